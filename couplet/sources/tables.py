"""Reading cell tables and checking imported posterior and evidence tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from couplet.functions.vectors import is_finite, total
from couplet.spec import CLONE, COVARIATE, PHENOTYPE, Study


def load_cells(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """Read a cell table; NaN in floating columns becomes NULL, the one undefined value used here."""
    df = spark.read.format(format).options(**options).load(path)
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floating}) if floating else df


def union_cells(*blocks: DataFrame) -> DataFrame:
    """Stack cell tables by column name; columns missing from a block are NULL there."""
    if not blocks:
        raise ValueError("union_cells needs at least one table")
    out = blocks[0]
    for block in blocks[1:]:
        out = out.unionByName(block, allowMissingColumns=True)
    return out


def check_posterior(study: Study, tolerance: float = 1e-6) -> None:
    """Vector lengths, signs and sums of the pair table; every observed pair must be covered.

    One aggregate over the pair table and one anti join of pair keys.
    """
    size = study.size
    df = study.posterior
    p = F.col("p")
    has_conc = "conc" in df.columns
    sized = F.when(F.size(p) == size, p)
    checks = [
        F.count_if(p.isNull() | (F.size(p) != size)).alias("length"),
        F.count_if(F.exists("p", lambda x: x < 0)).alias("negative"),
        F.count_if(~F.exists("p", lambda x: ~is_finite(x)) & (F.abs(total(sized, size) - 1.0) > tolerance)).alias("sum"),
        (F.count_if(F.size("conc") != F.size("p")) if has_conc else F.lit(0)).alias("conc"),
    ]
    bad = df.agg(*checks).first()
    if bad["length"]:
        raise ValueError(f"{bad['length']} posterior rows do not hold {size} phenotype entries")
    if bad["conc"]:
        raise ValueError(f"{bad['conc']} posterior rows have a conc vector whose length differs from p")
    if bad["negative"]:
        raise ValueError(f"{bad['negative']} posterior rows hold negative probabilities")
    if bad["sum"]:
        raise ValueError(f"{bad['sum']} posterior rows do not sum to 1")
    twice = df.groupBy(CLONE, COVARIATE).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the posterior has {twice[0]['n']} rows for ({twice[0][CLONE]!r}, {twice[0][COVARIATE]!r})")
    uncovered = missing_pairs(study)
    row = uncovered.limit(1).collect()
    if row:
        raise ValueError(f"cells exist for ({row[0][CLONE]!r}, {row[0][COVARIATE]!r}) but the posterior has no such row")


def missing_pairs(study: Study) -> DataFrame:
    """Observed (clone, covariate) pairs without a posterior row."""
    return study.counts().select(CLONE, COVARIATE).join(
        study.posterior.select(CLONE, COVARIATE), [CLONE, COVARIATE], "left_anti")


def import_posterior(study: Study, path: str, *, local_scale: float | None = None, format: str = "parquet") -> Study:
    """Attach an external fit stored as ``clonotype, covariate, p[, conc]``."""
    return study.with_posterior(study.spark.read.format(format).load(path), local_scale=local_scale)


def import_evidence(study: Study, path: str, *, gate: float | None = None, classifier_temperature: float = 1.0,
                    format: str = "parquet") -> Study:
    """Attach external per-cell vectors stored as ``cell_id, logits[, probs, latent]``."""
    evidence = study.spark.read.format(format).load(path)
    for column in ("logits", "probs"):
        if column in evidence.columns:
            wrong = evidence.agg(F.count_if(F.size(column) != study.size).alias("n")).first()["n"]
            if wrong:
                raise ValueError(f"{wrong} evidence rows do not hold {study.size} entries in {column!r}")
    return study.with_evidence(evidence, gate=gate, classifier_temperature=classifier_temperature)


def dictionary(study: Study, axis: str) -> DataFrame:
    """``axis, label, ordinal`` in declared order; clone labels are sorted and never collected."""
    if axis in (PHENOTYPE, COVARIATE):
        levels = study.phenotypes if axis == PHENOTYPE else study.covariates
        return study.spark.createDataFrame([(axis, x, i) for i, x in enumerate(levels)],
                                           "axis string, label string, ordinal int")
    if axis != CLONE:
        raise ValueError(f"axis must be one of {(PHENOTYPE, COVARIATE, CLONE)}, got {axis!r}")
    from couplet.operators.ranks import distinct_ordinals
    return distinct_ordinals(study.counts().select(F.col(CLONE).alias("label")), "label") \
        .select(F.lit(CLONE).alias("axis"), F.col("label").cast("string").alias("label"), "ordinal")


def registry(study: Study) -> DataFrame:
    """Observed (clone, covariate) pairs with their cells."""
    return study.counts().select(CLONE, COVARIATE, "n_cells")


def export_tables(study: Study) -> dict[str, DataFrame]:
    """Everything a study has learned, as plain tables."""
    out = {"phenotypes": dictionary(study, PHENOTYPE), "covariates": dictionary(study, COVARIATE),
           "registry": registry(study)}
    if study.posterior is not None:
        fitted = [c for c in ("p", "conc") if c in study.posterior.columns]
        out["posterior"] = study.posterior.select(CLONE, COVARIATE, *fitted).join(registry(study), [CLONE, COVARIATE])
    if "logits" in study.cells.columns:
        from couplet.operators.evidence import score_cells
        extra = [c for c in ("latent",) if c in study.cells.columns]
        scored = score_cells(study) if study.posterior is not None else study.cells
        columns = [c for c in ("cell_id", "logits", "log_posterior", "probs", "predicted", *extra) if c in scored.columns]
        out["evidence"] = scored.select(*columns)
    return out
