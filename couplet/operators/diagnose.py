"""Checks of a fit against the data: joint, calibration, count tables, permutation null."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from couplet.functions.distances import resolve_distance
from couplet.functions.sampling import keyed_generator, permuted_table_terms
from couplet.functions.vectors import argmax_label, normalise, total
from couplet.operators.joint import joint_table, pick_seed
from couplet.operators.metrics import check_mode, from_terms, information_terms
from couplet.operators.ranks import exact_quantiles
from couplet.operators.shared import clone_filter, materialise, task_count
from couplet.operators.splitting import block_totals, without_replacement
from couplet.spec import CLONE, COVARIATE, PHENOTYPE, Study


def joint_distribution_ppc(study: Study, *, covariate=None, distance_metric="l1", temperature=1.0, clones=None,
                           random_state=None) -> dict[str, DataFrame]:
    """Distance between observed frequencies and the model joint, per clone and averaged per covariate.

    The counts are row-local to the pair table, so model and data meet in one key join.
    """
    distance = resolve_distance(distance_metric)
    size = study.size
    model = joint_table(study, covariate=covariate, temperature=temperature, clones=clones, random_state=random_state)
    observed = clone_filter(study.counts(), clones)
    if covariate is not None:
        observed = observed.where(F.col(COVARIATE) == covariate)
    both = model.select(COVARIATE, CLONE, "mass").join(
        observed.select(COVARIATE, CLONE, normalise(F.col("counts"), size).alias("seen")), [COVARIATE, CLONE])
    table = both.where("seen is not null").select(
        COVARIATE, CLONE, distance(F.col("seen"), F.col("mass"), size).alias("distance"))
    return {"table": table, "per_covariate": table.groupBy(COVARIATE).agg(F.avg("distance").alias("mean_distance"))}


def phenotype_calibration(cells: DataFrame, phenotypes, *, n_bins: int = 10, probs: str = "probs",
                          observed: str = PHENOTYPE) -> dict[str, DataFrame]:
    """Reliability by bins of the largest probability, and the expected calibration error.

    Empty bins stay, with undefined means. The last bin includes its upper edge.
    """
    n_bins = int(n_bins)
    edges = [float(e) for e in np.linspace(0.0, 1.0, n_bins + 1)]
    conf = F.array_max(probs)
    # Edges are compared as literals: a multiplication would move values that sit on an edge.
    inner = F.array(*[F.lit(e) for e in edges[1:-1]]) if n_bins > 1 else None
    slot = F.size(F.filter(inner, lambda e: e <= F.col("conf"))) if n_bins > 1 else F.lit(0)
    correct = (argmax_label(F.col(probs), list(phenotypes)) == F.col(observed)).cast("double")
    scored = cells.select(conf.alias("conf"), F.coalesce(correct, F.lit(0.0)).alias("correct")).where("conf is not null")
    scored = scored.where(F.col("conf").between(0.0, 1.0))
    bins = scored.select(slot.alias("bin"), "conf", "correct").groupBy("bin").agg(
        F.avg("conf").alias("mean_pred"), F.avg("correct").alias("emp_freq"), F.count(F.lit(1)).alias("count"))
    every = cells.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    table = every.join(F.broadcast(bins), "bin", "left").select(       # bins has at most n_bins rows
        "bin", "mean_pred", "emp_freq", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    gap = F.sum(F.col("count") * F.abs(F.col("emp_freq") - F.col("mean_pred")))
    ece = bins.agg((F.coalesce(gap, F.lit(0.0)) / F.greatest(F.coalesce(F.sum("count"), F.lit(0)), F.lit(1))).alias("ece"))
    return {"table": table, "ece": ece}


# -- count tables -----------------------------------------------------------------------------------

_STATISTICS = ("mean_library_size", "median_library_size", "dropout_fraction", "mean_expression", "var_expression")


def _table_statistics(counts: DataFrame, keys: list[str], n_cells: int, n_features: int) -> DataFrame:
    """Library, dropout and entry statistics per key; cells without entries have library size 0."""
    entries = float(n_cells) * n_features
    libraries = materialise(counts.groupBy(*keys, "cell_id").agg(
        F.sum("count").alias("lib"), F.sum(F.col("count") * F.col("count")).alias("sq"),
        F.count_if(F.col("count") != 0).alias("nnz")))
    present = libraries.groupBy(*keys).agg(F.sum("lib").alias("__sum"), F.sum("sq").alias("__sq"),
                                           F.sum("nnz").alias("__nnz"), F.count(F.lit(1)).alias("__cells"))
    present = materialise(present)
    absent = present.where(F.col("__cells") < n_cells).select(
        *keys, F.lit(0.0).alias("lib"), (F.lit(int(n_cells)) - F.col("__cells")).alias("w"))
    weighted = libraries.select(*keys, F.col("lib").cast("double").alias("lib"), F.lit(1).cast("long").alias("w")) \
        .unionByName(absent.withColumn("w", F.col("w").cast("long")))
    medians = exact_quantiles(weighted, "lib", keys, (0.5,), ("median_library_size",), weight=F.col("w"))
    mean = F.col("__sum") / F.lit(entries)
    return present.join(medians, keys).select(
        *keys, (F.col("__sum") / F.lit(float(n_cells))).alias("mean_library_size"), "median_library_size",
        (F.lit(1.0) - F.col("__nnz") / F.lit(entries)).alias("dropout_fraction"), mean.alias("mean_expression"),
        (F.col("__sq") / F.lit(entries) - mean * mean).alias("var_expression"))


def compare_count_tables(observed: DataFrame, simulated: DataFrame, *, sim: str | None = "sim",
                         n_cells: int | None = None, n_features: int | None = None) -> DataFrame:
    """Observed against replicated count tables (``cell_id, feature, count``, replicates in ``sim``).

    Each statistic is taken per replicate and then averaged. Table shape defaults to the
    distinct cells and features of the observed table.
    """
    if n_cells is None:
        n_cells = observed.select("cell_id").distinct().count()
    if n_features is None:
        n_features = observed.select("feature").distinct().count()
    key = "__sim"
    sims = simulated.withColumn(key, F.col(sim).cast("string") if sim else F.lit("0"))
    per_sim = _table_statistics(sims, [key], n_cells, n_features)
    reference = _table_statistics(observed.withColumn(key, F.lit("observed")), [key], n_cells, n_features)
    rows = per_sim.withColumn("__of", F.lit("simulated")).unionByName(reference.withColumn("__of", F.lit("observed")))
    stacked = rows.select("__of", F.explode(F.array(*[
        F.struct(F.lit(s).alias("statistic"), F.col(s).cast("double").alias("v")) for s in _STATISTICS])).alias("r"))
    means = stacked.groupBy(F.col("r.statistic").alias("statistic")).agg(
        F.avg(F.when(F.col("__of") == "observed", F.col("r.v"))).alias("observed"),
        F.avg(F.when(F.col("__of") == "simulated", F.col("r.v"))).alias("simulated"))
    return means.select("statistic", "observed", "simulated",
                        F.abs(F.col("observed") - F.col("simulated")).alias("discrepancy"))


# -- permutation null ---------------------------------------------------------------------------------

BLOCK_CLONES = 20_000
PERMUTATIONS_PER_TASK = 100
TASK_SHUFFLED_CELLS = 1e7


def permutation_null(study: Study, *, metric: str = "mutual_information", covariate=None, groupby=None,
                     normalize_mode: str = "min", n_perm: int = 1000, random_state=None,
                     block_clones: int = BLOCK_CLONES) -> DataFrame:
    """Observed empirical NMI against shuffled phenotypes, per covariate (and group).

    Shuffling phenotypes with clone sizes fixed draws a random table with both margins fixed, and
    only its ``sum of x log2 x`` varies. So tasks receive clone sizes, not cells. A stratum's
    clones are dealt over bounded blocks; the phenotype totals of the blocks are drawn down a
    splitting tree, and the partial sums are added.
    """
    if metric != "mutual_information":
        raise ValueError(f"no null for metric {metric!r}: pass 'mutual_information'")
    check_mode(normalize_mode)
    study.check_covariate(covariate)
    n_perm, size, seed = int(n_perm), study.size, pick_seed(random_state)
    ct = study.counts(groupby)
    if covariate is not None:
        ct = ct.where(F.col(COVARIATE) == covariate)
    keys = [COVARIATE]
    if groupby is not None:
        ct, keys = ct.where("grp is not null"), [COVARIATE, "grp"]
    ct = ct.withColumn("mass", F.col("counts"))
    terms = materialise(ct.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_clones"),
                                              *information_terms(F.col("mass"), size)))
    observed = from_terms(terms, keys, size).select(*keys, F.col(f"nmi_{normalize_mode}").alias("observed"))
    if n_perm <= 0:
        raise ValueError("n_perm must be positive")

    cells = sum((F.col(f"__k{j}") for j in range(size)), F.lit(0.0))
    scale = terms.agg(F.max("n_clones").alias("clones"), F.sum(cells).alias("cells")).first()
    n_blocks = -(-int(scale["clones"] or 1) // block_clones)
    sizes = ct.select(*keys, F.pmod(F.xxhash64(CLONE), F.lit(n_blocks)).cast("int").alias("block"),
                      total(F.col("mass"), size).cast("long").alias("n")).where("n > 0")
    blocks = sizes.groupBy(*keys, "block").agg(F.collect_list("n").alias("sizes"),   # about block_clones entries
                                               F.sum("n").alias("cells"))
    blocks = materialise(blocks)
    margins = terms.select(*keys, F.array(*[F.col(f"__k{j}").cast("long") for j in range(size)]).alias("margin"))
    n_chunks = -(-n_perm // PERMUTATIONS_PER_TASK)
    drawn_by = ", ".join(f"`{k}` {ct.schema[k].dataType.simpleString()}" for k in keys) + ", stratum long, chunk long, width int"

    def begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            width = np.minimum(PERMUTATIONS_PER_TASK, n_perm - frame["chunk"] * PERMUTATIONS_PER_TASK)
            frame["totals"] = [np.tile(np.asarray(m, np.int64), (w, 1)).tobytes() for m, w in zip(frame["margin"], width)]
            yield frame.drop(columns="margin").assign(width=width)

    roots = margins.select(*keys, F.xxhash64(*keys).alias("stratum"),
                           F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_chunks - 1).cast("long"))).alias("chunk"), "margin") \
        .mapInPandas(begin, f"{drawn_by}, totals binary")
    held = blocks.select(*keys, F.col("block").cast("long").alias("block"), "sizes", F.array("cells").alias("weights"))
    shares = block_totals(roots, held.select(*keys, "block", "weights"), keys, n_blocks, seed, without_replacement)
    tasks = task_count(study.spark, float(scale["cells"] or 0) * n_perm, TASK_SHUFFLED_CELLS)
    if n_blocks == 1:                       # a stratum may have no cells at all, and then no block
        shares = shares.withColumn("block", F.lit(0).cast("long"))
    work = shares.join(held.drop("weights"), [*keys, "block"]).repartition(tasks, *keys, "block", "chunk")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                inner = keyed_generator(seed, row.stratum, row.chunk, row.block + 1)
                part = permuted_table_terms(inner, np.asarray(row.sizes), np.frombuffer(row.totals, np.int64).reshape(row.width, -1))
                out.append(pd.DataFrame({**{k: getattr(row, k) for k in keys},
                                         "draw": row.chunk * PERMUTATIONS_PER_TASK + np.arange(row.width), "part": part}))
            if out:
                yield pd.concat(out)

    kinds = ", ".join(f"`{k}` {ct.schema[k].dataType.simpleString()}" for k in keys)
    parts = work.mapInPandas(run, f"{kinds}, draw long, part double")
    drawn = parts.groupBy(*keys, "draw").agg(F.sum("part").alias("__a"))
    # margins are fixed, so every permutation shares all other terms of its stratum
    fixed = terms.select(*keys, "__r", *[f"__k{j}" for j in range(size)])
    nulls = from_terms(drawn.join(fixed, keys), keys, size).select(*keys, F.col(f"nmi_{normalize_mode}").alias("null"))
    compared = nulls.join(observed, keys)
    out = compared.groupBy(*keys).agg(
        F.max("observed").alias("observed"), F.avg("null").alias("null_mean"),
        F.coalesce(F.stddev_samp("null"), F.lit(0.0)).alias("null_sd"),
        F.count_if(F.col("null") >= F.col("observed") - 1e-12).alias("__reach"))
    z = F.when(F.col("null_sd") > 0, F.try_divide(F.col("observed") - F.col("null_mean"), F.col("null_sd")))
    labels = [F.col("grp").alias(groupby)] if groupby is not None else []
    return out.select(COVARIATE, "observed", "null_mean", "null_sd", z.alias("z"),
                      ((1.0 + F.col("__reach")) / (1.0 + n_perm)).alias("p"), *labels)


# -- estimator error ----------------------------------------------------------------------------------

def estimator_errors(df: DataFrame, keys: list[str], *, estimate: str = "value", population: str = "population",
                     realised: str = "realised", low: str = "hdi_low", high: str = "hdi_high") -> DataFrame:
    """Mean absolute error against population and realised truth, and interval coverage, per key."""
    e, p, r = F.col(estimate), F.col(population), F.col(realised)
    inside = F.when(F.col(low).isNotNull() & F.col(high).isNotNull(), ((F.col(low) <= r) & (r <= F.col(high))).cast("double"))
    return df.groupBy(*keys).agg(F.avg(F.abs(e - p)).alias("mae_population"), F.avg(F.abs(e - r)).alias("mae_realised"),
                                 F.avg(inside).alias("hdi_coverage"), F.count(F.lit(1)).alias("n"))
