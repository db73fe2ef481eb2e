"""Clone-level preprocessing of the cell table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from couplet.functions.vectors import argmax_label
from couplet.operators.shared import lookup_join, materialise
from couplet.spec import CLONE, COVARIATE, PHENOTYPE, Study


def _with_key_counts(cells: DataFrame, key: str, out: str) -> DataFrame:
    """Cells plus the number of cells sharing their key: counted first, then looked up by key.

    A window over the key would gather a hot clone in one task.
    """
    counts = materialise(cells.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(out)))
    return lookup_join(cells, counts, [key], out, row_bytes=96, keep_unmatched=True)


_MISSING = "nan"  # Fixed value: label text of a missing clone or group in a candidate name.


def scope_clones(cells: DataFrame, clone: str, group: str, out: str | None = None) -> DataFrame:
    """``clone@group``, which makes clones disjoint across groups."""
    return cells.withColumn(out or clone, F.concat_ws("@", F.col(clone).cast("string"), F.col(group).cast("string")))


def group_singletons(cells: DataFrame, *, clonotype_key: str = "trb", groupby: str = "patient",
                     target_col: str = "trb_unique", min_clone_size: int = 10,
                     candidate_col: str = "trb_candidate") -> DataFrame:
    """Add ``clone_group`` and its replacement: small clones of a group share ``Singleton_<group>``."""
    group = F.coalesce(F.col(groupby).cast("string"), F.lit(_MISSING))
    clone = F.coalesce(F.col(clonotype_key).cast("string"), F.lit(_MISSING))
    cells = cells.withColumn(candidate_col, F.concat(clone, F.lit("_"), group))
    counted = _with_key_counts(cells, candidate_col, "__cells")
    small = F.col("__cells") < min_clone_size
    target = F.when(small, F.concat(F.lit("Singleton_"), group)).otherwise(F.col(candidate_col))
    return counted.withColumn(target_col, target).select(*cells.columns, target_col)


def clone_counts(study: Study) -> DataFrame:
    """Cells per clone over all covariates."""
    return study.counts().groupBy(CLONE).agg(F.sum("n_cells").alias("clone_size"))


def clone_size(study: Study, *, key_added: str = "clone_size") -> DataFrame:
    """Cells with the size of their clone."""
    counts = materialise(clone_counts(study).withColumnRenamed("clone_size", key_added))
    return lookup_join(study.cells, counts, [CLONE], key_added, row_bytes=96, keep_unmatched=True)


def modal_phenotype(study: Study) -> DataFrame:
    """Most frequent phenotype per clone; ties go to the first label in string order.

    Counts collapse to one vector per clone, so the choice is row-local.
    """
    size = study.size
    order = sorted(range(size), key=lambda j: study.phenotypes[j])
    sums = study.counts().groupBy(CLONE).agg(*[F.sum(F.col("counts")[j]).alias(f"c{j}") for j in range(size)])
    ranked = sums.select(CLONE, F.array(*[F.col(f"c{j}") for j in order]).alias("n"))
    return ranked.select(CLONE, argmax_label(F.col("n"), [study.phenotypes[j] for j in order]).alias("modal_phenotype"),
                         F.array_max("n").cast("long").alias("n_modal"),
                         F.aggregate("n", F.lit(0.0), lambda a, x: a + x).cast("long").alias("__cells"))


def modal_flags(study: Study) -> DataFrame:
    """Cells with their clone's modal phenotype and whether they carry it."""
    modal = materialise(modal_phenotype(study))
    cells = lookup_join(study.cells, modal.drop("n_modal"), [CLONE], "__cells", row_bytes=128,
                        keep_unmatched=True)
    return cells.drop("__cells").withColumn("is_modal", F.col(PHENOTYPE) == F.col("modal_phenotype"))


def dataset_summary(study: Study, groupby: str | None = None) -> DataFrame:
    """One row: cells, clones, phenotypes, covariates, groups, largest clone and key nulls.

    Distinct counts come from the pair table, so the cells are scanned once for nulls only.
    """
    groupby = study.resolve_groupby(groupby)
    nulls = study.cells.agg(
        F.count(F.lit(1)).alias("n_cells"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in (CLONE, PHENOTYPE, COVARIATE)])
    ct = study.counts(groupby)
    size = study.size
    per_clone = ct.groupBy(CLONE).agg(F.sum("n_cells").alias("n"))
    clones = per_clone.agg(F.count(F.lit(1)).alias("n_clones"), F.max("n").alias("largest_clone"))
    pairs = ct.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_distinct(COVARIATE).alias("n_covariates"),
        *[F.max(F.when(F.col("counts")[j] > 0, 1).otherwise(0)).alias(f"__p{j}") for j in range(size)],
    )
    seen = sum((F.col(f"__p{j}") for j in range(size)), F.lit(0))
    pairs = pairs.select("n_pairs", "n_covariates", seen.cast("long").alias("n_phenotypes"))
    one = F.lit(1).alias("__one")
    out = nulls.select("*", one).join(clones.select("*", one), "__one").join(pairs.select("*", one), "__one")
    if groupby is not None:
        groups = ct.agg(F.count_distinct("grp").alias("n_groups"))
        out = out.join(groups.select("*", one), "__one")
    return out.drop("__one")


def clone_rank(study: Study, groupby: str | None = None) -> DataFrame:
    """Repertoire curve: clones of a group by size, ties by clone, rank from 1."""
    groupby = study.resolve_groupby(groupby)
    sizes = study.counts(groupby).where("grp is not null").groupBy("grp", CLONE).agg(F.sum("n_cells").alias("clone_size"))
    sizes = materialise(sizes)
    if sizes.count() <= _RANK_WINDOW:
        w = Window.partitionBy("grp").orderBy(F.col("clone_size").desc(), F.col(CLONE))
        return sizes.select(F.col("grp").alias(groupby), CLONE, "clone_size", F.row_number().over(w).alias("rank"))
    return _blockwise_rank(sizes).select(F.col("grp").alias(groupby), CLONE, "clone_size", "rank")


_RANK_WINDOW = 500_000
_RANK_BLOCK = 100_000


def _blockwise_rank(sizes: DataFrame, block: int = _RANK_BLOCK) -> DataFrame:
    """Rank by (size desc, clone) for any number of clones per group.

    Sizes repeat a lot, so (group, size) totals are few; within one (group, size) clones are
    numbered in hash-free clone order inside sub-blocks cut by clone quantiles of that tie.
    """
    from couplet.operators.ranks import distinct_ordinals
    order = distinct_ordinals(sizes.select(CLONE), CLONE)
    rows = sizes.join(order, CLONE)
    tie = ["grp", "clone_size"]
    rows = rows.withColumn("__sub", F.floor(F.col("ordinal") / block))
    inner = Window.partitionBy(*tie, "__sub").orderBy("ordinal")
    rows = rows.select("*", F.row_number().over(inner).alias("__local"))
    subs = rows.groupBy(*tie, "__sub").agg(F.count(F.lit(1)).alias("__n"))
    lower = Window.partitionBy(*tie).orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    subs = subs.select("*", F.coalesce(F.sum("__n").over(lower), F.lit(0)).alias("__in_tie"))
    ties = subs.groupBy(*tie).agg(F.sum("__n").alias("__t"))
    above = Window.partitionBy("grp").orderBy(F.col("clone_size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.select(*tie, F.coalesce(F.sum("__t").over(above), F.lit(0)).alias("__above"))
    shifts = materialise(subs.join(ties, tie).select(*tie, "__sub", "__n", (F.col("__in_tie") + F.col("__above")).alias("__shift")))
    out = lookup_join(rows, shifts, [*tie, "__sub"], "__n", row_bytes=96)
    return out.select("grp", CLONE, "clone_size", (F.col("__local") + F.col("__shift")).cast("int").alias("rank"))


def largest_share(study: Study, groupby: str | None = None) -> DataFrame:
    """Share of a group's cells held by its largest clone."""
    groupby = study.resolve_groupby(groupby)
    sizes = study.counts(groupby).where("grp is not null").groupBy("grp", CLONE).agg(F.sum("n_cells").alias("n"))
    return sizes.groupBy("grp").agg((F.max("n") / F.sum("n")).alias("largest_share"), F.max("n").alias("largest_clone"),
                                    F.sum("n").alias("n_cells")).withColumnRenamed("grp", groupby)


def clones_per_group(study: Study, groupby: str | None = None) -> DataFrame:
    """Distinct clones per group."""
    groupby = study.resolve_groupby(groupby)
    pairs = study.counts(groupby).where("grp is not null").select("grp", CLONE).distinct()
    return pairs.groupBy("grp").agg(F.count(F.lit(1)).alias("n_clones")).withColumnRenamed("grp", groupby)
