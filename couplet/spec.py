"""Registration: column roles, category order, and the study handle the operators work on."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace as _replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from couplet.operators.shared import WIDE_AGGREGATE, LookupSide, lookup_join, materialise, measure_side

# Category lists live on the driver and in plans; more levels than this is a wrong column choice.
MAX_LEVELS = 10_000

CELL_ID, CLONE, PHENOTYPE, COVARIATE = "cell_id", "clonotype", "phenotype", "covariate"


@dataclass(frozen=True)
class CouplingSpec:
    """Names, in the user's table, of the columns that play each role."""

    clonotype: str
    phenotype: str
    covariate: str
    cell_id: str | None = None
    batch: str | None = None
    replicate: str | None = None
    layer: str | None = None

    def roles(self) -> dict[str, str]:
        named = {CELL_ID: self.cell_id, CLONE: self.clonotype, PHENOTYPE: self.phenotype,
                 COVARIATE: self.covariate}
        return {k: v for k, v in named.items() if v is not None}


def register_cells(cells: DataFrame, *, clonotype_key: str, phenotype_key: str, covariate_key: str,
                   cell_id_key: str | None = None, batch_key: str | None = None,
                   replicate: str | None = None, layer: str | None = None,
                   phenotype_levels: list[str] | None = None,
                   covariate_levels: list[str] | None = None,
                   clone_labels: DataFrame | None = None) -> "Study":
    """Name the roles of a cell table's columns.

    Labels such as patient or response may be columns of ``cells``, or come once per clone in
    ``clone_labels`` (clone column plus label columns), which saves a join on the cell side.
    Level lists fix the category order; a missing list is read as the sorted distinct labels.
    """
    spec = CouplingSpec(clonotype_key, phenotype_key, covariate_key, cell_id_key, batch_key,
                        replicate, layer)
    label_columns = set(clone_labels.columns) if clone_labels is not None else set()
    wanted = {"clonotype_key": clonotype_key, "phenotype_key": phenotype_key,
              "covariate_key": covariate_key, "cell_id_key": cell_id_key, "batch_key": batch_key,
              "replicate": replicate}
    for argument, column in wanted.items():
        known = set(cells.columns) | (label_columns if argument in ("batch_key", "replicate") else set())
        if column is not None and column not in known:
            raise ValueError(f"{argument}={column!r} is not a column of the cell table {sorted(known)}")
    if clone_labels is not None:
        if clonotype_key not in label_columns:
            raise ValueError(f"clone_labels has no clone column {clonotype_key!r}")
        clone_labels = clone_labels.withColumnRenamed(clonotype_key, CLONE)

    roles = spec.roles()
    used = set(roles.values())
    others = [c for c in cells.columns if c not in used]
    clash = [c for c in others if c in roles]
    if clash:
        raise ValueError(f"columns {clash} would collide with the role names; rename them first")
    picked = [F.col(source).cast("string").alias(role) if role in (PHENOTYPE, COVARIATE)
              else F.col(source).alias(role) for role, source in roles.items()]
    table = cells.select(*picked, *others)
    return Study(
        spec=spec, cells=table, clone_labels=clone_labels,
        phenotypes=tuple(phenotype_levels or levels_of(table, PHENOTYPE)),
        covariates=tuple(covariate_levels or levels_of(table, COVARIATE)),
    )


def levels_of(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct labels of a category column (one aggregate; bounded on the driver)."""
    rows = df.select(F.col(column).cast("string").alias("x")).where("x is not null") \
        .groupBy("x").agg(F.lit(1)).limit(MAX_LEVELS + 1).collect()
    if len(rows) > MAX_LEVELS:
        raise ValueError(f"{column!r} has more than {MAX_LEVELS} levels; it is not a category column")
    return sorted(r["x"] for r in rows)


@dataclass(frozen=True)
class Study:
    """A registered cell table plus, once known, its posterior and per-cell evidence.

    ``posterior``: ``clonotype, covariate, p array<double>, conc array<double>`` per observed pair.
    ``cells`` may carry ``logits`` / ``probs`` / ``latent`` array columns.
    ``gate=None`` is the additive rule. Every method returns a new value.
    """

    spec: CouplingSpec
    cells: DataFrame
    phenotypes: tuple[str, ...]
    covariates: tuple[str, ...]
    clone_labels: DataFrame | None = None
    posterior: DataFrame | None = None
    local_scale: float | None = None
    gate: float | None = None
    classifier_temperature: float = 1.0
    _stages: dict = field(default_factory=dict, repr=False, compare=False)

    def __post_init__(self):
        if self.gate is not None and not 0.0 <= self.gate <= 1.0:
            raise ValueError(f"gate must be in [0, 1] or None, got {self.gate!r}")

    @property
    def size(self) -> int:
        return len(self.phenotypes)

    @property
    def spark(self):
        return self.cells.sparkSession

    def replace(self, **changes) -> "Study":
        keep = {} if {"cells", "clone_labels", "phenotypes", "covariates"} & set(changes) else self._stages
        return _replace(self, _stages=dict(keep), **changes)

    # -- labels -----------------------------------------------------------------------------

    def resolve_groupby(self, groupby: str | None) -> str | None:
        """Explicit column, else the registered replicate."""
        return groupby if groupby is not None else self.spec.replicate

    def has_label(self, column: str) -> bool:
        return column in self.cells.columns or (
            self.clone_labels is not None and column in self.clone_labels.columns)

    def check_covariate(self, covariate: str | None) -> None:
        if covariate is not None and covariate not in self.covariates:
            raise ValueError(f"covariate {covariate!r} not found among {list(self.covariates)}")

    # -- the clone x covariate count table ------------------------------------------------------

    def counts(self, groupby: str | None = None, splitby: str | None = None) -> DataFrame:
        """Stage table ``clonotype, covariate, n_cells, counts[, grp][, split]``, validated.

        One hash aggregate over the cells; every check below reads this much smaller table.
        """
        if splitby is not None and groupby is None:
            raise ValueError("splitby requires groupby: name the column of the replicates that make up the arms")
        for name, column in (("groupby", groupby), ("splitby", splitby)):
            if column is not None and not self.has_label(column):
                raise ValueError(f"{name}={column!r} is not a column of the cell table")
        key = ("counts", groupby, splitby)
        if key not in self._stages:
            self._stages[key] = self._build_counts(groupby, splitby)
        return self._stages[key]

    def spanning_clones(self, groupby: str) -> DataFrame:
        """``clonotype, lo, hi``: clones with cells in more than one group, which grouped metrics refuse."""
        ct = self._label_table(groupby, None)
        return _spanning(ct).groupBy(CLONE).agg(F.min("grp_low").alias("lo"), F.max("grp").alias("hi"))

    def split_ranges(self, groupby: str, splitby: str) -> DataFrame:
        """``grp, lo, hi``: smallest and largest split label of every group; they must agree."""
        return self._label_table(groupby, splitby).where("grp is not null").groupBy("grp").agg(
            F.min("split_low").alias("lo"), F.max("split_high").alias("hi"))

    def _build_counts(self, groupby, splitby) -> DataFrame:
        if groupby is None:
            return materialise(count_table(self.cells, self.phenotypes, [CLONE, COVARIATE]))
        ct = materialise(self._label_table(groupby, splitby))
        self._stages.setdefault(("counts", None, None), ct.select(CLONE, COVARIATE, "n_cells", "counts"))
        fill = self._check_labels(ct, groupby, splitby)
        columns = [CLONE, COVARIATE, "n_cells", "counts", "grp"]
        if splitby is None:
            return ct.select(*columns)
        if not fill:
            return ct.select(*columns, F.col("split_high").alias("split"))
        # some clones carry no split label of their own: take it from their group
        groups = materialise(ct.where("grp is not null").groupBy("grp").agg(
            F.max("split_high").alias("split"), F.count(F.lit(1)).alias("__rows")))
        return materialise(lookup_join(ct.select(*columns), groups, ["grp"], "__rows", keep_unmatched=True).drop("__rows"))

    def _label_table(self, groupby, splitby) -> DataFrame:
        """Counts per pair with the range of labels of its clone, before any check."""
        base_key = ("counts", None, None)
        labels = [c for c in (groupby, splitby) if c is not None]
        if any(c in self.cells.columns for c in labels):
            ct = self._labelled_from_cells(groupby, splitby)
        else:
            base = self._stages.get(base_key)
            if base is None:
                base = count_table(self.cells, self.phenotypes, [CLONE, COVARIATE])
            per_clone = self.clone_labels.where(F.col(CLONE).isNotNull()).groupBy(CLONE).agg(
                *_label_ranges(groupby, splitby))
            ct = base.join(per_clone, CLONE, "left").withColumn(
                "n_unlabelled", F.when(F.col("grp").isNull(), F.col("n_cells")).otherwise(F.lit(0).cast("long")))
        return ct

    def _labelled_from_cells(self, groupby, splitby) -> DataFrame:
        """Counts per pair with label ranges, labels being columns of the cells.

        The cell pass is one hash aggregate with the labels as keys; label ranges are taken on
        its much smaller output.
        """
        size = self.size
        labels = [c for c in (groupby, splitby) if c is not None]
        in_cells = [c for c in labels if c in self.cells.columns]
        ct = count_table(self.cells, self.phenotypes, [CLONE, COVARIATE, *in_cells])
        from_map = [c for c in labels if c not in in_cells]
        if from_map:
            # one row per clone; labels that disagree keep both ends of their range for the checks
            per_clone = self.clone_labels.where(F.col(CLONE).isNotNull()).groupBy(CLONE).agg(
                *[F.min(c).alias(c) for c in from_map], *[F.max(c).alias(f"__high_{c}") for c in from_map])
            ct = ct.join(per_clone, CLONE, "left")
        unlabelled = F.sum(F.when(F.col(groupby).isNull(), F.col("n_cells")).otherwise(0)).alias("n_unlabelled")
        if size <= WIDE_AGGREGATE:
            sums = [F.sum(F.col("counts")[j]).alias(f"c{j}") for j in range(size)]
            counts = F.array(*[F.col(f"c{j}") for j in range(size)])
        else:
            sums = [F.collect_list("counts").alias("__parts")]      # one row per label combination
            counts = F.aggregate("__parts", F.array_repeat(F.lit(0.0), size),
                                 lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
        merged = ct.groupBy(CLONE, COVARIATE).agg(
            F.sum("n_cells").alias("n_cells"), *sums, unlabelled,
            *_label_ranges(groupby, splitby, {c: f"__high_{c}" for c in from_map}))
        per_clone = Window.partitionBy(CLONE)       # at most one row per covariate level
        return merged.select(
            CLONE, COVARIATE, "n_cells", counts.alias("counts"), "n_unlabelled",
            F.min("grp_low").over(per_clone).alias("grp_low"), F.max("grp").over(per_clone).alias("grp"),
            *(["split_low", "split_high"] if splitby is not None else []))

    def _check_labels(self, ct: DataFrame, groupby: str, splitby: str | None) -> bool:
        """Disjoint clones, constant split per group, warning on unlabelled cells: one job.

        Returns whether a clone of a labelled group lacks its own split label.
        """
        per_group = ct.groupBy("grp").agg(
            F.count_if(F.col("grp_low") != F.col("grp")).alias("spanning"),
            F.sum("n_unlabelled").alias("missing"), F.sum("n_cells").alias("cells"),
            *([F.min("split_low").alias("lo"), F.max("split_high").alias("hi"),
               F.count_if(F.col("split_high").isNull()).alias("bare")] if splitby is not None else []))
        known = F.col("grp").isNotNull()
        found = per_group.agg(
            F.sum("spanning").alias("spanning"), F.sum("missing").alias("missing"), F.sum("cells").alias("cells"),
            *([F.count_if(known & (F.col("lo") != F.col("hi"))).alias("mixed"),
               F.count_if(known & F.col("hi").isNotNull() & (F.col("bare") > 0)).alias("bare")] if splitby is not None else []),
        ).first()
        if found["spanning"]:
            r = _spanning(ct).limit(1).collect()[0]
            raise ValueError(
                f"scope clone ids to {groupby!r} first: {r[CLONE]!r} spans groups {r['grp_low']!r} and {r['grp']!r}")
        if splitby is not None and found["mixed"]:
            bad = per_group.where(known & (F.col("lo") != F.col("hi"))).orderBy("grp").limit(5).collect()
            raise ValueError(
                f"give every {groupby!r} one value of {splitby!r}; it is not constant within {[r['grp'] for r in bad]}")
        if found["missing"]:
            warnings.warn(
                f"left out {found['missing']} of {found['cells']} cells ({100 * found['missing'] / found['cells']:.1f}%): "
                f"fill {groupby!r} to count them",
                UserWarning, stacklevel=4)
        return bool(splitby is not None and found["bare"])

    # -- posterior and evidence ---------------------------------------------------------------

    def with_posterior(self, posterior: DataFrame, local_scale: float | None = None,
                       check: bool = True) -> "Study":
        """Attach a fitted ``clonotype, covariate, p[, conc]`` table (imported or estimated)."""
        missing = {CLONE, COVARIATE, "p"} - set(posterior.columns)
        if missing:
            raise ValueError(f"posterior lacks columns {sorted(missing)}")
        study = self.replace(posterior=posterior, local_scale=local_scale)
        for key in [k for k in study._stages if k[0] == "dims"]:
            del study._stages[key]
        if check:
            from couplet.sources.tables import check_posterior
            check_posterior(study)
        return study

    def with_evidence(self, evidence: DataFrame | None = None, *, gate: float | None = None,
                      classifier_temperature: float = 1.0) -> "Study":
        """Attach per-cell ``logits`` (and optionally ``probs``, ``latent``) by cell id.

        No cell is dropped: one without evidence fails the jobs that need its logits. A cell id
        with two rows of evidence fails the job that reads it.
        """
        cells = self.cells
        if evidence is not None:
            if CELL_ID not in cells.columns or CELL_ID not in evidence.columns:
                raise ValueError("evidence is joined by cell id; register cell_id_key and name it 'cell_id'")
            extra = [c for c in ("logits", "probs", "latent") if c in evidence.columns]
            # one row per cell: the count uses the join's own partitioning, and a filter cannot be pruned away
            per_cell = F.count(F.lit(1)).over(Window.partitionBy(CELL_ID))
            once = F.when(F.col("__n") > 1, F.raise_error(F.lit("the evidence has two rows for one cell id"))
                          .cast("boolean")).otherwise(F.lit(True))
            vectors = evidence.where(F.col(CELL_ID).isNotNull()).select(CELL_ID, *extra, per_cell.alias("__n")) \
                .where(once).drop("__n")
            cells = cells.drop(*extra).join(vectors, CELL_ID, "left")
        study = self.replace(gate=gate, classifier_temperature=classifier_temperature)
        return _replace(study, cells=cells)

    def dims(self, groupby: str | None = None, splitby: str | None = None) -> tuple[DataFrame, LookupSide]:
        """Posterior rows with cell counts and labels (the lookup side of the cell fold), and its size."""
        if self.posterior is None:
            raise RuntimeError("no posterior attached: estimate one or import it with with_posterior")
        key = ("dims", groupby, splitby)
        if key not in self._stages:
            ct = self.counts(groupby, splitby)
            labels = [c for c in ("grp", "split") if c in ct.columns]
            fitted = [c for c in ("p", "conc") if c in self.posterior.columns]
            ct = ct.select(CLONE, COVARIATE, "n_cells", *labels)
            side = measure_side(ct, "n_cells", 160 + 24 * self.size)
            joined = self.posterior.select(CLONE, COVARIATE, *fitted).join(ct, [CLONE, COVARIATE])
            self._stages[key] = (joined if side.broadcast else materialise(joined), side)
        return self._stages[key]


def _spanning(ct: DataFrame) -> DataFrame:
    return ct.where(F.col("grp_low") != F.col("grp"))


def _label_ranges(groupby: str, splitby: str | None, highs: dict[str, str] | None = None) -> list[Column]:
    """Smallest and largest label; a split label counts only where the group is known.

    ``highs`` names the column of the largest label where a label column holds the smallest.
    """
    highs = highs or {}
    g = F.col(groupby)
    out = [F.min(g).alias("grp_low"), F.max(highs.get(groupby, groupby)).alias("grp")]
    if splitby is not None:
        low, high = (F.when(g.isNotNull(), F.col(c)) for c in (splitby, highs.get(splitby, splitby)))
        out += [F.min(low).alias("split_low"), F.max(high).alias("split_high")]
    return out


def count_table(cells: DataFrame, levels, keys: list[str]) -> DataFrame:
    """Cells per key and phenotype as one dense vector in level order (zero-filled)."""
    cells = cells.where(F.col(CLONE).isNotNull() & F.col(COVARIATE).isNotNull()) \
        if CLONE in keys and COVARIATE in keys else cells
    size = len(levels)
    if size <= WIDE_AGGREGATE:
        per_level = [F.count_if(F.col(PHENOTYPE) == F.lit(x)).cast("double").alias(f"c{j}")
                     for j, x in enumerate(levels)]
        out = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), *per_level)
        return out.select(*keys, "n_cells", F.array(*[F.col(f"c{j}") for j in range(size)]).alias("counts"))
    long = cells.groupBy(*keys, PHENOTYPE).agg(F.count(F.lit(1)).alias("n"))
    rows = long.groupBy(*keys).agg(
        F.sum("n").alias("n_cells"),
        F.map_from_entries(F.collect_list(F.when(F.col(PHENOTYPE).isNotNull(),
                                                 F.struct(PHENOTYPE, "n")))).alias("m"),
    )
    dense = F.transform(F.array(*[F.lit(x) for x in levels]),
                        lambda x: F.coalesce(F.try_element_at("m", x).cast("double"), F.lit(0.0)))
    return rows.select(*keys, "n_cells", dense.alias("counts"))
