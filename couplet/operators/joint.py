"""The clone x phenotype joint per covariate: the table every metric reads.

``partials`` are non-negative vectors keyed by (covariate, clone, labels, draw) whose sum per key
is the joint: one per cell when cells are folded, one per pair when they are not. Folding them is
one hash aggregate with map-side combine, so neither a hot clone nor a hot group gathers rows.

Under posterior draws a partial is a ``block``: one row per (covariate, clone) with the vectors of all draws.
Cells are clustered by pair, so a task finishes its pairs, and only pairs that were salted are added up again.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from couplet.functions.sampling import dirichlet_draws, fold_cells
from couplet.functions.vectors import (
    BASE_EPS, UNROLL, at_least, each, log_base, sanitize, temper_base, total,
)
from couplet.operators.shared import (
    SHORT_LIST, LookupSide, clone_filter, in_requested_order, lookup_join, materialise, task_count, vector_sum,
)
from couplet.sources.store import ResultStore, stored_result
from couplet.spec import CLONE, COVARIATE, PHENOTYPE, Study

MAGNITUDE_FLOOR = 1e-6  # Fixed value: smallest total concentration.
_BLOCK_VALUES = 2_000_000   # draw values held at once by a task
_TASK_VALUES = 1e8          # cell x draw x phenotype values folded by a task
_TASK_BLOCKS = 5e6          # draw values of folded pairs in a task
_TASK_DRAWS = 2e6           # draw values generated by a task


def pick_seed(random_state: int | None) -> int:
    """The given seed, or one fresh seed for the whole call (so both sides share their draws)."""
    return int(random_state) if random_state is not None else secrets.randbits(63)


def label_columns(df: DataFrame) -> list[str]:
    return [c for c in ("grp", "split") if c in df.columns]


def tempered_dims(study: Study, dims: DataFrame, temperature: float) -> DataFrame:
    """Add the sanitised, once-tempered base and the concentration magnitude to the pair table."""
    size = study.size
    if "conc" in dims.columns:
        magnitude = at_least(total(F.col("conc"), size), MAGNITUDE_FLOOR)
    else:
        magnitude = F.lit(study.local_scale).cast("double")
    keep = [CLONE, COVARIATE, "n_cells", *label_columns(dims)]
    clean = dims.select(*keep, magnitude.alias("magnitude"), sanitize(F.col("p"), size).alias("base"))
    if float(temperature) == 1.0:
        return clean
    return clean.withColumn("base", temper_base(F.col("base"), size, temperature))


def partials(study: Study, *, covariates: list[str] | None = None, groupby: str | None = None,
             splitby: str | None = None, n_samples: int = 0, temperature: float = 1.0,
             use_logits: bool = True, weighted: bool = False, clones=None,
             random_state: int | None = None, source: str = "model", labelled: bool = False,
             paired: bool = False) -> DataFrame:
    """``covariate, clonotype[, grp, split], draw, part`` for the requested covariates; ``block`` instead of the last
    two under draws of the model.

    ``labelled`` leaves out clones without a group, ``paired`` clones that are not seen at every requested covariate;
    both act on the pair table, before any cell is folded.
    """
    wanted = list(study.covariates) if covariates is None else list(dict.fromkeys(covariates))
    for c in wanted:
        study.check_covariate(c)
    n_samples = int(n_samples or 0)
    if source == "counts":
        ct = _restrict(study.counts(groupby, splitby), wanted, clones, labelled and groupby is not None)
        return ct.select(COVARIATE, CLONE, *label_columns(ct), F.lit(0).alias("draw"),
                         F.col("counts").alias("part"))
    if source != "model":
        raise ValueError(f"source must be 'model' or 'counts', got {source!r}")
    if use_logits and "logits" not in study.cells.columns:
        raise RuntimeError("the cells carry no 'logits'; attach evidence or pass use_logits=False")
    if n_samples > 0 and study.local_scale is None:
        raise RuntimeError("n_samples > 0 needs the local scale of the posterior")

    dims, measured = study.dims(groupby, splitby)
    dims = _restrict(dims, wanted, clones, labelled and groupby is not None)
    if paired and n_samples > 0:
        whole = study.counts().where(F.col(COVARIATE).isin(wanted)).groupBy(CLONE).agg(F.count(F.lit(1)).alias("n"))
        dims = dims.join(whole.where(F.col("n") == len(wanted)).select(CLONE), CLONE, "left_semi")
    dims = tempered_dims(study, dims, temperature)
    seed = pick_seed(random_state)
    if not use_logits:
        scale = F.col("n_cells").cast("double") if weighted else F.lit(1.0)
        if n_samples == 0:
            part = each(study.size, lambda x: x * scale, F.col("base"))
            return dims.select(COVARIATE, CLONE, *label_columns(dims), F.lit(0).alias("draw"),
                               part.alias("part"))
        tasks = task_count(study.spark, float(measured.rows) * n_samples * study.size, _TASK_DRAWS)
        drawn = _draw_rows(dims.repartition(tasks, CLONE, COVARIATE), study.size, n_samples, seed)
        block = F.transform("block", lambda row: F.transform(row, lambda x: x * scale)) if weighted else F.col("block")
        return drawn.select(COVARIATE, CLONE, *label_columns(dims), block.alias("block"))

    cells = _restrict(study.cells.select(
        CLONE, COVARIATE, *[c for c in ("cell_id",) if c in study.cells.columns], "logits"), wanted,
        # a long clone list already limits the lookup side; filtering cells by it would shuffle them by clone
        clones if isinstance(clones, (list, tuple)) and len(clones) <= SHORT_LIST else None)
    logit_weight, base_weight = combine_weights(study.gate, temperature)
    if n_samples == 0:
        return _fold_native(study, cells, dims, measured, logit_weight, base_weight)
    return _fold_draws(study, cells, dims, measured, n_samples, seed, logit_weight, base_weight)


def _restrict(df: DataFrame, covariates: list[str], clones, labelled: bool = False) -> DataFrame:
    df = df.where(F.col(COVARIATE).isin(covariates))
    return clone_filter(df.where("grp is not null") if labelled else df, clones)


def checked_logits(size: int) -> Column:
    """The cell's logits; a cell without them, or with another length, fails the job."""
    message = F.lit(f"a cell has no logits vector of length {size}")
    return F.when(F.size("logits") == size, F.col("logits")) \
        .otherwise(F.raise_error(message).cast("array<double>")).alias("logits")


def combine_weights(gate: float | None, temperature: float) -> tuple[float, float]:
    """Weights of the logit and of ``log base`` inside the softmax."""
    t = float(temperature)
    return (1.0 / t, 1.0 / t) if gate is None else (gate / t, (1.0 - gate) / t)


def _fold_native(study: Study, cells: DataFrame, dims: DataFrame, measured: LookupSide, logit_weight: float,
                 base_weight: float) -> DataFrame:
    size = study.size
    labels = label_columns(dims)
    side = dims.select(CLONE, COVARIATE, "n_cells", *labels, log_base(F.col("base"), size).alias("log_base"))
    joined = lookup_join(cells, side, [CLONE, COVARIATE], "n_cells", side=measured) \
        .withColumn("logits", checked_logits(size))     # after the join: clones that are not listed need none
    keys = [COVARIATE, CLONE, *labels]
    combined = each(size, lambda l, b: l * logit_weight + b * base_weight, F.col("logits"), F.col("log_base"))
    return softmax_rows(joined.select(*keys, combined.alias("__x")), keys, "__x", "part", size) \
        .withColumn("draw", F.lit(0)).select(COVARIATE, CLONE, *labels, "draw", "part")


def softmax_rows(df: DataFrame, keep: list, x: str, out: str, size: int) -> DataFrame:
    """Row-wise softmax in three projections, so shared terms are computed once and stay compiled."""
    v = F.col(x)
    top = (v[0] if size == 1 else F.greatest(*[v[j] for j in range(size)])) if size <= UNROLL else F.array_max(v)
    df = df.select(*keep, x, top.alias("__top"))
    df = df.select(*keep, each(size, lambda a: F.exp(a - F.col("__top")), v).alias("__e"))
    df = df.select(*keep, "__e", total(F.col("__e"), size).alias("__s"))
    return df.select(*keep, each(size, lambda a: a / F.col("__s"), F.col("__e")).alias(out))


# -- draws --------------------------------------------------------------------------------------

def _matrix(column: pa.Array, size: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(float, copy=False).reshape(len(column), size)


def _emit(names: list[str], labels: list[pa.Array], parts: np.ndarray) -> pa.RecordBatch:
    """Key columns and one block (draws by phenotypes) per row."""
    rows, n_samples, size = parts.shape
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, parts.size + 1, size, dtype=np.int32)),
                                       pa.array(np.ascontiguousarray(parts).reshape(-1)))
    blocks = pa.ListArray.from_arrays(pa.array(np.arange(0, rows * n_samples + 1, n_samples, dtype=np.int32)), vectors)
    return pa.RecordBatch.from_arrays([*labels, blocks], names=[*names, "block"])


def _draw_schema(df: DataFrame, names: list[str]) -> T.StructType:
    fields = [df.schema[n] for n in names]
    return T.StructType([*[T.StructField(f.name, f.dataType) for f in fields],
                         T.StructField("block", T.ArrayType(T.ArrayType(T.DoubleType())))])


def _pair_key() -> Column:
    return F.xxhash64(F.col(CLONE), F.col(COVARIATE)).alias("__key")


def _draw_rows(dims: DataFrame, size: int, n_samples: int, seed: int) -> DataFrame:
    """A block of ``n_samples`` draws per (clone, covariate), which depend on seed, pair and index only."""
    names = [COVARIATE, CLONE, "n_cells", *label_columns(dims)]
    ready = dims.select(*names, "base", "magnitude", _pair_key())
    step = max(1, _BLOCK_VALUES // (n_samples * size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = _matrix(batch.column(batch.schema.get_field_index("base")), size)
            magnitude = batch.column(batch.schema.get_field_index("magnitude")).to_numpy(zero_copy_only=False)
            keys = batch.column(batch.schema.get_field_index("__key")).to_numpy(zero_copy_only=False)
            for start in range(0, len(keys), step):
                rows = np.arange(start, min(start + step, len(keys)))
                parts = np.stack([dirichlet_draws(magnitude[i] * base[i], n_samples, seed, keys[i]) for i in rows])
                labels = [batch.column(batch.schema.get_field_index(n)).take(pa.array(rows)) for n in names]
                yield _emit(names, labels, parts)

    return ready.mapInArrow(run, _draw_schema(ready, names))


def _fold_draws(study: Study, cells: DataFrame, dims: DataFrame, measured: LookupSide, n_samples: int, seed: int,
                logit_weight: float, base_weight: float) -> DataFrame:
    """Cell fold under draws: never ``cells x draws`` rows.

    Cells are clustered by pair (hot pairs over several salted tasks) and sorted, so a task sees a pair's cells in
    a row, adds them up over its Arrow batches, and emits one block per pair. Draws are keyed by the
    pair, so the tasks that share a hot pair draw the same; only their blocks meet in a second exchange.
    """
    size = study.size
    names = [COVARIATE, CLONE, *label_columns(dims), "__salt"]
    on = [CLONE, COVARIATE]
    # cells bound the work of a task, pairs what it passes on; the bytes of the cells say nothing about either
    tasks = max(task_count(study.spark, float(measured.fact_rows) * n_samples * size, _TASK_VALUES),
                task_count(study.spark, float(measured.rows) * n_samples * size, _TASK_BLOCKS))
    joined = lookup_join(cells, dims, on, "n_cells", side=measured, salt_column="__salt", tasks=tasks)
    joined = joined.repartition(tasks, *on, "__salt")       # no further exchange where the lookup was shuffled into these tasks
    ready = joined.sortWithinPartitions(*on, "__salt").select(*names, checked_logits(size), "base", "magnitude", _pair_key())
    step = max(1, _BLOCK_VALUES // (n_samples * size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, draws = None, None
        rows: list[list[pa.Array]] = []                         # labels and sums of the pairs seen, the last one still open
        sums: list[np.ndarray] = []

        def emit(upto: int) -> pa.RecordBatch:
            labels = [pa.concat_arrays([r[i] for r in rows[:upto]]) for i in range(len(names))]
            out = _emit(names, labels, np.stack(sums[:upto]))
            del rows[:upto], sums[:upto]
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index
            base = _matrix(batch.column(at("base")), size)
            logits = _matrix(batch.column(at("logits")), size)
            magnitude = batch.column(at("magnitude")).to_numpy(zero_copy_only=False)
            keys = batch.column(at("__key")).to_numpy(zero_copy_only=False)
            salts = batch.column(at("__salt")).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (salts[1:] != salts[:-1])])
            for start, end in zip(starts, np.r_[starts[1:], len(keys)]):
                if (keys[start], salts[start]) != current:
                    if len(rows) >= step:
                        yield emit(len(rows))
                    current = (keys[start], salts[start])
                    draws = dirichlet_draws(magnitude[start] * base[start], n_samples, seed, keys[start])
                    rows.append([batch.column(at(n)).slice(start, 1) for n in names])
                    sums.append(np.zeros((n_samples, size)))
                sums[-1] += fold_cells(draws, logits[start:end], logit_weight, base_weight, BASE_EPS)
        if rows:
            yield emit(len(rows))

    blocks = ready.mapInArrow(run, _draw_schema(ready, names))
    if measured.largest <= measured.hot_limit:                  # no pair was salted
        return blocks.drop("__salt")
    blocks = materialise(blocks)
    keys = names[:-1]
    split = blocks.where("`__salt` > 0").select(*keys, F.posexplode("block").alias("draw", "part"))
    added = vector_sum(split, [*keys, "draw"], {"mass": F.col("part")}, size)
    whole = added.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("draw", "mass"))), lambda x: x["mass"]).alias("block"))
    return blocks.where("`__salt` = 0").drop("__salt").unionByName(whole)


# -- folding ------------------------------------------------------------------------------------

def _rescaled(mass: Column, size: int, divide: bool) -> Column:
    if not divide:
        return mass
    s = at_least(total(mass, size), BASE_EPS)
    return each(size, lambda x: x / s, mass)


def folded(parts: DataFrame, size: int, *, unit_rows: bool, summed: bool = True) -> DataFrame:
    """``covariate, clonotype[, grp, split], draw, mass``; ``unit_rows`` scales each row to 1."""
    if "block" in parts.columns:
        mass = parts.select(COVARIATE, CLONE, *label_columns(parts), F.posexplode("block").alias("draw", "mass"))
        return mass.withColumn("mass", _rescaled(F.col("mass"), size, unit_rows))
    keys = [COVARIATE, CLONE, *label_columns(parts), "draw"]
    mass = vector_sum(parts, keys, {"mass": F.col("part")}, size) if summed \
        else parts.withColumnRenamed("part", "mass")
    return mass.select(*keys, _rescaled(F.col("mass"), size, unit_rows).alias("mass"))


def folded_pair(parts: DataFrame, size: int, cov_from: str, cov_to: str, *, unit_rows: bool) -> DataFrame:
    """``clonotype[, grp, split], draw, mass_from, mass_to`` for clones seen at both levels.

    Both sides come out of one aggregate instead of a self-join.
    """
    if "block" in parts.columns:
        keys = [CLONE, *label_columns(parts)]
        sides = parts.groupBy(*keys).agg(*[F.max(F.when(F.col(COVARIATE) == level, F.struct("block"))).alias(name)
                                           for level, name in ((cov_from, "f"), (cov_to, "t"))]).where("f is not null and t is not null")
        rows = sides.select(*keys, F.posexplode(F.arrays_zip(F.col("f.block").alias("f"), F.col("t.block").alias("t"))).alias("draw", "m"))
        return rows.select(*keys, "draw", *[_rescaled(F.col(f"m.{c}"), size, unit_rows).alias(name)
                                            for c, name in (("f", "mass_from"), ("t", "mass_to"))])
    keys = [CLONE, *label_columns(parts), "draw"]
    zero = F.array_repeat(F.lit(0.0), size)

    def side(level: str) -> Column:
        at = F.col(COVARIATE) == level
        if size <= UNROLL:
            return F.array(*[F.when(at, F.col("part")[j]).otherwise(0.0) for j in range(size)])
        return F.when(at, F.col("part")).otherwise(zero)

    sums = vector_sum(
        parts, keys, {"mass_from": side(cov_from), "mass_to": side(cov_to)}, size,
        extra=[F.count_if(F.col(COVARIATE) == cov_from).alias("seen_from"),
               F.count_if(F.col(COVARIATE) == cov_to).alias("seen_to")],
    )
    both = sums.where("seen_from > 0 and seen_to > 0")
    return both.select(*keys, *[_rescaled(F.col(c), size, unit_rows).alias(c) for c in ("mass_from", "mass_to")])


def joint_table(study: Study, *, covariate: str | None = None, n_samples: int = 0,
                use_logits: bool = True, weighted: bool = False, clones=None, temperature: float = 1.0,
                random_state: int | None = None, source: str = "model", groupby: str | None = None,
                splitby: str | None = None) -> DataFrame:
    """Canonical joint with a ``mass`` array per (covariate, clone, draw)."""
    study.check_covariate(covariate)
    cell_fold = source == "model" and use_logits
    parts = partials(study, covariates=None if covariate is None else [covariate], groupby=groupby,
                     splitby=splitby, n_samples=n_samples, temperature=temperature, use_logits=use_logits,
                     weighted=weighted, clones=clones, random_state=random_state, source=source)
    unit_rows = not weighted and (cell_fold or source == "counts")
    return folded(parts, study.size, unit_rows=unit_rows, summed=cell_fold)


def averaged(joint: DataFrame, size: int) -> DataFrame:
    """Mean over draws per (covariate, clone)."""
    keys = [c for c in joint.columns if c not in ("draw", "mass")]
    sums = vector_sum(joint, keys, {"mass": F.col("mass")}, size, extra=[F.count(F.lit(1)).alias("n")])
    return sums.select(*keys, each(size, lambda x: x / F.col("n"), F.col("mass")).alias("mass"))


def wide(joint: DataFrame, phenotypes, *, with_covariate: bool, with_draw: bool) -> DataFrame:
    """One column per phenotype; the covariate and draw axes only where they vary."""
    keys = ([COVARIATE] if with_covariate else []) + [CLONE]
    names = [F.col(k) for k in keys] + ([F.col("draw").alias("sample_id")] if with_draw else [])
    return joint.select(*names, *[F.col("mass")[j].alias(x) for j, x in enumerate(phenotypes)])


def long(joint: DataFrame, phenotypes) -> DataFrame:
    """One row per (…, clone, phenotype)."""
    keys = [c for c in joint.columns if c != "mass"]
    labels = F.array(*[F.lit(x) for x in phenotypes])
    rows = joint.select(*keys, F.posexplode("mass").alias("ordinal", "value"))
    return rows.select(*keys, F.get(labels, F.col("ordinal")).alias(PHENOTYPE), "ordinal", "value")


@stored_result("joint_distribution")
def joint_distribution(study: Study, *, covariate: str | None = None, n_samples: int = 0,
                       use_logits: bool = True, weighted: bool = False, clones=None,
                       temperature: float = 1.0, random_state: int | None = None,
                       source: str = "model", store: ResultStore | None = None, key_added: str | None = None,
                       inplace: bool = True) -> dict:
    """``{"table", "result"}`` with one column per phenotype; ``result`` averages the draws.

    Frames read back from a store are in no particular order.
    """
    seed = pick_seed(random_state)
    joint = joint_table(study, covariate=covariate, n_samples=n_samples, use_logits=use_logits,
                        weighted=weighted, clones=clones, temperature=temperature, random_state=seed,
                        source=source)
    drawn = bool(n_samples)
    shape = dict(with_covariate=covariate is None)
    table = wide(joint, study.phenotypes, with_draw=drawn, **shape)
    result = wide(averaged(joint, study.size), study.phenotypes, with_draw=False, **shape) if drawn else table
    if isinstance(clones, (list, tuple)):
        then = ([COVARIATE] if covariate is None else [])
        result = in_requested_order(result, list(clones), *then)
        table = in_requested_order(table, list(clones), *then, *(["sample_id"] if drawn else []))
    return {"table": table, "result": result, "resolved": {"n_draws": int(n_samples or 0), "random_state": seed}}
