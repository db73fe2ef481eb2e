"""Ranks, exact quantiles and exact highest-density intervals over groups of any size.

Rows collapse to distinct values first. If the distinct values are few (counted), one window per
key ranks them. Otherwise value ranges cut by quantile boundaries are ranked side by side and
shifted by the totals of the lower ranges, so no task sees a whole hot group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from couplet.functions.intervals import HDI_PROB
from couplet.operators.shared import lookup_join, materialise

# Distinct (key, value) rows that one window task may hold.
WINDOW_ROWS = 500_000


@dataclass(frozen=True)
class Ranked:
    """Distinct values with ``n`` (rows), extra sums, ``below`` (rows under) and ``position``."""

    rows: DataFrame
    keys: list[str]
    distinct: int


def ranked_values(df: DataFrame, value: str, keys: Sequence[str] = (), sums: dict[str, Column] | None = None,
                  weight: Column | None = None, rows: int | None = None) -> Ranked:
    """Rank the distinct values of ``value`` within ``keys`` (NULL values are left out).

    ``rows`` is an upper bound on the input rows if the caller has counted them.
    """
    window_rows = WINDOW_ROWS
    keys = list(keys)
    sums = sums or {}
    count = F.count(F.lit(1)) if weight is None else F.sum(weight)
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("value")).agg(
        count.cast("long").alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()])
    if rows is not None and rows <= window_rows:
        distinct = rows
    else:
        hist = materialise(hist)
        distinct = hist.count()
    over = [F.lit(0)] if not keys else [F.col(k) for k in keys]
    if distinct <= window_rows:
        w = Window.partitionBy(*over).orderBy("value")
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        ranked = hist.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"),
                             (F.row_number().over(w) - 1).cast("long").alias("position"))
        return Ranked(ranked, keys, distinct)

    ranges = -(-distinct // window_rows) * 4
    cuts = sorted(set(hist.approxQuantile("value", [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    splits = [float("-inf"), *cuts, float("inf")]
    hist = Bucketizer(splits=splits, inputCol="value", outputCol="range").transform(hist)
    w = Window.partitionBy(*over, "range").orderBy("value")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    local = hist.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__below"),
                        (F.row_number().over(w) - 1).cast("long").alias("__position"))
    # per key at most one row per range: a bounded window
    totals = hist.groupBy(*keys, "range").agg(F.sum("n").alias("__n"), F.count(F.lit(1)).alias("__d"))
    on = ["__key", "range"]
    lower = Window.partitionBy(*over).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = materialise(totals.select(_joinable(keys), "range", "__d",
                                       F.coalesce(F.sum("__n").over(lower), F.lit(0)).alias("__shift"),
                                       F.coalesce(F.sum("__d").over(lower), F.lit(0)).alias("__pshift")))
    ranked = lookup_join(local.select("*", _joinable(keys)), shifts, on, "__d", row_bytes=96)
    ranked = ranked.select(*[c for c in hist.columns if c != "range"],
                           (F.col("__below") + F.col("__shift")).alias("below"),
                           (F.col("__position") + F.col("__pshift")).alias("position"))
    return Ranked(materialise(ranked), keys, distinct)


def _joinable(keys: Sequence[str]) -> Column:
    """One non-NULL text key, so that a group labelled NULL survives an equi-join."""
    return (F.to_json(F.struct(*keys)) if keys else F.lit("")).alias("__key")


def midrank() -> Column:
    """Average rank of a tied value, from ``below`` and ``n``."""
    return F.col("below") + (F.col("n") + 1) / 2.0


def _with_totals(ranked: Ranked) -> DataFrame:
    totals = ranked.rows.groupBy(*ranked.keys).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("__d"))
    if not ranked.keys:
        total = totals.first()["total"] or 0
        return ranked.rows.withColumn("total", F.lit(total).cast("long"))
    totals = materialise(totals.select(_joinable(ranked.keys), "total", "__d"))
    rows = ranked.rows.select("*", _joinable(ranked.keys))
    return lookup_join(rows, totals, ["__key"], "__d", row_bytes=96).drop("__d", "__key")


def exact_quantiles(df: DataFrame, value: str, keys: Sequence[str], probs: Sequence[float],
                    names: Sequence[str], weight: Column | None = None, rows: int | None = None) -> DataFrame:
    """Linear-interpolation quantiles per key, exact at any group size.

    A counted small input goes through the built-in percentile, whose buffer holds a group's
    distinct values; larger ones through distributed ranks.
    """
    keys = list(keys)
    if rows is not None and rows <= WINDOW_ROWS:
        frequency = F.lit(1).cast("long") if weight is None else weight
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        out = df.groupBy(*keys).agg(F.percentile(value, wanted, frequency).alias("__q"))
        return out.select(*keys, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])
    rows = _with_totals(ranked_values(df, value, keys, weight=weight))
    picks = []
    for p, name in zip(probs, names):
        h = (F.col("total") - 1) * F.lit(float(p))
        for end, at in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            inside = (F.col("below") <= at) & (at < F.col("below") + F.col("n"))
            picks.append(F.max(F.when(inside, F.col("value"))).alias(f"__{name}_{end}"))
        picks.append(F.max(h - F.floor(h)).alias(f"__{name}_w"))
    found = rows.groupBy(*keys).agg(*picks).select(*keys, *[
        (F.col(f"__{n}_lo") + (F.col(f"__{n}_hi") - F.col(f"__{n}_lo")) * F.col(f"__{n}_w")).alias(n)
        for n in names
    ])
    # a key whose values are all NULL has no ranks but keeps its row
    every = df.groupBy(*keys).agg(*[F.max(F.lit(None).cast("double")).alias(n) for n in names])
    return found.unionByName(every).groupBy(*keys).agg(*[F.max(n).alias(n) for n in names])


def exact_hdi(df: DataFrame, value: str, keys: Sequence[str] = (), prob: float = HDI_PROB) -> DataFrame:
    """``keys, n, hdi_low, hdi_high`` of raw values, for groups too large to gather in one array.

    Among equal values the first row starts the narrowest window, so one window per distinct
    value is enough; the value at its end is looked up by rank.
    """
    keys = list(keys)
    rows = materialise(_with_totals(ranked_values(df, value, keys)).select(*keys, "value", "n", "below", "total"))
    inc = F.greatest(F.lit(1), F.floor(F.col("total") * F.lit(float(prob)))).cast("long")
    starts = rows.select(*keys, "total", F.col("value").alias("low"), F.col("below").alias("start"),
                         (F.col("below") + inc).alias("rank")).where("rank < total")
    ends = _value_at_rank(starts, rows, keys, "high")
    best = ends.groupBy(*keys).agg(F.min(F.struct((F.col("high") - F.col("low")).alias("width"),
                                                  "start", "low", "high")).alias("b"))
    whole = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    merged = whole.withColumn("b", F.lit(None).cast(best.schema["b"].dataType)).unionByName(
        best.select(*keys, F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("lo"),
                    F.lit(None).cast("double").alias("hi"), "b"))
    out = merged.groupBy(*keys).agg(F.max("n").alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"),
                                    F.max("b").alias("b"))
    return out.where("n is not null").select(*keys, "n", F.coalesce("b.low", "lo").alias("hdi_low"),
                                             F.coalesce("b.high", "hi").alias("hdi_high"))


_BLOCK_RANKS = 1_000_000


def _value_at_rank(asked: DataFrame, rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Value at each asked 0-based ``rank``: a forward fill inside blocks of consecutive ranks.

    A key has at most a million blocks; a long tied run opens every block it covers, so each
    block is filled on its own.
    """
    width = F.greatest(F.lit(_BLOCK_RANKS), F.ceil(F.col("total") / 1_000_000))
    first = F.floor(F.col("below") / width)
    final = F.floor((F.col("below") + F.col("n") - 1) / width)
    known = rows.select("*", F.explode(F.sequence(first, final)).alias("__block")).select(
        *keys, "__block", F.greatest(F.col("below"), F.col("__block") * width).alias("rank"),
        F.lit(0).alias("__asked"), F.col("value").alias("__value"))
    carried = [c for c in asked.columns if c not in (*keys, "rank")]
    union = known.unionByName(
        asked.select(*keys, F.floor(F.col("rank") / width).alias("__block"), "rank", F.lit(1).alias("__asked"),
                     *carried), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "__block").orderBy("rank", "__asked").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    filled = union.withColumn(out, F.last("__value", ignorenulls=True).over(w))
    return filled.where("__asked = 1").select(*keys, *carried, out)


def distinct_ordinals(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct labels with a dense 0-based ``ordinal``, without a single-task window.

    Labels are cut into contiguous ranges by literal boundaries, numbered inside each range, and
    shifted by the sizes of the lower ranges.
    """
    labels = materialise(df.where(F.col(column).isNotNull()).select(column).distinct())
    n = labels.count()
    if n <= WINDOW_ROWS:
        w = Window.partitionBy(F.lit(0)).orderBy(column)
        return labels.select(column, (F.row_number().over(w) - 1).cast("long").alias("ordinal"))
    parts = -(-n // WINDOW_ROWS) * 4
    sample = labels.sample(min(1.0, 200.0 * parts / n), seed=0).orderBy(column)
    picked = [r[0] for r in sample.collect()]                    # about 200 labels per range
    cuts = [picked[i * len(picked) // parts] for i in range(1, parts)]
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(column)))
    ranged = labels.withColumn("__part", part)
    sizes = {r["__part"]: r["count"] for r in ranged.groupBy("__part").count().collect()}
    shift, shifts = 0, []
    for i in range(parts):
        shifts.append((i, shift))
        shift += sizes.get(i, 0)
    offsets = df.sparkSession.createDataFrame(shifts, "__part int, __shift long")
    w = Window.partitionBy("__part").orderBy(column)
    numbered = ranged.select(column, "__part", (F.row_number().over(w) - 1).alias("__local"))
    return numbered.join(F.broadcast(offsets), "__part").select(
        column, (F.col("__local") + F.col("__shift")).cast("long").alias("ordinal"))
