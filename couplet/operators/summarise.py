"""Reduction of a metric table over draws, and replicate-level contrasts."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

from couplet.functions.intervals import HDI_PROB, hdi_bounds
from couplet.functions.sampling import mann_whitney_p
from couplet.functions.vectors import is_finite, stars, versus
from couplet.operators.ranks import WINDOW_ROWS, exact_hdi, exact_quantiles
from couplet.operators.shared import materialise
from couplet.spec import MAX_LEVELS, levels_of


def _null() -> Column:
    return F.lit(None).cast("double")


def summarise_draws(table: DataFrame, keys: Sequence[str], value: str = "value", *,
                    extra_values: Sequence[str] = (), hdi_prob: float = HDI_PROB) -> DataFrame:
    """Mean, sd and HDI of the finite draws per key.

    No draws: all undefined. One draw: the mean only, because one value has no spread. The
    array behind the interval holds one key's draws (a call argument), not data rows.
    """
    v = F.when(is_finite(F.col(value)), F.col(value))
    agg = table.groupBy(*keys).agg(
        F.avg(v).alias(value), F.stddev_samp(v).alias("sd"), F.count(v).alias("__n"),
        F.collect_list(v).alias("__draws"), *[F.avg(c).alias(c) for c in extra_values])
    bounds = F.when(F.col("__n") > 1, hdi_bounds(F.col("__draws"), hdi_prob))
    agg = agg.withColumn("__b", bounds)
    return agg.select(*keys, value, F.when(F.col("__n") > 1, F.col("sd")).alias("sd"),
                      F.col("__b.low").alias("hdi_low"), F.col("__b.high").alias("hdi_high"), *extra_values)


def build_result(table: DataFrame, n_samples: int, *, value: str = "value",
                 extra_values: Sequence[str] = ()) -> DataFrame:
    """Reduce over draws only: every other label column stays a key (NULL labels kept).

    With at most one draw there is nothing to reduce, so no shuffle happens.
    """
    keys = [c for c in table.columns if c not in ("draw", value, *extra_values)]
    if n_samples <= 1:
        return table.select(*keys, value, _null().alias("sd"), _null().alias("hdi_low"),
                            _null().alias("hdi_high"), *extra_values)
    return summarise_draws(table, keys, value, extra_values=extra_values)


def collapse_to_replicates(result: DataFrame, *, groupby: str | None, splitby: str | None = None,
                           value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """One row per replicate: items averaged away (shared by tests and plot frames)."""
    if groupby is None or groupby not in result.columns:
        return result
    keys = list(dict.fromkeys(c for c in (groupby, splitby, *keep) if c and c in result.columns))
    return result.groupBy(*keys).agg(F.avg(value).alias(value))


def across_groups(df: DataFrame, keys: Sequence[str] = (), value: str = "value", rows: int | None = None) -> DataFrame:
    """Between-replicate mean, sd, 2.5/97.5 percentile (linear) and count over finite values.

    ``rows`` is the number of input rows, if counted.
    """
    keys = list(keys)
    finite = df.select(*keys, F.when(is_finite(F.col(value)), F.col(value)).alias("__x"))
    finite = finite if keys else finite.withColumn("__all", F.lit(0))
    names = keys or ["__all"]
    moments = [F.avg("__x").alias("value"), F.stddev_samp("__x").alias("sd"), F.count("__x").alias("n_groups")]
    if rows is not None and rows <= WINDOW_ROWS:
        ends = F.percentile("__x", F.array(F.lit(0.025), F.lit(0.975)))
        joined = finite.groupBy(*names).agg(*moments, ends.alias("__q")).select(
            "*", F.col("__q")[0].alias("ci_low"), F.col("__q")[1].alias("ci_high"))
    else:
        bounds = exact_quantiles(finite, "__x", names, (0.025, 0.975), ("ci_low", "ci_high")).select(
            *[F.col(k).alias(f"__k{i}") for i, k in enumerate(names)], "ci_low", "ci_high")
        same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(names)]
        joined = finite.groupBy(*names).agg(*moments).join(bounds, same, "left")
    many = F.col("n_groups") > 1
    return joined.select(*keys, "value", F.when(many, F.col("sd")).alias("sd"),
                         F.when(many, F.col("ci_low")).alias("ci_low"),
                         F.when(many, F.col("ci_high")).alias("ci_high"), "n_groups")


@F.pandas_udf(T.DoubleType())
def _p_value(u: pd.Series, n_a: pd.Series, n_b: pd.Series, ties: pd.Series, alternative: pd.Series) -> pd.Series:
    return pd.Series([mann_whitney_p(*row) for row in zip(u, n_a, n_b, ties, alternative)], dtype="float64")


def level_pairs(levels: list[str], splitby: str, reference: str | None = None) -> list[tuple[str, str]]:
    """All pairs in string order, or the reference against each other level."""
    if reference is None:
        return list(itertools.combinations(levels, 2))
    if reference not in levels:
        raise ValueError(f"reference {reference!r} not in {splitby} levels {levels}")
    return [(reference, x) for x in levels if x != reference]


def _by_pair(df: DataFrame, splitby: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Each row once per pair its level takes part in, with ``side`` 0 (a) or 1 (b)."""
    listed = [(a, a, b, 0) for a, b in pairs] + [(b, a, b, 1) for a, b in pairs]
    schema = "__level string, level_a string, level_b string, side int"
    sides = df.sparkSession.createDataFrame(listed, schema)
    return df.withColumn("__level", F.col(splitby).cast("string")).join(F.broadcast(sides), "__level").drop("__level")


RANGE_CELLS = 2_000_000      # value x level counts that a task holds at once


def _ranked_together(df: DataFrame, levels: list[str], pairs: list[tuple[str, str]],
                     rows: int | None) -> tuple[DataFrame, DataFrame]:
    """Rank sums of all pairs of levels from one ranking: ``(a, b, U, cross)`` and, per level, ``(a, level, n, sx, ties)``.

    Rows collapse to counts per value and level. Going up the values with a vector of how many rows each level has
    had so far gives, for every pair at once, how often one level beats the other (``U``, ties half) and the tie term
    that the two levels have together. Large inputs are cut into value ranges that start from the lower ranges'
    totals: at most ranges times levels numbers.
    """
    spark, size = df.sparkSession, len(levels)
    named = spark.createDataFrame(list(enumerate(levels)), "a int, level string")
    hist = df.where("x is not null").join(F.broadcast(named), "level").groupBy(F.col("x").cast("double").alias("value"), "a") \
        .agg(F.count(F.lit(1)).alias("n"))
    if rows is None or rows > WINDOW_ROWS:
        hist = materialise(hist)
        rows = hist.count()
    ranges = min(1000, max(1, -(-rows // WINDOW_ROWS)))
    start = {0: np.zeros(size)}
    if ranges > 1:
        cuts = sorted(set(hist.approxQuantile("value", [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
        hist = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="value", outputCol="range").transform(hist) \
            .withColumn("range", F.col("range").cast("int"))
        totals = np.zeros((len(cuts) + 1, size))
        for r in hist.groupBy("range", "a").agg(F.sum("n").alias("n")).collect():          # ranges x levels
            totals[r["range"], r["a"]] = r["n"]
        start = dict(enumerate(np.cumsum(totals, axis=0) - totals))
    else:
        hist = hist.withColumn("range", F.lit(0))
    left, right = (np.array([levels.index(p[i]) for p in pairs], np.int64) for i in (0, 1))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wins, cross = np.zeros(len(left)), np.zeros(len(left))
        n, sx, ties = np.zeros(size), np.zeros(size), np.zeros(size)
        below: dict[int, np.ndarray] = {}
        held: list[pd.DataFrame] = []                   # rows of the last value, which may go on

        def take(frame: pd.DataFrame) -> None:
            codes = np.cumsum((frame["value"].diff().fillna(1) != 0) | (frame["range"].diff().fillna(1) != 0)).to_numpy() - 1
            step = max(1, RANGE_CELLS // size)
            for first in range(0, int(codes[-1]) + 1, step):
                mine = frame[(codes >= first) & (codes < first + step)]
                for r, part in mine.groupby("range", sort=True):
                    order = pd.factorize(part["value"])[0]
                    count = np.zeros((int(order.max()) + 1, size))
                    count[order, part["a"]] = part["n"]
                    before = below.setdefault(r, start[r].copy())
                    lower = np.cumsum(count, axis=0) - count + before
                    square = count ** 2
                    wins[:] += (count.T @ (lower + count / 2))[left, right]
                    both = square.T @ count
                    cross[:] += 3 * (both + both.T)[left, right]
                    below[r] = before + count.sum(axis=0)
                    n[:] += count.sum(axis=0)
                    ties[:] += (count * square - count).sum(axis=0)
                    np.add.at(sx, part["a"].to_numpy(), part["value"].to_numpy() * part["n"].to_numpy())

        for frame in frames:
            if not len(frame):
                continue
            frame = pd.concat([*held, frame], ignore_index=True)
            last = (frame["value"] == frame["value"].iloc[-1]) & (frame["range"] == frame["range"].iloc[-1])
            held = [frame[last]]
            if not last.all():
                take(frame[~last].reset_index(drop=True))
        if held:
            take(held[0].reset_index(drop=True))
            yield pd.DataFrame({"a": left, "b": right, "U": wins, "cross": cross})
            yield pd.DataFrame({"a": np.arange(size), "b": -1, "U": sx, "cross": ties, "n": n})

    placed = hist.repartition(ranges, "range") if ranges > 1 else hist.coalesce(1)
    schema = "a int, b int, U double, cross double, n double"
    sums = placed.sortWithinPartitions("range", "value").mapInPandas(
        lambda frames: (f.reindex(columns=["a", "b", "U", "cross", "n"]) for f in run(frames)), schema)
    sums = materialise(sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("U", "cross", "n")]))
    per_level = sums.where("b < 0").join(named, "a").select("a", "level", F.col("n").cast("long").alias("n"), F.col("U").alias("sx"),
                                                           F.col("cross").alias("ties"))
    return sums.where("b >= 0").select("a", "b", "U", "cross"), per_level


def compare_groups(df: DataFrame, *, value: str = "value", splitby: str, reference: str | None = None,
                   alternative: str = "two-sided", levels: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Unpaired contrast per level pair: Mann-Whitney U, p, means, ``delta = mean_b - mean_a``, stars.

    ``levels`` and ``rows`` spare a pass where the caller knows them.
    """
    if alternative not in ("two-sided", "less", "greater"):
        raise ValueError(f"alternative must be 'two-sided', 'less' or 'greater', got {alternative!r}")
    schema = "level_a string, level_b string, n_a long, n_b long, mean_a double, mean_b double, " \
             "delta double, U double, p double, stars string"
    levels = levels_of(df, splitby) if levels is None else levels
    pairs = level_pairs(levels, splitby, reference)
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    pair_sums, level_sums = _ranked_together(
        df.select(F.col(splitby).cast("string").alias("level"), F.when(is_finite(F.col(value)), F.col(value)).alias("x")),
        levels, pairs, rows)
    sides = {side: level_sums.select(F.col("a").alias(side), F.col("level").alias(f"level_{side}"), F.col("n").alias(f"n_{side}"),
                                     (F.col("sx") / F.col("n")).alias(f"mean_{side}"), F.col("ties").alias(f"ties_{side}"))
             for side in ("a", "b")}
    test = pair_sums.join(sides["a"], "a").join(sides["b"], "b").where("n_a > 0 and n_b > 0") \
        .withColumn("__ties", F.col("cross") + F.col("ties_a") + F.col("ties_b"))
    test = test.withColumn("p", _p_value("U", "n_a", "n_b", "__ties", F.lit(alternative)))
    test = test.withColumn("p", F.when(~F.isnan("p"), F.col("p")))
    return test.select("level_a", "level_b", "n_a", "n_b", "mean_a", "mean_b",
                       (F.col("mean_b") - F.col("mean_a")).alias("delta"), "U", "p", stars(F.col("p")).alias("stars"))


def prob_direction(delta: Column) -> tuple[Column, Column]:
    """Aggregates ``P(d > 0)`` and its complement."""
    up = F.avg(F.when(delta > 0, 1.0).otherwise(0.0))
    return up, 1.0 - up


def compare_paired(table: DataFrame, *, splitby: str, pair_on: str, value: str = "value",
                   reference: str | None = None, hdi_prob: float = HDI_PROB) -> DataFrame:
    """Paired posterior contrast per level pair.

    Units are matched on ``pair_on`` and draws on their index; differences ``b - a`` of all units
    are pooled. One pooled difference is its own interval.
    """
    pairs = level_pairs(levels_of(table, splitby), splitby, reference)
    schema = "level_a string, level_b string, delta double, p_gt double, p_lt double, hdi_low double, hdi_high double"
    if not pairs:
        return table.sparkSession.createDataFrame([], schema)
    rows = _by_pair(table.select(splitby, pair_on, "draw", F.col(value).alias("__x")), splitby, pairs)
    x = F.col("__x")
    matched = rows.groupBy("level_a", "level_b", pair_on, "draw").agg(
        F.max(F.when(F.col("side") == 0, x)).alias("a"), F.max(F.when(F.col("side") == 1, x)).alias("b"))
    diffs = materialise(matched.where("a is not null and b is not null")
                        .select("level_a", "level_b", (F.col("b") - F.col("a")).alias("d")))
    up, down = prob_direction(F.col("d"))
    means = diffs.groupBy("level_a", "level_b").agg(F.avg("d").alias("delta"), up.alias("p_gt"), down.alias("p_lt"))
    return means.join(exact_hdi(diffs, "d", ["level_a", "level_b"], hdi_prob).drop("n"), ["level_a", "level_b"])


def build_stats(result: DataFrame, *, groupby: str | None, splitby: str | None,
                value: str = "value") -> DataFrame | None:
    """One row per pair of split levels. The unit is the replicate: items are averaged first."""
    if splitby is None or groupby is None:
        return None
    per_group = collapse_to_replicates(result, groupby=groupby, splitby=splitby, value=value)
    per_group = materialise(per_group.where(F.col(splitby).isNotNull())
                            .select(groupby, F.col(splitby).cast("string").alias(splitby), value))
    known = per_group.groupBy(splitby).agg(F.count(F.lit(1)).alias("n")).limit(MAX_LEVELS + 1).collect()
    if len(known) > MAX_LEVELS:
        raise ValueError(f"{splitby!r} has more than {MAX_LEVELS} levels; it is not a split label")
    rows = sum(r["n"] for r in known)
    contrasts = compare_groups(per_group, value=value, splitby=splitby, levels=sorted(r[0] for r in known), rows=rows)
    arms = across_groups(per_group, [splitby], value, rows=rows)
    out = contrasts.select("level_a", "level_b", "delta", F.col("U").alias("stat"), "p", "stars")
    for side in ("a", "b"):
        arm = arms.select(F.col(splitby).alias(f"level_{side}"), F.col("value").alias(f"mean_{side}"),
                          F.col("sd").alias(f"sd_{side}"), F.col("ci_low").alias(f"ci_low_{side}"),
                          F.col("ci_high").alias(f"ci_high_{side}"), F.col("n_groups").alias(f"n_{side}"))
        out = out.join(arm, f"level_{side}")
    spread = [f"{c}_{s}" for s in ("a", "b") for c in ("mean", "sd", "ci_low", "ci_high", "n")]
    return out.select(versus(F.col("level_a"), F.col("level_b")).alias(splitby), "level_a", "level_b",
                      F.lit(groupby).alias("replicate_unit"), *spread, "delta", "stat", "p", "stars")
