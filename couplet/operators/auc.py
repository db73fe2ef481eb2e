"""AUROC with label permutation and bootstrap, on ranked distinct scores.

The scores never change, so each resample only redraws how many rows of every distinct score fall
in a class. Distinct scores are cut into blocks of bounded size; a resample first splits its class
totals over the blocks down a tree, then draws inside each block, and partial rank sums are added up.
A block's scores travel once, or a few times where there are fewer blocks than tasks.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from couplet.functions.sampling import keyed_generator
from couplet.operators.ranks import Ranked, midrank, ranked_values
from couplet.operators.splitting import Law, block_totals, with_replacement, without_replacement
from couplet.operators.shared import materialise

# Distinct scores per block and resamples per task.
BLOCK_SCORES = 50_000
CHUNK = 2_000
BOOT_CHUNK = 100
# Rows of a value up to which its binomial law is tabulated, and numbers that a task draws at once.
TABLE_COUNT = 4_096
_HELD_VALUES = 2_000_000
_TOLERANCE = 1e-12


def _ranked_scores(df: DataFrame, scores: str, labels: str, pos_label) -> tuple[Ranked, object]:
    known = F.col(scores).isNotNull() & F.col(labels).isNotNull()
    seen = df.agg(F.max(F.when(known, F.col(labels))).alias("top"), F.count_if(~known).alias("unknown")).first()
    if seen["unknown"]:
        warnings.warn(f"{seen['unknown']} rows have no score or no label and are left out", UserWarning, stacklevel=3)
    df = df.where(known)
    if pos_label is None:
        pos_label = seen["top"]
    ranked = ranked_values(df, scores, sums={"pos": (F.col(labels) == F.lit(pos_label)).cast("long")})
    return ranked, pos_label


def _observed(ranked: Ranked) -> dict:
    row = ranked.rows.agg(F.sum("n").alias("n"), F.sum("pos").alias("n_pos"),
                          F.sum(midrank() * F.col("pos")).alias("rank_sum")).first()
    n, n_pos = int(row["n"] or 0), int(row["n_pos"] or 0)
    n_neg = n - n_pos
    auc = None
    if n_pos and n_neg:
        auc = (row["rank_sum"] - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg)
    return {"n": n, "n_pos": n_pos, "n_neg": n_neg, "auc": auc}


def auroc(df: DataFrame, scores: str, labels: str, pos_label=None) -> DataFrame:
    """One row: ``auc, n_pos, n_neg``; a single class is undefined."""
    ranked, _ = _ranked_scores(df, scores, labels, pos_label)
    sums = ranked.rows.agg(F.sum("n").alias("n"), F.sum("pos").alias("n_pos"),
                           F.sum(midrank() * F.col("pos")).alias("r"))
    pos, neg = F.col("n_pos").cast("double"), (F.col("n") - F.col("n_pos")).cast("double")
    auc = F.try_divide(F.col("r") - pos * (pos + 1) / 2.0, pos * neg)
    return sums.select(auc.alias("auc"), "n_pos", (F.col("n") - F.col("n_pos")).alias("n_neg"))


def _resampled(ranked: Ranked, n_draws: int, chunk_size: int, block_scores: int, seed: int, law: Law, start, weights: list,
               columns: list[str], inside) -> DataFrame:
    """``(draw, part)``: what every block adds to the rank sum of every resample.

    ``start(chunk, width)`` gives the class totals of a chunk of resamples; ``inside(chunk, block, totals, *columns)`` the
    sums of one block.
    """
    spark = ranked.rows.sparkSession
    n_chunks, n_blocks = -(-n_draws // chunk_size), max(1, -(-ranked.distinct // block_scores))
    rows = ranked.rows.select(F.floor(F.col("position") / block_scores).alias("block"), "value", "n", "pos", midrank().alias("mid"))
    blocks = rows.groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("value", "n", "pos", "mid"))).alias("rows"),  # <= block_scores entries
        F.array(*weights).alias("weights"))
    blocks = materialise(blocks.select("block", "weights", *[F.col("rows")[c].alias(c) for c in columns]))

    def begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            widths = [min(chunk_size, n_draws - c * chunk_size) for c in frame["id"]]
            yield pd.DataFrame({"stratum": 0, "chunk": frame["id"], "width": widths, "totals": [
                np.ascontiguousarray(start(c, w), np.int64).tobytes() for c, w in zip(frame["id"], widths)]})

    tasks = min(n_chunks, 2 * spark.sparkContext.defaultParallelism)
    roots = spark.range(0, n_chunks, 1, tasks).mapInPandas(begin, "stratum long, chunk long, width int, totals binary")
    totals = block_totals(roots, blocks.select("block", "weights"), [], n_blocks, seed, law)
    copies = max(1, min(n_chunks, -(-2 * spark.sparkContext.defaultParallelism // n_blocks)))
    dealt = min(10_000, n_blocks * copies)
    left = totals.withColumn("copy", F.pmod("chunk", F.lit(copies))).repartition(dealt, "block", "copy")
    right = blocks.select("block", *columns, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("copy")) \
        .repartition(dealt, "block", "copy")

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(held):
            return pd.DataFrame({"draw": [], "part": []})
        data = [np.asarray(held[c].iloc[0]) for c in columns]
        parts = [(row.chunk, inside(row.chunk, row.block, np.frombuffer(row.totals, np.int64).reshape(row.width, -1), *data))
                 for row in asked.itertuples(index=False)]
        return pd.DataFrame({"draw": np.concatenate([c * chunk_size + np.arange(len(p)) for c, p in parts] or [[]]),
                             "part": np.concatenate([p for _, p in parts] or [[]])})

    return left.groupBy("block", "copy").cogroup(right.groupBy("block", "copy")).applyInPandas(run, "draw long, part double")


def _binomial_steps(count: int, p: float) -> np.ndarray:
    """Distribution function of Binomial(``count``, ``p``) at 0 .. ``count`` - 1."""
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1.0, count + 1)))])
    k = np.arange(count + 1)
    mass = np.exp(logs[-1] - logs - logs[::-1] + k * math.log(p) + (count - k) * math.log1p(-p))
    return np.minimum(np.cumsum(mass / mass.sum())[:-1], 1.0)


def _subset_rank_sums(rng, counts: np.ndarray, mids: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Rank sum of a uniform subset of ``take[r]`` rows, per resample ``r``.

    Where the subset or its complement is small its rows are drawn. Else every row is taken by its own coin, which is a binomial
    number per value, and a uniform choice of the rows taken (or left) brings the number taken to ``take[r]``: given
    its size a set drawn by coins is uniform, and so it stays. The coins' bias decides only how many rows that last step moves.
    """
    n = int(counts.sum())
    out = np.empty(len(take))
    if not len(take) or not n:
        return np.zeros(len(take))
    p = float(take.mean()) / n
    if p in (0.0, 1.0):
        return take * (counts * mids).sum() / n
    if n <= 4 * BLOCK_SCORES and np.minimum(take, n - take).mean() <= 2 * len(counts):
        expanded = np.repeat(mids, counts)
        whole = expanded.sum()
        for r, k in enumerate(take):                # the smaller side of the cut is drawn
            few = min(k, n - k)
            drawn = expanded[rng.choice(n, few, replace=False, shuffle=False)].sum()
            out[r] = drawn if few == k else whole - drawn
        return out
    order = np.argsort(counts, kind="stable")
    counts, mids = counts[order].astype(np.int64), mids[order]
    kinds, first = np.unique(counts, return_index=True)
    ends = np.append(first[1:], len(counts))
    steps = [_binomial_steps(int(c), p) if c <= TABLE_COUNT else None for c in kinds]
    width = max(1, _HELD_VALUES // len(counts))
    for low in range(0, len(take), width):
        asked = take[low:low + width]
        taken = np.empty((len(asked), len(counts)), np.int64)
        for c, start, end, table in zip(kinds, first, ends, steps):
            shape = (len(asked), end - start)
            taken[:, start:end] = rng.binomial(c, p, shape) if table is None else np.searchsorted(table, rng.random(shape), side="right")
        out[low:low + width] = taken @ mids
        for r, moved in enumerate(asked - taken.sum(axis=1)):
            if moved:                               # rows by their number among those left, or among those taken
                pool = np.cumsum(counts - taken[r] if moved > 0 else taken[r])
                at = np.searchsorted(pool, rng.choice(pool[-1], abs(moved), replace=False, shuffle=False), side="right")
                out[low + r] += np.sign(moved) * mids[at].sum()
    return out


def _permutation_parts(ranked: Ranked, n_pos: int, n_neg: int, n_perm: int, seed: int, block_scores: int) -> DataFrame:
    def inside(chunk, block, totals, counts, mids):
        return _subset_rank_sums(keyed_generator(seed, 2, chunk, block), counts, mids, totals[:, 0])

    return _resampled(ranked, n_perm, CHUNK, block_scores, seed, without_replacement,
                      lambda _, width: np.tile([n_pos, n_neg], (width, 1)), [F.sum("n").cast("long")], ["n", "mid"], inside)


def _combination_at(n: int, k: int, index: int) -> list[int]:
    """The ``index``-th size-``k`` subset of ``range(n)`` in lexicographic order."""
    out, low = [], 0
    for left in range(k, 0, -1):
        while True:
            below = math.comb(n - low - 1, left - 1)
            if index < below:
                break
            index -= below
            low += 1
        out.append(low)
        low += 1
    return out


def _exact_parts(ranked: Ranked, n: int, n_pos: int, n_exact: int) -> DataFrame:
    """Rank sums of every possible positive set; ``n <= n_exact`` bounds the broadcast ranks."""
    mids = np.repeat(*map(np.array, zip(*[
        (r["mid"], r["n"]) for r in ranked.rows.select(midrank().alias("mid"), "n").collect()])))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = frame["id"].to_numpy()
            sums = np.empty(len(ids))
            subset, previous = None, None
            for i, index in enumerate(ids):
                if previous is None or index != previous + 1:
                    subset = _combination_at(n, n_pos, int(index))
                else:
                    j = n_pos - 1
                    while subset[j] == n - n_pos + j:
                        j -= 1
                    subset[j] += 1
                    for t in range(j + 1, n_pos):
                        subset[t] = subset[t - 1] + 1
                previous = index
                sums[i] = mids[subset].sum()
            yield pd.DataFrame({"draw": ids, "part": sums})

    return ranked.rows.sparkSession.range(n_exact).mapInPandas(run, "draw long, part double")


def auc_and_label_permutation(df: DataFrame, scores: str, labels: str, *, pos_label=None, n_perm: int = 200_000,
                              seed: int = 42, max_exact: int = 200_000, block_scores: int = BLOCK_SCORES) -> dict:
    """``{"result", "perm_stats"}``: observed AUROC, permutation p and mode, and the permuted AUROCs.

    All label assignments are enumerated when there are at most ``max_exact``; else ``n_perm``
    random ones. ``p`` is the share at least as far from 0.5 as observed.
    """
    ranked, _ = _ranked_scores(df, scores, labels, pos_label)
    seen = _observed(ranked)
    spark = df.sparkSession
    schema = "auc double, p double, mode string, n_pos long, n_neg long, n_stats long"
    if seen["auc"] is None:
        empty = spark.createDataFrame([], "draw long, auc double")
        row = [(None, None, "degenerate", seen["n_pos"], seen["n_neg"], 0)]
        return {"result": spark.createDataFrame(row, schema), "perm_stats": empty}
    n, n_pos, n_neg = seen["n"], seen["n_pos"], seen["n_neg"]
    # C(n, k) >= n here, so a larger n cannot be enumerated and the big binomial is not computed
    n_exact = math.comb(n, n_pos) if n <= max_exact and min(n_pos, n_neg) <= 64 else None
    if n_exact is not None and n_exact <= max_exact:
        parts, mode = _exact_parts(ranked, n, n_pos, n_exact), "exact"
    else:
        parts, mode = _permutation_parts(ranked, n_pos, n_neg, n_perm, seed, block_scores), "mc"
    sums = parts.groupBy("draw").agg(F.sum("part").alias("s"))
    auc = (F.col("s") - F.lit(n_pos * (n_pos + 1) / 2.0)) / F.lit(float(n_pos) * n_neg)
    stats = materialise(sums.select("draw", auc.alias("auc")))      # drawn once for both results
    reach = abs(seen["auc"] - 0.5) - _TOLERANCE
    result = stats.agg(F.lit(seen["auc"]).alias("auc"),
                       F.avg((F.abs(F.col("auc") - 0.5) >= F.lit(reach)).cast("double")).alias("p"),
                       F.lit(mode).alias("mode"), F.lit(n_pos).cast("long").alias("n_pos"),
                       F.lit(n_neg).cast("long").alias("n_neg"), F.count(F.lit(1)).alias("n_stats"))
    return {"result": result, "perm_stats": stats}


def bootstrap_auc(df: DataFrame, scores: str, labels: str, *, pos_label=None, n_boot: int = 5_000, seed: int = 42,
                  block_scores: int = BLOCK_SCORES) -> DataFrame:
    """One row: 2.5 % and 97.5 % quantile of the AUROC over resamples that hold both classes."""
    ranked, _ = _ranked_scores(df, scores, labels, pos_label)
    seen = _observed(ranked)
    if seen["auc"] is None:
        raise ValueError("bootstrap needs both classes")
    n, n_pos = seen["n"], seen["n_pos"]

    def start(chunk: int, width: int) -> np.ndarray:
        rng = keyed_generator(seed, 3, chunk)
        pos = rng.binomial(n, n_pos / n, size=width)
        while ((pos == 0) | (pos == n)).any():
            bad = (pos == 0) | (pos == n)
            pos[bad] = rng.binomial(n, n_pos / n, size=int(bad.sum()))
        return np.column_stack([pos, n - pos, np.zeros(width, np.int64)])

    def inside(chunk, block, totals, counts, pos_n):
        rng = keyed_generator(seed, 4, chunk, block)
        neg_n = counts - pos_n
        part = totals[:, 0] * totals[:, 2].astype(float)
        for r, (pos, neg, _) in enumerate(totals):
            if pos and neg:
                p = rng.multinomial(pos, pos_n / pos_n.sum())
                q = rng.multinomial(neg, neg_n / neg_n.sum())
                part[r] += (p * (np.cumsum(q) - q / 2.0)).sum()
        of = start(chunk, len(totals))                  # the resample's own class totals, from its key
        return part / (of[:, 0] * of[:, 1].astype(float))

    pos, rows = F.sum("pos").cast("long"), F.sum("n").cast("long")
    parts = _resampled(ranked, n_boot, BOOT_CHUNK, block_scores, seed, with_replacement, start, [pos, rows - pos],
                       ["n", "pos"], inside)
    aucs = parts.groupBy("draw").agg(F.sum("part").alias("auc"))
    ends = aucs.agg(F.percentile("auc", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count(F.lit(1)).alias("n_boot"))
    return ends.select(F.lit(seen["auc"]).alias("auc"), F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), "n_boot")
