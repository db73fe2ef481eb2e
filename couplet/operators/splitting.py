"""Random totals of many blocks by a splitting tree.

A resample spreads class totals over blocks of rows. Here no task needs to know all blocks: a node of the tree holds
the totals of a run of blocks, and draws how they divide between the halves of the run, with the same law
whatever the order. Draws are keyed by (seed, stratum, chunk, node), so a repeated task gives the same totals. One
stage takes a node down to its at most ``FAN`` children; a tree over n blocks needs log(n) / log(FAN) stages, and
the work is linear in the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from couplet.functions.sampling import hypergeometric, keyed_generator

FAN = 64

# Draws what the left half of a node receives: (generator, totals [draws, classes], weights left, weights right)
# -> (totals left, totals right).
Law = Callable[[np.random.Generator, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def without_replacement(rng: np.random.Generator, totals: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Labels shuffled over rows: the left half's class totals are multivariate hypergeometric in its rows."""
    remaining = np.full(len(totals), int(left[0]), np.int64)
    rest = totals.sum(axis=1)
    share = np.zeros_like(totals)
    for j in range(totals.shape[1] - 1):
        rest = rest - totals[:, j]
        share[:, j] = hypergeometric(rng, totals[:, j], rest, remaining)
        remaining = remaining - share[:, j]
    share[:, -1] = remaining
    return share, totals - share


def with_replacement(rng: np.random.Generator, totals: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Rows drawn with replacement within each class. The column after the classes counts what the last class has in
    all blocks before the node."""
    classes = totals.shape[1] - 1
    both = np.maximum(left + right, 1)
    mine = np.column_stack([*[rng.binomial(totals[:, j], left[j] / both[j]) for j in range(classes)], totals[:, -1]])
    theirs = totals - mine
    theirs[:, -1] = totals[:, -1] + mine[:, classes - 1]
    return mine, theirs


def shares(law: Law, seed: int, key: tuple[int, ...], totals: np.ndarray, weights: np.ndarray, first: int = 0) -> list[np.ndarray]:
    """Totals of each child (a row of ``weights``), by halving."""
    if len(weights) == 1:
        return [totals]
    half = len(weights) // 2
    rng = keyed_generator(seed, *key, first, len(weights))
    left, right = law(rng, totals, weights[:half].sum(axis=0), weights[half:].sum(axis=0))
    return shares(law, seed, key, left, weights[:half], first) + shares(law, seed, key, right, weights[half:], first + half)


def block_totals(roots: DataFrame, blocks: DataFrame, keys: list[str], n_blocks: int, seed: int, law: Law) -> DataFrame:
    """``keys, stratum, chunk, width, block, totals`` of every block of every root.

    ``roots`` has ``keys, stratum, chunk, width`` and ``totals``, a binary of ``width`` rows of longs. ``blocks`` has ``keys, block`` and
    ``weights`` (array of longs). Totals are spread over the blocks present.
    """
    carried = [*keys, "stratum", "chunk", "width"]
    level, depth = roots.select(*carried, F.lit(0).cast("long").alias("node"), "totals"), 0
    while FAN ** depth < n_blocks:
        depth += 1
    kinds = ", ".join(f"`{c}` {roots.schema[c].dataType.simpleString()}" for c in carried)

    for step in range(depth):
        below = FAN ** (depth - 1 - step)               # blocks under a child
        sizes = blocks.select(*keys, F.floor(F.col("block") / below).cast("long").alias("child"), F.posexplode("weights").alias("at", "w"))
        sizes = sizes.groupBy(*keys, "child", "at").agg(F.sum("w").alias("w"))
        rows = sizes.groupBy(*keys, "child").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"]).alias("w"))
        fan = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys], F.floor(F.col("child") / FAN).alias("__node")).agg(
            F.array_sort(F.collect_list(F.struct("child", "w"))).alias("children"))        # at most FAN entries
        match = F.col("node") == F.col("__node")
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"__{k}"))
        work = level.join(fan, match).select(*carried, "node", "totals", F.col("children.child").alias("child"),
                                             F.col("children.w").alias("w"))

        def run(frames: Iterator[pd.DataFrame], step=step) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples(index=False):
                    totals = np.frombuffer(row.totals, np.int64).reshape(row.width, -1)
                    weights = np.array([list(w) for w in row.w], np.int64)
                    parts = shares(law, seed, (row.stratum, row.chunk, step, row.node), totals, weights)
                    yield pd.DataFrame({**{c: [getattr(row, c)] * len(parts) for c in carried}, "node": np.asarray(row.child),
                                        "totals": [np.ascontiguousarray(p).tobytes() for p in parts]})

        level = work.mapInPandas(run, f"{kinds}, node long, totals binary")
    return level.withColumnRenamed("node", "block")
