"""Hard-negative mining for embeddings by slot-decomposed selection.

Every anchor has a few positives, the best-scored other rows of its label. For each positive the hard
negatives are the best-scored rows of other labels whose score lies in a window set by the
positive's score. The windows of one anchor overlap, so they are not searched one by one: their upper
limits split the scores into disjoint slots, every task keeps the top of each slot, a window function merges
the tasks' tops, and the slots from a window's limit downwards, taken together, hold its answer.

Vectors are floored to integers, so scores are exact integers and do not depend on the order of sums.
All rows meet the anchors in blocks: anchors travel to the tasks in chunks of bounded bytes, one pass over the
rows per chunk and phase; rows are never shuffled, and what tasks send on are tops alone.

Nulls and edges: rows with a null id, label or vector, or with a null or non-finite component, take no part, nor
do those with a component beyond ``LARGEST``, whose scores would not fit a long. Rows that repeat an id
count once, the one with the smallest label and vector. Vectors of different length have no score with each
other; empty ones score 0. Ties go to the smaller id. A positive with a negative score has an empty window. Without
anchors or rows the result is empty. Columns besides id, label and vector are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from couplet.operators.shared import materialise

LARGEST = float(1 << 18)
CHUNK_BYTES, CHUNK_ANCHORS = 32 << 20, 16_384      # anchors per pass over the rows
BLOCK_ROWS, BLOCK_ANCHORS = 2048, 1024             # scores worked on at a time
NEVER = np.iinfo(np.int64).min


def integer_rows(vectors: DataFrame, id: Column, label: Column, vector: Column, scale: int = 256) -> DataFrame:
    """``(id, label, q)`` of the rows that take part, one per id; ``q`` are the components times ``scale``, floored."""
    plain = vectors.select(id.cast("long").alias("id"), label.cast("long").alias("label"), vector.cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    rows = materialise(plain.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & sound)
                       .select("id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("q")))
    # Only ids travel to find the repeated ones, and only rows of repeated ids are compared.
    repeated = materialise(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    if repeated.isEmpty():
        return rows
    first = rows.join(repeated, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "q")).alias("r"))
    return materialise(rows.join(repeated, "id", "left_anti").unionByName(first.select("id", "r.*")))


class Chunk:
    """Anchors of one pass, by vector length, and the limits of their windows once these are known."""

    def __init__(self, rows: pa.Table):
        ids, labels, groups = _columns(rows.column("id"), rows.column("label"), rows.column("q"))
        self.parts = {size: (ids[at], labels[at], q) for size, (at, q) in groups.items()}

    def limits(self, anchors: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Per vector length: distinct upper limits of each anchor, descending, and its smallest lower limit."""
        pairs = np.unique(np.stack([anchors, -upper], axis=1), axis=0) if len(anchors) else np.empty((0, 2), np.int64)
        start = np.searchsorted(pairs[:, 0], pairs[:, 0], side="left")
        rank = np.arange(len(pairs)) - start
        width = int(rank.max()) + 1 if len(pairs) else 1
        out = {}
        for size, (ids, _, _) in self.parts.items():
            order = np.argsort(ids)
            limit, least = np.full((len(ids), width), NEVER), np.full(len(ids), np.iinfo(np.int64).max)
            for table, keys in ((pairs, pairs[:, 0]), (None, anchors)):
                at = np.minimum(np.searchsorted(ids[order], keys), len(ids) - 1)
                mine = ids[order][at] == keys
                if table is not None:
                    limit[order[at[mine]], rank[mine]] = -table[mine, 1]
                else:
                    np.minimum.at(least, order[at[mine]], lower[mine])
            out[size] = (limit, least)
        return out


def _columns(id, label, q) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Ids, labels, and per vector length the positions of its rows and their matrix."""
    lists = q.combine_chunks() if isinstance(q, pa.ChunkedArray) else q
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    offsets = lists.offsets.to_numpy()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    offsets = offsets - offsets[0] if len(offsets) else offsets
    sizes = np.diff(offsets)
    groups = {}
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        groups[int(size)] = (at, flat[offsets[at][:, None] + np.arange(size)[None, :]])
    return np.asarray(id.to_numpy()), np.asarray(label.to_numpy()), groups


def _scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact integer products: doubles hold them up to 2**53, longs beyond."""
    reach = np.abs(rows).max(initial=0) * np.abs(anchors).max(initial=0) * max(1, rows.shape[1])
    if reach < 1 << 53:
        return (rows @ anchors.T).astype(np.int64)
    return rows.astype(np.int64) @ anchors.astype(np.int64).T


class Tops:
    """The best entries seen per slot, best score first, then smallest id."""

    def __init__(self, slots: int, keep: int):
        self.keep = keep
        self.slot, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.bar = np.full(slots, NEVER)                 # score that an entry must reach to matter

    def add(self, slot: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        good = score >= self.bar[slot]
        if not good.any():
            return
        slot, score, id = (np.concatenate([old, new[good]]) for old, new in
                           ((self.slot, slot), (self.score, score), (self.id, id)))
        order = np.lexsort((id, -score, slot))
        slot = slot[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot, side="left")
        kept = rank < self.keep
        order = order[kept]
        self.slot, self.score, self.id = slot[kept], score[order], id[order]
        full = rank[kept] == self.keep - 1
        self.bar[self.slot[full]] = self.score[full]


def _search(rows: DataFrame, chunk: Chunk, slots: dict[int, int], keep: int, pick) -> DataFrame:
    """``(anchor, slot, score, id)``: per anchor and slot the top of each task; ``pick`` finds the candidates.

    ``pick(size, own, scores, same, ids)`` gets a block of scores (rows by anchors ``own``), whether labels are
    equal, and the row ids; it returns row positions, anchor positions within the block and slots.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = {(size, a): Tops(min(BLOCK_ANCHORS, len(part[0]) - a) * slots[size], keep)
                for size, part in chunk.parts.items() for a in range(0, len(part[0]), BLOCK_ANCHORS)}
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(start, BLOCK_ROWS)
                ids, labels, groups = _columns(piece.column("id"), piece.column("label"), piece.column("q"))
                for size, (at, q) in groups.items():
                    if size not in chunk.parts:
                        continue
                    anchor_ids, anchor_labels, vectors = chunk.parts[size]
                    for a in range(0, len(anchor_ids), BLOCK_ANCHORS):
                        own = slice(a, a + BLOCK_ANCHORS)
                        scores = _scores(q, vectors[own])
                        same = labels[at][:, None] == anchor_labels[own][None, :]
                        row, column, slot = pick(size, own, scores, same, ids[at][:, None] == anchor_ids[own][None, :])
                        tops[size, a].add(column * slots[size] + slot, scores[row, column], ids[at][row])
        for (size, a), top in tops.items():
            if len(top.slot):
                anchor = chunk.parts[size][0][a + top.slot // slots[size]]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array((top.slot % slots[size]).astype(np.int32)),
                                                  pa.array(top.score), pa.array(top.id)], ["anchor", "slot", "score", "id"])

    partial = rows.mapInArrow(run, "anchor long, slot int, score long, id long")
    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)


def positives_of(rows: DataFrame, chunk: Chunk, count: int) -> DataFrame:
    """``(anchor, positive_id, positive_score)``: the best other rows of each anchor's label."""
    def pick(size, own, scores, same, self_):
        row, column = np.nonzero(same & ~self_)
        return row, column, np.zeros(len(row), np.int64)

    found = _search(rows, chunk, dict.fromkeys(chunk.parts, 1), count, pick)
    return found.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))


def negatives_of(rows: DataFrame, chunk: Chunk, positives: DataFrame, count: int, low: int, high: int) -> DataFrame:
    """Hard negatives of every positive of the chunk's anchors, by slots."""
    known = positives.where("positive_score >= 0").select("anchor", "positive_score").toArrow()     # a few per anchor
    score = known.column("positive_score").to_numpy().astype(np.int64)
    limits = chunk.limits(known.column("anchor").to_numpy().astype(np.int64), high * score // 100, -(-low * score // 100))
    slots = {size: limit.shape[1] for size, (limit, _) in limits.items()}

    def pick(size, own, scores, same, self_):
        limit, least = limits[size][0][own], limits[size][1][own]
        row, column = np.nonzero(~same & (scores <= limit[:, 0]) & (scores >= least))
        at = scores[row, column]
        slot = np.full(len(row), -1)
        for k in range(limit.shape[1]):
            slot += at <= limit[column, k]
        return row, column, slot

    tops = _search(rows, chunk, slots, count, pick).groupBy("anchor", "slot") \
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("score"), "id"))).alias("top"))
    held = tops.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "top"))).alias("slots"))
    # Slots descend in score, so a window's answer is the head of its own slot and those after it.
    order = Window.partitionBy("anchor").orderBy(F.desc(F.expr(f"positive_score * {int(high)} div 100")))
    asked = positives.where("positive_score >= 0").withColumn("from", F.dense_rank().over(order) - 1)
    merged = F.slice(F.flatten(F.transform(F.filter("slots", lambda s: s["slot"] >= F.col("from")), lambda s: s["top"])), 1, count)
    inside = F.filter("merged", lambda n: -n["score"] * 100 >= F.col("positive_score") * low)
    return asked.join(held, "anchor").withColumn("merged", merged).select(
        "anchor", "positive_id", "positive_score", F.posexplode(inside).alias("pos", "n")).select(
        F.col("anchor").alias("anchor_id"), "positive_id", (F.col("pos") + 1).cast("int").alias("rank"),
        F.col("n.id").alias("negative_id"), "positive_score", (-F.col("n.score")).alias("negative_score"))


def hard_negatives(vectors: DataFrame, anchors: Column, id: Column | None = None, label: Column | None = None,
                   vector: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   scale: int = 256) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``anchors`` is a condition on the column ``id`` (by default ``vec_id``) of the prepared rows. A negative's score lies between ``low``
    and ``high`` hundredths of the positive's.
    """
    rows = integer_rows(vectors, F.col("vec_id") if id is None else id, F.col("label") if label is None else label,
                        F.col("embedding") if vector is None else vector, scale)
    chosen = rows.where(anchors)
    size = chosen.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("width")).first()
    per_pass = max(1, min(CHUNK_ANCHORS, CHUNK_BYTES // (8 * max(1, size["width"] or 1))))
    passes = -(-size["n"] // per_pass)
    out = []
    for k in range(passes):
        chunk = Chunk(chosen.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == k).toArrow())
        best = materialise(positives_of(rows, chunk, positives))
        out.append(materialise(negatives_of(rows, chunk, best, negatives, low, high)))
    if not out:
        return rows.sparkSession.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, out)
