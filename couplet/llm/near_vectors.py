"""Near-duplicate embeddings by Euclidean p-stable hashing with exact cosine checks.

Normalised vectors fall into buckets of several hash tables: each table rounds a handful of Gaussian
projections to a grid. Vectors that share a bucket are candidates, and candidates of the same label
are compared by exact cosine in double precision.

Tight groups never meet pairwise. A vector joins the *ball* of the smallest id in one of its buckets
when it lies within half the threshold angle of it, so members of one ball are linked by the
triangle inequality. Candidates are pairs of balls; centre angle and radii settle most of them as
"all linked" or "none linked", and only the rest is compared member by member, in blocks.

Nulls and edges: a vector that is null, empty, zero, or holds a null or non-finite component, and a
vector without a label, link with nothing. Vectors of different lengths are not compared. Rows that
repeat an id must repeat its vector; they are one vector. Rows without an id link with nothing and
have a null component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from couplet.llm.components import components
from couplet.operators.shared import materialise

TABLES, PROJECTIONS, CELL = 40, 14, 2.0     # finds a pair at cosine 0.93 with probability 0.99, at 0.97 with 0.99999
BALL_TABLES = 4
BLOCK = 256                                 # members of a ball that are compared at a time
MARGIN = 1e-9                               # keeps decisions by angle on the safe side of rounding


def rows_of(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector as float64, or None where it can't be compared."""
    out = []
    for v in column:
        v = v.as_py()
        x = None if not v or any(e is None for e in v) else np.asarray(v, np.float64)
        out.append(x if x is not None and np.isfinite(x).all() and x.any() else None)
    return out


def _hashes(unit: np.ndarray, tables: int, projections: int, cell: float, seed: int) -> np.ndarray:
    """One 64-bit bucket key per vector and table."""
    rng = np.random.Generator(np.random.PCG64([seed, unit.shape[1]]))
    directions = rng.standard_normal((unit.shape[1], tables * projections))
    shift = rng.uniform(0, cell, tables * projections)
    cells = np.floor((unit @ directions + shift) / cell).astype(np.int64).view(np.uint64)
    key = np.zeros((len(unit), tables), np.uint64)
    grid = cells.reshape(len(unit), tables, projections)
    for p in range(projections):
        key = (key ^ grid[:, :, p]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return (key + np.arange(tables, dtype=np.uint64)).view(np.int64)


def hashed(vectors: DataFrame, tables: int, projections: int, cell: float, seed: int) -> DataFrame:
    """``(id, label, size, unit, keys)`` of every vector that can be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                rows = rows_of(part.column("vector"))
                for size in sorted({len(x) for x in rows if x is not None}):
                    at = [i for i, x in enumerate(rows) if x is not None and len(x) == size]
                    x = np.stack([rows[i] for i in at])
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                    keys = _hashes(unit, tables, projections, cell, seed)
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(take), part.column("label").take(take),
                         pa.array(np.full(len(at), size, np.int32)), _lists(unit), _lists(keys)],
                        ["id", "label", "size", "unit", "keys"])

    kind = vectors.schema["label"].dataType.simpleString()
    usable = vectors.where("id is not null and label is not null and vector is not null").dropDuplicates(["id"])
    return usable.mapInArrow(run, f"id long, label {kind}, size int, unit array<double>, keys array<long>")


def _lists(matrix: np.ndarray) -> pa.Array:
    width = matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, width, dtype=np.int32)),
                                    pa.array(np.ascontiguousarray(matrix).ravel()))


def with_cosine(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Add ``cosine`` of two columns of unit vectors and drop both."""
    rest = [c for c in pairs.columns if c not in (left, right)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4000):
                part = batch.slice(start, 4000)
                a, b = part.column(left), part.column(right)
                sizes = np.diff(a.offsets.to_numpy())
                prod = a.flatten().to_numpy() * b.flatten().to_numpy()
                borders = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                cosine = np.add.reduceat(prod, borders) if len(sizes) else np.empty(0)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], pa.array(cosine)],
                                                 [*rest, "cosine"])

    schema = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in rest)
    return pairs.mapInArrow(run, f"{schema}, cosine double")


def _block_counts(rows: DataFrame, cosine: float) -> DataFrame:
    """Per row ``(id, unit, ball, others)``: how many of the other units reach the cosine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, others = batch.column("unit"), batch.column("others")
            counts = np.empty(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                x = units[i].values.to_numpy()
                counts[i] = int((others[i].values.flatten().to_numpy().reshape(-1, len(x)) @ x >= cosine).sum())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("ball"), pa.array(counts)],
                                             ["id", "ball", "n"])

    return rows.select("id", "ball", "unit", "others").mapInArrow(run, "id long, ball long, n long")


def near_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label",
                 cosine: float = 0.93, tables: int = TABLES, projections: int = PROJECTIONS, cell: float = CELL,
                 seed: int = 7) -> DataFrame:
    """``(id, n_links, component_id, kept)`` per row: links at ``cosine`` or more within a label."""
    plain = vectors.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{label}`").alias("label"),
                           F.col(f"`{vector}`").alias("vector"))
    units = materialise(hashed(plain, tables, projections, cell, seed))
    angle = math.acos(cosine)

    # A vector joins the ball of the smallest id among the near ones its first buckets name.
    keyed = units.select("id", "label", "size", F.posexplode("keys").alias("t", "key"))
    bucket = ["label", "size", "t", "key"]
    early = keyed.where(F.col("t") < BALL_TABLES)
    named = early.join(early.groupBy(*bucket).agg(F.min("id").alias("centre")), bucket) \
        .where("centre < id").select("id", "centre").distinct()
    near = with_cosine(
        named.join(units.select("id", F.col("unit").alias("u")), "id")
        .join(units.select(F.col("id").alias("centre"), F.col("unit").alias("v")), "centre"), "u", "v") \
        .where(F.col("cosine") >= math.cos(angle / 2 - MARGIN)) \
        .groupBy("id").agg(F.min(F.struct("centre", "cosine")).alias("m"))
    placed = materialise(units.select("id").join(near, "id", "left").select(
        "id", F.coalesce("m.centre", "id").alias("ball"),
        F.acos(F.least(F.coalesce("m.cosine", F.lit(1.0)), F.lit(1.0))).alias("off")))
    balls = materialise(placed.groupBy("ball").agg(F.count(F.lit(1)).alias("members"), F.max("off").alias("radius")))

    # Pairs of balls that share a bucket, settled by their centres where angles and radii allow.
    present = materialise(keyed.join(placed.select("id", "ball"), "id").select(*bucket, "ball").distinct())
    crowded = present.groupBy(*bucket).agg(F.min("ball").alias("lo"), F.max("ball").alias("hi")).where("lo != hi") \
        .select(*bucket)
    shared = present.join(crowded, bucket)
    met = shared.withColumnRenamed("ball", "a").join(shared.withColumnRenamed("ball", "b"), bucket) \
        .where("a < b").select("a", "b").distinct()
    centres = balls.join(units.select(F.col("id").alias("ball"), "unit"), "ball")
    pairs = with_cosine(
        met.join(centres.select(F.col("ball").alias("a"), F.col("members").alias("na"), F.col("radius").alias("ra"),
                                F.col("unit").alias("u")), "a")
        .join(centres.select(F.col("ball").alias("b"), F.col("members").alias("nb"), F.col("radius").alias("rb"),
                             F.col("unit").alias("v")), "b"), "u", "v")
    apart = F.acos(F.greatest(F.least("cosine", F.lit(1.0)), F.lit(-1.0)))
    reach = F.col("ra") + F.col("rb")
    lone = (F.col("na") == 1) & (F.col("nb") == 1) & (reach == 0)
    verdict = F.when(lone, F.when(F.col("cosine") >= cosine, "all").otherwise("none")) \
        .when(apart + reach <= angle - MARGIN, "all").when(apart - reach > angle + MARGIN, "none").otherwise("some")
    settled = materialise(pairs.select("a", "b", "na", "nb", verdict.alias("verdict")).where("verdict != 'none'"))

    both = settled.select(F.col("a").alias("ball"), F.col("b").alias("other"), F.col("nb").alias("n"), "verdict") \
        .unionByName(settled.select(F.col("b").alias("ball"), F.col("a").alias("other"), F.col("na").alias("n"),
                                    "verdict"))
    whole = both.where("verdict = 'all'").groupBy("ball").agg(F.sum("n").alias("whole"))
    # Undecided pairs of balls: each member against the other ball, in blocks of bounded size.
    open_pairs = both.where("verdict = 'some'").select("ball", "other")
    inside = placed.join(units.select("id", "unit"), "id")
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / F.lit(BLOCK)))
    blocks = inside.join(open_pairs.select(F.col("other").alias("ball")).distinct(), "ball") \
        .join(balls.select("ball", "members"), "ball") \
        .groupBy(F.col("ball").alias("other"), block.alias("block")).agg(F.collect_list("unit").alias("others"))
    compared = inside.join(open_pairs, "ball").drop("ball").join(blocks, "other") \
        .select("id", F.col("other").alias("ball"), "unit", "others")
    counted = materialise(_block_counts(compared, cosine).where("n > 0"))
    extra = counted.groupBy("id").agg(F.sum("n").alias("extra"))

    edges = placed.where("id != ball").select(F.col("id").alias("a"), F.col("ball").alias("b")) \
        .unionByName(settled.where("verdict = 'all'").select("a", "b")) \
        .unionByName(counted.select(F.col("id").alias("a"), F.col("ball").alias("b")))
    joined = components(edges)
    per_ball = balls.join(whole, "ball", "left").select(
        "ball", (F.col("members") - 1 + F.coalesce("whole", F.lit(0))).alias("sure"))
    links = placed.join(per_ball, "ball").join(extra, "id", "left") \
        .join(joined.withColumnRenamed("node", "id"), "id", "left") \
        .select("id", (F.col("sure") + F.coalesce("extra", F.lit(0))).alias("n_links"),
                F.coalesce("component", "id").alias("component_id"))
    return plain.select("id").join(links, "id", "left").select(
        F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.col("id").eqNullSafe(F.coalesce("component_id", "id")).alias("kept"))
