"""Leading principal axes of wide feature tables by randomised block Krylov iteration.

No feature-by-feature matrix is ever formed. A pass over the rows multiplies the (implicitly standardised) data with
a block of ``k`` and some directions and back; every task sends the sum of its rows' contributions, features by
directions, and the sums of all tasks are added in two rounds. The driver holds a few blocks of that size,
keeps them orthogonal, and reads the axes off the space they span (Rayleigh-Ritz). It stops when the axes'
residuals are small, which is measured, not assumed.

Features are an ``array<double>``, a vector, or a struct ``(indices, values)`` of the non-zero entries (then
``width`` tells their number), so a table of 35,000 sparse columns is read as it is.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from couplet.operators.shared import materialise

EXTRA = 8                   # directions beyond the wanted ones
HELD_BLOCKS = 8             # blocks that the driver keeps before it restarts from the best directions
MAX_PASSES = 60
TOLERANCE = 1e-9            # residual of an axis, relative to the largest variance
SLICE = 2048                # features in one row of partial sums
ENTRIES = 1 << 18           # sparse entries worked on at a time


@dataclass(frozen=True)
class Axes:
    """Means and deviations of the features, orthonormal axes (features by k) and the variance along each."""

    mean: np.ndarray
    deviation: np.ndarray
    axes: np.ndarray
    variance: np.ndarray
    passes: int
    residual: float


def stored(df: DataFrame, features: str) -> tuple[Column, bool]:
    """The features as an array or as indices and values, and whether they are sparse."""
    kind = df.schema[features].dataType
    if isinstance(kind, T.StructType):
        return F.when(F.col(features).isNotNull(), F.struct(F.col(features)["indices"].cast("array<int>").alias("indices"),
                                                            F.col(features)["values"].cast("array<double>").alias("values"))), True
    if isinstance(kind, T.ArrayType):
        return F.col(features).cast("array<double>"), False
    return vector_to_array(F.col(features)), False


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of an array column in a row, and the borders of its rows."""
    offsets = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


class Batch:
    """Rows of a batch, dense or sparse, as factors of two products."""

    def __init__(self, column: pa.Array, width: int, sparse: bool):
        self.width = width
        if not sparse:
            flat, borders = _flat(column)
            if len(flat) != width * len(column) or (np.diff(borders) != width).any():
                raise ValueError(f"a row does not have {width} features")
            self.dense, self.n = flat.astype(float).reshape(-1, width), len(column)
            return
        self.dense, self.n = None, len(column)
        self.index, self.borders = _flat(column.field("indices"))
        self.value = _flat(column.field("values"))[0].astype(float)
        if len(self.index) and (self.index.min() < 0 or self.index.max() >= width):
            raise ValueError(f"a feature number is outside 0..{width - 1}")

    def _pieces(self) -> Iterator[tuple[slice, slice]]:
        start = 0
        while start < self.n:
            stop = max(start + 1, int(np.searchsorted(self.borders, self.borders[start] + ENTRIES, side="right")) - 1)
            yield slice(start, stop), slice(int(self.borders[start]), int(self.borders[stop]))
            start = stop

    def times(self, q: np.ndarray, power: int = 1) -> np.ndarray:
        """Rows, each entry raised to ``power``, times a matrix."""
        if self.dense is not None:
            return self.dense ** power @ q
        out = np.zeros((self.n, q.shape[1]))
        for rows, entries in self._pieces():
            owner = np.repeat(np.arange(rows.start, rows.stop), np.diff(self.borders[rows.start:rows.stop + 1]))
            index, value = self.index[entries], self.value[entries] ** power
            for c in range(q.shape[1]):
                out[rows, c] += np.bincount(owner - rows.start, value * q[index, c], rows.stop - rows.start)
        return out

    def back(self, z: np.ndarray, power: int = 1) -> np.ndarray:
        """Transposed rows, each entry raised to ``power``, times a matrix with a row per row."""
        if self.dense is not None:
            return (self.dense ** power).T @ z
        owner, value = np.repeat(np.arange(self.n), np.diff(self.borders)), self.value ** power
        return np.stack([np.bincount(self.index, value * z[owner, c], self.width) for c in range(z.shape[1])], axis=1)

    def moments(self) -> np.ndarray:
        if self.dense is not None:
            return np.stack([self.dense.sum(axis=0), (self.dense ** 2).sum(axis=0)], axis=1)
        return np.stack([np.bincount(self.index, self.value ** p, self.width) for p in (1, 2)], axis=1)


def added_up(rows: DataFrame, width: int, sparse: bool, columns: int, contribution) -> tuple[np.ndarray, np.ndarray]:
    """Sum over all rows of ``contribution(batch) -> (features x columns, extra columns)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        total, extra = np.zeros((width, columns)), np.zeros(columns)
        for batch in batches:
            part, side = contribution(Batch(batch.column(0), width, sparse))
            total += part
            extra += side
        pieces = [total[s:s + SLICE].tobytes() for s in range(0, width, SLICE)] + [extra.tobytes()]
        lane = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pieces))), pa.array(np.full(len(pieces), lane)), pa.array(pieces, pa.binary())],
                                         ["slice", "lane", "part"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for s, lane, part in zip(*(batch.column(i).to_pylist() for i in range(3))):
                known = held.get((s, lane))
                held[s, lane] = np.frombuffer(part) + (0 if known is None else known)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int64()), pa.array([k[1] for k in held], pa.int64()),
                                          pa.array([v.tobytes() for v in held.values()], pa.binary())], ["slice", "lane", "part"])

    schema = "slice long, lane long, part binary"
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    slices = -(-width // SLICE) + 1
    sums = rows.mapInArrow(run, schema).repartition(min(4 * slices, 2 * tasks), "slice", "lane").mapInArrow(fold, schema) \
        .withColumn("lane", F.lit(0).cast("long")).repartition(min(slices, 2 * tasks), "slice").mapInArrow(fold, schema)
    parts = {r["slice"]: np.frombuffer(bytes(r["part"])) for r in sums.select("slice", "part").collect()}   # width x columns numbers
    blocks = [parts[i].reshape(-1, columns) for i in range(slices - 1)]
    return np.concatenate(blocks), parts[slices - 1]


def principal_axes(df: DataFrame, features: str = "features", *, k: int = 10, width: int | None = None, standardise: bool = True,
                   seed: int = 0, max_passes: int = MAX_PASSES, tolerance: float = TOLERANCE) -> Axes:
    """The ``k`` axes of largest variance. Constant features count nothing; rows with NULL features are left out."""
    column, sparse = stored(df, features)
    rows = materialise(df.select(column.alias("x")).where("x is not null"))
    if width is None:
        if sparse:
            raise ValueError("sparse features need width")
        width = rows.select(F.size("x").alias("n")).limit(1).collect()
        width = width[0]["n"] if width else 0
    n = rows.count()
    if not n or not width:
        raise ValueError("no rows with features")
    moments, _ = added_up(rows, width, sparse, 2, lambda b: (b.moments(), np.zeros(2)))
    mean = moments[:, 0] / n
    spread = np.sqrt(np.maximum(moments[:, 1] - n * mean ** 2, 0) / max(1, n - 1))
    steady = spread <= 1e-12 * np.maximum(1.0, np.abs(mean))
    scale = np.where(steady, 0.0, 1.0 / np.where(steady, 1.0, spread)) if standardise else np.where(steady, 0.0, 1.0)

    def covered(q: np.ndarray) -> np.ndarray:
        """Covariance of the standardised features times ``q``, from one pass."""
        scaled = q * scale[:, None]
        centre = mean @ scaled

        def contribution(batch: Batch):
            z = batch.times(scaled) - centre
            return batch.back(z), z.sum(axis=0)

        total, sums = added_up(rows, width, sparse, q.shape[1], contribution)
        return (total - np.outer(mean, sums)) * scale[:, None] / max(1, n - 1)

    k = min(k, width)
    lanes = min(width, k + EXTRA)
    rng = np.random.default_rng(seed)
    block, _ = np.linalg.qr(rng.normal(size=(width, lanes)))
    basis, image = np.empty((width, 0)), np.empty((width, 0))
    passes, residual = 0, np.inf
    while True:
        basis, image = np.column_stack([basis, block]), np.column_stack([image, covered(block)])
        passes += 1
        small = basis.T @ image
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)
        values, vectors = values[order], vectors[:, order]
        ritz, moved = basis @ vectors, image @ vectors
        gap = moved[:, :k] - ritz[:, :k] * values[:k]
        residual = float(np.linalg.norm(gap, axis=0).max() / max(values[0], 1e-300))
        if residual <= tolerance or passes >= max_passes or basis.shape[1] >= width:
            break
        if basis.shape[1] + lanes > HELD_BLOCKS * lanes:
            basis, image = ritz[:, :2 * lanes], moved[:, :2 * lanes]
        fresh = image[:, -lanes:] if basis.shape[1] > 2 * lanes or passes < 2 else moved[:, :lanes] - ritz[:, :lanes] * values[:lanes]
        for _ in range(2):                                      # twice is enough for orthogonality
            fresh = fresh - basis @ (basis.T @ fresh)
        q, r = np.linalg.qr(fresh)
        alive = np.abs(np.diag(r)) > 1e-13 * max(values[0], 1e-300)
        block = q[:, alive][:, :width - basis.shape[1]]
        if not block.shape[1]:                                  # the space is closed: its axes are exact
            break
    if residual > max(1e-6, tolerance) and basis.shape[1] < width:
        warnings.warn(f"axes after {passes} passes have a residual of {residual:.2g} of the largest variance", stacklevel=2)
    axes = ritz[:, :k]
    top = np.abs(axes).argmax(axis=0)
    axes = axes * np.where(axes[top, np.arange(k)] < 0, -1.0, 1.0)
    return Axes(mean, scale, axes, np.maximum(values[:k], 0), passes, residual)


def projected(df: DataFrame, found: Axes, features: str = "features", out: str = "latent") -> DataFrame:
    """``df`` without its features and with ``out``, the coordinates along the axes (NULL for NULL features)."""
    column, sparse = stored(df, features)
    others = [c for c in df.columns if c not in (features, out)]
    schema = T.StructType([*[df.schema[c] for c in others], T.StructField(out, T.ArrayType(T.DoubleType()))])
    scaled = found.axes * found.deviation[:, None]
    centre = found.mean @ scaled
    width, k = scaled.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(len(others))
            known = x.is_valid().to_numpy(zero_copy_only=False)
            z = Batch(x.drop_null(), width, sparse).times(scaled) - centre
            offsets = np.concatenate([[0], np.cumsum(np.where(known, k, 0))]).astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~known, False)), pa.array(z.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(others))], made], schema.names)

    return df.select(*[F.col(f"`{c}`") for c in others], column.alias("__x")).mapInArrow(run, schema)
