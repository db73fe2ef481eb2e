"""Gaussian mixtures with diagonal covariance, fitted by expectation-maximisation as grouped sums.

A pass over the rows computes how much of each row belongs to each component, and adds up, per component, these
shares, the weighted features and their squares; the next parameters are quotients of the sums. What leaves a
task is a few numbers per component and feature, whatever its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from couplet.operators.shared import materialise
from couplet.operators.subspace import Batch, added_up, stored

FLOOR = 1e-6                # Fixed value: added to every variance.
GAIN = 1e-3                 # Fixed value: mean log-likelihood gain per row below which the fit ends.
MAX_ITER = 100              # Fixed value.


@dataclass(frozen=True)
class Mixture:
    """Weights (k), means and variances (k by features), and the mean log-likelihood after each pass."""

    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    likelihood: tuple[float, ...] = ()

    def log_shares(self, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each component per row, and the row's log-likelihood."""
        precision = 1.0 / self.variances
        away = batch.times((0.5 * precision).T, power=2) - batch.times((self.means * precision).T)
        fixed = 0.5 * ((self.means ** 2 * precision).sum(axis=1) + np.log(2 * np.pi * self.variances).sum(axis=1))
        with np.errstate(divide="ignore"):
            joint = np.log(self.weights) - away - fixed
        top = joint.max(axis=1, keepdims=True)
        whole = top[:, 0] + np.log(np.exp(joint - top).sum(axis=1))
        return joint - whole[:, None], whole


def fit_mixture(df: DataFrame, start: np.ndarray, features: str = "features", *, max_iter: int = MAX_ITER, gain: float = GAIN,
                floor: float = FLOOR) -> Mixture:
    """Fit from the means ``start`` (k by features), equal weights and the features' own variances.

    The log-likelihood never falls. A component that loses all rows keeps its place with weight 0. Rows with NULL
    features are left out.
    """
    column, sparse = stored(df, features)
    rows = materialise(df.select(column.alias("x")).where("x is not null"))
    k, width = start.shape
    moments, counted = added_up(rows, width, sparse, 2, lambda b: (b.moments(), np.array([b.n, 0.0])))
    n = counted[0]
    if not n:
        raise ValueError("no rows with features")
    spread = np.maximum(moments[:, 1] / n - (moments[:, 0] / n) ** 2, 0) + floor
    now = Mixture(np.full(k, 1.0 / k), np.asarray(start, float), np.tile(spread, (k, 1)))
    for _ in range(max_iter):
        mixture = now

        def contribution(batch: Batch):
            shares, whole = mixture.log_shares(batch)
            shares = np.exp(shares)
            side = np.concatenate([shares.sum(axis=0), [whole.sum()], np.zeros(k - 1)])
            return np.concatenate([batch.back(shares), batch.back(shares, power=2)], axis=1), side

        sums, side = added_up(rows, width, sparse, 2 * k, contribution)
        mass = side[:k]
        held = mass > 0
        means = np.where(held[:, None], sums[:, :k].T / np.maximum(mass, 1e-300)[:, None], now.means)
        square = sums[:, k:].T / np.maximum(mass, 1e-300)[:, None]
        variances = np.where(held[:, None], np.maximum(square - means ** 2, 0) + floor, now.variances)
        seen = (*now.likelihood, float(side[k] / n))
        now = Mixture(mass / n, means, variances, seen)
        if len(seen) > 1 and seen[-1] - seen[-2] < gain:
            break
    return now


def assigned(df: DataFrame, mixture: Mixture, features: str = "features", out: str = "cluster") -> DataFrame:
    """Add ``out``, the most probable component (the first of equals; NULL for NULL features)."""
    column, sparse = stored(df, features)
    others = [c for c in df.columns if c != out]
    schema = T.StructType([*[df.schema[c] for c in others], T.StructField(out, T.IntegerType())])
    width = mixture.means.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(len(others))
            known = x.is_valid().to_numpy(zero_copy_only=False)
            label = np.zeros(len(x), np.int32)
            label[known] = mixture.log_shares(Batch(x.drop_null(), width, sparse))[0].argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(others))], pa.array(label, mask=~known)], schema.names)

    return df.select(*[F.col(f"`{c}`") for c in others], column.alias("__x")).mapInArrow(run, schema)
