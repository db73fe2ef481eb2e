"""Distances between two phenotype distributions, in bits where a logarithm is involved."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from couplet.functions.vectors import DISTANCE_EPS, at_least, each, fold, let, total


def _clipped(p: Column, size: int, eps: float) -> Column:
    return each(size, lambda x: at_least(x, eps), p)


def _rescaled_pair(p: Column, q: Column, size: int, body: Callable[[Column, Column], Column]) -> Column:
    """``body(p, q)`` on clipped vectors rescaled to sum 1, each evaluated once."""
    def unit(v: Column) -> Column:
        return let(_clipped(v, size, DISTANCE_EPS), lambda c: let(total(c, size), lambda s: each(size, lambda x: x / s, c)))

    pair = F.struct(unit(p).alias("p"), unit(q).alias("q"))
    defined = F.when(p.isNotNull() & q.isNotNull(), pair)
    return let(defined, lambda t: body(t["p"], t["q"]))


def kl_divergence(p: Column, q: Column, size: int, eps: float = DISTANCE_EPS) -> Column:
    """KL(p || q) after both sides are clipped and rescaled; plain sums, so it stays compiled."""
    p, q = _clipped(p, size, eps), _clipped(q, size, eps)
    sp, sq = total(p, size), total(q, size)
    return fold(size, lambda a, b: a * F.log2(a / b), p, q) / sp - F.log2(sp / sq)


def l1_distance(p: Column, q: Column, size: int) -> Column:
    return _rescaled_pair(p, q, size, lambda a, b: fold(size, lambda x, y: F.abs(x - y), a, b))


def jensen_shannon(p: Column, q: Column, size: int) -> Column:
    def half(x: Column, y: Column) -> Column:
        m = (x + y) * 0.5
        return (x * F.log2(x / m) + y * F.log2(y / m)) * 0.5

    return _rescaled_pair(p, q, size, lambda a, b: fold(size, half, a, b))


# Accepted distance names.
_NAMES: dict[str, Callable[[Column, Column, int], Column]] = {
    "l1": l1_distance,
    "kl": kl_divergence,
    "dkl": kl_divergence,
    "js": jensen_shannon,
    "jsd": jensen_shannon,
}


def python_distance(f: Callable[[np.ndarray, np.ndarray], float]) -> Callable[[Column, Column, int], Column]:
    """Wrap a plain ``f(p, q) -> float`` as an Arrow-batched scalar function."""

    @F.pandas_udf(T.DoubleType())
    def call(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([
            None if a is None or b is None else float(f(np.asarray(a, float), np.asarray(b, float)))
            for a, b in zip(p, q)
        ], dtype="float64")

    return lambda p, q, size: call(p, q)


@dataclass(frozen=True)
class ColumnDistance:
    """Marks a user distance written with Column functions, ``f(p, q, size) -> Column``."""

    f: Callable[[Column, Column, int], Column]


def resolve_distance(metric) -> Callable[[Column, Column, int], Column]:
    """A name, a ``ColumnDistance``, or a Python ``f(p, q) -> float``; unknown names are refused."""
    if isinstance(metric, ColumnDistance):
        return metric.f
    if callable(metric):
        return python_distance(metric)
    key = str(metric).lower()
    if key not in _NAMES:
        raise ValueError(f"unknown distance_metric {metric!r}: pass a function of two vectors, or one of {sorted(_NAMES)}")
    return _NAMES[key]
