"""Highest-density intervals over a short, bounded array of draws (one array per result row)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HDI_PROB = 0.94  # Fixed value: default mass of the interval.


def hdi_bounds(values: Column, prob: float = HDI_PROB) -> Column:
    """``struct(low, high)`` of the narrowest window spanning ``max(1, floor(prob*n))`` steps."""
    s = F.sort_array(values)
    n = F.size(s)
    inc = F.greatest(F.lit(1), F.floor(n * F.lit(float(prob))).cast("int"))
    windows = F.transform(
        F.sequence(F.lit(0), n - inc - 1),
        lambda i: F.struct(
            (F.get(s, i + inc) - F.get(s, i)).alias("width"), i.alias("at"),
            F.get(s, i).alias("low"), F.get(s, i + inc).alias("high"),
        ),
    )
    best = F.array_min(windows)
    whole = F.struct(F.get(s, F.lit(0)).alias("low"), F.get(s, n - 1).alias("high"))
    narrow = F.struct(best["low"].alias("low"), best["high"].alias("high"))
    return F.when(n == 0, F.lit(None)).when(inc >= n, whole).otherwise(narrow)
