"""Column functions over fixed-length ``array<double>`` vectors.

Short vectors (``size <= UNROLL``) become plain arithmetic over ``v[0] .. v[n-1]``, which stays
inside whole-stage code generation. Longer ones use the built-in higher-order functions, which
are correct for any length but interpreted. Undefined results are NULL, never NaN.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

UNROLL = 16

# Floors that decide results, shared with any implementation of the same formulas.
BASE_EPS = 1e-8        # inside log(p + eps) when a table is folded with logits
DISTANCE_EPS = 1e-12   # clip of both sides of a distance
TEMPER_EPS = 1e-12     # clip before a power temper
PRIOR_EPS = 1e-6       # pseudo count of the empirical clone prior
CONC_FLOOR = 1e-3      # smallest Dirichlet concentration


def _indices(size: int) -> Column:
    return F.sequence(F.lit(0), F.lit(size - 1))


def fold(size: int, f: Callable[..., Column], *vectors: Column) -> Column:
    """Sum of ``f(v1[j], v2[j], ...)`` over all slots."""
    if size <= UNROLL:
        return reduce(operator.add, [f(*[v[j] for v in vectors]) for j in range(size)])
    return F.aggregate(
        _indices(size), F.lit(0.0),
        lambda acc, j: acc + f(*[F.get(v, j) for v in vectors]),
    )


def each(size: int, f: Callable[..., Column], *vectors: Column) -> Column:
    """Vector of ``f(v1[j], v2[j], ...)``."""
    if size <= UNROLL:
        return F.array(*[f(*[v[j] for v in vectors]) for j in range(size)])
    return F.transform(_indices(size), lambda j: f(*[F.get(v, j) for v in vectors]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, for formulas that use a computed vector often.

    Written out, nested vector formulas grow with a power of the length; bound, they stay small.
    """
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def literal_vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def total(v: Column, size: int) -> Column:
    return fold(size, lambda x: x, v)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def null_if_undefined(x: Column) -> Column:
    """NaN and infinities become NULL (used on ingest)."""
    return F.when(is_finite(x), x)


def xlog2x(x: Column) -> Column:
    """``x * log2(x)`` with ``0 * log 0 = 0`` (Spark's ``log2(0)`` is NULL)."""
    return F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))


def clamp(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounded value; NaN counts as undefined because ``greatest`` would let it win."""
    x = F.when(~F.isnan(x), x)
    if low is not None:
        x = F.when(x < low, F.lit(float(low))).otherwise(x)
    if high is not None:
        x = F.when(x > high, F.lit(float(high))).otherwise(x)
    return x


def at_least(x: Column, low: float) -> Column:
    return F.when(x > low, x).otherwise(F.lit(float(low)))


def sanitize(p: Column, size: int) -> Column:
    """Non-finite entries become ``1/size``, entry by entry and without renormalising."""
    return each(size, lambda x: F.when(is_finite(x), x).otherwise(F.lit(1.0 / size)), p)


def normalise(v: Column, size: int, floor: float | None = None) -> Column:
    """Vector divided by its sum, after raising entries to ``floor``; zero mass is NULL."""
    if floor is not None:
        v = each(size, lambda x: at_least(x, floor), v)
    s = total(v, size)
    return F.when(s > 0, each(size, lambda x: F.try_divide(x, s), v))


def log_base(p: Column, size: int) -> Column:
    return each(size, lambda x: F.ln(x + F.lit(BASE_EPS)), p)


def softmax(x: Column, size: int) -> Column:
    """Max-shifted softmax."""
    return let(x, lambda x: let(
        F.array_max(x), lambda top: let(
            each(size, lambda v: F.exp(v - top), x), lambda e: let(
                total(e, size), lambda s: each(size, lambda v: v / s, e)))))


def log_sum_exp(x: Column, size: int) -> Column:
    top = F.array_max(x)
    return top + F.ln(fold(size, lambda v: F.exp(v - top), x))


def temper_base(p: Column, size: int, temperature: float) -> Column:
    """``softmax(log(p + eps) / T)``; T = 1 is the exact identity."""
    if float(temperature) == 1.0:
        return p
    return softmax(each(size, lambda x: F.ln(x + F.lit(BASE_EPS)) / F.lit(float(temperature)), p), size)


def check_temperature(temperature: float) -> float:
    t = float(temperature)
    if not (0.0 < t < float("inf")):
        raise ValueError(f"pass a positive, finite temperature instead of {temperature!r}")
    return t


def temper_power(p: Column, size: int, temperature: float, eps: float = TEMPER_EPS) -> Column:
    """Rows ``p ** (1/T)`` renormalised after a clip; an underflowing row fails the job."""
    t = check_temperature(temperature)
    powered = each(size, lambda x: F.pow(at_least(x, eps), F.lit(1.0 / t)), p)
    message = F.lit(f"temperature {t} underflows: a row collapsed to zero under p ** (1/T)")

    def rescale(v: Column, s: Column) -> Column:
        return F.when(s > 0, each(size, lambda x: F.try_divide(x, s), v)).otherwise(F.raise_error(message))

    return let(powered, lambda v: let(total(v, size), lambda s: rescale(v, s)))


def temper_prior(p: Column, size: int, temperature: float) -> Column:
    """Tempered prior: add the pseudo count, renormalise, and for T != 1 raise to ``1/T`` and rescale."""
    t = check_temperature(temperature)
    shifted = let(each(size, lambda x: x + F.lit(PRIOR_EPS), p), lambda v: normalise(v, size))
    if t == 1.0:
        return shifted
    risen = let(shifted, lambda v: each(size, lambda x: F.pow(x, F.lit(1.0 / t)), v))
    return let(risen, lambda v: normalise(v, size))


def argmax_label(p: Column, levels: list[str]) -> Column:
    """Label of the first maximum."""
    return F.element_at(
        F.array(*[F.lit(x) for x in levels]), F.array_position(p, F.array_max(p)).cast("int")
    )


def shannon(v: Column, size: int, normalized: bool) -> Column:
    """Entropy in bits of a non-negative vector of any scale; zero mass is NULL."""
    s = total(v, size)
    h = F.log2(s) - F.try_divide(fold(size, xlog2x, v), s)
    if normalized and size > 1:
        h = F.try_divide(h, F.log2(F.lit(float(size))))
    return F.when(s > 0, non_negative(h))


def non_negative(x: Column) -> Column:
    """Rounding noise below zero becomes ``0.0`` (and never ``-0.0``)."""
    return F.when(x <= 0, F.lit(0.0)).otherwise(x)


def log_gamma(x: Column) -> Column:
    """``ln Gamma(x)`` for ``x > 0``: shift by eight, then the Stirling series."""
    shift = reduce(operator.mul, [x + F.lit(float(k)) for k in range(1, 8)], x)
    z = x + F.lit(8.0)
    series = (
        F.lit(1 / 12) / z
        - F.lit(1 / 360) / (z * z * z)
        + F.lit(1 / 1260) / F.pow(z, F.lit(5.0))
        - F.lit(1 / 1680) / F.pow(z, F.lit(7.0))
    )
    half_log_two_pi = 0.9189385332046727
    return (z - 0.5) * F.ln(z) - z + F.lit(half_log_two_pi) + series - F.ln(shift)


def dirichlet_multinomial(counts: Column, alpha: list[float]) -> Column:
    """Log evidence of a count vector under ``Dir(alpha)``, without the multinomial coefficient.

    One lambda serves all slots: the log-gamma expression is long, so it is not written out per slot.
    """
    a_sum = float(sum(alpha))
    n = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    slots = F.zip_with(counts, literal_vector(alpha), lambda c, a: log_gamma(c + a))
    constant = math.lgamma(a_sum) - sum(math.lgamma(a) for a in alpha)
    return F.lit(constant) - log_gamma(n + F.lit(a_sum)) + F.aggregate(slots, F.lit(0.0), lambda s, x: s + x)


def vector_from_counts(counts_by_label: Column, levels: list[str]) -> Column:
    """Dense vector in level order from a ``map<label, count>``; missing labels are 0."""
    return F.transform(
        F.array(*[F.lit(x) for x in levels]),
        lambda label: F.coalesce(F.try_element_at(counts_by_label, label).cast("double"), F.lit(0.0)),
    )


def stars(p: Column) -> Column:
    # Significance thresholds and their marks.
    return (
        F.when(p < 1e-4, "****").when(p < 1e-3, "***").when(p < 1e-2, "**").when(p < 0.05, "*").otherwise("ns")
    )


def versus(a: Column, b: Column) -> Column:
    return F.concat(a.cast("string"), F.lit(" vs "), b.cast("string"))
