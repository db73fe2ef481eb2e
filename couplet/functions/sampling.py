"""Small numpy helpers that run inside Spark tasks on one Arrow batch or one bounded block."""

from __future__ import annotations

import math

import numpy as np

from couplet.functions.vectors import CONC_FLOOR

_NUMPY_HYPERGEOMETRIC_LIMIT = 10**9


def keyed_generator(seed: int, *key: int) -> np.random.Generator:
    """Counter-based stream that depends on ``(seed, key)`` only, so never on partitioning."""
    words = [seed & 0xFFFFFFFFFFFFFFFF]
    mixed = 0
    for k in key:
        mixed = (mixed * 0x9E3779B97F4A7C15 + (int(k) & 0xFFFFFFFFFFFFFFFF) + 1) & 0xFFFFFFFFFFFFFFFF
    return np.random.Generator(np.random.Philox(key=np.array([words[0], mixed], dtype=np.uint64)))


def dirichlet_draws(conc: np.ndarray, n_draws: int, seed: int, key: int) -> np.ndarray:
    """``[n_draws, P]`` draws for one row.

    Works with log-gammas (``G(a) = G(a + 1) * U ** (1/a)``), so tiny concentrations cannot
    underflow to an all-zero row.
    """
    conc = np.maximum(np.asarray(conc, float), CONC_FLOOR)
    rng = keyed_generator(seed, key)
    shape = (n_draws, conc.size)
    log_g = np.log(rng.standard_gamma(conc + 1.0, size=shape)) + np.log1p(-rng.random(shape)) / conc
    log_g -= log_g.max(axis=1, keepdims=True)
    g = np.exp(log_g)
    return g / g.sum(axis=1, keepdims=True)


def fold_cells(draws: np.ndarray, logits: np.ndarray, logit_weight: float, base_weight: float,
               eps: float) -> np.ndarray:
    """``sum over cells of softmax(logit_weight * l + base_weight * log(draw + eps))`` per draw.

    The softmax numerator factors into a per-cell and a per-draw part, so the sum over cells is
    two matrix products. Extreme temperatures, where the factors could underflow, are summed
    in log space cell block by cell block.
    """
    log_b = np.log(draws + eps) * base_weight                   # [S, P]
    scaled = logits * logit_weight
    scaled = scaled - scaled.max(axis=1, keepdims=True)         # [n, P]
    log_b = log_b - log_b.max(axis=1, keepdims=True)
    if log_b.min() + min(scaled.min(), 0.0) > -300.0:
        cell = np.exp(scaled)
        base = np.exp(log_b)
        inverse = 1.0 / (cell @ base.T)                         # [n, S]
        return base * (inverse.T @ cell)
    out = np.zeros_like(draws)
    step = max(1, 2_000_000 // draws.size)
    for start in range(0, scaled.shape[0], step):
        x = scaled[start:start + step, None, :] + log_b[None, :, :]
        x = np.exp(x - x.max(axis=2, keepdims=True))
        out += (x / x.sum(axis=2, keepdims=True)).sum(axis=0)
    return out


def _log_falling_ratio(k: int, x: int) -> float:
    """``ln[ k! / ((k - x)! k**x) ]``, by Stirling with log1p where ``k`` is large."""
    rest = k - x
    if rest < 1_000_000:
        return math.lgamma(k + 1) - math.lgamma(rest + 1) - x * math.log(k)
    return -(rest + 0.5) * math.log1p(-x / k) - x + (1.0 / k - 1.0 / rest) / 12.0


def hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray,
                   sample: np.ndarray) -> np.ndarray:
    """Vectorised hypergeometric draws without numpy's population limit.

    Above the limit the binomial with the same mean is the proposal and the ratio of the two
    mass functions decides acceptance.
    """
    good, bad, sample = np.broadcast_arrays(
        np.asarray(good, np.int64), np.asarray(bad, np.int64), np.asarray(sample, np.int64)
    )
    out = np.zeros(good.shape, np.int64)
    large = (good >= _NUMPY_HYPERGEOMETRIC_LIMIT) | (bad >= _NUMPY_HYPERGEOMETRIC_LIMIT)
    small = ~large
    if small.any():
        out[small] = rng.hypergeometric(good[small], bad[small], sample[small])
    for i in np.flatnonzero(large):
        out.flat[i] = _large_hypergeometric(rng, int(good.flat[i]), int(bad.flat[i]), int(sample.flat[i]))
    return out


def _large_hypergeometric(rng, good: int, bad: int, sample: int) -> int:
    population = good + bad
    if good > bad:
        return sample - _large_hypergeometric(rng, bad, good, sample)
    if sample > population - sample:
        return good - _large_hypergeometric(rng, good, bad, population - sample)
    trials, marked = sorted((good, sample))     # the law is symmetric in the two
    if trials == 0:
        return 0
    p = marked / population

    def log_ratio(x: int) -> float:
        return _log_falling_ratio(marked, x) + _log_falling_ratio(population - marked, trials - x)

    mode = math.floor((trials - 1) * p)
    peak = max(log_ratio(mode), log_ratio(min(trials, mode + 1)))
    while True:
        x = int(rng.binomial(trials, p))
        if math.log1p(-rng.random()) <= log_ratio(x) - peak:
            return x


def split_margins(rng: np.random.Generator, left: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Random tables with fixed margins, one per row of ``left``.

    ``left`` is ``[R, P]`` (category totals, equal row sums); the result is ``[len(sizes), R, P]``
    with row totals ``sizes`` and column totals ``left``: sequential multivariate hypergeometric.
    """
    left = left.astype(np.int64).copy()
    n_tables, n_cats = left.shape
    out = np.zeros((len(sizes), n_tables, n_cats), np.int64)
    for i, size in enumerate(sizes):
        remaining = np.full(n_tables, int(size), np.int64)
        rest = left.sum(axis=1)
        for j in range(n_cats - 1):
            rest = rest - left[:, j]
            take = hypergeometric(rng, left[:, j], rest, remaining)
            out[i, :, j] = take
            remaining = remaining - take
        out[i, :, n_cats - 1] = remaining
        left -= out[i]
    return out


def xlog2x_sum(x: np.ndarray, axis) -> np.ndarray:
    x = x.astype(float)
    return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1.0)), 0.0).sum(axis=axis)


def permuted_table_terms(rng: np.random.Generator, sizes: np.ndarray, left: np.ndarray,
                         large: int = 64) -> np.ndarray:
    """``sum of x*log2(x)`` over the cells of a random table with fixed margins, per row of ``left``.

    Rows above ``large`` are drawn by their margins; the rest by shuffling the labels that
    remain, which is cheaper for small rows. Both are the same permutation law.
    """
    sizes = np.sort(np.asarray(sizes, np.int64))[::-1]
    big = sizes[sizes > large]
    small = sizes[sizes <= large]
    n_tables, n_cats = left.shape
    left = left.astype(np.int64).copy()
    terms = np.zeros(n_tables)
    for start in range(0, len(big), 256):
        block = split_margins(rng, left, big[start:start + 256])
        terms += xlog2x_sum(block, axis=(0, 2))
        left -= block.sum(axis=0)
    if len(small):
        owner = np.repeat(np.arange(len(small)), small)
        labels = np.arange(n_cats)
        for r in range(n_tables):
            shuffled = rng.permutation(np.repeat(labels, left[r]))
            table = np.bincount(owner * n_cats + shuffled, minlength=len(small) * n_cats)
            terms[r] += xlog2x_sum(table, axis=None)
    return terms


def _gaussian_binomial(n: int, m: int) -> np.ndarray:
    """Number of ways to reach each U statistic for sample sizes ``m <= n``, without ties."""
    dtype = np.int64 if math.comb(n + m, m) < 2**61 else object
    size = n * m + 1
    ways = np.zeros(size, dtype=dtype)
    ways[0] = 1
    for i in range(1, m + 1):
        shift = n + i
        if shift < size:
            moved = ways[:-shift].copy()
            ways[shift:] = ways[shift:] - moved
        for r in range(min(i, size)):
            ways[r::i] = np.cumsum(ways[r::i])
    return ways


def _normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


# Fixed value: the exact null distribution is used when a side has at most this many values.
EXACT_SIDE = 8


def mann_whitney_p(u_a: float, n_a: int, n_b: int, tie_term: float, alternative: str) -> float | None:
    """p-value of a Mann-Whitney U. ``tie_term`` is the sum of ``t**3 - t`` over tied values.

    Exact when a side is small and nothing is tied, else normal with tie and continuity
    correction; all-identical samples are undefined.
    """
    u_b = n_a * n_b - u_a
    if alternative == "greater":
        u = u_a
    elif alternative == "less":
        u = u_b
    else:
        u = max(u_a, u_b)
    factor = 2.0 if alternative == "two-sided" else 1.0
    n = n_a + n_b
    if tie_term == 0 and min(n_a, n_b) <= EXACT_SIDE:
        ways = _gaussian_binomial(max(n_a, n_b), min(n_a, n_b))
        tail = int(ways[int(round(u)):].sum())
        return min(1.0, factor * (tail / math.comb(n, n_a)))
    variance = n_a * n_b / 12.0 * ((n + 1) - tie_term / (n * (n - 1.0)))
    if variance <= 0:
        return None
    z = (u - n_a * n_b / 2.0 - 0.5) / math.sqrt(variance)
    return min(1.0, factor * _normal_sf(z))
