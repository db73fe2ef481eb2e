"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

The features of a line are measures of its characters and words, and those of the lines before and
after it. Lines of a labelled document carry the document's label in training. Forward-backward
marginals of "good", weighted by the words of the lines, add up to the document's score.

The field is fitted on the driver on a bounded sample: about ``SAMPLE_DOCUMENTS`` labelled documents
per class, those whose id hash falls below a bound set by their number, each of at most
``SAMPLE_LINES`` lines. Scoring
covers every line of every text, in the tasks.

Nulls and edges: lines without a word are no part of the chain. A text without words scores 0. Without
labels of both classes every other text scores the share of good labels (0.5 without any). Rows
without an id are scored like others and never learned from. Repeated rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from couplet.llm.texts import LOWER, Texts, annotate, sums, windows

SAMPLE_DOCUMENTS = 2000         # per class, of some tens of bytes each where they are broadcast
SAMPLE_LINES = 200
GOOD_FROM = 0.3
FOLDS = 5
STEPS, RATE, DECAY = 150, 0.05, 1e-3
REPEAT = 4                      # words of a run that counts as repeated when the text has it twice

def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_KINDS = {"symbols": _table(b"#*$%&|<>{}[]=_~^\\/@"), "shouts": _table(b"!?"), "digits": _table(b"0123456789"),
          "stops": _table(b".,;:"), "upper": _table(bytes(range(65, 91)))}
N_OWN = len(_KINDS) + 8


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per line with a word: own features, owning text, number of words."""
    texts = Texts(column)
    starts, ends = texts.words()
    begin, end, owner = texts.lines()
    borders = np.searchsorted(starts, np.append(begin, len(texts.data)))
    solid = np.diff(borders) > 0
    if not solid.any():
        return np.empty((0, N_OWN)), np.empty(0, np.int64), np.empty(0, np.int64)
    begin, end, owner = begin[solid], end[solid], owner[solid]
    borders = np.append(borders[:-1][solid], len(starts))
    n_words = np.diff(borders)
    size = (end - begin).astype(np.float64)

    columns = []
    for kind, table in _KINDS.items():
        flag = table[texts.data]
        if kind == "upper":                       # capitals of two-byte Latin letters end in 0x80..0x9E after 0xC3
            flag = flag.copy()
            flag[1:] |= (texts.data[:-1] == 0xC3) & (texts.data[1:] >= 0x80) & (texts.data[1:] <= 0x9E)
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(flag)])
        columns.append((upto[end] - upto[begin]) / size)
    h = texts.hashes(starts, ends)
    line_of = np.repeat(np.arange(len(n_words)), n_words)
    repeated = np.zeros(len(h), bool)
    repeated[1:] = (h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1])
    columns.append(sums(repeated, borders) / n_words)
    order = np.lexsort((h, line_of))
    fresh = np.ones(len(h), bool)
    fresh[order[1:]] = (h[order[1:]] != h[order[:-1]]) | (line_of[order[1:]] != line_of[order[:-1]])
    columns.append(sums(fresh, borders) / n_words)
    # Words at the start of a run that the same text has twice, whatever the case of its letters.
    low = Texts.__new__(Texts)
    low.data, low.bounds, low.n, low._prefix = LOWER[texts.data], texts.bounds, texts.n, None
    runs = windows(low.hashes(starts, ends), REPEAT)
    text_of = owner[line_of]
    inside = np.flatnonzero(text_of[:len(runs)] == text_of[REPEAT - 1:]) if len(runs) else np.empty(0, np.int64)
    key = runs[inside] + text_of[inside].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    order = np.argsort(key)
    equal = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[inside[order[1:][equal]]] = True
    twice[inside[order[:-1][equal]]] = True
    columns.append(sums(twice, borders) / n_words)
    line_hash = texts.hashes(begin, end)
    order = np.lexsort((np.arange(len(begin)), line_hash, owner))
    again = np.zeros(len(begin))
    again[order[1:]] = (line_hash[order][1:] == line_hash[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    columns.append(again)
    columns.append(np.log1p(n_words))
    length = sums(ends - starts, borders) / n_words
    columns.append(np.minimum(length, 60.0) / 10)
    final = texts.data[ends[borders[1:] - 1] - 1]
    columns.append(np.isin(final, list(b".!?:")).astype(np.float64))
    lead = starts[borders[:-1]]
    columns.append(_KINDS["upper"][texts.data[lead]].astype(np.float64))
    return np.stack(columns, axis=1), owner, n_words


def with_neighbours(own: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (0 at the ends), and whether these exist."""
    n, k = own.shape
    out = np.zeros((n, 3 * k + 3))
    out[:, :k] = own
    same = np.concatenate([[False], owner[1:] == owner[:-1]]) if n else np.empty(0, bool)
    out[1:, k:2 * k] = own[:-1] * same[1:, None]
    out[:-1, 2 * k:3 * k] = own[1:] * same[1:, None]
    out[:, 3 * k] = same
    out[:-1, 3 * k + 1] = same[1:]
    out[:, 3 * k + 2] = 1.0
    return out


@dataclass
class Model:
    """Weights of the field: features for "good", transitions between the two labels."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    constant: float | None = None

    def potentials(self, own: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return with_neighbours((own - self.mean) / self.scale, owner) @ self.weights


def _log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(node: np.ndarray, owner: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """P(good) of every line by forward-backward over all chains at once; with ``pairs`` also the
    expected number of each move, per chain weight 1."""
    n = len(node)
    first = np.concatenate([[True], owner[1:] != owner[:-1]]) if n else np.empty(0, bool)
    at = np.flatnonzero(first)
    sizes = np.diff(np.append(at, n))
    order = np.argsort(-sizes, kind="stable")
    at, sizes = at[order], sizes[order]
    score = np.stack([np.zeros(n), node], axis=1)
    ahead, behind = np.empty((n, 2)), np.zeros((n, 2))
    longest = int(sizes[0]) if n else 0
    live = np.searchsorted(-sizes, -np.arange(longest), side="left")       # chains longer than t
    for t in range(longest):
        i = at[:live[t]] + t
        if t == 0:
            ahead[i] = score[i]
        else:
            p = ahead[i - 1]
            ahead[i] = score[i] + np.stack([_log_sum(p[:, 0] + moves[0, y], p[:, 1] + moves[1, y]) for y in (0, 1)], axis=1)
    for t in range(longest - 2, -1, -1):
        i = at[:live[t + 1]] + t
        q = behind[i + 1] + score[i + 1]
        behind[i] = np.stack([_log_sum(q[:, 0] + moves[y, 0], q[:, 1] + moves[y, 1]) for y in (0, 1)], axis=1)
    both = ahead + behind
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
    if not pairs:
        return good
    inner = np.flatnonzero(~first)
    whole = _log_sum(both[inner, 0], both[inner, 1])
    joint = ahead[inner - 1][:, :, None] + moves[None] + (behind[inner] + score[inner])[:, None, :]
    return good, np.exp(joint - whole[:, None, None]), inner


def fit(own: np.ndarray, owner: np.ndarray, good: np.ndarray) -> Model:
    """Fit to lines of labelled documents; ``good`` is the label of each line's document."""
    mean, scale = own.mean(axis=0), own.std(axis=0) + 1e-6
    x = with_neighbours((own - mean) / scale, owner)
    y = good.astype(np.float64)
    # Every document counts alike, however many lines it has.
    lines = np.bincount(owner)[owner].astype(np.float64)
    weight = 1 / np.sqrt(lines)
    weight /= weight.sum()
    params = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        w, moves = params[:-4], params[-4:].reshape(2, 2)
        p, joint, inner = marginals(x @ w, owner, moves, pairs=True)
        seen = np.zeros((len(inner), 2, 2))
        seen[np.arange(len(inner)), y[inner].astype(int), y[inner].astype(int)] = 1
        gain = np.concatenate([x.T @ ((y - p) * weight), ((seen - joint) * weight[inner, None, None]).sum(axis=0).ravel()])
        gain -= DECAY * params
        m, v = 0.9 * m + 0.1 * gain, 0.999 * v + 0.001 * gain * gain
        params = params + RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Model(mean, scale, params[:-4], params[-4:].reshape(2, 2))


def fold_of(id: Column) -> Column:
    return F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(FOLDS))


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
          documents: int = SAMPLE_DOCUMENTS, lines: int = SAMPLE_LINES) -> Model:
    """Fit on a bounded sample of the labelled documents outside fold 0."""
    usable = labels.select(F.col(f"`{id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")) \
        .where("id is not null and y in (0, 1)").where(fold_of(F.col("id")) != 0) \
        .groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")
    seen = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}    # two rows
    share = seen.get(1, 0) / sum(seen.values()) if seen else None
    part = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("long")
    chosen = usable.where(F.lit(False))
    for y, n in seen.items():
        chosen = chosen.unionByName(usable.where((F.col("y") == y) & (part < int(min(1.0, documents / n) * (1 << 32)))))
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")) \
        .join(F.broadcast(chosen), "id")

    def compute(column: pa.Array) -> list:
        own, owner, words = line_features(column)
        counts = np.bincount(owner, minlength=len(column))
        borders = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
        packed = own.astype("<f4")
        return [pa.array([packed[a:b].tobytes() if b - a <= lines else None
                          for a, b in zip(borders[:-1], borders[1:])], pa.binary())]

    # One row per sampled id, so that repeated rows don't widen the sample.
    sample = annotate(rows, "text", compute, "features binary", ["id", "y"]).where("features is not null") \
        .groupBy("id", "y").agg(F.max("features").alias("features")).orderBy("id").collect()
    own, owner, good = [], [], []
    for r in sample:
        if r["features"]:
            f = np.frombuffer(r["features"], "<f4").reshape(-1, N_OWN).astype(np.float64)
            own.append(f)
            owner.append(np.full(len(f), len(owner)))
            good.append(np.full(len(f), r["y"]))
    if not own or len({int(g[0]) for g in good}) < 2:
        constant = 0.5 if share is None else float(share)
        return Model(np.zeros(N_OWN), np.ones(N_OWN), np.zeros(3 * N_OWN + 3), np.zeros((2, 2)), constant)
    return fit(np.concatenate(own), np.concatenate(owner), np.concatenate(good))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score",
          keep: list[str] | None = None) -> DataFrame:
    """Add ``out``: the share of the text's words in good lines, by the field's marginals."""

    def compute(column: pa.Array) -> list:
        own, owner, words = line_features(column)
        p = np.full(len(owner), model.constant) if model.constant is not None else \
            marginals(model.potentials(own, owner), owner, model.moves)
        total = np.bincount(owner, weights=words, minlength=len(column))
        good = np.bincount(owner, weights=words * p, minlength=len(column))
        return [np.clip(good / np.maximum(total, 1), 0.0, 1.0)]

    return annotate(docs, text, compute, f"`{out}` double", keep)
