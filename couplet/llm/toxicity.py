"""Toxicity by a convolutional text classifier, with thresholds calibrated by language.

A word is embedded as the sum of hashed vectors: of the word itself and of its beginnings, so that inflected
and compound forms share what was learned. Filters of several widths run over the words, their responses are
pooled by the maximum over the text, and a logistic layer weighs the pooled responses. All is trained in numpy.

All labelled documents outside fold 0 are learned from, whatever their length. They are dealt by id over shards of bounded
size; each task fits its shards from the common network, and the common network moves to the mean of what they found, a word's
vector to the mean over the shards in which it moved. After ``ROUNDS`` such rounds, all labelled documents of one fold, kept back
until then, set thresholds, one for each language that function words of the text suggest; languages with few toxic
documents lean on the threshold of all. A score is the logistic of the distance
from the threshold, so 0.5 is the verdict in every language. Scoring covers every word of every text, in the tasks.

Nulls and edges: a null or empty text, and one without words, scores as a text of unknown words. Without labels of
both classes every text scores the share of toxic labels (0 without any). Very long texts are pooled block by block.
Rows without an id are scored and never learned from; repeated rows, and texts with the same words, get equal scores.
Of several texts of one id the greatest is learned, and the highest logit counts for the thresholds.
An empty table gives an empty result. Input columns named like the added one are replaced, others pass through.
"""

from __future__ import annotations

import copy
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from couplet.llm.line_crf import fold_of
from couplet.llm.texts import LOWER, Texts, annotate, slices
from couplet.operators.ranks import WINDOW_ROWS
from couplet.operators.shared import BROADCAST_BYTES, materialise, vector_sum

SHARD_DOCUMENTS, SHARD_BYTES = 4000, 1 << 25
LABEL_BYTES = 24                    # of a label that is broadcast
BUCKETS, SIZE = 1 << 17, 16         # hashed vectors and their length
STEMS = (4, 6, 8)                   # beginnings of a word, in bytes, that have a vector of their own
WIDTHS, FILTERS = (1, 2, 3), 8
EPOCHS, BATCH, RATE = 12, 32, 0.1
ROUNDS = 3                          # the epochs are spread over them
SPREAD_EPOCHS = 6                   # over several shards, where an epoch has more texts
HIDDEN = 0.4                        # share of words that a step does not see, so that no word speaks for the others
CALIBRATION_FOLD = 1
FALSE_ALARM = 2.0                   # cost of a clean text flagged, in toxic texts missed (both as shares of their class)
LEAN = 8                            # toxic samples a language needs for its own threshold to weigh half
BLOCK = 1 << 16                     # words convolved at a time

# Frequent function words that tell languages apart.
FUNCTION_WORDS = {
    "en": "the of and to is that it for was on with as by this are be at from or not",
    "de": "der die das und ist nicht ein eine zu mit von auf für sich auch als dem den bei nach",
    "fr": "le les des et est une dans pour pas sur qui au ce il par plus ne avec sont vous",
    "es": "el los las y es una por con del se lo como más pero sus al ha su para sobre",
}

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_PAD = max(WIDTHS) - 1


def words_of(column: pa.Array) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts, starts and ends of their words (runs of letters and digits), and the words per text."""
    texts = Texts(column)
    data = LOWER[texts.data]
    accented = np.zeros(len(data), bool)               # capitals of two-byte Latin letters
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    data[accented] += 32
    texts.data = data
    starts, ends = texts.spans(_INSIDE[data])
    return texts, starts, ends, np.diff(texts.per_text(starts))


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vector numbers of every word (one row each; ``BUCKETS`` where there is none), words per text, and the
    words that each language's list has in the text."""
    texts, starts, ends, counts = words_of(column)
    whole = texts.hashes(starts, ends)
    rows = np.full((len(starts), 1 + len(STEMS)), BUCKETS, np.int32)
    rows[:, 0] = (whole % np.uint64(BUCKETS)).astype(np.int32)
    for k, size in enumerate(STEMS, 1):
        long = ends - starts > size
        stem = texts.hashes(starts[long], starts[long] + size)
        rows[long, k] = ((stem + np.uint64(k)) % np.uint64(BUCKETS)).astype(np.int32)
    owner = np.repeat(np.arange(texts.n), counts)
    seen = np.stack([np.bincount(owner[np.isin(whole, list_)], minlength=texts.n) for list_ in _lists().values()], axis=1)
    return rows, counts, seen


_known: dict[str, np.ndarray] = {}


def _lists() -> dict[str, np.ndarray]:
    if not _known:
        for language, words in FUNCTION_WORDS.items():
            listed = Texts(pa.array([words]))
            _known[language] = listed.hashes(*listed.words())
    return _known


def language_of(seen: np.ndarray) -> np.ndarray:
    """The language with most function words; after the last one ("unknown") where none leads."""
    best = seen.argmax(axis=1) if len(seen) else np.empty(0, np.int64)
    top = np.sort(seen, axis=1)
    clear = top[:, -1] > top[:, -2] if len(seen) else np.empty(0, bool)
    return np.where(clear, best, seen.shape[1])


@dataclass
class Network:
    """Word vectors (the last row is empty), filters per width, and the logistic layer; ``limits`` per language."""

    vectors: np.ndarray
    filters: list[np.ndarray]
    shifts: list[np.ndarray]
    weights: np.ndarray
    bias: float
    limits: np.ndarray = field(default_factory=lambda: np.zeros(len(FUNCTION_WORDS) + 1))
    constant: float | None = None

    def pooled(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Largest response of every filter per text."""
        place, owner, valid = _padded(rows, counts)
        out = np.full((len(counts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        for start in range(0, len(place), BLOCK):
            inside = slice(start, start + BLOCK)
            x = self.embedded(place[start:start + BLOCK + _PAD])
            mine = owner[inside]
            edge = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            here = mine[edge]
            for w, response in enumerate(self._responses(x, len(mine))):
                response[~valid[inside]] = -np.inf
                part = slice(w * FILTERS, (w + 1) * FILTERS)
                out[here, part] = np.maximum(out[here, part], np.maximum.reduceat(response, edge, axis=0))
        return out

    def embedded(self, place: np.ndarray) -> np.ndarray:
        x = self.vectors[place[:, 0]]
        for k in range(1, place.shape[1]):
            known = np.flatnonzero(place[:, k] < BUCKETS)
            x[known] += self.vectors[place[known, k]]
        return x

    def _responses(self, x: np.ndarray, n: int):
        """Filter responses at ``n`` places; ``x`` goes on beyond them, or ends with them."""
        if len(x) < n + _PAD:
            x = np.concatenate([x, np.zeros((n + _PAD - len(x), SIZE), x.dtype)])
        for kernel, shift in zip(self.filters, self.shifts):
            yield sum(x[k:n + k] @ kernel[k] for k in range(len(kernel))) + shift

    def logits(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.pooled(rows, counts) @ self.weights + self.bias


def _padded(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vector numbers with empty places after each text, the text of each place, and whether a word stands there."""
    sizes = np.maximum(counts, 1) + _PAD
    start = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(counts)), sizes)
    place = np.full((len(owner), rows.shape[1]), BUCKETS, np.int32)
    at = np.repeat(start - (np.cumsum(counts) - counts), counts) + np.arange(len(rows))
    place[at] = rows
    valid = np.zeros(len(owner), bool)
    valid[at] = True
    valid[start[counts == 0]] = True                   # a text without words has one empty place
    return place, owner, valid


@dataclass
class Fit:
    """A network under training with Adagrad's sums of squares; ``moved`` marks the vectors that changed since it was dealt."""

    net: Network
    spread: np.ndarray
    sums: list[np.ndarray]
    moved: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 7) -> Fit:
        rng = np.random.default_rng(seed)
        net = Network(rng.normal(0, 0.05, (BUCKETS + 1, SIZE)).astype(np.float32),
                      [rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS],
                      [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                      np.abs(rng.normal(0, 0.3, len(WIDTHS) * FILTERS)).astype(np.float32), 0.0)
        net.vectors[BUCKETS] = 0
        fit = cls(net, np.full(BUCKETS + 1, 1e-3, np.float32), [], np.zeros(BUCKETS + 1, bool))
        fit.sums = [np.full_like(a, 1e-3) for a in fit.dense()]
        return fit

    def dense(self) -> list[np.ndarray]:
        """Filters, shifts, weights and the bias."""
        return [*self.net.filters, *self.net.shifts, self.net.weights, np.array([self.net.bias], np.float32)]

    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """All that moved as rows of ``SIZE + 1`` values: vectors and their sums by bucket, the rest under negative numbers."""
        rest = np.concatenate([a.ravel() for a in (*self.dense(), *self.sums)])
        rest = np.pad(rest, (0, -len(rest) % (SIZE + 1))).reshape(-1, SIZE + 1)
        at = np.flatnonzero(self.moved)
        return np.concatenate([at, -1 - np.arange(len(rest))]), \
            np.concatenate([np.column_stack([self.net.vectors[at], self.spread[at]]), rest])

    def take(self, slots: np.ndarray, values: np.ndarray) -> None:
        """Set what ``slots`` of other fits, or means of them, hold."""
        words = slots >= 0
        self.net.vectors[slots[words]] = values[words, :SIZE]
        self.spread[slots[words]] = values[words, SIZE]
        self.moved[slots[words]] = True
        rest = values[~words][np.argsort(-slots[~words])].ravel().astype(np.float32)
        out, at = [], 0
        for a in (*self.dense(), *self.sums):
            out.append(rest[at:at + a.size].reshape(a.shape).copy())
            at += a.size
        n = len(WIDTHS)
        self.net.filters, self.net.shifts, self.net.weights, self.net.bias = out[:n], out[n:2 * n], out[2 * n], float(out[2 * n + 1][0])
        self.sums = out[2 * n + 2:]

    def finished(self) -> Network:
        self.net.vectors[~self.moved] = 0            # words that never mattered are neutral
        return self.net


def peaks(net: Network, place: np.ndarray, owner: np.ndarray, valid: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and value of every filter's largest response per text, ``BLOCK`` places at a time."""
    peak = np.zeros((n, len(net.weights)), np.int64)
    top = np.full(peak.shape, -np.inf, np.float32)
    for start in range(0, len(place), BLOCK):
        inside = slice(start, start + BLOCK)
        mine = owner[inside]
        x = net.embedded(place[start:start + BLOCK + _PAD])
        edges = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1], [True]]))
        for w, response in enumerate(net._responses(x, len(mine))):
            response[~valid[inside]] = -np.inf
            part = slice(w * FILTERS, (w + 1) * FILTERS)
            for low, high in zip(edges[:-1], edges[1:]):
                best = response[low:high].argmax(axis=0)
                value = response[low + best, np.arange(FILTERS)]
                d, better = mine[low], value > top[mine[low], part]
                peak[d, part] = np.where(better, start + low + best, peak[d, part])
                top[d, part] = np.where(better, value, top[d, part])
    return peak, top


def passes(fit: Fit, texts: list[tuple[np.ndarray, int]], epochs: int, rng: np.random.Generator) -> None:
    """Go over ``(vector numbers of the words, label)`` per text ``epochs`` times, by Adagrad on small batches.

    Only the word where a filter responds most gets a gradient, so a step touches few vectors. Weights of the
    logistic layer stay at 0 or above: a response can only add to toxicity, so harmless passages that recur
    can't be learned as a proof against it.
    """
    net, n = fit.net, len(WIDTHS)
    kernel_sums, shift_sums, weight_sums, bias_sum = fit.sums[:n], fit.sums[n:2 * n], fit.sums[2 * n], fit.sums[2 * n + 1]
    y = np.array([label for _, label in texts], np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for b in range(0, len(order), BATCH):
            group = order[b:b + BATCH]
            rows = np.concatenate([texts[i][0] for i in group])
            counts = np.array([len(texts[i][0]) for i in group])
            place, owner, valid = _padded(rows, counts)
            place[rng.random(len(place), np.float32) < HIDDEN] = BUCKETS
            peak, top = peaks(net, place, owner, valid, len(group))
            off = (1 / (1 + np.exp(-(top @ net.weights + net.bias))) - y[group]) / len(group)
            back = off[:, None] * net.weights[None, :]
            step = top.T @ off + 1e-5 * net.weights
            ids, grads = [], []
            for w, kernel in enumerate(net.filters):
                part = slice(w * FILTERS, (w + 1) * FILTERS)
                at, g = peak[:, part], back[:, part]
                grad_kernel = np.empty_like(kernel)
                for k in range(len(kernel)):
                    here = place[(at + k).ravel()]
                    grad_kernel[k] = np.einsum("dfs,df->sf", net.embedded(here).reshape(*at.shape, SIZE), g)
                    ids.append(here)
                    grads.append((kernel[k].T[None] * g[:, :, None]).reshape(-1, SIZE))
                kernel_sums[w] += grad_kernel ** 2
                kernel -= RATE * grad_kernel / np.sqrt(kernel_sums[w])
                grad_shift = g.sum(axis=0)
                shift_sums[w] += grad_shift ** 2
                net.shifts[w] -= RATE * grad_shift / np.sqrt(shift_sums[w])
            weight_sums += step ** 2
            net.weights = np.maximum(net.weights - RATE * step / np.sqrt(weight_sums), 0)
            bias_sum += off.sum() ** 2
            net.bias -= float(RATE * off.sum() / np.sqrt(bias_sum[0]))
            ids, grads = np.concatenate(ids), np.concatenate(grads)
            mine = (ids < BUCKETS) & (np.abs(grads).sum(axis=1) > 0)[:, None]
            unique, inverse = np.unique(ids[mine], return_inverse=True)
            grad = np.zeros((len(unique), SIZE), np.float32)
            np.add.at(grad, inverse, np.repeat(grads, mine.sum(axis=1), axis=0))
            fit.spread[unique] += (grad ** 2).mean(axis=1)
            net.vectors[unique] -= RATE * grad / np.sqrt(fit.spread[unique])[:, None]
            fit.moved[unique] = True


def train(texts: list[tuple[np.ndarray, int]], seed: int = 7) -> Network:
    """A network fitted to the texts of one shard alone."""
    fit = Fit.fresh(seed)
    passes(fit, texts, EPOCHS, np.random.default_rng([seed, 1]))
    return fit.finished()


def _shard_fit(common: Fit, epochs: int, key: tuple[int, ...]):
    """The function that goes over one shard's rows from the common network and returns what moved."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("text", "ascending")]).combine_chunks()
        texts = []
        ids = table.column("id").to_pylist()
        at = 0
        for batch in table.to_batches():
            for part in slices(batch, "text"):
                rows, counts, _ = features(part.column("text"))
                borders = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
                for i, y in enumerate(part.column("y").to_pylist()):
                    if at + 1 == len(ids) or ids[at + 1] != ids[at]:
                        texts.append((rows[borders[i]:borders[i + 1]], y))
                    at += 1
        mine = copy.deepcopy(common)
        mine.moved[:] = False
        passes(mine, texts, epochs, np.random.default_rng([*key, table.column("shard")[0].as_py()]))
        slots, values = mine.slots()
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, SIZE + 1, dtype=np.int32)),
                                           pa.array(values.astype(np.float32).ravel()))
        return pa.table({"slot": pa.array(slots.astype(np.int32)), "held": vectors})

    return run


def train_shards(labelled: DataFrame, shards: int, seed: int = 7) -> Network:
    """Fit to all rows of ``id, y, text``: shards side by side, their networks averaged after each round."""
    fit = Fit.fresh(seed)
    tasks = 4 * min(shards, labelled.sparkSession.sparkContext.defaultParallelism)       # what a task's shards find is added up there
    dealt = labelled.select("id", "y", "text", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")) \
        .repartition(tasks, "shard")
    whole = EPOCHS if shards == 1 else SPREAD_EPOCHS
    for step in range(ROUNDS):
        epochs = whole * (step + 1) // ROUNDS - whole * step // ROUNDS

        found = dealt.groupBy("shard").applyInArrow(_shard_fit(fit, epochs, (seed, 1 + step)), "slot int, held array<float>")
        mean = vector_sum(found, ["slot"], {"held": F.col("held")}, SIZE + 1, extra=[F.count(F.lit(1)).alias("n")]).toArrow()
        sums = mean.column("held").combine_chunks().flatten().to_numpy().reshape(-1, SIZE + 1)
        fit.take(mean.column("slot").to_numpy(), sums / mean.column("n").to_numpy()[:, None])
    return fit.finished()


def cuts(scored: DataFrame) -> dict[int, tuple[float, int, int]]:
    """Per language, and under -1 for all, the logit that parts the classes at least cost, in the middle of the best gap, with
    the numbers of toxic and of clean rows. Exact for any number of rows of ``language, y, logit``."""
    both = scored.select("language", "y", "logit").unionByName(scored.select(F.lit(-1).alias("language"), "y", "logit"))
    hist = materialise(both.groupBy("language", "logit").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean")))
    ranges = -(-hist.count() // WINDOW_ROWS)
    if ranges > 1:
        inner = sorted(set(hist.approxQuantile("logit", [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
        hist = Bucketizer(splits=[float("-inf"), *inner, float("inf")], inputCol="logit", outputCol="range").transform(hist) \
            .withColumn("range", F.col("range").cast("int"))
    else:
        hist = hist.withColumn("range", F.lit(0))
    totals = sorted(map(tuple, hist.groupBy("language", "range").agg(           # languages x ranges
        F.sum("toxic"), F.sum("clean"), F.min("logit")).collect()))
    whole: dict[int, list] = {}
    for language, _, toxic, clean, low in totals:
        seen = whole.setdefault(language, [0, 0, low])
        seen[0], seen[1] = seen[0] + toxic, seen[1] + clean
    starts, before = [], {language: [0, 0] for language in whole}
    for i, (language, part, toxic, clean, _) in enumerate(totals):
        above = totals[i + 1][4] if i + 1 < len(totals) and totals[i + 1][0] == language else None
        starts.append((language, part, *before[language], *whole[language][:2], above))
        before[language] = [before[language][0] + toxic, before[language][1] + clean]
    if not starts:
        return {}
    lower = hist.sparkSession.createDataFrame(
        starts, "language int, range int, toxic_below long, clean_below long, toxics long, cleans long, above double")
    w = Window.partitionBy("language", "range").orderBy("logit")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = hist.join(F.broadcast(lower), ["language", "range"])
    missed = (F.sum("toxic").over(upto) + F.col("toxic_below")) / F.greatest(F.lit(1), "toxics")
    alarms = 1 - (F.sum("clean").over(upto) + F.col("clean_below")) / F.greatest(F.lit(1), "cleans")
    gap = rows.select("language", F.struct((missed + FALSE_ALARM * alarms).alias("cost"), F.col("logit").alias("low"), F.coalesce(
        F.lead("logit").over(w), "above", F.col("logit") + 1).alias("high")).alias("gap"))
    out = {}
    for language, best in gap.groupBy("language").agg(F.min("gap")).collect():
        toxic, clean, low = whole[language]
        limit = (best["low"] + best["high"]) / 2 if best["cost"] < FALSE_ALARM else low - 0.5
        out[language] = (limit, toxic, clean)
    return out


def calibrate(net: Network, scored: DataFrame) -> None:
    """Set the network's limit of every language from all rows of ``language, y, logit``."""
    found = cuts(scored)
    if -1 not in found or not all(found[-1][1:]):
        return
    whole = found[-1][0]
    for k in range(len(net.limits)):
        own, toxic, clean = found.get(k, (whole, 0, 0))
        net.limits[k] = (toxic * (own if clean else whole) + LEAN * whole) / (toxic + LEAN)


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
          shard_documents: int = SHARD_DOCUMENTS) -> Network:
    """Fit and calibrate on all labelled documents outside fold 0."""
    usable = labels.select(F.col(f"`{id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")) \
        .where("id is not null and y in (0, 1)").where(fold_of(F.col("id")) != 0) \
        .groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")
    usable = materialise(usable)
    seen = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}    # two rows
    few = sum(seen.values()) * LABEL_BYTES <= BROADCAST_BYTES
    labelled = materialise(docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
                           .join(F.broadcast(usable) if few else usable, "id")
                           .select("id", "y", "text", (fold_of(F.col("id")) == CALIBRATION_FOLD).alias("kept_back")))
    held = {(r["kept_back"], r["y"]): r for r in labelled.groupBy("kept_back", "y").agg(          # four rows
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()}
    if len({y for _, y in held}) < 2:
        share = seen.get(1, 0) / sum(seen.values()) if seen else 0.0
        empty = np.zeros((BUCKETS + 1, SIZE), np.float32)
        return Network(empty, [], [], np.empty(0, np.float32), 0.0, constant=share)
    apart = {(False, 0), (False, 1)} <= held.keys()              # else there is too little to keep a fold back
    own = labelled.where(~F.col("kept_back")) if apart else labelled
    sizes = [r for (kept_back, _), r in held.items() if not (apart and kept_back)]
    shards = max(math.ceil(sum(r["n"] for r in sizes) / shard_documents), math.ceil(sum(r["bytes"] for r in sizes) / SHARD_BYTES))
    net = train_shards(own, shards)
    ruled = labelled.where("kept_back") if apart and {(True, 0), (True, 1)} <= held.keys() else own

    def compute(column: pa.Array) -> list:
        rows, counts, words = features(column)
        return [net.logits(rows, counts).astype(np.float64), language_of(words).astype(np.int32)]

    scored = annotate(ruled, "text", compute, "logit double, language int", ["id", "y"])
    calibrate(net, scored.groupBy("id", "y").agg(F.max_by("language", "logit").alias("language"), F.max("logit").alias("logit")))
    return net


def score(docs: DataFrame, net: Network, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add ``out``, the probability-like score of toxicity of the whole text; 0.5 or more is the verdict."""

    def compute(column: pa.Array) -> list:
        if net.constant is not None:
            return [np.full(len(column), net.constant)]
        rows, counts, words = features(column)
        away = net.logits(rows, counts).astype(np.float64) - net.limits[language_of(words)]
        return [1 / (1 + np.exp(-np.clip(away, -500, 500)))]

    return annotate(docs, text, compute, f"`{out}` double", keep)
