"""Near-duplicate documents by banded MinHash, odd sketches and an exact check.

A document is its set of distinct word shingles. MinHash samples of the set are cut into bands;
documents that share a band are candidates. The samples are also folded into a parity bitmap (odd
sketch): the population count of the XOR of two bitmaps tells how many samples differ, and hence the
similarity. Candidates whose sketches rule out the threshold by five standard deviations are
dropped, one by one or block against block; all others are confirmed on the full sets.

Equal sets collapse to one representative first. Within a band every member is compared with three
members that aggregates choose (smallest and largest id, smallest id hash); what these links connect
needs no further comparison. Only members that stay outside the component of their band's smallest
id meet the rest of the band, so a large group of near copies costs rows, not pairs, and no link
between components is lost.

Nulls and edges: a null text, or one without words, has an empty set and links with nothing. Fewer
words than a shingle form one shingle. Rows with a null id link with nothing and have a null
component. Rows that repeat an id must repeat its text; they are one document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from couplet.llm.components import components
from couplet.llm.texts import Texts, annotate, as_signed, mix, windows
from couplet.operators.shared import lookup_join, materialise

BANDS, ROWS = 25, 5                 # a pair at similarity 0.8 shares a band with probability 0.99995
SAMPLES = 128                       # MinHash samples of the sketch; the first BANDS * ROWS form bands
SKETCH_BITS = 512
SKETCH_WORDS = SKETCH_BITS // 64
SIGMAS = 5
# Blocks of documents in exact comparisons: bounds on their shingles and their number.
BLOCK_SHINGLES, BLOCK_DOCUMENTS = 200_000, 1000

_rng = np.random.Generator(np.random.PCG64(20))
_MULTIPLY = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a batch of texts and the borders of each text; repeats are left in."""
    texts = Texts(column, lower=True)
    starts, ends = texts.words()
    borders = texts.per_text(starts)
    h = texts.hashes(starts, ends)
    count = np.diff(borders)
    long = windows(h, width)
    n_out = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    out_borders = np.concatenate([np.zeros(1, np.int64), np.cumsum(n_out)])
    out = np.empty(out_borders[-1], np.uint64)
    owner = np.repeat(np.arange(texts.n), n_out)
    at = borders[owner] + np.arange(len(out)) - out_borders[owner]
    full = count[owner] >= width
    out[full] = long[at[full]]
    for d in np.flatnonzero((count > 0) & (count < width)):
        out[out_borders[d]] = windows(h[borders[d]:borders[d + 1]], int(count[d]))[0] + np.uint64(count[d])
    return out, out_borders


def distinct_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    h, borders = shingles(column, width)
    return [np.unique(h[a:b]) for a, b in zip(borders[:-1], borders[1:])]


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter((len(s) for s in sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), sizes


def signature_columns(width: int):
    def compute(column: pa.Array) -> list:
        h, sizes = _flat(distinct_sets(column, width))
        full = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[full]
        least = np.zeros((len(full), SAMPLES), np.uint64)
        total, parity = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
        if len(full):
            for k in range(SAMPLES):
                least[:, k] = np.minimum.reduceat(h * _MULTIPLY[k] + _ADD[k], starts)
            total[full] = np.add.reduceat(mix(h), starts)
            parity[full] = np.bitwise_xor.reduceat(h, starts)
        ranks = np.arange(SAMPLES, dtype=np.uint64)
        mixed = mix(least + ranks * np.uint64(0x9E3779B97F4A7C15))
        band = np.zeros((len(full), BANDS), np.uint64)
        for r in range(ROWS):
            band = band * np.uint64(0x9FB21C651E98DF25) + mixed[:, r * BANDS:(r + 1) * BANDS]
        keys = np.zeros((len(sizes), BANDS), np.int64)
        keys[full] = as_signed(mix(band + ranks[:BANDS]))
        cell = np.arange(len(full))[:, None] * SKETCH_BITS + (mixed % np.uint64(SKETCH_BITS)).astype(np.int64)
        odd = np.bincount(cell.ravel(), minlength=len(full) * SKETCH_BITS) & 1
        sketch = np.zeros((len(sizes), SKETCH_WORDS), np.int64)
        sketch[full] = np.packbits(odd.astype(np.uint8).reshape(len(full), SKETCH_BITS), axis=1).view(np.int64)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)),
                                         pa.array(keys.ravel()))
        return [sizes, as_signed(total), as_signed(parity), bands, *[sketch[:, i].copy() for i in range(SKETCH_WORDS)]]

    return compute


_SIGNATURE = "n_shingles long, __sum long, __xor long, __bands array<long>, " + ", ".join(
    f"__s{i} long" for i in range(SKETCH_WORDS))


def set_column(width: int):
    def compute(column: pa.Array) -> list:
        h, sizes = _flat(distinct_sets(column, width))
        return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                                         pa.array(as_signed(h)))]

    return compute


def sketch_similarity(left: str, right: str) -> Column:
    """Similarity estimated from two odd sketches, given as prefixes of their columns."""
    differing = sum((F.bit_count(F.col(f"{left}.__s{i}").bitwiseXOR(F.col(f"{right}.__s{i}")))
                     for i in range(SKETCH_WORDS)), F.lit(0))
    odd = F.greatest(F.lit(1.0) - differing * (2.0 / SKETCH_BITS), F.lit(1.0 / SKETCH_BITS))
    return F.lit(1.0) + F.log(odd) * (SKETCH_BITS / (4.0 * SAMPLES))


def sketch_floor(threshold: float) -> float:
    """Estimates below this rule the threshold out: sampling and folding noise of SIGMAS deviations."""
    differing = SAMPLES * (1 - threshold)
    sampling = math.sqrt(SAMPLES * threshold * (1 - threshold)) / SAMPLES
    load = 2 * 2 * differing / SKETCH_BITS
    folding = math.sqrt(max(SKETCH_BITS * (1 - math.exp(-2 * load)) / 4, 0)) * 2 / SKETCH_BITS \
        * SKETCH_BITS / (4 * SAMPLES) / math.exp(-load)
    return threshold - SIGMAS * math.hypot(sampling, folding)


def similar_links(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets reach the threshold; sketches drop hopeless pairs first."""
    p = pairs.join(sketches.select(F.col("id").alias("a"), F.struct("n", *_SKETCH).alias("l")), "a") \
        .join(sketches.select(F.col("id").alias("b"), F.struct("n", *_SKETCH).alias("r")), "b")
    small, large = F.least("l.n", "r.n"), F.greatest("l.n", "r.n")
    hopeful = materialise(p.where((100 * small >= percent * large)
                                  & (sketch_similarity("l", "r") >= sketch_floor(percent / 100))).select("a", "b"))
    full = hopeful.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a") \
        .join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return full.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


_SKETCH = [f"__s{i}" for i in range(SKETCH_WORDS)]


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, parts, sizes, and whether a row stands outside its band's main component."""
    return tuple(table.column(c).to_numpy() for c in ("id", "part", "n", "outside"))


def _may_reach(size_l: np.ndarray, size_r: np.ndarray, sketch_l: np.ndarray, sketch_r: np.ndarray, percent: int) -> np.ndarray:
    """Pairs whose sizes and sketches leave the threshold possible."""
    small, large = np.minimum(size_l[:, None], size_r[None, :]), np.maximum(size_l[:, None], size_r[None, :])
    hopeful = 100 * small >= percent * large
    differing = np.zeros(hopeful.shape, np.int32)
    for word in range(SKETCH_WORDS):
        differing += np.bitwise_count(sketch_l[:, word, None] ^ sketch_r[None, :, word])
    odd = np.maximum(1.0 - differing * (2.0 / SKETCH_BITS), 1.0 / SKETCH_BITS)
    return hopeful & (1.0 + np.log(odd) * (SKETCH_BITS / (4.0 * SAMPLES)) >= sketch_floor(percent / 100))


def cross_links(placed: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between band members outside their band's main component and all others of the band.

    Both sides are dealt into blocks of bounded size. A task first holds the sketches of one block against
    those of another and names the members that may have a link there, leaving a pair to the first of the bands that it
    shares; only their sets travel, and a second task per pair of blocks counts common shingles by a matrix
    product. So pairs never become rows. Of the links of a document with one component the first is enough.
    """
    apart = F.col("part") != F.col("main")
    blocks_of = lambda inside: F.ceil(F.greatest(                                      # noqa: E731
        F.sum(F.when(inside, F.col("n"))) / BLOCK_SHINGLES, F.count(F.when(inside, 1)) / BLOCK_DOCUMENTS))
    busy = placed.groupBy("key").agg(blocks_of(F.lit(True)).alias("all_blocks"), blocks_of(apart).alias("apart_blocks")) \
        .where("apart_blocks > 0")
    rows = placed.join(busy, "key").join(sketches.select("id", "__bands", *_SKETCH), "id")
    dealt = lambda blocks: F.pmod(F.xxhash64("id"), F.col(blocks))                     # noqa: E731
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    carried = ["key", "id", "n", "part", "__bands", *_SKETCH]
    left = rows.where(apart).select(*carried, dealt("apart_blocks").alias("i"), every("all_blocks").alias("j"),
                                    F.lit(True).alias("outside"))
    right = rows.select(*carried, every("apart_blocks").alias("i"), dealt("all_blocks").alias("j"),
                        F.lit(False).alias("outside"))

    def screen(table: pa.Table) -> pa.Table:
        ids, part, sizes, outside = _sides(table)
        bits = np.stack([table.column(c).to_numpy() for c in _SKETCH], axis=1).view(np.uint64)
        bands = table.column("__bands").combine_chunks().flatten().to_numpy().reshape(len(ids), BANDS)
        earlier = int((bands[0] == table.column("key")[0].as_py()).argmax())        # bands before this one
        lefts, rights = np.flatnonzero(outside), np.flatnonzero(~outside)
        wanted = np.zeros(len(ids), bool)
        for start in range(0, len(lefts), 256):
            some = lefts[start:start + 256]
            hopeful = _may_reach(sizes[some], sizes[rights], bits[some], bits[rights], percent) \
                & (part[some][:, None] != part[rights][None, :])
            x, y = np.nonzero(hopeful)
            fresh = np.ones(len(x), bool)
            for band in range(earlier):
                fresh &= bands[some[x], band] != bands[rights[y], band]
            wanted[some[x[fresh]]] = True
            wanted[rights[y[fresh]]] = True
        return table.select(["key", "i", "j", "id", "n", "part", "outside"]).filter(pa.array(wanted))

    hopeful = materialise(left.unionByName(right).groupBy("key", "i", "j").applyInArrow(
        screen, "key long, i long, j long, id long, n long, part long, outside boolean"))

    def compare(table: pa.Table) -> pa.Table:
        ids, part, sizes, outside = _sides(table)
        lists = table.column("set").combine_chunks()
        owner, flat = np.repeat(np.arange(len(ids)), sizes), lists.flatten().to_numpy()
        rank = np.where(outside, np.cumsum(outside) - 1, np.cumsum(~outside) - 1)
        mine, theirs = outside[owner], ~outside[owner]
        shared = np.intersect1d(flat[mine], flat[theirs])
        n_left, n_right = int(outside.sum()), int((~outside).sum())
        common = np.zeros((n_left, n_right), np.float32)
        at = np.searchsorted(shared, flat)
        at[at == len(shared)] = 0
        known = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        width = max(1, (1 << 21) // max(1, n_left + n_right))
        for start in range(0, len(shared), width):
            here = known & (at >= start) & (at < start + width)
            sides = []
            for side, n in ((mine, n_left), (theirs, n_right)):
                marks = np.zeros((n, width), np.float32)
                marks[rank[owner[here & side]], at[here & side] - start] = 1
                sides.append(marks)
            common += sides[0] @ sides[1].T
        size_l, size_r = sizes[outside], sizes[~outside]
        part_l, part_r = part[outside], part[~outside]
        enough = 100 * common.astype(np.int64) >= percent * (size_l[:, None] + size_r[None, :] - common.astype(np.int64))
        x, y = np.nonzero(enough & (part_l[:, None] != part_r[None, :]))
        _, first = np.unique(np.stack([x, part_r[y]]), axis=1, return_index=True)
        a, b = ids[outside][x[first]], ids[~outside][y[first]]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return hopeful.join(sets, "id").groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5,
                    percent: int = 80) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` per row of ``docs``.

    ``component_id`` is the smallest id that links reach, where a link is a similarity of at least
    ``percent`` hundredths.
    """
    plain = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    signed = annotate(plain, "text", signature_columns(width), _SIGNATURE, ["id"])
    linked = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
    signed = materialise(signed)
    # Equal sets are one class; its smallest id stands for it. Only sets that occur again are looked up, so neither
    # signatures nor texts are shuffled, and rows that repeat an id are found among them.
    content = ["__sum", "__xor", "n_shingles"]
    classes = materialise(signed.where(linked).groupBy(*content).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("__rows"))
                          .where("__rows > 1"))
    tagged = lookup_join(signed.where(linked), classes, content, "__rows", row_bytes=96, keep_unmatched=True)
    members = materialise(tagged.select("id", "n_shingles", F.coalesce("rep", "id").alias("rep")))
    shown = ["id", F.col("n_shingles").alias("n"), "__bands", *_SKETCH]
    reps = materialise(tagged.where("rep is null").select(*shown, F.lit(False).alias("__again")).unionByName(
        tagged.where("id = rep").select(*shown, F.lit(True).alias("__again")).dropDuplicates(["id"])))
    keyed = reps.select("id", "n", "__again", F.explode("__bands").alias("key"))
    shared = materialise(keyed.groupBy("key").agg(
        F.min("id").alias("lo"), F.max("id").alias("hi"),
        F.min(F.struct(F.xxhash64("id").alias("h"), "id"))["id"].alias("some"), F.count(F.lit(1)).alias("__rows"))
        .where("__rows > 1"))
    crowd = materialise(lookup_join(keyed, shared, ["key"], "__rows", row_bytes=64).drop("__rows"))

    wanted = materialise(crowd.groupBy("id", "__again").agg(F.count(F.lit(1)).alias("__rows")))
    sets = materialise(annotate(lookup_join(plain.where("id is not null"), wanted, ["id"], "__rows", row_bytes=32), "text",
                                set_column(width), "set array<long>", ["id", "__again"]))
    sets = sets.where(~F.col("__again")).drop("__again").unionByName(
        sets.where("__again").drop("__again").dropDuplicates(["id"]))
    sketches = materialise(lookup_join(reps.drop("__again"), wanted.drop("__again"), ["id"], "__rows", row_bytes=32).drop("__rows"))
    chosen = crowd.select("id", F.explode(F.array("lo", "hi", "some")).alias("other")).where("id != other") \
        .select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    links = materialise(similar_links(chosen, sketches, sets, percent))
    first = components(links)

    # Band members outside the component of the band's smallest id meet the others of the band.
    at = crowd.drop("__again").join(first.withColumnRenamed("node", "id"), "id", "left") \
        .join(first.select(F.col("node").alias("lo"), F.col("component").alias("main")), "lo", "left")
    placed = materialise(at.select("key", "id", "n", F.coalesce("component", "id").alias("part"),
                                   F.coalesce("main", "lo").alias("main")))
    more = materialise(cross_links(placed, sketches, sets, percent))
    final = components(links.unionByName(more)) if more.limit(1).count() else first

    found = members.join(final.withColumnRenamed("node", "rep"), "rep", "left") \
        .select("id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = signed.where(~linked | F.col("id").isNull()).select("id", "n_shingles", F.col("id").alias("component_id"))
    return found.unionByName(alone).select(F.col("id").alias(id), "n_shingles", "component_id",
                                           F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5,
                         percent: int = 80) -> DataFrame:
    """``docs`` with one document of each linked group, the one with the smallest id; rows and columns are passed on as
    they are, whatever the names. The ids that go are looked up, so texts are not shuffled to them."""
    verdicts = near_duplicates(docs, id, text, width, percent)
    gone = materialise(verdicts.where(~F.col("kept")).groupBy(F.col(f"`{id}`").alias("__id")).agg(F.count(F.lit(1)).alias("__rows")))
    packed = docs.select(F.col(f"`{id}`").alias("__id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    looked = lookup_join(packed, gone, ["__id"], "__rows", row_bytes=32, keep_unmatched=True)
    return looked.where("`__rows` is null").select("__row.*")
