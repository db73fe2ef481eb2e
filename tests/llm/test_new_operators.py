"""Hard negatives, cross-tokenizer alignment and toxicity on small fixtures, next to brute force."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from couplet.llm import cross_tokens, hard_negatives, queries, toxicity
from couplet.operators import shared
from couplet.operators.shared import materialise

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, id string, q int, score double"


def floored(v):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * x) for x in v]


def mined_plainly(rows, is_anchor, positives, negatives, low=30, high=90):
    known = {}
    for id, vector, label in rows:
        q = floored(vector)
        if id is not None and label is not None and q is not None:
            known[id] = min(known.get(id, (label, q)), (label, q))
    out = set()
    for a, (label, q) in known.items():
        if not is_anchor(a):
            continue
        scores = sorted((-sum(x * y for x, y in zip(q, w)), b, m == label) for b, (m, w) in known.items() if b != a and len(w) == len(q))
        for s, p, _ in [x for x in scores if x[2]][:positives]:
            window = [x for x in scores if not x[2] and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out |= {(a, p, k, b, -s, -t) for k, (t, b, _) in enumerate(window, 1)}
    return out


def vector_rows():
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0.2, 1, 6)], int(rng.integers(0, 3))) for i in range(400)]
    rows += [(400 + i, rows[7][1], i % 3) for i in range(40)]                       # ties
    rows += [(500, None, 1), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (502, [math.nan] * 6, 1), (503, [math.inf] * 6, 1),
             (504, rows[0][1], None), (None, rows[0][1], 1), (505, [0.0] * 6, 0), (506, [], 0), (510, [], 0), (507, [1.0, 2.0], 0),
             (508, [1.0, 2.0], 1), (520, [0.5, 1.0], 0), rows[10], rows[20], (20, rows[21][1], 2)]      # lengths, repeated ids
    return rows


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], VECTORS).repartition(5)
    want = mined_plainly(rows, lambda i: i % 10 == 0, 5, 10)
    got = hard_negatives.hard_negatives(df, F.col("id") % 10 == 0).collect()
    assert len(got) == len(want) > 500 and {tuple(r) for r in got} == want
    monkeypatch.setattr(hard_negatives, "CHUNK_ANCHORS", 15)                        # several passes, blocks of few rows
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 4)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)
    got = hard_negatives.hard_negatives(df, F.col("id") % 10 == 0).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_hard_negatives_of_large_components_and_empty_tables(spark):
    rows = [(i, [float((-1) ** i * (200_000 + i)), float(i * 1000), 0.5], i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = mined_plainly(rows, lambda i: i % 5 == 0, 3, 4, -200, 200)
    got = hard_negatives.hard_negatives(df, F.col("id") % 5 == 0, positives=3, negatives=4, low=-200, high=200).collect()
    assert {tuple(r) for r in got} == {w for w in want if w[4] >= 0}
    assert hard_negatives.hard_negatives(df.where("false"), F.col("id") % 5 == 0).count() == 0
    assert hard_negatives.hard_negatives(df, F.lit(False)).count() == 0


@pytest.fixture(scope="module")
def pair():
    return cross_tokens.TokenizerPair(queries.BYTE_VOCABULARY, queries.corpus_pipeline.PIECE_MODEL)


def aligned_plainly(pair, text):
    """Token ids of both sides, groups and links, from the byte range of every token."""
    if not pair._ready:
        pair._prepare()
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    sides = []
    for ids, spelling in ((a, pair.spell_a), (b, pair.spell_b)):
        words = [spelling.spell(np.array([i])).tobytes() for i in ids]
        if b"".join(words) != (" " + text).encode():
            return None
        ends = np.cumsum([len(w) for w in words]).tolist()
        sides.append([(i, e - len(w), e) for i, w, e in zip(ids, words, ends)])
    ends = sorted({e for _, _, e in sides[0]} & {e for _, _, e in sides[1]})
    groups, start = [], 0
    for e in ends:
        groups.append("|".join(",".join(str(i) for i, s, t in side if start <= s and t <= e) for side in sides))
        start = e
    links = [(i, j) for i, s, e in sides[0] for j, t, f in sides[1] if s < f and t < e]
    return len(a), len(b), len(groups), links, ";".join(groups)


TEXTS = [None, "", " ", "  two  spaces ", "plain words, and more words", "naïve café – “quotes” 日本語テキスト 🙂🙂", "a▁b", "</s> <|endoftext|> <s>",
         "\x00\x01 tab\there\n\nnew  line \r\n", "x" * 700, "word word word word", "plain words, and more words", "ünïcödé" * 30, "a b c d e f g" * 20]


def test_alignment_equals_brute_force(spark, pair, monkeypatch):
    rows = [(None if i == 3 else i, t, "clash", 1, "r") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "clash", 1, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, groups string, n_a int, row string")
    got = cross_tokens.align(docs, pair).collect()
    assert len(got) == len(rows) and set(docs.columns) <= set(cross_tokens.align(docs, pair).columns)
    for r in got:
        want = aligned_plainly(pair, r.text) if r.text else None
        if want is None:
            assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.pairs) == (0, 0, 0, 0, "", [])
            continue
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups) == (*want[:3], len(want[3]), want[4])
        assert dict(zip(r.pairs, r.pair_links)) == collections.Counter(a * pair.n_b + b for a, b in want[3])
    assert cross_tokens.align(docs.where("false"), pair).count() == 0


def test_long_texts_align_as_whole_ones(spark, pair, monkeypatch):
    text = " ".join(f"wörd{i % 97} and, {i}  double\nline" for i in range(400)) + " "
    whole = pair.align([text, None, text[:500]])
    monkeypatch.setattr(cross_tokens, "PART_CHARS", 100)
    monkeypatch.setattr(cross_tokens, "CACHE_WINDOWS", 5)
    monkeypatch.setattr(cross_tokens, "LONG_WINDOW", 4)
    again = pair.align([text, None, text[:500]])
    assert len(list(pair._parts(text))) > 20
    for x, y in zip(whole, again):
        assert (x.to_pylist() if hasattr(x, "to_pylist") else x.tolist()) == (y.to_pylist() if hasattr(y, "to_pylist") else y.tolist())


ODD_TEXTS = [t.replace("{}", sign) for sign in ("▁", "\xa0", "\x1c", "\u2028", "\u200b", "\t", "  ", "\r\n", "\u0301", "'ll", "</s>", "日本", "12")
             for t in ("a {} b", "a{} b", "a {}b", "{} a b", " a b {}", "{}{} {} a", "some words, {}a{} and some words, again ")]


def test_texts_cut_into_words_align_as_whole_ones(pair):
    for cuts in (True, False):                               # False: vocabularies with tokens over several words
        fresh = cross_tokens.TokenizerPair(queries.BYTE_VOCABULARY, queries.corpus_pipeline.PIECE_MODEL)
        fresh._prepare()
        assert fresh.cuts
        fresh.cuts = cuts
        fresh._ready = True
        for texts in (ODD_TEXTS, ODD_TEXTS[::-1]):           # the second time all words are known
            n_a, n_b, n_groups, n_links, groups, pairs, pair_links = fresh.align(texts)
            for i, text in enumerate(texts):
                n, m, k, links, said = aligned_plainly(pair, text) or (0, 0, 0, [], "")
                assert (n_a[i], n_b[i], n_groups[i], n_links[i], groups[i].as_py()) == (n, m, k, len(links), said), text
                assert dict(zip(pairs[i].as_py(), pair_links[i].as_py())) == collections.Counter(a * pair.n_b + b for a, b in links)
    assert cross_tokens._Spelling([b" a", b"b c"]).crosses and not cross_tokens._Spelling([b" a", b"b", b"\n  "]).crosses


def test_tokenizers_see_a_word_once(monkeypatch):
    fresh = cross_tokens.TokenizerPair(queries.BYTE_VOCABULARY, queries.corpus_pipeline.PIECE_MODEL)
    texts = [" ".join(f"word{(i * j) % 50}," for i in range(200)) for j in range(1, 30)]
    fresh.align(["warm"])
    seen = collections.Counter()

    class Counting:
        def __init__(self, own, side):
            self.own, self.side = own, side

        def encode(self, texts, **options):
            seen[self.side] += sum(map(len, texts))
            return self.own(texts, **options)

        encode_batch = encode_batch_fast = encode

    monkeypatch.setattr(fresh, "a", Counting(fresh.a.encode_batch, "a"))
    monkeypatch.setattr(fresh, "b", Counting(fresh.b.encode, "b"))
    fresh.align(texts)
    fresh.align(texts[::-1])
    assert 0 < max(seen.values()) <= 50 * len(" word49,")


@pytest.mark.parametrize("bound", [1 << 26, 100])            # counts broadcast, and shuffled with hot keys apart
def test_link_scores_equal_brute_force(spark, pair, monkeypatch, bound):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", bound)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    aligned = materialise(cross_tokens.align(docs, pair).withColumn("row", F.monotonically_increasing_id()))
    counts = materialise(cross_tokens.pair_counts(aligned, pair))
    scores = {r.row: r for r in cross_tokens.link_scores(aligned, counts, "row").collect()}
    links = {r.row: (aligned_plainly(pair, r.text) or (0, 0, 0, []))[3] if r.text else [] for r in aligned.collect()}
    count = collections.Counter(x for each in links.values() for x in each)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    for row, each in links.items():
        want = (sum(count[x] == best[x[1]] for x in each), sum(count[x] for x in each))
        assert ((scores[row].n_best, scores[row].count_sum) if row in scores else (0, 0)) == want


def test_cross_token_query_reports_every_document(spark):
    rows = queries.op12_cross_tokens(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all((r.n_a == 0) == (r.groups_sha256 == "") and r.n_best <= r.n_links <= r.count_sum for r in rows)


def toxic_corpus(spark, n=600):
    rng = np.random.default_rng(5)
    calm, bad = [f"word{i}" for i in range(300)], ["grumble", "snark", "fiend"]
    rows, marks = [], []
    for i in range(n):
        toxic = i % 4 == 0
        text = [str(w) for w in rng.choice(calm, int(rng.integers(5, 120)))] + ["the", "and", "of"]
        for at in rng.integers(0, len(text), 3 if toxic else 0):
            text.insert(int(at), str(rng.choice(bad)) + ("y" if i % 8 == 0 else ""))
        rows.append((i, " ".join(text), "keep"))
        marks.append((i, int(toxic)))
    extra = [(None, "grumble snark", "keep"), (9000, None, "keep"), (9001, "", "keep"), (9002, "!!! ...", "keep"), rows[1], rows[4],
             (9003, " ".join(calm) * 40 + " grumble snark fiend " + "calm " * 90_000, "keep"), (9004, "calm " * 90_000, "keep")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, score string")
    return materialise(docs), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_toxicity_on_held_out_documents(spark):
    docs, labels = toxic_corpus(spark)
    scored = toxicity.score(docs, toxicity.learn(docs, labels))
    assert scored.columns == docs.columns[:2] + ["score"] and scored.count() == docs.count()
    held = scored.join(labels, "doc_id").where(toxicity.fold_of(F.col("doc_id")) == 0).select("toxic", "score").collect()
    assert np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in held]) > 0.95
    by_id = collections.defaultdict(set)
    for r in scored.collect():
        assert 0 <= r.score <= 1
        by_id[r.doc_id].add(r.score)
    assert len(by_id[1]) == len(by_id[4]) == 1 and by_id[9000] == by_id[9001]
    assert min(by_id[9003]) >= 0.5 > max(by_id[9004])                 # one passage among 90,000 words


def test_toxicity_without_labels_of_both_classes(spark):
    docs, labels = toxic_corpus(spark, 20)
    assert {r.score for r in toxicity.score(docs, toxicity.learn(docs, labels.where("toxic = 0"))).collect()} == {0.0}
    assert {r.score for r in toxicity.score(docs, toxicity.learn(docs, labels.where("false"))).collect()} == {0.0}
    assert toxicity.score(docs.where("false"), toxicity.learn(docs.where("false"), labels)).count() == 0


def test_pooling_equals_plain_convolution():
    rng = np.random.default_rng(1)
    net = toxicity.train([(rng.integers(0, toxicity.BUCKETS, (n, 4)).astype(np.int32), n % 2) for n in range(2, 40)])
    counts = np.array([0, 1, 2, 9, 0, 30])
    rows = rng.integers(0, toxicity.BUCKETS + 1, (counts.sum(), 4)).astype(np.int32)
    got, at = net.pooled(rows, counts), 0
    for d, n in enumerate(counts):
        x = np.zeros((max(n, 1) + 2, toxicity.SIZE))
        x[:n] = net.vectors[rows[at:at + n]].sum(axis=1)
        at += n
        want = np.concatenate([np.max([sum(x[p + k] @ kernel[k] for k in range(len(kernel))) + shift for p in range(max(n, 1))], axis=0)
                               for kernel, shift in zip(net.filters, net.shifts)])
        assert np.allclose(got[d], want, atol=1e-4)


def test_pooling_does_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    net = toxicity.train([(rng.integers(0, toxicity.BUCKETS, (n, 4)).astype(np.int32), n % 2) for n in range(2, 20)])
    counts = np.array([50, 0, 3, 700])
    rows = rng.integers(0, toxicity.BUCKETS, (counts.sum(), 4)).astype(np.int32)
    whole = net.pooled(rows, counts)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert np.allclose(net.pooled(rows, counts), whole, atol=1e-5)


def test_toxicity_query_on_test_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op13_toxicity(spark, sf).collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert np.mean([p == t for p, t in held]) > 0.93


def test_toxicity_learns_from_every_labelled_document(spark):
    docs, labels = toxic_corpus(spark)
    late = [(20_000 + i, "word1 " * 4000 + f"zorgon{i % 3} the", "keep") for i in range(40)]      # beyond 16 KiB, and only there
    more = spark.createDataFrame(late, docs.schema)
    marks = spark.createDataFrame([(r[0], 1) for r in late], labels.schema)
    whole = materialise(docs.unionByName(more))
    net = toxicity.learn(whole, labels.unionByName(marks), shard_documents=100)       # several shards
    asked = spark.createDataFrame([(1, "word1 zorgon1 word1", "x"), (2, "word1 the word1", "x")], docs.schema)
    scores = {r.doc_id: r.score for r in toxicity.score(asked, net).collect()}
    assert scores[1] >= 0.5 > scores[2]


def test_toxicity_cuts_use_every_row(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 3)), int(y), float(np.round(rng.normal(y, 1), 2))) for y in rng.integers(0, 2, 3000)]
    scored = spark.createDataFrame(rows, "language int, y int, logit double")
    whole = toxicity.cuts(scored)
    monkeypatch.setattr(toxicity, "WINDOW_ROWS", 100)                # several ranges
    assert toxicity.cuts(scored) == whole
    for language, (limit, toxic, clean) in whole.items():
        mine = [(y, z) for k, y, z in rows if language in (-1, k)]
        assert (toxic, clean) == (sum(y for y, _ in mine), sum(1 - y for y, _ in mine))
        def cost(at):
            return sum(y and z < at for y, z in mine) / toxic + toxicity.FALSE_ALARM * sum(not y and z >= at for y, z in mine) / clean
        assert abs(cost(limit) - min(cost(z) for z in {z for _, z in mine} | {99.0})) < 1e-9
