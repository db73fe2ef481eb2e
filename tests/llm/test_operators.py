"""Operators on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from couplet.llm import (balanced_shards, host_rules, line_crf, mixing, near_vectors, odd_sketch, pieces, reply_trees,
                         url_lists, warc)
from couplet.llm.components import components
from couplet.operators.shared import materialise

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_words string, kept string"


def make_docs(spark):
    base = [" ".join(f"w{(i * 7 + k) % 90}" for k in range(60)) for i in range(4)]
    near = [b.replace(f"w{(i * 7 + 59) % 90}", "X") for i, b in enumerate(base)]
    texts = [None, "", " \n\t ", "one", "One", "a b c", *base, *near, base[0], base[0].upper(),
             "z " * 5000, "line\nline\nother line here\nline", "é|#" * 9, "x" * 100_000]
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", "clash", "clash")
            for i, t in enumerate(texts)]
    return materialise(spark.createDataFrame([*rows, (None, "no id", None, None, None, None), rows[6]], DOCS))


@pytest.fixture(scope="module")
def docs(spark):
    return make_docs(spark)


def shingle_sets(rows, width):
    out = {}
    for r in rows:
        if r.doc_id is None:
            continue
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        out[r.doc_id] = {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else \
            ({tuple(w)} if w else set())
    return out


def smallest_reachable(ids, linked):
    best = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(best[a], best[b])
            changed |= best[a] != m or best[b] != m
            best[a] = best[b] = m
    return best


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("width", [4, 5])
def test_odd_sketch_equals_brute_force(spark, docs, width):
    rows = docs.collect()
    sets = shingle_sets(rows, width)
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b]
              and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = smallest_reachable(sets, linked)
    got = odd_sketch.near_duplicates(docs, width=width).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], r.doc_id == want[r.doc_id])
    kept = odd_sketch.drop_near_duplicates(docs, width=width)
    assert kept.columns == docs.columns
    assert odd_sketch.near_duplicates(docs.where("false")).count() == 0


def test_odd_sketch_leftovers_meet_their_band(spark, monkeypatch):
    """Copies edited apart from each other: links that no chosen member shows are found in blocks."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(odd_sketch, "BLOCK_DOCUMENTS", 7)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(60):
        w = list(base)
        for at in rng.choice(120, int(rng.integers(0, 9)), replace=False):
            w[at] = f"e{rng.integers(4)}x{at}"
        texts.append((i, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    sets = shingle_sets(df.collect(), 4)
    linked = [(a, b) for a, b in itertools.combinations(sets, 2)
              if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in odd_sketch.near_duplicates(df, width=4).collect()}
    assert got == smallest_reachable(sets, linked)


def test_host_rules_equal_brute_force(spark, docs):
    got = host_rules.host_rules(docs, keep=["doc_id", "text"]).collect()
    assert len(got) == docs.count()
    for r in got:
        t = r.text or ""
        w = WORD.findall(t)
        at = {}
        for i in range(len(w) - 7):
            at.setdefault(tuple(w[i:i + 8]), []).append(i)
        covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert r.kept == (not r.base_failed and not r.host_rejected)
    assert host_rules.host_rules(docs.where("false"), keep=["doc_id"]).count() == 0
    assert host_rules.keep_passing(docs).columns == docs.columns


def test_a_bad_host_loses_its_good_documents(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good if i % 10 else "bad", "fine") for i in range(50)] + [(100 + i, "bad", "junk") for i in range(30)] \
        + [(200, good, "junk"), (201, good, None)]
    got = {r.doc_id: r for r in host_rules.host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[200].host_rejected and not got[200].kept and got[201].kept and got[1].kept and not got[0].kept


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 16))
    rows = [(i, (centres[i % 6] + rng.standard_normal(16) * (0.05 + 0.02 * (i % 9))).tolist(), i % 2) for i in range(150)]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, rows[0][1], None),
             (204, rows[0][1], 0), (205, [1.0, None], 0), (None, rows[0][1], 0), rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    x = {r[0]: (np.array(r[1]) / np.linalg.norm(r[1]), r[2]) for r in rows
         if r[0] is not None and r[2] is not None and r[0] not in (200, 201, 202, 205)}
    linked = [(a, b) for a, b in itertools.combinations(x, 2) if x[a][1] == x[b][1] and x[a][0] @ x[b][0] >= 0.93]
    want = smallest_reachable({r[0] for r in rows if r[0] is not None}, linked)
    got = near_vectors.near_vectors(df).collect()
    assert len(got) == len(rows)
    missed = 0
    for r in got:
        if r.vec_id is None:
            assert r.n_links == 0 and r.component_id is None
            continue
        n = sum(r.vec_id in p for p in linked)
        assert r.n_links <= n
        missed += n - r.n_links
        assert r.component_id == want[r.vec_id]
    assert missed <= 0.02 * 2 * len(linked)
    assert near_vectors.near_vectors(df.where("false")).count() == 0


def test_shards_are_even_and_gapless(spark, docs):
    many = docs.select("doc_id", "text").unionByName(spark.range(1000, 1400).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 1150, F.concat(F.lit("t"), F.col("id") % 40)).otherwise(F.concat(F.lit("alone"), "id")).alias("text")))
    got = balanced_shards.balanced_shards(many, shards=7).collect()
    counts = {s: sorted(r.slot for r in got if r.shard == s) for s in range(7)}
    sizes = [len(v) for v in counts.values()]
    assert sum(sizes) == many.count() and max(sizes) - min(sizes) <= 1
    assert all(v == list(range(len(v))) for v in counts.values())
    text = {r.doc_id: r.text for r in many.collect()}
    placed = {}
    for r in got:
        if r.doc_id is not None and 1000 <= r.doc_id < 1150:
            placed.setdefault(text[r.doc_id], set()).add(r.shard)
    assert sum(len(v) == 1 for v in placed.values()) >= 0.9 * len(placed)
    assert balanced_shards.balanced_shards(many.where("false"), shards=7).count() == 0
    assert balanced_shards.balanced_shards(many.limit(3), shards=7).count() == 3


def test_full_shards_swap_nodes(spark):
    at = spark.range(200).select("id", F.pmod(F.xxhash64("id"), F.lit(2)).alias("s")).collect()
    left, right = ([r.id for r in at if r.s == s] for s in range(2))
    links = {1: left[:3] + right[:1], 2: right[1:4] + left[3:4]}               # both shards are full
    members = spark.createDataFrame([(n, k) for k, nodes in links.items() for n in nodes], "node long, link long")
    got = {r.node: r.shard for r in balanced_shards.propagate(members, 2, 4).collect()}
    assert [{got[n] for n in nodes} for nodes in links.values()] == [{0}, {1}]


def test_crowded_groups_come_together(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("t"), F.when(F.col("id") < 1500, F.col("id") % 15).otherwise(F.col("id") % 300)).alias("text"))
    many = rows.unionByName(spark.range(5000, 5600).select(F.col("id").alias("doc_id"), F.concat(F.lit("alone"), "id").alias("text")))
    text = {r.doc_id: r.text for r in many.collect()}
    placed = {}
    for r in balanced_shards.balanced_shards(many, shards=8).collect():
        placed.setdefault(text[r.doc_id], set()).add(r.shard)
    groups = [v for t, v in placed.items() if t.startswith("t")]
    assert sum(len(v) == 1 for v in groups) >= 0.97 * len(groups)


def test_nodes_of_several_links_settle(spark):
    pairs = [(n, n // 10) for n in range(100)] + [(n, 50 + n % 7) for n in range(0, 100, 9)]
    members = spark.createDataFrame(pairs, "node long, link long")
    got = {r.node: r.shard for r in balanced_shards.propagate(members, 4, 30).collect()}
    assert len(got) == 100 and max(list(got.values()).count(s) for s in range(4)) <= 30


def test_quotas_of_moves_keep_the_room():
    rng = np.random.default_rng(3)
    for _ in range(50):
        wishes, free = rng.integers(0, 9, (6, 6)), rng.integers(0, 5, 6)
        q = np.array(balanced_shards.move_quotas(wishes.tolist(), free.tolist()))
        np.fill_diagonal(wishes, 0)
        assert (q >= 0).all() and (q <= wishes).all() and (q.sum(axis=0) - q.sum(axis=1) <= free).all()
        assert not balanced_shards._cycle(wishes - q)
    assert balanced_shards.move_quotas([[0, 10, 0], [1, 0, 0], [0, 10, 0]], [0, 0, 0]) == [[0, 1, 0], [1, 0, 0], [0, 0, 0]]


def test_raking_meets_its_targets(spark):
    cells = spark.createDataFrame([("a", "x", 50), ("a", "y", 10), ("b", "x", 20), ("b", "y", 20), (None, "x", 5)],
                                  "source string, lang string, tokens long")
    targets = {"source": spark.createDataFrame([("a", .5), ("b", .4), (None, .1)], "value string, share double"),
               "lang": spark.createDataFrame([("x", .6), ("y", .4)], "value string, share double")}
    got = mixing.rake(cells, targets, sweeps=60).collect()
    for d, want in (("source", {"a": .5, "b": .4, None: .1}), ("lang", {"x": .6, "y": .4})):
        for value, share in want.items():
            assert sum(r.share for r in got if r[d] == value) == pytest.approx(share, abs=1e-6)
    p = mixing.probabilities(mixing.rake(cells, targets, sweeps=60), 0.5).collect()
    assert all(0 <= r.p <= 1 for r in p)
    assert sum(r.p * r.tokens for r in p) == pytest.approx(0.5 * 105)


def test_raking_goes_on_until_targets_are_met(spark):
    rows = [(f"s{i}", f"l{j}", (4000 if i == 0 else 500) * (85 if i % 2 == j else 15)) for i in range(4) for j in range(2)]
    cells = spark.createDataFrame(rows, "source string, lang string, tokens long")
    targets = {d: mixing.tempered(cells, d, 0.5) for d in ("source", "lang")}
    got = mixing.rake(cells, targets).collect()                        # the defaults that queries use
    for d, target in targets.items():
        for r in target.collect():
            assert sum(x.share for x in got if x[d] == r.value) == pytest.approx(r.share, rel=1e-9)


def test_raking_reports_targets_that_exclude_each_other(spark):
    cells = spark.createDataFrame([("a", "x", 50), ("b", "y", 10)], "source string, lang string, tokens long")
    goal = {"source": [("a", .5), ("b", .5)], "lang": [("x", .8), ("y", .2)]}
    targets = {d: spark.createDataFrame(v, "value string, share double") for d, v in goal.items()}
    with pytest.warns(UserWarning, match="off by"):
        mixing.rake(cells, targets).collect()


def test_caps_go_on_until_no_cell_is_left(spark):
    rows = [(int(1000 * 1.1 ** k), 0.3 ** k) for k in range(20)]       # more than eight rounds cap further cells
    total, shares = (sum(r[i] for r in rows) for i in range(2))
    cells = spark.createDataFrame([(t, s / shares) for t, s in rows], "tokens long, share double")
    p = mixing.probabilities(cells, 0.9).collect()
    assert sum(r.p * r.tokens for r in p) == pytest.approx(0.9 * total, rel=1e-9)


def test_mixing_handles_nulls_and_empty_tables(spark, docs):
    out = mixing.mix_documents(docs, 0.9)
    assert set(docs.columns) <= set(out.columns) and out.count() <= docs.count()
    assert mixing.mix_documents(docs.where("false"), 0.9).count() == 0


def test_url_lists_by_day(spark):
    entries = spark.createDataFrame(
        [("bad.com", 10, "add"), ("bad.com", 20, "remove"), ("bad.com", 30, "add"), ("ok.org/x", 5, "add"),
         ("bad.com", 30, "add"), (None, 1, "add"), ("tie.net", 4, "add"), ("tie.net", 4, "remove")],
        "pattern string, day int, action string")
    rows = [(1, "http://bad.com/a", 9), (2, "http://www.BAD.com:80/a", 10), (3, "http://bad.com", 20), (4, "http://notbad.com", 15),
            (5, "https://u@ok.org/x/y?q#f", 6), (6, "http://ok.org/xy", 6), (7, None, 6), (8, "http://bad.com", None),
            (9, "http://a.bad.com", 99), (9, "http://a.bad.com", 99), (10, "http://tie.net", 5), (11, "nonsense", 5)]
    captures = spark.createDataFrame(rows, "page_id long, url string, day int")
    got = url_lists.judged_captures(captures, entries).collect()
    assert len(got) == len(rows)
    assert {r.page_id for r in got if r.blocked} == {2, 5, 9}
    assert [(r.pattern, r.since) for r in got if r.page_id == 5] == [("ok.org/x", 5)]


def test_url_lists_take_patterns_of_any_length(spark):
    deep = "deep.org/" + "/".join("abcdefgh")
    entries = spark.createDataFrame([(deep, 5, "add")], "pattern string, day int, action string")
    urls = [f"http://{deep}", f"http://{deep}/i/j?q", f"http://{deep}i", "http://deep.org/a/b/c/d/e/f/g", "http://deep.org"]
    captures = spark.createDataFrame([(i, u, 6) for i, u in enumerate(urls)], "page_id long, url string, day int")
    got = url_lists.judged_captures(captures, entries).collect()
    assert {(r.page_id, r.n_matches, r.pattern) for r in got if r.blocked} == {(0, 1, deep), (1, 1, deep)}
    assert url_lists.judged_captures(captures, entries.where("false")).where("not blocked").count() == len(urls)


def test_url_lists_keep_the_case_of_paths(spark):
    entries = spark.createDataFrame(
        [("Site.ORG/News", 5, "add"), ("slash.net/", 5, "add"), ("Slash.com/A/", 5, "add"), ("slash.com/A", 8, "remove"),
         ("/", 5, "add"), ("", 5, "add")], "pattern string, day int, action string")
    rows = [(1, "http://site.org/News/1", 6), (2, "http://SITE.org/news", 6), (3, "http://slash.net", 6), (4, "http://slash.net/b", 6),
            (5, "http://slash.com/A", 6), (6, "http://slash.com/A/c", 7), (7, "http://slash.com/a", 6), (8, "http://slash.com/A", 8),
            (9, "http://dot./", 6)]
    captures = spark.createDataFrame(rows, "page_id long, url string, day int")
    got = {r.page_id: r.pattern for r in url_lists.judged_captures(captures, entries).collect() if r.blocked}
    assert got == {1: "site.org/News", 3: "slash.net", 4: "slash.net", 5: "slash.com/A", 6: "slash.com/A"}


@pytest.mark.parametrize("rows", [[f"<p>{i} " + f"line {i % 7} of a page</p>" * 1000 for i in range(60)], ["<p>one</p>" * 30, "<p>two</p>", "x"], ["y"]])
def test_archives_of_large_or_few_pages_carry_a_dictionary(spark, rows):
    df = spark.createDataFrame([(i, f"http://a/{i}", t) for i, t in enumerate(rows)], "page_id long, url string, html string")
    words = warc.build_dictionary(df, warc.payload_roles(df, "page_id", "html"), "html")
    assert 0 < len(words) <= warc.DICTIONARY_BYTES
    folder = warc.archive_folder(spark)
    got = warc.read_archives(spark, warc.write_archives(df, folder), folder).collect()
    assert {int(r.id): r.digest for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(rows)}


def test_archives_round_trip(spark):
    big, other = "<p>hello world</p>" * 20, "ü" * 3000
    rows = [(i, f"http://a/{i}", big if i % 3 else other + str(i)) for i in range(40)]
    rows += [(50, None, None), (51, "a b\r\nX: y", ""), (52, "c", "same"), (53, "c", "same"), rows[1]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = warc.archive_folder(spark)
    manifest = warc.write_archives(df, folder)
    got = warc.read_archives(spark, manifest, folder).collect()
    assert len(got) == len(rows) == sum(r.records for r in manifest.collect())
    html = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        body = html[int(r.id)]
        first = min(i for i in html if html[i] == body)
        stored = len(body) < 100 or int(r.id) == first
        assert (r.size, r.digest) == (len(body), hashlib.sha256(body).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if stored else ("revisit", str(first)))
        assert r.payload is None if not stored else bytes(r.payload) == body
    empty = warc.archive_folder(spark)
    assert warc.write_archives(df.where("false"), empty).count() == 0


def test_reply_trees_choose_the_best_branch(spark):
    rows = [(1, i, i - 1 if i else None, 1.0, "user" if i % 2 == 0 else "assistant", f"t<|[\\{i}</s>[INST]") for i in range(20)]
    rows += [(1, 100, 3, 50.0, "assistant", None), (2, 1, None, None, "user", "x"), (2, 2, 1, 0.5, "assistant", "é\n<|end|>\n"),
             (2, 3, 1, 0.5, "assistant", "z"), (3, 1, 2, 1.0, "a", "b"), (3, 2, 1, 1.0, "a", "b"), (None, 1, None, 1.0, "user", "q"),
             (2, 3, 1, 0.5, "assistant", "z"), (4, 9, 77, 0.0, None, "root by absence")]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")
    got = {(r.tree, r.path_rank): r for r in reply_trees.parsed(reply_trees.formatted(df, top=2)).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2), (None, 1), (4, 1)}
    assert [t.text for t in got[1, 1].turns] == [rows[i][5] for i in range(4)] + [""]
    assert [t.text for t in got[1, 2].turns] == [rows[i][5] for i in range(20)]
    assert got[2, 1].loss_texts == ["é\n<|end|>\n"] and got[2, 2].loss_texts == ["z"]
    for r in got.values():
        body = r.formatted.removeprefix("<s>").removesuffix("</s>")
        assert "</s>" not in body and "[INST]" not in body
    assert reply_trees.formatted(df.where("false")).count() == 0


def test_pieces_equal_the_library(spark, docs):
    sp = pytest.importorskip("sentencepiece")
    path = "/opt/tokenizers/piece_bpe_32k.model"
    model, table = sp.SentencePieceProcessor(model_file=path), pieces.PieceTable.load(path)
    texts = ["", None, " ", "  a   b \n\n c", "日本語\U0001F600é\r\n\t", "ab" * 400, " " * 37, "for(i=0;i<9;){\r\n}", "\x00\x01"]
    texts += [r[0] for r in docs.select("text").collect() if len(r[0] or "") < 20_000]
    ids, borders = table.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(borders[:-1], borders[1:])] == model.encode([t or "" for t in texts])
    assert table.decode(ids, borders) == [t or "" for t in texts]
    out = pieces.decode(pieces.encode(docs, table), table).collect()
    assert [r.decoded for r in out] == [r.text for r in out]
    assert pieces.round_trip(docs.where("false"), table).count() == 0


def test_unigram_pieces_have_the_best_score():
    rng = np.random.default_rng(2)
    names = ["a", "b", "c", "ab", "bc", "abc", "ca", "▁", "▁a", "aa", "bca"]
    scores = (-rng.random(len(names)) * 5).tolist()
    table = pieces.PieceTable(names, scores, [False] * len(names), [], "unigram")
    known = dict(zip(names, scores))

    def best(text):
        if not text:
            return 0.0
        return max((known[text[:k]] + best(text[k:]) for k in range(1, 4) if text[:k] in known), default=-1e9)

    for _ in range(60):
        t = "".join(rng.choice(list("abc"), 9))
        ids, _ = table.encode([t])
        assert "".join(names[i] for i in ids) == "▁" + t
        assert sum(scores[i] for i in ids) == pytest.approx(best("▁" + t))


def test_crf_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    node, owner, moves = rng.standard_normal(9), np.array([0, 0, 0, 0, 1, 2, 2, 2, 3]), rng.standard_normal((2, 2))
    got = line_crf.marginals(node, owner, moves)
    for chain in range(4):
        at = np.flatnonzero(owner == chain)
        total, good = 0.0, np.zeros(len(at))
        for y in itertools.product((0, 1), repeat=len(at)):
            w = np.exp(sum(node[a] * v for a, v in zip(at, y)) + sum(moves[p, q] for p, q in zip(y, y[1:])))
            total += w
            good += w * np.array(y)
        assert got[at] == pytest.approx(good / total)


def test_crf_separates_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = line_crf.learn(docs, labels)
    held = line_crf.score(docs, model, keep=["doc_id"]).join(labels, "doc_id").where(line_crf.fold_of(F.col("doc_id")) == 0).collect()
    assert np.mean([(r.score >= line_crf.GOOD_FROM) == bool(r.quality) for r in held]) >= 0.95


def test_crf_without_labels(spark, docs):
    model = line_crf.learn(docs, spark.createDataFrame([], "doc_id long, quality int"))
    got = line_crf.score(docs, model).collect()
    assert {r.score for r in got if not WORD.search(r.text or "")} == {0.0}
    assert {r.score for r in got if WORD.search(r.text or "")} == {0.5}
