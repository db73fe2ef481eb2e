import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from couplet.functions.sampling import hypergeometric, mann_whitney_p, permuted_table_terms, _large_hypergeometric
from couplet.functions.vectors import stars
from couplet.operators import auc, diagnose, metrics, preprocess, ranks, shared, splitting, summarise
from tests import fixtures as fx


def reference_hdi(s, prob=0.94):
    s = np.sort(s)
    inc = max(1, int(np.floor(prob * len(s))))
    if inc >= len(s):
        return s[0], s[-1]
    i = int(np.argmin(s[inc:] - s[:len(s) - inc]))
    return s[i], s[i + inc]


def test_draw_summary(spark):
    rows = [("skew", x) for x in (0.0, 0.0, 0.0, 0.0, 0.1, 0.2, 5.0)] + [("one", 2.0), ("none", None), ("nan", float("nan"))]
    df = spark.createDataFrame(rows, "k string, value double")
    got = {r["k"]: r for r in summarise.summarise_draws(df, ["k"], hdi_prob=0.8).collect()}
    lo, hi = reference_hdi([x for k, x in rows if k == "skew"], 0.8)
    assert (got["skew"]["hdi_low"], got["skew"]["hdi_high"]) == (lo, hi)
    assert got["one"]["value"] == 2.0 and got["one"]["sd"] is None and got["one"]["hdi_low"] is None
    assert got["none"]["value"] is None and got["nan"]["value"] is None


@pytest.mark.parametrize("window_rows", [10**6, 50])
def test_ranks_quantiles_and_hdi_of_skewed_groups(spark, monkeypatch, window_rows):
    """Both the single-window and the range-split form, with ties, against numpy."""
    monkeypatch.setattr(ranks, "WINDOW_ROWS", window_rows)
    monkeypatch.setattr(ranks, "_BLOCK_RANKS", 64)
    rng = np.random.default_rng(0)
    groups = {"a": np.round(rng.gamma(2, 2, 900), 1), "b": rng.normal(size=301), "c": np.array([4.0]), "d": np.full(200, 7.0),
              None: np.round(rng.normal(size=150), 1)}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v], "k string, x double")
    ranked = ranks.ranked_values(df, "x", ["k"]).rows.collect()
    for k, v in groups.items():
        uniq, n = np.unique(v, return_counts=True)
        mine = sorted((r for r in ranked if r["k"] == k), key=lambda r: r["value"])
        assert [r["value"] for r in mine] == list(uniq)
        assert [r["below"] for r in mine] == list(np.cumsum(n) - n)
        assert [r["position"] for r in mine] == list(range(len(uniq)))
    quant = {r["k"]: r for r in ranks.exact_quantiles(df, "x", ["k"], (0.025, 0.5), ("lo", "mid")).collect()}
    hdi = {r["k"]: r for r in ranks.exact_hdi(df, "x", ["k"]).collect()}
    for k, v in groups.items():
        np.testing.assert_allclose([quant[k]["lo"], quant[k]["mid"]], np.quantile(v, [0.025, 0.5]), atol=1e-12)
        np.testing.assert_allclose((hdi[k]["hdi_low"], hdi[k]["hdi_high"]), reference_hdi(v), atol=1e-12)


@pytest.mark.parametrize("window_rows", [10**6, 20])
def test_ordinals_and_clone_ranks(spark, monkeypatch, window_rows):
    monkeypatch.setattr(ranks, "WINDOW_ROWS", window_rows)
    df = spark.createDataFrame([(f"x{i % 97:02d}",) for i in range(300)], "label string")
    got = {r["label"]: r["ordinal"] for r in ranks.distinct_ordinals(df, "label").collect()}
    assert got == {f"x{i:02d}": i for i in range(97)}
    study = fx.study(spark)
    want = {(r["patient"], r["clonotype"]): r["rank"] for r in preprocess.clone_rank(study).collect()}
    monkeypatch.setattr(preprocess, "_RANK_WINDOW", 0)
    monkeypatch.setattr(preprocess, "_RANK_BLOCK", 5)
    assert {(r["patient"], r["clonotype"]): r["rank"] for r in preprocess.clone_rank(study).collect()} == want


def brute_p(a, b, alternative):
    pool, n = np.concatenate([a, b]), len(a)
    u = lambda x, y: sum((i > j) + 0.5 * (i == j) for i in x for j in y)
    seen = u(a, b)
    hits = {"two-sided": 0, "greater": 0, "less": 0}
    total = 0
    for idx in itertools.combinations(range(len(pool)), n):
        mask = np.zeros(len(pool), bool)
        mask[list(idx)] = True
        v = u(pool[mask], pool[~mask])
        total += 1
        hits["greater"] += v >= seen
        hits["less"] += v <= seen
    p = {k: hits[k] / total for k in ("greater", "less")}
    p["two-sided"] = min(1.0, 2 * min(p.values()))
    return seen, p[alternative]


@pytest.mark.parametrize("alternative", ["two-sided", "greater", "less"])
def test_exact_mann_whitney(alternative):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=4), rng.normal(size=5) + 0.7
    u, p = brute_p(a, b, alternative)
    assert mann_whitney_p(u, 4, 5, 0, alternative) == pytest.approx(p, abs=1e-12)


def test_asymptotic_mann_whitney():
    # hand-computed: n = 10 + 10, U = 30, no ties, continuity corrected
    z = (70 - 50 - 0.5) / math.sqrt(10 * 10 * 21 / 12)
    assert mann_whitney_p(30, 10, 10, 0, "two-sided") == pytest.approx(math.erfc(z / math.sqrt(2)))
    assert mann_whitney_p(50, 10, 10, 20**3 - 20, "two-sided") is None
    assert mann_whitney_p(4000, 8, 1000, 0, "two-sided") == pytest.approx(1.0, abs=0.01)


def test_contrast_frame(spark):
    rows = [("R", x) for x in (0.80, 0.75, 0.82, 0.79)] + [("NR", x) for x in (0.40, 0.35, 0.45, 0.50)] + [("X", None)]
    df = spark.createDataFrame(rows, "arm string, value double")
    got = summarise.compare_groups(df, splitby="arm").collect()
    assert len(got) == 1        # a side without values is skipped
    r = got[0]
    assert (r["level_a"], r["level_b"], r["U"]) == ("NR", "R", 0.0)
    assert r["p"] == pytest.approx(2 / 70) and r["stars"] == "*" and r["delta"] == pytest.approx(0.365)
    assert summarise.compare_groups(df, splitby="arm", reference="R").first()["delta"] == pytest.approx(-0.365)
    with pytest.raises(ValueError, match="reference"):
        summarise.compare_groups(df, splitby="arm", reference="Z")
    with pytest.raises(ValueError, match="alternative"):
        summarise.compare_groups(df, splitby="arm", alternative="up")


@pytest.mark.parametrize("window_rows,cells", [(10**6, 10**6), (40, 12)])
def test_contrasts_of_all_pairs_from_one_ranking(spark, monkeypatch, window_rows, cells):
    """One range and many, with ties and uneven levels, against counting every pair of rows."""
    monkeypatch.setattr(summarise, "WINDOW_ROWS", window_rows)
    monkeypatch.setattr(summarise, "RANGE_CELLS", cells)
    rng = np.random.default_rng(6)
    groups = {"a": np.round(rng.normal(size=90), 1), "b": np.round(rng.normal(0.4, 1, 140), 1), "c": rng.normal(size=33), "d": np.full(25, 0.3)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("e", None), (None, 1.0), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "arm string, value double").repartition(6)
    got = {(r["level_a"], r["level_b"]): r for r in summarise.compare_groups(df, splitby="arm").collect()}
    assert set(got) == set(itertools.combinations("abcd", 2))
    for (p, q), r in got.items():
        x, y = groups[p], groups[q]
        wins = (x[:, None] > y[None, :]).sum() + (x[:, None] == y[None, :]).sum() / 2
        _, tied = np.unique(np.concatenate([x, y]), return_counts=True)
        assert (r["U"], r["n_a"], r["n_b"]) == (wins, len(x), len(y))
        assert r["delta"] == pytest.approx(y.mean() - x.mean())
        assert r["p"] == pytest.approx(mann_whitney_p(wins, len(x), len(y), float((tied.astype(float) ** 3 - tied).sum()), "two-sided"))


def test_splitting_tree_keeps_totals_and_law(spark, monkeypatch):
    """Thirteen blocks under a fan of three: totals add up and follow the shuffle's mean and variance."""
    monkeypatch.setattr(splitting, "FAN", 3)
    sizes = [3, 50, 7, 1, 20, 11, 90, 2, 40, 5, 5, 60, 6]
    blocks = spark.createDataFrame([("s", i, [n]) for i, n in enumerate(sizes)], "k string, block long, weights array<long>")
    margin, width = np.array([120, 130, 50]), 400
    root = [("s", 7, c, width, bytearray(np.tile(margin, (width, 1)).astype(np.int64).tobytes())) for c in range(5)]
    roots = spark.createDataFrame(root, "k string, stratum long, chunk long, width int, totals binary")
    rows = splitting.block_totals(roots, blocks, ["k"], len(sizes), 11, splitting.without_replacement).collect()
    assert len(rows) == 5 * len(sizes)
    got = {(r["chunk"], r["block"]): np.frombuffer(bytes(r["totals"]), np.int64).reshape(width, 3) for r in rows}
    for c in range(5):
        assert (sum(got[c, b] for b in range(len(sizes))) == margin).all()
    for b, n in enumerate(sizes):
        draws = np.concatenate([got[c, b] for c in range(5)])
        assert (draws.sum(axis=1) == n).all() and (draws >= 0).all()
        share = margin / 300
        spread = n * share * (1 - share) * (300 - n) / 299
        assert (np.abs(draws.mean(axis=0) - n * share) < 5 * np.sqrt(spread / len(draws)) + 1e-9).all()
        np.testing.assert_allclose(draws.var(axis=0), spread, rtol=0.2, atol=0.02)
    again = splitting.block_totals(roots.repartition(3), blocks, ["k"], len(sizes), 11, splitting.without_replacement).collect()
    assert {(r["chunk"], r["block"]): bytes(r["totals"]) for r in again} == {k: v.tobytes() for k, v in got.items()}


def test_stars(spark):
    df = spark.createDataFrame([(1e-5,), (5e-4,), (5e-3,), (0.04,), (0.05,), (None,)], "p double")
    assert [r[0] for r in df.select(stars(F.col("p"))).collect()] == ["****", "***", "**", "*", "ns", "ns"]


def test_unit_of_the_contrast_is_the_replicate(spark):
    study = fx.study(spark)
    out = metrics.phenotypic_entropy(study, covariate="t0", splitby="response", source="counts")
    row = out["stats"].first()
    assert (row["n_a"], row["n_b"], row["replicate_unit"]) == (3, 3, "patient") and row["response"] == "NR vs R"
    means = {r["response"]: r["m"] for r in out["result"].groupBy("patient", "response").agg(F.avg("value").alias("v"))
             .groupBy("response").agg(F.avg("v").alias("m")).collect()}
    assert row["mean_a"] == pytest.approx(means["NR"]) and row["delta"] == pytest.approx(means["R"] - means["NR"])
    assert metrics.phenotypic_entropy(study, covariate="t0", source="counts")["stats"] is None


def test_across_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 3.0), ("c", None), ("a", float("nan"))], "k string, value double")
    for rows in (None, 6):
        got = {r["k"]: r for r in summarise.across_groups(df, ["k"], rows=rows).collect()}
        lo, hi = np.percentile([1, 2, 4], [2.5, 97.5])
        assert (got["a"]["ci_low"], got["a"]["ci_high"], got["a"]["n_groups"]) == (pytest.approx(lo), pytest.approx(hi), 3)
        assert got["b"]["value"] == 3.0 and got["b"]["sd"] is None and got["c"]["n_groups"] == 0


def test_paired_contrast(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(3, 20)), rng.normal(size=(3, 20)) + 1
    rows = [("x", u, d, float(a[u, d])) for u in range(3) for d in range(20)] + \
           [("y", u, d, float(b[u, d])) for u in range(3) for d in range(20 - u)]
    df = spark.createDataFrame(rows, "arm string, unit int, draw int, value double")
    diff = np.concatenate([b[u, :20 - u] - a[u, :20 - u] for u in range(3)])
    r = summarise.compare_paired(df, splitby="arm", pair_on="unit").first()
    assert r["delta"] == pytest.approx(diff.mean()) and r["p_gt"] == pytest.approx((diff > 0).mean())
    np.testing.assert_allclose((r["hdi_low"], r["hdi_high"]), reference_hdi(diff))


def brute_auc(scores, labels):
    pos, neg = [s for s, y in zip(scores, labels) if y], [s for s, y in zip(scores, labels) if not y]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def frame(spark, scores, labels):
    return spark.createDataFrame([(float(s), int(y)) for s, y in zip(scores, labels)], "s double, y int")


def test_auc_exact_permutation(spark):
    perfect = auc.auc_and_label_permutation(frame(spark, [.1, .2, .8, .9], [0, 0, 1, 1]), "s", "y")["result"].first()
    assert (perfect["auc"], perfect["mode"], perfect["n_stats"]) == (1.0, "exact", 6) and perfect["p"] == pytest.approx(2 / 6)
    rng = np.random.default_rng(6)
    s, y = rng.integers(0, 4, 9), [1, 1, 1, 0, 0, 0, 0, 0, 1]
    got = auc.auc_and_label_permutation(frame(spark, s, y), "s", "y")
    seen = brute_auc(s, y)
    every = [brute_auc(s, [i in c for i in range(9)]) for c in itertools.combinations(range(9), 4)]
    r = got["result"].first()
    assert r["auc"] == pytest.approx(seen) and r["p"] == pytest.approx(np.mean(np.abs(np.array(every) - .5) >= abs(seen - .5) - 1e-12))
    np.testing.assert_allclose(sorted(x["auc"] for x in got["perm_stats"].collect()), sorted(every))


def test_auc_degenerate_and_bootstrap(spark):
    one = auc.auc_and_label_permutation(frame(spark, [1, 2], [1, 1]), "s", "y")["result"].first()
    assert one["mode"] == "degenerate" and one["p"] is None
    with pytest.raises(ValueError, match="both classes"):
        auc.bootstrap_auc(frame(spark, [1, 2], [1, 1]), "s", "y")


def test_auc_resampling_over_many_blocks(spark):
    """Blocks of a few scores give the law of a plain shuffle and a plain bootstrap."""
    rng = np.random.default_rng(7)
    y = (rng.random(120) < 0.4).astype(int)
    s = np.round(rng.normal(size=120) + 0.5 * y, 1)
    df = frame(spark, s, y)
    draws = {}
    for size in (7, 50_000):
        out = auc.auc_and_label_permutation(df, "s", "y", n_perm=4000, max_exact=10, block_scores=size)
        draws[size] = np.array([r["auc"] for r in out["perm_stats"].collect()])
        assert out["result"].first()["mode"] == "mc" and len(draws[size]) == 4000
    plain = np.array([brute_fast(s, rng.permutation(y)) for _ in range(4000)])
    for d in draws.values():
        assert d.mean() == pytest.approx(0.5, abs=0.005) and d.std() == pytest.approx(plain.std(), rel=0.06)
    boots = []
    while len(boots) < 3000:
        i = rng.integers(0, 120, 120)
        if 0 < y[i].sum() < 120:
            boots.append(brute_fast(s[i], y[i]))
    want = np.quantile(boots, [0.025, 0.975])
    for size in (7, 50_000):
        r = auc.bootstrap_auc(df, "s", "y", n_boot=3000, block_scores=size).first()
        np.testing.assert_allclose((r["ci_low"], r["ci_high"]), want, atol=0.015)


def brute_fast(s, y):
    order = np.argsort(s, kind="stable")
    uniq, inv, n = np.unique(s, return_inverse=True, return_counts=True)
    mid = (np.cumsum(n) - n + (n + 1) / 2)[inv]
    k = y.sum()
    return (mid[y == 1].sum() - k * (k + 1) / 2) / (k * (len(y) - k))


def test_hypergeometric_beyond_the_numpy_limit():
    rng = np.random.default_rng(8)
    good, bad, n = 3 * 10**9, 5 * 10**9, 10**6
    x = hypergeometric(rng, np.full(3000, good), np.full(3000, bad), np.full(3000, n))
    p = good / (good + bad)
    sd = math.sqrt(n * p * (1 - p) * (good + bad - n) / (good + bad - 1))
    assert abs(x.mean() - n * p) < 5 * sd / math.sqrt(3000) and x.std() == pytest.approx(sd, rel=0.08)
    small = np.array([_large_hypergeometric(rng, 7, 9, 6) for _ in range(6000)])
    plain = rng.hypergeometric(7, 9, 6, 6000)
    assert small.mean() == pytest.approx(plain.mean(), abs=0.08) and small.std() == pytest.approx(plain.std(), rel=0.06)


def test_permuted_tables_follow_the_shuffle_law():
    rng = np.random.default_rng(9)
    sizes = rng.integers(1, 90, 40)
    left = np.tile(rng.multinomial(sizes.sum(), [.2, .3, .5]), (3000, 1))
    runs = [permuted_table_terms(rng, sizes, left, large=k) for k in (0, 30, 10**9)]
    for r in runs[:2]:
        assert r.mean() == pytest.approx(runs[2].mean(), rel=1e-4) and r.std() == pytest.approx(runs[2].std(), rel=0.08)


@pytest.mark.parametrize("block_clones", [20_000, 3])
def test_permutation_null_matches_a_plain_shuffle(spark, block_clones):
    rows = fx.cell_rows(seed=11, n_patients=2)
    out = diagnose.permutation_null(fx.study(spark, rows), covariate="t0", groupby="patient", n_perm=600, random_state=1,
                                    normalize_mode="average", block_clones=block_clones)
    rng = np.random.default_rng(0)
    for r in out.collect():
        cells = [(c, fx.PHENOTYPES.index(ph)) for _, c, ph, t, p, *_ in rows if t == "t0" and p == r["patient"]]
        ids = {c: i for i, c in enumerate(sorted({c for c, _ in cells}))}
        owner, label = np.array([ids[c] for c, _ in cells]), np.array([j for _, j in cells])

        def nmi(lab):
            t = np.zeros((len(ids), 4))
            np.add.at(t, (owner, lab), 1)
            return fx.information(t) / (0.5 * (fx.entropy(t.sum(1)) + fx.entropy(t.sum(0))))

        null = np.array([nmi(rng.permutation(label)) for _ in range(600)])
        assert r["observed"] == pytest.approx(nmi(label), abs=1e-9)
        assert r["null_mean"] == pytest.approx(null.mean(), abs=6 * null.std() / math.sqrt(300))
        assert r["null_sd"] == pytest.approx(null.std(), rel=0.2)
        assert r["p"] >= 1 / 601 and r["z"] == pytest.approx((r["observed"] - r["null_mean"]) / r["null_sd"])


def test_permutation_null_arguments(spark):
    study = fx.study(spark)
    with pytest.raises(ValueError, match="metric"):
        diagnose.permutation_null(study, metric="flux")
    with pytest.raises(ValueError, match="normalize_mode"):
        diagnose.permutation_null(study, normalize_mode="max")


def test_subset_rank_sums_of_many_rows_follow_the_law_and_cost_little(monkeypatch):
    rng = np.random.default_rng(4)
    counts = np.concatenate([rng.integers(1, 60, 3000), [9000]])          # 9000: beyond the tabulated laws
    mids = np.cumsum(counts) - counts + (counts + 1) / 2
    n = int(counts.sum())
    take = np.full(600, n // 2) + np.arange(600) % 3
    start = time.perf_counter()
    got = auc._subset_rank_sums(rng, counts, mids, take)
    fast = time.perf_counter() - start
    start = time.perf_counter()
    for count in counts[:600]:                                            # a fifth of what one draw per value would cost
        hypergeometric(rng, np.full(600, count), np.full(600, n - count), take)
    assert fast < 2.5 * (time.perf_counter() - start)
    law = take * (n - take) / 12 * (n + 1 - (counts.astype(float) ** 3 - counts).sum() / (n * (n - 1)))
    z = (got - take * (n + 1) / 2) / np.sqrt(law)
    assert abs(z.mean()) < 5 / 600 ** 0.5 and 0.75 < z.var() < 1.3


def test_subset_rank_sums_are_uniform_on_few_rows(monkeypatch):
    monkeypatch.setattr(auc, "BLOCK_SCORES", 0)                           # no rows drawn one by one
    counts, mids = np.array([2, 1, 3]), np.array([1.0, 10.0, 100.0])
    got = auc._subset_rank_sums(np.random.default_rng(6), counts, mids, np.concatenate([np.full(20_000, 3), [0, 6]]))
    assert got[-2] == 0 and got[-1] == 312
    want = {}
    for rows in itertools.combinations([1, 1, 10, 100, 100, 100], 3):
        want[sum(rows)] = want.get(sum(rows), 0) + 1 / 20
    seen = dict(zip(*np.unique(got[:-2], return_counts=True)))
    assert seen.keys() == want.keys()
    assert all(abs(seen[k] / 20_000 - share) < 5 * (share / 20_000) ** 0.5 for k, share in want.items())


def test_permuted_aucs_are_drawn_once(spark):
    df = spark.createDataFrame([(float(i % 17), i % 2) for i in range(400)], "score double, label int")
    out = auc.auc_and_label_permutation(df, "score", "label", n_perm=50)
    plan = out["perm_stats"]._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and "CoGroup" not in plan
    assert out["result"].first()["n_stats"] == out["perm_stats"].count() == 50
