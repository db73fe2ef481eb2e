import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from couplet.functions import distances, vectors
from couplet.operators import (
    auc, diagnose, estimate, evidence, frames, joint, metrics, preprocess, ranks, shared, summarise,
)
from couplet.spec import register_cells
from tests import fixtures as fx


@pytest.fixture(scope="module")
def rows():
    return fx.cell_rows(seed=21)


@pytest.fixture(scope="module")
def study(spark, rows):
    return fx.study(spark, rows, fit=True)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first()["x"]


def test_distance_literals(spark):
    f = lambda d, p, q: one(spark, d(F.col("p"), F.col("q"), 2), p=p, q=q)
    assert f(distances.kl_divergence, [0.3, 0.7], [0.3, 0.7]) == 0.0
    assert f(distances.jensen_shannon, [1.0, 0.0], [0.0, 1.0]) == pytest.approx(1.0, abs=1e-9)
    assert f(distances.l1_distance, [1.0, 0.0], [0.0, 1.0]) == pytest.approx(2.0, abs=1e-9)


@pytest.mark.parametrize("size", [3, 40])
def test_vector_functions_short_and_long(spark, size):
    rng = np.random.default_rng(size)
    p = rng.dirichlet(np.ones(size))
    v = [float(x) for x in p]
    assert one(spark, vectors.shannon(F.col("p"), size, False), p=v) == pytest.approx(fx.entropy(p))
    np.testing.assert_allclose(one(spark, vectors.softmax(F.col("p"), size), p=v), np.exp(p) / np.exp(p).sum())
    np.testing.assert_allclose(one(spark, vectors.temper_power(F.col("p"), size, 0.5), p=v), p**2 / (p**2).sum(), rtol=1e-9)
    assert one(spark, vectors.log_sum_exp(F.col("p"), size), p=v) == pytest.approx(np.log(np.exp(p).sum()))
    assert one(spark, vectors.argmax_label(F.col("p"), [str(i) for i in range(size)]), p=v) == str(p.argmax())
    alpha = list(rng.random(size) + 0.1)
    counts = [float(x) for x in rng.integers(0, 9, size)]
    want = math.lgamma(sum(alpha)) - math.lgamma(sum(alpha) + sum(counts)) + sum(
        math.lgamma(c + a) - math.lgamma(a) for c, a in zip(counts, alpha))
    assert one(spark, vectors.dirichlet_multinomial(F.col("c"), alpha), c=counts) == pytest.approx(want, rel=1e-10)


def test_undefined_values_are_null(spark):
    assert one(spark, vectors.shannon(F.col("p"), 2, True), p=[0.0, 0.0]) is None
    assert one(spark, vectors.xlog2x(F.col("x")), x=0.0) == 0.0
    assert one(spark, vectors.clamp(F.col("x"), 0.0, 1.0), x=float("nan")) is None
    assert one(spark, vectors.clamp(F.col("x"), 0.0, 1.0), x=7.0) == 1.0


def test_temperature_is_checked(spark):
    for bad in (0.0, -1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="temperature"):
            vectors.temper_power(F.col("p"), 2, bad)
    with pytest.raises(Exception, match="underflows"):
        one(spark, vectors.temper_power(F.col("p"), 3, 1e-4), p=[0.7, 0.2, 0.1])


@pytest.mark.parametrize("x", [1e-3, 0.2, 1.0, 8.5, 1e3, 1e7])
def test_log_gamma(spark, x):
    assert one(spark, vectors.log_gamma(F.col("x")), x=x) == pytest.approx(math.lgamma(x), rel=1e-11, abs=1e-11)


def test_preprocessing(spark, rows, study):
    sizes: dict[str, int] = {}
    for r in rows:
        sizes[r[1]] = sizes.get(r[1], 0) + 1
    assert {(r["cell_id"], r["clone_size"]) for r in preprocess.clone_size(study).collect()} == {(r[0], sizes[r[1]]) for r in rows}
    cells = spark.createDataFrame([(r[0], r[1].split("@")[0], r[4]) for r in rows], "id string, trb string, patient string")
    got = preprocess.group_singletons(cells).collect()
    assert len(got) == len(rows)
    for r in got:
        small = sizes[f"{r['trb']}@{r['patient'][1:]}"] < 10
        assert r["trb_unique"] == (f"Singleton_{r['patient']}" if small else f"{r['trb']}_{r['patient']}")
    modal = {r["clonotype"]: r["modal_phenotype"] for r in preprocess.modal_phenotype(study).collect()}
    for c, m in modal.items():
        n = {p: sum(r[1] == c and r[2] == p for r in rows) for p in fx.PHENOTYPES}
        assert m == min((p for p in n if n[p] == max(n.values())))
    summary = preprocess.dataset_summary(study).first()
    assert (summary["n_cells"], summary["n_clones"], summary["n_groups"], summary["largest_clone"]) == (
        len(rows), len(sizes), 6, max(sizes.values()))


def test_null_clones_are_kept_by_lookups(spark, rows):
    study = fx.study(spark, rows + [("x", None, "p0", "t0", None, None, [0.0] * 4)])
    got = {r["cell_id"]: r["clone_size"] for r in preprocess.clone_size(study).collect()}
    assert len(got) == len(rows) + 1 and got["x"] is None


def test_salted_lookup_keeps_every_row_once(spark, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(shared, "HOT_SHARE", 8)
    facts = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    dim = shared.materialise(facts.where("k <> 7").groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    inner = shared.lookup_join(facts, dim, ["k"], "n").collect()
    assert len(inner) == facts.where("k <> 7").count() == len({r["id"] for r in inner})
    left = shared.lookup_join(facts, dim, ["k"], "n", keep_unmatched=True).collect()
    assert len(left) == 3000 and all((r["n"] is None) == (r["k"] == 7) for r in left)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = shared.lookup_join(facts, dim, ["k"], "n")._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the shuffle of the facts carries the salt, so a hot key is spread over partitions
    assert "__salt" in plan.split("Physical Plan")[1].split("SortMergeJoin")[1].split("]")[0]
    salts = shared.lookup_join(facts, dim, ["k"], "n", salt_column="s").where("k = 0").select("s").distinct().count()
    assert salts > 1


def test_posterior_closed_form_and_behaviour(spark, rows, study):
    want = fx.fitted(rows)
    for r in study.posterior.collect():
        p, conc = want[r["clonotype"], r["covariate"]]
        np.testing.assert_allclose(r["p"], p, atol=1e-12)
        np.testing.assert_allclose(r["conc"], conc, atol=1e-12)
    loose = estimate.shrink_posterior(study, local_scale=0.1)
    tight = estimate.shrink_posterior(study, local_scale=200.0)

    def gap(df):
        both = df.groupBy("clonotype").pivot("covariate", fx.COVARIATES).agg(F.first("p")).where("t0 is not null and t1 is not null")
        return both.agg(F.avg(F.abs(F.col("t0")[0] - F.col("t1")[0]))).first()[0]

    assert gap(tight) < 0.2 * gap(loose)        # a larger local scale leaves less covariate difference
    big = max(want, key=lambda k: want[k][1].sum())
    n = fx.crosstab(rows, big[1])[big[0]]
    assert np.abs(want[big][0] - n / n.sum()).max() < 0.1       # a large clone barely moves


def test_archetype_mixture(spark, rows, study):
    archetypes = np.array([[0.7, 0.1, 0.1, 0.1], [0.1, 0.1, 0.1, 0.7]])
    got = {(r["clonotype"], r["covariate"]): np.array(r["p"]) for r in
           estimate.shrink_posterior(study, archetypes=archetypes, global_scale=6.0, local_scale=2.0).collect()}
    pooled = {}
    for _, c, ph, *_ in rows:
        pooled.setdefault(c, np.zeros(4))[fx.PHENOTYPES.index(ph)] += 1
    for (c, t), p in got.items():
        ev = np.array([math.lgamma(6) - math.lgamma(6 + pooled[c].sum()) + sum(
            math.lgamma(n + 6 * a) - math.lgamma(6 * a) for n, a in zip(pooled[c], row)) for row in archetypes])
        w = np.exp(ev - ev.max())
        w /= w.sum()
        omega = sum(wi * (6 * row + pooled[c]) / (6 + pooled[c].sum()) for wi, row in zip(w, archetypes))
        conc = 2 * omega + fx.crosstab(rows, t)[c]
        np.testing.assert_allclose(p, conc / conc.sum(), atol=1e-9)
    with pytest.raises(ValueError, match="archetypes"):
        estimate.shrink_posterior(study, archetypes=np.ones((2, 3)))


def test_archetypes_are_clamped_and_on_the_simplex(study):
    n = len(fx.crosstab(fx.cell_rows(seed=21), "t0") | fx.crosstab(fx.cell_rows(seed=21), "t1"))
    with pytest.warns(UserWarning, match="archetypes requested"):
        centers, labelled = estimate.build_archetypes(study, k=n + 5)
    assert len(centers) <= n and labelled.count() == n
    np.testing.assert_allclose(centers.sum(axis=1), 1.0)
    single, _ = estimate.build_archetypes(study, k=1)
    np.testing.assert_allclose(single.sum(), 1.0)


def test_sharpening_keeps_the_magnitude(study):
    for temperature in (1.0, 0.5):
        out = estimate.sharpen(study.posterior, 4, temperature).collect()
        raw = {(r["clonotype"], r["covariate"]): np.array(r["conc"]) for r in study.posterior.collect()}
        for r in out:
            c = raw[r["clonotype"], r["covariate"]]
            assert sum(r["conc"]) == pytest.approx(c.sum(), rel=1e-3)
            np.testing.assert_allclose(r["p"], c ** (1 / temperature) / (c ** (1 / temperature)).sum(), atol=1e-9)


def test_predictions_follow_the_key_for_any_subset(study):
    whole = {r["cell_id"]: r["probs"] for r in evidence.predict(study).collect()}
    part = study.cells.where("phenotype = 'p1'").orderBy(F.col("cell_id").desc())
    for r in evidence.predict(study, part).collect():
        np.testing.assert_allclose(r["probs"], whole[r["cell_id"]], atol=1e-15)


def test_gate_endpoints(spark, rows):
    free, prior = fx.study(spark, rows, gate=1.0, fit=True), fx.study(spark, rows, gate=0.0, fit=True)
    for r in evidence.predict(free).limit(50).collect():
        np.testing.assert_allclose(r["probs"], np.exp(r["logits"]) / np.exp(r["logits"]).sum(), atol=1e-12)
    fit = fx.fitted(rows)
    for r in evidence.predict(prior).limit(50).collect():
        np.testing.assert_allclose(r["probs"], fit[r["clonotype"], r["covariate"]][0], atol=1e-6)


def test_evidence_frames(study):
    row = evidence.evidence_summary(study).first()
    assert row["kl_divergence"] >= 0 and 0 <= row["entropy"] <= math.log(4) and 0.25 <= row["confidence"] <= 1
    assert 0.5 < evidence.label_agreement(study).first()["agreement"] <= 1
    lp = evidence.log_posterior(study).first()
    assert len(lp["log_posterior"]) == 4


def test_learned_evidence(spark):
    rng = np.random.default_rng(2)
    rows = [(f"c{i}", f"k{i % 5}", f"p{i % 3}", [float(x) for x in rng.random(6) + 4.0 * (np.arange(6) == i % 3)]) for i in range(240)]
    cells = spark.createDataFrame(rows, "cell_id string, clonotype string, phenotype string, features array<double>")
    wanted = cells.where("phenotype = 'p0'").select("cell_id")
    latent = evidence.latent_representation(cells, k=3)
    assert evidence.latent_representation(cells, k=3, indices=wanted).count() == 80 and len(latent.first()["latent"]) == 3
    logits = evidence.phenotype_logits(latent, ["p0", "p1", "p2"])
    hit = evidence.hard_labels(logits, ["p0", "p1", "p2"], probs="logits").agg(F.avg((F.col("predicted") == F.col("phenotype")).cast("int")))
    assert hit.first()[0] > 0.95
    half = evidence.phenotype_logits(latent, ["p0", "p1", "p2"], temperature=2.0).orderBy("cell_id").first()
    np.testing.assert_allclose(np.array(half["logits"]) * 2, logits.orderBy("cell_id").first()["logits"], rtol=1e-6)
    for method in ("kmeans", "gmm"):
        r = evidence.cluster_nmi(cells, k=3, method=method, clone="phenotype" if method == "kmeans" else "clonotype").first()
        assert 0 <= r["nmi"] <= 1
    with pytest.raises(ValueError, match="method"):
        evidence.cluster_labels(cells, k=3, method="dbscan")


def test_joint_check(study, rows):
    out = diagnose.joint_distribution_ppc(study)
    model = fx.model_joint(rows)
    for r in out["table"].collect():
        n = fx.crosstab(rows, r["covariate"])[r["clonotype"]]
        assert r["distance"] == pytest.approx(np.abs(n / n.sum() - model[r["clonotype"], r["covariate"]]).sum(), abs=1e-9)
    assert out["per_covariate"].count() == 2


def test_calibration_bins_and_edges(spark):
    conf = [0.3, 0.30000000000000004, 0.5, 0.95, 1.0, 0.7]
    rows = [([c, 1 - c] if c >= 0.5 else [c, 0.2, 0.1], "a") for c in conf]
    df = spark.createDataFrame([(r[0] + [0.0] * (3 - len(r[0])), r[1]) for r in rows], "probs array<double>, phenotype string")
    out = diagnose.phenotype_calibration(df, ["a", "b", "c"])
    got = {r["bin"]: r for r in out["table"].collect()}
    top = np.array([max(r[0]) for r in rows])
    edges = np.linspace(0, 1, 11)
    want = [int(((top >= edges[b]) & ((top <= edges[b + 1]) if b == 9 else (top < edges[b + 1]))).sum()) for b in range(10)]
    assert [got[b]["count"] for b in range(10)] == want
    assert got[0]["mean_pred"] is None and got[0]["count"] == 0
    assert 0 <= out["ece"].first()["ece"] <= 1
    assert diagnose.phenotype_calibration(df.limit(0), ["a", "b", "c"])["ece"].first()["ece"] == 0.0


def test_count_tables(spark):
    rng = np.random.default_rng(3)
    observed, sims = rng.poisson(0.7, (9, 5)), rng.poisson(1.1, (3, 9, 5))

    def long(x, *head):
        return [(*head, f"c{i}", f"g{j}", float(v)) for (i, j), v in np.ndenumerate(x) if v]

    df = spark.createDataFrame(long(observed), "cell_id string, feature string, count double")
    sim = spark.createDataFrame([r for s in range(3) for r in long(sims[s], s)], "sim int, cell_id string, feature string, count double")
    got = {r["statistic"]: r for r in diagnose.compare_count_tables(df, sim, n_cells=9, n_features=5).collect()}
    lib = observed.sum(1)
    want = {
        "mean_library_size": (lib.mean(), sims.sum(2).mean()), "median_library_size": (np.median(lib), np.mean([np.median(s.sum(1)) for s in sims])),
        "dropout_fraction": ((observed == 0).mean(), (sims == 0).mean()), "mean_expression": (observed.mean(), sims.mean()),
        "var_expression": (observed.var(), np.mean([s.var() for s in sims])),
    }
    for k, (o, s) in want.items():
        assert (got[k]["observed"], got[k]["simulated"]) == (pytest.approx(o), pytest.approx(s))
        assert got[k]["discrepancy"] == pytest.approx(abs(o - s))


def test_plot_frames(study):
    kw = dict(source="counts", weighted=True)
    entropy = metrics.phenotypic_entropy(study, covariate="t0", splitby="response", **kw)
    args = dict(groupby="patient", item="clonotype")
    assert frames.sample_unit(entropy["result"], entropy["table"], x="response", **args) == "replicate"
    assert frames.sample_unit(entropy["result"], entropy["table"], x="patient", **args) == "item"
    drawn = metrics.mutual_information(study, covariate="t0", n_samples=3)
    assert frames.sample_unit(drawn["result"], drawn["table"], x="patient", groupby="patient", item=None) == "draw"
    single = metrics.mutual_information(study, covariate="t0", **kw)
    assert frames.sample_unit(single["result"], single["table"], x="patient", groupby="patient", item=None) is None
    dots = frames.points(entropy["result"], groupby="patient", keep=["response"])
    assert dots.count() == 6 and set(dots.columns) == {"patient", "response", "value"}
    label = frames.contrast_label(entropy["stats"], "R", "NR").first()
    assert label["label"] and frames.contrast_label(entropy["stats"], "R", "X").count() == 0
    order = [r["median"] for r in frames.order_by_median(entropy["result"], "patient").collect()]
    assert order == sorted(order, reverse=True)


def test_estimator_errors(spark):
    df = spark.createDataFrame([("a", 0.5, 0.4, 0.6, 0.4, 0.7), ("a", 0.2, 0.2, 0.1, 0.15, 0.3)],
                               "k string, value double, population double, realised double, hdi_low double, hdi_high double")
    r = diagnose.estimator_errors(df, ["k"]).first()
    assert (r["mae_population"], r["mae_realised"], r["hdi_coverage"]) == (pytest.approx(0.05), pytest.approx(0.1), 0.5)


def test_long_and_short_clone_lists_select_alike(spark):
    from couplet.operators.shared import SHORT_LIST, clone_filter
    cells = spark.range(500).withColumnRenamed("id", "clonotype")
    for n in (SHORT_LIST, SHORT_LIST + 1):
        assert clone_filter(cells, [str(i) for i in range(n)]).count() == n
        assert clone_filter(cells, list(range(n))).count() == n


def test_lookup_of_map_columns_and_equal_hot_rows(spark, monkeypatch):
    """Maps cannot be hashed, and equal rows of a hot key must still spread over several salts."""
    facts = spark.range(0, 8000, 1, 8).select(F.lit("hot").alias("k"), F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    dim = spark.createDataFrame([("hot", 8000, 7), *[(f"c{i}", 1, i) for i in range(50)]], "k string, w long, v int")
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    out = shared.lookup_join(facts, dim, ["k"], "w", salt_column="s").collect()
    assert len(out) == 8000 and {r["v"] for r in out} == {7}
    assert len({r["s"] for r in out}) > 1


def test_hot_limit_is_bounded_by_a_task():
    side = shared.LookupSide(10**9, 10**12, False, 256)
    assert side.hot_limit == shared.TASK_ROWS
    assert 10**12 / side.hot_limit * 256 <= shared.BROADCAST_BYTES
    assert shared.LookupSide(10, 5120, False).hot_limit == 10


def test_quantile_paths_agree_on_null_groups(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 2.0), (None, 4.0)], "k string, value double")
    def both(call):
        small = call(5)
        monkeypatch.setattr(ranks, "WINDOW_ROWS", 1)
        monkeypatch.setattr(summarise, "WINDOW_ROWS", 1)
        large = call(None)
        monkeypatch.undo()
        return small, large
    for call in (lambda n: {tuple(r) for r in ranks.exact_quantiles(df, "value", ["k"], (0.5,), ("q",), rows=n).collect()},
                 lambda n: {tuple(r) for r in summarise.across_groups(df, ["k"], rows=n).collect()}):
        small, large = ({r[0]: [None if v is None else round(v, 9) for v in r[1:]] for r in rows} for rows in both(call))
        assert small == large and set(large) == {"a", "b", None}


def test_repeated_clone_labels_count_cells_once(spark):
    rows = fx.cell_rows()
    cells = spark.createDataFrame(rows, fx.SCHEMA).drop("response")
    labels = spark.createDataFrame(sorted({(r[1], r[5]) for r in rows}) * 2, "clone string, response string")
    def registered(labels):
        return register_cells(cells, clonotype_key="clone", phenotype_key="pheno", covariate_key="time",
                              replicate="patient", clone_labels=labels)
    ct = registered(labels).counts("patient", "response")
    assert ct.agg(F.sum("n_cells")).first()[0] == len(rows)
    mixed = labels.unionByName(labels.limit(1).withColumn("response", F.lit("other")))
    with pytest.raises(ValueError, match="not constant"):
        registered(mixed).counts("patient", "response")


def test_rows_without_a_score_are_named(spark):
    df = spark.createDataFrame([(0.1, 0), (0.9, 1), (None, 1), (0.5, None)], "s double, y int")
    with pytest.warns(UserWarning, match="2 rows have no score"):
        assert auc.auroc(df, "s", "y").first()["auc"] == 1.0


def test_unlisted_clones_need_no_logits(spark):
    """A listed and a tabled selection agree: only the cells of listed clones must carry logits."""
    rows = [(*r[:6], None if r[1] == "c0@0" else r[6]) for r in fx.cell_rows()]
    fitted = fx.study(spark, rows, fit=True)
    wanted = sorted({r[1] for r in rows} - {"c0@0"})
    table = spark.createDataFrame([(c,) for c in wanted], "clonotype string")
    for n_samples in (0, 2):
        by_list, by_table = (joint.joint_table(fitted, clones=c, n_samples=n_samples, random_state=1).count()
                             for c in (wanted, table))
        assert by_list == by_table > 0
