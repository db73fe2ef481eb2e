import numpy as np
import pytest
from pyspark.sql import functions as F

from couplet.functions.sampling import dirichlet_draws, fold_cells
from couplet.operators import evidence, joint, metrics, shared
from couplet.spec import register_cells
from tests import fixtures as fx


def as_dict(df, *keys):
    return {tuple(r[k] for k in keys): np.array(r["mass"]) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    return fx.cell_rows()


@pytest.fixture(scope="module")
def fitted(spark, rows):
    return fx.study(spark, rows, fit=True)


@pytest.mark.parametrize("options", [{}, {"weighted": True}, {"temperature": 0.5}])
def test_cell_informed_matches_loop(fitted, rows, options):
    got = as_dict(joint.joint_table(fitted, **options), "clonotype", "covariate")
    want = fx.model_joint(rows, **options)
    assert got.keys() == want.keys()
    for k in want:
        np.testing.assert_allclose(got[k], want[k], atol=1e-12)


@pytest.mark.parametrize("gate", [0.0, 0.3, 1.0])
def test_gate(spark, rows, gate):
    got = as_dict(joint.joint_table(fx.study(spark, rows, gate=gate, fit=True)), "clonotype", "covariate")
    want = fx.model_joint(rows, gate=gate)
    for k in want:
        np.testing.assert_allclose(got[k], want[k], atol=1e-12)


def test_gate_bounds(spark, rows):
    with pytest.raises(ValueError, match="gate"):
        fx.study(spark, rows, gate=1.5)


def test_pair_level_equals_posterior(fitted, rows):
    got = as_dict(joint.joint_table(fitted, use_logits=False), "clonotype", "covariate")
    for k, (p, _) in fx.fitted(rows).items():
        np.testing.assert_allclose(got[k], p, atol=1e-12)


def test_joint_is_mean_of_predictions(fitted):
    probs = evidence.predict(fitted).select("clonotype", "covariate", F.posexplode("probs").alias("j", "q"))
    means = {(r["clonotype"], r["covariate"], r["j"]): r["m"]
             for r in probs.groupBy("clonotype", "covariate", "j").agg(F.avg("q").alias("m")).collect()}
    for (c, t), v in as_dict(joint.joint_table(fitted), "clonotype", "covariate").items():
        np.testing.assert_allclose(v, [means[c, t, j] for j in range(4)], atol=1e-9)


def test_weighted_rows_sum_to_cells(fitted):
    cells = {(r["clonotype"], r["covariate"]): r["n_cells"] for r in fitted.counts().collect()}
    for k, v in as_dict(joint.joint_table(fitted, weighted=True), "clonotype", "covariate").items():
        assert v.sum() == pytest.approx(cells[k])


def test_draws_shared_across_calls_and_subsets(fitted):
    kw = dict(n_samples=5, random_state=3)
    everything = as_dict(joint.joint_table(fitted, **kw), "clonotype", "covariate", "draw")
    one = as_dict(joint.joint_table(fitted, covariate="t1", clones=["c1@0", "c2@1"], **kw), "clonotype", "covariate", "draw")
    assert one
    for k, v in one.items():
        np.testing.assert_allclose(v, everything[k], atol=1e-12)
    other = as_dict(joint.joint_table(fitted, n_samples=5, random_state=4), "clonotype", "covariate", "draw")
    assert any(not np.allclose(other[k], everything[k]) for k in everything)


def test_draws_centre_on_base(fitted, rows):
    result = joint.joint_distribution(fitted, covariate="t0", n_samples=600, use_logits=False, random_state=1)["result"]
    got = {r["clonotype"]: np.array([r[p] for p in fx.PHENOTYPES]) for r in result.collect()}
    for (c, t), (p, conc) in fx.fitted(rows).items():
        if t == "t0":
            sd = np.sqrt(p * (1 - p) / (conc.sum() + 1) / 600)
            assert (np.abs(got[c] - p) < 6 * sd + 1e-3).all()


def test_more_cells_narrow_the_draws():
    spread = [dirichlet_draws(n * np.array([0.5, 0.3, 0.2]), 2000, 1, 1).std(axis=0).max() for n in (3, 30, 300)]
    assert spread[0] > spread[1] > spread[2]


def test_tiny_concentrations_stay_on_the_simplex():
    d = dirichlet_draws(np.full(6, 1e-3), 500, 0, 9)
    assert np.isfinite(d).all()
    np.testing.assert_allclose(d.sum(axis=1), 1.0)


@pytest.mark.parametrize("weight", [1.0, 2.0, 200.0])
def test_fold_is_a_sum_of_softmaxes(weight):
    rng = np.random.default_rng(0)
    draws, logits = rng.dirichlet(np.ones(4) * 0.2, 7), rng.normal(size=(11, 4)) * 3
    x = weight * logits[None] + weight * np.log(draws + 1e-8)[:, None]
    x = np.exp(x - x.max(-1, keepdims=True))
    want = (x / x.sum(-1, keepdims=True)).sum(1)
    np.testing.assert_allclose(fold_cells(draws, logits, weight, weight, 1e-8), want, atol=1e-9)


@pytest.mark.parametrize("n_samples", [0, 4])
def test_salted_lookup_equals_broadcast(spark, rows, monkeypatch, n_samples):
    """One clone holds a third of all cells; the shuffled, salted lookup gives the same joint."""
    hot = [(f"h{i}", "c0@0", fx.PHENOTYPES[i % 4], "t0", "P0", "NR", [0.1 * (i % 7), 0.0, 0.2, -0.1]) for i in range(400)]
    want = as_dict(joint.joint_table(fx.study(spark, rows + hot, fit=True), n_samples=n_samples, random_state=5),
                   "clonotype", "covariate", "draw")
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(shared, "HOT_SHARE", 20)
    got = as_dict(joint.joint_table(fx.study(spark, rows + hot, fit=True), n_samples=n_samples, random_state=5),
                  "clonotype", "covariate", "draw")
    assert got.keys() == want.keys()
    for k in want:
        np.testing.assert_allclose(got[k], want[k], atol=1e-9)


def test_many_phenotypes_take_the_long_path(spark):
    names = [f"k{i:03d}" for i in range(140)]
    rows = fx.cell_rows(phenotypes=names, n_patients=2)
    study = fx.study(spark, rows, phenotypes=names, fit=True)
    got = as_dict(joint.joint_table(study), "clonotype", "covariate")
    want = fx.model_joint(rows, phenotypes=names)
    for k in want:
        np.testing.assert_allclose(got[k], want[k], atol=1e-9)
    mi = metrics.mutual_information(study, covariate="t0", source="counts", weighted=True, normalized=False)
    for r in mi["result"].collect():
        table = np.array(list(fx.crosstab(rows, "t0", r["patient"], names).values()))
        assert r["value"] == pytest.approx(fx.information(table), abs=1e-9)
    flux = metrics.phenotypic_flux(study, cov_from="t0", cov_to="t0", source="counts")
    assert flux["table"].agg(F.max(F.abs("value"))).first()[0] == 0.0


def test_requested_clone_order(fitted):
    asked = ["c3@1", "missing", "c0@0"]
    got = [r["clonotype"] for r in joint.joint_distribution(fitted, covariate="t0", clones=asked)["result"].collect()]
    assert got == [c for c in asked if c != "missing"]


def test_wide_and_long_shapes(fitted):
    out = joint.joint_distribution(fitted, n_samples=2, random_state=0)
    assert out["table"].columns == ["covariate", "clonotype", "sample_id", *fx.PHENOTYPES]
    assert out["result"].columns == ["covariate", "clonotype", *fx.PHENOTYPES]
    assert out["resolved"]["n_draws"] == 2


def test_guards(spark, rows, fitted):
    with pytest.raises(ValueError, match="not found among"):
        joint.joint_table(fitted, covariate="t9")
    with pytest.raises(RuntimeError, match="local scale"):
        joint.joint_table(fitted.replace(local_scale=None), n_samples=2)
    with pytest.raises(RuntimeError, match="no posterior"):
        joint.joint_table(fx.study(spark, rows))
    bare = fitted.replace(cells=fitted.cells.drop("logits"))
    with pytest.raises(RuntimeError, match="logits"):
        joint.joint_table(bare)
    with pytest.raises(ValueError, match="not a column"):
        register_cells(fitted.cells, clonotype_key="nope", phenotype_key="phenotype", covariate_key="covariate")


def test_non_finite_probabilities_become_uniform_entries(spark, rows, fitted):
    nan = float("nan")
    broken = fitted.posterior.withColumn("p", F.array(F.lit(nan), F.col("p")[1], F.lit(None).cast("double"), F.col("p")[3]))
    got = as_dict(joint.joint_table(fitted.with_posterior(broken, 3.0, check=False), use_logits=False), "clonotype", "covariate")
    for k, (p, _) in fx.fitted(rows).items():
        np.testing.assert_allclose(got[k], [0.25, p[1], 0.25, p[3]], atol=1e-12)


def test_cells_without_logits_fail_instead_of_vanishing(spark, rows):
    study = fx.study(spark, rows, fit=True)
    some = study.cells.select("cell_id", "logits").where("cell_id <> '0-0'")
    partial = study.replace(cells=study.cells.drop("logits")).with_evidence(some)
    assert partial.cells.count() == len(rows)
    for n in (0, 2):
        with pytest.raises(Exception, match="no logits vector"):
            joint.joint_table(partial, n_samples=n).collect()
    with pytest.raises(Exception, match="no logits vector"):
        evidence.predict(partial).collect()


def test_lookup_shuffles_into_the_asked_number_of_tasks(spark):
    from couplet.operators.shared import LookupSide, lookup_join, materialise
    facts = spark.range(200).selectExpr("id % 20 as k", "id as v")
    dim = materialise(facts.groupBy("k").count().withColumnRenamed("count", "n"))
    side = LookupSide(20, 200, False, 256, 10)
    joined = lookup_join(facts, dim, ["k"], "n", side=side, salt_column="__salt", tasks=37).repartition(37, "k", "__salt")
    assert joined.count() == 200 and joined.rdd.getNumPartitions() == 37
