import numpy as np
import pytest
from pyspark.sql import functions as F

from couplet.operators import joint, metrics
from couplet.sources import session, store, tables
from tests import fixtures as fx

COUNTS = dict(source="counts", weighted=True)


@pytest.fixture(scope="module")
def study(spark):
    return fx.study(spark, fit=True)


def test_store_round_trip(spark, study, tmp_path):
    kept = store.ResultStore(spark, str(tmp_path / "r"))
    out = metrics.mutual_information(study, covariate="t0", splitby="response", store=kept, n_samples=3, random_state=5)
    again = store.result(kept, "mutual_information")
    for frame in store.FRAMES:
        assert sorted(map(tuple, out[frame].collect()), key=str) == sorted(map(tuple, again[frame].collect()), key=str)
    params = store.params(kept, "mutual_information")
    # defaults and resolved values are recorded, plumbing is not
    assert params["groupby"] == "patient" and params["temperature"] == 1.0 and params["random_state"] == 5
    assert not {"store", "key_added", "inplace"} & set(params)
    assert store.mutual_information(kept, which="table").count() == 18
    assert store.table(kept, "mutual_information").columns == store.mutual_information(kept).columns


def test_store_replaces_renames_and_skips(spark, study, tmp_path):
    kept = store.ResultStore(spark, str(tmp_path / "r"))
    metrics.phenotypic_entropy(study, covariate="t0", store=kept, inplace=False, **COUNTS)
    with pytest.raises(KeyError, match=r"run phenotypic_entropy\(study"):
        store.phenotypic_entropy(kept)
    metrics.phenotypic_entropy(study, covariate="t0", store=kept, key_added="mine", **COUNTS)
    metrics.phenotypic_entropy(study, covariate="t1", store=kept, key_added="mine", **COUNTS)
    got = store.phenotypic_entropy(kept, key="mine")
    assert [r[0] for r in got.select("covariate").distinct().collect()] == ["t1"]
    with pytest.raises(KeyError, match="no 'stats' frame"):
        store.table(kept, "phenotypic_entropy", key="mine", which="stats")
    with pytest.raises(KeyError, match="unknown result"):
        store.table(kept, "nothing")
    with pytest.raises(ValueError, match="plain name"):
        kept.frame("a/b", "table")


def test_stored_joint_and_a_save_that_stops(spark, study, tmp_path):
    kept = store.ResultStore(spark, str(tmp_path / "r"))
    out = joint.joint_distribution(study, covariate="t0", store=kept)
    stored = sorted(map(tuple, store.joint_distribution(kept).collect()))
    assert stored == sorted(map(tuple, out["result"].collect())) and stored
    broken = spark.range(1).select(F.raise_error(F.lit("lost")).cast("string").alias("clonotype"))
    with pytest.raises(Exception, match="lost"):
        kept.save("joint_distribution", {"table": broken, "result": broken}, {})
    assert sorted(map(tuple, store.joint_distribution(kept).collect())) == stored


def test_stats_frame_leaves_with_its_split(spark, study, tmp_path):
    """A re-run without a split no longer offers the older contrast."""
    kept = store.ResultStore(spark, str(tmp_path / "r"))
    metrics.mutual_information(study, covariate="t0", splitby="response", store=kept, **COUNTS)
    metrics.mutual_information(study, covariate="t0", store=kept, **COUNTS)
    assert store.result(kept, "mutual_information")["stats"] is None


def test_schema_check(spark):
    frame = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError, match="lacks frames"):
        store.check_schema("mutual_information", {"table": frame})
    with pytest.raises(ValueError, match="lacks columns"):
        store.check_schema("mutual_information", {"table": frame, "result": frame})


def test_session_round_trip(spark, study, tmp_path):
    path = str(tmp_path / "s")
    order = ("p3", "p1", "p0", "p2")
    reordered = fx.study(spark, phenotypes=list(order), gate=0.4, fit=True)
    features = spark.createDataFrame([("0-1", "g1", 2.0), ("0-1", "g2", 1.0)], "cell_id string, feature string, count double")
    paths = session.save_session(reordered, path, features=features)
    assert set(paths) == {"cells", "posterior", "features", "setup", "meta"}
    back = session.load_session(spark, path)
    assert back.phenotypes == order and back.spec == reordered.spec and back.gate == 0.4 and back.local_scale == 3.0
    a = metrics.mutual_information(reordered, covariate="t0")["result"].orderBy("patient").collect()
    b = metrics.mutual_information(back, covariate="t0")["result"].orderBy("patient").collect()
    assert [r["value"] for r in a] == pytest.approx([r["value"] for r in b], abs=1e-12)
    meta = session.session_meta(spark, path)
    assert meta["n_cells"] == 720 and meta["n_features"] == 2 and meta["feature_hash"]
    with pytest.raises(FileNotFoundError):
        session.load_session(spark, str(tmp_path / "absent"))


def test_session_without_setup_is_inferred(spark, study, tmp_path):
    study.cells.write.parquet(str(tmp_path / "x" / "cells"))
    with pytest.warns(UserWarning, match="no setup record"):
        back = session.load_session(spark, str(tmp_path / "x"))
    assert back.phenotypes == tuple(fx.PHENOTYPES)


def test_posterior_checks(spark, study):
    good = study.posterior
    for column, value, message in [
        ("p", F.slice("p", 1, 3), "entries"), ("conc", F.slice("conc", 1, 3), "length differs"),
        ("p", F.transform("p", lambda x: x * 2), "sum to 1"), ("p", F.array(F.lit(-0.5), F.lit(0.5), F.lit(0.5), F.lit(0.5)), "negative"),
    ]:
        with pytest.raises(ValueError, match=message):
            study.with_posterior(good.withColumn(column, value), 3.0)
    with pytest.raises(ValueError, match="posterior has no such row"):
        study.with_posterior(good.where("covariate = 't0'"), 3.0)
    with pytest.raises(ValueError, match="lacks columns"):
        study.with_posterior(good.drop("p"), 3.0)


def test_import_and_export(spark, study, tmp_path):
    out = tables.export_tables(study)
    assert set(out) == {"phenotypes", "covariates", "registry", "posterior", "evidence"}
    out["posterior"].write.parquet(str(tmp_path / "p"))
    out["evidence"].write.parquet(str(tmp_path / "e"))
    bare = fx.study(spark)
    bare = bare.replace(cells=bare.cells.drop("logits"))
    full = tables.import_evidence(tables.import_posterior(bare, str(tmp_path / "p"), local_scale=3.0), str(tmp_path / "e"))
    key = ["covariate", "clonotype"]
    a = joint.joint_table(study).orderBy(*key).collect()
    b = joint.joint_table(full).orderBy(*key).collect()
    for x, y in zip(a, b, strict=True):
        np.testing.assert_allclose(x["mass"], y["mass"], atol=1e-9)


def test_draws_without_concentration_use_the_local_scale(study):
    bare = study.with_posterior(study.posterior.drop("conc"), local_scale=3.0)
    wide = joint.joint_table(bare, n_samples=200, use_logits=False, random_state=1)
    tight = joint.joint_table(study, n_samples=200, use_logits=False, random_state=1)
    sd = lambda df: df.groupBy("clonotype", "covariate").agg(F.stddev(F.col("mass")[0]).alias("s")).agg(F.avg("s")).first()[0]
    assert sd(wide) > 1.5 * sd(tight)


def test_dictionaries_keep_declared_order(spark, study):
    rows = tables.dictionary(fx.study(spark, phenotypes=["p2", "p0", "p3", "p1", "unused"]), "phenotype").collect()
    assert [(r["label"], r["ordinal"]) for r in rows] == [("p2", 0), ("p0", 1), ("p3", 2), ("p1", 3), ("unused", 4)]
    clones = [r["label"] for r in tables.dictionary(study, "clonotype").orderBy("ordinal").collect()]
    assert clones == sorted(clones) and len(clones) == len({r[1] for r in fx.cell_rows()})
    with pytest.raises(ValueError, match="axis"):
        tables.dictionary(study, "gene")


def test_load_cells_turns_nan_into_null(spark, tmp_path):
    spark.createDataFrame([(1, float("nan")), (2, 0.5)], "id int, x double").write.parquet(str(tmp_path / "c"))
    got = {r["id"]: r["x"] for r in tables.load_cells(spark, str(tmp_path / "c")).collect()}
    assert got == {1: None, 2: 0.5}
    spark.createDataFrame([("a", 1)], "k string, v int").write.option("header", True).csv(str(tmp_path / "v"))
    assert tables.load_cells(spark, str(tmp_path / "v"), "csv", header=True).first()["k"] == "a"


def test_duplicate_posterior_rows_are_refused(spark, study):
    with pytest.raises(ValueError, match="2 rows for"):
        study.with_posterior(study.posterior.unionByName(study.posterior), 3.0)


def test_duplicate_evidence_fails_the_job(spark, study):
    once = study.cells.select("cell_id", "logits")
    assert study.with_evidence(once).cells.count() == study.cells.count()
    with pytest.raises(Exception, match="two rows for one cell id"):
        study.with_evidence(once.unionByName(once.limit(1))).cells.select("logits").collect()


def test_resaved_session_forgets_the_old_fit(spark, study, tmp_path):
    path = str(tmp_path / "again")
    session.save_session(study, path)
    assert session.load_session(spark, path).posterior is not None
    session.save_session(fx.study(spark), path)
    assert session.load_session(spark, path).posterior is None
