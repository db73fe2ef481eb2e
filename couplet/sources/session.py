"""Saving and restoring a study: tables as parquet, roles and category order as JSON."""

from __future__ import annotations

import json
import warnings
from dataclasses import asdict

import pyspark
from pyspark.sql import DataFrame, SparkSession, functions as F

import couplet
from couplet.spec import CELL_ID, CLONE, COVARIATE, PHENOTYPE, CouplingSpec, Study, levels_of


def _write_json(spark: SparkSession, path: str, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "payload string") \
        .coalesce(1).write.mode("overwrite").json(path)


def _read_json(spark: SparkSession, path: str) -> dict | None:
    try:
        row = spark.read.schema("payload string").json(path).first()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    return json.loads(row["payload"]) if row else None


def save_session(study: Study, path: str, *, features: DataFrame | None = None, save_cells: bool = True,
                 compression: str = "snappy") -> dict[str, str]:
    """Write the study under ``path`` and return the paths written.

    ``features`` is the optional long count table (``cell_id, feature, count``); its feature
    names are fingerprinted in the metadata.
    """
    spark, path = study.spark, path.rstrip("/")
    paths: dict[str, str] = {}

    def put(name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").option("compression", compression).parquet(f"{path}/{name}")
        paths[name] = f"{path}/{name}"

    if save_cells:
        put("cells", study.cells)
    if study.clone_labels is not None:
        put("clone_labels", study.clone_labels)
    if study.posterior is not None:
        put("posterior", study.posterior)
    if features is not None:
        put("features", features)
    setup = {
        "spec": asdict(study.spec), "phenotypes": list(study.phenotypes), "covariates": list(study.covariates),
        "local_scale": study.local_scale, "gate": study.gate,
        "classifier_temperature": study.classifier_temperature, "tables": sorted(paths),
    }
    meta = {"n_cells": study.cells.count(), "couplet": couplet.__version__, "pyspark": pyspark.__version__}
    if features is not None:
        names = features.select("feature").distinct()
        row = names.agg(F.count(F.lit(1)).alias("n"),
                        F.sum(F.xxhash64("feature").cast("decimal(38,0)")).alias("h")).first()
        meta.update(n_features=row["n"], feature_hash=str(row["h"]))
    _write_json(spark, f"{path}/meta", meta)
    _write_json(spark, f"{path}/setup", setup)      # last: it names the tables that belong to this save
    paths.update(setup=f"{path}/setup", meta=f"{path}/meta")
    return paths


def load_session(spark: SparkSession, path: str, *, cells_path: str | None = None) -> Study:
    """Restore a study with its roles, replicate and category order.

    Without the setup record the saved cell table's role columns are used, with a warning and
    sorted category order.
    """
    path = path.rstrip("/")
    try:
        cells = spark.read.parquet(cells_path or f"{path}/cells")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"no cell table at {cells_path or path + '/cells'}") from None
        raise

    setup = _read_json(spark, f"{path}/setup")

    def optional(name: str) -> DataFrame | None:
        if setup is not None and name not in setup.get("tables", [name]):
            return None         # left over from an earlier save
        try:
            return spark.read.parquet(f"{path}/{name}")
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise

    if setup is None:
        warnings.warn("no setup record; inferring roles and category order from the cell table", stacklevel=2)
        spec = CouplingSpec(CLONE, PHENOTYPE, COVARIATE, CELL_ID if CELL_ID in cells.columns else None)
        setup = {"phenotypes": levels_of(cells, PHENOTYPE), "covariates": levels_of(cells, COVARIATE)}
    else:
        spec = CouplingSpec(**setup["spec"])
    return Study(
        spec=spec, cells=cells, clone_labels=optional("clone_labels"), posterior=optional("posterior"),
        phenotypes=tuple(setup["phenotypes"]), covariates=tuple(setup["covariates"]),
        local_scale=setup.get("local_scale"), gate=setup.get("gate"),
        classifier_temperature=setup.get("classifier_temperature", 1.0),
    )


def session_meta(spark: SparkSession, path: str) -> dict:
    """The metadata record of a saved session."""
    meta = _read_json(spark, f"{path.rstrip('/')}/meta")
    if meta is None:
        raise FileNotFoundError(f"no session metadata under {path}")
    return meta
