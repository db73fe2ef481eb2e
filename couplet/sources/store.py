"""Results as parquet frames next to the parameters that produced them."""

from __future__ import annotations

import functools
import inspect
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import couplet

FRAMES = ("table", "result", "stats")

# Frames a stored result must hold, and the columns its ``result`` frame must have.
_SPREAD = ("value", "sd", "hdi_low", "hdi_high")
SCHEMAS: dict[str, tuple[str, ...]] = {
    "joint_distribution": ("clonotype",),
    "mutual_information": ("covariate", *_SPREAD),
    "clonotypic_entropy": ("covariate", "phenotype", *_SPREAD),
    "phenotypic_entropy": ("covariate", "clonotype", *_SPREAD),
    "phenotypic_flux": ("cov_from", "cov_to", "clonotype", *_SPREAD),
    "delta_clonotypic_entropy": ("cov_from", "cov_to", "phenotype", *_SPREAD, "value_from", "value_to"),
    "delta_phenotypic_entropy": ("cov_from", "cov_to", "clonotype", *_SPREAD, "value_from", "value_to"),
}
_NOT_PARAMS = ("store", "key_added", "inplace")


def check_schema(tool: str, payload: dict) -> None:
    """Required frames and columns are present, or ``ValueError``."""
    missing = [f for f in ("table", "result") if payload.get(f) is None]
    if missing:
        raise ValueError(f"{tool}: result lacks frames {missing}")
    lacking = sorted(set(SCHEMAS.get(tool, ())) - set(payload["result"].columns))
    if lacking:
        raise ValueError(f"{tool}: result frame lacks columns {lacking}")


def jsonable(x):
    """A JSON-safe copy of call arguments."""
    if x is None or isinstance(x, (str, int, float, bool)):
        return x
    if isinstance(x, dict):
        return {str(k): jsonable(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [jsonable(v) for v in x]
    if isinstance(x, DataFrame):
        return {"dataframe": x.schema.simpleString()}
    return getattr(x, "__name__", None) or str(x)


class ResultStore:
    """A folder of stored results: one sub-folder per key, one parquet table per frame."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _folder(self, key: str) -> str:
        if not key or "/" in key or key in (".", ".."):
            raise ValueError(f"result key {key!r} must be a plain name")
        return f"{self.path}/{key}"

    def save(self, key: str, payload: dict, params: dict) -> None:
        """Replace what the key held. Frames go to a fresh sub-folder, which the parameter row, written last, names.

        A save that stops half-way leaves the earlier result as it was; frames of earlier saves stay on disk.
        """
        folder = self._folder(key)
        present = [f for f in FRAMES if payload.get(f) is not None]
        part = f"save-{uuid.uuid4().hex}"
        stored = {"params": jsonable(params), "version": couplet.__version__, "frames": present, "part": part}
        for frame in present:
            payload[frame].write.mode("errorifexists").parquet(f"{folder}/{part}/{frame}")
        self.spark.createDataFrame([(json.dumps(stored, sort_keys=True),)], "payload string") \
            .coalesce(1).write.mode("overwrite").json(f"{folder}/provenance")

    def provenance(self, key: str) -> dict:
        try:
            row = self.spark.read.schema("payload string").json(f"{self._folder(key)}/provenance").first()
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            row = None
        if row is None:
            raise KeyError(key)
        return json.loads(row["payload"])

    def frame(self, key: str, which: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder(key)}/{self.provenance(key)['part']}/{which}")


def stored_result(tool: str) -> Callable:
    """Write a metric's frames and its full parameters (defaults included) when a store is given.

    Parameters the call resolved itself (effective ``groupby``, seed) are recorded as used.
    ``inplace=False`` skips the write; ``key_added`` renames the result.
    """
    def wrap(metric: Callable) -> Callable:
        signature = inspect.signature(metric)

        @functools.wraps(metric)
        def call(study, **options):
            bound = signature.bind(study, **options)
            bound.apply_defaults()
            payload = metric(study, **options)
            resolved = payload.get("resolved", {})
            check_schema(tool, payload)
            target = bound.arguments.get("store")
            if target is not None and bound.arguments.get("inplace", True):
                params = {k: v for k, v in list(bound.arguments.items())[1:] if k not in _NOT_PARAMS}
                params.update(resolved)
                key = bound.arguments.get("key_added") or tool
                target.save(key, payload, params)
                for name in FRAMES:
                    if payload.get(name) is not None:
                        payload[name] = target.frame(key, name)
            return payload

        return call

    return wrap


# -- accessors --------------------------------------------------------------------------------------

def _locate(store: ResultStore, name: str, key: str | None) -> tuple[str, dict]:
    if key is None and name not in SCHEMAS:
        raise KeyError(f"unknown result {name!r}; expected one of {sorted(SCHEMAS)}, or pass key= for a custom name")
    where = key or name
    try:
        return where, store.provenance(where)
    except KeyError:
        extra = f", key_added={key!r}" if key is not None else ""
        raise KeyError(f"no stored result {where!r}; run {name}(study, ..., store=store{extra}) first") from None


def result(store: ResultStore, name: str, *, key: str | None = None) -> dict:
    """All frames of a stored result, without provenance."""
    where, stored = _locate(store, name, key)
    return {f: (store.frame(where, f) if f in stored["frames"] else None) for f in FRAMES}


def params(store: ResultStore, name: str, *, key: str | None = None) -> dict:
    """Every argument the stored result was computed with."""
    return _locate(store, name, key)[1].get("params", {})


def table(store: ResultStore, name: str, *, key: str | None = None, which: str = "result") -> DataFrame:
    """One frame of a stored result: ``result`` (reduced), ``table`` (per draw) or ``stats``."""
    where, stored = _locate(store, name, key)
    if which not in stored["frames"]:
        raise KeyError(f"stored result {name!r} has no {which!r} frame (present: {stored['frames']})")
    return store.frame(where, which)


def _shortcut(name: str) -> Callable[..., DataFrame]:
    def read(store: ResultStore, *, key: str | None = None, which: str = "result") -> DataFrame:
        return table(store, name, key=key, which=which)

    read.__name__ = name
    read.__doc__ = f"Stored ``{name}`` frame."
    return read


joint_distribution = _shortcut("joint_distribution")
mutual_information = _shortcut("mutual_information")
clonotypic_entropy = _shortcut("clonotypic_entropy")
phenotypic_entropy = _shortcut("phenotypic_entropy")
phenotypic_flux = _shortcut("phenotypic_flux")
delta_clonotypic_entropy = _shortcut("delta_clonotypic_entropy")
delta_phenotypic_entropy = _shortcut("delta_phenotypic_entropy")
