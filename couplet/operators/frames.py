"""Frames a plot needs, derived from stored results with the same collapse the tests use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from couplet.operators.ranks import exact_quantiles
from couplet.operators.summarise import collapse_to_replicates
from couplet.spec import CLONE


def _varies(df: DataFrame | None, column: str | None, x: str | None) -> bool:
    """Whether more than one value of ``column`` occurs at some x position (min and max differ)."""
    if df is None or column is None or column not in df.columns:
        return False
    grouped = df.groupBy(x) if x is not None and x in df.columns else df.groupBy()
    spread = grouped.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    return bool(spread.where("lo <> hi").limit(1).collect())


def sample_unit(result: DataFrame, table: DataFrame | None = None, *, x: str | None, groupby: str | None,
                item: str | None) -> str | None:
    """Coarsest unit varying within an x position: ``replicate``, ``item``, ``draw`` or None."""
    if groupby != x and _varies(result, groupby, x):
        return "replicate"
    if item != x and _varies(result, item, x):
        return "item"
    if _varies(table, "draw", None):
        return "draw"
    return None


def points(result: DataFrame, *, groupby: str | None, keep: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Defined values, one per replicate, with the axes about to be drawn kept."""
    defined = result.where(F.col(value).isNotNull())
    return collapse_to_replicates(defined, groupby=groupby, keep=keep, value=value)


def matched_clones(result: DataFrame, groupby: str) -> DataFrame:
    """Clones behind each replicate's delta."""
    pairs = result.select(groupby, CLONE).distinct()
    return pairs.groupBy(groupby).agg(F.count(CLONE).alias("n_matched"))


def endpoints(result: DataFrame, groupby: str, splitby: str | None = None) -> DataFrame:
    """Mean start and end value per replicate."""
    keys = [groupby] + ([splitby] if splitby else [])
    return result.groupBy(*keys).agg(F.avg("value_from").alias("value_from"), F.avg("value_to").alias("value_to"))


def order_by_median(df: DataFrame, x: str, value: str = "value") -> DataFrame:
    """Levels of x with their exact median, largest first."""
    return exact_quantiles(df, value, [x], (0.5,), ("median",)).orderBy(F.col("median").desc(), x)


def contrast_label(stats: DataFrame, a: str, b: str) -> DataFrame:
    """Stars and p of one pair, in either order; a non-significant pair without p has no label."""
    pair = ((F.col("level_a") == a) & (F.col("level_b") == b)) | ((F.col("level_a") == b) & (F.col("level_b") == a))
    shown = ~(F.coalesce("stars", F.lit("")).isin("", "ns") & F.col("p").isNull())
    return stats.where(pair & shown).select("level_a", "level_b", F.coalesce("stars", F.lit("ns")).alias("label"), "p")
