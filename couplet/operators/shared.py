"""Building blocks used by several operators: stage tables, skew-safe lookups, element-wise sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A lookup side is broadcast only when its counted rows times their width stay below this.
BROADCAST_BYTES = 64 * 1024 * 1024
# A key is "hot" when it holds more than 1/HOT_SHARE of all rows, so there are < HOT_SHARE of them.
HOT_SHARE = 512
# Rows of one key that a task may always take; keys beyond it are hot as long as their rows can be broadcast.
TASK_ROWS = 5_000_000
# Clone lists up to this length become a plain predicate.
SHORT_LIST = 200
# Widest aggregate that is written as one expression per slot.
WIDE_AGGREGATE = 128


_local_folder: list[str] = []


def stage_folder(spark: SparkSession) -> str:
    """Shared folder for stage tables: ``spark.checkpoint.dir``, or a scratch folder in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="spark-couplet-", dir="/tmp"))
    return _local_folder[0]


def task_count(spark: SparkSession, work: float, per_task: float) -> int:
    """Tasks for compute-heavy rows: their bytes say nothing about their cost, so AQE must not merge them."""
    return int(min(100_000, max(spark.sparkContext.defaultParallelism, work // per_task + 1)))


def materialise(df: DataFrame) -> DataFrame:
    """Write a stage table and read it back.

    Cuts the lineage, survives executor loss, keeps column pruning and gives the planner real
    sizes. Used where one small(er) result feeds two or more passes.
    """
    path = f"{stage_folder(df.sparkSession)}/couplet-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class LookupSide:
    """Measured size of a lookup side: its rows, the fact rows behind it, and the join it allows."""

    rows: int
    fact_rows: int
    broadcast: bool
    row_bytes: int = 256
    largest: int = 0            # fact rows of the largest key

    @property
    def hot_limit(self) -> float:
        """Rows of a hot key: a share of all, or a task's load where the hot rows then fit the broadcast bound."""
        share = self.fact_rows / HOT_SHARE
        return min(share, max(float(TASK_ROWS), self.fact_rows * self.row_bytes / max(1, BROADCAST_BYTES)))


def measure_side(dim: DataFrame, weight: str | None, row_bytes: int,
                 broadcast_bytes: int | None = None) -> LookupSide:
    """Count a stage table (metadata-sized scan) to decide how it may be joined."""
    size = dim.agg(F.count(F.lit(1)).alias("n"),
                   (F.sum(weight) if weight else F.lit(0)).alias("w"),
                   (F.max(weight) if weight else F.lit(0)).alias("top")).first()
    bound = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    return LookupSide(size["n"], int(size["w"] or 0), size["n"] * row_bytes <= bound, row_bytes, int(size["top"] or 0))


def salt_of(weight: Column, side: LookupSide, content: Sequence[Column]) -> Column:
    """0 for ordinary keys; 1..k for hot keys, k growing with the rows of the key.

    The input partition is part of the hash, so that equal rows of one key spread too; a repeated
    task gives its rows the same salts.
    """
    parts = F.ceil(weight / F.lit(side.hot_limit / 4 + 1))
    return F.when(weight > side.hot_limit, F.pmod(F.xxhash64(*content, F.spark_partition_id()), parts) + 1) \
        .otherwise(F.lit(0)).cast("long")


def _unhashable(kind: str) -> bool:
    return "map<" in kind or "variant" in kind


def lookup_join(facts: DataFrame, dim: DataFrame, on: list[str], weight: str, row_bytes: int = 256,
                side: LookupSide | None = None, salt_column: str | None = None,
                keep_unmatched: bool = False, tasks: int | None = None) -> DataFrame:
    """Join of many fact rows to one dimension row per key, safe for any key skew.

    ``dim`` must be a stage table with one row per key; ``weight`` is its column with the number
    of fact rows per key. A dimension within the broadcast bound is broadcast. Beyond that the
    join shuffles by key, except for hot keys: fewer than ``HOT_SHARE`` keys can hold more than
    ``1/HOT_SHARE`` of the rows, so their dimension rows are broadcast and their fact rows are
    dealt over many partitions by a salt. ``salt_column`` keeps that salt on the output. ``tasks`` sets
    the number of partitions of a shuffled lookup.
    """
    side = side or measure_side(dim, weight, row_bytes)
    content = [F.col(f"`{f.name}`") for f in facts.schema if not _unhashable(f.dataType.simpleString())]
    if side.broadcast:
        joined = facts.join(F.broadcast(dim), on, "left" if keep_unmatched else "inner")
        return joined.withColumn(salt_column, salt_of(F.col(weight), side, content)) if salt_column else joined

    salt = salt_column or "__salt"
    payload = [c for c in dim.columns if c not in on]
    packed = dim.select(*on, F.struct(*payload).alias("__dim"), F.col(weight).alias("__w"))
    hot = packed.where(F.col("__w") > side.hot_limit) \
        .select(*on, F.col("__dim").alias("__hot"), F.col("__w").alias("__hot_w"))
    # The cold salt is always 0 but must not be a literal: the optimizer would fold it out of the
    # join keys, and hot rows would then be shuffled by the bare key into one partition.
    is_hot = F.col("__w") > side.hot_limit
    cold = packed.where(~is_hot).select(*on, "__dim", F.when(is_hot, 1).otherwise(0).cast("long").alias(salt))
    routed = facts.join(F.broadcast(hot), on, "left").withColumn(
        salt, F.coalesce(salt_of(F.col("__hot_w"), side, content), F.lit(0).cast("long")))
    if tasks:
        routed, cold = routed.repartition(tasks, *on, salt), cold.repartition(tasks, *on, salt)
    joined = routed.join(cold, [*on, salt], "left")
    others = [c for c in facts.columns if c not in on]
    found = joined.select(*on, *others, salt, F.coalesce("__hot", "__dim").alias("__found"))
    if not keep_unmatched:
        found = found.where(F.col("__found").isNotNull())
    return found.select(*on, *others, *([salt] if salt_column else []),
                        *[F.col("__found")[c].alias(c) for c in payload])


def vector_sum(df: DataFrame, keys: list[str], vectors: dict[str, Column], size: int,
               extra: Sequence[Column] = ()) -> DataFrame:
    """Element-wise sums of array columns per key, in one hash aggregate where the width allows.

    Both forms combine on the map side, so a key holding a third of the rows sends one partial
    row per task.
    """
    if size * len(vectors) <= WIDE_AGGREGATE:
        sums = [F.sum(v[j]).alias(f"__{name}_{j}") for name, v in vectors.items() for j in range(size)]
        out = df.groupBy(*keys).agg(*sums, *extra)
        arrays = [F.array(*[F.col(f"__{name}_{j}") for j in range(size)]).alias(name) for name in vectors]
        rest = [c for c in out.columns if c not in keys and not c.startswith("__")]
        return out.select(*keys, *arrays, *rest)

    zipped = F.arrays_zip(*[v.alias(n) for n, v in vectors.items()])
    long = df.select(*keys, F.posexplode(zipped).alias("__pos", "__v"))
    sums = long.groupBy(*keys, "__pos").agg(
        *[F.sum(F.col("__v")[n]).alias(n) for n in vectors]
    )
    rows = sums.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("__pos", *vectors))).alias("__rows")   # `size` entries
    )
    out = rows.select(*keys, *[F.col("__rows")[n].alias(n) for n in vectors])
    if not extra:
        return out
    side = df.groupBy(*keys).agg(*extra)
    condition = [out[k].eqNullSafe(side[k]) for k in keys]
    return out.join(side, condition).select(*[out[c] for c in out.columns],
                                            *[side[c] for c in side.columns if c not in keys])


def clone_filter(df: DataFrame, clones, column: str = "clonotype") -> DataFrame:
    """Keep listed clones (a Python list or a DataFrame with the clone column); None keeps all."""
    if clones is None:
        return df
    if isinstance(clones, DataFrame):
        wanted = clones.select(F.col(clones.columns[0]).alias(column)).distinct()
        return df.join(wanted, column, "left_semi")
    # Entries go through text to the column's type; one that has no value of that type matches nothing.
    kind = df.schema[column].dataType.simpleString()
    wanted = [str(c) for c in clones if c is not None]
    if len(wanted) <= SHORT_LIST:
        return df.where(F.col(column).isin([F.lit(c).try_cast(kind) for c in wanted]))
    text = df.sparkSession.createDataFrame([(c,) for c in wanted], f"`{column}` string")
    listed = text.select(F.col(column).try_cast(kind).alias(column)).distinct()
    return df.join(listed, column, "left_semi")


def in_requested_order(df: DataFrame, clones: list, *then: str) -> DataFrame:
    """Presentation order: the requested clone list first, then the named columns."""
    rank = F.array_position(F.array(*[F.lit(c) for c in clones]), F.col("clonotype"))
    return df.orderBy(rank, *then)
