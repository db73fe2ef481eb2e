"""The shared test tables seen as cell tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from couplet.operators.estimate import fit_posterior
from couplet.spec import Study, register_cells

# Category orders of the test tables.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
LINE_STATES = ["AF", "AO", "NF", "NO", "RF", "RO"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
COVARIATES = ["pre", "post"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def before(column: str, date: str) -> Column:
    return F.when(F.col(column) < F.expr(f"TIMESTAMP_NTZ '{date}'"), "pre").otherwise("post")


def geography(spark: SparkSession, sf_dir: str, key: str, table: str, nation_key: str) -> DataFrame:
    """Entity key with its nation (replicate) and region (arm); nation and region are fixed-size tables."""
    places = read(spark, sf_dir, "nation").join(
        F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    places = places.select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    return read(spark, sf_dir, table).select(key, nation_key).join(
        F.broadcast(places), F.col(nation_key) == F.col("n_nationkey")).select(key, "nation", "region")


def order_logits() -> Column:
    """A stand-in for imported classifier output: depends on the order key and its priority."""
    return F.array(*[
        F.pmod(F.col("o_orderkey") * (j + 3) + j * j, F.lit(11)) * 2 / F.lit(11.0)
        + F.when(F.col("o_orderpriority") == level, 1.0).otherwise(0.0)
        for j, level in enumerate(PRIORITIES)
    ])


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", before("o_orderdate", "1998-04-01").alias("period"),
        order_logits().alias("logits"))


def orders_study(spark: SparkSession, sf_dir: str, *, gate: float | None = None) -> Study:
    """Orders as cells: customer = clone, priority = phenotype, period = covariate, nation = replicate.

    Nation and region are properties of the customer, so they arrive once per clone and the order
    table is aggregated before it meets them.
    """
    study = register_cells(
        order_cells(spark, sf_dir), clonotype_key="o_custkey", phenotype_key="o_orderpriority", covariate_key="period",
        cell_id_key="o_orderkey", replicate="nation", phenotype_levels=PRIORITIES, covariate_levels=COVARIATES,
        clone_labels=geography(spark, sf_dir, "c_custkey", "customer", "c_nationkey")
        .withColumnRenamed("c_custkey", "o_custkey"))
    return study.with_evidence(gate=gate)


def fitted_orders(spark: SparkSession, sf_dir: str, *, gate: float | None = None) -> Study:
    """The orders study with its closed-form posterior (one uniform archetype)."""
    return fit_posterior(orders_study(spark, sf_dir, gate=gate))


def lineitem_study(spark: SparkSession, sf_dir: str) -> Study:
    """Line items: supplier = clone, return flag and status = phenotype; few clones, each holding many cells."""
    cells = read(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("state"),
        before("l_shipdate", "1998-04-01").alias("period"))
    return register_cells(
        cells, clonotype_key="l_suppkey", phenotype_key="state", covariate_key="period", replicate="nation",
        phenotype_levels=LINE_STATES, covariate_levels=COVARIATES,
        clone_labels=geography(spark, sf_dir, "s_suppkey", "supplier", "s_nationkey")
        .withColumnRenamed("s_suppkey", "l_suppkey"))


def events_study(spark: SparkSession, sf_dir: str) -> Study:
    """Events: user = clone, event type = phenotype; no replicate."""
    cells = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", before("ts", "2024-01-16").alias("period"))
    return register_cells(cells, clonotype_key="user_id", phenotype_key="event_type", covariate_key="period",
                          cell_id_key="event_id", phenotype_levels=EVENT_TYPES, covariate_levels=COVARIATES)


def embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a label: 25 clones, feature array, phenotype."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("cell_id"), F.concat(F.lit("c"), F.pmod("vec_id", F.lit(25))).alias("clonotype"),
        F.col("label").cast("string").alias("phenotype"), F.col("embedding").cast("array<double>").alias("features"))


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(
        read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


def line_counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Count tables (order x part, quantity) of the two date halves."""
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("feature"), "l_quantity",
        before("l_shipdate", "1998-04-01").alias("half"))
    sums = rows.groupBy("cell_id", "feature", "half").agg(F.sum("l_quantity").alias("count"))
    return sums.where("half = 'pre'").drop("half"), sums.where("half = 'post'").drop("half")
