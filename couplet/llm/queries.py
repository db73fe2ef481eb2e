"""Registered queries of this folder: each runs one operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

import corpus_pipeline
from couplet.llm import (balanced_shards, cross_tokens, hard_negatives, host_rules, line_crf, mixing, near_vectors, odd_sketch,
                         pieces, reply_trees, toxicity, url_lists, warc)
from couplet.llm.sql import ORACLES
from couplet.operators.shared import materialise

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = balanced_shards.balanced_shards(table(spark, sf_dir, "documents"), shards=40)
    return placed.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    narrow = materialise(table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", mixing.topic_of(text).alias("topic"), mixing.word_count(text).alias("tokens")))
    sampled = mixing.mix_documents(narrow, 0.5, topic=F.col("topic"), tokens=F.col("tokens"))
    return sampled.select("doc_id", "source", "lang", "topic", "tokens", (F.round("__p", 8) + F.lit(0.0)).alias("p"))


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = line_crf.learn(docs, table(spark, sf_dir, "labels"))
    scored = line_crf.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (line_crf.fold_of(F.col("doc_id")) == 0).alias("held_out"), "score",
                         (F.col("score") >= line_crf.GOOD_FROM).cast("int").alias("predicted"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), pieces.PieceTable.load(corpus_pipeline.PIECE_MODEL))


def _digits(text, start: int):
    return F.conv(F.substring(F.md5(text), start, 8), 16, 10).cast("long")


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries that follow from the hosts and first path segments of the pages."""
    host = url_lists.host_of(F.col("url"))
    segment = F.regexp_extract(url_lists.path_of(F.col("url")), r"^/([^/]+)", 1)
    seen = pages.select(host.alias("host"), segment.alias("segment")).where("host is not null").distinct()
    names = seen.select(F.col("host").alias("pattern")).unionByName(
        seen.where("segment != ''").select(F.concat("host", F.lit("/"), "segment").alias("pattern"))).distinct()
    named = names.select("pattern", *[_digits(F.col("pattern"), 1 + 8 * i).alias(f"h{i}") for i in range(3)])
    add = named.where("h0 % 100 < 30").withColumn("day", F.col("h1") % 200)
    gone = add.where("h0 % 100 < 15").withColumn("day", F.col("day") + 30 + F.col("h2") % 90)
    again = gone.where("h0 % 100 < 8").withColumn("day", F.col("day") + 20)
    parts = [(add, "add"), (gone, "remove"), (again, "add")]
    out = [df.select("pattern", "day", F.lit(action).alias("action")) for df, action in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def op7_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("day", F.pmod(F.col("page_id"), F.lit(365)))
    return url_lists.judged_captures(captures, list_entries(pages))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    records = warc.read_archives(spark, manifest, folder, payloads=False)
    return records.select(F.col("id").cast("long").alias("page_id"), F.col("size").alias("payload_bytes"),
                          F.col("digest").alias("payload_digest"), "record_type",
                          F.col("refers_to").cast("long").alias("refers_to"))


def op9_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def conversation_trees(conversations: DataFrame) -> DataFrame:
    """The conversations, and conversation -1, as trees: a row's parent is the row before it."""
    said = "</s>[INST] ok [/INST]"
    rows = conversations.select("conv_id", "turn", "role", "text")
    extra = conversations.sparkSession.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")      # one conversation, one output row
    node = F.row_number().over(order)
    return rows.unionByName(extra).select(F.col("conv_id").alias("tree"), node.alias("node"),
                                          F.when(node > 1, node - 1).alias("parent"), F.lit(1.0).alias("score"),
                                          "role", "text")


def op10_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = materialise(conversation_trees(table(spark, sf_dir, "conversations")))
    read = reply_trees.parsed(reply_trees.formatted(trees))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("loss_texts", "")
    return read.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(said, 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"),
                       F.sha2(learned, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def op12_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = cross_tokens.TokenizerPair(BYTE_VOCABULARY, corpus_pipeline.PIECE_MODEL)
    shown = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    aligned = cross_tokens.align(table(spark, sf_dir, "documents"), pair, keep=["doc_id"]).withColumn(
        "groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit("")))
    aligned = materialise(aligned.select(*shown, "pairs", "pair_links", F.monotonically_increasing_id().alias("row")))
    scores = cross_tokens.link_scores(aligned, materialise(cross_tokens.pair_counts(aligned, pair)), "row")
    zero = F.lit(0).cast("long")
    return aligned.join(scores, "row", "left").select(
        *shown, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", (toxicity.fold_of(F.col("doc_id")) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def registry() -> dict[str, Query]:
    out = {f.__name__: f for f in (
        op1_balanced_shards, op2_near_vectors, op3_source_mixing, op4_host_rules, op5_line_crf, op6_sentencepiece,
        op7_url_lists, op8_warc, op9_odd_sketch, op10_reply_trees, op11_hard_negatives, op12_cross_tokens,
        op13_toxicity)}
    out["pipeline"] = corpus_pipeline.run
    return out


def oracles() -> dict[str, str]:
    out = dict(ORACLES)
    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
