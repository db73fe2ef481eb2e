"""From raw documents to token ids, in five stages; each is written as Parquet and read again.

Every stage works on all that its predecessor kept and returns the columns of ``documents``; the last
returns ids and piece counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from couplet.llm import host_rules, line_crf, mixing, odd_sketch, pieces
from couplet.operators.shared import materialise

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# The mix takes this share of the tokens that reach it.
MIX_FRACTION = 0.9


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text breaks no base rule and whose host is not rejected; null and empty texts break one."""
    return host_rules.keep_passing(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score as good; a text without words scores 0 and goes, repeated rows fare alike."""
    model = line_crf.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = line_crf.score(docs, model, out="__score")
    return scored.where(F.col("__score") >= line_crf.GOOD_FROM).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the smallest id; empty texts are no copies of each other."""
    return odd_sketch.drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample towards the target shares; every column passes, whatever its name, and an empty table stays empty."""
    return mixing.mix_documents(docs, MIX_FRACTION, added=False)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the whole text, also of very long ones; a null text has null ids and 0 pieces."""
    table = pieces.PieceTable.load(PIECE_MODEL)
    encoded = pieces.encode(docs, table, keep=["doc_id"])
    return encoded.select("doc_id", F.greatest(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"), "piece_ids")


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", piece_ids),
]

# The classifier, the sketches and the encoder are beyond SQL; tests hold the stages to brute force one by one and run() to
# its properties.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
