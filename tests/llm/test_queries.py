"""Registered queries against their SQL, and the pipeline against its stages on the smallest tables."""

import re

import duckdb
import pytest

import corpus_pipeline
from couplet.llm import queries
from tests.check_oracles import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_query_equals_sql(spark, name):
    verdict, _, rows = compare(spark, connect(SF), name, SF)
    assert verdict == "ok" and rows > 0


def test_url_lists_equal_sql_with_capitals(spark, tmp_path):
    pages = spark.range(400).selectExpr("id AS page_id", "concat('http://H', id % 40, '.org/', "
                                        "if(id % 3 = 0, 'News', 'news'), id % 7, '/x') AS url")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    verdict, _, rows = compare(spark, con, "op7_url_lists", str(tmp_path))
    assert verdict == "ok" and rows == 400


def test_shards_query_law(spark):
    rows = queries.op1_balanced_shards(spark, SF).collect()
    counts = [sum(r.shard == s for r in rows) for s in range(40)]
    assert max(counts) - min(counts) <= 1 and {r.law for r in rows} == {"rows"}


def test_round_trip_query(spark):
    assert all(r.round_trip for r in queries.op6_sentencepiece(spark, SF).collect())


def test_pipeline_keeps_one_of_each_group(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = [r.doc_id for r in out]
    assert 0 < len(ids) == len(set(ids)) < len(docs)
    words = re.compile(r"[^\x20\x09-\x0D]+")
    assert all(len(words.findall(docs[i])) >= 20 for i in ids)
    assert len({docs[i] for i in ids}) == len(ids)
