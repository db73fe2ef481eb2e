"""Registered queries against DuckDB on the smallest tables (a spread of operators; the checker runs all)."""

import os

import pytest

import __spark_entry__ as entry
from tests import check_oracles

SF = "/root/testdata/sf0.001"
SAMPLE = ["joint_counts", "group_singletons", "mi_stats", "mi_model", "flux_jsd", "delta_clonotypic_model", "hdi_totalprice",
          "predict_gated", "calibration", "count_table_compare", "union_blocks", "label_vectors"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, name):
    verdict, _, count = check_oracles.compare(spark, check_oracles.connect(SF), name, SF)
    assert verdict == "ok" and count > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10
