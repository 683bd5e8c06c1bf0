"""Every registered query against its SQL, and the shape of its plan."""

import pytest

import __spark_entry__ as entry
from tools.check import compare
from verification.oracles import ORACLES
from verification.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
ROWS_ONLY = {"v2_vector_lsh", "v2_vector_index"}


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_agrees_with_its_sql(spark, key):
    outcome = compare(spark, FOLDER, key)
    assert outcome.startswith("rows only" if key in ROWS_ONLY else "ok"), outcome


@pytest.mark.parametrize("key", ["f1_sku_velocity", "r2_co_purchase_parts", "p4_search_by_name", "t5_find_symbol"])
def test_plans_without_broadcasts_have_no_cross_join_or_python(spark, key):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[key](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for node in ("CartesianProduct", "NestedLoopJoin", "BatchEvalPython", "SinglePartition"):
        assert node not in plan
    assert "SortMergeJoin" in plan


def test_scans_read_only_the_columns_they_need(spark):
    plan = entry.queries()["f2_basket_affinity"](spark, FOLDER)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in text
    assert "IsNotNull(l_orderkey)" in text


def test_top_k_is_cut_before_the_shuffle(spark):
    plan = entry.queries()["w1_top_k"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") > plan.index("WindowGroupLimit")
    assert plan.count("WindowGroupLimit") == 2


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["query_id", "anchor_id", "status"]
    assert df.count() > 0
