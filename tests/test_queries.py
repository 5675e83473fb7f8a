"""Registered queries: oracle agreement, plan shape, independence of partitioning."""

import re

import pytest

import __spark_entry__ as entry
from checks.compare import compare, duck, rows_of
from forgeline.plans.catalog import QUERIES

SMALL = entry.SMALL


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_contract(spark):
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.count() > 0


# Page reports can be empty on the smallest tables.
MAY_BE_EMPTY = {"review_page", "review_next_page"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_oracle(spark, con, name):
    ok, note = compare(spark, con, SMALL, name)
    assert ok or (name in MAY_BE_EMPTY and "EMPTY" in note), note


@pytest.mark.parametrize("name", ["regression_pairs", "duplicate_negative_pairs", "top_paths", "classified_threads", "review_queue"])
def test_plans_have_no_cross_join_and_no_python(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|Python|InPandas", plan)


def test_top_k_limits_before_the_shuffle(spark):
    plan = QUERIES["top_paths"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_scan_reads_only_needed_columns(spark):
    plan = QUERIES["file_ownership"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet [l_orderkey" in plan and "l_extendedprice" not in plan


@pytest.mark.parametrize("name", ["inducing_commits", "duplicate_negative_pairs", "file_experts", "review_time_medians"])
def test_result_does_not_depend_on_partitions(spark, name):
    def result():
        df = QUERIES[name](spark, SMALL)
        return rows_of(df.columns, [tuple(r) for r in df.collect()])

    first = result()
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    try:
        assert result() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
