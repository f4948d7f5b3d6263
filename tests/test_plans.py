"""Plans: shared scans and shuffles, pruned columns, pushed filters."""

from __future__ import annotations

import os
import re

import pytest

from pyspark.sql import functions as F

from plumbline.plans.evaluate import compile_rules, evaluate
from plumbline.rule import Rule
from plumbline.sources.datasets import Scope, since
from plumbline.suite.run_queries import LINE_RULES

SF_DIR = os.environ.get("SUITE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_row_rules_share_one_scan(spark):
    lineitem = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    rules = [e[0] for e in LINE_RULES if e[0].rule_config_id <= 11]
    text = plan(evaluate(Scope(lineitem), rules))
    assert text.count("FileScan") == 1
    read = re.search(r"FileScan parquet \[(.*?)\]", text).group(1)
    assert sorted(c.split("#")[0] for c in read.split(",")) == [
        "l_discount", "l_extendedprice", "l_linestatus", "l_quantity", "l_returnflag", "l_shipdate", "l_tax",
    ]


def test_rules_on_one_key_share_one_grouping(spark):
    lineitem = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    rules = [
        Rule(1, "expect_column_values_to_be_unique", {"column": "l_suppkey"}),
        Rule(2, "expect_column_unique_value_count_to_be_between", {"column": "l_suppkey", "min_value": 1}),
        Rule(3, "expect_column_distinct_values_to_be_in_set", {"column": "l_suppkey", "value_set": [1]}),
        Rule(4, "expect_column_most_common_value_to_be_in_set", {"column": "l_suppkey", "value_set": [1]}),
    ]
    text = plan(evaluate(Scope(lineitem), rules))
    assert text.count("FileScan") == 1 and text.count("hashpartitioning") == 1


def test_incremental_filter_reaches_the_scan(spark):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    text = plan(since(events, "TS", "2024-01-15 00:00:00").select("event_id"))
    assert re.search(r"PushedFilters: \[.*GreaterThan\(ts", text)
    assert since(events, None, "2024-01-15") is events and since(events, "ts", None) is events


def test_incremental_reconciliation_filters_its_source(spark):
    """Both sides are filtered by their marks before anything is grouped."""
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    kwargs = {"source_table": "core", "scd_type": 1, "partition_keys": "o_orderkey", "recon_mode": "incremental",
              "core_insert_date_col": "o_orderdate", "conformed_update_date_col": "o_orderdate"}
    marks = {1: ("1998-01-01 00:00:00", "1998-02-01 00:00:00")}
    scope = Scope(orders, name="orders", others={"core": orders}, watermarks=marks)
    text = plan(evaluate(scope, [Rule(1, "expect_table_row_count_to_equal_other_table", kwargs)]))
    assert len(re.findall(r"PushedFilters: \[[^\]]*GreaterThan\(o_orderdate", text)) == 2


def test_no_job_runs_while_a_plan_is_made(spark):
    """Failing rows of the grouped checks are plans alone; only files' footers are read."""
    from plumbline.plans.evaluate import failing_rows

    lineitem = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    rules = [
        Rule(1, "expect_column_values_to_be_unique", {"column": "l_orderkey"}),
        Rule(2, "expect_compound_columns_to_be_unique", {"column_list": ["l_orderkey", "l_suppkey"]}),
        Rule(3, "expect_column_values_to_not_be_null", {"column": "l_tax"}),
    ]
    spark.sparkContext.setJobGroup("made", "plans")
    frame = failing_rows(Scope(lineitem, name="lineitem"), rules)
    evaluate(Scope(lineitem, name="lineitem"), rules)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("made")) == []
    frame.count()
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("made"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def rows_read(spark, action) -> int:
    """Rows that the stages of an action read from files."""
    tracker = spark.sparkContext._jsc.sc().statusStore()

    def read() -> int:
        stages = tracker.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(k).inputRecords() for k in range(stages.size()))

    before = read()
    action()
    return read() - before


def test_medians_share_three_scans(spark):
    """Four medians read the table three times, and no job runs while they are compiled."""
    lineitem = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    columns = ("l_extendedprice", "l_quantity", "l_discount", "l_tax")
    rules = [
        Rule(k, "expect_column_median_to_be_between", {"column": c, "min_value": 0}) for k, c in enumerate(columns)
    ]
    whole = lineitem.count()
    found = []
    scope = Scope(lineitem, name="lineitem")
    spark.sparkContext.setJobGroup("medians", "compiled")
    assert compile_rules(scope, rules)[1] == {}
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("medians")) == []
    assert rows_read(spark, lambda: found.extend(evaluate(scope, rules).collect())) == 3 * whole
    # A sketch, counts and values, each with the stages adaptive execution runs as jobs.
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("medians")) <= 9
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for row, column in zip(sorted(found, key=lambda r: r["rule_config_id"]), columns, strict=True):
        assert row["observed_value"] == lineitem.agg(F.median(F.col(column).cast("double"))).first()[0]
