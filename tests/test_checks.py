"""Checks on the defect sample, with known numbers."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from plumbline.operators import check, failing
from plumbline.plans.evaluate import evaluate
from plumbline.rule import Rule, RuleError
from plumbline.sources.datasets import Scope
from tests.samples import EMAIL

# expectation, arguments, total, missing, unexpected
COUNTS = [
    ("expect_column_values_to_not_be_null", {"column": "STATUS"}, 75, None, 3),
    ("expect_column_values_to_not_be_null", {"column": "email"}, 75, None, 1),
    ("expect_column_values_to_be_null", {"column": "ISSUES"}, 75, None, 0),
    ("expect_column_values_to_be_unique", {"column": "USER_ID"}, 75, 0, 5),
    ("expect_compound_columns_to_be_unique", {"column_list": ["USER_ID", "START_VAL"]}, 75, 0, 3),
    ("expect_column_values_to_be_between", {"column": "SCORE", "min_value": 0, "max_value": 100}, 75, 1, 6),
    ("expect_column_values_to_be_in_set", {"column": "STATUS", "value_set": ["Active", "Inactive", "Pending"]}, 75, 3, 3),
    ("expect_column_values_to_match_regex", {"column": "EMAIL", "regex": EMAIL}, 75, 1, 9),
    ("expect_column_values_to_not_match_regex", {"column": "EMAIL", "regex": EMAIL}, 75, 1, 66),
    ("expect_column_values_to_match_like_pattern_list", {"column": "STATUS", "regex_list": ["Active", "In.*"]}, 75, 2, 10),
    ("expect_column_value_lengths_to_be_between", {"column": "EMAIL", "min_value": 5, "max_value": 20}, 75, 1, 4),
    ("expect_column_pair_values_a_to_be_greater_than_b", {"column_A": "END_VAL", "column_B": "START_VAL"}, 75, 0, 3),
    ("expect_column_pair_values_a_to_be_greater_than_b",
     {"column_A": "END_VAL", "column_B": "START_VAL", "or_equal": "true"}, 75, 0, 1),
    ("expect_column_pair_values_to_be_equal", {"column_A": "START_VAL", "column_B": "END_VAL"}, 75, None, 73),
    ("expect_column_value_z_scores_to_be_less_than", {"column": "SCORE", "threshold": 3}, 74, 0, 1),
    ("expect_column_value_z_scores_to_be_less_than", {"column": "SCORE", "threshold": 3, "double_sided": True}, 74, 0, 2),
]

OBSERVED = [
    ("expect_column_min_to_be_between", -2147483648.0),
    ("expect_column_max_to_be_between", 2147483647.0),
    ("expect_column_sum_to_be_between", 2005480.0),
    ("expect_column_mean_to_be_between", 27101.08108108108),
    ("expect_column_median_to_be_between", 70.0),
    ("expect_column_stdev_to_be_between", 355454059.96079004),
]


@pytest.mark.parametrize("expectation,kwargs,total,missing,bad", COUNTS)
def test_counts(defects, expectation, kwargs, total, missing, bad):
    row = check(defects, expectation, kwargs).first()
    assert (row["element_count"], row["missing_count"], row["unexpected_count"]) == (total, missing, bad)
    assert row["is_success"] == (bad == 0)


@pytest.mark.parametrize("expectation,kwargs,total,missing,bad", COUNTS)
def test_failing_rows_match_the_count(defects, expectation, kwargs, total, missing, bad):
    assert failing(defects, expectation, kwargs, primary_key=("ROW_ID",)).count() == bad


@pytest.mark.parametrize("expectation,value", OBSERVED)
def test_observed(defects, expectation, value):
    row = check(defects, expectation, {"column": "SCORE", "min_value": value, "max_value": value}).first()
    assert math.isclose(row["observed_value"], value, rel_tol=1e-12)
    assert (row["element_count"], row["missing_count"]) == (75, 1)


def test_one_run_equals_single_runs(defects):
    rules = [Rule(i, e, k) for i, (e, k, *_) in enumerate(COUNTS, start=1)]
    rules += [Rule(100 + i, e, {"column": "SCORE", "min_value": 0}) for i, (e, _) in enumerate(OBSERVED)]
    scope = Scope(defects)
    fused = {r["rule_config_id"]: r for r in evaluate(scope, rules).collect()}
    assert len(fused) == len(rules)
    for rule in rules:
        assert fused[rule.rule_config_id] == evaluate(scope, [rule]).first()


def test_compound_unique_keeps_the_first_by_key(defects):
    kwargs = {"column_list": "USER_ID, STATUS"}
    rows = failing(defects, "expect_compound_columns_to_be_unique", kwargs, primary_key=("row_id",))
    assert sorted(r["ROW_ID"] for r in rows.collect()) == [41, 67, 68]


def test_boundary_of_mostly(spark):
    """5 of 20 fail: passes at 0.75 exactly, not above."""
    df = spark.range(20).select(F.when(F.col("id") >= 5, F.col("id")).alias("v"))
    for mostly, passes in ((0.75, True), (0.7500001, False), (0.7, True)):
        row = check(df, "expect_column_values_to_not_be_null", {"column": "v", "mostly": mostly}).first()
        assert row["is_success"] is passes


EDGE = [
    ("expect_column_values_to_not_be_null", {"column": "v"}),
    ("expect_column_values_to_be_between", {"column": "v", "min_value": 1, "max_value": 2}),
    ("expect_column_values_to_be_in_set", {"column": "v", "value_set": [1]}),
    ("expect_column_values_to_be_unique", {"column": "v"}),
    ("expect_compound_columns_to_be_unique", {"column_list": ["v", "w"], "ignore_row_if": "ANY_VALUE_IS_MISSING"}),
    ("expect_column_value_z_scores_to_be_less_than", {"column": "v", "threshold": 1}),
    ("expect_column_stdev_to_be_between", {"column": "v", "min_value": 0}),
    ("expect_column_median_to_be_between", {"column": "v"}),
    ("expect_column_most_common_value_to_be_in_set", {"column": "v", "value_set": [1]}),
    ("expect_column_proportion_of_unique_values_to_be_between", {"column": "v", "min_value": 0}),
    ("expect_column_proportion_of_non_null_value_to_be_between", {"column": "v", "min_value": 0.5}),
    ("expect_column_distinct_values_to_contain_set", {"column": "v", "value_set": [1]}),
    ("expect_multicolumn_sum_to_equal", {"column_list": ["v", "w"], "sum_total": 0}),
]
PASSES = {
    "empty": [True, True, True, True, True, True, False, False, False, True, False, False, True],
    "nulls": [False, True, True, True, True, True, False, False, False, True, False, False, True],
    "one": [True, True, True, True, True, True, False, True, True, True, True, True, False],
}


@pytest.mark.parametrize("case", list(PASSES))
def test_edges(spark, case):
    rows = {"empty": [], "nulls": [(None, None)] * 3, "one": [(1, 1)]}[case]
    df = spark.createDataFrame(rows, "v int, w int")
    for (expectation, kwargs), passes in zip(EDGE, PASSES[case]):
        assert check(df, expectation, kwargs).first()["is_success"] is passes, expectation


def test_set_values_compare_in_the_column_type(spark):
    df = spark.createDataFrame([(1.0, "1"), (10000000.0, "1e7")], "d double, s string")
    ok = check(df, "expect_column_values_to_be_in_set", {"column": "d", "value_set": ["1", 10000000]}).first()
    assert ok["is_success"]
    bad = check(df, "expect_column_values_to_be_in_set", {"column": "s", "value_set": [1, 10000000]}).first()
    assert bad["unexpected_count"] == 1


def test_regex_matches_the_whole_text(spark):
    df = spark.createDataFrame([("abc",), ("xabc",), ("abc\n",), ("ABC",)], "s string")
    row = check(df, "expect_column_values_to_match_regex", {"column": "s", "regex": "a|abc"}).first()
    assert row["unexpected_count"] == 3
    row = check(df, "expect_column_values_to_not_match_regex", {"column": "s", "regex": "(?i)^abc$"}).first()
    assert row["unexpected_count"] == 2


def test_long_sets_join_instead_of_inlining(spark):
    df = spark.range(5000).select("id", F.col("id").cast("string").alias("s"))
    long = list(range(0, 5000, 2))
    row = check(df, "expect_column_values_to_be_in_set", {"column": "id", "value_set": long}).first()
    assert row["unexpected_count"] == 2500
    row = check(df, "expect_column_values_to_not_be_in_set", {"column": "s", "value_set": [str(v) for v in long]}).first()
    assert row["unexpected_count"] == 2500
    pairs = [[v, str(v)] for v in long]
    row = check(df, "expect_column_pair_values_to_be_in_set",
                {"column_list": ["id", "s"], "value_pairs_set": pairs}).first()
    assert row["unexpected_count"] == 2500
    assert failing(df, "expect_column_pair_values_to_be_in_set",
                   {"column_list": ["id", "s"], "value_pairs_set": pairs}).columns == ["id", "s"]


TYPES = [
    ("i", "VARCHAR", 0, True), ("i", "DATE", 2, False), ("i", "BOOLEAN", 2, False), ("i", "INT", 0, True),
    ("b", "NUMBER", 2, False), ("b", "TEXT", 0, True), ("b", "TIMESTAMP", 2, False),
    ("d", "STRING", 0, True), ("d", "FLOAT", 2, False), ("d", "BOOLEAN", 2, False),
    ("s", "NUMBER", 1, False), ("s", "STRING", 0, True), ("f", "DOUBLE", 0, True),
]


@pytest.mark.parametrize("column,wanted,bad,passes", TYPES)
def test_type_table(spark, column, wanted, bad, passes):
    df = spark.sql(
        "SELECT * FROM VALUES (1, true, DATE'2024-01-01', '12', 1.5D), (2, false, DATE'2024-01-02', 'x', 2.5D) AS t(i, b, d, s, f)"
    )
    row = check(df, "expect_column_values_to_be_of_type", {"column": column, "type_": wanted}).first()
    assert (row["unexpected_count"], row["is_success"]) == (bad, passes)


def test_type_never_passes_even_on_no_rows(spark):
    df = spark.createDataFrame([], "i int")
    row = check(df, "expect_column_values_to_be_of_type", {"column": "i", "type_": "DATE", "mostly": 0}).first()
    assert row["is_success"] is False


def test_unknown_arguments_raise(defects):
    with pytest.raises(RuleError):
        check(defects, "expect_column_values_to_be_between", {"column": "SCORE", "min_value": 1})
    with pytest.raises(RuleError):
        check(defects, "expect_column_values_to_not_be_null", {"column": "NOT_THERE"})
    with pytest.raises(RuleError):
        check(defects, "expect_nothing", {})


def test_approximate_statistics_join_the_scan(spark):
    df = spark.range(2000).select((F.col("id") % 500).alias("v"))
    for name, low, high in (
        ("expect_column_unique_value_count_to_be_between", 450, 550),
        ("expect_column_proportion_of_unique_values_to_be_between", 0.2, 0.3),
        ("expect_column_median_to_be_between", 240, 260),
    ):
        row = check(df, name, {"column": "v", "min_value": low, "max_value": high, "approximate": True}).first()
        assert row["is_success"], name


def test_rule_ids_must_differ(defects):
    same = [Rule(1, "expect_table_row_count_to_equal", {"value": v}) for v in (75, 76)]
    with pytest.raises(RuleError):
        evaluate(Scope(defects), same)


def test_time_of_day(spark):
    """Text that is a time of day; timestamps hold one, dates and numbers don't."""
    texts = ["12:30", "23:59:59.25", " 1:05:00 ", "24:00", "12:60", "noon", "2024-01-01 10:00:00", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr(
        "t", "timestamp_ntz'2024-01-01 10:00:00' AS ts", "date'2024-01-01' AS d", "1 AS n"
    )
    got = {}
    for column in ("t", "ts", "d", "n"):
        row = check(df, "expect_column_values_to_be_of_type", {"column": column, "type_": "time"}).first()
        got[column] = (row["unexpected_count"], row["missing_count"], row["is_success"])
    assert got == {"t": (4, 2, False), "ts": (0, 0, True), "d": (9, 0, False), "n": (9, 0, False)}


def test_a_query_reads_the_tables_of_its_plan(spark):
    from plumbline.operators.custom import relations

    text = (
        "WITH w AS (SELECT * FROM first) SELECT o.* FROM `orders` o JOIN w ON o.k IN (SELECT k FROM inner_one) "
        "WHERE extract(year FROM o.day) > 1 AND EXISTS (SELECT 1 FROM db.other)"
    )
    found = relations(spark, text)
    assert {"first", "orders", "inner_one"} <= found and not found & {"o", "day", "k", "year"}
