"""Checks on a column's statistics, distinct values and freshness."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.plans.details import most_common_values, set_difference
from plumbline.suite.helpers import add, counts_sql, quoted_list, summary
from plumbline.suite.tables import load, source


def _statistic(name, table, expectation, kwargs, value, ok, digits=4, column=None):
    column = column or kwargs["column"]
    add(
        name,
        summary(table, expectation, kwargs, digits=digits),
        counts_sql(
            expectation,
            f"count(*) AS total, count(*) FILTER (WHERE {column} IS NULL) AS missing, {value} AS observed",
            table,
            f"coalesce({ok}, FALSE)",
            missing="missing",
            bad=f"CASE WHEN coalesce({ok}, FALSE) THEN 0 ELSE 1 END",
            percent=f"CASE WHEN coalesce({ok}, FALSE) THEN 0.0 ELSE 100.0 END",
            observed="coalesce(observed, 0.0)",
            digits=digits,
        ),
    )


_statistic(
    "minimum_between", "lineitem", "expect_column_min_to_be_between",
    {"column": "l_extendedprice", "min_value": 100, "max_value": 1000},
    "min(CAST(l_extendedprice AS DOUBLE))", "observed >= 100 AND observed <= 1000",
)
_statistic(
    "text_minimum_between", "orders_q", "expect_column_min_to_be_between",
    {"column": "price_text", "min_value": 160000, "strict_min": True},
    "min(TRY_CAST(price_text AS DOUBLE))", "observed > 160000",
)
_statistic(
    "maximum_between", "lineitem", "expect_column_max_to_be_between",
    {"column": "l_quantity", "min_value": 50, "max_value": 50, "strict_max": True},
    "max(CAST(l_quantity AS DOUBLE))", "observed >= 50 AND observed < 50",
)
_statistic(
    "sum_between", "lineitem", "expect_column_sum_to_be_between",
    {"column": "l_quantity", "min_value": 1000},
    "sum(CAST(l_quantity AS DOUBLE))", "observed >= 1000", digits=2,
)
_statistic(
    "mean_between", "events_q", "expect_column_mean_to_be_between",
    {"column": "paid", "min_value": 1, "max_value": 20},
    "avg(CAST(paid AS DOUBLE))", "observed >= 1 AND observed <= 20", digits=6,
)
_statistic(
    "mean_unbounded", "customer", "expect_column_mean_to_be_between", {"column": "c_acctbal"},
    "avg(CAST(c_acctbal AS DOUBLE))", "observed IS NOT NULL", digits=4,
)
_statistic(
    "median_between", "lineitem", "expect_column_median_to_be_between",
    {"column": "l_extendedprice", "min_value": 1, "max_value": 60000},
    "quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5)", "observed >= 1 AND observed <= 60000",
)
_statistic(
    "stdev_between", "lineitem", "expect_column_stdev_to_be_between",
    {"column": "l_extendedprice", "max_value": 1000},
    "stddev_samp(CAST(l_extendedprice AS DOUBLE))", "observed <= 1000",
)


def _whole(name, table, expectation, kwargs, measures, ok, observed, total="total", digits=6):
    """A check about the table as a whole: 0 or 100 percent unexpected."""
    add(
        name,
        summary(table, expectation, kwargs, digits=digits),
        counts_sql(
            expectation, measures, table, ok, total=total,
            bad=f"CASE WHEN {ok} THEN 0 ELSE 1 END",
            percent=f"CASE WHEN {ok} THEN 0.0 ELSE 100.0 END", observed=observed, digits=digits,
        ),
    )


_whole(
    "unique_count_between", "lineitem", "expect_column_unique_value_count_to_be_between",
    {"column": "l_partkey", "min_value": 10, "max_value": 100},
    "count(*) AS total, count(DISTINCT l_partkey) AS observed", "observed >= 10 AND observed <= 100", "observed",
)
_whole(
    "unique_proportion_between", "events_q", "expect_column_proportion_of_unique_values_to_be_between",
    {"column": "paid", "min_value": 0.01, "max_value": 0.9},
    "count(*) AS total, CAST(count(DISTINCT paid) AS DOUBLE) / count(paid) AS observed",
    "observed >= 0.01 AND observed <= 0.9", "observed",
)
add(
    "non_null_proportion_between",
    summary("events_q", "expect_column_proportion_of_non_null_value_to_be_between",
            {"column": "paid", "min_value": 0.5, "max_value": 0.8, "strict_min": True}, digits=8),
    counts_sql(
        "expect_column_proportion_of_non_null_value_to_be_between",
        "count(*) AS total, count(*) - count(paid) AS bad, CAST(count(paid) AS DOUBLE) / count(*) AS observed",
        "events_q", "observed > 0.5 AND observed <= 0.8", observed="observed", digits=8,
    ),
)

# --- freshness ----------------------------------------------------------------

for _name, _now, _amount, _unit in (
    ("values_recent", "2024-01-31 12:00:00", 2, "days"),
    ("values_stale", "2024-01-31 12:00:00", "3", "HOUR"),
):
    _ok = f"newest > TIMESTAMP '{_now}' - INTERVAL {_amount} {_unit}"
    add(
        _name,
        summary("events", "expect_column_values_to_be_recent",
                {"column": "ts", "freshness_threshold_value": _amount, "freshness_threshold_unit": _unit, "now": _now}),
        counts_sql(
            "expect_column_values_to_be_recent", "count(*) AS total, max(ts) AS newest", "events", _ok,
            bad=f"CASE WHEN {_ok} THEN 0 ELSE total END",
        ),
    )

# --- distinct values -------------------------------------------------------------

_MODE_GROUPS = "(SELECT {c}, count(*) AS n FROM {s} AS src GROUP BY {c}) AS g"

for _name, _table, _column, _values, _ties in (
    ("most_common_in_set", "orders", "o_orderstatus", ["P", "X"], False),
    ("most_common_tie_in_set", "documents", "source", ["src1", "src2"], True),
    ("most_common_tie_not_in_set", "documents", "source", ["src1", "src2"], False),
):
    _inside = f"{_column} IN ({quoted_list(_values)})"
    _ok = f"coalesce(inside, 0) > 0 AND coalesce(inside, 0) {'>=' if _ties else '>'} coalesce(outside, 0)"
    add(
        _name,
        summary(_table, "expect_column_most_common_value_to_be_in_set",
                {"column": _column, "value_set": _values, "ties_okay": _ties}),
        counts_sql(
            "expect_column_most_common_value_to_be_in_set",
            f"sum(n) AS total, max(n) FILTER (WHERE {_column} IS NOT NULL AND {_inside}) AS inside, "
            f"max(n) FILTER (WHERE {_column} IS NOT NULL AND NOT {_inside}) AS outside",
            _table, _ok, bad=f"CASE WHEN {_ok} THEN 0 ELSE 1 END",
            percent=f"CASE WHEN {_ok} THEN 0.0 ELSE 100.0 END",
            observed="greatest(coalesce(inside, 0), coalesce(outside, 0))",
        ).replace(f"FROM {source(_table)} AS src)", "FROM " + _MODE_GROUPS.format(c=_column, s=source(_table)) + ")"),
    )

add(
    "most_common_values",
    lambda spark, sf_dir: most_common_values(load(spark, sf_dir, "documents"), "source"),
    "SELECT source AS value, n AS rows FROM (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL "
    "GROUP BY source) AS g WHERE n = (SELECT max(n) FROM (SELECT count(*) AS n FROM documents "
    "WHERE source IS NOT NULL GROUP BY source) AS h)",
)

_DISTINCT = (
    ("distinct_in_set", "expect_column_distinct_values_to_be_in_set", "events", "event_type",
     ["view", "click", "error", "signup", "purchase", "refund"], "extra = 0"),
    ("distinct_in_set_fails", "expect_column_distinct_values_to_be_in_set", "part", "p_size",
     [1, 2, 3, "4", "four"], "extra = 0"),
    ("distinct_equal_set", "expect_column_distinct_values_to_equal_set", "orders_q", "status",
     [" P ", "F"], "extra = 0 AND absent = 0"),
    ("distinct_equal_set_fails", "expect_column_distinct_values_to_equal_set", "customer", "c_mktsegment",
     ["BUILDING", "MACHINERY", "OTHER"], "extra = 0 AND absent = 0"),
    ("distinct_contain_set", "expect_column_distinct_values_to_contain_set", "documents", "lang",
     ["en", "de"], "absent = 0"),
    ("distinct_contain_set_fails", "expect_column_distinct_values_to_contain_set", "documents", "lang",
     ["en", "it"], "absent = 0"),
)
for _name, _expectation, _table, _column, _values, _ok in _DISTINCT:
    _numbers = [v for v in _values if str(v).isdigit()] if _column == "p_size" else _values
    _listed = ", ".join(str(v) for v in _numbers) if _column == "p_size" else quoted_list(_numbers)
    add(
        _name,
        summary(_table, _expectation, {"column": _column, "value_set": _values}),
        counts_sql(
            _expectation,
            f"count({_column}) AS total, "
            f"count(DISTINCT CASE WHEN {_column} IN ({_listed}) THEN {_column} END) AS found, "
            f"count(DISTINCT CASE WHEN {_column} NOT IN ({_listed}) THEN {_column} END) AS extra, "
            f"{len(_values)} - count(DISTINCT CASE WHEN {_column} IN ({_listed}) THEN {_column} END) AS absent",
            _table, _ok, bad="extra", percent="0.0", observed="found + extra",
        ),
    )


def _differences(spark, sf_dir):
    segments = set_difference(load(spark, sf_dir, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY", "OTHER"])
    sizes = set_difference(load(spark, sf_dir, "part"), "p_size", [1, 2, 99])
    return segments.unionByName(sizes.withColumn("value", F.col("value").cast("string")))


add(
    "set_differences",
    _differences,
    """
    WITH seen AS (SELECT DISTINCT c_mktsegment AS value FROM customer),
         wanted AS (SELECT * FROM (VALUES ('BUILDING'), ('MACHINERY'), ('OTHER')) AS v(value)),
         sizes AS (SELECT DISTINCT p_size AS value FROM part),
         wanted_sizes AS (SELECT * FROM (VALUES (1), (2), (99)) AS v(value))
    SELECT value, 'extra' AS side FROM seen WHERE value NOT IN (SELECT value FROM wanted)
    UNION ALL SELECT value, 'missing' FROM wanted WHERE value NOT IN (SELECT value FROM seen)
    UNION ALL SELECT CAST(value AS VARCHAR), 'extra' FROM sizes WHERE value NOT IN (SELECT value FROM wanted_sizes)
    UNION ALL SELECT CAST(value AS VARCHAR), 'missing' FROM wanted_sizes WHERE value NOT IN (SELECT value FROM sizes)""",
)
