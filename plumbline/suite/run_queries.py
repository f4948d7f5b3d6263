"""Whole runs: fused rules, capture, failure details, pivot, projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import catalog
from plumbline.operators.custom import combination_profile, query_profile_columns
from plumbline.plans import details
from plumbline.plans.evaluate import compile_rule, evaluate, failing_rows
from plumbline.plans.pivot import pivot_failures, rule_header
from plumbline.plans.rules import failed_in_latest_run, runnable_rules
from plumbline.rule import Rule
from plumbline.sources.datasets import Scope
from plumbline.suite.helpers import add, blank, share, summary_columns
from plumbline.suite.tables import load, source

# --- one fused run ------------------------------------------------------------
#
# Each entry: rule, table, oracle measures (total, missing, bad, observed) and
# the test that passes it.

_C = "count(*) FILTER (WHERE {})"


def _rule(rule_id, expectation, kwargs, total, missing, bad, ok, observed="0.0", percent=None):
    return (Rule(rule_id, expectation, kwargs), total, missing, bad, ok, observed, percent)


def _share_ok(mostly):
    return f"({share()}) <= CAST(1.0 AS DOUBLE) - CAST({mostly} AS DOUBLE)"


def _whole(ok):
    return f"CASE WHEN {ok} THEN 0 ELSE 1 END", f"CASE WHEN {ok} THEN 0.0 ELSE 100.0 END"


LINE_RULES = [
    _rule(1, "expect_column_values_to_not_be_null", {"column": "l_shipdate"},
          "count(*)", "0", _C.format("l_shipdate IS NULL"), _share_ok(1.0)),
    _rule(2, "expect_column_values_to_be_between", {"column": "l_quantity", "min_value": 1, "max_value": 45, "mostly": 0.9},
          "count(*)", _C.format("l_quantity IS NULL"), _C.format("l_quantity < 1 OR l_quantity > 45"), _share_ok(0.9)),
    _rule(3, "expect_column_values_to_be_between", {"column": "l_discount", "min_value": 0, "max_value": 0.05, "mostly": 0.4},
          "count(*)", _C.format("l_discount IS NULL"), _C.format("l_discount < 0 OR l_discount > 0.05"), _share_ok(0.4)),
    _rule(4, "expect_column_values_to_be_in_set", {"column": "l_returnflag", "value_set": ["A", "N"], "mostly": 0.6},
          "count(*)", _C.format(blank("l_returnflag")), _C.format("trim(l_returnflag) NOT IN ('A', 'N')"), _share_ok(0.6),
          observed="total - missing - bad"),
    _rule(5, "expect_column_values_to_not_be_in_set", {"column": "l_linestatus", "value_set": ["X"]},
          "count(*)", _C.format(blank("l_linestatus")), _C.format("l_linestatus IN ('X')"), _share_ok(1.0)),
    _rule(6, "expect_column_values_to_match_regex", {"column": "l_linestatus", "regex": "[OF]"},
          "count(*)", _C.format(blank("l_linestatus")),
          _C.format(f"{blank('l_linestatus')} OR NOT regexp_full_match(trim(l_linestatus), '[OF]')"), _share_ok(1.0)),
    _rule(7, "expect_column_pair_values_a_to_be_greater_than_b", {"column_A": "l_extendedprice", "column_B": "l_tax"},
          "count(*)", _C.format("l_extendedprice IS NULL OR l_tax IS NULL"), _C.format("NOT (l_extendedprice > l_tax)"),
          _share_ok(1.0)),
    _rule(8, "expect_table_row_count_to_be_between", {"min_value": 1},
          "count(*)", "0", "0", "total >= 1", observed="total"),
    _rule(9, "expect_column_max_to_be_between", {"column": "l_quantity", "max_value": 49},
          "count(*)", "0", "max(l_quantity)", "bad <= 49", observed="bad", percent="whole"),
    _rule(10, "expect_column_mean_to_be_between", {"column": "l_quantity", "min_value": 20, "max_value": 30},
          "count(*)", "0", "avg(l_quantity)", "bad >= 20 AND bad <= 30", observed="bad", percent="whole"),
    _rule(11, "expect_table_column_count_to_equal", {"value": 11}, "11", "0", "0", "TRUE", observed="11"),
    _rule(12, "expect_column_unique_value_count_to_be_between", {"column": "l_suppkey", "min_value": 1, "max_value": 50},
          "count(*)", "0", "count(DISTINCT l_suppkey)", "bad >= 1 AND bad <= 50", observed="bad", percent="whole"),
    _rule(13, "expect_column_distinct_values_to_be_in_set", {"column": "l_suppkey", "value_set": [1, 2, 3]},
          "count(l_suppkey)", "0", "count(DISTINCT CASE WHEN l_suppkey NOT IN (1, 2, 3) THEN l_suppkey END)", "bad = 0",
          observed="distinct_suppliers", percent="none"),
    _rule(14, "expect_column_median_to_be_between", {"column": "l_extendedprice", "min_value": 0, "max_value": 1000},
          "count(*)", "0", "quantile_cont(l_extendedprice, 0.5)", "bad >= 0 AND bad <= 1000", observed="bad", percent="whole"),
    _rule(15, "expect_compound_columns_to_be_unique", {"column_list": ["l_orderkey", "l_linenumber"], "mostly": 0.5},
          "count(*)", "0", "count(*) - count(DISTINCT (l_orderkey, l_linenumber))", _share_ok(0.5)),
    _rule(16, "expect_column_value_z_scores_to_be_less_than", {"column": "l_quantity", "threshold": 1.7, "mostly": 0.9},
          "count(*)", "0", "(SELECT count(*) FROM lineitem, (SELECT avg(l_quantity) AS q_mean, stddev_samp(l_quantity) AS q_sd "
          "FROM lineitem) AS st WHERE NOT ((l_quantity - q_mean) / q_sd < 1.7))", _share_ok(0.9), observed="mean_quantity"),
]


def _result_sql(entries, table: str, prefix: str = "", digits: int = 4, extra: str = "0 AS nothing") -> str:
    """Results of rules as one SELECT per rule."""
    out = []
    for rule, total, missing, bad, ok, observed, percent in entries:
        shown_bad, shown_percent = "bad", f"round(({share()}) * 100, 8)"
        if percent == "whole":
            shown_bad, shown_percent = _whole(ok)
        elif percent == "none":
            shown_percent = "CAST(0.0 AS DOUBLE)"
        out.append(
            f"SELECT {prefix}CAST({rule.rule_config_id} AS BIGINT) AS rule_config_id, '{rule.expectation}' AS expectation, "
            f"CAST(total AS BIGINT) AS element_count, CAST(missing AS BIGINT) AS missing_count, "
            f"CAST({shown_bad} AS BIGINT) AS unexpected_count, CAST({shown_percent} AS DOUBLE) AS unexpected_percent, "
            f"round(CAST({observed} AS DOUBLE), {digits}) AS observed_value, ({ok}) AS is_success "
            f"FROM (SELECT {total} AS total, {missing} AS missing, {bad} AS bad, {extra} FROM {source(table)} AS src) AS m"
        )
    return " UNION ALL ".join(out)


_LINE_EXTRA = "count(DISTINCT l_suppkey) AS distinct_suppliers, avg(l_quantity) AS mean_quantity"


def _results(spark, sf_dir, table, entries) -> DataFrame:
    return evaluate(Scope(load(spark, sf_dir, table), name=table), [e[0] for e in entries])


def fused_run(spark, sf_dir) -> DataFrame:
    """Sixteen rules of ``lineitem``: one scan, three groupings, one median."""
    return summary_columns(_results(spark, sf_dir, "lineitem", LINE_RULES), keep=("rule_config_id",))


add("fused_run", fused_run, _result_sql(LINE_RULES, "lineitem", extra=_LINE_EXTRA))

# --- capture of several rules in one pass ---------------------------------------

CUSTOMER_RULES = [
    _rule(21, "expect_column_values_to_be_between", {"column": "c_acctbal", "min_value": 0, "max_value": 9000},
          "count(*)", "0", _C.format("c_acctbal < 0 OR c_acctbal > 9000"), _share_ok(1.0)),
    _rule(22, "expect_column_values_to_be_in_set",
          {"column": "c_mktsegment", "value_set": ["BUILDING", "MACHINERY", "FURNITURE"], "mostly": 0.5},
          "count(*)", "0", _C.format("c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')"), _share_ok(0.5),
          observed="total - bad"),
    _rule(23, "expect_column_values_to_match_regex", {"column": "c_name", "regex": "Customer#0+[0-9]*[02468]"},
          "count(*)", "0", _C.format("NOT regexp_full_match(c_name, 'Customer#0+[0-9]*[02468]')"), _share_ok(1.0)),
    _rule(24, "expect_table_row_count_to_be_between", {"min_value": 0, "max_value": 10},
          "count(*)", "0", "count(*)", "total <= 10", observed="total", percent="whole"),
]
ORDER_RULES = [
    _rule(31, "expect_column_values_to_not_be_null", {"column": "o_custkey"},
          "count(*)", "0", _C.format("o_custkey IS NULL"), _share_ok(1.0)),
    _rule(32, "expect_column_values_to_be_in_set", {"column": "o_orderstatus", "value_set": ["O", "F", "P"]},
          "count(*)", "0", _C.format("o_orderstatus NOT IN ('O', 'F', 'P')"), _share_ok(1.0), observed="total - bad"),
]
PART_RULES = [
    _rule(41, "expect_column_values_to_be_between", {"column": "p_size", "min_value": 1, "max_value": 40, "mostly": 0.5},
          "count(*)", "0", _C.format("p_size < 1 OR p_size > 40"), _share_ok(0.5)),
    _rule(42, "expect_column_values_to_be_unique", {"column": "p_partkey"},
          "count(*)", "0", "count(*) - count(DISTINCT p_partkey)", _share_ok(1.0), observed="total"),
]

_CUSTOMER_TESTS = {
    21: "c_acctbal < 0 OR c_acctbal > 9000",
    22: "c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')",
    23: "NOT regexp_full_match(c_name, 'Customer#0+[0-9]*[02468]')",
}


def _customer(spark, sf_dir) -> Scope:
    return Scope(load(spark, sf_dir, "customer"), name="customer", primary_key=("c_custkey",))


def _capture(spark, sf_dir):
    scope = _customer(spark, sf_dir)
    rows = failing_rows(scope, [e[0] for e in CUSTOMER_RULES])
    return rows.select(
        F.lit(7).cast("bigint").alias("dataset_run_id"), F.lit(1).cast("bigint").alias("dataset_id"), "*"
    )


_CAPTURE_SQL = " UNION ALL ".join(
    f"SELECT CAST(7 AS BIGINT) AS dataset_run_id, CAST(1 AS BIGINT) AS dataset_id, "
    f"CAST({i} AS BIGINT) AS rule_config_id, * FROM customer WHERE {test}"
    for i, test in _CUSTOMER_TESTS.items()
)
add("fused_capture", _capture, _CAPTURE_SQL)


# --- failure details ------------------------------------------------------------

_DETAIL_RULES = [
    Rule(2, "expect_column_values_to_be_between", {"column": "l_quantity", "min_value": 5, "max_value": 45}),
    Rule(4, "expect_column_values_to_be_in_set", {"column": "l_returnflag", "value_set": ["A"]}),
    Rule(6, "expect_column_values_to_be_in_set", {"column": "l_partkey", "value_set": [1, 2, 3]}),
    Rule(7, "expect_column_values_to_be_unique", {"column": "l_orderkey"}),
]
_DETAIL_TESTS = {
    2: ("l_quantity", "l_quantity < 5 OR l_quantity > 45", "CAST(l_quantity AS DOUBLE)"),
    4: ("l_returnflag", "l_returnflag <> 'A'", "CAST(NULL AS DOUBLE)"),
    6: ("l_partkey", "l_partkey NOT IN (1, 2, 3)", "CAST(l_partkey AS DOUBLE)"),
    7: ("l_orderkey", "l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)",
        "CAST(l_orderkey AS DOUBLE)"),
}


def _values(spark, sf_dir) -> DataFrame:
    scope = Scope(load(spark, sf_dir, "lineitem"), name="lineitem")
    return details.failing_value_counts([compile_rule(scope, r) for r in _DETAIL_RULES], scope)


_VALUES_SQL = " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS rule_config_id, trim(CAST({column} AS VARCHAR)) AS value, count(*) AS rows, "
    f"min({number}) AS low, max({number}) AS high FROM lineitem WHERE {test} GROUP BY {column}"
    for i, (column, test, number) in _DETAIL_TESTS.items()
)


def _profile(spark, sf_dir):
    profile = details.failure_profile(_values(spark, sf_dir))
    return profile.select(
        "rule_config_id",
        "error_total_count",
        "error_unique_count",
        F.round("error_unique_percent", 8).alias("error_unique_percent"),
        F.coalesce("error_min_value", F.lit(-1.0)).alias("error_min_value"),
        F.coalesce("error_max_value", F.lit(-1.0)).alias("error_max_value"),
    )


add(
    "failure_profile",
    _profile,
    f"""
    SELECT rule_config_id, CAST(sum(rows) AS BIGINT) AS error_total_count, count(value) AS error_unique_count,
           round(count(value) * CAST(100.0 AS DOUBLE) / sum(rows), 8) AS error_unique_percent,
           coalesce(min(low), -1.0) AS error_min_value, coalesce(max(high), -1.0) AS error_max_value
    FROM ({_VALUES_SQL}) AS v GROUP BY rule_config_id""",
)
add(
    "failure_top_values",
    lambda spark, sf_dir: details.top_values(_values(spark, sf_dir)),
    f"""
    SELECT rule_config_id, value, rows FROM (
        SELECT *, row_number() OVER (PARTITION BY rule_config_id ORDER BY rows DESC, value) AS rn
        FROM ({_VALUES_SQL}) AS v) AS w WHERE rn <= 1000""",
)


def _matched(spark, sf_dir):
    scope = Scope(load(spark, sf_dir, "orders_q"), name="orders_q")
    kwargs = {"column": "status", "value_set": ["P", "F", "X"]}
    return details.matched_value_counts(scope, Rule(1, "expect_column_values_to_be_in_set", kwargs))


add(
    "matched_value_counts",
    _matched,
    f"SELECT trim(status) AS value, count(*) AS rows, count(DISTINCT status) AS spellings FROM {source('orders_q')} AS s "
    "WHERE trim(status) IN ('P', 'F', 'X') GROUP BY trim(status)",
)


def _distinct_counts(spark, sf_dir):
    return details.value_counts(load(spark, sf_dir, "orders_q"), "status")


add(
    "distinct_value_counts",
    _distinct_counts,
    f"SELECT status AS value, count(*) AS rows FROM {source('orders_q')} AS s WHERE status IS NOT NULL GROUP BY status",
)


_COMBINATION_RULE = Rule(
    1,
    "unexpected_rows_expectation",
    {"unexpected_rows_query": "SELECT * FROM orders WHERE o_totalprice > 300000 AND o_custkey > 0 "
     "AND o_orderstatus <> 'none'", "profile_columns": ["o_custkey", "O_ORDERSTATUS"]},
)


def _combinations(spark, sf_dir):
    """The failing rows of a custom query by the columns that its rule profiles."""
    spec = compile_rule(Scope(load(spark, sf_dir, "orders"), name="orders"), _COMBINATION_RULE).spec
    query = spec.failing()
    return combination_profile(query, query_profile_columns(query, _COMBINATION_RULE))


add(
    "query_combinations",
    _combinations,
    """
    WITH c AS (SELECT concat_ws(',', CAST(o_custkey AS VARCHAR), o_orderstatus) AS value, count(*) AS rows
               FROM orders WHERE o_totalprice > 300000 AND o_custkey > 0 GROUP BY 1)
    SELECT value, rows, (SELECT count(*) FROM c) AS error_unique_count,
           CAST((SELECT sum(rows) FROM c) AS BIGINT) AS error_total_count
    FROM c ORDER BY rows DESC, value LIMIT 1000""",
)

# --- pivot: failing rows against rules ------------------------------------------


def _pivot(spark, sf_dir):
    """Failures of the customers against the rules, one run per nation."""
    scope = _customer(spark, sf_dir)
    rules = [e[0] for e in CUSTOMER_RULES]
    run = F.col("c_nationkey").cast("bigint").alias("dataset_run_id")
    failures = failing_rows(scope, rules).select("*", run)
    passes = {21: F.lit(False), 22: F.lit(False), 23: F.lit(False), 24: F.count(F.lit(1)) <= PIVOT_LIMIT}
    verdict = F.array(
        *[
            F.struct(F.lit(i).cast("bigint").alias("rule_config_id"), ok.alias("is_success"))
            for i, ok in passes.items()
        ]
    )
    results = scope.df.groupBy(run).agg(verdict.alias("v")).select("dataset_run_id", F.inline("v"))
    return pivot_failures(failures, results, _pivot_rules())


# Customers per nation that pass the table rule of the pivot.
PIVOT_LIMIT = 60


def _pivot_rules():
    import json

    rules = [e[0] for e in CUSTOMER_RULES] + [Rule(25, "expect_column_values_to_be_null", {"column": "c_name"})]
    return [
        {
            "rule_config_id": r.rule_config_id,
            "expectation_id": catalog.expectation(r.expectation).expectation_id,
            "kwargs": json.dumps(r.kwargs),
            "column_name": r.kwargs.get("column"),
        }
        for r in rules
    ]


_HEADERS = {r["rule_config_id"]: rule_header(r) for r in _pivot_rules()}
add(
    "failure_pivot",
    _pivot,
    "SELECT CAST(c_nationkey AS BIGINT) AS dataset_run_id, "
    + ", ".join(f"CASE WHEN {test} THEN 'FAIL' ELSE 'PASS' END AS \"{_HEADERS[i]}\"" for i, test in _CUSTOMER_TESTS.items())
    + f", CASE WHEN (SELECT count(*) FROM customer AS n WHERE n.c_nationkey = customer.c_nationkey) > {PIVOT_LIMIT} "
    f"THEN 'FAIL - TABLE CHECK' ELSE 'PASS' END AS \"{_HEADERS[24]}\", "
    f"'NOT CONFIGURED' AS \"{_HEADERS[25]}\", * FROM customer WHERE "
    + " OR ".join(f"({t})" for t in _CUSTOMER_TESTS.values()),
)

# --- runs of a dataset and of a project ------------------------------------------

_DATASETS = ((1, "customer", CUSTOMER_RULES), (2, "orders", ORDER_RULES), (3, "part", PART_RULES))


_PROJECT_SQL = " UNION ALL ".join(
    _result_sql(entries, table, prefix=f"CAST({i} AS BIGINT) AS dataset_id, ") for i, table, entries in _DATASETS
)


_SUMMARY_SQL = f"""
    SELECT dataset_id, count(*) AS evaluated_expectations,
           count(*) FILTER (WHERE is_success) AS successfull_expectations,
           count(*) FILTER (WHERE NOT is_success) AS unsuccessfull_expectations,
           CAST(count(*) FILTER (WHERE is_success) AS DOUBLE) * 100.0 / count(*) AS success_percent,
           CASE WHEN bool_and(is_success) THEN 'SUCCESS' ELSE 'FAILURE' END AS run_status
    FROM ({_PROJECT_SQL}) AS r GROUP BY dataset_id"""

# --- rules: fetching and retrying ----------------------------------------------


def _fetch(spark, sf_dir):
    rules = runnable_rules(
        load(spark, sf_dir, "rule_config_q"), catalog.master_frame(spark), catalog.mapping_frame(spark)
    )
    return rules.select("rule_config_id", "dataset_id", "expectation_id", "expectation_name", "severity", "error_flag")


_CATALOG_SQL = ", ".join(f"({e.expectation_id}, '{e.name}')" for e in catalog.EXPECTATIONS)
add(
    "runnable_rules",
    _fetch,
    f"""
    SELECT cc.rule_config_id, cc.dataset_id, cc.expectation_id, em.name AS expectation_name, cc.severity, cc.error_flag
    FROM {source('rule_config_q')} AS cc
    JOIN (SELECT * FROM (VALUES {_CATALOG_SQL}) AS v(id, name)) AS em ON cc.expectation_id = em.id
    WHERE cc.is_active AND (cc.dq_engine IS NULL OR upper(cc.dq_engine) = 'SQL')""",
)
add(
    "failed_in_latest_run",
    lambda spark, sf_dir: failed_in_latest_run(load(spark, sf_dir, "rule_results_q"), 5),
    f"""
    SELECT DISTINCT rule_config_id FROM {source('rule_results_q')} AS r WHERE dataset_id = 5 AND NOT is_success
    AND dataset_run_id = (SELECT max(dataset_run_id) FROM {source('rule_results_q')} AS s WHERE dataset_id = 5)""",
)
