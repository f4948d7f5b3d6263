"""Row-level checks."""

from __future__ import annotations

from plumbline.operators import failing
from plumbline.suite.helpers import (
    add,
    at_least,
    at_most,
    blank,
    counts_sql,
    failures,
    row_check,
    summary,
)
from plumbline.suite.tables import load, source

ORDER_KEYS = "o_orderkey, o_orderstatus"
LINE_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"

row_check(
    "values_not_null", "orders_q", "expect_column_values_to_not_be_null",
    {"column": "PRIORITY", "mostly": 0.5}, bad=blank("priority"), keys=ORDER_KEYS,
)
row_check(
    "values_null", "orders_q", "expect_column_values_to_be_null",
    {"column": "priority", "mostly": 0.4}, bad=f"NOT {blank('priority')}", keys=ORDER_KEYS,
)
row_check(
    "values_between", "lineitem", "expect_column_values_to_be_between",
    {"column": "l_quantity", "min_value": 2, "max_value": 45, "strict_max": True, "mostly": 0.8},
    bad="l_quantity IS NOT NULL AND (l_quantity < 2 OR l_quantity >= 45)",
    missing="l_quantity IS NULL", keys=LINE_KEYS,
)
row_check(
    "text_values_between", "orders_q", "expect_column_values_to_be_between",
    {"column": "price_text", "min_value": "200000", "max_value": 400000},
    bad=f"NOT {blank('price_text')} AND coalesce(TRY_CAST(price_text AS DOUBLE) < 200000 "
    "OR TRY_CAST(price_text AS DOUBLE) > 400000, FALSE)",
    missing=blank("price_text"), keys="o_orderkey, price_text",
)
row_check(
    "values_in_set", "orders_q", "expect_column_values_to_be_in_set",
    {"column": "status", "value_set": ["P", "X"], "mostly": 0.6},
    bad="status IS NOT NULL AND trim(status) <> '' AND trim(status) NOT IN ('P', 'X')",
    missing=blank("status"), observed="total - missing - bad", keys="o_orderkey, status",
)
row_check(
    "numbers_in_set", "part", "expect_column_values_to_be_in_set",
    {"column": "p_size", "value_set": ["1", 2, "3.0", 4, 5, "x"], "mostly": 0.05},
    bad="p_size NOT IN (1, 2, 3, 4, 5)", missing="p_size IS NULL",
    observed="total - missing - bad", keys="p_partkey, p_size",
)
row_check(
    "values_in_long_set", "lineitem", "expect_column_values_to_be_in_set",
    {"column": "l_partkey", "value_set": list(range(1500)), "mostly": 0.7},
    bad="l_partkey >= 1500", missing="l_partkey IS NULL", observed="total - missing - bad", keys=LINE_KEYS,
)
row_check(
    "values_not_in_set", "orders_q", "expect_column_values_to_not_be_in_set",
    {"column": "status", "value_set": '["P", "F"]', "mostly": 0.6},
    bad="status IS NOT NULL AND status IN ('P', 'F')", missing=blank("status"), keys="o_orderkey, status",
)
row_check(
    "matches_regex", "orders_q", "expect_column_values_to_match_regex",
    {"column": "priority", "regex": "[1-2]-[A-Z]+", "mostly": 0.3},
    bad=f"{blank('priority')} OR NOT regexp_full_match(trim(priority), '[1-2]-[A-Z]+')",
    missing=blank("priority"), keys=ORDER_KEYS,
)
row_check(
    "not_matches_regex", "documents", "expect_column_values_to_not_match_regex",
    {"column": "text", "regex": "(?s).*[0-9]{3}.*", "mostly": 0.5},
    bad=f"NOT {blank('text')} AND regexp_full_match(trim(text), '(?s).*[0-9]{{3}}.*')",
    missing=blank("text"), keys="doc_id, lang",
)
row_check(
    "matches_regex_list", "customer", "expect_column_values_to_match_like_pattern_list",
    {"column": "c_name", "regex_list": [".*[02468]", "Customer#0000000.*"], "match_on": "ANY", "mostly": 0.5},
    bad="c_name IS NOT NULL AND NOT (regexp_full_match(c_name, '.*[02468]') "
    "OR regexp_full_match(c_name, 'Customer#0000000.*'))",
    missing="c_name IS NULL", keys="c_custkey, c_name",
)
row_check(
    "matches_regex_list_all", "part", "expect_column_values_to_match_like_pattern_list",
    {"column": "p_name", "regex_list": ["[a-z ]+", ".*r.*"], "match_on": "ALL"},
    bad="p_name IS NOT NULL AND NOT (regexp_full_match(p_name, '[a-z ]+') AND regexp_full_match(p_name, '.*r.*'))",
    missing="p_name IS NULL", keys="p_partkey, p_name",
)
row_check(
    "not_matches_regex_list", "part", "expect_column_values_to_not_match_regex_list",
    {"column": "p_type", "regex_list": ["S.*", ".*A.*"], "match_on": "ALL", "mostly": 0.6},
    bad="p_type IS NOT NULL AND (regexp_full_match(p_type, 'S.*') AND regexp_full_match(p_type, '.*A.*'))",
    missing="p_type IS NULL", keys="p_partkey, p_type",
)
row_check(
    "not_matches_regex_list_any", "documents", "expect_column_values_to_not_match_regex_list",
    {"column": "source", "regex_list": ["src1.", ".*9"], "mostly": 0.4},
    bad="source IS NOT NULL AND (regexp_full_match(source, 'src1.') OR regexp_full_match(source, '.*9'))",
    missing="source IS NULL", keys="doc_id, source",
)
row_check(
    "lengths_between", "documents", "expect_column_value_lengths_to_be_between",
    {"column": "text", "min_value": 100, "max_value": 5000, "mostly": 0.7, "strict_min": True},
    bad=f"NOT {blank('text')} AND (length(text) < 100 OR length(text) > 5000)",
    missing=blank("text"), gate=at_least, keys="doc_id, n_chars",
)
row_check(
    "lengths_equal", "orders_q", "expect_column_value_lengths_to_equal",
    {"column": "status", "value": 1, "mostly": 0.7},
    bad="status IS NOT NULL AND length(status) <> 1", missing="status IS NULL", keys="o_orderkey, status",
)
row_check(
    "pair_a_greater_than_b", "events_q", "expect_column_pair_values_a_to_be_greater_than_b",
    {"column_A": "paid", "column_B": "due", "ignore_row_if": "any_value_is_missing", "mostly": 0.7},
    bad="paid IS NOT NULL AND due IS NOT NULL AND NOT (paid > due)",
    missing="FALSE", total="paid IS NOT NULL AND due IS NOT NULL",
    gate=lambda mostly: at_most(mostly, total="(total - missing)"), keys="event_id, event_type",
)
row_check(
    "pair_a_at_least_b", "events_q", "expect_column_pair_values_a_to_be_greater_than_b",
    {"column_A": "due", "column_B": "paid", "or_equal": True, "mostly": 0.4},
    bad="paid IS NOT NULL AND due IS NOT NULL AND NOT (due >= paid)",
    missing="paid IS NULL OR due IS NULL",
    gate=lambda mostly: at_most(mostly, total="(total - missing)"), keys="event_id, event_type",
)
row_check(
    "pair_equal", "events_q", "expect_column_pair_values_to_be_equal",
    {"column_A": "paid", "column_B": "due", "mostly": 0.1},
    bad="paid IS DISTINCT FROM due AND NOT (paid IS NULL AND due IS NULL)",
    total="NOT (paid IS NULL AND due IS NULL)", keys="event_id, event_type",
)
row_check(
    "pair_equal_either", "events_q", "expect_column_pair_values_to_be_equal",
    {"column_A": "paid", "column_B": "due", "ignore_row_if": "EITHER_VALUE_IS_MISSING", "mostly": 0.3},
    bad="paid IS DISTINCT FROM due AND NOT (paid IS NULL OR due IS NULL)",
    total="NOT (paid IS NULL OR due IS NULL)", keys="event_id, event_type",
)
row_check(
    "pair_in_set", "orders_q", "expect_column_pair_values_to_be_in_set",
    {"column_A": "status", "column_B": "priority",
     "value_pairs_set": [["F", "1-URGENT"], [" P ", "2-HIGH"], [None, "3-MEDIUM"]], "mostly": 0.1},
    bad="NOT (status IS NULL AND priority IS NULL) AND NOT ("
    "(status IS NOT DISTINCT FROM 'F' AND priority IS NOT DISTINCT FROM '1-URGENT') OR "
    "(status IS NOT DISTINCT FROM ' P ' AND priority IS NOT DISTINCT FROM '2-HIGH') OR "
    "(status IS NULL AND priority IS NOT DISTINCT FROM '3-MEDIUM'))",
    total="NOT (status IS NULL AND priority IS NULL)", missing="status IS NULL AND priority IS NULL",
    keys="o_orderkey, o_orderstatus",
)
row_check(
    "multicolumn_sum", "lineitem", "expect_multicolumn_sum_to_equal",
    {"column_list": ["l_quantity", "l_linenumber"], "sum_total": 20, "mostly": 0.01},
    bad="abs((coalesce(l_quantity, 0) + coalesce(CAST(l_linenumber AS DOUBLE), 0)) - 20) > 0.0001",
    missing="l_quantity IS NULL OR l_linenumber IS NULL", gate=at_least, keys=LINE_KEYS,
)
row_check(
    "multicolumn_sum_all_present", "events_q", "expect_multicolumn_sum_to_equal",
    {"column_list": "paid, due", "sum_total": "20", "ignore_row_if": "either", "mostly": 0.01},
    bad="abs((coalesce(paid, 0) + coalesce(due, 0)) - 20) > 0.0001 AND NOT (paid IS NULL OR due IS NULL)",
    missing="paid IS NULL OR due IS NULL", total="NOT (paid IS NULL OR due IS NULL)", gate=at_least,
    keys="event_id, event_type",
)
row_check(
    "unique_within_record", "lineitem", "expect_select_column_values_to_be_unique_within_record",
    {"column_list": ["l_orderkey", "l_partkey", "l_suppkey"], "mostly": 0.99},
    bad="l_orderkey = l_partkey OR l_orderkey = l_suppkey OR l_partkey = l_suppkey", keys=LINE_KEYS,
)
row_check(
    "unique_within_record_ignoring", "orders_q", "expect_select_column_values_to_be_unique_within_record",
    {"column_list": "status, o_orderstatus", "ignore_row_if": "ANY_VALUE_IS_MISSING", "mostly": 0.6},
    bad="NOT (status IS NULL OR o_orderstatus IS NULL) AND status = o_orderstatus",
    missing="status IS NULL OR o_orderstatus IS NULL", total="NOT (status IS NULL OR o_orderstatus IS NULL)",
    gate=lambda mostly: at_most(mostly, total="(total + missing)"),
    percent="CAST(bad AS DOUBLE) / (total + missing) * 100", keys="o_orderkey, status",
)
row_check(
    "values_of_type_number", "orders_q", "expect_column_values_to_be_of_type",
    {"column": "price_text", "type_": "NUMBER(38,0)", "mostly": 0.9},
    bad=f"NOT {blank('price_text')} AND TRY_CAST(trim(price_text) AS DECIMAL(38,0)) IS NULL",
    missing=blank("price_text"), keys="o_orderkey, price_text",
)
row_check(
    "values_of_type_date", "events_q", "expect_column_values_to_be_of_type",
    {"column": "day_text", "type_": "DATE"},
    bad=f"NOT {blank('day_text')} AND TRY_CAST(trim(day_text) AS DATE) IS NULL",
    missing=blank("day_text"), keys="event_id, day_text",
)
row_check(
    "values_of_type_same", "lineitem", "expect_column_values_to_be_of_type",
    {"column": "l_quantity", "type_": "FLOAT"}, bad="FALSE", with_rows=False,
)
row_check(
    "values_of_type_never", "orders", "expect_column_values_to_be_of_type",
    {"column": "o_orderdate", "type_": "INTEGER", "mostly": 0.0}, bad="TRUE", success="FALSE",
    with_rows=False,
)
row_check(
    "values_in_given_format", "events_q", "expect_column_values_to_be_in_given_format",
    {"column": "day_text", "format": "yyyy-MM-dd", "mostly": 0.7},
    bad=f"NOT {blank('day_text')} AND try_strptime(day_text, '%Y-%m-%d') IS NULL",
    missing=blank("day_text"), keys="event_id, day_text",
)

# --- z-scores: mean and deviation of the whole table, then the rows ---------

_SCORED = (
    "(SELECT src.*, (l_extendedprice - mean) / nullif(sd, 0) AS score, mean FROM lineitem AS src, "
    "(SELECT avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS sd FROM lineitem) AS stats)"
)
for _name, _double, _test in (
    ("z_scores_below", False, "score < 1.5"),
    ("z_scores_within", True, "abs(score) < 1.5"),
):
    _kwargs = {"column": "l_extendedprice", "threshold": 1.5, "double_sided": _double, "mostly": 0.9}
    add(
        _name,
        summary("lineitem", "expect_column_value_z_scores_to_be_less_than", _kwargs, digits=2),
        counts_sql(
            "expect_column_value_z_scores_to_be_less_than",
            f"count(*) AS total, count(*) FILTER (WHERE score IS NULL) AS missing, "
            f"count(*) FILTER (WHERE NOT ({_test})) AS bad, max(mean) AS mean",
            "lineitem", at_most(0.9), missing="missing", observed="mean", digits=2,
        ).replace("FROM lineitem AS src)", f"FROM {_SCORED} AS src)"),
    )
    add(
        f"{_name}_failing",
        failures("lineitem", "expect_column_value_z_scores_to_be_less_than", _kwargs, LINE_KEYS),
        f"SELECT {LINE_KEYS} FROM {_SCORED} AS src WHERE NOT ({_test})",
    )

# --- uniqueness --------------------------------------------------------------

_GROUPS = "SELECT {keys}, count(*) AS n FROM {source} AS src GROUP BY ALL"

for _name, _table, _column, _mostly, _keys in (
    ("values_unique", "orders_q", "priority", 0.1, ORDER_KEYS),
    ("keys_unique", "orders", "o_custkey", 0.5, "o_orderkey, o_custkey"),
    ("texts_unique", "documents", "text", 0.8, "doc_id, n_chars"),
):
    _kwargs = {"column": _column, "mostly": _mostly, "by_hash": _column == "text"}
    add(
        _name,
        summary(_table, "expect_column_values_to_be_unique", _kwargs),
        counts_sql(
            "expect_column_values_to_be_unique",
            f"coalesce(sum(n), 0) AS total, coalesce(sum(n) FILTER (WHERE {blank('k')}), 0) AS missing, "
            f"coalesce(sum(n) FILTER (WHERE n > 1 AND NOT {blank('k')}), 0) AS bad, "
            f"count(*) FILTER (WHERE NOT {blank('k')}) AS uniq",
            _table, at_least(_mostly), missing="missing", observed="uniq",
        ).replace(
            f"FROM {source(_table)} AS src)",
            f"FROM ({_GROUPS.format(keys=f'{_column} AS k', source=source(_table))}) AS g)",
        ),
    )
    add(
        f"{_name}_failing",
        failures(_table, "expect_column_values_to_be_unique", _kwargs, _keys),
        f"SELECT {_keys} FROM (SELECT *, count(*) OVER (PARTITION BY {_column}) AS n FROM {source(_table)} AS src "
        f"WHERE NOT {blank(_column)}) AS w WHERE n > 1",
    )

for _name, _table, _columns, _ignore, _ignored, _mostly, _order, _keys in (
    ("compound_unique", "lineitem", ["l_orderkey", "l_linenumber"], None, "FALSE", 0.7,
     "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
     "l_returnflag, l_linestatus, l_shipdate", "l_orderkey, l_linenumber, l_partkey, l_suppkey"),
    ("compound_unique_ignoring", "orders_q", ["o_custkey", "priority"], "ANY_VALUE_IS_MISSING",
     "o_custkey IS NULL OR priority IS NULL", 0.2, "o_orderkey", "o_orderkey, o_custkey"),
):
    _kwargs = {"column_list": _columns, "ignore_row_if": _ignore, "mostly": _mostly}
    _keylist = ", ".join(_columns)
    _pk = () if _ignore is None else ("o_orderkey",)
    add(
        _name,
        summary(_table, "expect_compound_columns_to_be_unique", _kwargs, primary_key=_pk),
        counts_sql(
            "expect_compound_columns_to_be_unique",
            f"coalesce(sum(n) FILTER (WHERE NOT ({_ignored})), 0) AS total, "
            f"coalesce(sum(n) FILTER (WHERE {_ignored}), 0) AS missing, "
            f"coalesce(sum(n - 1) FILTER (WHERE NOT ({_ignored})), 0) AS bad",
            _table, at_most(_mostly), missing="missing",
        ).replace(
            f"FROM {source(_table)} AS src)",
            f"FROM ({_GROUPS.format(keys=_keylist, source=source(_table))}) AS g)",
        ),
    )
    add(
        f"{_name}_failing",
        failures(_table, "expect_compound_columns_to_be_unique", _kwargs, _keys, primary_key=_pk),
        f"SELECT {_keys} FROM (SELECT *, row_number() OVER (PARTITION BY {_keylist} ORDER BY {_order}) AS rn "
        f"FROM {source(_table)} AS src WHERE NOT ({_ignored})) AS w WHERE rn > 1",
    )

# --- custom query --------------------------------------------------------------

_QUERY = (
    "SELECT o.o_orderkey, o.o_totalprice, c.c_mktsegment FROM orders o JOIN customer c "
    "ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 400000 AND c.c_acctbal < 0"
)
_CUSTOM = {"unexpected_rows_query": _QUERY}
add(
    "unexpected_rows",
    summary("orders", "unexpected_rows_expectation", _CUSTOM, others=("customer",)),
    f"""
    WITH m AS (SELECT (SELECT count(*) FROM orders) AS total, (SELECT count(*) FROM ({_QUERY})) AS bad)
    SELECT 'unexpected_rows_expectation' AS expectation, total AS element_count,
           CAST(0 AS BIGINT) AS missing_count, bad AS unexpected_count,
           round(CAST(bad AS DOUBLE) / total * 100, 8) AS unexpected_percent,
           CAST(0.0 AS DOUBLE) AS observed_value, bad = 0 AS is_success FROM m""",
)


def _limited(spark, sf_dir):
    """Capture limit: the number of rows kept, not which, is defined."""
    df = load(spark, sf_dir, "orders_q")
    kwargs = {"column": "priority", "failed_row_count": 25}
    return failing(df, "expect_column_values_to_not_be_null", kwargs).groupBy().count().withColumnRenamed(
        "count", "rows_kept"
    )


add(
    "capture_limit",
    _limited,
    f"SELECT least(count(*), 25) AS rows_kept FROM {source('orders_q')} AS src WHERE {blank('priority')}",
)

