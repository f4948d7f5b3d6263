"""Checks on schemas and row counts, and reconciliation."""

from __future__ import annotations

from plumbline.operators.recon import latest_audit_entry
from plumbline.plans.evaluate import evaluate
from plumbline.plans.state import latest_watermarks
from plumbline.rule import Rule
from plumbline.sources.datasets import Scope, since
from plumbline.suite.helpers import add, counts_sql, summary, summary_columns
from plumbline.suite.tables import load, source

LINEITEM = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
    "l_returnflag l_linestatus l_shipdate"
).split()


# The table's columns as the other engine sees them, by position.
_COLUMNS = "cols AS (SELECT column_name AS name, row_number() OVER () - 1 AS i FROM (DESCRIBE SELECT * FROM lineitem))"


def _list_sql(names) -> str:
    """Expected names by position; ``CS:`` marks those compared with their case."""
    rows = [f"({k}, '{n.removeprefix('CS:')}', {n.startswith('CS:')})" for k, n in enumerate(names)]
    return f"wanted AS (SELECT * FROM (VALUES {', '.join(rows)}) AS v(i, name, exact))"


def _schema_sql(expectation, total, bad, ok, observed="0", percent=None, also=""):
    """Schema checks from the described table: counts as scalar SQL over ``cols`` and ``wanted``."""
    percent = percent or "CASE WHEN bad = 0 THEN 0.0 ELSE 100.0 END"
    return (
        f"WITH {_COLUMNS}{', ' + also if also else ''}, "
        f"found AS (SELECT CAST(({total}) AS BIGINT) AS total, CAST(({bad}) AS BIGINT) AS bad, ({ok}) AS ok, "
        f"CAST(({observed}) AS DOUBLE) AS observed) "
        f"SELECT '{expectation}' AS expectation, total AS element_count, CAST(0 AS BIGINT) AS missing_count, "
        f"bad AS unexpected_count, round({percent}, 8) AS unexpected_percent, observed AS observed_value, ok AS is_success FROM found"
    )


def _exists_sql(expectation, column, index):
    at = f"SELECT max(i) FROM cols WHERE lower(name) = '{column.lower()}'"
    return _schema_sql(expectation, "1", f"CASE WHEN ({at}) = {index} THEN 0 ELSE 1 END", f"coalesce(({at}) = {index}, false)", at)


def _count_sql(expectation, test):
    whole = "SELECT count(*) FROM cols"
    holds = test.format(n=f"({whole})")
    return _schema_sql(expectation, whole, f"CASE WHEN {holds} THEN 0 ELSE 1 END", holds, whole)


_SAME = "(CASE WHEN w.exact THEN w.name = c.name ELSE lower(w.name) = lower(c.name) END)"
_MISSING = f"(SELECT count(*) FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM cols c WHERE {_SAME}))"
# A column is extra only if no expected name is the same but for case.
_EXTRA = "(SELECT count(*) FROM cols c WHERE NOT EXISTS (SELECT 1 FROM wanted w WHERE lower(w.name) = lower(c.name)))"
_SHARE = "bad * 100.0 / total"


def _set_sql(expectation, names, exact):
    bad = f"{_MISSING} + {_EXTRA}"
    ok = f"{bad} = 0" if exact else f"{_MISSING} = 0"
    return _schema_sql(expectation, "SELECT count(*) FROM wanted", bad, ok, percent=_SHARE, also=_list_sql(names))


def _order_sql(expectation, names):
    bad = "SELECT count(*) FROM wanted w FULL JOIN cols c ON w.i = c.i WHERE w.name IS DISTINCT FROM c.name"
    return _schema_sql(
        expectation, "SELECT count(*) FROM wanted", bad, f"({bad}) = 0", percent=_SHARE, also=_list_sql(names)
    )


# Schema checks read metadata; each is run with the row count of its table.
_ROWS = Rule(99, "expect_table_row_count_to_be_between", {"min_value": 1})
_ROWS_SQL = (
    "SELECT 'expect_table_row_count_to_be_between', count(*), CAST(0 AS BIGINT), "
    "CAST(CASE WHEN count(*) >= 1 THEN 0 ELSE 1 END AS BIGINT), CASE WHEN count(*) >= 1 THEN 0.0 ELSE 100.0 END, "
    "CAST(count(*) AS DOUBLE), count(*) >= 1 FROM lineitem"
)

_SET = LINEITEM[:9] + ["CS:l_linestatus", "CS:L_SHIPDATE"]
_ORDER = LINEITEM[:8] + ["L_RETURNFLAG"]
_EXISTS, _SETS = "expect_column_to_exist", "expect_table_columns_to_match_set"
_EQUALS, _WITHIN = "expect_table_column_count_to_equal", "expect_table_column_count_to_be_between"
_ORDERED = "expect_table_columns_to_match_ordered_list"

for _name, _expectation, _kwargs, _sql in (
    ("column_exists", _EXISTS, {"column": "L_TAX", "column_index": 7}, _exists_sql(_EXISTS, "l_tax", 7)),
    ("column_exists_elsewhere", _EXISTS, {"column": "l_tax", "column_index": 2}, _exists_sql(_EXISTS, "l_tax", 2)),
    ("column_count_equal", _EQUALS, {"value": 11}, _count_sql(_EQUALS, "{n} = 11")),
    ("column_count_between", _WITHIN, {"min_value": 11, "max_value": 20, "strict_min": True},
     _count_sql(_WITHIN, "({n} > 11 AND {n} <= 20)")),
    ("columns_match_set", _SETS, {"column_set": _SET}, _set_sql(_SETS, _SET, True)),
    ("columns_match_subset", _SETS, {"column_set": "l_orderkey, L_TAX", "exact_match": False},
     _set_sql(_SETS, ["l_orderkey", "L_TAX"], False)),
    ("columns_match_ordered_list", _ORDERED, {"column_list": _ORDER}, _order_sql(_ORDERED, _ORDER)),
):
    def _schema(spark, sf_dir, expectation=_expectation, kwargs=_kwargs):
        scope = Scope(load(spark, sf_dir, "lineitem"), name="lineitem")
        return summary_columns(evaluate(scope, [Rule(1, expectation, kwargs), _ROWS]))

    add(_name, _schema, f"{_sql} UNION ALL {_ROWS_SQL}")


def _volume(name, expectation, kwargs, ok):
    add(
        name,
        summary("orders", expectation, kwargs),
        counts_sql(
            expectation, "count(*) AS total", "orders", ok, bad=f"CASE WHEN {ok} THEN 0 ELSE 1 END",
            percent=f"CASE WHEN {ok} THEN 0.0 ELSE 100.0 END", observed="total",
        ),
    )


_volume("row_count_between", "expect_table_row_count_to_be_between",
        {"min_value": 10, "max_value": 1000000000}, "total >= 10 AND total <= 1000000000")
_volume("row_count_equal", "expect_table_row_count_to_equal", {"value": 15000}, "total = 15000")

# --- reconciliation --------------------------------------------------------------

_EQUAL = "expect_table_row_count_to_equal_other_table"


def _reconciled(core: str, conformed: str, core2: str = "0", conformed2: str = "0") -> str:
    """Verdict over up to two pairs of counts."""
    return f"""
        WITH m AS (SELECT ({core}) AS a, ({conformed}) AS b, ({core2}) AS c, ({conformed2}) AS d)
        SELECT '{_EQUAL}' AS expectation, a AS element_count, CAST(0 AS BIGINT) AS missing_count,
               CAST(abs(a - b) + abs(c - d) AS BIGINT) AS unexpected_count,
               CAST(0.0 AS DOUBLE) AS unexpected_percent, CAST(0.0 AS DOUBLE) AS observed_value,
               a = b AND c = d AS is_success FROM m"""


def _recon(name, target, source_name, kwargs, oracle, marks=None):
    kwargs = {"source_table": source_name, **kwargs}
    add(name, summary(target, _EQUAL, kwargs, others=(source_name,), watermarks={1: marks} if marks else {}), oracle)


_recon("row_count_equal_other_table", "nation", "region", {},
       _reconciled("SELECT count(*) FROM region", "SELECT count(*) FROM nation"))
_recon(
    "recon_current_state", "sales_current", "sales_core",
    {"scd_type": 1, "partition_keys": "customer_id", "recon_mode": "full"},
    _reconciled(
        f"SELECT count(DISTINCT customer_id) FROM {source('sales_core')} AS s",
        f"SELECT count(*) FROM {source('sales_current')} AS s",
    ),
)
_recon(
    "recon_current_state_incremental", "sales_current", "sales_core",
    {"scd_type": 1, "partition_keys": ["customer_id"]},
    _reconciled(
        f"SELECT count(*) FROM (SELECT customer_id, max(insert_date_time) AS d FROM {source('sales_core')} AS s "
        "GROUP BY customer_id) AS k WHERE d > TIMESTAMP '2001-01-01'",
        f"SELECT count(*) FROM {source('sales_current')} AS s WHERE update_date_time > TIMESTAMP '2000-12-01'",
    ),
    marks=("2001-01-01 00:00:00", "2000-12-01 00:00:00"),
)
_recon(
    "recon_history_full", "sales_history", "sales_core",
    {"scd_type": 2, "partition_keys": "customer_id"},
    _reconciled(
        f"SELECT count(DISTINCT customer_id) FROM {source('sales_core')} AS s",
        f"SELECT count(*) FROM {source('sales_history')} AS s WHERE is_active = 'Y'",
    ),
)
_LATEST = (
    f"SELECT customer_id, max(insert_date_time) AS d FROM {source('sales_core')} AS s GROUP BY customer_id "
    "HAVING max(insert_date_time) > TIMESTAMP '2000-01-01'"
)
_recon(
    "recon_history_incremental", "sales_history", "sales_core",
    {"scd_type": 2, "partition_keys": "customer_id", "recon_mode": "incremental"},
    _reconciled(
        f"SELECT count(*) FROM ({_LATEST}) AS k",
        f"SELECT count(*) FROM {source('sales_history')} AS s WHERE update_date_time > TIMESTAMP '2000-06-01' AND is_active = 'Y'",
        f"SELECT count(*) FROM ({_LATEST}) AS k WHERE customer_id IN (SELECT customer_id FROM {source('sales_history')} AS s "
        "WHERE insert_date_time <= TIMESTAMP '2000-06-01')",
        f"SELECT count(*) FROM {source('sales_history')} AS s WHERE update_date_time > TIMESTAMP '2000-06-01' AND is_active = 'N'",
    ),
    marks=("2000-01-01 00:00:00", "2000-06-01 00:00:00"),
)
_recon(
    "recon_history_first_seen", "sales_changes", "sales_core",
    {"scd_type": 2, "partition_keys": "customer_id"},
    _reconciled(
        f"SELECT count(*) FROM ({_LATEST}) AS k",
        f"SELECT count(*) FROM {source('sales_changes')} AS s WHERE update_date_time > TIMESTAMP '1995-06-01' AND is_active = 'Y'",
        f"SELECT count(*) FROM ({_LATEST}) AS k WHERE customer_id IN (SELECT customer_id FROM {source('sales_changes')} AS s "
        "GROUP BY customer_id HAVING min(update_date_time) <= TIMESTAMP '1995-06-01')",
        f"SELECT count(*) FROM {source('sales_changes')} AS s WHERE update_date_time > TIMESTAMP '1995-06-01' AND is_active = 'N'",
    ),
    marks=("2000-01-01 00:00:00", "1995-06-01 00:00:00"),
)

_FILE = "expect_table_row_count_to_equal_source_file"
for _name, _target in (
    ("source_file_count", "sales.core.orders_core"),
    ("source_file_count_other", "SALES.CORE.REGION_X"),
    ("source_file_count_unknown", "SALES.CORE.NOTHING"),
):
    _entry = (
        f"SELECT number_of_records_source AS src, number_of_records_target AS core FROM {source('audit_log_q')} AS s "
        f"WHERE lower(target_table) = lower('{_target}') AND sync_level = 'SOURCE_TO_CORE' "
        "ORDER BY sync_start_date_time DESC LIMIT 1"
    )
    add(
        _name,
        summary("orders", _FILE, {"audit_control_table": "audit_log_q", "target_table": _target, "source_labels": {"REGION": "AREAS"}},
                others=("audit_log_q",)),
        f"""
        WITH e AS ({_entry}), m AS (SELECT max(src) AS src, max(core) AS core, count(*) AS n FROM e)
        SELECT '{_FILE}' AS expectation, CAST(coalesce(core, 0) AS BIGINT) AS element_count,
               CAST(0 AS BIGINT) AS missing_count, CAST(coalesce(abs(src - core), 0) AS BIGINT) AS unexpected_count,
               CAST(0.0 AS DOUBLE) AS unexpected_percent, CAST(0.0 AS DOUBLE) AS observed_value,
               n > 0 AND coalesce(src = core, FALSE) AS is_success FROM m""",
    )


def _audit_entry(spark, sf_dir):
    return latest_audit_entry(load(spark, sf_dir, "audit_log_q"), Rule(1, _FILE, {}), "SALES.CORE.customers_core")


add(
    "latest_audit_entry",
    _audit_entry,
    f"SELECT number_of_records_source AS src, number_of_records_target AS core, target_table AS target "
    f"FROM {source('audit_log_q')} AS s WHERE lower(target_table) = 'sales.core.customers_core' "
    "ORDER BY sync_start_date_time DESC LIMIT 1",
)


def _marks(spark, sf_dir):
    return latest_watermarks(load(spark, sf_dir, "rule_results_q"))


add(
    "latest_watermarks",
    _marks,
    f"""
    WITH r AS (
        SELECT rule_config_id, run_timestamp, dataset_run_id,
               coalesce(json_extract_string(observed_value, '$.core_watermark'),
                        json_extract_string(observed_value, '$.watermark')) AS core,
               coalesce(json_extract_string(observed_value, '$.conf_watermark'),
                        json_extract_string(observed_value, '$.watermark')) AS conf
        FROM {source('rule_results_q')} AS s WHERE is_success AND observed_value IS NOT NULL)
    SELECT rule_config_id, core, conf FROM (
        SELECT *, row_number() OVER (PARTITION BY rule_config_id
                  ORDER BY run_timestamp DESC, dataset_run_id DESC, core DESC, conf DESC) AS rn FROM r) AS w WHERE rn = 1""",
)


def _incremental(spark, sf_dir):
    rows = load(spark, sf_dir, "events")
    scope = Scope(rows, name="events").narrowed("TS", "2024-01-20 00:00:00")
    return summary_columns(
        evaluate(
            scope,
            [
                Rule(1, "expect_column_values_to_be_in_set", {"column": "event_type", "value_set": ["view", "click"]}),
                Rule(2, "expect_column_value_z_scores_to_be_less_than", {"column": "value", "threshold": 2}),
            ],
        ),
        digits=2,
    )


add(
    "incremental_scan",
    _incremental,
    """
    WITH n AS (SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-20'),
         st AS (SELECT avg(value) AS mean, stddev_samp(value) AS sd FROM events),
         a AS (SELECT count(*) AS total, count(*) FILTER (WHERE event_type NOT IN ('view', 'click')) AS bad FROM n),
         z AS (SELECT count(*) AS total, count(*) FILTER (WHERE NOT ((value - mean) / sd < 2)) AS bad, max(mean) AS mean
               FROM n, st)
    SELECT 'expect_column_values_to_be_in_set' AS expectation, total AS element_count, CAST(0 AS BIGINT) AS missing_count,
           bad AS unexpected_count, round(CAST(bad AS DOUBLE) / total * 100, 8) AS unexpected_percent,
           round(CAST(total - bad AS DOUBLE), 2) AS observed_value, bad = 0 AS is_success FROM a
    UNION ALL
    SELECT 'expect_column_value_z_scores_to_be_less_than', total, 0, bad,
           round(CAST(bad AS DOUBLE) / total * 100, 8), round(mean, 2), bad = 0 FROM z""",
)


def _since(spark, sf_dir):
    return since(load(spark, sf_dir, "events"), "ts", "2024-01-25 12:00:00").select("event_id", "user_id", "value")


add(
    "rows_since_watermark",
    _since,
    "SELECT event_id, user_id, value FROM events WHERE ts > TIMESTAMP '2024-01-25 12:00:00'",
)
