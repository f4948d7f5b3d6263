"""Whole runs through a store, read back from its tables.

The runs of one session over one set of files are made once, in a database of
their own, and shared by the queries that look at different tables of them; files
that change get runs of their own.
"""

from __future__ import annotations

import datetime
import tempfile
import uuid

from pyspark.sql import functions as F

from plumbline.operators.median import median_frame
from plumbline.plans.parallel import side_by_side
from plumbline.plans.project import run_project
from plumbline.plans.rules import register_dataset, register_rules
from plumbline.plans.runner import run_dataset
from plumbline.rule import Rule
from plumbline.sources.datasets import Dataset
from plumbline.sources.store import Store
from plumbline.suite.helpers import add
from plumbline.suite.run_queries import (
    _CUSTOMER_TESTS,
    _PROJECT_SQL,
    _SUMMARY_SQL,
    CUSTOMER_RULES,
    ORDER_RULES,
    PART_RULES,
)
from plumbline.suite.tables import load, source

NOW = datetime.datetime(2001, 10, 1, 12, 0, 0)
PROJECT, OTHERS = 10, 20

CUSTOM = (
    "SELECT O_ORDERKEY, o_totalprice, c_name AS who, extract(year FROM o_orderdate) AS o_year "
    "FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 250000"
)
PAIR = {"column_A": "p_size", "column_B": "p_partkey"}
SEGMENTS = ["BUILDING", "MACHINERY", "OTHER"]

# Datasets beside those of the project: id, name, table, key columns, candidate key, rules.
BESIDE = (
    (4, "orders_custom", "orders", ["o_orderkey"], None,
     [Rule(61, "unexpected_rows_expectation", {"unexpected_rows_query": CUSTOM})]),
    (5, "orders_recon", "orders", ["o_orderkey"], None,
     [Rule(62, "expect_table_row_count_to_equal_other_table", {"other_dataset_name": "part", "scd_type": 0})]),
    (6, "part_pairs", "part", None, "p_partkey",
     [Rule(63, "expect_column_pair_values_a_to_be_greater_than_b", PAIR)]),
    (7, "customer_lists", "customer", ["c_custkey"], None,
     [Rule(64, "expect_column_distinct_values_to_equal_set", {"column": "c_mktsegment", "value_set": SEGMENTS}),
      Rule(65, "expect_column_most_common_value_to_be_in_set", {"column": "c_nationkey", "value_set": [1], "ties_okay": True})]),
    (8, "customer_faults", "customer", ["c_custkey"], None,
     [Rule(66, "expect_column_values_to_not_be_null", {"column": "c_name"}),
      Rule(67, "expect_column_values_to_not_be_null", {"column": "no_such_column"}),
      Rule(68, "expect_table_row_count_to_equal_other_table", {"other_dataset_name": "o", "scd_type": 0})]),
)
# Orders written as CSV, prices with a blank now and then.
PRICES = [
    Rule(69, "expect_column_values_to_be_between", {"column": "o_totalprice", "min_value": 1000, "max_value": 200000}),
    Rule(70, "expect_column_values_to_be_in_set", {"column": "o_orderstatus", "value_set": ["O", "F"]}),
]

_made: dict[tuple, Store] = {}


def _files(spark, sf_dir) -> tuple:
    """The files of the tables that the runs read, with their sizes and times."""
    paths = [f"{sf_dir}/{t}.parquet" for t in ("customer", "orders", "part")]
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return tuple(sorted(tuple(r) for r in listed.select("path", "length", "modificationTime").collect()))


def _folder(spark) -> str:
    """A folder all machines share: the session's checkpoint folder; a temporary one on a single machine alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("stores of the suite need spark.checkpoint.dir, a folder that all machines share")
    return folder or tempfile.mkdtemp(prefix="plumbline-suite-")


def new_store(spark) -> Store:
    name = f"plumbline_suite_{uuid.uuid4().hex[:12]}"
    return Store(spark, name, f"{_folder(spark)}/{name}").create()


def _with_dataset(rules, dataset_id):
    return [Rule(r.rule_config_id, r.expectation, r.kwargs, dataset_id=dataset_id) for r in rules]


def store_of_runs(spark, sf_dir) -> Store:
    """A store after a project run and the runs of the datasets beside it."""
    key = (spark.sparkContext.applicationId, sf_dir, _files(spark, sf_dir))
    if key in _made:
        return _made[key]
    store = new_store(spark)
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey"}
    for number, (name, entries) in enumerate(
        (("customer", CUSTOMER_RULES), ("orders", ORDER_RULES), ("part", PART_RULES)), 1
    ):
        primary = f'{{"primary_key": ["{keys[name]}"]}}'
        path = f"{sf_dir}/{name}.parquet"
        register_dataset(store, Dataset(number, name, path=path, project_id=PROJECT, primary_key_columns=primary), now=NOW)
        register_rules(store, _with_dataset([e[0] for e in entries], number), now=NOW)
    for number, name, table, primary, candidate, rules in BESIDE:
        path = f"{sf_dir}/{table}.parquet"
        primary = primary and f'{{"primary_key": ["{primary[0]}"]}}'
        dataset = Dataset(number, name, path=path, project_id=OTHERS, primary_key_columns=primary, candidate_key_columns=candidate)
        register_dataset(store, dataset, now=NOW)
        register_rules(store, _with_dataset(rules, number), now=NOW)
    csv = f"{_folder(spark)}/{store.database}_orders_csv"
    schema = "o_orderkey bigint, o_orderstatus string, o_totalprice double"
    options = '{"header": "true"}'
    register_dataset(
        store, Dataset(9, "orders_csv", path=csv, file_format="csv", file_schema=schema, file_options=options), now=NOW
    )
    register_rules(store, _with_dataset(PRICES, 9), now=NOW)
    # A dataset nobody can read; only the rule that names it may notice.
    register_dataset(store, Dataset(99, "o", path=f"{sf_dir}/no_such_table.parquet", project_id=OTHERS), now=NOW)

    def priced_orders():
        priced = F.when(F.col("o_orderkey") % 10 > 0, F.col("o_totalprice")).alias("o_totalprice")
        load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", priced).write.option("header", True).csv(csv)
        run_dataset(store, 9)

    # Runs are many jobs, most of them short: those of one dataset leave room for others'.
    beside = [lambda n=b[0]: run_dataset(store, n) for b in BESIDE]
    side_by_side([lambda: run_project(store, PROJECT), priced_orders, *beside])
    _made[key] = store
    return store


def _read(table, *columns, where="true"):
    def query(spark, sf_dir):
        return store_of_runs(spark, sf_dir).read(table).where(where).select(*columns)

    return query


add(
    "run_rule_results",
    _read("rule_results", "dataset_id", "rule_config_id", "element_count", "unexpected_count", "is_success", where="dataset_id <= 3"),
    f"SELECT dataset_id, rule_config_id, element_count, unexpected_count, is_success FROM ({_PROJECT_SQL}) AS r",
)


def _failure_rows(name, *drop):
    def query(spark, sf_dir):
        store = store_of_runs(spark, sf_dir)
        return spark.table(store.name(f"{name}_dq_failure")).drop("dataset_run_id", "dataset_id", "dq_load_timestamp", *drop)

    return query


_CUSTOMER_FAILURES = " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS rule_config_id, * FROM customer WHERE {test}" for i, test in _CUSTOMER_TESTS.items()
)


def _captured(spark, sf_dir):
    rows = _failure_rows("customer", "query_columns")(spark, sf_dir)
    return rows.withColumn("rule_config_id", F.col("rule_config_id").cast("bigint"))


add("run_failure_rows", _captured, _CUSTOMER_FAILURES)
add(
    "failed_row_keys",
    _read("failed_row_keys", "rule_config_id", "failed_key", where="dataset_id = 1"),
    " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS rule_config_id, concat('{{\"c_custkey\":', c_custkey, '}}') AS failed_key "
        f"FROM customer WHERE {test}"
        for i, test in _CUSTOMER_TESTS.items()
    ),
)
add(
    "failed_candidate_keys",
    _read("failed_row_keys", "rule_config_id", "failed_key", where="dataset_id = 6"),
    "SELECT CAST(63 AS BIGINT) AS rule_config_id, concat('{\"p_partkey\":', p_partkey, '}') AS failed_key "
    "FROM part WHERE NOT (p_size > p_partkey)",
)
add(
    "run_recon_results",
    _read("recon_results", "rule_config_id", "validation_on", "core_value", "conformed_value", "result"),
    """
    WITH c AS (SELECT (SELECT count(*) FROM part) AS a, (SELECT count(*) FROM orders) AS b)
    SELECT CAST(62 AS BIGINT) AS rule_config_id, 'TOTAL_COUNT' AS validation_on, CAST(a AS VARCHAR) AS core_value,
           CAST(b AS VARCHAR) AS conformed_value, CASE WHEN a = b THEN 'PASS' ELSE 'FAIL' END AS result FROM c""",
)
_COUNTS = ("evaluated_expectations", "successfull_expectations", "unsuccessfull_expectations", "success_percent", "run_status")
add(
    "dataset_run_summaries",
    _read("dataset_run_log", "dataset_id", *_COUNTS, where="dataset_id <= 3"),
    _SUMMARY_SQL,
)
add(
    "project_run_summary",
    _read("project_run_log", "datasets_run", "passed", "failed", "run_status", "success_percent"),
    f"""
    SELECT count(*) AS datasets_run, count(*) FILTER (WHERE run_status = 'SUCCESS') AS passed,
           count(*) FILTER (WHERE run_status = 'FAILURE') AS failed,
           CASE WHEN bool_and(run_status = 'SUCCESS') THEN 'SUCCESS' ELSE 'FAILURE' END AS run_status,
           CAST(count(*) FILTER (WHERE run_status = 'SUCCESS') AS DOUBLE) * 100.0 / count(*) AS success_percent
    FROM ({_SUMMARY_SQL}) AS s""",
)
add(
    "run_audit_steps",
    _read("rule_audit_log", "rule_config_id", "step_name", "status", where="dataset_run_id IS NOT NULL AND step_name = 'RULE_EXECUTION' AND rule_config_id < 60"),
    f"SELECT rule_config_id, 'RULE_EXECUTION' AS step_name, 'COMPLETED' AS status FROM ({_PROJECT_SQL}) AS r",
)
add(
    "run_isolation",
    _read("rule_audit_log", "rule_config_id", "status", where="step_name = 'RULE_EXECUTION' AND rule_config_id BETWEEN 66 AND 68"),
    "SELECT CAST(i AS BIGINT) AS rule_config_id, s AS status FROM (VALUES (66, 'COMPLETED'), (67, 'FAILED'), (68, 'FAILED')) AS v(i, s)",
)
add(
    "csv_dataset_run",
    _read("rule_results", "rule_config_id", "element_count", "missing_count", "unexpected_count", where="dataset_id = 9"),
    """
    WITH o AS (SELECT o_orderstatus, CASE WHEN o_orderkey % 10 > 0 THEN o_totalprice END AS p FROM orders)
    SELECT CAST(69 AS BIGINT) AS rule_config_id, count(*) AS element_count, count(*) FILTER (WHERE p IS NULL) AS missing_count,
           count(*) FILTER (WHERE p < 1000 OR p > 200000) AS unexpected_count FROM o
    UNION ALL
    SELECT CAST(70 AS BIGINT), count(*), count(*) FILTER (WHERE trim(o_orderstatus) = ''),
           count(*) FILTER (WHERE trim(o_orderstatus) NOT IN ('O', 'F', '')) FROM o""",
)
_CUSTOM_ROWS = """
    SELECT o_orderkey, CAST(NULL AS {key}) AS o_custkey, CAST(NULL AS VARCHAR) AS o_orderstatus, o_totalprice,
           concat('{{"who":"', c_name, '","o_year":', extract(year FROM o_orderdate), '}}') AS query_columns
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 250000"""


def _custom_rows(rows):
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "query_columns")


add(
    "unexpected_rows_captured",
    lambda spark, sf_dir: _custom_rows(_failure_rows("orders_custom")(spark, sf_dir)),
    _CUSTOM_ROWS.format(key="BIGINT"),
)


def _custom_failing(spark, sf_dir):
    from plumbline.operators import failing

    others = {"customer": load(spark, sf_dir, "customer")}
    kwargs = {"unexpected_rows_query": CUSTOM}
    rows = failing(load(spark, sf_dir, "orders"), "unexpected_rows_expectation", kwargs, name="orders", others=others)
    return _custom_rows(rows)


add("unexpected_rows_failing", _custom_failing, _CUSTOM_ROWS.format(key="BIGINT"))
add(
    "distinct_missing_extra",
    _read("value_lists", "kind", "value", where="rule_config_id = 64 AND kind <> 'observed'"),
    """
    SELECT 'missing' AS kind, v AS value FROM (VALUES ('BUILDING'), ('MACHINERY'), ('OTHER')) AS w(v)
    WHERE v NOT IN (SELECT c_mktsegment FROM customer)
    UNION ALL SELECT DISTINCT 'extra', c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'OTHER')""",
)
add(
    "distinct_observed_values",
    _read("value_lists", "value", "rows", where="rule_config_id = 64 AND kind = 'observed'"),
    "SELECT c_mktsegment AS value, count(*) AS rows FROM customer GROUP BY c_mktsegment",
)
add(
    "all_modes",
    _read("value_lists", "value", "rows", where="rule_config_id = 65"),
    """
    WITH g AS (SELECT CAST(c_nationkey AS VARCHAR) AS value, count(*) AS rows FROM customer GROUP BY c_nationkey)
    SELECT value, rows FROM g WHERE rows = (SELECT max(rows) FROM g)""",
)


def _view(spark, sf_dir):
    """The catalogue view of the custom rule's failures, by verdict."""
    store = store_of_runs(spark, sf_dir)
    rows = spark.table(store.name("vw_customer_dq_failure"))
    header = next(c for c in rows.columns if c.endswith("_21"))
    return rows.groupBy(F.col(f"`{header}`").alias("verdict")).agg(F.count("*").alias("rows"))


_ANY_TEST = " OR ".join(f"({t})" for t in _CUSTOMER_TESTS.values())
add(
    "failure_view_verdicts",
    _view,
    f"SELECT CASE WHEN {_CUSTOMER_TESTS[21]} THEN 'FAIL' ELSE 'PASS' END AS verdict, count(*) AS rows "
    f"FROM customer WHERE {_ANY_TEST} GROUP BY 1",
)

# --- retention ---


def _retention(spark, sf_dir):
    """Rows left and rows reported as deleted after a clean-up of full tables."""
    store = new_store(spark)
    frames = {"rule_results": "rule_results_q", "dataset_run_log": "run_log_q"}
    before = {}
    for table, rows in frames.items():
        store.append(table, load(spark, sf_dir, rows))
        before[table] = store.read(table).count()
    report = {r["table"]: r["rows_deleted"] for r in store.clean_up(NOW)}
    out = []
    for table in frames:
        deleted = F.lit(report[table]).cast("bigint")
        kept = store.read(table).agg(F.count("*").alias("kept"))
        out.append(kept.select(F.lit(table).alias("table_name"), "kept", deleted.alias("deleted")))
    return out[0].unionByName(out[1])


_CUT = "TIMESTAMP '2001-10-01 12:00:00' - INTERVAL 180 DAY"
add(
    "retention",
    _retention,
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) FILTER (WHERE {stamp} >= {_CUT}) AS kept, "
        f"count(*) FILTER (WHERE {stamp} < {_CUT}) AS deleted FROM {source(view)} AS s"
        for name, view, stamp in (
            ("rule_results", "rule_results_q", "run_timestamp"),
            ("dataset_run_log", "run_log_q", "created_timestamp"),
        )
    ),
)

# --- medians with NaN, on both sides of the limit ---

_VALUE = "CASE WHEN l_linenumber = 1 THEN CAST('NaN' AS DOUBLE) ELSE l_extendedprice END"


def _nan_medians(spark, sf_dir):
    value = F.expr(_VALUE)
    frames = [
        median_frame(load(spark, sf_dir, "lineitem"), value, value, **sizes).select(
            F.lit(name).alias("way"), "total", F.round("observed", 6).alias("observed")
        )
        for name, sizes in (("narrowed", {}), ("sorted", {"bins": 1, "steps": 1}))
    ]
    return frames[0].unionByName(frames[1])


add(
    "median_with_nan",
    _nan_medians,
    f"""
    WITH v AS (SELECT {_VALUE} AS x FROM lineitem),
         o AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM v),
         m AS (SELECT any_value(n) AS total, round(avg(x), 6) AS observed FROM o WHERE i IN ((n - 1) // 2, n // 2))
    SELECT way, total, observed FROM m, (VALUES ('narrowed'), ('sorted')) AS w(way)""",
)
