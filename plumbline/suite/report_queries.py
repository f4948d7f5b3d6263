"""Reports over the framework's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import rule_problems, schema_frame
from plumbline.plans import reports
from plumbline.plans.pivot import shown_rules
from plumbline.suite.helpers import add
from plumbline.suite.tables import load, source


def _frames(spark, sf_dir, *names):
    return [load(spark, sf_dir, n) for n in names]


RULES, RUNS, RESULTS = source("rule_config_q"), source("run_log_q"), source("rule_results_q")
RECON, SETS = source("recon_results_q"), source("dataset_q")

add(
    "active_rules_by_severity",
    lambda spark, d: reports.active_rules_by_severity(load(spark, d, "rule_config_q")),
    f"SELECT severity, count(*) AS cnt FROM {RULES} AS r WHERE is_active GROUP BY severity",
)
add(
    "rules_by_dimension",
    lambda spark, d: reports.rules_by_dimension(load(spark, d, "rule_config_q")),
    f"SELECT dimension, count(*) AS cnt FROM {RULES} AS r GROUP BY dimension",
)
add(
    "recent_runs",
    lambda spark, d: reports.recent_runs(*_frames(spark, d, "run_log_q", "dataset_q")).drop("created_timestamp"),
    f"""
    SELECT d.dataset_name, l.dataset_run_id, l.run_status, l.successfull_expectations,
           l.unsuccessfull_expectations, l.success_percent
    FROM {RUNS} AS l LEFT JOIN {SETS} AS d ON l.dataset_id = d.dataset_id
    ORDER BY l.created_timestamp DESC, l.dataset_run_id DESC LIMIT 8""",
)
add(
    "recon_health",
    lambda spark, d: reports.recon_health(*_frames(spark, d, "recon_results_q", "dataset_q")).drop("last_run"),
    f"""
    SELECT d.dataset_name, CAST(sum(CASE WHEN rr.result = 'PASS' THEN 1 ELSE 0 END) AS BIGINT) AS passed,
           count(*) AS total
    FROM {RECON} AS rr LEFT JOIN {SETS} AS d ON rr.dataset_id = d.dataset_id
    WHERE rr.dataset_run_id IN (SELECT max(dataset_run_id) FROM {RECON} AS x GROUP BY dataset_id)
    GROUP BY d.dataset_name""",
)


def _feed(spark, d):
    projects = load(spark, d, "orders").select(
        F.col("o_orderpriority").alias("created_by"),
        F.col("o_orderdate").alias("created_timestamp"),
        F.concat(F.lit("Order "), F.col("o_orderkey")).alias("project_name"),
    )
    sets = load(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("created_by"),
        F.col("l_shipdate").alias("created_timestamp"),
        F.concat(F.lit("Line "), F.col("l_orderkey"), F.lit(" "), F.col("l_partkey")).alias("dataset_name"),
    )
    rules = load(spark, d, "events").select(
        F.col("event_type").alias("created_by"),
        F.col("ts").alias("created_timestamp"),
        F.concat(F.lit("Event "), F.col("event_id")).alias("expectation_name"),
    )
    feed = reports.activity_feed(projects, sets, rules)
    return feed.select("user", "action", "detail", F.date_format("timestamp", "yyyy-MM-dd").alias("day"))


add(
    "activity_feed",
    _feed,
    """
    SELECT user, action, detail, strftime(t, '%Y-%m-%d') AS day FROM (
        SELECT o_orderpriority AS user, CAST(o_orderdate AS TIMESTAMP) AS t, 'Project Created' AS action, concat('Order ', o_orderkey) AS detail
        FROM orders
        UNION ALL SELECT l_returnflag, CAST(l_shipdate AS TIMESTAMP), 'Dataset Created', concat('Line ', l_orderkey, ' ', l_partkey) FROM lineitem
        UNION ALL SELECT event_type, ts, 'Rule Created', concat('Event ', event_id) FROM events) AS f
    ORDER BY t DESC, action, detail LIMIT 20""",
)


def _run_results(spark, d, run_id=None):
    rows = reports.run_results(*_frames(spark, d, "rule_results_q", "rule_config_q"), 5, run_id)
    return rows.drop("run_timestamp")


_RESULTS_SQL = f"""
    SELECT r.rule_config_id, r.dataset_run_id, r.expectation_name, r.is_success, r.element_count, r.unexpected_count,
           r.unexpected_percent, rc.column_name, rc.severity, rc.dimension
    FROM {RESULTS} AS r LEFT JOIN {RULES} AS rc ON r.rule_config_id = rc.rule_config_id
    WHERE r.dataset_id = 5 AND r.dataset_run_id = """
_LATEST = f"(SELECT max(dataset_run_id) FROM {RESULTS} AS x WHERE dataset_id = 5)"
add("latest_run_results", _run_results, _RESULTS_SQL + _LATEST)


def _all_results(spark, d):
    results, rules = _frames(spark, d, "rule_results_q", "rule_config_q")
    return results.join(rules.select("rule_config_id", "dimension", "severity"), "rule_config_id", "left")


_ALL = f"(SELECT r.*, rc.dimension, rc.severity FROM {RESULTS} AS r LEFT JOIN {RULES} AS rc ON r.rule_config_id = rc.rule_config_id)"
add(
    "pass_rate",
    lambda spark, d: reports.pass_rate(_all_results(spark, d)),
    f"""
    SELECT count(*) AS total, count(*) FILTER (WHERE is_success) AS passed, count(*) FILTER (WHERE NOT is_success) AS failed,
           CAST(round(CAST(100.0 AS DOUBLE) * count(*) FILTER (WHERE is_success) / count(*), 0) AS BIGINT) AS pass_percent
    FROM {_ALL} AS a""",
)
for _column in ("dimension", "severity"):
    add(
        f"pass_fail_by_{_column}",
        lambda spark, d, c=_column: reports.pass_fail_by(_all_results(spark, d), c),
        f"""
        SELECT {_column}, count(*) FILTER (WHERE is_success) AS passed, count(is_success) AS total,
               count(is_success) - count(*) FILTER (WHERE is_success) AS failed FROM {_ALL} AS a GROUP BY {_column}""",
    )
add(
    "run_history",
    lambda spark, d: reports.run_history(load(spark, d, "run_log_q"), 7).drop("created_timestamp"),
    f"""
    SELECT dataset_run_id, run_status, evaluated_expectations, successfull_expectations, unsuccessfull_expectations,
           success_percent, run_time FROM {RUNS} AS l WHERE dataset_id = 7
    ORDER BY created_timestamp DESC, dataset_run_id DESC LIMIT 30""",
)
add(
    "recon_detail",
    lambda spark, d: reports.recon_detail(load(spark, d, "recon_results_q"), 8).drop("audit_timestamp"),
    f"""
    SELECT dataset_run_id, dataset_id, rule_config_id, result, validation_on, core_value FROM {RECON} AS r WHERE dataset_id = 8
    AND dataset_run_id = (SELECT max(dataset_run_id) FROM {RECON} AS x WHERE dataset_id = 8)""",
)
add(
    "recon_runs",
    lambda spark, d: reports.recon_runs(load(spark, d, "recon_results_q"), 8).select(
        "dataset_run_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")
    ),
    f"""
    SELECT dataset_run_id, strftime(max(audit_timestamp), '%Y-%m-%d %H:%M:%S') AS ts FROM {RECON} AS r WHERE dataset_id = 8
    GROUP BY dataset_run_id ORDER BY max(audit_timestamp) DESC, dataset_run_id DESC LIMIT 20""",
)
add(
    "rule_counts",
    lambda spark, d: reports.rule_counts(load(spark, d, "rule_config_q"), 12),
    f"""
    SELECT severity, count(*) AS total, count(*) FILTER (WHERE is_active) AS active FROM {RULES} AS r
    WHERE dataset_id = 12 GROUP BY severity""",
)
add(
    "datasets_with_runs",
    lambda spark, d: reports.datasets_with_runs(*_frames(spark, d, "dataset_q", "run_log_q")),
    f"""
    SELECT DISTINCT d.dataset_id, d.dataset_name FROM {SETS} AS d JOIN {RUNS} AS l ON d.dataset_id = l.dataset_id""",
)
add(
    "rules_shown_in_pivot",
    lambda spark, d: shown_rules(
        *_frames(spark, d, "rule_results_q", "supplier_runs_q", "rule_config_q"), 5, 3
    ).select("rule_config_id", "expectation_id", "column_name"),
    f"""
    SELECT rule_config_id, expectation_id, column_name FROM {RULES} AS rc WHERE rule_config_id IN (
        SELECT rule_config_id FROM {RESULTS} AS r WHERE dataset_id = 5 AND dataset_run_id IN (
            SELECT dataset_run_id FROM (SELECT dataset_run_id FROM {source('supplier_runs_q')} AS l WHERE dataset_id = 5
                AND coalesce(run_scope, 'FULL') = 'FULL' ORDER BY dataset_run_id DESC LIMIT 10) AS t
            UNION SELECT 3))""",
)


def _validation(spark, d):
    """What is wrong with each of the rules that the test tables configure."""
    columns = schema_frame(spark, {1: load(spark, d, "lineitem")})
    return rule_problems(load(spark, d, "rules_q"), columns)


add(
    "rule_validation",
    _validation,
    f"""
    WITH r AS (SELECT rule_config_id, lower(expectation_name) AS e, nullif(kwargs ->> '$.column', '') AS c, kwargs
               FROM {source('rules_q')} AS q),
         needed AS (SELECT * FROM (VALUES
            ('expect_column_values_to_be_between', 'column'), ('expect_column_values_to_be_between', 'min_value'),
            ('expect_column_values_to_be_between', 'max_value'), ('column_values_to_match_regex', 'column'),
            ('column_values_to_match_regex', 'regex'), ('expect_column_values_to_be_unique', 'column'),
            ('expect_column_to_exist', 'column')) AS v(e, a)),
         cols AS (SELECT lower(column_name) AS name, column_type AS kind FROM (DESCRIBE SELECT * FROM lineitem)),
         asked AS (SELECT * FROM r LEFT JOIN cols ON lower(c) = name
                   WHERE c IS NOT NULL AND e NOT IN ('no_such_check', 'expect_column_to_exist'))
    SELECT rule_config_id, 'unknown expectation' AS problem, e AS detail FROM r WHERE e = 'no_such_check'
    UNION ALL SELECT rule_config_id, 'missing argument', a FROM r JOIN needed USING (e)
        WHERE coalesce(kwargs ->> concat('$.', a), '') = ''
    UNION ALL SELECT rule_config_id, 'unknown column', c FROM asked WHERE name IS NULL
    UNION ALL SELECT rule_config_id, 'column type', c FROM asked
        WHERE (e LIKE '%between' AND (kind = 'VARCHAR' OR kind LIKE '%TIME%' OR kind = 'DATE'))
           OR (e LIKE '%regex' AND kind <> 'VARCHAR')""",
)
