"""Failing rows against rules: one column per rule with PASS or FAIL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import catalog
from plumbline.functions.arithmetic import literal
from plumbline.functions.columns import quoted
from plumbline.plans.evaluate import QUERY_COLUMNS
from plumbline.sources.datasets import Dataset
from plumbline.sources.store import DAY, FAILED_RULES, Store, failure_table_name, stored_table_name

# Full runs whose rules get a column, besides the current run.
RUNS_SHOWN = 10

AUDIT_COLUMNS = (
    "dataset_run_id", "dataset_id", "rule_config_id", "dq_load_timestamp", QUERY_COLUMNS, FAILED_RULES, DAY,
)


def rule_header(rule: dict) -> str:
    """``COLUMN_DIMENSION_CATEGORY_ID`` (a fixed format); some expectations show arguments in the category."""
    known = catalog.BY_ID.get(rule["expectation_id"])
    category, dimension = (known.check_type, known.dimension) if known else ("UNCATEGORIZED", "UNCATEGORIZED")
    try:
        kwargs = json.loads(rule.get("kwargs") or "{}")
        if kwargs and known and known.header:
            category = known.header.text(kwargs)
    except json.JSONDecodeError:
        category = f"{category}_PARSE_ERROR"
    column = (rule.get("column_name") or "TABLE").upper().replace(" ", "_")
    return f"{column}_{dimension}_{category}_{rule['rule_config_id']}"


def _name(column: str) -> str:
    return quoted(column)


def pivot_sql(
    failures: str, results: str, rules: list[dict], source: list[str], runs: list[int] | None = None
) -> str:
    """The pivot as a query over a failure table and a result table.

    Both sides are aggregated before they meet: failing rows to one row per
    source row, results to one row per run, so the join's right side has a row
    per run and adaptive execution broadcasts it by its measured size.  With
    ``runs`` both sides read those runs alone.
    """
    only = "" if runs is None else f"WHERE dataset_run_id IN ({', '.join(map(str, runs or [-1]))})"
    keys = ["dataset_run_id", *map(_name, source)]
    ids = [r["rule_config_id"] for r in rules]
    flags = [f"max(CASE WHEN rule_config_id = {i} THEN 1 END) AS __f{n}" for n, i in enumerate(ids)]
    verdicts = [f"max(CASE WHEN rule_config_id = {i} THEN is_success END) AS __r{n}" for n, i in enumerate(ids)]
    cells = [f"{_cell(n, r)} AS {_name(rule_header(r))}" for n, r in enumerate(rules)]
    shown = ["f.dataset_run_id", *cells, *[f"f.{_name(c)}" for c in source]]
    return (
        f"SELECT {', '.join(shown)} FROM "
        f"(SELECT {', '.join([*keys, *flags])} FROM {failures} {only} GROUP BY {', '.join(keys)}) AS f LEFT JOIN "
        f"(SELECT {', '.join(['dataset_run_id', *verdicts])} FROM {results} {only} GROUP BY dataset_run_id) AS r "
        "ON f.dataset_run_id = r.dataset_run_id"
    )


def _source_columns(failures: DataFrame) -> list[str]:
    return [c for c in failures.columns if c not in AUDIT_COLUMNS]


def pivot_failures(failures: DataFrame, rule_results: DataFrame, rules: list[dict]) -> DataFrame:
    """One row per run and distinct failing row, one column per rule."""
    text = pivot_sql("__failures", "__results", rules, _source_columns(failures))
    text = text.replace("{", "{{").replace("}", "}}")
    text = text.replace("FROM __failures ", "FROM {failures} ").replace("FROM __results ", "FROM {results} ")
    return failures.sparkSession.sql(text, failures=failures, results=rule_results)


def _cell(n: int, rule: dict) -> str:
    known = catalog.BY_ID.get(rule["expectation_id"])
    level = known.check_level if known else "ROW"
    if level == "ROW":
        return f"CASE WHEN f.__f{n} = 1 THEN 'FAIL' WHEN r.__r{n} IS NULL THEN 'NOT CONFIGURED' ELSE 'PASS' END"
    return (
        f"CASE WHEN r.__r{n} IS NULL THEN 'NOT CONFIGURED' WHEN NOT r.__r{n} THEN 'FAIL - {level} CHECK' "
        "ELSE 'PASS' END"
    )


def shown_runs(run_log: DataFrame, dataset_id: int, run_id: int) -> DataFrame:
    """The last full runs of the dataset and this run."""
    recent = (
        run_log.where(
            (F.col("dataset_id") == dataset_id) & (F.coalesce(F.col("run_scope"), F.lit("FULL")) == "FULL")
        )
        .select("dataset_run_id")
        .orderBy(F.desc("dataset_run_id"))
        .limit(RUNS_SHOWN)
    )
    current = run_log.sparkSession.range(run_id, run_id + 1).select(F.col("id").alias("dataset_run_id"))
    return recent.union(current).distinct()


def history_verdicts(rule_results: DataFrame, run_log: DataFrame, rule_config: DataFrame, dataset_id: int, run_id: int) -> DataFrame:
    """The shown runs, each with the verdicts of its rules; a run without results has one row."""
    told = rule_results.where(F.col("dataset_id") == dataset_id).select("dataset_run_id", "rule_config_id", "is_success")
    rules = rule_config.select("rule_config_id", "expectation_id", "kwargs", "column_name")
    return (
        shown_runs(run_log, dataset_id, run_id)
        .join(told, "dataset_run_id", "left")
        .join(rules.withColumn("known", F.lit(True)), "rule_config_id", "left")
    )


def shown_rules(
    rule_results: DataFrame, run_log: DataFrame, rule_config: DataFrame, dataset_id: int, run_id: int
) -> DataFrame:
    """Rules with results in the last full runs of the dataset or in this run."""
    runs = shown_runs(run_log, dataset_id, run_id)
    used = (
        rule_results.where(F.col("dataset_id") == dataset_id)
        .join(runs, "dataset_run_id", "left_semi")
        .select("rule_config_id")
        .distinct()
    )
    return (
        rule_config.join(used, "rule_config_id", "left_semi")
        .select("rule_config_id", "expectation_id", "kwargs", "column_name")
        .orderBy("rule_config_id")
    )


def known_verdicts(store: Store, verdicts: list[dict]) -> list[dict]:
    """Verdicts beside the configuration of their rules."""
    ids = sorted({v["rule_config_id"] for v in verdicts})
    config = store.read("rule_config").where(F.col("rule_config_id").isin(ids))
    rules = {
        r["rule_config_id"]: r.asDict() | {"known": True}
        for r in config.select("rule_config_id", "expectation_id", "kwargs", "column_name").collect()
    }
    return [{"known": None} | rules.get(v["rule_config_id"], {}) | v for v in verdicts]


def failure_pivot_sql(store: Store, dataset: Dataset, run_id: int, verdicts: list[dict] | None = None) -> str | None:
    """The pivot of a dataset's failing rows; None when it has none yet.

    Stored rows hold each distinct failing row once, so the pivot is a
    projection of them; the verdicts of the shown runs are part of its text.
    Rows of custom queries may differ in columns that the pivot doesn't show:
    with such rules it is grouped.  ``verdicts`` spares a reading of the history.
    """
    table = failure_table_name(dataset.dataset_name)
    if not store.exists(table):
        return None
    if verdicts is None:
        results, log, config = (store.read(t) for t in ("rule_results", "dataset_run_log", "rule_config"))
        rows = history_verdicts(results, log, config, dataset.dataset_id, run_id).collect()
        told = [r.asDict() for r in rows]
    else:
        told = known_verdicts(store, verdicts)
    runs = sorted({r["dataset_run_id"] for r in told})
    rules = {r["rule_config_id"]: r for r in told if r["known"]}
    rules = [rules[i] for i in sorted(rules)]
    source = _source_columns(store.spark.table(store.name(stored_table_name(table))))
    if any(_custom(r) for r in rules):
        pivot = pivot_sql(store.name(table), store.name("rule_results"), rules, source, runs)
    else:
        pivot = projection_sql(store.name(stored_table_name(table)), told, rules, source, runs)
    columns = [*[_name(rule_header(r)) for r in rules], *map(_name, source)]
    return (
        f"SELECT dataset_run_id, {dataset.dataset_id} AS dataset_id, "
        f"{literal(dataset.dataset_name)} AS dataset_name, {', '.join(columns)} FROM ({pivot}) AS p"
    )


def _custom(rule: dict) -> bool:
    known = catalog.BY_ID.get(rule["expectation_id"])
    return known is None or known.name == "unexpected_rows_expectation"


def projection_sql(stored: str, told: list, rules: list[dict], source: list[str], runs: list[int]) -> str:
    """The pivot over stored rows: no grouping, no join."""

    def among(rule_id: int, *verdicts: bool) -> str:
        found = [r["dataset_run_id"] for r in told if r["rule_config_id"] == rule_id and r["is_success"] in verdicts]
        return f"dataset_run_id IN ({', '.join(map(str, sorted(found) or [-1]))})"

    def cell(rule: dict) -> str:
        known, i = catalog.BY_ID.get(rule["expectation_id"]), rule["rule_config_id"]
        level = known.check_level if known else "ROW"
        if level == "ROW":
            fails, configured = f"map_contains_key({FAILED_RULES}, CAST({i} AS BIGINT))", among(i, True, False)
            return f"CASE WHEN {fails} THEN 'FAIL' WHEN {configured} THEN 'PASS' ELSE 'NOT CONFIGURED' END"
        return (
            f"CASE WHEN {among(i, False)} THEN 'FAIL - {level} CHECK' WHEN {among(i, True)} THEN 'PASS' "
            "ELSE 'NOT CONFIGURED' END"
        )

    shown = ["dataset_run_id", *[f"{cell(r)} AS {_name(rule_header(r))}" for r in rules], *map(_name, source)]
    return f"SELECT {', '.join(shown)} FROM {stored} WHERE dataset_run_id IN ({', '.join(map(str, runs or [-1]))})"


def failure_pivot(store: Store, dataset: Dataset, run_id: int) -> DataFrame | None:
    text = failure_pivot_sql(store, dataset, run_id)
    return None if text is None else store.spark.sql(text)


def failure_view(store: Store, dataset: Dataset, run_id: int, verdicts: list[dict] | None = None) -> str | None:
    """The pivot as the catalogue view ``vw_<dataset>_dq_failure`` of the store's database."""
    text = failure_pivot_sql(store, dataset, run_id, verdicts)
    if text is None:
        return None
    name = store.name("vw_" + failure_table_name(dataset.dataset_name))
    store.spark.sql(f"CREATE OR REPLACE VIEW {name} AS {text}")
    return name
