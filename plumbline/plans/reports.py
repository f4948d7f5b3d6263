"""Queries over the framework's tables.  All take and return DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def active_rules_by_severity(rule_config: DataFrame) -> DataFrame:
    return (
        rule_config.where("is_active")
        .groupBy("severity")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("cnt"))
    )


def rules_by_dimension(rule_config: DataFrame) -> DataFrame:
    return rule_config.groupBy("dimension").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"))


def recent_runs(run_log: DataFrame, dataset: DataFrame, limit: int = 8) -> DataFrame:
    """The latest runs of all datasets.  Limited before the join."""
    latest = run_log.orderBy(F.desc("created_timestamp"), F.desc("dataset_run_id")).limit(limit)
    return latest.join(dataset.select("dataset_id", "dataset_name"), "dataset_id", "left").select(
        "dataset_name",
        "dataset_run_id",
        "run_status",
        "successfull_expectations",
        "unsuccessfull_expectations",
        "success_percent",
        "created_timestamp",
    )


def recon_health(recon_results: DataFrame, dataset: DataFrame) -> DataFrame:
    """Passing comparisons in the latest reconciliation run of each dataset."""
    latest = recon_results.groupBy("dataset_id").agg(F.max("dataset_run_id").alias("dataset_run_id"))
    rows = recon_results.join(latest, ["dataset_id", "dataset_run_id"], "left_semi")
    counts = rows.groupBy("dataset_id").agg(
        F.count_if(F.col("result") == "PASS").alias("passed"),
        F.count(F.lit(1)).alias("total"),
        F.max("audit_timestamp").alias("last_run"),
    )
    return (
        counts.join(dataset.select("dataset_id", "dataset_name"), "dataset_id", "left")
        .groupBy("dataset_name")
        .agg(
            F.sum("passed").alias("passed"),
            F.sum("total").alias("total"),
            F.max("last_run").alias("last_run"),
        )
    )


def activity_feed(
    projects: DataFrame, dataset: DataFrame, rule_config: DataFrame, limit: int = 20
) -> DataFrame:
    """The latest things created."""

    def entries(frame, action, detail):
        return frame.select(
            F.col("created_by").alias("user"),
            F.col("created_timestamp").alias("timestamp"),
            F.lit(action).alias("action"),
            F.col(detail).alias("detail"),
        )

    feed = (
        entries(projects, "Project Created", "project_name")
        .unionByName(entries(dataset, "Dataset Created", "dataset_name"))
        .unionByName(entries(rule_config, "Rule Created", "expectation_name"))
    )
    return feed.orderBy(F.desc("timestamp"), "action", "detail").limit(limit)


def run_results(
    rule_results: DataFrame, rule_config: DataFrame, dataset_id: int, run_id: int | None = None
) -> DataFrame:
    """Results of a run, the latest one unless given, with the rules' settings."""
    mine = rule_results.where(F.col("dataset_id") == dataset_id)
    run = F.lit(run_id) if run_id is not None else mine.agg(F.max("dataset_run_id").alias("r")).scalar()
    rules = rule_config.select("rule_config_id", "column_name", "severity", "dimension")
    return (
        mine.where(F.col("dataset_run_id") == run)
        .select(
            "rule_config_id",
            "dataset_run_id",
            "expectation_name",
            "is_success",
            "element_count",
            "unexpected_count",
            "unexpected_percent",
            "run_timestamp",
        )
        .join(rules, "rule_config_id", "left")
        .orderBy("is_success", "rule_config_id")
    )


def datasets_with_runs(dataset: DataFrame, run_log: DataFrame) -> DataFrame:
    return (
        dataset.join(run_log, "dataset_id", "left_semi")
        .select("dataset_id", "dataset_name")
        .distinct()
        .orderBy("dataset_name")
    )


def pass_rate(results: DataFrame) -> DataFrame:
    """Totals and the rounded pass rate of a set of results."""
    passed = F.count_if(F.col("is_success"))
    total = F.count(F.lit(1))
    rate = F.when(total == 0, F.lit(0.0)).otherwise(F.round(100.0 * passed / F.when(total != 0, total), 0))
    return results.agg(
        total.alias("total"),
        passed.alias("passed"),
        (total - passed).alias("failed"),
        rate.cast("bigint").alias("pass_percent"),
    )


def pass_fail_by(results: DataFrame, column: str) -> DataFrame:
    """Passed and failed results by ``dimension`` or ``severity``."""
    return results.groupBy(column).agg(
        F.count_if(F.col("is_success")).alias("passed"),
        F.count("is_success").alias("total"),
        (F.count("is_success") - F.count_if(F.col("is_success"))).alias("failed"),
    )


def run_history(run_log: DataFrame, dataset_id: int, limit: int = 30) -> DataFrame:
    return (
        run_log.where(F.col("dataset_id") == dataset_id)
        .orderBy(F.desc("created_timestamp"), F.desc("dataset_run_id"))
        .limit(limit)
        .select(
            "dataset_run_id",
            "run_status",
            "evaluated_expectations",
            "successfull_expectations",
            "unsuccessfull_expectations",
            "success_percent",
            "run_time",
            "created_timestamp",
        )
    )


def recon_detail(recon_results: DataFrame, dataset_id: int, run_id: int | None = None) -> DataFrame:
    mine = recon_results.where(F.col("dataset_id") == dataset_id)
    run = F.lit(run_id) if run_id is not None else mine.agg(F.max("dataset_run_id").alias("r")).scalar()
    return mine.where(F.col("dataset_run_id") == run).orderBy(F.desc("result"), F.desc("audit_timestamp"))


def recon_runs(recon_results: DataFrame, dataset_id: int, limit: int = 20) -> DataFrame:
    return (
        recon_results.where(F.col("dataset_id") == dataset_id)
        .groupBy("dataset_run_id")
        .agg(F.max("audit_timestamp").alias("ts"))
        .orderBy(F.desc("ts"), F.desc("dataset_run_id"))
        .limit(limit)
    )


def rule_counts(rule_config: DataFrame, dataset_id: int) -> DataFrame:
    """Rules of a dataset by severity, with how many are active."""
    return (
        rule_config.where(F.col("dataset_id") == dataset_id)
        .groupBy("severity")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_active")).alias("active"))
    )
