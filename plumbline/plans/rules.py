"""Configured rules: registering, fetching, selecting."""

from __future__ import annotations

import datetime
import json
from typing import Any, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import catalog
from plumbline.rule import Rule
from plumbline.sources.datasets import Dataset
from plumbline.sources.store import Store


def register_dataset(store: Store, dataset: Dataset, created_by: str | None = None, now=None) -> None:
    row = dict(vars(dataset))
    row.update(created_by=created_by, created_timestamp=now or datetime.datetime.now())
    store.append_rows("dataset", [row])


def register_rules(store: Store, rules: Iterable[Rule], created_by: str | None = None, now=None) -> None:
    """Store rule configurations; the expectation id follows from the name."""
    rows = []
    for rule in rules:
        known = catalog.expectation(rule.expectation)
        rows.append(
            {
                "rule_config_id": rule.rule_config_id,
                "expectation_id": known.expectation_id,
                "dataset_id": rule.dataset_id,
                "expectation_name": known.name.upper(),
                "expectation_type": known.check_type,
                "kwargs": json.dumps(rule.kwargs),
                "dimension": rule.dimension or known.dimension,
                "column_name": rule.column_name or column_label(rule.kwargs),
                "check_type": known.check_type,
                "severity": rule.severity,
                "is_active": rule.is_active,
                "error_flag": rule.error_flag,
                "created_by": created_by,
                "created_timestamp": now or datetime.datetime.now(),
            }
        )
    store.append_rows("rule_config", rows)


def column_label(kwargs: dict[str, Any]) -> str | None:
    """The column a rule is listed under: its column, else its pair of columns."""
    if kwargs.get("column"):
        return str(kwargs["column"])
    pair = [str(kwargs[k]) for k in ("column_A", "column_B") if kwargs.get(k)]
    return ",".join(pair) or None


def runnable_rules(
    rule_config: DataFrame, master: DataFrame, mapping: DataFrame, dataset_id: int | None = None
) -> DataFrame:
    """Active rules joined with the catalogue and an active handler."""
    cc = rule_config.alias("cc")
    em = master.alias("em")
    ehm = mapping.where(F.col("is_active")).alias("ehm")
    engine = F.col("cc.dq_engine")
    chosen = F.col("cc.is_active") & (engine.isNull() | (F.upper(engine) == "SQL"))
    if dataset_id is not None:
        chosen = chosen & (F.col("cc.dataset_id") == dataset_id)
    return (
        cc.where(chosen)
        .join(em, F.col("cc.expectation_id") == F.col("em.expectation_id"), "left")
        .join(
            ehm,
            F.upper(F.col("em.validation_name")) == F.upper(F.col("ehm.expectation_type")),
            "left",
        )
        .where(F.col("ehm.handler").isNotNull())
        .select(
            "cc.rule_config_id",
            "cc.dataset_id",
            "cc.expectation_id",
            F.col("em.validation_name").alias("expectation_name"),
            "em.check_level",
            F.coalesce(F.col("cc.check_type"), F.col("em.check_type")).alias("check_type"),
            F.coalesce(F.col("cc.dimension"), F.col("em.dimension")).alias("dimension"),
            "cc.column_name",
            "cc.kwargs",
            "cc.severity",
            F.coalesce(F.col("cc.error_flag"), F.lit(True)).alias("error_flag"),
            "ehm.handler",
        )
    )


def fetch_rules(store: Store, dataset_id: int, rule_ids: list[int] | None = None) -> list:
    """The runnable rules of a dataset: one row per rule, in id order."""
    rules = runnable_rules(
        store.read("rule_config"),
        catalog.master_frame(store.spark),
        catalog.mapping_frame(store.spark),
        dataset_id,
    )
    if rule_ids:
        rules = rules.where(F.col("rule_config_id").isin(rule_ids))
    return rules.orderBy("rule_config_id").collect()


def parse_rule_ids(text: str | None) -> list[int]:
    """Rule ids from comma-separated text; anything unreadable means all rules."""
    try:
        return [int(part) for part in str(text or "").split(",") if part.strip()]
    except ValueError:
        return []


def failed_in_latest_run(rule_results: DataFrame, dataset_id: int) -> DataFrame:
    """Ids of the rules that failed in the dataset's latest run."""
    mine = rule_results.where(F.col("dataset_id") == dataset_id)
    latest = mine.agg(F.max("dataset_run_id").alias("run")).scalar()
    return (
        mine.where((F.col("dataset_run_id") == latest) & ~F.col("is_success"))
        .select("rule_config_id")
        .distinct()
    )
