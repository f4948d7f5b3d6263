"""The checks.  ``check`` and ``failing`` evaluate a single one."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame


def check(df: DataFrame, expectation: str, kwargs: dict[str, Any], **scope) -> DataFrame:
    """One result row of one check over ``df``."""
    from plumbline.plans.evaluate import evaluate
    from plumbline.rule import Rule
    from plumbline.sources.datasets import Scope

    rows = evaluate(Scope(df, **scope), [Rule(1, expectation, kwargs)])
    return rows.drop("rule_config_id").withColumnRenamed("expectation_name", "check")


def failing(df: DataFrame, expectation: str, kwargs: dict[str, Any], **scope) -> DataFrame:
    """The rows of ``df`` that fail one check."""
    from plumbline.plans.evaluate import failing_rows
    from plumbline.rule import Rule
    from plumbline.sources.datasets import Scope

    return failing_rows(Scope(df, **scope), [Rule(1, expectation, kwargs)]).drop("rule_config_id")
