"""Building blocks of the named queries and of their oracle SQL."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import check, failing
from plumbline.suite.tables import load, source

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Query, oracle: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


def summary_columns(rows: DataFrame, digits: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """Result columns compared with the oracle; absent counts show as 0."""
    return rows.select(
        *keep,
        F.col("expectation_name" if "expectation_name" in rows.columns else "check").alias("expectation"),
        "element_count",
        F.coalesce("missing_count", F.lit(0)).alias("missing_count"),
        F.coalesce("unexpected_count", F.lit(0)).alias("unexpected_count"),
        F.round(F.coalesce("unexpected_percent", F.lit(0.0)), 8).alias("unexpected_percent"),
        F.round(F.coalesce("observed_value", F.lit(0.0)), digits).alias("observed_value"),
        "is_success",
    )


def summary(table: str, expectation: str, kwargs: dict, digits: int = 4, others=(), **scope) -> Query:
    def query(spark, sf_dir):
        df = load(spark, sf_dir, table)
        frames = {name: load(spark, sf_dir, name) for name in others}
        rows = check(df, expectation, kwargs, name=table, others=frames, **scope)
        return summary_columns(rows, digits)

    return query


def failures(table: str, expectation: str, kwargs: dict, columns: str | None = None, **scope) -> Query:
    def query(spark, sf_dir):
        df = load(spark, sf_dir, table)
        rows = failing(df, expectation, kwargs, name=table, **scope)
        return rows.select(*columns.split(", ")) if columns else rows

    return query


def share(bad: str = "bad", total: str = "total") -> str:
    return f"CASE WHEN {total} = 0 THEN 0.0 ELSE CAST({bad} AS DOUBLE) / {total} END"


def at_most(mostly: float, bad: str = "bad", total: str = "total") -> str:
    return f"({share(bad, total)}) <= (CAST(1.0 AS DOUBLE) - CAST({mostly} AS DOUBLE))"


def at_least(mostly: float, bad: str = "bad", total: str = "total") -> str:
    return f"(CAST(1.0 AS DOUBLE) - ({share(bad, total)})) >= CAST({mostly} AS DOUBLE)"


def counts_sql(
    expectation: str,
    measures: str,
    table: str,
    success: str,
    missing: str = "0",
    bad: str = "bad",
    total: str = "total",
    percent: str | None = None,
    observed: str = "0.0",
    digits: int = 4,
) -> str:
    """Oracle of a summary: measures over the table, then the verdict."""
    percent = percent or f"({share(bad, total)}) * 100"
    return f"""
        WITH m AS (SELECT {measures} FROM {source(table)} AS src)
        SELECT '{expectation}' AS expectation,
               CAST({total} AS BIGINT) AS element_count,
               CAST({missing} AS BIGINT) AS missing_count,
               CAST({bad} AS BIGINT) AS unexpected_count,
               round(CAST({percent} AS DOUBLE), 8) AS unexpected_percent,
               round(CAST({observed} AS DOUBLE), {digits}) AS observed_value,
               {success} AS is_success
        FROM m"""


def row_check(
    name: str,
    table: str,
    expectation: str,
    kwargs: dict,
    bad: str,
    missing: str | None = None,
    total: str | None = None,
    gate: Callable[..., str] = at_most,
    percent: str | None = None,
    success: str | None = None,
    observed: str = "0.0",
    keys: str | None = None,
    extra: str = "",
    with_rows: bool = True,
    **scope,
) -> None:
    """Register a row check: its verdict and its failing rows."""
    mostly = float(kwargs.get("mostly", 1.0))
    count = f"count(*) FILTER (WHERE {total})" if total else "count(*)"
    measures = f"{count} AS total, count(*) FILTER (WHERE {bad}) AS bad"
    measures += f", count(*) FILTER (WHERE {missing or 'FALSE'}) AS missing" + extra
    oracle = counts_sql(
        expectation,
        measures,
        table,
        success or gate(mostly),
        missing="missing",
        percent=percent,
        observed=observed,
    )
    add(name, summary(table, expectation, kwargs, **scope), oracle)
    if with_rows:
        rows = f"SELECT {keys or '*'} FROM {source(table)} AS src WHERE {bad}"
        add(f"{name}_failing", failures(table, expectation, kwargs, keys, **scope), rows)


def blank(column: str) -> str:
    return f"({column} IS NULL OR trim(CAST({column} AS VARCHAR)) = '')"


def quoted_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values)
