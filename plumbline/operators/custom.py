"""A query whose every row is a failure."""

from __future__ import annotations

import re
import threading
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import find_column, quoted
from plumbline.operators.spec import FrameSpec, all_rows, combine_single_rows, counted
from plumbline.rule import Rule, RuleError, name_list, require
from plumbline.sources.datasets import Scope


_VIEWS = threading.Lock()


@contextmanager
def _views(spark: SparkSession, frames: dict[str, DataFrame]):
    """Temp views for as long as a query is analysed; views of the same names come back after it."""
    with _VIEWS:
        temporary = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
        before = {name: spark.table(f"`{name}`") for name in frames if name.lower() in temporary}
        try:
            for name, frame in frames.items():
                frame.createOrReplaceTempView(name)
            yield
        finally:
            for name in frames:
                if name in before:
                    before[name].createOrReplaceTempView(name)
                else:
                    spark.catalog.dropTempView(name)


def query_frame(scope: Scope, rule: Rule) -> DataFrame:
    """The rule's query, over the datasets that it names."""
    (text,) = require(rule.kwargs, "unexpected_rows_query")
    read = relations(scope.spark, text)
    names = [n for n in scope.others if n.lower() in read]
    frames = {**{n: scope.others[n] for n in names}, scope.name: scope.whole}
    with _views(scope.spark, frames):
        return scope.spark.sql(text)


def relations(spark: SparkSession, text: str) -> set[str]:
    """Names of the tables a query reads, in lower case: of its parsed plan, so aliases and columns don't count."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    found = re.findall(r"'?UnresolvedRelation \[([^\]]*)\]", plan.toString())
    return {name.lower() for name in found}


def _counted_source(scope: Scope, text: str) -> DataFrame:
    """The first dataset after a FROM, whose rows are the total; else the rule's own.

    A word after FROM that is no dataset, as in ``extract(year FROM day)``, is passed over.
    """
    read = relations(scope.spark, text)
    for found in re.finditer(r"\bfrom\s+([\w.`]+)", text, re.IGNORECASE):
        name = found.group(1).replace("`", "")
        if "." not in name and name.lower() not in read:
            continue
        try:
            return scope.lookup(name)
        except RuleError:
            continue
    return scope.whole


def unexpected_rows(scope: Scope, rule: Rule) -> FrameSpec:
    """Any row fails the rule, whatever ``mostly`` says."""
    query = query_frame(scope, rule)
    source = _counted_source(scope, rule.kwargs["unexpected_rows_query"])

    def frame():
        return combine_single_rows(
            [source.agg(all_rows().alias("total")), query.agg(all_rows().alias("bad"))]
        )

    def verdict(m):
        return counted(m("total"), m("bad"), f"({m('bad')} = 0)")

    return FrameSpec(frame, verdict, failing=lambda: query)


def query_profile_columns(query: DataFrame, rule: Rule) -> list[str]:
    """Columns to profile: those given, else output columns named after WHERE."""
    given = name_list(rule.kwargs, "profile_columns")
    if given:
        return [find_column(query, n) for n in given]
    parts = re.split(r"\bwhere\b", rule.kwargs["unexpected_rows_query"], maxsplit=1, flags=re.IGNORECASE)
    if len(parts) < 2:
        return []
    words = {w.lower() for w in re.findall(r"[A-Za-z_]\w*", re.sub(r"'[^']*'", "", parts[1]))}
    return sorted(n for n in query.columns if n.lower() in words)


def combination_counts(query: DataFrame, columns: list[str]) -> DataFrame:
    """Each combination of the columns as text with its number of rows."""
    text = [F.coalesce(F.col(quoted(c)).cast("string"), F.lit("NULL")) for c in columns]
    return query.groupBy(F.concat_ws(",", *text).alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def combination_profile(query: DataFrame, columns: list[str], limit: int = 1000) -> DataFrame:
    """The most frequent combinations, with the number of combinations overall."""
    counts = combination_counts(query, columns)
    summary = counts.agg(
        F.struct(F.count(F.lit(1)).alias("combinations"), F.sum("rows").alias("rows")).alias("s")
    ).scalar()
    return (
        counts.orderBy(F.desc("rows"), F.asc("value"))
        .limit(limit)
        .withColumn("error_unique_count", summary["combinations"])
        .withColumn("error_total_count", summary["rows"])
    )
