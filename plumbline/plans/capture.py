"""Failing rows: found by the pass that decides the verdicts, stored once each.

The aggregates of all scan rules are observed while the rows that fail any of
them are written to a staging table, so verdicts and failing rows come from one
reading of the dataset.  The staging job has no shuffle: its tasks are counted
once however often they are tried, and so are the observed aggregates.

Staged rows and the failing rows of other rules (groups, queries, limited ones)
are then brought together by all columns: a stored row holds each distinct
failing row once, with the rules it fails and how many rows of the dataset it
stands for under each (``failed_rules``).  Copies collapse before the shuffle.
A view has one row for each failing row and rule, as readers expect them; keys,
frequent values and the pivot read the stored rows, not the dataset.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import quoted
from plumbline.operators.spec import ScanSpec
from plumbline.plans.evaluate import QUERY_COLUMNS, Compiled, failing_frames, measures, prepared, row_limit, verdicts_of
from plumbline.sources.datasets import Scope
from plumbline.sources.store import FAILED_RULES, Store

RULES = "__rules"


def stageable(c: Compiled) -> bool:
    """Whether the rule's failing rows can be told row by row and are all to be kept."""
    return (
        isinstance(c.spec, ScanSpec) and c.spec.failing is not None and c.rule.error_flag and row_limit(c) is None
    )


def tagged(rows: DataFrame, rules: list[Compiled], names: list[str]) -> DataFrame:
    """The rows that fail any of the rules, with the ids of those."""
    tags = [F.when(c.spec.failing, F.lit(c.rule.rule_config_id).cast("bigint")) for c in rules]
    failing = reduce(or_, [c.spec.failing for c in rules])
    source = [F.col(quoted(n)) for n in names]
    return rows.where(failing).select(*source, F.array_compact(F.array(*tags)).alias(RULES))


def observed(store: Store, scope: Scope, scans: list[Compiled], run_id: int) -> dict[int, dict]:
    """Results of the scan rules, from the pass that stages the failing rows of those to be captured."""
    seen = Observation(f"verdicts_{run_id}")
    columns = measures(scans)
    kinds = prepared(scope.df, scans).agg(*columns).schema
    rows = prepared(scope.df, scans).observe(seen, *columns)
    store.stage(run_id, tagged(rows, [c for c in scans if stageable(c)], scope.df.columns))
    found = seen.get
    return {r["rule_config_id"]: r.asDict() for r in verdicts_of(scope.spark, scans, found, kinds).collect()}


def stored_rows(scope: Scope, kept: list[Compiled], staged: DataFrame | None) -> DataFrame:
    """Each distinct failing row of the rules with ``failed_rules``: rule id -> rows of the dataset."""
    ids = sorted(c.rule.rule_config_id for c in kept)
    names = scope.df.columns
    together = [c for c in kept if stageable(c)]
    frames = []
    if together and staged is not None:
        wanted = F.array(*[F.lit(c.rule.rule_config_id).cast("bigint") for c in together])
        frames.append(staged.withColumn(RULES, F.array_intersect(RULES, wanted)).where(F.size(RULES) > 0))
    elif together:
        frames.append(tagged(prepared(scope.df, together), together, names))
    for rows in failing_frames([c for c in kept if not stageable(c)], scope):
        frames.append(rows.withColumn(RULES, F.array("rule_config_id")).drop("rule_config_id"))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if QUERY_COLUMNS not in rows.columns:
        rows = rows.withColumn(QUERY_COLUMNS, F.lit(None).cast("string"))
    keys = [*names, QUERY_COLUMNS]
    if not all(_groups(rows.schema[n].dataType) for n in keys):
        once = F.transform(F.array_distinct(RULES), lambda r: F.struct(r.alias("rule"), F.lit(1).cast("bigint").alias("rows")))
        alone = rows.select(*[F.col(quoted(n)) for n in keys], F.map_from_entries(once).alias(FAILED_RULES))
        return alone.hint("rebalance")
    counts = [F.count_if(F.array_contains(RULES, F.lit(i).cast("bigint"))).alias(f"__n{i}") for i in ids]
    grouped = rows.groupBy(*[F.col(quoted(n)) for n in keys]).agg(*counts)
    failed = [F.when(F.col(f"__n{i}") > 0, F.struct(F.lit(i).cast("bigint").alias("rule"), F.col(f"__n{i}").alias("rows"))) for i in ids]
    return grouped.select(
        *[F.col(quoted(n)) for n in keys], F.map_from_entries(F.array_compact(F.array(*failed))).alias(FAILED_RULES)
    )


def _groups(kind: T.DataType) -> bool:
    """Whether rows can be grouped by values of a type."""
    if isinstance(kind, (T.MapType, T.VariantType)):
        return False
    if isinstance(kind, T.ArrayType):
        return _groups(kind.elementType)
    return not isinstance(kind, T.StructType) or all(_groups(f.dataType) for f in kind.fields)


def fails(rule_config_id: int) -> Column:
    return F.map_contains_key(FAILED_RULES, F.lit(rule_config_id).cast("bigint"))


def rows_failing(rule_config_id: int) -> Column:
    """Rows of the dataset that a stored row stands for under a rule."""
    return F.element_at(FAILED_RULES, F.lit(rule_config_id).cast("bigint"))
