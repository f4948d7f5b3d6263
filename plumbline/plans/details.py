"""What failing rows look like: profile, frequent values, examples."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import find_column, is_text, missing, quoted, type_of
from plumbline.functions.local import small_frame
from plumbline.functions.matching import to_column_type
from plumbline.operators.membership import member_test
from plumbline.operators.skew import group_counts
from plumbline.operators.spec import ROWS_IN_GROUP, FrameSpec, GroupSpec, ScanSpec
from plumbline.plans.capture import fails, rows_failing
from plumbline.plans.evaluate import Compiled, first_rows, prepared, row_limit
from plumbline.rule import Rule, value_list
from plumbline.sources.datasets import Scope

# Values listed per rule at most; counts stay exact beyond it.
LISTED_VALUES = 1000


def failing_value_counts(compiled: list[Compiled], scope: Scope) -> DataFrame | None:
    """Rows per failing value: ``rule_config_id, value, rows, low, high``.

    The failing rows of a column are counted by value once for all its rules;
    which rules a value fails is then decided on the distinct values.
    """
    by_column: dict[str, list[Compiled]] = {}
    frames = []
    for c in compiled:
        if isinstance(c.spec, ScanSpec) and c.spec.failing is not None and c.spec.profile:
            by_column.setdefault(c.spec.profile, []).append(c)
        elif isinstance(c.spec, (GroupSpec, FrameSpec)) and c.spec.failing_groups is not None:
            if isinstance(c.spec, FrameSpec):
                groups = c.spec.failing_groups()
            else:
                groups = group_counts(scope.df, c.spec.keys).where(c.spec.failing_groups)
            frames.append(groups.select(_entry(c, scope).alias("e"), F.col(ROWS_IN_GROUP).alias("rows")))
    for column, rules in by_column.items():
        failing = reduce(or_, [c.spec.failing for c in rules])
        rows = prepared(scope.df, rules).where(failing)
        values = prepared(group_counts(rows, [column]), rules)
        entries = [F.when(c.spec.failing, _entry(c, scope)) for c in rules]
        frames.append(
            values.select(
                F.explode(F.array_compact(F.array(*entries))).alias("e"),
                F.col(ROWS_IN_GROUP).alias("rows"),
            )
        )
    if not frames:
        return None
    return _by_value(reduce(DataFrame.unionByName, frames))


def has_values(c: Compiled) -> bool:
    """Whether the rule's failing values are listed."""
    if isinstance(c.spec, ScanSpec):
        return c.spec.failing is not None and bool(c.spec.profile)
    return isinstance(c.spec, (GroupSpec, FrameSpec)) and c.spec.failing_groups is not None


def stored_value_counts(compiled: list[Compiled], scope: Scope, stored: DataFrame) -> DataFrame:
    """The same counts from failing rows that are stored with the rules they fail."""
    entries = [
        F.when(fails(i), F.struct(_entry(c, scope).alias("e"), rows_failing(i).alias("rows")))
        for c in compiled
        for i in [c.rule.rule_config_id]
    ]
    return _by_value(stored.select(F.inline(F.array_compact(F.array(*entries)))))


def _by_value(entries: DataFrame) -> DataFrame:
    """Values that differ only in surrounding spaces are one."""
    return entries.groupBy("e.rule_config_id", "e.value").agg(
        F.sum("rows").alias("rows"),
        F.min("e.number").alias("low"),
        F.max("e.number").alias("high"),
    )


def _entry(c: Compiled, scope: Scope):
    column = F.col(quoted(c.spec.profile))
    kind = type_of(scope.df, c.spec.profile)
    number = F.lit(None).cast("double")
    if isinstance(kind, T.NumericType):
        number = column.cast("double")
    elif is_text(kind):
        number = column.try_cast("double")
    return F.struct(
        F.lit(c.rule.rule_config_id).cast("bigint").alias("rule_config_id"),
        F.trim(column.cast("string")).alias("value"),
        number.alias("number"),
    )


def failure_profile(values: DataFrame) -> DataFrame:
    """Per rule: failing rows, distinct values and their share, smallest, largest."""
    return values.groupBy("rule_config_id").agg(
        F.sum("rows").alias("error_total_count"),
        F.count("value").alias("error_unique_count"),
        (F.count("value") * 100.0 / F.sum("rows")).alias("error_unique_percent"),
        F.min("low").alias("error_min_value"),
        F.max("high").alias("error_max_value"),
    )


# Parts a rule's values are ranked in before the parts' best meet.
RANK_PARTS = 64


def top_values(values: DataFrame, limit: int = LISTED_VALUES) -> DataFrame:
    """The most frequent failing values of each rule.

    Ranked in parts of a rule first, so that the last rank of a rule gets
    ``RANK_PARTS * limit`` rows at most, however many tasks there were.
    """
    part = F.pmod(F.xxhash64("value"), F.lit(RANK_PARTS))
    order = [F.desc("rows"), F.asc("value")]
    first = Window.partitionBy("rule_config_id", part).orderBy(*order)
    last = Window.partitionBy("rule_config_id").orderBy(*order)
    return (
        values.where(F.col("value").isNotNull())
        .withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= limit)
        .withColumn("rank", F.row_number().over(last))
        .where(F.col("rank") <= limit)
        .select("rule_config_id", "value", "rows")
    )


def failure_details(values: DataFrame, limit: int = LISTED_VALUES) -> DataFrame:
    """Profile and frequent values side by side, one row per rule."""
    listed = (
        top_values(values, limit)
        .groupBy("rule_config_id")
        .agg(F.sort_array(F.collect_list(F.struct("rows", "value")), asc=False).alias("listed"))
    )
    return failure_profile(values).join(listed, "rule_config_id", "left")


def matched_value_counts(scope: Scope, rule: Rule) -> DataFrame:
    """Rows per allowed value of a set check, trimmed; at most one row per value."""
    name = find_column(scope.df, rule.kwargs.get("column") or rule.column_name)
    column, kind = F.col(quoted(name)), type_of(scope.df, name)
    values = to_column_type(value_list(rule.kwargs, "value_set"), kind)
    seen = F.trim(column) if is_text(kind) else column
    found, prepare = member_test(seen, values, kind)
    rows = prepare(scope.df) if prepare else scope.df
    return (
        rows.where(~missing(column, kind) & found)
        .groupBy(seen.cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(column).alias("spellings"))
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Every value of a column with its number of rows (NULL left out)."""
    name = find_column(df, column)
    return (
        df.where(F.col(quoted(name)).isNotNull())
        .groupBy(F.col(quoted(name)).alias("value"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def set_difference(df: DataFrame, column: str, value_set: list) -> DataFrame:
    """Distinct values against a set: ``value, side`` with missing and extra ones.

    Every difference is returned, distributed; nothing is collected.
    """
    name = find_column(df, column)
    kind = type_of(df, name)
    values = to_column_type(value_set, kind)
    schema = T.StructType([T.StructField("value", kind)])
    expected = small_frame(df.sparkSession, [(v,) for v in values], schema)
    observed = df.select(F.col(quoted(name)).alias("value")).where(F.col("value").isNotNull()).distinct()
    marked = observed.withColumn("seen", F.lit(True)).join(
        expected.withColumn("wanted", F.lit(True)), "value", "full_outer"
    )
    return marked.where(F.col("seen").isNull() | F.col("wanted").isNull()).select(
        "value", F.when(F.col("seen").isNull(), "missing").otherwise("extra").alias("side")
    )


def most_common_values(df: DataFrame, column: str) -> DataFrame:
    """All modes of a column, ties included."""
    name = find_column(df, column)
    groups = group_counts(df.where(F.col(quoted(name)).isNotNull()), [name])
    top = groups.agg(F.max(ROWS_IN_GROUP).alias("top")).scalar()
    return groups.where(F.col(ROWS_IN_GROUP) == top).select(
        F.col(quoted(name)).alias("value"), F.col(ROWS_IN_GROUP).alias("rows")
    )


def value_lists(scope: Scope, c: Compiled) -> DataFrame:
    """``kind, value, rows`` of a rule on distinct values or on the mode: whole lists, distributed."""
    column = c.rule.kwargs.get("column") or c.rule.column_name

    def listed(rows: DataFrame, kind, count) -> DataFrame:
        return rows.select(kind.alias("kind"), F.col("value").cast("string").alias("value"), count.alias("rows"))

    if "_distinct_values_to_" not in c.label:
        return listed(most_common_values(scope.df, column), F.lit("mode"), F.col("rows"))
    wanted = value_list(c.rule.kwargs, "value_set")
    differing = set_difference(scope.df, column, wanted)
    return listed(value_counts(scope.df, column), F.lit("observed"), F.col("rows")).unionByName(
        listed(differing, F.col("side"), F.lit(None).cast("bigint"))
    )


# Example rows of a rule that sets no ``failed_row_count``.
EXAMPLES = 20


def example_rows(compiled: Compiled, scope: Scope) -> DataFrame:
    """The first failing rows of one rule, as many as it keeps, as JSON of the checked columns."""
    spec = compiled.spec
    rows = prepared(scope.df, [compiled]).where(spec.failing).select(*[F.col(quoted(c)) for c in scope.df.columns])
    columns = [F.col(quoted(n)) for n in spec.partial_list]
    kept = first_rows(rows, scope, row_limit(compiled) or EXAMPLES)
    return kept.select(F.to_json(F.struct(*columns)).alias("row"))
