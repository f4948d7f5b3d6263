"""Many rules, few passes.

``evaluate`` compiles the rules of a dataset and groups what they need:

* all plain aggregates go into one scan,
* rules on the same key share one grouping of that key,
* all medians share three scans,
* everything else brings its own one-row frame,

and the parts are unioned, so one job answers all rules and Spark schedules
their stages side by side.  ``failing_rows`` tags each row with the rules it
fails, again in one pass for all row predicates.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.catalog import expectation
from plumbline.functions.columns import quoted
from plumbline.functions.local import small_frame
from plumbline.operators.median import medians
from plumbline.operators.skew import group_counts
from plumbline.operators.spec import FrameSpec, GroupSpec, MedianSpec, ScanSpec, Spec, result_struct
from plumbline.plans.parallel import side_by_side
from plumbline.rule import Rule, RuleError
from plumbline.sources.datasets import Scope

# More aggregates than this in one scan outgrow a generated method.
RULES_PER_SCAN = 64


@dataclass(frozen=True)
class Compiled:
    rule: Rule
    spec: Spec

    @property
    def label(self) -> str:
        return expectation(self.rule.expectation).name


def compile_rule(scope: Scope, rule: Rule) -> Compiled:
    """The rule's spec.  Runs no job."""
    return Compiled(rule, expectation(rule.expectation).build(scope, rule))


def compile_rules(scope: Scope, rules: list[Rule]) -> tuple[list[Compiled], dict[int, Exception]]:
    """Compiled rules, and the error of every rule that does not compile."""
    compiled, errors = [], {}
    for rule in rules:
        try:
            compiled.append(compile_rule(scope, rule))
        except Exception as exc:  # one bad rule must not stop the others
            errors[rule.rule_config_id] = exc
    return compiled, errors


def analysed(compiled: list[Compiled], scope: Scope) -> tuple[list[Compiled], dict[int, Exception]]:
    """Rules whose plans Spark accepts, and the error of each of the others."""
    good, errors = [], {}
    for c in compiled:
        try:
            if not isinstance(c.spec, FrameSpec):
                results([c], scope)
            good.append(c)
        except Exception as exc:
            errors[c.rule.rule_config_id] = exc
    return good, errors


def evaluate(scope: Scope, rules: list[Rule]) -> DataFrame:
    """One result row per rule; raises on the first rule that does not compile."""
    ids = [r.rule_config_id for r in rules]
    repeated = sorted({i for i in ids if ids.count(i) > 1})
    if repeated:
        raise RuleError(f"rule ids are used more than once: {repeated}")
    return results([compile_rule(scope, r) for r in rules], scope)


def results(compiled: list[Compiled], scope: Scope) -> DataFrame:
    return reduce(DataFrame.unionByName, parts(compiled, scope))


def passes(compiled: list[Compiled]) -> list[list[Compiled]]:
    """The rules that share a pass over the data, pass by pass."""
    out = []
    for kind in (ScanSpec, MedianSpec):
        scans = [c for c in compiled if isinstance(c.spec, kind)]
        out += [scans[start : start + RULES_PER_SCAN] for start in range(0, len(scans), RULES_PER_SCAN)]
    by_key: dict[tuple[str, ...], list[Compiled]] = {}
    for c in compiled:
        if isinstance(c.spec, GroupSpec):
            by_key.setdefault(tuple(sorted(c.spec.keys)), []).append(c)
    return [*out, *by_key.values(), *[[c] for c in compiled if isinstance(c.spec, FrameSpec)]]


def parts(compiled: list[Compiled], scope: Scope) -> list[DataFrame]:
    """Result frames, one for every pass over the data; medians take two jobs to make."""
    out, made = [], []
    for group in passes(compiled):
        if isinstance(group[0].spec, ScanSpec):
            out.append(_scan(group, scope))
        elif isinstance(group[0].spec, GroupSpec):
            out.append(_grouped(group, scope))
        elif isinstance(group[0].spec, MedianSpec):
            made.append(lambda g=group: _medians(g, scope))
        else:
            made.append(lambda c=group[0]: _framed(c))
    return out + side_by_side(made)


def _measure(c: Compiled, name: str) -> str:
    return f"r{c.rule.rule_config_id}_{name}"


def _verdicts(frame: DataFrame, compiled: list[Compiled], prefixed: bool = True) -> DataFrame:
    """The row of measures turned into one row per rule."""
    rows = []
    for c in compiled:
        def measure(name, c=c):
            return quoted(_measure(c, name) if prefixed else name)

        rows.append(result_struct(c.rule.rule_config_id, c.label, c.spec.verdict(measure)))
    return frame.selectExpr(f"inline(array({', '.join(rows)}))")


def measures(compiled: list[Compiled]) -> list[Column]:
    """The aggregates of scan or group rules, each under a name of its own."""
    return [column.alias(_measure(c, name)) for c in compiled for name, column in c.spec.measures.items()]


def verdicts_of(spark: SparkSession, compiled: list[Compiled], found: dict, kinds: T.StructType) -> DataFrame:
    """Result rows from measures that are known."""
    return _verdicts(small_frame(spark, [tuple(found[f.name] for f in kinds.fields)], kinds), compiled)


def _scan(compiled: list[Compiled], scope: Scope) -> DataFrame:
    aggregates = measures(compiled)
    if not aggregates:  # schema checks alone
        return _verdicts(scope.spark.range(1), compiled)
    return _verdicts(prepared(scope.df, compiled).agg(*aggregates), compiled)


def prepared(df: DataFrame, compiled: list[Compiled]) -> DataFrame:
    """The dataset with the helper columns its rules ask for."""
    for c in compiled:
        if isinstance(c.spec, ScanSpec) and c.spec.prepare is not None:
            df = c.spec.prepare(df)
    return df


def _grouped(compiled: list[Compiled], scope: Scope) -> DataFrame:
    groups = group_counts(scope.df, compiled[0].spec.keys)
    for c in compiled:
        if c.spec.prepare is not None:
            groups = c.spec.prepare(groups)
    return _verdicts(groups.agg(*measures(compiled)), compiled)


def _medians(compiled: list[Compiled], scope: Scope) -> DataFrame:
    wanted = {_measure(c, ""): (c.spec.column, c.spec.value) for c in compiled}
    return _verdicts(medians(scope.df, wanted), compiled)


def _framed(c: Compiled) -> DataFrame:
    return _verdicts(c.spec.frame(), [c], prefixed=False)


def failing_rows(scope: Scope, rules: list[Rule]) -> DataFrame:
    """Failing rows of all rules, each with the id of the rule it fails."""
    return tagged_rows([compile_rule(scope, r) for r in rules], scope)


# Columns of a custom query that the dataset lacks, as a JSON object.
QUERY_COLUMNS = "query_columns"


def tagged_rows(compiled: list[Compiled], scope: Scope) -> DataFrame:
    """``rule_config_id`` and the dataset's columns, one row per failure.

    ``failed_row_count`` keeps that many rows of the rule that sets it, the
    first by primary key and then by all columns.  When a custom query has
    columns of its own, all rows get ``query_columns`` with those as JSON.
    """
    frames = failing_frames(compiled, scope)
    if not frames:
        source = [F.col(quoted(c)) for c in scope.df.columns]
        return scope.df.where(F.lit(False)).select(F.lit(0).cast("bigint").alias("rule_config_id"), *source)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def failing_frames(compiled: list[Compiled], scope: Scope) -> list[DataFrame]:
    """The parts of ``tagged_rows``: one for all row predicates, one for each other rule."""
    source = [F.col(quoted(c)) for c in scope.df.columns]
    scans = [c for c in compiled if isinstance(c.spec, ScanSpec) and c.spec.failing is not None]
    free = [c for c in scans if row_limit(c) is None]
    frames = []
    if free:
        tags = [F.when(c.spec.failing, F.lit(c.rule.rule_config_id).cast("bigint")) for c in free]
        rows = prepared(scope.df, free).where(reduce(or_, [c.spec.failing for c in free]))
        frames.append(
            rows.select(F.explode(F.array_compact(F.array(*tags))).alias("rule_config_id"), *source)
        )
    for c in scans:
        if row_limit(c) is not None:
            rows = prepared(scope.df, [c]).where(c.spec.failing).select(*source)
            frames.append(_tagged(first_rows(rows, scope, row_limit(c)), c, scope.df))
    for c in compiled:
        if isinstance(c.spec, (GroupSpec, FrameSpec)) and c.spec.failing is not None:
            rows = c.spec.failing()
            if row_limit(c) is not None:
                rows = first_rows(rows, scope, row_limit(c))
            frames.append(_tagged(rows, c, scope.df))
    return frames


def row_limit(c: Compiled) -> int | None:
    given = c.rule.kwargs.get("failed_row_count")
    return int(given) if given not in (None, "") and int(given) > 0 else None


def first_rows(rows: DataFrame, scope: Scope, limit: int) -> DataFrame:
    """The first rows by primary key, then by every column that has an order."""
    have = {n.lower(): n for n in rows.columns}
    keys = [have[k.lower()] for k in scope.primary_key if k.lower() in have]
    rest = [f.name for f in rows.schema.fields if f.name not in keys and not _unordered(f.dataType)]
    order = [F.col(quoted(n)) for n in dict.fromkeys([*keys, *rest])]
    return rows.orderBy(*order).limit(limit) if order else rows.limit(limit)


def _unordered(kind: T.DataType) -> bool:
    return isinstance(kind, (T.MapType, T.VariantType)) or (
        isinstance(kind, T.ArrayType) and _unordered(kind.elementType)
    ) or (isinstance(kind, T.StructType) and any(_unordered(f.dataType) for f in kind.fields))


def _tagged(rows: DataFrame, c: Compiled, dataset: DataFrame) -> DataFrame:
    """The rows under the rule's id with the dataset's columns, whatever their case.

    Columns the rows lack are NULL; columns only the rows have go into
    ``query_columns``.
    """
    if len({n.lower() for n in rows.columns}) < len(rows.columns):
        rows = rows.toDF(*_distinct_names(rows.columns))
    have = {n.lower(): n for n in rows.columns}
    known = {n.lower() for n in dataset.columns}
    columns = [
        (F.col(quoted(have[f.name.lower()])) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in dataset.schema.fields
    ]
    more = [n for n in rows.columns if n.lower() not in known]
    if more:
        columns.append(F.to_json(F.struct(*[F.col(quoted(n)) for n in more])).alias(QUERY_COLUMNS))
    return rows.select(F.lit(c.rule.rule_config_id).cast("bigint").alias("rule_config_id"), *columns)


def _distinct_names(names: list[str]) -> list[str]:
    """Repeated output names, numbered from the second on."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        seen[name.lower()] = seen.get(name.lower(), 0) + 1
        out.append(name if seen[name.lower()] == 1 else f"{name}_{seen[name.lower()]}")
    return out
