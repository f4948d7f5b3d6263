"""Checks that need the groups of a key: uniqueness, distinct values, mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.arithmetic import (
    between_a,
    fraction,
    json_object,
    mostly_at_least,
    mostly_at_most,
)
from plumbline.functions.columns import find_column, ignore_rows, missing, quoted, type_of
from plumbline.functions.matching import to_column_type
from plumbline.operators.membership import member_test
from plumbline.operators.skew import (
    group_counts,
    possibly_repeated,
    repeated_hashes,
    rows_beyond_first,
    rows_of_groups,
)
from plumbline.operators.spec import (
    ROWS_IN_GROUP,
    FrameSpec,
    GroupSpec,
    ScanSpec,
    Verdict,
    all_or_nothing,
    all_rows,
    combine_single_rows,
    count_if,
    counted,
    group_rows,
    sum_if,
)
from plumbline.rule import Rule, RuleError, flag, mostly, name_list, number, value_list
from plumbline.sources.datasets import Scope


def _key(scope: Scope, rule: Rule):
    name = find_column(scope.df, rule.kwargs.get("column") or rule.column_name)
    return name, F.col(quoted(name)), type_of(scope.df, name)


def _total() -> Column:
    return F.coalesce(F.sum(ROWS_IN_GROUP), F.lit(0))


def values_unique(scope: Scope, rule: Rule) -> GroupSpec | FrameSpec:
    """Every row of a repeated value fails; blanks are left out."""
    name, c, t = _key(scope, rule)
    rows, absent = group_rows(), missing(c, t)
    allowed = mostly(rule.kwargs)

    def verdict(m):
        return counted(
            m("total"),
            m("bad"),
            mostly_at_least(fraction(m("bad"), m("total")), allowed),
            missing=m("missing"),
            observed=m("unique"),
            details=json_object(unique_count=m("unique")),
        )

    present = scope.df.where(~absent)
    if rule.kwargs.get("by_hash"):  # long texts: compare values only where their hashes repeat
        return FrameSpec(
            lambda: _wide_unique(scope.df, name, absent),
            verdict,
            failing=lambda: rows_of_groups(_suspects(present, name), [name], group_rows() > 1),
            profile=name,
            failing_groups=lambda: group_counts(_suspects(present, name), [name]).where(group_rows() > 1),
        )
    repeated = (rows > 1) & ~absent
    return GroupSpec(
        keys=(name,),
        measures={
            "total": _total(),
            "missing": sum_if(absent, rows),
            "bad": sum_if(repeated, rows),
            "unique": count_if(~absent),
        },
        verdict=verdict,
        failing=lambda: rows_of_groups(present, [name], group_rows() > 1),
        profile=name,
        failing_groups=repeated,
    )


def _wide_unique(df: DataFrame, name: str, absent: Column) -> DataFrame:
    """Measures of a long text column: hashes first, values only where hashes repeat."""
    present = df.where(~absent).select(F.col(quoted(name)))
    hashes, repeated = repeated_hashes(present, name)
    suspects = possibly_repeated(present, name, repeated)
    once = F.col(ROWS_IN_GROUP) == 1
    if suspects is None:
        suspects, once = present, F.lit(False)
    groups = group_counts(suspects, [name])
    one = combine_single_rows(
        [
            df.agg(all_rows().alias("total"), count_if(absent).alias("missing")),
            hashes.agg(count_if(once).alias("single")),
            groups.agg(
                sum_if(group_rows() > 1, group_rows()).alias("bad"), all_rows().alias("compared")
            ),
        ]
    )
    return one.select("total", "missing", "bad", (F.col("single") + F.col("compared")).alias("unique"))


def _suspects(present: DataFrame, name: str) -> DataFrame:
    """The rows among which values can repeat."""
    _, repeated = repeated_hashes(present, name)
    rows = possibly_repeated(present, name, repeated)
    return present if rows is None else rows


def row_order(scope: Scope) -> list[Column]:
    """A total order of rows up to exact copies: primary key, then every column."""
    known = [n for n in scope.primary_key if n.lower() in [c.lower() for c in scope.df.columns]]
    first = [find_column(scope.df, n) for n in known]
    rest = [
        f.name
        for f in scope.df.schema.fields
        if f.name not in first and f.dataType.typeName() not in ("map", "variant")
    ]
    return [F.col(quoted(n)).asc_nulls_first() for n in first + rest]


def compound_unique(scope: Scope, rule: Rule) -> GroupSpec:
    """Rows beyond the first of each combination fail; NULLs group together."""
    names = [find_column(scope.df, n) for n in name_list(rule.kwargs, "column_list")]
    if len(names) < 2:
        raise RuleError("column_list needs at least two columns")
    columns = [F.col(quoted(n)) for n in names]
    rows = group_rows()
    ignored = ignore_rows(columns, rule.kwargs.get("ignore_row_if"), "never")
    allowed = mostly(rule.kwargs)

    def verdict(m):
        return counted(
            m("total"),
            m("bad"),
            mostly_at_most(fraction(m("bad"), m("total")), allowed),
            missing=m("missing"),
            same_nonmissing=True,
        )

    return GroupSpec(
        keys=tuple(names),
        measures={
            "total": sum_if(~ignored, rows),
            "missing": sum_if(ignored, rows),
            "bad": sum_if(~ignored, rows - 1),
        },
        verdict=verdict,
        failing=lambda: rows_beyond_first(
            scope.df.where(~ignored), names, group_rows() > 1, row_order(scope)
        ),
    )


def unique_count_between(scope: Scope, rule: Rule) -> GroupSpec | ScanSpec:
    """Exact by grouping; ``approximate`` opts for a sketch in the shared scan."""
    name, c, _ = _key(scope, rule)
    low, high = _bounds(rule)

    def verdict(m):
        ok = between_a(m("unique"), low, high, *_strict(rule))
        return all_or_nothing(m("total"), ok, observed=m("unique"))

    if flag(rule.kwargs, "approximate"):
        return ScanSpec({"total": all_rows(), "unique": F.approx_count_distinct(c)}, verdict)
    measures = {"total": _total(), "unique": count_if(c.isNotNull())}
    return GroupSpec((name,), measures, verdict)


def unique_proportion_between(scope: Scope, rule: Rule) -> GroupSpec | ScanSpec:
    name, c, _ = _key(scope, rule)
    low, high = number(rule.kwargs, "min_value"), number(rule.kwargs, "max_value")

    def verdict(m):
        share = fraction(m("unique"), m("present"))
        return all_or_nothing(
            m("total"), between_a(share, low, high, *_strict(rule)), observed=share
        )

    if flag(rule.kwargs, "approximate"):
        sketch = {"total": all_rows(), "present": F.count(c), "unique": F.approx_count_distinct(c)}
        return ScanSpec(sketch, verdict)
    measures = {
        "total": _total(),
        "present": sum_if(c.isNotNull(), group_rows()),
        "unique": count_if(c.isNotNull()),
    }
    return GroupSpec((name,), measures, verdict)


def _bounds(rule: Rule):
    low, high = number(rule.kwargs, "min_value"), number(rule.kwargs, "max_value")
    if low is None and high is None:
        raise RuleError("min_value or max_value is required")
    return low, high


def _strict(rule: Rule) -> tuple[bool, bool]:
    return flag(rule.kwargs, "strict_min"), flag(rule.kwargs, "strict_max")


def most_common_in_set(scope: Scope, rule: Rule) -> GroupSpec:
    """All most common values must be in the set, or one of them with ``ties_okay``.

    Comparing the largest group inside the set with the largest outside it
    decides both cases without listing the modes.
    """
    name, c, t = _key(scope, rule)
    values = to_column_type(value_list(rule.kwargs, "value_set"), t)
    ties_okay = flag(rule.kwargs, "ties_okay")
    rows = group_rows()
    member, prepare = member_test(c, values, t)

    def verdict(m):
        inside, outside = f"coalesce({m('inside')}, 0)", f"coalesce({m('outside')}, 0)"
        ok = f"({inside} > 0 AND {inside} {'>=' if ties_okay else '>'} {outside})"
        return all_or_nothing(m("total"), ok, observed=f"greatest({inside}, {outside})")

    measures = {
        "total": _total(),
        "inside": F.max(F.when(c.isNotNull() & member, rows)),
        "outside": F.max(F.when(c.isNotNull() & ~member, rows)),
    }
    return GroupSpec((name,), measures, verdict, prepare=prepare)


def _distinct_check(scope: Scope, rule: Rule, passes) -> GroupSpec:
    """Distinct values against a set; NULLs count for nothing."""
    name, c, t = _key(scope, rule)
    given = value_list(rule.kwargs, "value_set")
    values = to_column_type(given, t)
    impossible = len({repr(v) for v in given if v is not None and not to_column_type([v], t)})
    rows = group_rows()
    member, prepare = member_test(c, values, t)

    def verdict(m):
        absent = f"({len(values) + impossible} - {m('found')})"
        distinct = f"({m('found')} + {m('extra')})"
        return Verdict(
            element_count=m("present"),
            unexpected_count=m("extra"),
            observed_value=distinct,
            details=json_object(
                distinct_values=distinct, missing_values=absent, extra_values=m("extra")
            ),
            is_success=passes(absent, m("extra")),
        )

    measures = {
        "present": sum_if(c.isNotNull(), rows),
        "found": count_if(c.isNotNull() & member),
        "extra": count_if(c.isNotNull() & ~member),
    }
    return GroupSpec((name,), measures, verdict, prepare=prepare)


def distinct_in_set(scope: Scope, rule: Rule) -> GroupSpec:
    return _distinct_check(scope, rule, lambda absent, extra: f"({extra} = 0)")


def distinct_equal_set(scope: Scope, rule: Rule) -> GroupSpec:
    return _distinct_check(scope, rule, lambda absent, extra: f"({absent} = 0 AND {extra} = 0)")


def distinct_contain_set(scope: Scope, rule: Rule) -> GroupSpec:
    return _distinct_check(scope, rule, lambda absent, extra: f"({absent} = 0)")

