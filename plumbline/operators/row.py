"""Row-level checks: a predicate per row, counted in the shared scan."""

from __future__ import annotations

from functools import reduce
from itertools import count
from operator import add, and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.arithmetic import fraction, json_object, mostly_at_least, mostly_at_most
from plumbline.functions.columns import (
    as_double,
    blank,
    bound,
    comparable,
    false_if_null,
    find_column,
    ignore_rows,
    is_text,
    missing,
    quoted,
    type_of,
)
from plumbline.functions.matching import as_text, full_match, to_column_type
from plumbline.operators.membership import member_test, pair_test
from plumbline.operators.spec import ScanSpec, all_rows, count_if, counted
from plumbline.rule import Rule, RuleError, flag, mostly, name_list, number, require, value_list
from plumbline.sources.datasets import Scope

_serial = count()


def _column(scope: Scope, rule: Rule, argument: str = "column"):
    """Name, column and type of the checked column."""
    given = rule.kwargs.get(argument) or (rule.column_name if argument == "column" else None)
    name = find_column(scope.df, given)
    return name, F.col(quoted(name)), type_of(scope.df, name)


def _simple(rule, name, bad, absent=None, gate=mostly_at_most, **options) -> ScanSpec:
    """Total, missing and failing rows; the failing share of all rows decides."""
    measures = {"total": all_rows(), "bad": count_if(bad)}
    if absent is not None:
        measures["missing"] = count_if(absent)
    allowed = mostly(rule.kwargs)

    def verdict(m):
        return counted(
            m("total"),
            m("bad"),
            gate(fraction(m("bad"), m("total")), allowed),
            missing=m("missing") if absent is not None else None,
            **options,
        )

    return ScanSpec(measures, verdict, failing=bad, profile=name)


def values_not_null(scope: Scope, rule: Rule) -> ScanSpec:
    name, c, t = _column(scope, rule)
    return _simple(rule, name, missing(c, t))


def values_null(scope: Scope, rule: Rule) -> ScanSpec:
    name, c, t = _column(scope, rule)
    return _simple(rule, name, ~missing(c, t))


def values_between(scope: Scope, rule: Rule) -> ScanSpec:
    name, c, t = _column(scope, rule)
    low, high = require(rule.kwargs, "min_value", "max_value")
    value = comparable(c, t)
    low, high = bound(low, t), bound(high, t)
    below = (value <= low) if flag(rule.kwargs, "strict_min") else (value < low)
    above = (value >= high) if flag(rule.kwargs, "strict_max") else (value > high)
    absent = missing(c, t)
    return _simple(rule, name, false_if_null(~absent & (below | above)), absent)


def values_in_set(scope: Scope, rule: Rule) -> ScanSpec:
    name, c, t = _column(scope, rule)
    values = to_column_type(value_list(rule.kwargs, "value_set"), t)
    absent = missing(c, t)
    found, prepare = member_test(F.trim(c) if is_text(t) else c, values, t)
    bad = false_if_null(~absent & ~found)
    spec = _simple(rule, name, bad, absent)
    allowed = mostly(rule.kwargs)

    def verdict(m):
        matched = f"({m('total')} - {m('missing')} - {m('bad')})"
        return counted(
            m("total"),
            m("bad"),
            mostly_at_most(fraction(m("bad"), m("total")), allowed),
            missing=m("missing"),
            observed=matched,
            details=json_object(match_count=matched),
        )

    return ScanSpec(spec.measures, verdict, failing=bad, profile=name, prepare=prepare)


def values_not_in_set(scope: Scope, rule: Rule) -> ScanSpec:
    name, c, t = _column(scope, rule)
    values = to_column_type(value_list(rule.kwargs, "value_set"), t)
    found, prepare = member_test(c, values, t)
    bad = false_if_null(c.isNotNull() & found)
    spec = _simple(rule, name, bad, missing(c, t))
    return ScanSpec(spec.measures, spec.verdict, failing=bad, profile=name, prepare=prepare)


def matches_regex(scope: Scope, rule: Rule) -> ScanSpec:
    """Blank values count as missing and as mismatches."""
    name, c, _ = _column(scope, rule)
    (pattern,) = require(rule.kwargs, "regex")
    absent = blank(c)
    hit = full_match(F.trim(c.cast("string")), pattern)
    return _simple(rule, name, absent | ~false_if_null(hit), absent)


def not_matches_regex(scope: Scope, rule: Rule) -> ScanSpec:
    name, c, _ = _column(scope, rule)
    (pattern,) = require(rule.kwargs, "regex")
    absent = blank(c)
    hit = full_match(F.trim(c.cast("string")), pattern)
    return _simple(rule, name, ~absent & false_if_null(hit), absent)


def _list_hits(column: Column, rule: Rule) -> Column:
    patterns = value_list(rule.kwargs, "regex_list")
    if not patterns:
        raise RuleError("regex_list is empty")
    word = str(rule.kwargs.get("match_on") or "ANY").upper()
    if word not in ("ANY", "ALL"):
        raise RuleError(f"match_on must be ANY or ALL, got {word!r}")
    text = column.cast("string")
    return reduce(or_ if word == "ANY" else and_, [full_match(text, p) for p in patterns])


def matches_regex_list(scope: Scope, rule: Rule) -> ScanSpec:
    name, c, _ = _column(scope, rule)
    bad = c.isNotNull() & ~false_if_null(_list_hits(c, rule))
    return _simple(rule, name, bad, c.isNull())


def not_matches_regex_list(scope: Scope, rule: Rule) -> ScanSpec:
    name, c, _ = _column(scope, rule)
    bad = c.isNotNull() & false_if_null(_list_hits(c, rule))
    return _simple(rule, name, bad, c.isNull())


def lengths_between(scope: Scope, rule: Rule) -> ScanSpec:
    """Untrimmed length; strict bounds only with ``honour_strict``."""
    name, c, t = _column(scope, rule)
    low = number(rule.kwargs, "min_value", 0)
    high = number(rule.kwargs, "max_value", 9999999)
    strict = flag(rule.kwargs, "honour_strict")
    size = F.length(c.cast("string"))
    below = (size <= low) if strict and flag(rule.kwargs, "strict_min") else (size < low)
    above = (size >= high) if strict and flag(rule.kwargs, "strict_max") else (size > high)
    absent = blank(c)
    bad = false_if_null(~absent & (below | above))
    return _simple(rule, name, bad, absent, gate=mostly_at_least, same_nonmissing=True)


def lengths_equal(scope: Scope, rule: Rule) -> ScanSpec:
    name, c, _ = _column(scope, rule)
    require(rule.kwargs, "value")
    bad = c.isNotNull() & (F.length(c.cast("string")) != F.lit(number(rule.kwargs, "value")))
    return _simple(rule, name, bad, c.isNull())


def in_given_format(scope: Scope, rule: Rule) -> ScanSpec:
    """Text that does not parse in the given date pattern."""
    name, c, t = _column(scope, rule)
    (pattern,) = require(rule.kwargs, "format")
    absent = missing(c, t)
    parsed = F.try_to_timestamp(c.cast("string"), F.lit(pattern))
    return _simple(rule, name, ~absent & parsed.isNull(), absent)


def unique_within_record(scope: Scope, rule: Rule) -> ScanSpec:
    """Values of the listed columns differ within each row (NULLs are equal)."""
    names = [find_column(scope.df, n) for n in name_list(rule.kwargs, "column_list")]
    if len(names) < 2:
        raise RuleError("column_list needs at least two columns")
    columns = [F.col(quoted(n)) for n in names]
    ignored = ignore_rows(columns, rule.kwargs.get("ignore_row_if"), "never")
    repeated = F.size(F.array_distinct(F.array(*columns))) < len(names)
    bad = ~ignored & repeated
    allowed = mostly(rule.kwargs)

    def verdict(m):
        everything = f"({m('total')} + {m('missing')})"
        return counted(
            m("total"),
            m("bad"),
            mostly_at_most(fraction(m("bad"), everything), allowed),
            missing=m("missing"),
            denominator=everything,
        )

    measures = {"total": count_if(~ignored), "missing": count_if(ignored), "bad": count_if(bad)}
    return ScanSpec(measures, verdict, failing=bad, partial_list=tuple(names))


def pair_a_greater_than_b(scope: Scope, rule: Rule) -> ScanSpec:
    """The share among rows with both values decides."""
    _, a, ta = _column(scope, rule, "column_A")
    _, b, tb = _column(scope, rule, "column_B")
    left, right = comparable(a, ta), comparable(b, tb)
    ignored = ignore_rows([a, b], rule.kwargs.get("ignore_row_if"), "neither")
    absent = a.isNull() | b.isNull()
    holds = (left >= right) if flag(rule.kwargs, "or_equal") else (left > right)
    bad = false_if_null(~absent & ~holds & ~ignored)
    allowed = mostly(rule.kwargs)

    def verdict(m):
        share = fraction(m("bad"), f"({m('total')} - {m('missing')})")
        return counted(m("total"), m("bad"), mostly_at_most(share, allowed), missing=m("missing"))

    measures = {
        "total": count_if(~ignored),
        "missing": count_if(absent & ~ignored),
        "bad": count_if(bad),
    }
    return ScanSpec(measures, verdict, failing=bad)


def pair_equal(scope: Scope, rule: Rule) -> ScanSpec:
    _, a, _ = _column(scope, rule, "column_A")
    _, b, _ = _column(scope, rule, "column_B")
    both = "both_values_are_missing"
    ignored = ignore_rows([a, b], rule.kwargs.get("ignore_row_if"), both, unknown=both)
    bad = ~a.eqNullSafe(b) & ~ignored
    allowed = mostly(rule.kwargs)

    def verdict(m):
        return counted(
            m("total"), m("bad"), mostly_at_most(fraction(m("bad"), m("total")), allowed)
        )

    return ScanSpec({"total": count_if(~ignored), "bad": count_if(bad)}, verdict, failing=bad)


def pair_in_set(scope: Scope, rule: Rule) -> ScanSpec:
    listed = name_list(rule.kwargs, "column_list") + [None, None]
    name_a = find_column(scope.df, rule.kwargs.get("column_A") or listed[0])
    name_b = find_column(scope.df, rule.kwargs.get("column_B") or listed[1])
    a, b = F.col(quoted(name_a)), F.col(quoted(name_b))
    types = (type_of(scope.df, name_a), type_of(scope.df, name_b))
    given = value_list(rule.kwargs, "value_pairs_set")
    if not given:
        raise RuleError("value_pairs_set is empty")
    pairs = [typed for pair in given if (typed := _typed_pair(pair, types)) is not None]
    both = "both_values_are_missing"
    ignored = ignore_rows([a, b], rule.kwargs.get("ignore_row_if"), both, unknown=both)
    found, prepare = pair_test(a, b, pairs, types)
    bad = ~ignored & ~found
    allowed = mostly(rule.kwargs)

    def verdict(m):
        return counted(
            m("total"),
            m("bad"),
            mostly_at_most(fraction(m("bad"), m("total")), allowed),
            missing=m("missing"),
        )

    measures = {
        "total": count_if(~ignored),
        "missing": count_if(a.isNull() & b.isNull()),
        "bad": count_if(bad),
    }
    return ScanSpec(measures, verdict, failing=bad, prepare=prepare)


def _typed_pair(pair, types):
    """The pair in the columns' types; None when a value can never match."""
    if not isinstance(pair, (list, tuple)) or len(pair) != 2:
        raise RuleError(f"not a pair: {pair!r}")
    out = []
    for value, data_type in zip(pair, types):
        if value is None:
            out.append(None)
            continue
        typed = to_column_type([as_text(value)], data_type)
        if not typed:
            return None
        out.append(typed[0])
    return tuple(out)


# Two row sums closer than this are equal.
SUM_TOLERANCE = 0.0001


def multicolumn_sum(scope: Scope, rule: Rule) -> ScanSpec:
    names = [find_column(scope.df, n) for n in name_list(rule.kwargs, "column_list")]
    if not names:
        raise RuleError("column_list is empty")
    require(rule.kwargs, "sum_total")
    target = float(number(rule.kwargs, "sum_total"))
    columns = [F.col(quoted(n)) for n in names]
    numbers = [
        F.coalesce(as_double(c, type_of(scope.df, n)), F.lit(0.0)) for c, n in zip(columns, names)
    ]
    ignored = ignore_rows(columns, rule.kwargs.get("ignore_row_if"), "neither")
    bad = (F.abs(reduce(add, numbers) - F.lit(target)) > SUM_TOLERANCE) & ~ignored
    allowed = mostly(rule.kwargs)

    def verdict(m):
        return counted(
            m("total"),
            m("bad"),
            mostly_at_least(fraction(m("bad"), m("total")), allowed),
            missing=m("missing"),
            same_nonmissing=True,
        )

    measures = {
        "total": count_if(~ignored),
        "missing": count_if(reduce(or_, [c.isNull() for c in columns])),
        "bad": count_if(bad),
    }
    return ScanSpec(measures, verdict, failing=bad)


def z_scores_below(scope: Scope, rule: Rule) -> ScanSpec:
    """Distance from the mean in standard deviations of the whole dataset.

    Mean and deviation come from a scalar subquery over one column, so the
    test itself still runs in the shared scan.
    """
    name, c, t = _column(scope, rule)
    require(rule.kwargs, "threshold")
    threshold = float(number(rule.kwargs, "threshold"))
    value = as_double(c, t)
    summary = scope.whole.agg(
        F.struct(F.avg(value).alias("mean"), F.stddev_samp(value).alias("stddev")).alias("stats")
    ).scalar()
    holder = f"__stats{next(_serial)}"
    stats = F.col(holder)
    spread = F.when(stats["stddev"] != 0, stats["stddev"])
    score = (value - stats["mean"]) / spread
    near = F.abs(score) if flag(rule.kwargs, "double_sided") else score
    bad = false_if_null(c.isNotNull() & ~(near < threshold))
    allowed = mostly(rule.kwargs)

    def verdict(m):
        constant = f"coalesce({m('stddev')} = 0, true)"
        near_enough = mostly_at_most(fraction(m("bad"), m("total")), allowed)
        return counted(
            m("total"),
            m("bad"),
            f"({constant} OR {near_enough})",
            missing=m("missing"),
            observed=m("mean"),
            details=json_object(mean=m("mean"), stddev=m("stddev")),
        )

    measures = {
        "total": count_if(c.isNotNull()),
        "missing": count_if(c.isNotNull() & score.isNull()),
        "bad": count_if(bad),
        "mean": F.max(stats["mean"]),
        "stddev": F.max(stats["stddev"]),
    }
    return ScanSpec(
        measures,
        verdict,
        failing=bad,
        profile=name,
        prepare=lambda df: df.withColumn(holder, summary),
        partial_list=(name,),
    )
