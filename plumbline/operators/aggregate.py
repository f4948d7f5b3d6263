"""Checks on one statistic of a column."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.arithmetic import between_a, between_b, fraction, json_object
from plumbline.functions.columns import as_double, false_if_null, find_column, quoted, type_of
from plumbline.operators.median import approximate_median
from plumbline.operators.spec import (
    MedianSpec,
    ScanSpec,
    all_or_nothing,
    all_rows,
    count_if,
    counted,
)
from plumbline.rule import Rule, RuleError, flag, number, require
from plumbline.sources.datasets import Scope


def _limits(rule: Rule, need_one: bool):
    low, high = number(rule.kwargs, "min_value"), number(rule.kwargs, "max_value")
    if need_one and low is None and high is None:
        raise RuleError("min_value or max_value is required")
    return low, high, flag(rule.kwargs, "strict_min"), flag(rule.kwargs, "strict_max")


def _column(scope: Scope, rule: Rule):
    name = find_column(scope.df, rule.kwargs.get("column") or rule.column_name)
    return F.col(quoted(name)), type_of(scope.df, name)


def _statistic(function, need_one: bool = True):
    """A check that bounds ``function`` of the column read as doubles."""

    def build(scope: Scope, rule: Rule) -> ScanSpec:
        column, data_type = _column(scope, rule)
        limits = _limits(rule, need_one)

        def verdict(m):
            ok = between_b(m("observed"), *limits)
            return all_or_nothing(m("total"), ok, missing=m("missing"), observed=m("observed"))

        measures = {
            "total": all_rows(),
            "missing": count_if(column.isNull()),
            "observed": function(as_double(column, data_type)),
        }
        return ScanSpec(measures, verdict)

    return build


minimum_between = _statistic(F.min)
maximum_between = _statistic(F.max)
sum_between = _statistic(F.sum)
mean_between = _statistic(F.avg, need_one=False)
stdev_between = _statistic(F.stddev_samp)


def median_between(scope: Scope, rule: Rule) -> MedianSpec | ScanSpec:
    """Exact interpolated median; ``approximate`` opts for a measure of the shared scan."""
    column, data_type = _column(scope, rule)
    limits = _limits(rule, need_one=False)
    value = as_double(column, data_type)

    def verdict(m):
        ok = between_b(m("observed"), *limits)
        return all_or_nothing(m("total"), ok, missing=m("missing"), observed=m("observed"))

    if flag(rule.kwargs, "approximate"):
        measures = {
            "total": all_rows(),
            "missing": count_if(column.isNull()),
            "observed": approximate_median(value),
        }
        return ScanSpec(measures, verdict)
    return MedianSpec(column, value, verdict)


def non_null_proportion_between(scope: Scope, rule: Rule) -> ScanSpec:
    column, _ = _column(scope, rule)
    limits = _limits(rule, need_one=False)

    def verdict(m):
        share = fraction(m("present"), m("total"))
        return counted(
            m("total"),
            f"({m('total')} - {m('present')})",
            between_a(share, *limits),
            observed=share,
        )

    return ScanSpec({"total": all_rows(), "present": F.count(column)}, verdict)


# Time units a freshness threshold may use.
FRESHNESS_UNITS = ("SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "QUARTER", "YEAR")


def values_recent(scope: Scope, rule: Rule) -> ScanSpec:
    """The newest value is younger than the threshold; stale tables fail whole.

    The current time is taken from the scope or ``now`` when given, so that a
    run can be repeated.
    """
    column, data_type = _column(scope, rule)
    amount, unit = require(rule.kwargs, "freshness_threshold_value", "freshness_threshold_unit")
    amount = int(number(rule.kwargs, "freshness_threshold_value"))
    unit = str(unit).strip().upper()
    unit = unit if unit in FRESHNESS_UNITS else unit.rstrip("S")
    if unit not in FRESHNESS_UNITS:
        raise RuleError(f"unknown time unit {unit!r}")
    if not isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise RuleError(f"freshness needs a date or time column, not {data_type.simpleString()}")
    now = _current_time(scope, rule, data_type)
    threshold = F.timestamp_add(unit, F.lit(-amount), now)

    def verdict(m):
        return counted(
            m("total"),
            f"IF({m('fresh')}, 0, {m('total')})",
            m("fresh"),
            details=json_object(most_recent=m("newest"), threshold=m("threshold")),
        )

    newest = F.max(column)
    measures = {
        "total": all_rows(),
        "newest": newest.cast("string"),
        "threshold": threshold.cast("string"),
        "fresh": false_if_null(newest > threshold),
    }
    return ScanSpec(measures, verdict)


def _current_time(scope: Scope, rule: Rule, data_type: T.DataType) -> Column:
    given = rule.kwargs.get("now") or scope.now
    if given is None:
        if isinstance(data_type, T.TimestampType):
            return F.current_timestamp()
        zone = rule.kwargs.get("timezone") or "UTC"
        return F.convert_timezone(F.current_timezone(), F.lit(zone), F.localtimestamp())
    if isinstance(given, datetime.datetime):
        given = given.isoformat(sep=" ")
    kind = "timestamp" if isinstance(data_type, T.TimestampType) else "timestamp_ntz"
    return F.lit(str(given)).cast(kind)
