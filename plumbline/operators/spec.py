"""What a check compiles to.

``ScanSpec``   plain aggregates over the dataset's rows; any number of them
               share one scan.
``GroupSpec``  aggregates over the groups of a key; specs with the same key
               share one shuffle, and duplicates collapse before it.
``MedianSpec`` the middle value of a column; all of them share three scans.
``FrameSpec``  a one-row frame of measures of its own (other tables, queries).

Each carries a ``verdict`` that turns measures into the result columns, so a
verdict is part of the plan and the driver sees one row per rule.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.arithmetic import literal, percent, struct

ROWS_IN_GROUP = "__rows"

Measures = Callable[[str], str]


@dataclass(frozen=True)
class Verdict:
    """Result columns of one rule as SQL over its measures; percents are out of 100."""

    element_count: str
    is_success: str
    missing_count: str | None = None
    unexpected_count: str | None = None
    missing_percent: str | None = None
    unexpected_percent: str | None = None
    unexpected_percent_nonmissing: str | None = None
    unexpected_percent_total: str | None = None
    observed_value: str | None = None
    observed_json: str | None = None
    details: str | None = None


# Name and type of every verdict column, in result order.
RESULT_TYPES = {
    "element_count": "bigint",
    "missing_count": "bigint",
    "unexpected_count": "bigint",
    "missing_percent": "double",
    "unexpected_percent": "double",
    "unexpected_percent_nonmissing": "double",
    "unexpected_percent_total": "double",
    "observed_value": "double",
    "observed_json": "string",
    "details": "string",
    "is_success": "boolean",
}


@dataclass(frozen=True)
class ScanSpec:
    measures: dict[str, Column]
    verdict: Callable[[Measures], Verdict]
    failing: Column | None = None
    profile: str | None = None
    prepare: Callable[[DataFrame], DataFrame] | None = None
    partial_list: tuple[str, ...] = ()


@dataclass(frozen=True)
class GroupSpec:
    keys: tuple[str, ...]
    measures: dict[str, Column]
    verdict: Callable[[Measures], Verdict]
    failing: Callable[[], DataFrame] | None = None
    profile: str | None = None
    failing_groups: Column | None = None
    prepare: Callable[[DataFrame], DataFrame] | None = None


@dataclass(frozen=True)
class FrameSpec:
    frame: Callable[[], DataFrame]
    verdict: Callable[[Measures], Verdict]
    failing: Callable[[], DataFrame] | None = None
    profile: str | None = None
    failing_groups: Callable[[], DataFrame] | None = None


@dataclass(frozen=True)
class MedianSpec:
    """Measures ``total``, ``missing`` and ``observed`` of a column's numeric reading."""

    column: Column
    value: Column
    verdict: Callable[[Measures], Verdict]
    failing: None = None
    profile: None = None


Spec = ScanSpec | GroupSpec | MedianSpec | FrameSpec


def counted(
    total: str,
    unexpected: str,
    success: str,
    missing: str | None = None,
    denominator: str | None = None,
    same_nonmissing: bool = False,
    observed: str | None = None,
    details: str | None = None,
) -> Verdict:
    """A verdict from counts.  ``denominator`` replaces ``total`` in percents."""
    whole = total if denominator is None else denominator
    share = percent(unexpected, whole)
    nonmissing = None
    if same_nonmissing:
        nonmissing = share
    elif missing is not None:
        nonmissing = percent(unexpected, f"({whole} - {missing})")
    return Verdict(
        element_count=total,
        missing_count=missing,
        unexpected_count=unexpected,
        missing_percent=None if missing is None else percent(missing, whole),
        unexpected_percent=share,
        unexpected_percent_nonmissing=nonmissing,
        unexpected_percent_total=share,
        observed_value=observed,
        details=details,
        is_success=success,
    )


def all_or_nothing(
    total: str,
    success: str,
    missing: str | None = None,
    observed: str | None = None,
    details: str | None = None,
) -> Verdict:
    """A verdict about the table as a whole: 0 or 1 unexpected, 0 or 100 percent."""
    share = f"IF({success}, 0D, 100D)"
    return Verdict(
        element_count=total,
        missing_count=missing,
        unexpected_count=f"IF({success}, 0, 1)",
        missing_percent=None if missing is None else percent(missing, total),
        unexpected_percent=share,
        unexpected_percent_total=share,
        observed_value=observed,
        details=details,
        is_success=success,
    )


def result_struct(rule_config_id: int, expectation: str, verdict: Verdict) -> str:
    """The verdict as one struct, every column in its result type."""
    fields = {
        "rule_config_id": f"CAST({rule_config_id} AS BIGINT)",
        "expectation_name": literal(expectation),
    }
    for name, kind in RESULT_TYPES.items():
        fields[name] = f"CAST({getattr(verdict, name) or 'NULL'} AS {kind})"
    return struct(**fields)


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def sum_if(condition: Column, value: Column) -> Column:
    """Sum over the groups or rows where ``condition`` holds, 0 when none does."""
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))


def all_rows() -> Column:
    return F.count(F.lit(1))


def group_rows() -> Column:
    return F.col(ROWS_IN_GROUP)


def combine_single_rows(frames: list[DataFrame]) -> DataFrame:
    """One row with the columns of several one-row frames.

    Each frame fills its own columns and leaves the others NULL; the maximum of
    a column is then its only value.  One job, no join.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
