"""Checks on a dataset's columns.  They read the schema and run no job."""

from __future__ import annotations

import json
from itertools import zip_longest

from plumbline.functions.arithmetic import between_a, literal
from plumbline.operators.spec import ScanSpec, Verdict, all_or_nothing
from plumbline.rule import Rule, RuleError, flag, name_list, number, require
from plumbline.sources.datasets import Scope


def _known(verdict: Verdict) -> ScanSpec:
    return ScanSpec({}, lambda m: verdict)


def column_exists(scope: Scope, rule: Rule) -> ScanSpec:
    """Present under the name (without case) and, if asked, at the 0-based index."""
    (wanted,) = require(rule.kwargs, "column")
    index = number(rule.kwargs, "column_index")
    names = [n.lower() for n in scope.df.columns]
    found = names.index(wanted.lower()) if wanted.lower() in names else None
    ok = found is not None and (index is None or found == index)
    return _known(all_or_nothing("1", literal(ok), observed=literal(found)))


def column_count_equal(scope: Scope, rule: Rule) -> ScanSpec:
    require(rule.kwargs, "value")
    size = len(scope.df.columns)
    ok = literal(size == number(rule.kwargs, "value"))
    return _known(all_or_nothing(str(size), ok, observed=str(size)))


def column_count_between(scope: Scope, rule: Rule) -> ScanSpec:
    low, high = number(rule.kwargs, "min_value"), number(rule.kwargs, "max_value")
    size = str(len(scope.df.columns))
    ok = between_a(size, low, high, flag(rule.kwargs, "strict_min"), flag(rule.kwargs, "strict_max"))
    return _known(all_or_nothing(size, ok, observed=size))


# Marks a column name that must match in case as well.
CASE_PREFIX = "CS:"


def columns_match_set(scope: Scope, rule: Rule) -> ScanSpec:
    wanted = name_list(rule.kwargs, "column_set")
    if not wanted:
        raise RuleError("column_set is empty")
    exact_case = {n[len(CASE_PREFIX) :] for n in wanted if n.startswith(CASE_PREFIX)}
    any_case = {n.upper() for n in wanted if not n.startswith(CASE_PREFIX)}
    actual = [n.strip() for n in scope.df.columns]
    upper = {n.upper() for n in actual}
    absent = sorted(exact_case - set(actual)) + sorted(any_case - upper)
    extra = sorted(upper - any_case - {n.upper() for n in exact_case})
    ok = not absent and (not flag(rule.kwargs, "exact_match", True) or not extra)
    total, bad = len(exact_case) + len(any_case), len(absent) + len(extra)
    return _known(_mismatches(total, bad, ok, {"missing": absent, "unexpected": extra}))


def columns_match_ordered_list(scope: Scope, rule: Rule) -> ScanSpec:
    """Position by position and in case; a position only one side has is a mismatch."""
    wanted = name_list(rule.kwargs, "column_list")
    if not wanted:
        raise RuleError("column_list is empty")
    pairs = enumerate(zip_longest(wanted, scope.df.columns), start=1)
    wrong = [{"position": i, "expected": a, "found": b} for i, (a, b) in pairs if a != b]
    return _known(_mismatches(len(wanted), len(wrong), not wrong, {"mismatches": wrong}))


def _mismatches(total: int, bad: int, ok: bool, details: dict) -> Verdict:
    share = literal(100.0 * (bad / total))
    return Verdict(
        element_count=str(total),
        unexpected_count=str(bad),
        unexpected_percent=share,
        unexpected_percent_total=share,
        details=literal(json.dumps(details)),
        is_success=literal(ok),
    )
