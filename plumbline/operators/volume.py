"""Row-count checks."""

from __future__ import annotations

from plumbline.functions.arithmetic import between_a, literal
from plumbline.operators.spec import ScanSpec, all_or_nothing, all_rows
from plumbline.rule import Rule, flag, number, require
from plumbline.sources.datasets import Scope


def row_count_between(scope: Scope, rule: Rule) -> ScanSpec:
    low, high = number(rule.kwargs, "min_value"), number(rule.kwargs, "max_value")
    strict = flag(rule.kwargs, "strict_min"), flag(rule.kwargs, "strict_max")

    def verdict(m):
        ok = between_a(m("total"), low, high, *strict)
        return all_or_nothing(m("total"), ok, observed=m("total"))

    return ScanSpec({"total": all_rows()}, verdict)


def row_count_equal(scope: Scope, rule: Rule) -> ScanSpec:
    require(rule.kwargs, "value")
    wanted = number(rule.kwargs, "value")

    def verdict(m):
        return all_or_nothing(m("total"), f"({m('total')} = {literal(wanted)})", observed=m("total"))

    return ScanSpec({"total": all_rows()}, verdict)
