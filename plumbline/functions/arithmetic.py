"""Verdict arithmetic, written once so that every check agrees to the bit.

Verdicts are SQL text over named measures: the verdicts of all rules then go
to Spark as one expression, however many rules there are.
"""

from __future__ import annotations


def literal(value) -> str:
    """A number, boolean, text or NULL as SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def fraction(part: str, whole: str) -> str:
    """``part / whole`` in doubles, 0 for an empty whole."""
    return f"(CASE WHEN {whole} = 0 THEN 0D ELSE CAST({part} AS DOUBLE) / {whole} END)"


def percent(part: str, whole: str) -> str:
    return f"({fraction(part, whole)} * 100)"


def mostly_at_most(share: str, mostly: float) -> str:
    """Gate on the failing share: passes when it is at most ``1 - mostly``."""
    return f"({share} <= {literal(1.0 - mostly)})"


def mostly_at_least(share: str, mostly: float) -> str:
    """The same gate in the form ``1 - share >= mostly`` (differs in the last ulp)."""
    return f"(1D - {share} >= {literal(float(mostly))})"


def between_a(observed: str, low, high, strict_low: bool, strict_high: bool) -> str:
    """Bounds on a count or a proportion; an absent bound is open."""
    tests = ["true"]
    if low is not None:
        tests.append(f"{observed} {'>' if strict_low else '>='} {literal(low)}")
    if high is not None:
        tests.append(f"{observed} {'<' if strict_high else '<='} {literal(high)}")
    return "(" + " AND ".join(tests) + ")"


def between_b(observed: str, low, high, strict_low: bool, strict_high: bool) -> str:
    """Bounds on a statistic: as ``between_a``, and a NULL statistic fails."""
    bounds = between_a(observed, low, high, strict_low, strict_high)
    return f"({observed} IS NOT NULL AND coalesce({bounds}, false))"


def json_object(**fields: str) -> str:
    """JSON text of named expressions."""
    return f"to_json({struct(**fields)})"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
