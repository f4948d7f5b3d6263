"""Does a column hold values of a given type?

The declared type decides first: equal types pass, conversions that always
work pass, conversions that never make sense fail every row.  Only text is
looked at value by value.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.arithmetic import fraction, mostly_at_most
from plumbline.functions.columns import blank, false_if_null, find_column, is_text, quoted, type_of
from plumbline.operators.spec import ScanSpec, all_rows, count_if, counted
from plumbline.rule import Rule, RuleError, mostly, require
from plumbline.sources.datasets import Scope

# Type names a rule may use, by family, with the Spark type text is cast to.
TYPE_FAMILIES = {
    "number": {
        "NUMBER": "decimal(38,0)",
        "DECIMAL": "decimal(38,0)",
        "NUMERIC": "decimal(38,0)",
        "INT": "decimal(38,0)",
        "INTEGER": "decimal(38,0)",
        "BIGINT": "decimal(38,0)",
        "LONG": "decimal(38,0)",
        "FLOAT": "double",
        "DOUBLE": "double",
    },
    "date": {
        "DATE": "date",
        "TIMESTAMP": "timestamp_ntz",
        "TIMESTAMP_NTZ": "timestamp_ntz",
        "TIMESTAMP_LTZ": "timestamp",
        "TIMESTAMP_TZ": "timestamp",
        "TIME": "time",
    },
    "boolean": {"BOOLEAN": "boolean"},
    "text": {"VARCHAR": "string", "STRING": "string", "TEXT": "string", "CHAR": "string"},
}


CLOCK = r"\A\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\z"


def _fits(column, declared: T.DataType, target: str):
    """Whether a value of the column can be read as the type.

    A time of day is text like ``23:59`` or ``23:59:59.5``, or any timestamp; a date holds none.
    """
    if target != "time":
        text = F.trim(column) if is_text(declared) else column
        return text.try_cast(target).isNotNull()
    if is_text(declared):
        text = F.trim(column)
        return text.rlike(CLOCK) & F.concat(F.lit("1970-01-01 "), text).try_cast("timestamp_ntz").isNotNull()
    return F.lit(isinstance(declared, (T.TimestampType, T.TimestampNTZType)))


def _declared(data_type: T.DataType) -> tuple[str, tuple[str, ...]]:
    """Family of a column type and the rule type names that are the same type."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "number", ("FLOAT", "DOUBLE")
    if isinstance(data_type, T.NumericType):
        whole = ("NUMBER", "DECIMAL", "NUMERIC", "INT", "INTEGER", "BIGINT", "LONG")
        return "number", whole
    if isinstance(data_type, T.DateType):
        return "date", ("DATE",)
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return "date", ("TIMESTAMP", "TIMESTAMP_NTZ", "TIMESTAMP_LTZ", "TIMESTAMP_TZ")
    if isinstance(data_type, T.BooleanType):
        return "boolean", ("BOOLEAN",)
    if is_text(data_type):
        return "text", ("VARCHAR", "STRING", "TEXT", "CHAR")
    return "other", ()


def values_of_type(scope: Scope, rule: Rule) -> ScanSpec:
    name = find_column(scope.df, rule.kwargs.get("column") or rule.column_name)
    (wanted,) = require(rule.kwargs, "type_")
    wanted = str(wanted).strip().upper().split("(")[0]
    family = next((f for f, names in TYPE_FAMILIES.items() if wanted in names), None)
    if family is None:
        raise RuleError(f"unknown type {wanted!r}")
    column = F.col(quoted(name))
    kind = type_of(scope.df, name)
    declared, same = _declared(kind)

    if wanted in same or family == "text":
        absent, bad = F.lit(False), F.lit(False)
    elif declared == "text":
        absent = blank(column)
        bad = false_if_null(~absent & ~_fits(column, kind, TYPE_FAMILIES[family][wanted]))
    elif declared == family:
        # Within a family only a value that does not fit is wrong.
        absent = column.isNull()
        bad = false_if_null(~absent & ~_fits(column, kind, TYPE_FAMILIES[family][wanted]))
    else:
        absent, bad = F.lit(False), F.lit(True)
    allowed = mostly(rule.kwargs)

    def verdict(m):
        success = mostly_at_most(fraction(m("bad"), m("total")), allowed)
        if declared != "text" and declared != family and family != "text":
            success = "false"
        return counted(m("total"), m("bad"), success, missing=m("missing"))

    measures = {"total": all_rows(), "missing": count_if(absent), "bad": count_if(bad)}
    return ScanSpec(measures, verdict, failing=bad, profile=name)
