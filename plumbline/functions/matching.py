"""Pattern and set membership expressions."""

from __future__ import annotations

import datetime
import decimal
import math
from typing import Any, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import is_text
from plumbline.rule import RuleError

# Above this many values a membership test becomes a join with the value set.
INLINE_VALUES = 1000


def full_match(text: Column, pattern: str) -> Column:
    """True when the whole text matches; ``rlike`` alone would search inside it."""
    return text.rlike(rf"\A(?:{pattern})\z")


def as_text(value: Any) -> str | None:
    """A JSON value as the text it is compared as."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def to_column_type(values: Iterable[Any], data_type: T.DataType) -> list[Any]:
    """JSON values read as the column's type, once each; unreadable ones drop out.

    A value that cannot be read as the column's type equals no column value,
    so dropping it changes no membership test.
    """
    out: dict[Any, None] = {}
    for value in values:
        typed = _read(value, data_type)
        if typed is not None:
            out[typed] = None
    return list(out)


def _read(value: Any, data_type: T.DataType):
    text = as_text(value)
    if text is None:
        return None
    if is_text(data_type):
        return text
    try:
        if isinstance(data_type, T.IntegralType):
            exact = decimal.Decimal(text.strip())
            return int(exact) if exact == exact.to_integral_value() else None
        if isinstance(data_type, T.DecimalType):
            return decimal.Decimal(text.strip())
        if isinstance(data_type, T.FractionalType):
            number = float(text)
            return None if math.isnan(number) else number
        if isinstance(data_type, T.BooleanType):
            return {"true": True, "false": False}.get(text.strip().lower())
        if isinstance(data_type, T.DateType):
            return datetime.date.fromisoformat(text.strip())
        if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
            return datetime.datetime.fromisoformat(text.strip())
    except (ValueError, decimal.InvalidOperation, OverflowError):
        return None
    raise RuleError(f"no value set for a {data_type.simpleString()} column")


def literal(value: Any, data_type: T.DataType) -> Column:
    """A typed literal; date and time values go through text to keep their type."""
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(str(value)).cast(data_type)
    return F.lit(value)


def members(column: Column, values: list[Any], data_type: T.DataType) -> Column:
    """Inline membership for a short value set already in the column's type."""
    if not values:
        return F.lit(False)
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return column.isin([literal(v, data_type) for v in values])
    return column.isin(values)
