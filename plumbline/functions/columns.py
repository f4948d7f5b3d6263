"""Column expressions shared by the checks."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.rule import RuleError


def quoted(name: str) -> str:
    """Backtick-quoted name, so dots and blanks in names stay literal."""
    return "`" + name.replace("`", "``") + "`"


def find_column(df: DataFrame, name: str | None) -> str:
    """The actual name of a column: an exact match first, then without case."""
    if not name:
        raise RuleError("no column given")
    names = df.columns
    if name in names:
        return name
    matches = [n for n in names if n.lower() == name.lower()]
    if len(matches) == 1:
        return matches[0]
    if matches:
        raise RuleError(f"column {name!r} is ambiguous: {matches}")
    raise RuleError(f"column {name!r} does not exist")


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def blank(column: Column) -> Column:
    """NULL, or nothing but spaces."""
    return column.isNull() | (F.trim(column.cast("string")) == "")


def missing(column: Column, data_type: T.DataType) -> Column:
    """``blank`` without the string cast where the type can never be blank."""
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return blank(column)
    return column.isNull()


def false_if_null(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.CharType, T.VarcharType))


def as_double(column: Column, data_type: T.DataType) -> Column:
    """Numeric reading of a column; text that is no number becomes NULL."""
    if isinstance(data_type, T.NumericType):
        return column.cast("double")
    if is_text(data_type):
        return column.try_cast("double")
    if isinstance(data_type, T.BooleanType):
        return column.cast("int").cast("double")
    raise RuleError(f"a {data_type.simpleString()} column has no numeric reading")


def comparable(column: Column, data_type: T.DataType) -> Column:
    """The column as the value ordered comparisons use."""
    return column.try_cast("double") if is_text(data_type) else column


def bound(value, data_type: T.DataType) -> Column:
    """A bound as a literal that compares with a column of ``data_type``."""
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(str(value)).cast(data_type)
    if isinstance(value, str):
        try:
            value = int(value)
        except ValueError:
            try:
                value = float(value)
            except ValueError as exc:
                raise RuleError(f"{value!r} is not a number") from exc
    return F.lit(value)


# Words that name the two ways of ignoring a row; anything else ignores none.
IGNORE_ANY = {"any", "either", "any_value_is_missing", "either_value_is_missing"}
IGNORE_ALL = {"all", "both", "all_values_are_missing", "both_values_are_missing"}
IGNORE_NONE = {"never", "neither"}


def ignore_rows(columns: list[Column], mode: str | None, default: str, unknown: str = "never") -> Column:
    """True for rows a check leaves out because of NULLs in its columns."""
    word = (mode or default).strip().lower()
    if word not in IGNORE_ANY | IGNORE_ALL | IGNORE_NONE:
        word = unknown
    nulls = [c.isNull() for c in columns]
    if word in IGNORE_ANY:
        return reduce(or_, nulls)
    if word in IGNORE_ALL:
        return reduce(and_, nulls)
    return F.lit(False)
