"""Membership in a value set of any size.

A short set is an inline ``IN``.  A longer one is joined: the set becomes a
small frame of distinct values, and every row keeps its place with a flag
telling whether its value was found.
"""

from __future__ import annotations

from functools import reduce
from itertools import count
from operator import and_, or_
from typing import Any, Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.local import small_frame
from plumbline.functions.matching import INLINE_VALUES, literal, members

# A joined value set is broadcast up to this size and shuffled beyond it.
BROADCAST_BYTES = 64 * 1024 * 1024

_serial = count()


def _size(rows: list[tuple]) -> int:
    return sum(len(str(v)) + 16 for row in rows for v in row)


def _set_frame(df: DataFrame, rows: list[tuple], types: list[T.DataType], names: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, types)])
    frame = small_frame(df.sparkSession, rows, schema)
    return F.broadcast(frame) if _size(rows) <= BROADCAST_BYTES else frame


def member_test(
    value: Column, values: list[Any], data_type: T.DataType
) -> tuple[Column, Callable[[DataFrame], DataFrame] | None]:
    """A membership column and, for a long set, the step that provides it."""
    if len(values) <= INLINE_VALUES:
        return members(value, values, data_type), None
    flag = f"__member{next(_serial)}"
    key = f"{flag}_value"

    def prepare(df: DataFrame) -> DataFrame:
        found = _set_frame(df, [(v,) for v in values], [data_type], [key])
        return (
            df.join(found, value == F.col(key), "left")
            .withColumn(flag, F.col(key).isNotNull())
            .drop(key)
        )

    return F.col(flag), prepare


def pair_test(
    first: Column,
    second: Column,
    pairs: list[tuple[Any, Any]],
    types: tuple[T.DataType, T.DataType],
) -> tuple[Column, Callable[[DataFrame], DataFrame] | None]:
    """Null-safe membership of a pair of columns in a list of pairs."""
    pairs = list(dict.fromkeys(pairs))
    if len(pairs) <= INLINE_VALUES:
        tests = [
            reduce(
                and_,
                [
                    c.isNull() if v is None else c.eqNullSafe(literal(v, t))
                    for c, v, t in zip((first, second), pair, types)
                ],
            )
            for pair in pairs
        ]
        return (reduce(or_, tests) if tests else F.lit(False)), None
    flag = f"__pair{next(_serial)}"

    def prepare(df: DataFrame) -> DataFrame:
        names = [f"{flag}_a", f"{flag}_b"]
        rows = [(a, b) for a, b in pairs]
        found = _set_frame(df, rows, list(types), names).withColumn(f"{flag}_hit", F.lit(True))
        condition = first.eqNullSafe(F.col(names[0])) & second.eqNullSafe(F.col(names[1]))
        return (
            df.join(found, condition, "left")
            .withColumn(flag, F.coalesce(F.col(f"{flag}_hit"), F.lit(False)))
            .drop(*names, f"{flag}_hit")
        )

    return F.col(flag), prepare
