"""Joins and windows on keys of which a few may hold much of the data.

Nothing here runs a job while a plan is made, but for the long-text path that a
rule asks for by ``by_hash``.  Groups are counted with partial aggregation, so
a hot key sends one row per task; their rows are found by a semi join, which
adaptive execution broadcasts or splits by measured sizes; rows are ranked
within parts of a group before the parts' firsts are compared.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import is_text, quoted
from plumbline.operators.spec import ROWS_IN_GROUP

BROADCAST_BYTES = 64 * 1024 * 1024
# Parts that a group's rows are ranked in.
PARTS = 32

HASH = "__key_hash"
SALT = "__salt"
RANK = "__rank"


def group_counts(df: DataFrame, keys: list[str] | tuple[str, ...]) -> DataFrame:
    """Rows per key.  Partial aggregation reduces a hot key before the shuffle."""
    return df.groupBy(*[F.col(quoted(k)) for k in keys]).agg(F.count(F.lit(1)).alias(ROWS_IN_GROUP))


def settled(frame: DataFrame) -> DataFrame:
    """The frame written to the session's checkpoint folder, when it has one.

    Used for a result that later jobs read again.  Without a folder the frame
    is returned as it is and recomputed.
    """
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            return frame
        context.setCheckpointDir(folder)
    return frame.checkpoint()


def bytes_of(frame: DataFrame, columns: list[str]) -> int:
    """Size of a frame's rows in memory, from their number and their text."""
    texts = [
        F.coalesce(F.octet_length(F.col(quoted(c))), F.lit(0))
        for c in columns
        if is_text(frame.schema[c].dataType)
    ]
    text = F.sum(reduce(add, texts)) if texts else F.lit(0)
    row = frame.agg(F.count(F.lit(1)).alias("rows"), text.cast("bigint").alias("text")).first()
    return row["rows"] * (32 + 16 * len(columns)) + (row["text"] or 0)


def rows_of_groups(df: DataFrame, keys: list[str], selected: Column) -> DataFrame:
    """All rows of the groups for which ``selected`` holds (keys compare null-safely).

    A plain semi join: adaptive execution broadcasts the group keys when their
    shuffled size is small, and splits the rows of a hot key otherwise.
    """
    names = [f"__g{i}" for i in range(len(keys))]
    renamed = [F.col(quoted(k)).alias(n) for k, n in zip(keys, names)]
    wanted = group_counts(df, keys).where(selected).select(*renamed)
    condition = reduce(and_, [df[quoted(k)].eqNullSafe(wanted[n]) for k, n in zip(keys, names)])
    return df.join(wanted, condition, "left_semi")


def _hashable(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.MapType):
        return False
    if isinstance(data_type, T.ArrayType):
        return _hashable(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return all(_hashable(f.dataType) for f in data_type.fields)
    return not isinstance(data_type, T.VariantType)


def _salt(df: DataFrame) -> Column:
    """A part from the row's content and its partition, so that exact copies of a row spread too."""
    content = [F.col(quoted(f.name)) for f in df.schema.fields if _hashable(f.dataType)]
    return F.pmod(F.xxhash64(*content) + F.spark_partition_id(), F.lit(PARTS)).cast("int")


def rows_beyond_first(df: DataFrame, keys: list[str], selected: Column, order: list[Column]) -> DataFrame:
    """Every row of the selected groups but the first in ``order``.

    Rows are ranked within ``PARTS`` parts of their group.  Those beyond a
    part's first are none of the group's firsts; the parts' first rows are
    ranked once more among themselves, the others staying spread as they are.
    """
    columns = [F.col(quoted(k)) for k in keys]
    rows = rows_of_groups(df, keys, selected)
    rows = rows.withColumn(SALT, _salt(rows))
    within = Window.partitionBy(*columns, SALT).orderBy(*order)
    rows = rows.withColumn(RANK, F.row_number().over(within))
    rows = rows.withColumn(SALT, F.when(F.col(RANK) == 1, F.lit(-1)).otherwise(F.col(SALT)))
    among = Window.partitionBy(*columns, SALT).orderBy(*order)
    rows = rows.withColumn("__first", (F.col(RANK) == 1) & (F.row_number().over(among) == 1))
    return rows.where(~F.col("__first")).drop(SALT, RANK, "__first")


def repeated_hashes(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows per 64-bit hash of a column, and the hashes seen more than once.

    Only 16 bytes per row are shuffled.  Equal values have equal hashes, so a
    value whose hash is seen once is unique.
    """
    hashes = settled(
        df.groupBy(F.xxhash64(F.col(quoted(name))).alias(HASH)).agg(F.count(F.lit(1)).alias(ROWS_IN_GROUP))
    )
    return hashes, hashes.where(F.col(ROWS_IN_GROUP) > 1).select(HASH)


def possibly_repeated(df: DataFrame, name: str, repeated: DataFrame) -> DataFrame | None:
    """Rows whose value may occur again; None when too many hashes repeat.

    The caller then groups by the values themselves.
    """
    if bytes_of(repeated, [HASH]) > BROADCAST_BYTES:
        return None
    hashed = F.xxhash64(F.col(quoted(name))) == F.col(HASH)
    return df.join(F.broadcast(repeated), hashed, "left_semi")
