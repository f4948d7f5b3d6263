"""Small frames made from driver-side values."""

from __future__ import annotations

from typing import Any, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def small_frame(spark: SparkSession, rows: Iterable[tuple], schema: str | T.StructType) -> DataFrame:
    """A frame from a few rows.

    Passed on as Arrow, it becomes a local relation: its size is known to the
    optimizer and no Python worker is needed to read it.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    rows = list(rows)
    columns: list[list[Any]] = [[row[i] for row in rows] for i in range(len(schema.fields))]
    arrays = [pa.array(c, type=to_arrow_type(f.dataType)) for c, f in zip(columns, schema.fields)]
    table = pa.Table.from_arrays(arrays, names=schema.names)
    return spark.createDataFrame(table, schema=schema)
