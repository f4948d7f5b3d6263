"""Datasets: what a rule reads, and the slice of it a run validates."""

from __future__ import annotations

import datetime
import json
from dataclasses import dataclass, field, replace
from typing import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import find_column, quoted
from plumbline.rule import RuleError


@dataclass(frozen=True)
class Dataset:
    """A registered dataset: a table, a file path or a custom query.

    ``file_schema`` is a DDL column list and ``file_options`` a JSON object of
    reader options; CSV files need the former to be read in one pass.
    """

    dataset_id: int
    dataset_name: str
    dataset_type: str = "TABLE"
    table_name: str | None = None
    path: str | None = None
    file_format: str = "parquet"
    file_schema: str | None = None
    file_options: str | None = None
    custom_sql: str | None = None
    project_id: int | None = None
    primary_key_columns: str | None = None
    candidate_key_columns: str | None = None
    is_incremental: bool = False
    incr_date_column_1: str | None = None
    incr_date_column_2: str | None = None

    def load(self, spark: SparkSession) -> DataFrame:
        kind = (self.dataset_type or "TABLE").upper()
        if kind == "QUERY":
            if not self.custom_sql:
                raise RuleError(f"dataset {self.dataset_name!r} is a QUERY without custom_sql")
            return spark.sql(self.custom_sql)
        if kind != "TABLE":
            raise RuleError(f"dataset type must be TABLE or QUERY, got {self.dataset_type!r}")
        if self.path:
            reader = spark.read.format(self.file_format)
            if self.file_options:
                reader = reader.options(**json.loads(self.file_options))
            if self.file_schema:
                reader = reader.schema(self.file_schema)
            return reader.load(self.path)
        if self.table_name:
            return spark.table(self.table_name)
        raise RuleError(f"dataset {self.dataset_name!r} names neither a table nor a path")

    def incremental_column(self) -> str | None:
        return self.incr_date_column_1 or self.incr_date_column_2

    def primary_key(self) -> list[str]:
        """Key columns from the JSON object ``{"primary_key": [...]}``."""
        if not self.primary_key_columns:
            return []
        value = json.loads(self.primary_key_columns)
        keys = value.get("primary_key", []) if isinstance(value, dict) else value
        return [str(k).strip() for k in ([keys] if isinstance(keys, str) else keys)]

    def candidate_key(self) -> list[str]:
        text = (self.candidate_key_columns or "").strip()
        if not text:
            return []
        if text.startswith("["):
            return [str(k).strip() for k in json.loads(text)]
        return [part.strip() for part in text.split(",") if part.strip()]


def since(df: DataFrame, column: str | None, watermark) -> DataFrame:
    """Rows after the watermark; all rows when there is no column or watermark.

    The comparison is against a literal of the column's own type, so it reaches
    the file scan as a pushed filter.
    """
    if column is None or watermark is None:
        return df
    name = find_column(df, column)
    literal = F.lit(str(watermark)).cast(df.schema[name].dataType)
    return df.where(F.col(quoted(name)) > literal)


class LazyFrames(Mapping):
    """Datasets by name, each loaded when a rule first asks for it.

    A dataset that can't be read fails the rules that name it, and only those.
    """

    def __init__(self, loaders: Mapping[str, Callable[[], DataFrame]]):
        self._loaders = dict(loaders)
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._loaders[name]()
        return self._frames[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._loaders)

    def __len__(self) -> int:
        return len(self._loaders)


@dataclass(frozen=True)
class Scope:
    """Everything a check may look at while it compiles.

    ``df`` holds the rows to validate, ``full`` the whole dataset (they differ
    in an incremental run).  ``lookup`` resolves other datasets by name and
    ``watermarks`` the reconciliation marks of earlier runs by rule id.
    """

    df: DataFrame
    full: DataFrame | None = None
    name: str = "dataset"
    table_name: str | None = None
    primary_key: tuple[str, ...] = ()
    candidate_key: tuple[str, ...] = ()
    now: datetime.datetime | None = None
    others: Mapping[str, DataFrame] = field(default_factory=dict)
    watermarks: Mapping[int, tuple] = field(default_factory=dict)
    resolve: Callable[[str], DataFrame] | None = None

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def whole(self) -> DataFrame:
        return self.df if self.full is None else self.full

    def lookup(self, name: str) -> DataFrame:
        """Another dataset by registered name (without case), else a catalog table."""
        for key in self.others:
            if key.lower() == name.lower():
                return self.others[key]
        if name.lower() == self.name.lower():
            return self.whole
        if self.resolve is not None:
            found = self.resolve(name)
            if found is not None:
                return found
        try:
            return self.spark.table(name)
        except Exception as exc:
            raise RuleError(f"dataset {name!r} not found") from exc

    def narrowed(self, column: str | None, watermark) -> "Scope":
        """The same scope over the rows after ``watermark``."""
        return replace(self, df=since(self.df, column, watermark), full=self.whole)
