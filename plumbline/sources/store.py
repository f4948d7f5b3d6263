"""Metadata and result tables of the framework.

Plain catalog tables in parquet, append-only.  Result tables are partitioned
by the day of their timestamp, so retention drops partitions instead of
rewriting data; within a partition rows are sorted by dataset and run, which
keeps min/max pruning effective for the usual lookups.
"""

from __future__ import annotations

import datetime
import random
import re
import threading
import time
from collections import defaultdict
from typing import Any, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.local import small_frame

DAY = "event_date"

# Column lists of the tables, misspelt names included.
# ``event_date`` is added to the dated ones.
TABLES = {
    "projects": "project_id bigint, bu_name string, app_name string, project_name string, "
    "project_desc string, created_by string, created_timestamp timestamp_ntz",
    "dataset": "dataset_id bigint, project_id bigint, dataset_type string, dataset_name string, "
    "table_name string, path string, file_format string, file_schema string, file_options string, "
    "custom_sql string, "
    "primary_key_columns string, candidate_key_columns string, is_incremental boolean, "
    "incr_date_column_1 string, incr_date_column_2 string, created_by string, "
    "created_timestamp timestamp_ntz",
    "rule_config": "rule_config_id bigint, expectation_id bigint, dataset_id bigint, "
    "expectation_name string, expectation_type string, kwargs string, dimension string, "
    "column_name string, rule_description string, check_type string, severity string, "
    "dq_engine string, is_active boolean, error_flag boolean, created_by string, "
    "created_timestamp timestamp_ntz",
    "rule_results": "batch_id bigint, dataset_run_id bigint, dataset_id bigint, "
    "rule_config_id bigint, expectation_id bigint, run_name string, run_timestamp timestamp_ntz, "
    "dataset_name string, expectation_config string, is_success boolean, results string, "
    "expectation_name string, details string, element_count bigint, missing_count bigint, "
    "missing_percent double, observed_value string, partial_unexpected_counts string, "
    "partial_unexpected_index_list string, partial_unexpected_list string, "
    "unexpected_count bigint, unexpected_percent double, unexpected_percent_nonmissing double, "
    "unexpected_percent_total double, unexpected_rows string, data_rows string, user string, "
    "dimension string, failed_rows string, session_id string",
    "failed_row_keys": "dataset_run_id bigint, rule_config_id bigint, dataset_id bigint, "
    "table_name string, failed_key string, load_timestamp timestamp_ntz",
    "recon_results": "dataset_run_id bigint, dataset_id bigint, rule_config_id bigint, "
    "layer string, data_source string, table_name string, validation_on string, "
    "src_value string, core_value string, conformed_value string, consumption_value string, "
    "result string, validation_logic string, audit_timestamp timestamp_ntz",
    "rule_audit_log": "dataset_run_id bigint, rule_config_id bigint, procedure_name string, "
    "step_name string, log_message string, start_timestamp timestamp_ntz, "
    "end_timestamp timestamp_ntz, status string, error_message string",
    "dataset_run_log": "dataset_run_id bigint, batch_id bigint, dataset_id bigint, "
    "run_time double, evaluated_expectations bigint, successfull_expectations bigint, "
    "unsuccessfull_expectations bigint, error_expectations bigint, run_status string, "
    "created_by string, success_percent double, created_timestamp timestamp_ntz, "
    "max_validated_timestamp timestamp_ntz, source_sql string, failure_view string, "
    "run_scope string",
    "value_lists": "dataset_run_id bigint, dataset_id bigint, rule_config_id bigint, kind string, "
    "value string, rows bigint, listed_timestamp timestamp_ntz",
    "run_state": "state string, dataset_id bigint",
    "project_run_log": "batch_id bigint, project_id bigint, datasets_total bigint, "
    "datasets_run bigint, datasets_skipped bigint, passed bigint, failed bigint, "
    "errored bigint, run_status string, success_percent double, run_time double, "
    "created_by string, created_timestamp timestamp_ntz",
}

# Timestamp column of every dated table.
TIMESTAMPS = {
    "rule_results": "run_timestamp",
    "failed_row_keys": "load_timestamp",
    "recon_results": "audit_timestamp",
    "rule_audit_log": "start_timestamp",
    "dataset_run_log": "created_timestamp",
    "project_run_log": "created_timestamp",
    "value_lists": "listed_timestamp",
}

# Days to keep.
RETENTION_DAYS = {
    "rule_audit_log": 90,
    "failed_row_keys": 30,
    "rule_results": 180,
    "dataset_run_log": 180,
    "recon_results": 90,
    "value_lists": 180,
}

# Partitions that one statement drops.
DROPPED_AT_ONCE = 500

# Spark's file committer shares one staging folder per table, so a process writes
# to a table with one job at a time.
_WRITES: defaultdict[str, threading.RLock] = defaultdict(threading.RLock)

_IDS = threading.Lock()
_last_id = 0


def new_id() -> int:
    """An id that no other run has: microseconds since 1970, then ten random bits.

    Ids of one process ascend; those of two processes differ but for a chance
    of one in a thousand within the same microsecond.
    """
    global _last_id
    with _IDS:
        _last_id = max(_last_id + 1, (time.time_ns() // 1000 << 10) | random.SystemRandom().getrandbits(10))
        return _last_id


def cutoff_literal(moment: datetime.datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def failure_table_name(dataset_name: str) -> str:
    """The view with one row for each failing row and rule."""
    return re.sub(r"[^a-zA-Z0-9]", "_", dataset_name).lower() + "_dq_failure"


# Rule id -> number of the dataset's rows that a stored failing row stands for.
FAILED_RULES = "failed_rules"
STORED = "_rows"
# Copies are unfolded in two steps, each of arrays that fit a task.
COPIES = 1_000_000


def stored_table_name(failure_table: str) -> str:
    """The table behind the view: each distinct failing row of a run once."""
    return failure_table + STORED


def _deleted(table: str, keep: int, rows: int) -> dict[str, Any]:
    return {"table": table, "retention_days": keep, "rows_deleted": rows, "status": "SUCCESS"}


class Store:
    """The tables of one database of the session's catalog.

    ``location`` is where a new database keeps its files: a folder that all
    machines share.  Without it the session's warehouse decides.
    """

    def __init__(self, spark: SparkSession, database: str = "dq", location: str | None = None):
        self.spark = spark
        self.database = database
        self.location = location

    def create(self) -> "Store":
        at = "" if self.location is None else " LOCATION '{}'".format(self.location.replace("'", "\\'"))
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.database}`{at}")
        for table, columns in TABLES.items():
            dated = table in TIMESTAMPS
            columns += f", {DAY} date" if dated else ""
            by = f" PARTITIONED BY ({DAY})" if dated else ""
            by = " PARTITIONED BY (dataset_id)" if table == "run_state" else by
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name(table)} ({columns}) USING parquet{by}")
        return self

    def name(self, table: str) -> str:
        return f"`{self.database}`.`{table}`"

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(f"{self.database}.{table}")

    def read(self, table: str) -> DataFrame:
        frame = self.spark.table(self.name(table))
        return frame.drop(DAY) if table in TIMESTAMPS else frame

    def append(self, table: str, rows: DataFrame, one_day: bool = False) -> None:
        """Append a frame, filling columns it does not have with NULL.

        Rows of many days meet by day first, so the number of files follows the
        days and the bytes, not the tasks times the days; a day of many rows is
        split.  Rows of ``one_day`` are written where they are.
        """
        fields = T.StructType.fromDDL(TABLES[table]).fields
        have = {c.lower() for c in rows.columns}
        if table in TIMESTAMPS:
            known = [f for f in fields if f.name in have]
            rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in known])
            stamp = F.col(TIMESTAMPS[table]) if TIMESTAMPS[table] in have else F.lit(None)
            rows = rows.withColumn(DAY, F.to_date(stamp))
            rows = rows if one_day else rows.hint("rebalance", DAY)
            order = [c for c in ("dataset_id", "dataset_run_id", "rule_config_id") if c in have]
            rows = rows.sortWithinPartitions(DAY, *order)
        columns = [
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields
        ]
        rows = rows.select(*columns, *([DAY] if table in TIMESTAMPS else []))
        with _WRITES[self.name(table)]:
            rows.write.mode("append").insertInto(self.name(table))

    def append_rows(self, table: str, rows: Iterable[dict[str, Any]]) -> None:
        """Append a few rows made on the driver: one per rule or per step."""
        rows = list(rows)
        if not rows:
            return
        schema = T.StructType.fromDDL(TABLES[table])
        data = [tuple(row.get(f.name) for f in schema.fields) for row in rows]
        self.append(table, small_frame(self.spark, data, schema).coalesce(1), one_day=True)

    def replace_state(self, dataset_id: int, state: str) -> None:
        """Put a dataset's state in place of the one before."""
        row = small_frame(self.spark, [(state, dataset_id)], TABLES["run_state"]).coalesce(1)
        with _WRITES[self.name("run_state")]:
            row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").insertInto(self.name("run_state"))

    def discard_run(self, run_id: int, failure_table: str) -> None:
        """Remove what an unfinished run has left, so that it can be repeated under its id."""
        for table in ("rule_results", "failed_row_keys", "recon_results", "rule_audit_log", "value_lists"):
            frame = self.spark.table(self.name(table))
            mine = F.col("dataset_run_id") == run_id
            for row in frame.where(mine).select(DAY).distinct().collect():
                day = F.col(DAY) == F.lit(row[DAY])
                rest = frame.where(day & ~F.coalesce(mine, F.lit(False)))
                if rest.isEmpty():
                    self._drop_days(table, [row[DAY]])
                else:
                    self._replace_day(table, rest)
        stored = stored_table_name(failure_table)
        if self.exists(stored):
            rows = self.spark.table(self.name(stored)).where(F.col("dataset_run_id") == run_id)
            for row in rows.select(DAY).distinct().collect():
                self._drop_run(stored, row[DAY], run_id)
        self.unstage(run_id)

    def _staged(self, run_id: int) -> str:
        return f"staged_{run_id}"

    def stage(self, run_id: int, rows: DataFrame) -> None:
        """Keep rows until the run has stored what it needs of them."""
        rows.write.mode("overwrite").format("parquet").saveAsTable(self.name(self._staged(run_id)))

    def staged(self, run_id: int) -> DataFrame:
        return self.spark.table(self.name(self._staged(run_id)))

    def unstage(self, run_id: int) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name(self._staged(run_id))}")

    def append_failures(self, table: str, rows: DataFrame) -> None:
        """Append stored failing rows, one directory a day and run, and offer them as a view.

        ``rows`` has ``dataset_run_id``, ``dataset_id``, ``dq_load_timestamp``,
        the dataset's columns, ``query_columns`` and ``failed_rules``.
        """
        stored = stored_table_name(table)
        with _WRITES[self.name(stored)]:
            (
                rows.withColumn(DAY, F.to_date("dq_load_timestamp"))
                .write.mode("append")
                .format("parquet")
                .partitionBy(DAY, "dataset_run_id")
                .saveAsTable(self.name(stored))
            )
            if not self.exists(table):
                self.spark.sql(f"CREATE VIEW {self.name(table)} AS {self._unfolded(stored)}")

    def failing_rows(self, table: str, run_id: int) -> DataFrame:
        """The stored failing rows of a run."""
        return self.spark.table(self.name(stored_table_name(table))).where(F.col("dataset_run_id") == run_id)

    def _unfolded(self, stored: str) -> str:
        """A row for each failing row and rule, copies included."""
        audit = ("dataset_run_id", "dataset_id", "rule_config_id", "dq_load_timestamp")
        names = self.spark.table(self.name(stored)).columns
        rest = [f"`{n.replace('`', '``')}`" for n in names if n not in (*audit, DAY, FAILED_RULES)]
        shown = ", ".join([*audit, *rest])
        kept = ", ".join([*[a for a in audit if a != "rule_config_id"], *rest])
        return (
            f"SELECT {shown} FROM (SELECT *, explode(sequence(1L, least(__left, {COPIES}L))) AS __copy FROM ("
            f"SELECT *, explode(transform(sequence(0L, (__n - 1) DIV {COPIES}L), k -> __n - k * {COPIES}L)) AS __left FROM ("
            f"SELECT {kept}, explode({FAILED_RULES}) AS (rule_config_id, __n) FROM {self.name(stored)})))"
        )

    def clean_up(
        self,
        now: datetime.datetime,
        days: dict[str, int] | None = None,
    ) -> list[dict[str, Any]]:
        """Delete rows older than each table's retention; returns what was deleted.

        Whole expired days are dropped as partitions.  Of the day the cutoff
        falls into, only the younger rows are written back.
        """
        report = []
        for table, keep in (days or RETENTION_DAYS).items():
            cutoff = now - datetime.timedelta(days=keep)
            stamp = F.col(TIMESTAMPS[table])
            limit = cutoff_literal(cutoff)
            day = F.lit(cutoff.date().isoformat()).cast("date")
            frame = self.spark.table(self.name(table))
            young = stamp >= limit
            days_told = frame.where(F.col(DAY) <= day).groupBy(DAY).agg(
                F.count_if(stamp < limit).alias("old"), F.count_if(young).alias("young")
            ).collect()
            today = next((r for r in days_told if r[DAY] == cutoff.date()), None)
            if today and today["old"] and today["young"]:
                self._replace_day(table, frame.where((F.col(DAY) == day) & young))
            self._drop_days(
                table, [r[DAY] for r in days_told if r[DAY] < cutoff.date() or (r["old"] and not r["young"])]
            )
            report.append(_deleted(table, keep, sum(r["old"] for r in days_told)))
        return report + self._clean_failures(now, (days or RETENTION_DAYS).get("failed_row_keys"))

    def _clean_failures(self, now: datetime.datetime, keep: int | None) -> list[dict[str, Any]]:
        """Drop the failing rows of runs whose keys have expired; a run's rows share one timestamp."""
        report = []
        for table in self._stored_tables() if keep is not None else ():
            limit = cutoff_literal(now - datetime.timedelta(days=keep))
            runs = self.spark.table(self.name(table)).where(F.col("dq_load_timestamp") < limit)
            expired = runs.groupBy(DAY, "dataset_run_id").agg(F.count(F.lit(1)).alias("n")).collect()
            for row in expired:
                self._drop_run(table, row[DAY], row["dataset_run_id"])
            report.append(_deleted(table, keep, sum(r["n"] for r in expired)))
        return report

    def _stored_tables(self) -> list[str]:
        found = self.spark.sql(f"SHOW TABLES IN `{self.database}`").collect()
        return sorted(r["tableName"] for r in found if r["tableName"].endswith("_dq_failure" + STORED))

    def _drop_days(self, table: str, days: list[datetime.date]) -> None:
        for first in range(0, len(days), DROPPED_AT_ONCE):
            parts = ", ".join(f"PARTITION ({DAY} = DATE'{d}')" for d in days[first : first + DROPPED_AT_ONCE])
            self.spark.sql(f"ALTER TABLE {self.name(table)} DROP IF EXISTS {parts}")

    def _drop_run(self, table: str, day: datetime.date, run_id: int) -> None:
        self.spark.sql(
            f"ALTER TABLE {self.name(table)} DROP IF EXISTS PARTITION ({DAY} = DATE'{day}', dataset_run_id = {run_id})"
        )

    def _replace_day(self, table: str, rows: DataFrame) -> None:
        """Overwrite only the partition the rows belong to."""
        with _WRITES[self.name(table)]:
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").insertInto(
                self.name(table)
            )
