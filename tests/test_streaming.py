"""Validation of a file stream, batch by batch."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.plans.rules import register_dataset, register_rules
from plumbline.rule import Rule
from plumbline.sources.datasets import Dataset
from plumbline.sources.store import Store
from plumbline.streaming import validate_stream

NOW = datetime.datetime(2026, 1, 1)


def test_each_row_is_validated_once(spark, store, tmp_path):
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    register_dataset(store, Dataset(1, "arrivals", path=path), now=NOW)
    rule = Rule(1, "expect_column_values_to_be_between", {"column": "v", "min_value": 0, "max_value": 9}, dataset_id=1)
    register_rules(store, [rule], now=NOW)
    for rows in ([(1,), (20,)], [(3,), (30,), (40,)]):
        spark.createDataFrame(rows, "v int").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema("v int").parquet(path)
        validate_stream(stream, store, 1, checkpoint).awaitTermination()
    results = store.read("rule_results").orderBy("dataset_run_id").collect()
    assert [(r["element_count"], r["unexpected_count"]) for r in results] == [(2, 1), (3, 2)]
    failures = spark.table(store.name("arrivals_dq_failure"))
    assert sorted(r["v"] for r in failures.select("v").collect()) == [20, 30, 40]
    assert store.read("dataset_run_log").where(F.col("run_status") == "FAILURE").count() == 2


RULE = Rule(1, "expect_column_values_to_be_between", {"column": "v", "min_value": 0, "max_value": 9}, dataset_id=1)


def arrive(spark, path, rows):
    spark.createDataFrame(rows, "v int").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("v int").parquet(path)


def test_a_batch_before_its_rules_is_not_lost(spark, store, tmp_path):
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    register_dataset(store, Dataset(1, "arrivals", path=path), now=NOW)
    stream = arrive(spark, path, [(1,), (20,)])
    with pytest.raises(Exception, match="was not validated"):
        validate_stream(stream, store, 1, checkpoint).awaitTermination()
    register_rules(store, [RULE], now=NOW)
    validate_stream(stream, store, 1, checkpoint).awaitTermination()
    results = store.read("rule_results").collect()
    assert [(r["element_count"], r["unexpected_count"]) for r in results] == [(2, 1)]


def test_a_batch_broken_after_its_capture_counts_once(spark, store, tmp_path, monkeypatch):
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    register_dataset(store, Dataset(1, "arrivals", path=path), now=NOW)
    register_rules(store, [RULE], now=NOW)
    stream = arrive(spark, path, [(1,), (20,), (30,)])
    append_rows = Store.append_rows

    def breaks(self, table, rows):
        if table == "dataset_run_log":
            raise RuntimeError("crash")
        append_rows(self, table, rows)

    monkeypatch.setattr(Store, "append_rows", breaks)
    with pytest.raises(Exception, match="crash"):
        validate_stream(stream, store, 1, checkpoint).awaitTermination()
    assert store.read("rule_results").count() == 1
    monkeypatch.setattr(Store, "append_rows", append_rows)
    validate_stream(stream, store, 1, checkpoint).awaitTermination()
    assert store.read("rule_results").count() == 1
    assert sorted(r["v"] for r in spark.table(store.name("arrivals_dq_failure")).collect()) == [20, 30]
    assert store.read("dataset_run_log").count() == 1
