"""Failing rows: one pass with the verdicts, each stored once, a pivot without a shuffle."""

from __future__ import annotations

import datetime
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.plans import runner
from plumbline.plans.pivot import failure_pivot
from plumbline.plans.rules import register_dataset, register_rules
from plumbline.plans.runner import FAILED, SUCCESS, run_dataset
from plumbline.rule import Rule
from plumbline.sources import store as stores
from plumbline.sources.datasets import Dataset
from tests.test_plans import rows_read

NOW = datetime.datetime(2026, 3, 1, 12, 0, 0)
# Copies of failing rows, rows that fail several rules, and rows that fail none.
ROWS = [(1, -5, "a")] * 4 + [(2, 50, None)] * 3 + [(3, -7, None), (4, 9, "b"), (5, 8, "c"), (5, 7, "c")]


def rule(rule_id, expectation, error_flag=True, **kwargs):
    return Rule(rule_id, expectation, kwargs, dataset_id=1, error_flag=error_flag)


RULES = [
    rule(1, "expect_column_values_to_be_between", column="v", min_value=0, max_value=10),
    rule(2, "expect_column_values_to_not_be_null", column="t"),
    rule(3, "expect_column_values_to_be_unique", column="k"),
    rule(4, "expect_column_values_to_not_be_null", column="k"),
    rule(5, "expect_column_median_to_be_between", column="v", min_value=100),
    rule(6, "expect_column_values_to_be_between", column="v", min_value=0, max_value=1000, failed_row_count=2),
]
FAILING = {
    1: [r for r in ROWS if not 0 <= r[1] <= 10],
    2: [r for r in ROWS if r[2] is None],
    3: [r for r in ROWS if r[0] in (1, 2, 5)],
    6: [(1, -5, "a")] * 2,
}


@pytest.fixture()
def numbers(spark, store, tmp_path):
    path = str(tmp_path / "numbers")
    spark.createDataFrame(ROWS, "k int, v int, t string").repartition(3).write.parquet(path)
    dataset = Dataset(1, "numbers", path=path, primary_key_columns='{"primary_key": ["k"]}')
    register_dataset(store, dataset, now=NOW)
    register_rules(store, RULES, now=NOW)
    return dataset


def found_rows(store):
    rows = store.spark.table(store.name("numbers_dq_failure")).collect()
    out = {}
    for r in rows:
        out.setdefault(r["rule_config_id"], []).append((r["k"], r["v"], r["t"]))
    return {i: Counter(v) for i, v in out.items()}


def wanted_rows():
    return {i: Counter(v) for i, v in FAILING.items()}


def test_each_distinct_failing_row_is_stored_once(store, numbers):
    run = run_dataset(store, 1, now=NOW)
    assert run.codes == {1: FAILED, 2: FAILED, 3: FAILED, 4: SUCCESS, 5: FAILED, 6: FAILED}
    assert found_rows(store) == wanted_rows()
    stored = {(r["k"], r["v"], r["t"]): r["failed_rules"] for r in store.failing_rows("numbers_dq_failure", run.dataset_run_id).collect()}
    assert len(stored) == len({r for rows in FAILING.values() for r in rows})
    assert stored[1, -5, "a"] == {1: 4, 3: 4, 6: 2} and stored[3, -7, None] == {1: 1, 2: 1}
    assert store.read("failed_row_keys").count() == sum(map(len, FAILING.values()))
    assert not [t for t in store.spark.catalog.listTables(store.database) if t.name.startswith("staged")]


def test_copies_unfold_in_two_steps(store, numbers, monkeypatch):
    monkeypatch.setattr(stores, "COPIES", 3)
    run_dataset(store, 1, now=NOW)
    assert found_rows(store) == wanted_rows()


def test_verdicts_and_failing_rows_come_from_one_reading(spark, store, numbers, monkeypatch):
    """The dataset is read once for all row rules, their verdicts and their failing rows."""
    register_rules(store, [], now=NOW)
    plain = [1, 2, 4]
    seen = []
    append = stores.Store.stage

    def stage(self, run_id, rows):
        seen.append(rows_read(spark, lambda: append(self, run_id, rows)))

    monkeypatch.setattr(stores.Store, "stage", stage)
    run = run_dataset(store, 1, rule_ids=plain, now=NOW)
    assert run.codes == {1: FAILED, 2: FAILED, 4: SUCCESS} and seen == [len(ROWS)]
    # A run after one without failures reads for verdicts first, and stages nothing.
    assert run_dataset(store, 1, rule_ids=[4], now=NOW).codes == {4: SUCCESS}
    again = run_dataset(store, 1, rule_ids=plain, now=NOW)
    assert again.codes == run.codes and len(seen) == 2  # the run with rule 4 alone staged an empty set
    results = store.read("rule_results").where("rule_config_id < 3").groupBy("rule_config_id", "unexpected_count").count()
    assert {tuple(r) for r in results.collect()} == {(1, 8, 2), (2, 4, 2)}
    assert found_rows(store) == {1: Counter(FAILING[1] * 2), 2: Counter(FAILING[2] * 2)}


def test_a_pass_that_fails_is_made_up_for(store, numbers, monkeypatch):
    monkeypatch.setattr(runner, "observed", lambda *a: 1 / 0)
    assert run_dataset(store, 1, now=NOW).status == "FAILURE"
    assert found_rows(store) == wanted_rows()


def test_the_pivot_is_a_projection(spark, store, numbers):
    run = run_dataset(store, 1, now=NOW)
    pivot = failure_pivot(store, numbers, run.dataset_run_id)
    plan = pivot._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Aggregate|Join", plan)
    cells = {(r["k"], r["v"], r["t"]): r.asDict() for r in pivot.collect()}
    assert len(cells) == len({r for rows in FAILING.values() for r in rows}) == pivot.count()
    for row, cell in cells.items():
        for column, value in cell.items():
            number = column.rpartition("_")[2]
            if number in ("1", "2", "3", "4"):
                assert value == ("FAIL" if row in FAILING.get(int(number), ()) else "PASS")
            if number == "5":
                assert value == "FAIL - AGGREGATE CHECK"
    later = run_dataset(store, 1, rule_ids=[1], now=NOW)
    both = failure_pivot(store, numbers, later.dataset_run_id).where(F.col("dataset_run_id") == later.dataset_run_id)
    second = next(c for c in both.columns if c.endswith("_2"))
    assert {r[0] for r in both.select(F.col(f"`{second}`")).collect()} == {"NOT CONFIGURED"}


def test_rows_that_do_not_group_are_stored_one_by_one(spark, store, tmp_path):
    path = str(tmp_path / "maps")
    spark.sql("SELECT 1 AS k, map('a', 1) AS m UNION ALL SELECT 1, map('a', 1) UNION ALL SELECT NULL, map()").write.parquet(path)
    register_dataset(store, Dataset(1, "maps", path=path), now=NOW)
    register_rules(store, [rule(1, "expect_column_values_to_be_null", column="k"), rule(2, "expect_column_values_to_not_be_null", column="k")], now=NOW)
    assert run_dataset(store, 1, now=NOW).codes == {1: FAILED, 2: FAILED}
    rows = spark.table(store.name("maps_dq_failure")).collect()
    assert sorted((r["rule_config_id"], len(r["m"])) for r in rows) == [(1, 1), (1, 1), (2, 0)]


def test_expired_failing_rows_are_dropped_by_run(store, numbers):
    old, young = NOW - datetime.timedelta(days=31), NOW - datetime.timedelta(days=29)
    run_dataset(store, 1, rule_ids=[1], now=old)
    run_dataset(store, 1, rule_ids=[1], now=young)
    report = {r["table"]: r["rows_deleted"] for r in store.clean_up(NOW)}
    assert report["numbers_dq_failure_rows"] == 3
    assert found_rows(store) == {1: Counter(FAILING[1])}
