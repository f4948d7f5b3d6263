"""The state of a dataset: equal to what the history tells, and read in its place."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from plumbline.plans.pivot import failure_pivot, failure_pivot_sql
from plumbline.plans.rules import register_dataset, register_rules
from plumbline.plans.runner import run_dataset
from plumbline.plans.state import RUNS_KEPT, change_state, read_state, rebuilt, shown_verdicts
from plumbline.rule import Rule
from plumbline.sources.datasets import Dataset
from plumbline.sources.store import Store

DAY = datetime.datetime(2026, 1, 1)
HISTORY = {"rule_results", "dataset_run_log", "rule_audit_log", "recon_results", "failed_row_keys"}


def rule(rule_id, expectation, **kwargs):
    return Rule(rule_id, expectation, kwargs, dataset_id=1)


@pytest.fixture()
def events(spark, store, tmp_path):
    """An incremental dataset with a range rule and a reconciliation against a source that grows."""
    path, core = str(tmp_path / "events"), str(tmp_path / "core")

    def arrive(ids):
        rows = [(i, DAY + datetime.timedelta(hours=i), i) for i in ids]
        for place in (path, core):
            spark.createDataFrame(rows, "id long, at timestamp_ntz, v int").coalesce(1).write.mode("append").parquet(place)

    arrive(range(6))
    register_dataset(store, Dataset(1, "events", path=path, is_incremental=True, incr_date_column_1="at"), now=DAY)
    register_dataset(store, Dataset(2, "core", path=core), now=DAY)
    register_rules(
        store,
        [
            rule(1, "expect_column_values_to_be_between", column="v", min_value=0, max_value=3),
            rule(2, "expect_table_row_count_to_equal_other_table", other_dataset_name="core", scd_type=1, partition_keys="id",
                 core_insert_date_col="at", conformed_update_date_col="at", recon_mode="incremental"),
            rule(3, "expect_table_row_count_to_be_between", min_value=0),
        ],
        now=DAY,
    )
    return arrive


def test_state_equals_the_history(store, events):
    seen = []
    for hour, ids in enumerate(([], [6, 7], [], [8])):
        if ids:
            events(ids)
        run_dataset(store, 1, now=DAY + datetime.timedelta(days=10 + hour))
        state = read_state(store, 1)
        assert state == rebuilt(store, 1)
        seen.append(state["mark"])
    assert seen[0] < seen[1] == seen[2] < seen[3]
    state = read_state(store, 1)
    assert state["failures"] == 1 and len(state["runs"]) == 4
    assert state["rules"]["2"] == ["2026-01-01 08:00:00", "2026-01-01 08:00:00"]
    runs = sorted(map(int, state["runs"]))
    last = store.read("rule_results").where(F.col("dataset_run_id") == runs[-1]).collect()
    assert {r["rule_config_id"]: r["element_count"] for r in last}[1] == 1  # only what came after the mark
    run_dataset(store, 1, rule_ids=[3], now=DAY + datetime.timedelta(days=20))
    assert sorted(map(int, read_state(store, 1)["runs"])) == runs and read_state(store, 1)["failures"] == 0


def test_no_history_is_read_by_a_run(store, events, monkeypatch):
    first = run_dataset(store, 1, now=DAY)
    read, tables = Store.read, []

    def noted(self, table):
        tables.append(table)
        return read(self, table)

    monkeypatch.setattr(Store, "read", noted)
    run = run_dataset(store, 1, now=DAY)
    assert run.codes == first.codes | {1: 200} and "run_state" in tables
    assert not HISTORY & set(tables)
    plan = store.read("run_state").where("dataset_id = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset_id" in plan


def test_a_lost_state_is_made_again(store, events):
    run_dataset(store, 1, now=DAY)
    wanted = read_state(store, 1)
    store.spark.sql(f"ALTER TABLE {store.name('run_state')} DROP PARTITION (dataset_id = 1)")
    assert read_state(store, 1) == wanted
    run = run_dataset(store, 1, now=DAY)
    assert str(run.dataset_run_id) in read_state(store, 1)["runs"]


def test_the_view_from_the_state_equals_that_from_the_history(store, events):
    for k in range(3):
        run = run_dataset(store, 1, now=DAY)
    dataset = Dataset(1, "events")
    state = read_state(store, 1)
    results = {int(i): {"is_success": ok} for i, ok in state["runs"][str(run.dataset_run_id)].items()}
    known = shown_verdicts(state, run.dataset_run_id, results)
    assert len(known) == 9
    assert failure_pivot_sql(store, dataset, run.dataset_run_id, known) == failure_pivot_sql(store, dataset, run.dataset_run_id)
    assert failure_pivot(store, dataset, run.dataset_run_id).count() == 2


def test_only_the_last_full_runs_are_kept(store):
    def add(k):
        return lambda state: state["runs"].update({str(k): {"1": True}})

    change_state(store, 7, add(1))
    change_state(store, 8, add(5))
    assert set(read_state(store, 7)["runs"]) == {"1"} and set(read_state(store, 8)["runs"]) == {"5"}
    from plumbline.plans.state import after_run

    state = {"runs": {str(k): {} for k in range(RUNS_KEPT)}, "failures": 0, "mark": "2026-01-02", "rules": {}, "streams": {}}
    told = {1: {"is_success": True, "observed_json": json.dumps({"watermark": 5})}}
    after_run(99, True, 0, 0, "2026-01-01", told)(state)
    assert len(state["runs"]) == RUNS_KEPT and "0" not in state["runs"] and "99" in state["runs"]
    assert state["mark"] == "2026-01-02" and state["rules"] == {}
    after_run(100, True, 2, 1, "2027-01-01", {})(state)
    assert state["failures"] == 3 and state["mark"] == "2026-01-02"
