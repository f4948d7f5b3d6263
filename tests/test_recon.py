"""Reconciliation scenarios in sequence, with stored watermarks."""

from __future__ import annotations

import datetime
import json

import pytest

from plumbline.operators import check
from plumbline.plans.rules import register_dataset, register_rules
from plumbline.plans.runner import ERROR, FAILED, SUCCESS, run_dataset
from plumbline.rule import Rule
from plumbline.sources.datasets import Dataset
from tests import samples as s

EQUAL = "expect_table_row_count_to_equal_other_table"
DAY = datetime.datetime(2025, 3, 2)


@pytest.fixture()
def history(spark, store):
    kwargs = {"source_table": "customers_core", "scd_type": 2, "partition_keys": "customer_id",
              "recon_mode": "incremental"}
    register_dataset(store, Dataset(3, "customers_conformed", table_name="customers_conformed_now"), now=DAY)
    register_dataset(store, Dataset(4, "customers_core", table_name="customers_core_now"), now=DAY)
    register_rules(store, [Rule(4, EQUAL, kwargs, dataset_id=3)], now=DAY)
    step = iter(range(100))

    def run(core, conformed):
        spark.createDataFrame(core, s.CORE_SCHEMA).createOrReplaceTempView("customers_core_now")
        spark.createDataFrame(conformed, s.HISTORY_SCHEMA).createOrReplaceTempView("customers_conformed_now")
        done = run_dataset(store, 3, now=DAY + datetime.timedelta(hours=next(step)))
        rows = store.read("recon_results").where(f"dataset_run_id = {done.dataset_run_id}").collect()
        return done.code, {r["validation_on"]: (r["core_value"], r["conformed_value"], r["result"]) for r in rows}

    return run


def test_baseline_then_pass_then_late_target(store, history):
    assert history(s.CORE, s.HISTORY) == (SUCCESS, {"ACTIVE_COUNT": ("5", "5", "PASS")})
    marks = json.loads(store.read("rule_results").first()["observed_value"])
    assert marks == {"core_watermark": "2025-01-24 11:12:05", "conf_watermark": "2025-01-24 14:15:00"}
    assert history(s.CORE_1, s.HISTORY_1) == (
        SUCCESS, {"ACTIVE_COUNT": ("3", "3", "PASS"), "INACTIVE_COUNT": ("1", "1", "PASS")})
    late = (FAILED, {"ACTIVE_COUNT": ("2", "0", "FAIL"), "INACTIVE_COUNT": ("0", "0", "PASS")})
    assert history(s.CORE_2, s.HISTORY_1) == late
    # A failed run does not move the marks.
    assert history(s.CORE_2, s.HISTORY_1) == late


def test_row_expired_without_a_source_change(history):
    assert history(s.CORE, s.HISTORY)[0] == SUCCESS
    assert history(s.CORE, s.HISTORY_3) == (
        FAILED, {"ACTIVE_COUNT": ("0", "1", "FAIL"), "INACTIVE_COUNT": ("0", "1", "FAIL")})


def test_target_without_insert_date(spark):
    """Keys existed before if their earliest update is not after the mark.

    Where expiry overwrites the update date of a key's only old version, the
    key looks new; an older version that kept its date shows that it existed.
    """
    core = spark.createDataFrame(s.CORE_1, s.CORE_SCHEMA)
    older = (0, 104, "N", s.at("2024-06-01 14:30:00"), s.at("2024-12-01 00:00:00"))
    for rows, known in ((s.HISTORY_1, 0), (s.HISTORY_1 + [older], 1)):
        target = spark.createDataFrame(rows, s.HISTORY_SCHEMA).drop("INSERT_DATE_TIME")
        row = check(
            target, EQUAL, {"source_table": "core", "scd_type": 2, "partition_keys": ["CUSTOMER_ID"]},
            others={"core": core}, watermarks={1: ("2025-01-24 11:12:05", "2025-01-24 14:15:00")},
        ).first()
        told = json.loads(row["details"])
        assert told["active"]["core"] == 3
        assert (told["inactive"]["core"], told["inactive"]["conformed"]) == (known, 1)


def test_plain_counts(spark):
    ten, eleven = spark.range(10), spark.range(11)
    for other, passes in ((ten, True), (eleven, False)):
        row = check(ten, EQUAL, {"other_dataset_name": "core"}, others={"core": other}).first()
        assert row["is_success"] is passes and row["unexpected_count"] == (0 if passes else 1)


def test_keys_are_required(spark):
    with pytest.raises(ValueError):
        check(spark.range(1), EQUAL, {"source_table": "core", "scd_type": 1}, others={"core": spark.range(1)})


def test_missing_keys_meet_as_text(spark):
    """NULL and padded keys of both sides meet."""
    mark = "2025-01-01 00:00:00"
    new, old = s.at("2025-02-01 00:00:00"), s.at("2024-01-01 00:00:00")
    core = spark.createDataFrame([(None, new), (" A ", new), ("B", new)], "k string, INSERT_DATE_TIME timestamp_ntz")
    target = spark.createDataFrame(
        [(None, "N", old, new), ("A", "N", old, new), ("C", "Y", old, old)],
        "k string, IS_ACTIVE string, INSERT_DATE_TIME timestamp_ntz, UPDATE_DATE_TIME timestamp_ntz",
    )
    row = check(target, EQUAL, {"source_table": "core", "scd_type": 2, "partition_keys": "k"},
                others={"core": core}, watermarks={1: (mark, mark)}).first()
    assert json.loads(row["details"])["inactive"] == {"core": 2, "conformed": 2, "result": "PASS"}


FILE = "expect_table_row_count_to_equal_source_file"


@pytest.mark.parametrize(
    "target,extra,expected",
    [
        ("sales.public.orders_core", [], ("10", "10", "PASS", "ORDERS")),
        ("SALES.PUBLIC.CUSTOMERS_CORE", [], ("5", "5", "PASS", "CUSTOMERS")),
        ("SALES.PUBLIC.CUSTOMERS_CORE", [("SALES.PUBLIC.CUSTOMERS_CORE", 3, 3, "SOURCE_TO_CORE", "Success",
                                          s.at("2025-02-01 10:10:00"))], ("3", "3", "PASS", "CUSTOMERS")),
        ("SALES.PUBLIC.VCRM_USER_C", [], ("0", "0", "PASS", "VCRM")),
        ("SALES.PUBLIC.NOTHING", [], ("NO_AUDIT_RECORD", "NO_AUDIT_RECORD", "FAIL", "UNKNOWN")),
        ("SALES.PUBLIC.ORDERS_CORE", [("SALES.PUBLIC.ORDERS_CORE", 12, 10, "SOURCE_TO_CORE", "Success",
                                       s.at("2025-01-24 10:16:00"))], ("12", "10", "FAIL", "ORDERS")),
        ("SALES.PUBLIC.LEDGER_X", [("SALES.PUBLIC.LEDGER_X", 1, 1, "SOURCE_TO_CORE", "Success",
                                   s.at("2025-01-24 10:16:00"))], ("1", "1", "PASS", "ROSTER")),
    ],
)
def test_source_file(spark, target, extra, expected):
    audit = spark.createDataFrame(s.AUDIT + extra, s.AUDIT_SCHEMA)
    row = check(spark.range(1), FILE, {"audit_control_table": "audit", "target_table": target, "source_labels": {"LEDGER": "ROSTER"}}, others={"audit": audit}).first()
    told = json.loads(row["details"])["source_to_core"]
    assert (told["src"], told["core"], told["result"], told["source_label"]) == expected
    assert row["is_success"] is (expected[2] == "PASS")


def test_retry_on_the_same_day_wins(spark):
    audit = spark.createDataFrame([r for r in s.AUDIT if r[5].day == 20], s.AUDIT_SCHEMA)
    kwargs = {"audit_control_table": "audit", "target_table": "SALES.PUBLIC.ORDERS_CORE"}
    assert check(spark.range(1), FILE, kwargs, others={"audit": audit}).first()["is_success"]


def test_recon_error_code(store, spark):
    spark.range(3).createOrReplaceTempView("three_rows")
    register_dataset(store, Dataset(1, "three", table_name="three_rows"), now=DAY)
    register_rules(store, [Rule(1, EQUAL, {"source_table": "absent_table"}, dataset_id=1)], now=DAY)
    assert run_dataset(store, 1, now=DAY).code == ERROR


@pytest.mark.parametrize("room", [None, 0])
def test_history_is_filtered_by_the_changed_keys(spark, monkeypatch, room):
    """Of a long history only the rows of changed keys go beyond its scan; without room for a broadcast the result is the same."""
    from plumbline.operators import recon

    if room is not None:
        monkeypatch.setattr(recon, "BROADCAST_BYTES", room)
    changed = spark.createDataFrame([("5",), ("5",), ("-1",), ("NA",), ("77",)], "__k0 string")
    known = spark.range(20_000).selectExpr("CAST(id % 10000 AS string) AS __k0")
    frame = recon.keys_known(changed, known)
    assert frame.collect()[0]["core_inactive"] == 3
    if room is None:
        plan = frame._jdf.queryExecution().executedPlan()
        text = plan.toString()
        assert "BroadcastHashJoin" in text
        written = {}

        def visit(node):
            metrics = node.metrics()
            if metrics.contains("shuffleRecordsWritten"):
                written[node.toString()[:80]] = metrics.apply("shuffleRecordsWritten").value()
            children = node.children()
            for k in range(children.size()):
                visit(children.apply(k))

        final = plan.executedPlan() if hasattr(plan, "executedPlan") else plan
        visit(final)
        assert all(n < 100 for n in written.values())
