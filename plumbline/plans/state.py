"""What a run needs to know of earlier ones, by dataset.

A small table has one row a dataset: its last full runs with their verdicts,
the newest validated value, the reconciliation marks of its rules and the
batches of its streams.  A run reads and replaces its dataset's partition, so
its cost doesn't grow with the history of results and logs.  The row is written
after the run's log row and can be made again from the history: a dataset
without one gets it that way.

Runs of one dataset at the same time in several processes may each replace the
row; the later one then lacks the other's marks, and what those would have
spared is validated again.
"""

from __future__ import annotations

import datetime
import json
import threading
from collections import defaultdict
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.store import DAY, Store

# Full runs whose verdicts are kept.
RUNS_KEPT = 10

_TURNS: defaultdict[tuple[str, int], threading.Lock] = defaultdict(threading.Lock)


def latest_watermarks(rule_results: DataFrame) -> DataFrame:
    """Marks of the last passing result of each rule that stored any."""
    # Find the latest result that holds a mark first, and parse only that.
    holds_mark = F.col("observed_value").rlike(r'"(core_)?watermark"\s*:\s*[^\sn]')
    latest = F.max_by("observed_value", F.struct("run_timestamp", "dataset_run_id", "observed_value"))
    found = (
        rule_results.where(F.col("is_success") & holds_mark)
        .groupBy("rule_config_id")
        .agg(latest.alias("observed"))
    )

    def mark(name):
        own = F.get_json_object("observed", f"$.{name}")
        return F.coalesce(own, F.get_json_object("observed", "$.watermark"))

    return found.select(
        "rule_config_id", mark("core_watermark").alias("core"), mark("conf_watermark").alias("conf")
    )


def rebuilt(store: Store, dataset_id: int) -> dict:
    """The state as the history of results and logs tells it; streams begin anew."""
    mine = F.col("dataset_id") == dataset_id
    log = store.read("dataset_run_log").where(mine & (F.col("evaluated_expectations") > 0))
    full = F.coalesce(F.col("run_scope"), F.lit("FULL")) == "FULL"
    bad = F.col("unsuccessfull_expectations") + F.col("error_expectations")
    told = log.agg(
        F.max_by(bad, "dataset_run_id").alias("failures"),
        F.max(F.when(full & (F.col("run_status") != "ERROR"), F.col("max_validated_timestamp"))).cast("string").alias("mark"),
    ).first()
    results = store.read("rule_results").where(mine)
    runs = log.where(full).select("dataset_run_id").orderBy(F.desc("dataset_run_id")).limit(RUNS_KEPT)
    verdicts = runs.join(results.select("dataset_run_id", "rule_config_id", "is_success"), "dataset_run_id", "left")
    by_run: dict[str, dict[str, bool]] = {}
    for r in verdicts.collect():
        held = by_run.setdefault(str(r["dataset_run_id"]), {})
        if r["rule_config_id"] is not None:
            held[str(r["rule_config_id"])] = r["is_success"]
    marks = {str(r["rule_config_id"]): [r["core"], r["conf"]] for r in latest_watermarks(results).collect()}
    return {"failures": told["failures"], "mark": told["mark"], "runs": by_run, "rules": marks, "streams": {}}


def read_state(store: Store, dataset_id: int) -> dict:
    def row():
        return store.read("run_state").where(F.col("dataset_id") == dataset_id).first()

    try:
        found = row()
    except Exception:  # another process has just replaced the file
        store.spark.catalog.refreshTable(store.name("run_state"))
        found = row()
    return rebuilt(store, dataset_id) if found is None else json.loads(found["state"])


def change_state(store: Store, dataset_id: int, change: Callable[[dict], None]) -> None:
    """Replace a dataset's state by what ``change`` makes of it; one at a time in this process."""
    with _TURNS[store.name("run_state"), dataset_id]:
        state = read_state(store, dataset_id)
        change(state)
        store.replace_state(dataset_id, json.dumps(state))


def after_run(
    run_id: int, full: bool, failures: int, errors: int, mark: str | None, results: dict[int, dict]
) -> Callable[[dict], None]:
    """The change that a finished run makes."""

    def change(state: dict) -> None:
        state["failures"] = failures + errors
        if full:
            state["runs"][str(run_id)] = {str(i): r["is_success"] for i, r in results.items()}
            for old in sorted(state["runs"], key=int)[:-RUNS_KEPT]:
                del state["runs"][old]
        if full and not errors and mark is not None:
            state["mark"] = mark if state["mark"] is None else max(mark, state["mark"])
        for i, r in results.items():
            held = json.loads(r["observed_json"]) if r["is_success"] and r["observed_json"] else {}
            if isinstance(held, dict) and held.get("core_watermark") is not None:
                state["rules"][str(i)] = [held["core_watermark"], held.get("conf_watermark")]

    return change


def shown_verdicts(state: dict, run_id: int, results: dict[int, dict]) -> list[dict]:
    """Verdicts of the last full runs and of this one, a row a run and rule."""
    runs = {int(k): v for k, v in state["runs"].items()}
    # A full run counts among the ten, as it will once it is logged.
    runs[run_id] = {str(i): r["is_success"] for i, r in results.items()}
    return [
        {"dataset_run_id": run, "rule_config_id": int(i), "is_success": ok}
        for run in sorted(runs)[-RUNS_KEPT - 1 :]
        for i, ok in runs[run].items()
    ]


def logged_since(store: Store, dataset_id: int, marker: str, day: datetime.date | None) -> bool:
    """Whether a run under a marker was logged on a day or later (ever, without one); earlier days are not read."""
    log = store.spark.table(store.name("dataset_run_log"))
    log = log if day is None else log.where(F.col(DAY) >= F.lit(day))
    mine = (F.col("dataset_id") == dataset_id) & (F.col("created_by") == marker)
    return not log.where(mine & (F.col("evaluated_expectations") > 0)).isEmpty()
