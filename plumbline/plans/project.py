"""One run of all datasets of a project."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import functions as F

from plumbline import catalog
from plumbline.plans.rules import runnable_rules
from plumbline.plans.runner import ERROR, FAILED, SUCCESS, load_datasets, run_dataset
from plumbline.sources.store import Store, new_id

STATUS = {SUCCESS: "SUCCESS", FAILED: "FAILURE", ERROR: "ERROR"}
SHORT = {SUCCESS: "PASS", FAILED: "FAIL", ERROR: "ERROR"}


@dataclass
class ProjectRun:
    project_id: int
    batch_id: int | None = None
    status: str = "NO_DATASETS"
    code: int | None = None
    datasets_total: int = 0
    datasets_run: int = 0
    datasets_skipped: int = 0
    passed: int = 0
    failed: int = 0
    errored: int = 0
    details: list[dict[str, Any]] = field(default_factory=list)


def run_project(
    store: Store, project_id: int, now: datetime.datetime | None = None, created_by: str | None = None
) -> ProjectRun:
    """Run the datasets that have rules, in id order; the summary comes from their run-log rows."""
    started = now or datetime.datetime.now()
    datasets = load_datasets(store, F.col("project_id") == project_id)
    if not datasets:
        return ProjectRun(project_id)
    runnable = runnable_counts(store, [d.dataset_id for d in datasets])
    batch_id = new_id()
    chosen = [d for d in datasets if runnable.get(d.dataset_id)]

    def one(dataset) -> dict[str, Any]:
        entry = {"dataset_id": dataset.dataset_id, "dataset_name": dataset.dataset_name}
        try:
            code = run_dataset(store, dataset.dataset_id, batch_id=batch_id, now=now, created_by=created_by).code
            return {**entry, "status": SHORT[code], "code": code}
        except Exception as exc:  # one dataset must not stop the project
            return {**entry, "status": "CALL_EXCEPTION", "error": str(exc)}

    # One dataset at a time: a run already keeps the executors busy, and its appends stay apart from others'.
    told = {d.dataset_id: one(d) for d in chosen}
    run = summary(store, project_id, batch_id, len(datasets), len(chosen))
    skipped = {"status": "SKIPPED_NO_RULES"}
    run.details = [
        told.get(d.dataset_id, {"dataset_id": d.dataset_id, "dataset_name": d.dataset_name, **skipped})
        for d in datasets
    ]
    ended = now or datetime.datetime.now()
    counts = {k: getattr(run, k) for k in ("datasets_total", "datasets_run", "datasets_skipped", "passed", "failed", "errored")}
    row = {"batch_id": batch_id, "project_id": project_id, **counts, "run_status": run.status}
    row["success_percent"] = run.passed * 100.0 / run.datasets_run if run.datasets_run else 0.0
    row |= {"run_time": (ended - started).total_seconds(), "created_by": created_by, "created_timestamp": started}
    store.append_rows("project_run_log", [row])
    return run


def runnable_counts(store: Store, dataset_ids: list[int]) -> dict[int, int]:
    """Runnable rules of each dataset, by one query."""
    rules = runnable_rules(
        store.read("rule_config"), catalog.master_frame(store.spark), catalog.mapping_frame(store.spark)
    )
    counts = rules.where(F.col("dataset_id").isin(dataset_ids)).groupBy("dataset_id").count().collect()
    return {r["dataset_id"]: r["count"] for r in counts}


def summary(store: Store, project_id: int, batch_id: int, total: int, chosen: int) -> ProjectRun:
    """The batch's outcome from its rows in the run log; a chosen dataset without a row is an error."""
    log = store.read("dataset_run_log").where(F.col("batch_id") == batch_id)
    found = {r["run_status"]: r["count"] for r in log.groupBy("run_status").count().collect()}
    passed, failed = (found.get(STATUS[c], 0) for c in (SUCCESS, FAILED))
    run = ProjectRun(project_id, batch_id, datasets_total=total, datasets_run=chosen, datasets_skipped=total - chosen)
    run.passed, run.failed, run.errored = passed, failed, chosen - passed - failed
    run.code = ERROR if run.errored else FAILED if failed else SUCCESS
    run.status = STATUS[run.code]
    return run
