"""Incremental validation driven by a stream instead of a stored watermark.

The stream's checkpoint takes the place of the last validated timestamp: each
micro-batch holds exactly the rows not yet validated, and is validated as one
run of the dataset.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.plans.runner import load_datasets, run_dataset
from plumbline.plans.state import change_state, logged_since, read_state
from plumbline.sources.store import Store, failure_table_name, new_id


STARTED = "BATCH_STARTED"


def reserve(store: Store, dataset_id: int, label: str, marker: str, now: datetime.datetime) -> int | None:
    """The run id of a batch, or None for one whose run was logged.

    The id is reserved in the dataset's state before the first attempt and found
    there by later ones.  The log is read from the day of the reservation on.
    """
    held = read_state(store, dataset_id)["streams"].get(label)
    row = {"procedure_name": "validate_stream", "step_name": STARTED, "log_message": marker, "status": "STARTED"}
    if held is not None and held["marker"] == marker:
        run_id = held["run"]
        if logged_since(store, dataset_id, marker, datetime.date.fromisoformat(held["day"])):
            return None
        for dataset in load_datasets(store, F.col("dataset_id") == dataset_id):
            store.discard_run(run_id, failure_table_name(dataset.dataset_name))
    elif held is None and logged_since(store, dataset_id, marker, None):  # a stream older than the state
        return None
    else:
        run_id = new_id()
        entry = {"marker": marker, "run": run_id, "day": now.date().isoformat()}
        change_state(store, dataset_id, lambda state: state["streams"].update({label: entry}))
    store.append_rows("rule_audit_log", [{**row, "dataset_run_id": run_id, "start_timestamp": now, "end_timestamp": now}])
    return run_id


def validate_stream(
    stream: DataFrame, store: Store, dataset_id: int, checkpoint: str, name: str | None = None
) -> StreamingQuery:
    """Validate everything available now, batch by batch.

    A batch's run id is reserved before its run begins.  A batch repeated after
    a failure is skipped when its run was logged; otherwise it runs under the
    same id, after what the broken run left is removed, so nothing counts twice.  A batch that can't be validated, for want of rules or of the
    dataset, stops the stream before its offsets are committed.
    """
    label = name or f"validate_{dataset_id}"

    def validate(batch: DataFrame, epoch: int) -> None:
        marker = f"{label}:{dataset_id}:{epoch}"
        run_id = reserve(store, dataset_id, label, marker, datetime.datetime.now())
        if run_id is None:
            return
        # A run reads its rows several times; the source is read once, and again
        # only for what a lost executor held.
        rows = batch.persist()
        try:
            run = run_dataset(store, dataset_id, run_id=run_id, created_by=marker, frame=rows)
        finally:
            rows.unpersist()
        if not run.codes:
            raise RuntimeError(f"batch {epoch} of {label} was not validated: {run.message}")

    return (
        stream.writeStream.foreachBatch(validate)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .queryName(label)
        .start()
    )
