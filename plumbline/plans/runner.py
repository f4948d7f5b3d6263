"""One run of a dataset: evaluate its rules, capture failures, write results."""

from __future__ import annotations

import datetime
import json
import re
import threading
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import find_column, quoted
from plumbline.operators.custom import combination_profile, query_profile_columns
from plumbline.operators.recon import source_label
from plumbline.operators.spec import ScanSpec
from plumbline.plans import details
from plumbline.plans.capture import observed, stageable, stored_rows
from plumbline.plans.evaluate import Compiled, analysed, compile_rules, passes, results, row_limit
from plumbline.plans.parallel import side_by_side
from plumbline.plans.pivot import failure_view
from plumbline.plans.rules import fetch_rules, parse_rule_ids
from plumbline.plans.state import after_run, change_state, read_state, shown_verdicts
from plumbline.rule import Rule, RuleError, name_list, parse_kwargs
from plumbline.sources.datasets import Dataset, LazyFrames, Scope
from plumbline.sources.store import Store, failure_table_name, new_id

# Return codes.
SUCCESS, FAILED, ERROR = 200, 300, 400

STEP = "run_dataset"

# Checks that record keys by the candidate key when there is no primary key.
CANDIDATE_KEY_CHECKS = {
    "expect_compound_columns_to_be_unique",
    "expect_column_pair_values_a_to_be_greater_than_b",
    "expect_multicolumn_sum_to_equal",
    "expect_column_value_z_scores_to_be_less_than",
    "expect_column_values_to_be_of_type",
}


@dataclass
class DatasetRun:
    """Outcome of a run."""

    code: int
    dataset_run_id: int | None = None
    status: str = "ERROR"
    codes: dict[int, int] = field(default_factory=dict)
    errors: dict[int, str] = field(default_factory=dict)
    message: str | None = None


class _Audit:
    """Steps of a run; written once at the run's end.

    A step begins where the last one ended, unless it tells its own start:
    steps that run side by side do.
    """

    def __init__(self, clock: Callable[[], datetime.datetime]):
        self.clock = clock
        self.since = clock()
        self.rows: list[dict[str, Any]] = []
        self._lock = threading.Lock()

    def add(self, run_id, rule_id, step, status, message=None, error=None, since=None, until=None):
        with self._lock:
            ended = until or self.clock()
            self.rows.append(
                {
                    "dataset_run_id": run_id,
                    "rule_config_id": rule_id,
                    "procedure_name": STEP,
                    "step_name": step,
                    "log_message": message,
                    "start_timestamp": since or self.since,
                    "end_timestamp": ended,
                    "status": status,
                    "error_message": None if error is None else str(error),
                }
            )
            self.since = max(self.since, ended)


def load_datasets(store: Store, condition=None) -> list[Dataset]:
    rows = store.read("dataset")
    rows = rows if condition is None else rows.where(condition)
    names = Dataset.__dataclass_fields__
    defaults = {"dataset_type": "TABLE", "file_format": "parquet", "is_incremental": False}
    out = []
    for row in rows.orderBy("dataset_id").collect():
        values = {k: v for k, v in row.asDict().items() if k in names}
        out.append(Dataset(**{**values, **{k: v for k, v in defaults.items() if values.get(k) is None}}))
    return out


def run_dataset(
    store: Store,
    dataset_id: int,
    rule_ids: str | list[int] | None = None,
    batch_id: int | None = None,
    run_id: int | None = None,
    now: datetime.datetime | None = None,
    created_by: str | None = None,
    frame: DataFrame | None = None,
) -> DatasetRun:
    """Run the rules of a dataset; ``frame`` replaces its rows (used for streams)."""
    spark = store.spark
    started = now or datetime.datetime.now()
    clock = (lambda: started) if now else datetime.datetime.now
    run_id = run_id or new_id()
    audit = _Audit(clock)

    def broken(step, message, error) -> DatasetRun:
        """A run that ends before any rule is evaluated is logged like the others."""
        audit.add(run_id, None, step, "FAILED", message, error)
        store.append_rows("rule_audit_log", audit.rows)
        entry = {"dataset_run_id": run_id, "batch_id": batch_id, "dataset_id": dataset_id, "run_status": "ERROR"}
        counts = ("evaluated", "successfull", "unsuccessfull", "error")
        entry |= {f"{c}_expectations": 0 for c in counts} | {"run_scope": "SELECTIVE" if rule_ids else "FULL"}
        entry |= {"created_by": created_by, "created_timestamp": started, "success_percent": 0.0}
        entry["run_time"] = (clock() - started).total_seconds()
        store.append_rows("dataset_run_log", [entry])
        return DatasetRun(ERROR, run_id, message=message or str(error))

    chosen = parse_rule_ids(rule_ids) if isinstance(rule_ids, (str, type(None))) else list(rule_ids)
    datasets, rows, state = side_by_side(
        [
            lambda: load_datasets(store),
            lambda: fetch_rules(store, dataset_id, chosen),
            lambda: read_state(store, dataset_id),
        ]
    )
    found = [d for d in datasets if d.dataset_id == dataset_id]
    if not found:
        message = f"Dataset ID {dataset_id} not found."
        return broken("VALIDATE_DATASET", message, message)
    dataset = found[0]
    if not rows:
        message = f"No rules to run for dataset {dataset_id}"
        return broken("RULES_FETCHING", message, message)
    audit.add(run_id, None, "RULES_FETCHING", "COMPLETED", f"{len(rows)} rules")

    rules, errors = [], {}
    for row in rows:
        try:
            rules.append(_rule(row))
        except RuleError as exc:
            errors[row["rule_config_id"]] = exc
    try:
        scope, watermark = build_scope(store, dataset, rules, now, frame, state, datasets)
    except Exception as exc:  # the dataset itself cannot be read
        return broken("VALIDATE_DATASET", None, exc)

    compiled, bad = compile_rules(scope, rules)
    errors.update(bad)
    began = clock()
    try:
        outcome, bad, staged = decide(store, scope, compiled, run_id, state)
        errors.update(bad)
        decided = clock()
        audit.add(run_id, None, "MAIN_QUERY", "COMPLETED", f"{len(outcome)} verdicts", since=began, until=decided)
        failed = [c for c in compiled if c.rule.rule_config_id in outcome and _failed(outcome, c)]
        allowed = [c for c in compiled if c.rule.rule_config_id in outcome]
        extras = capture(store, dataset, scope, failed, allowed, staged, run_id, started, audit)
    finally:
        store.unstage(run_id)

    for rule_id, exc in errors.items():
        audit.add(run_id, rule_id, "RULE_EXECUTION", "FAILED", None, exc, since=began, until=decided)
    # Rules share their passes, so each has taken as long as all of them.
    for rule_id in outcome:
        audit.add(run_id, rule_id, "RULE_EXECUTION", "COMPLETED", since=began, until=decided)
    write_results(store, dataset, allowed, outcome, extras, run_id, batch_id, started)
    view = None
    if any(r["unexpected_count"] for r in outcome.values()):
        try:
            view = failure_view(store, dataset, run_id, shown_verdicts(state, run_id, outcome))
            audit.add(run_id, None, "VIEW_CREATION", "COMPLETED", view)
        except Exception as exc:
            audit.add(run_id, None, "VIEW_CREATION", "FAILED", None, exc)
    store.append_rows("rule_audit_log", audit.rows)
    # The log row comes last but for the state: it tells that all else is written.
    return _finish(store, dataset, run_id, batch_id, rows, outcome, errors, chosen, watermark,
                   started, clock(), created_by, view)


def _rule(row) -> Rule:
    return Rule(
        rule_config_id=row["rule_config_id"],
        expectation=row["expectation_name"],
        kwargs=parse_kwargs(row["kwargs"]),
        dataset_id=row["dataset_id"],
        expectation_id=row["expectation_id"],
        severity=row["severity"],
        dimension=row["dimension"],
        column_name=row["column_name"],
        error_flag=row["error_flag"],
    )


def _failed(outcome, c: Compiled) -> bool:
    return (outcome[c.rule.rule_config_id]["unexpected_count"] or 0) > 0


def build_scope(store, dataset, rules, now=None, frame=None, state=None, datasets=None) -> tuple[Scope, str | None]:
    """The rows to validate, and the mark an incremental run leaves behind."""
    spark: SparkSession = store.spark
    state = read_state(store, dataset.dataset_id) if state is None else state
    marks = {int(i): tuple(m) for i, m in state["rules"].items()}
    others = LazyFrames(
        {
            d.dataset_name: lambda d=d: d.load(spark)
            for d in (load_datasets(store) if datasets is None else datasets)
            if d.dataset_id != dataset.dataset_id and d.dataset_name
        }
    )
    rows = dataset.load(spark) if frame is None else frame
    scope = Scope(
        df=rows,
        name=dataset.dataset_name,
        table_name=dataset.table_name,
        primary_key=tuple(dataset.primary_key()),
        candidate_key=tuple(dataset.candidate_key()),
        now=now,
        others=others,
        watermarks={r.rule_config_id: marks[r.rule_config_id] for r in rules if _recon(r) and r.rule_config_id in marks},
    )
    column = dataset.incremental_column()
    if not dataset.is_incremental or column is None or frame is not None:
        return scope, None
    mark = state["mark"]
    scope = scope.narrowed(column, mark)
    newest = scope.df.agg(F.max(F.col(quoted(find_column(rows, column)))).cast("string")).first()[0]
    return scope, newest or mark


def _recon(rule: Rule) -> bool:
    return rule.expectation.lower().endswith("row_count_to_equal_other_table")


def collect_results(compiled: list[Compiled], scope: Scope) -> tuple[dict[int, dict], dict[int, Exception]]:
    """One result per rule.

    When the job fails, rules Spark rejects are set aside.  A job that fails
    while running is tried again pass by pass (a scan, a grouping, a frame);
    only the rules of the failing pass are then run one by one.
    """
    if not compiled:
        return {}, {}
    try:
        rows = results(compiled, scope).collect()
        return {r["rule_config_id"]: r.asDict() for r in rows}, {}
    except Exception as exc:
        if len(compiled) == 1:
            return {}, {compiled[0].rule.rule_config_id: exc}
    good, errors = analysed(compiled, scope)
    if errors:
        groups = [good]
    else:
        groups = passes(compiled)
        groups = groups if len(groups) > 1 else [[c] for c in compiled]
    outcome = {}
    for group in groups:
        more, bad = collect_results(group, scope)
        outcome.update(more)
        errors.update(bad)
    return outcome, errors


def decide(
    store: Store, scope: Scope, compiled: list[Compiled], run_id: int, state: dict
) -> tuple[dict[int, dict], dict[int, Exception], bool]:
    """Results and errors of the rules, and whether failing rows were staged on the way.

    Where failing rows are likely, the scan rules' verdicts come from the pass
    that stages them.  A dataset whose last run had no failure is first read
    for its verdicts alone, in the columns they need.
    """
    scans = [c for c in compiled if isinstance(c.spec, ScanSpec)]
    if not any(stageable(c) for c in scans) or state["failures"] == 0:
        return *collect_results(compiled, scope), False

    def together():
        try:
            return observed(store, scope, scans, run_id)
        except Exception:  # the rules at fault are found by running them without the capture
            return None

    others = [c for c in compiled if not isinstance(c.spec, ScanSpec)]
    found, (outcome, errors) = side_by_side([together, lambda: collect_results(others, scope)])
    if found is None:
        more, bad = collect_results(scans, scope)
        return {**outcome, **more}, {**errors, **bad}, False
    return {**outcome, **found}, errors, True


def capture(store, dataset, scope, failed, allowed, staged, run_id, started, audit) -> dict[int, dict]:
    """Write failing rows, keys and value lists; return what the result rows add about them.

    Verdicts stand even when any of it fails: that is left to the audit trail.
    """
    extras: dict[int, dict] = {c.rule.rule_config_id: {} for c in allowed}
    kept = [c for c in failed if c.rule.error_flag and c.spec.failing is not None]
    table = failure_table_name(dataset.dataset_name)

    def guarded(task):
        began = audit.clock()
        try:
            return task()
        except Exception as exc:
            audit.add(run_id, None, "COMPUTE_ERROR_METRICS", "FAILED", None, exc, since=began)
            return {}

    def rows_first():
        """What is read back from the stored rows follows them; all else runs beside."""
        written = write_rows(store, dataset, scope, kept, staged, table, run_id, started, audit)
        told = {c.rule.rule_config_id: {"table": table} for c in written}
        found = side_by_side(
            [
                lambda: guarded(lambda: _value_details(store, scope, failed, written, table, run_id)),
                lambda: write_keys(store, dataset, scope, written, table, run_id, started, audit),
            ]
        )[0]
        for rule_id, more in found.items():
            told.setdefault(rule_id, {}).update(more)
        return told

    tasks = [
        *[lambda c=c: _examples(scope, c) for c in failed if isinstance(c.spec, ScanSpec) and c.spec.partial_list],
        *[lambda c=c: _combinations(c) for c in failed if c.label == "unexpected_rows_expectation"],
        *[lambda c=c: _matched(scope, c) for c in allowed if c.label == "expect_column_values_to_be_in_set"],
    ]
    found = side_by_side(
        [
            rows_first,
            lambda: write_lists(store, dataset, scope, allowed, run_id, started, audit),
            *[lambda t=t: guarded(t) for t in tasks],
        ]
    )
    for part in found:
        for rule_id, more in (part or {}).items():
            extras[rule_id].update(more)
    return extras


def write_rows(store, dataset, scope, kept, staged, table, run_id, started, audit) -> list[Compiled]:
    """Store the failing rows in one write; a failing write is halved down to the rule at fault."""
    if not kept:
        return []
    began = audit.clock()
    try:
        rows = stored_rows(scope, kept, store.staged(run_id) if staged else None)
        store.append_failures(
            table,
            rows.select(
                F.lit(run_id).cast("bigint").alias("dataset_run_id"),
                F.lit(dataset.dataset_id).cast("bigint").alias("dataset_id"),
                _stamp(started).alias("dq_load_timestamp"),
                "*",
            ),
        )
        audit.add(run_id, None, "INSERT_FAILED_RECORDS", "COMPLETED", table, since=began)
    except Exception as exc:
        if len(kept) == 1:
            audit.add(run_id, kept[0].rule.rule_config_id, "INSERT_FAILED_RECORDS", "FAILED", None, exc, since=began)
            return []
        middle = len(kept) // 2
        return [
            c
            for half in (kept[:middle], kept[middle:])
            for c in write_rows(store, dataset, scope, half, staged, table, run_id, started, audit)
        ]
    return kept


def key_columns(dataset: Dataset, c: Compiled) -> list[str]:
    """Columns that identify a failing row for this rule."""
    keys = dataset.primary_key()
    if not keys and c.label in CANDIDATE_KEY_CHECKS:
        keys = dataset.candidate_key()
        if not keys and c.label == "expect_compound_columns_to_be_unique":
            keys = name_list(c.rule.kwargs, "column_list")
    return keys


def write_keys(store, dataset, scope, written, table, run_id, started, audit) -> None:
    """Keys of the failing rows, read back from the rows just stored."""
    by_key: dict[tuple[str, ...], list[int]] = {}
    began = audit.clock()
    try:
        for c in written:
            names = tuple(find_column(scope.df, n) for n in key_columns(dataset, c))
            if names:
                by_key.setdefault(names, []).append(c.rule.rule_config_id)
        frames = []
        for names, rule_ids in by_key.items():
            rows = store.spark.table(store.name(table)).where(F.col("dataset_run_id") == run_id)
            frames.append(
                rows.where(F.col("rule_config_id").isin(rule_ids)).select(
                    F.col("dataset_run_id").cast("bigint"),
                    F.col("rule_config_id").cast("bigint"),
                    F.lit(dataset.dataset_id).cast("bigint").alias("dataset_id"),
                    F.lit(dataset.table_name or dataset.dataset_name).alias("table_name"),
                    F.to_json(F.struct(*[F.col(quoted(n)) for n in names])).alias("failed_key"),
                    _stamp(started).alias("load_timestamp"),
                )
            )
        if frames:
            store.append("failed_row_keys", reduce(DataFrame.unionByName, frames), one_day=True)
            audit.add(run_id, None, "CAPTURE_FAILED_KEYS", "COMPLETED", since=began)
    except Exception as exc:
        audit.add(run_id, None, "CAPTURE_FAILED_KEYS", "FAILED", None, exc, since=began)


def _value_details(store, scope: Scope, failed, written, table, run_id) -> dict[int, dict]:
    """Profiles and frequent values: of stored rows where all failing rows were stored, else of the dataset."""
    stored = [c for c in written if details.has_values(c) and row_limit(c) is None]
    ids = {c.rule.rule_config_id for c in stored}
    frames = [details.failing_value_counts([c for c in failed if c.rule.rule_config_id not in ids], scope)]
    if stored:
        frames.append(details.stored_value_counts(stored, scope, store.failing_rows(table, run_id)))
    frames = [f for f in frames if f is not None]
    if not frames:
        return {}
    # Profile and frequent values both read the counts; without this each would make them anew.
    values = reduce(DataFrame.unionByName, frames).persist()
    try:
        found = details.failure_details(values).collect()
    finally:
        values.unpersist()
    columns = {c.rule.rule_config_id: c.spec.profile for c in failed}
    out = {}
    for row in found:
        profile = {k: v for k, v in row.asDict().items() if k.startswith("error_")}
        profile["column_name"] = columns[row["rule_config_id"]]
        listed = {r["value"]: r["rows"] for r in row["listed"] or []}
        out[row["rule_config_id"]] = {
            "profile": profile,
            "counts": {"value_counts_without_nan": listed},
        }
    return out


def _examples(scope: Scope, c: Compiled) -> dict[int, dict]:
    rows = details.example_rows(c, scope).collect()
    return {c.rule.rule_config_id: {"examples": [json.loads(r["row"]) for r in rows]}}


def _combinations(c: Compiled) -> dict[int, dict]:
    query = c.spec.failing()
    columns = query_profile_columns(query, c.rule)
    rows = combination_profile(query, columns).collect() if columns else []
    if not rows:
        return {}
    names = ",".join(columns)
    profile = {
        "columns_name": names,
        "error_total_count": rows[0]["error_total_count"],
        "error_unique_count": rows[0]["error_unique_count"],
    }
    counts = {"columns_name": names, "value_counts": {r["value"]: r["rows"] for r in rows}}
    return {c.rule.rule_config_id: {"profile": profile, "counts": counts}}


def _matched(scope: Scope, c: Compiled) -> dict[int, dict]:
    """Rows per allowed value of a set check."""
    rows = details.matched_value_counts(scope, c.rule).collect()
    matched = {
        "matched_value_counts": {r["value"]: r["rows"] for r in rows},
        "distinct_match_count": sum(r["spellings"] for r in rows),
    }
    return {c.rule.rule_config_id: {"matched": matched}}


def write_lists(store, dataset, scope: Scope, compiled: list[Compiled], run_id, started, audit) -> None:
    """Whole value lists of rules on distinct values and on the mode, written where they are computed."""

    def task(c: Compiled):
        rows = details.value_lists(scope, c).select(
            F.lit(run_id).cast("bigint").alias("dataset_run_id"),
            F.lit(dataset.dataset_id).cast("bigint").alias("dataset_id"),
            F.lit(c.rule.rule_config_id).cast("bigint").alias("rule_config_id"),
            "kind",
            "value",
            "rows",
            _stamp(started).alias("listed_timestamp"),
        )
        store.append("value_lists", rows, one_day=True)

    for c in compiled:
        if c.label != "expect_column_most_common_value_to_be_in_set" and "_distinct_values_to_" not in c.label:
            continue
        began = audit.clock()
        try:
            task(c)
            audit.add(run_id, c.rule.rule_config_id, "LIST_VALUES", "COMPLETED", since=began)
        except Exception as exc:  # a verdict stands without its list
            audit.add(run_id, c.rule.rule_config_id, "LIST_VALUES", "FAILED", None, exc, since=began)


def _stamp(moment: datetime.datetime):
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def write_results(store, dataset, compiled, outcome, extras, run_id, batch_id, started) -> None:
    rows, recon = [], []
    for c in compiled:
        rule, result = c.rule, outcome[c.rule.rule_config_id]
        extra = extras.get(rule.rule_config_id, {})
        told = json.loads(result["details"]) if result["details"] else {}
        summary = {
            k: result[k]
            for k in (
                "element_count",
                "unexpected_count",
                "unexpected_percent",
                "missing_count",
                "missing_percent",
                "unexpected_percent_total",
                "unexpected_percent_nonmissing",
            )
        }
        summary["failed_records_table"] = extra.get("table")
        observed = result["observed_json"]
        if observed is None and result["observed_value"] is not None:
            observed = json.dumps(result["observed_value"])
        rows.append(
            {
                **{k: v for k, v in result.items() if k not in ("observed_value", "observed_json")},
                "batch_id": batch_id,
                "dataset_run_id": run_id,
                "dataset_id": dataset.dataset_id,
                "expectation_id": rule.expectation_id,
                "run_name": f"DQ_RUN_{run_id}",
                "run_timestamp": started,
                "dataset_name": dataset.dataset_name,
                "expectation_config": rule.config_json(),
                "results": json.dumps(summary),
                "details": _json({**told, **extra.get("matched", {})}),
                "observed_value": observed,
                "partial_unexpected_counts": _json(extra.get("counts")),
                "partial_unexpected_list": _json(extra.get("examples")),
                "unexpected_rows": _json(extra.get("profile")),
                "dimension": rule.dimension,
            }
        )
        recon.extend(_recon_rows(dataset, c, told, run_id, started))
    side_by_side(
        [lambda: store.append_rows("rule_results", rows), lambda: store.append_rows("recon_results", recon)]
    )


def _json(value) -> str | None:
    return json.dumps(value, default=str) if value else None


# Names of the compared counts in reconciliation results; the two
# ``validation_logic`` texts below are fixed as well.
VALIDATIONS = {"total": "TOTAL_COUNT", "active": "ACTIVE_COUNT", "inactive": "INACTIVE_COUNT"}


def _recon_rows(dataset, c: Compiled, told: dict, run_id, started) -> list[dict]:
    common = {
        "dataset_run_id": run_id,
        "dataset_id": dataset.dataset_id,
        "rule_config_id": c.rule.rule_config_id,
        "audit_timestamp": started,
    }
    if c.label == "expect_table_row_count_to_equal_other_table":
        return [
            {
                **common,
                "layer": "CONFORMED",
                "data_source": source_label(c.rule),
                "table_name": dataset.dataset_name,
                "validation_on": VALIDATIONS[name],
                "core_value": str(part["core"]),
                "conformed_value": str(part["conformed"]),
                "result": part["result"],
                "validation_logic": "WHEN CORE_VALUE = CONFORMED_VALUE THEN PASS ELSE FAIL",
            }
            for name, part in told.items()
        ]
    if c.label == "expect_table_row_count_to_equal_source_file":
        part = told["source_to_core"]
        return [
            {
                **common,
                "layer": "CORE",
                "data_source": part["source_label"],
                "table_name": c.rule.kwargs.get("target_table") or dataset.table_name or dataset.dataset_name,
                "validation_on": "SOURCE_TO_CORE_COUNT",
                "src_value": part["src"],
                "core_value": part["core"],
                "result": part["result"],
                "validation_logic": "WHEN SRC_VALUE = CORE_VALUE THEN PASS ELSE FAIL",
            }
        ]
    return []


def _finish(store, dataset, run_id, batch_id, rows, outcome, errors, chosen, watermark,
            started, ended, created_by, view=None) -> DatasetRun:
    codes = {r["rule_config_id"]: ERROR for r in rows}
    for rule_id, result in outcome.items():
        if rule_id not in errors:
            codes[rule_id] = SUCCESS if result["is_success"] else FAILED
    counts = {code: sum(1 for c in codes.values() if c == code) for code in (SUCCESS, FAILED, ERROR)}
    code = ERROR if counts[ERROR] else FAILED if counts[FAILED] else SUCCESS
    status = {ERROR: "ERROR", FAILED: "FAILURE", SUCCESS: "SUCCESS"}[code]
    store.append_rows(
        "dataset_run_log",
        [
            {
                "dataset_run_id": run_id,
                "batch_id": batch_id,
                "dataset_id": dataset.dataset_id,
                "run_time": (ended - started).total_seconds(),
                "evaluated_expectations": len(codes),
                "successfull_expectations": counts[SUCCESS],
                "unsuccessfull_expectations": counts[FAILED],
                "error_expectations": counts[ERROR],
                "run_status": status,
                "created_by": created_by,
                "success_percent": counts[SUCCESS] * 100.0 / len(codes),
                "created_timestamp": started,
                "max_validated_timestamp": _moment(watermark),
                "source_sql": dataset.custom_sql or dataset.table_name or dataset.path,
                "failure_view": view,
                "run_scope": "SELECTIVE" if chosen else "FULL",
            }
        ],
    )
    mark = _moment(watermark)
    change_state(
        store,
        dataset.dataset_id,
        after_run(run_id, not chosen, counts[FAILED], counts[ERROR], None if mark is None else str(mark), outcome),
    )
    return DatasetRun(code, run_id, status, codes, {k: str(v) for k, v in errors.items()})


def _moment(text: str | None) -> datetime.datetime | None:
    if text is None:
        return None
    return datetime.datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", text)).replace(tzinfo=None)


