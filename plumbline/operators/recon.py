"""Row-count reconciliation of a source table with the dataset of the rule.

Modes: plain counts, current-state tables (one row per key) and history tables
(active and inactive versions per key).  Incremental runs compare what changed
since the marks the last passing run left, each side on its own clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.arithmetic import json_object, literal, struct
from plumbline.functions.columns import find_column, quoted
from plumbline.operators.skew import BROADCAST_BYTES, bytes_of
from plumbline.operators.spec import (
    FrameSpec,
    Verdict,
    all_rows,
    combine_single_rows,
    count_if,
)
from plumbline.rule import Rule, RuleError, name_list, number
from plumbline.sources.datasets import Scope

# Argument defaults.
ACTIVE_FLAG_COLUMN = "IS_ACTIVE"
ACTIVE_VALUE = "Y"
INACTIVE_VALUE = "N"
SOURCE_DATE_COLUMN = "INSERT_DATE_TIME"
TARGET_DATE_COLUMN = "UPDATE_DATE_TIME"
TARGET_INSERT_COLUMN = "INSERT_DATE_TIME"


def _source(scope: Scope, rule: Rule) -> DataFrame:
    kw = rule.kwargs
    if kw.get("source_table"):
        parts = [kw.get("source_database"), kw.get("source_schema"), kw["source_table"]]
        full = ".".join(p for p in parts if p)
        try:
            return scope.lookup(kw["source_table"])
        except RuleError:
            return scope.lookup(full)
    if kw.get("other_dataset_name"):
        return scope.lookup(kw["other_dataset_name"])
    raise RuleError("source_table or other_dataset_name is required")


def source_label(rule: Rule) -> str:
    kw = rule.kwargs
    if kw.get("source_table"):
        parts = [kw.get("source_database"), kw.get("source_schema"), kw["source_table"]]
        return ".".join(p for p in parts if p)
    return str(kw.get("other_dataset_name"))


def _part(left: str, right: str) -> str:
    return struct(core=left, conformed=right, result=f"IF({left} = {right}, 'PASS', 'FAIL')")


def row_count_equal_other_table(scope: Scope, rule: Rule) -> FrameSpec:
    mode = int(number(rule.kwargs, "scd_type", 0))
    if mode not in (0, 1, 2):
        raise RuleError(f"scd_type must be 0, 1 or 2, got {mode}")
    source, target = _source(scope, rule), scope.whole
    if mode == 0:
        return _plain(source, target)
    keys = name_list(rule.kwargs, "partition_keys") or name_list(rule.kwargs, "compare_cols")
    if not keys:
        raise RuleError("partition_keys is required for scd_type 1 and 2")
    return _keyed(scope, rule, source, target, keys, mode)


def _plain(source: DataFrame, target: DataFrame) -> FrameSpec:
    def frame():
        return combine_single_rows(
            [source.agg(all_rows().alias("core")), target.agg(all_rows().alias("conformed"))]
        )

    def verdict(m):
        return Verdict(
            element_count=m("core"),
            unexpected_count=f"abs({m('core')} - {m('conformed')})",
            details=json_object(total=_part(m("core"), m("conformed"))),
            is_success=f"({m('core')} = {m('conformed')})",
        )

    return FrameSpec(frame, verdict)


def key_text(key: Column) -> Column:
    """Keys of the two sides meet as trimmed text."""
    return F.coalesce(F.trim(key.cast("string")), F.lit("NA"))


def distinct_keys(source: DataFrame, keys: list[str], date: str) -> DataFrame:
    """One row per key with its latest date; rows of a hot key collapse before the shuffle."""
    return source.groupBy(*[F.col(quoted(k)) for k in keys]).agg(
        F.max(F.col(quoted(date))).alias("__latest")
    )


def _key_texts(frame: DataFrame, keys: list[str]) -> DataFrame:
    return frame.select(*[key_text(F.col(quoted(k))).alias(f"__k{i}") for i, k in enumerate(keys)])


def keys_known(changed: DataFrame, known: DataFrame) -> DataFrame:
    """One row: how many of the changed keys are among the known ones.

    The known keys are all of a history, the changed ones what came after a
    mark.  So the history is filtered by them where it is read and only matches
    go on: by a broadcast where they are measured to fit one, else by a semi
    join, for which Spark may build a Bloom filter of the changed keys.
    """
    names = changed.columns
    wanted = changed.distinct()
    if bytes_of(wanted, names) <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    matched = known.join(wanted, names, "left_semi").distinct()
    return changed.join(matched, names, "left_semi").agg(all_rows().alias("core_inactive"))


def _keyed(scope, rule, source, target, keys, mode) -> FrameSpec:
    kw = rule.kwargs
    source_keys = [find_column(source, k) for k in keys]
    target_keys = [find_column(target, k) for k in keys]
    recon_mode = str(kw.get("recon_mode") or "incremental").strip().lower()
    date_name = kw.get("core_insert_date_col") or SOURCE_DATE_COLUMN
    updated_name = kw.get("conformed_update_date_col") or TARGET_DATE_COLUMN
    source_date = find_column(source, date_name)
    target_date = find_column(target, updated_name)

    marks = scope.watermarks.get(rule.rule_config_id) if recon_mode == "incremental" else None
    incremental = marks is not None and marks[0] is not None and marks[1] is not None

    updated = F.col(quoted(target_date))
    core_mark = conf_mark = F.lit(None).cast("string")
    changed, counted = source, target
    if incremental:
        # A key's latest date is after the mark just when some row of it is, so
        # both sides are filtered before they are grouped; the filters reach the scan.
        core_mark, conf_mark = F.lit(str(marks[0])), F.lit(str(marks[1]))
        changed = source.where(F.col(quoted(source_date)) > core_mark.cast(source.schema[source_date].dataType))
        counted = target.where(updated > conf_mark.cast(target.schema[target_date].dataType))
    latest = distinct_keys(changed, source_keys, source_date)

    active = inactive = F.lit(True)
    if mode == 2:
        state = F.col(quoted(find_column(target, kw.get("active_flag_col") or ACTIVE_FLAG_COLUMN)))
        active = state == F.lit(kw.get("active_value", ACTIVE_VALUE))
        inactive = state == F.lit(kw.get("inactive_value", INACTIVE_VALUE))
    both_states = mode == 2 and incremental

    def frame():
        frames = [
            latest.agg(
                all_rows().alias("core"),
                F.coalesce(F.max("__latest").cast("string"), core_mark).alias("core_mark"),
            ),
            counted.agg(
                count_if(active).alias("conformed"),
                count_if(inactive).alias("conformed_inactive"),
                F.coalesce(F.max(updated).cast("string"), conf_mark).alias("conf_mark"),
            ),
        ]
        if both_states:
            # Keys whose first row is not after the mark are those with any such row.
            seen = _insert_column(kw, target) or target_date
            known = target.where(F.col(quoted(seen)) <= conf_mark.cast(target.schema[seen].dataType))
            frames.append(keys_known(_key_texts(latest, source_keys), _key_texts(known, target_keys)))
        return combine_single_rows(frames)

    def verdict(m):
        pairs = {"total" if mode == 1 else "active": (m("core"), m("conformed"))}
        if both_states:
            pairs["inactive"] = (m("core_inactive"), m("conformed_inactive"))
        stored = None
        if recon_mode == "incremental":
            stored = json_object(core_watermark=m("core_mark"), conf_watermark=m("conf_mark"))
        return Verdict(
            element_count=m("core"),
            unexpected_count=" + ".join(f"abs({a} - {b})" for a, b in pairs.values()),
            observed_json=stored,
            details=json_object(**{name: _part(a, b) for name, (a, b) in pairs.items()}),
            is_success="(" + " AND ".join(f"{a} = {b}" for a, b in pairs.values()) + ")",
        )

    return FrameSpec(frame, verdict)


def _insert_column(kw: dict, target: DataFrame) -> str | None:
    """The target's insert-date column, when it has one apart from the update date."""
    given = kw.get("conformed_insert_date_col")
    updated = kw.get("conformed_update_date_col") or TARGET_DATE_COLUMN
    if given:
        name = find_column(target, given)
    else:
        name = next((c for c in target.columns if c.upper() == TARGET_INSERT_COLUMN), None)
    if name is None or name.lower() == updated.lower():
        return None
    return name


# Argument defaults of the audit-log check.
SYNC_LEVEL = "SOURCE_TO_CORE"
AUDIT_COLUMNS = {
    "target_table_col": "TARGET_TABLE",
    "source_count_col": "NUMBER_OF_RECORDS_SOURCE",
    "target_count_col": "NUMBER_OF_RECORDS_TARGET",
    "sync_date_col": "SYNC_START_DATE_TIME",
}
NO_RECORD = "NO_AUDIT_RECORD"


def latest_audit_entry(audit: DataFrame, rule: Rule, target_table: str) -> DataFrame:
    """One row: the last entry of the last day recorded for the target table.

    The latest timestamp lies on the latest day, so one ``max_by`` finds it.
    """
    names = {k: find_column(audit, rule.kwargs.get(k) or v) for k, v in AUDIT_COLUMNS.items()}
    table = F.col(quoted(names["target_table_col"]))
    when = F.col(quoted(names["sync_date_col"]))
    level = F.col(quoted(find_column(audit, "SYNC_LEVEL")))
    entry = F.struct(
        F.col(quoted(names["source_count_col"])).cast("bigint").alias("src"),
        F.col(quoted(names["target_count_col"])).cast("bigint").alias("core"),
        table.alias("target"),
    )
    wanted = (F.lower(table) == target_table.lower()) & (
        level == (rule.kwargs.get("sync_level") or SYNC_LEVEL)
    )
    picked = audit.where(wanted & when.isNotNull()).agg(
        F.max_by(entry, F.struct(when, entry)).alias("entry")
    )
    return picked.select("entry.src", "entry.core", "entry.target")


def row_count_equal_source_file(scope: Scope, rule: Rule) -> FrameSpec:
    audit_name = rule.kwargs.get("audit_control_table")
    if not audit_name:
        raise RuleError("audit_control_table is required")
    audit = scope.lookup(audit_name)
    target = rule.kwargs.get("target_table") or scope.table_name or scope.name
    # Table-name prefixes that are reported under another name.
    labels = rule.kwargs.get("source_labels") or {}

    def frame():
        return latest_audit_entry(audit, rule, target)

    def verdict(m):
        src, core, table = m("src"), m("core"), m("target")
        found = f"({src} IS NOT NULL OR {core} IS NOT NULL OR {table} IS NOT NULL)"
        same = f"({found} AND coalesce({src} = {core}, false))"
        first = f"split_part(split_part({table}, '.', 3), '_', 1)"
        renamed = " ".join(f"WHEN {literal(a)} THEN {literal(b)}" for a, b in labels.items())
        shown = f"CASE {first} {renamed} ELSE {first} END" if labels else first
        label = f"coalesce(nullif({shown}, ''), 'UNKNOWN')"
        part = struct(
            src=f"IF({found}, CAST({src} AS STRING), {literal(NO_RECORD)})",
            core=f"IF({found}, CAST({core} AS STRING), {literal(NO_RECORD)})",
            result=f"IF({same}, 'PASS', 'FAIL')",
            source_label=label,
        )
        return Verdict(
            element_count=f"coalesce({core}, 0)",
            unexpected_count=f"coalesce(abs({src} - {core}), 0)",
            details=json_object(source_to_core=part),
            is_success=same,
        )

    return FrameSpec(frame, verdict)
