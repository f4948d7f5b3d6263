"""Whole runs through the store: results, captures, isolation, scopes, projects."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from plumbline.plans import reports
from plumbline.plans.pivot import failure_pivot
from plumbline.plans.project import run_project
from plumbline.plans.rules import failed_in_latest_run, register_dataset, register_rules
from plumbline.plans.runner import ERROR, FAILED, SUCCESS, load_datasets, run_dataset
from plumbline.rule import Rule
from plumbline.sources.datasets import Dataset
from plumbline.sources.store import RETENTION_DAYS, Store, failure_table_name, new_id
from tests.samples import EMAIL

NOW = datetime.datetime(2026, 3, 1, 12, 0, 0)


def rule(rule_id, expectation, dataset_id=1, error_flag=True, **kwargs):
    return Rule(rule_id, expectation, kwargs, dataset_id=dataset_id, severity="HIGH", error_flag=error_flag)


RULES = [
    rule(1, "expect_column_values_to_not_be_null", column="STATUS"),
    rule(2, "expect_column_values_to_be_between", column="SCORE", min_value=0, max_value=100),
    rule(3, "expect_column_values_to_be_unique", column="USER_ID"),
    rule(4, "expect_column_values_to_match_regex", column="EMAIL", regex=EMAIL, mostly=0.5),
    rule(5, "expect_table_row_count_to_be_between", min_value=1, max_value=10),
    rule(6, "expect_column_values_to_be_in_set", column="STATUS", value_set=["Active", "Inactive", "Pending"]),
    rule(7, "unexpected_rows_expectation", unexpected_rows_query="SELECT * FROM users WHERE SCORE > 1000 AND STATUS = 'Active'"),
    rule(8, "expect_column_values_to_be_null", column="ISSUES"),
    rule(9, "expect_column_values_to_not_be_null", error_flag=False, column="EMAIL"),
    rule(10, "expect_column_value_z_scores_to_be_less_than", column="SCORE", threshold=3),
]


@pytest.fixture()
def users(spark, store, defects, tmp_path):
    path = str(tmp_path / "users")
    defects.repartition(3).write.parquet(path)
    dataset = Dataset(1, "users", path=path, project_id=10, primary_key_columns='{"primary_key": ["ROW_ID"]}')
    register_dataset(store, dataset, "tester", NOW)
    return dataset


def test_run_writes_everything(spark, store, users):
    register_rules(store, RULES, "tester", NOW)
    run = run_dataset(store, 1, now=NOW, created_by="tester")
    assert run.code == FAILED and run.status == "FAILURE"
    passed = {i for i, c in run.codes.items() if c == SUCCESS}
    assert passed == {4, 8} and not run.errors

    results = {r["rule_config_id"]: r for r in store.read("rule_results").collect()}
    assert len(results) == 10
    assert results[2]["unexpected_count"] == 6 and results[2]["missing_count"] == 1
    profile = json.loads(results[2]["unexpected_rows"])
    assert (profile["error_total_count"], profile["error_unique_count"]) == (6, 5)
    assert (profile["error_min_value"], profile["error_max_value"]) == (-2147483648.0, 2147483647.0)
    counts = json.loads(results[2]["partial_unexpected_counts"])["value_counts_without_nan"]
    assert counts["1000000"] == 2 and len(counts) == 5
    assert json.loads(results[3]["partial_unexpected_counts"])["value_counts_without_nan"] == {"166": 3, "101": 2}
    assert json.loads(results[6]["details"])["matched_value_counts"]["Active"] > 40
    assert json.loads(results[10]["partial_unexpected_list"]) == [{"SCORE": 2147483647}]
    assert json.loads(results[7]["unexpected_rows"])["error_unique_count"] == 2

    failures = spark.table(store.name(failure_table_name("users")))
    per_rule = {r["rule_config_id"]: r["count"] for r in failures.groupBy("rule_config_id").count().collect()}
    assert per_rule == {1: 3, 2: 6, 3: 5, 4: 9, 6: 3, 7: 3, 10: 1}
    keys = store.read("failed_row_keys")
    assert keys.count() == sum(per_rule.values())
    assert keys.where("rule_config_id = 3").select("failed_key").distinct().count() == 5
    assert json.loads(keys.where("rule_config_id = 10").first()["failed_key"]) == {"ROW_ID": 53}

    log = store.read("dataset_run_log").first()
    assert (log["evaluated_expectations"], log["successfull_expectations"], log["unsuccessfull_expectations"]) == (10, 2, 8)
    assert log["run_scope"] == "FULL" and log["success_percent"] == 20.0
    steps = {r["step_name"] for r in store.read("rule_audit_log").collect()}
    assert {"RULES_FETCHING", "MAIN_QUERY", "INSERT_FAILED_RECORDS", "CAPTURE_FAILED_KEYS", "RULE_EXECUTION"} <= steps

    pivot = failure_pivot(store, users, run.dataset_run_id)
    header = next(c for c in pivot.columns if c.endswith("_2"))
    assert header == "SCORE_NUMERIC_RANGE_CHECK(0_100)_2"
    assert pivot.where(F.col(f"`{header}`") == "FAIL").count() == 6
    table_level = next(c for c in pivot.columns if c.endswith("_5"))
    assert {r[0] for r in pivot.select(F.col(f"`{table_level}`")).collect()} == {"FAIL - TABLE CHECK"}
    assert spark.table(store.name("vw_users_dq_failure")).count() == pivot.count()
    assert log["failure_view"] == store.name("vw_users_dq_failure") and log["source_sql"] == users.path

    rows = reports.run_results(store.read("rule_results"), store.read("rule_config"), 1).collect()
    assert [r["is_success"] for r in rows] == [False] * 8 + [True] * 2
    assert reports.pass_rate(store.read("rule_results")).first()["pass_percent"] == 20


def test_errors_stay_with_their_rule(store, users):
    register_rules(
        store,
        [
            RULES[0],
            rule(21, "expect_column_values_to_not_be_null", column="NO_SUCH"),
            rule(22, "expect_column_values_to_be_between", column="SCORE", min_value=1),
            rule(23, "unexpected_rows_expectation", unexpected_rows_query="SELECT nothing FROM nowhere"),
            rule(24, "unexpected_rows_expectation",
                 unexpected_rows_query="SELECT raise_error('x') AS r FROM users WHERE SCORE > 0"),
            rule(25, "unexpected_rows_expectation", unexpected_rows_query="SELECT * FROM users WHERE 1 / (SCORE - SCORE) > 0"),
        ],
    )
    store.append_rows("rule_config", [{"rule_config_id": 26, "expectation_id": 2, "dataset_id": 1,
                                       "kwargs": "{not json", "is_active": True}])
    run = run_dataset(store, 1, now=NOW)
    assert run.code == ERROR
    assert {i for i, c in run.codes.items() if c == ERROR} >= {21, 22, 23, 25, 26}
    assert run.codes[1] == FAILED
    log = store.read("dataset_run_log").first()
    assert log["run_status"] == "ERROR" and log["unsuccessfull_expectations"] >= 1


def test_unknown_dataset_and_no_rules(store, users):
    assert run_dataset(store, 99, now=NOW).code == ERROR
    assert run_dataset(store, 1, now=NOW).code == ERROR
    log = store.read("dataset_run_log").collect()
    assert [(r["run_status"], r["evaluated_expectations"]) for r in log] == [("ERROR", 0)] * 2
    assert len({r["dataset_run_id"] for r in log}) == 2
    audited = {r["dataset_run_id"] for r in store.read("rule_audit_log").collect()}
    assert audited == {r["dataset_run_id"] for r in log}


def test_selective_run_and_retry(store, users):
    register_rules(store, RULES[:4], now=NOW)
    run_dataset(store, 1, now=NOW)
    failed = sorted(r[0] for r in failed_in_latest_run(store.read("rule_results"), 1).collect())
    assert failed == [1, 2, 3]
    again = run_dataset(store, 1, rule_ids=",".join(map(str, failed)), now=NOW)
    assert sorted(again.codes) == failed
    scopes = [r["run_scope"] for r in store.read("dataset_run_log").orderBy("dataset_run_id").collect()]
    assert scopes == ["FULL", "SELECTIVE"]
    assert again.dataset_run_id > 0


def test_incremental_run_validates_new_rows_only(spark, store, tmp_path):
    path = str(tmp_path / "events")

    def write(rows):
        spark.createDataFrame(rows, "id long, at timestamp_ntz, v int").write.mode("append").parquet(path)

    day = datetime.datetime(2026, 1, 1)
    write([(i, day + datetime.timedelta(hours=i), i) for i in range(10)])
    register_dataset(store, Dataset(1, "events", path=path, is_incremental=True, incr_date_column_2="AT"), now=NOW)
    register_rules(store, [rule(1, "expect_column_values_to_be_between", column="v", min_value=0, max_value=5)], now=NOW)
    counts = []
    for later in ([], [], [(i, day + datetime.timedelta(hours=i), 1) for i in range(10, 13)]):
        if later:
            write(later)
        run = run_dataset(store, 1, now=NOW)
        row = store.read("rule_results").where(F.col("dataset_run_id") == run.dataset_run_id).first()
        counts.append((row["element_count"], row["unexpected_count"]))
    assert counts == [(10, 4), (0, 0), (3, 0)]


def test_project_run(store, users, spark, tmp_path):
    other = str(tmp_path / "other")
    spark.range(5).write.parquet(other)
    register_dataset(store, Dataset(2, "other", path=other, project_id=10), now=NOW)
    register_dataset(
        store, Dataset(3, "query", "QUERY", custom_sql=f"SELECT id FROM parquet.`{other}`", project_id=10), now=NOW
    )
    register_dataset(store, Dataset(4, "unused", path=other, project_id=10), now=NOW)
    register_rules(
        store,
        [
            RULES[0],
            rule(31, "expect_table_row_count_to_equal", dataset_id=2, value=5),
            rule(32, "expect_table_row_count_to_equal_other_table", dataset_id=3, other_dataset_name="other", scd_type=0),
        ],
        now=NOW,
    )
    run = run_project(store, 10, now=NOW)
    assert (run.datasets_total, run.datasets_run, run.datasets_skipped) == (4, 3, 1)
    assert (run.passed, run.failed, run.errored, run.status, run.batch_id) == (2, 1, 0, "FAILURE", run.batch_id)
    assert {r["batch_id"] for r in store.read("dataset_run_log").collect()} == {run.batch_id}
    assert {r["batch_id"] for r in store.read("rule_results").collect()} == {run.batch_id}
    assert store.read("project_run_log").first()["run_status"] == "FAILURE"
    assert run_project(store, 77).status == "NO_DATASETS"


def test_candidate_keys_when_there_is_no_primary_key(store, spark, tmp_path):
    path = str(tmp_path / "pairs")
    spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (3, 1, "c")], "a int, b int, n string").write.parquet(path)
    register_dataset(store, Dataset(1, "pairs", path=path, candidate_key_columns="n"), now=NOW)
    register_rules(
        store,
        [
            rule(1, "expect_compound_columns_to_be_unique", column_list=["a", "b"]),
            rule(2, "expect_column_pair_values_a_to_be_greater_than_b", column_A="a", column_B="b"),
            rule(3, "expect_column_values_to_be_in_set", column="n", value_set=["a"]),
        ],
        now=NOW,
    )
    run_dataset(store, 1, now=NOW)
    keys = {(r["rule_config_id"], r["failed_key"]) for r in store.read("failed_row_keys").collect()}
    assert keys == {(1, '{"n":"b"}'), (2, '{"n":"a"}'), (2, '{"n":"b"}')}


def test_retention(store):
    old, edge, young = (NOW - datetime.timedelta(days=d, hours=h) for d, h in ((200, 0), (90, 1), (89, 23)))
    for moment in (old, edge, young, NOW):
        store.append_rows(
            "rule_audit_log",
            [{"dataset_run_id": 1, "procedure_name": "p", "step_name": "s", "start_timestamp": moment, "status": "OK"}],
        )
    report = {r["table"]: r["rows_deleted"] for r in store.clean_up(NOW)}
    assert report["rule_audit_log"] == 2 and set(report) == set(RETENTION_DAYS)
    left = sorted(r["start_timestamp"] for r in store.read("rule_audit_log").collect())
    assert left == [young, NOW]
    assert store.clean_up(NOW)[0]["rows_deleted"] == 0


def test_files_of_many_days_follow_the_days(spark, store, monkeypatch):
    """Rows of 120 days from 12 tasks: a file a day, not a file a task and day; days are dropped some at a time."""
    monkeypatch.setattr("plumbline.sources.store.DROPPED_AT_ONCE", 7)
    moment = F.lit(NOW.isoformat(sep=" ")).cast("timestamp_ntz") - F.make_dt_interval(F.col("id") % 120, F.col("id") % 3)
    rows = spark.range(0, 6000, 1, 12).select(F.col("id").alias("dataset_run_id"), moment.alias("start_timestamp"))
    rows = rows.unionByName(spark.sql("SELECT -1L AS dataset_run_id, CAST(NULL AS TIMESTAMP_NTZ) AS start_timestamp"))
    store.append("rule_audit_log", rows)
    held = spark.table(store.name("rule_audit_log"))
    assert held.count() == 6001 and held.where("step_name IS NOT NULL").isEmpty()
    assert len(held.inputFiles()) <= 2 * (120 + 1)
    old = rows.where(F.col("start_timestamp") < NOW - datetime.timedelta(days=90)).count()
    assert 0 < old < 1500 + 50
    assert [r["rows_deleted"] for r in store.clean_up(NOW, {"rule_audit_log": 90})] == [old]
    left = store.read("rule_audit_log")
    assert left.count() == 6001 - old
    assert left.where(F.col("start_timestamp") < NOW - datetime.timedelta(days=90)).isEmpty()


def test_values_are_counted_once_for_profile_and_list(store, users, monkeypatch):
    """Both readers of the failing values share one count, which is let go afterwards."""
    from plumbline.plans import details

    seen, read = [], details.failure_details

    def watched(values):
        seen.append((values, values.storageLevel.useMemory))
        return read(values)

    monkeypatch.setattr(details, "failure_details", watched)
    register_rules(store, RULES[:3], now=NOW)
    run_dataset(store, 1, now=NOW)
    assert [held for _, held in seen] == [True]
    assert not seen[0][0].storageLevel.useMemory
    told = [json.loads(r["unexpected_rows"]) for r in store.read("rule_results").where("unexpected_rows IS NOT NULL").collect()]
    assert told and all(t["error_total_count"] > 0 for t in told)


def test_runs_of_the_suite_overlap(spark):
    """Runs of different datasets share the machine, and each has all its results."""
    from plumbline.suite import product_queries

    store = product_queries.store_of_runs(spark, "/root/testdata/sf0.001")
    log = store.read("dataset_run_log").collect()
    assert sorted(r["dataset_id"] for r in log) == list(range(1, 10))
    spans = {r["dataset_id"]: (r["created_timestamp"], r["created_timestamp"] + datetime.timedelta(seconds=r["run_time"])) for r in log}
    assert max(spans[i][0] for i in range(4, 9)) < min(spans[i][1] for i in range(4, 9))
    codes = {r["dataset_id"]: r["run_status"] for r in log}
    assert codes == {1: "FAILURE", 2: "SUCCESS", 3: "SUCCESS", 4: "FAILURE", 5: "FAILURE", 6: "FAILURE", 7: "FAILURE", 8: "ERROR", 9: "FAILURE"}


def test_store_ids_and_names(store):
    made = [new_id() for _ in range(5000)]
    assert made == sorted(set(made))
    assert failure_table_name("My data-set 1") == "my_data_set_1_dq_failure"
    assert isinstance(store, Store) and load_datasets(store) == []


def test_csv_dataset(spark, store, defects, tmp_path):
    """The defect sample as a CSV file with a declared schema; empty fields are NULL."""
    path = str(tmp_path / "csv")
    defects.coalesce(1).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in defects.schema.fields)
    dataset = Dataset(1, "sample", path=path, file_format="csv", file_schema=schema, file_options='{"header": "true"}')
    register_dataset(store, dataset, now=NOW)
    register_rules(store, [RULES[0], RULES[1], rule(3, "expect_column_values_to_be_null", column="ISSUES")], now=NOW)
    assert run_dataset(store, 1, now=NOW).codes == {1: FAILED, 2: FAILED, 3: SUCCESS}
    rows = {r["rule_config_id"]: r["unexpected_count"] for r in store.read("rule_results").collect()}
    assert rows == {1: 3, 2: 6, 3: 0}


def test_long_sets_on_groups(spark):
    from plumbline.operators import check

    df = spark.range(3000).select((F.col("id") % 2000).alias("v"))
    row = check(df, "expect_column_distinct_values_to_be_in_set", {"column": "v", "value_set": list(range(1500))}).first()
    assert (row["unexpected_count"], row["element_count"]) == (500, 3000)
    row = check(df, "expect_column_most_common_value_to_be_in_set", {"column": "v", "value_set": list(range(1500))}).first()
    assert row["is_success"] and row["observed_value"] == 2.0


def test_capture_failure_leaves_the_verdict(store, users, monkeypatch):
    """A rule whose rows cannot be written keeps its verdict; the others are captured."""
    register_rules(store, RULES[:3], now=NOW)
    write = Store.append_failures

    def refuse_rule_2(self, table, rows):
        if not rows.where("map_contains_key(failed_rules, 2L)").isEmpty():
            raise RuntimeError("no space")
        write(self, table, rows)

    monkeypatch.setattr(Store, "append_failures", refuse_rule_2)
    run = run_dataset(store, 1, now=NOW)
    assert run.codes == {1: FAILED, 2: FAILED, 3: FAILED}
    failures = store.spark.table(store.name("users_dq_failure"))
    assert {r[0] for r in failures.select("rule_config_id").distinct().collect()} == {1, 3}
    broken = store.read("rule_audit_log").where("status = 'FAILED'").collect()
    assert [(r["rule_config_id"], r["step_name"]) for r in broken] == [(2, "INSERT_FAILED_RECORDS")]


def test_custom_rows_are_captured(spark, store, users):
    """A subset of the columns in another case, a column of its own, and a repeated name."""
    query = "SELECT row_id, Score AS SCORE, SCORE * 2 AS twice, 1 AS why, 2 AS why FROM users WHERE SCORE > 1000"
    register_rules(store, [rule(1, "unexpected_rows_expectation", unexpected_rows_query=query), RULES[7]], now=NOW)
    run = run_dataset(store, 1, now=NOW)
    rows = spark.table(store.name("users_dq_failure")).where("rule_config_id = 1").collect()
    found = store.read("rule_results").where("rule_config_id = 1").first()["unexpected_count"]
    assert run.codes == {1: FAILED, 8: SUCCESS}
    assert len(rows) == found > 0
    for row in rows:
        assert row["SCORE"] > 1000 and row["ROW_ID"] is not None and row["STATUS"] is None
        assert json.loads(row["query_columns"])["why"] == 1 and json.loads(row["query_columns"])["why_2"] == 2
    keys = store.read("failed_row_keys").where("rule_config_id = 1")
    assert {json.loads(r["failed_key"])["ROW_ID"] for r in keys.collect()} == {r["ROW_ID"] for r in rows}


def test_a_dataset_nobody_names_does_no_harm(store, users):
    register_dataset(store, Dataset(2, "o", path="/no/such/path"), now=NOW)
    register_rules(
        store,
        [RULES[7], rule(30, "expect_table_row_count_to_equal_other_table", other_dataset_name="o", scd_type=0),
         rule(31, "unexpected_rows_expectation", unexpected_rows_query="SELECT * FROM users JOIN o ON true"),
         rule(32, "unexpected_rows_expectation",
              unexpected_rows_query="SELECT extract(year FROM current_date()) AS y FROM users WHERE SCORE IS NOT NULL AND 1 = 0"),
         rule(33, "unexpected_rows_expectation", unexpected_rows_query="SELECT o.* FROM users o WHERE o.SCORE IS NULL AND 1 = 0")],
        now=NOW,
    )
    run = run_dataset(store, 1, now=NOW)
    assert run.codes == {8: SUCCESS, 30: ERROR, 31: ERROR, 32: SUCCESS, 33: SUCCESS}


def test_views_of_the_user_stay(spark, store, users):
    spark.range(3).createOrReplaceTempView("users")
    register_rules(store, [RULES[6]], now=NOW)
    assert run_dataset(store, 1, now=NOW).codes == {7: FAILED}
    assert spark.table("users").columns == ["id"] and spark.table("users").count() == 3
    spark.catalog.dropTempView("users")
    assert run_dataset(store, 1, now=NOW).codes == {7: FAILED}
    assert not [t for t in spark.catalog.listTables() if t.name == "users"]


def test_runs_at_the_same_time_keep_apart(store, users):
    from plumbline.plans.parallel import side_by_side

    register_rules(store, RULES[:3], now=NOW)
    runs = side_by_side([lambda: run_dataset(store, 1, now=NOW) for _ in range(2)])
    ids = {r.dataset_run_id for r in runs}
    assert len(ids) == 2
    counts = store.read("failed_row_keys").groupBy("dataset_run_id").count().collect()
    assert {r["dataset_run_id"]: r["count"] for r in counts} == {i: 14 for i in ids}


def test_steps_have_times_of_their_own(store, users):
    register_rules(store, RULES[:3])
    run_dataset(store, 1)
    steps = store.read("rule_audit_log").orderBy("start_timestamp").collect()
    assert all(r["start_timestamp"] <= r["end_timestamp"] for r in steps)
    main = next(r for r in steps if r["step_name"] == "MAIN_QUERY")
    written = next(r for r in steps if r["step_name"] == "INSERT_FAILED_RECORDS")
    assert main["end_timestamp"] > main["start_timestamp"] and written["start_timestamp"] >= main["end_timestamp"]


def test_limits_keep_the_first_rows(spark, store, users):
    register_rules(store, [rule(1, "expect_column_values_to_be_between", column="SCORE", min_value=-10**10, max_value=5, failed_row_count=7),
                           rule(2, "expect_column_value_z_scores_to_be_less_than", column="SCORE", threshold=-5, failed_row_count=3)], now=NOW)
    run_dataset(store, 1, now=NOW)
    rows = spark.table(store.name("users_dq_failure"))
    first = [r[0] for r in users.load(spark).where("SCORE > 5").orderBy("ROW_ID").limit(7).select("ROW_ID").collect()]
    assert sorted(r["ROW_ID"] for r in rows.where("rule_config_id = 1").collect()) == first
    told = store.read("rule_results").where("rule_config_id = 2").first()["partial_unexpected_list"]
    assert len(json.loads(told)) == rows.where("rule_config_id = 2").count() == 3


def test_store_in_a_given_place(spark, tmp_path):
    store = Store(spark, "dq_placed", str(tmp_path / "placed")).create()
    store.append_rows("rule_audit_log", [{"dataset_run_id": 1, "start_timestamp": NOW}])
    assert list((tmp_path / "placed").rglob("*.parquet"))
    spark.sql("DROP DATABASE dq_placed CASCADE")
