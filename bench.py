"""Times the headline queries and prints one JSON line.

Environment: ``BENCH_SF_DIR`` (tables), ``BENCH_CPUS`` (local cores),
``BENCH_REPEAT`` (timed repetitions, the median counts).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import tempfile
import time
import uuid

from pyspark.sql import functions as F

from plumbline import suite
from plumbline.operators.median import median_frame
from plumbline.plans.evaluate import evaluate
from plumbline.plans.rules import register_dataset, register_rules
from plumbline.plans.runner import run_dataset
from plumbline.rule import Rule
from plumbline.session import build_session
from plumbline.sources.datasets import Dataset, Scope
from plumbline.sources.store import Store
from plumbline.suite.run_queries import LINE_RULES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEAT = int(os.environ.get("BENCH_REPEAT", "3"))

HEADLINE = [
    "fused_run",
    "fused_capture",
    "failure_top_values",
    "failure_pivot",
    "values_in_long_set",
    "z_scores_below",
    "matches_regex",
    "not_matches_regex",
    "keys_unique",
    "keys_unique_failing",
    "texts_unique",
    "compound_unique",
    "compound_unique_failing",
    "median_between",
    "most_common_in_set",
    "distinct_in_set",
    "recon_history_full",
    "recon_current_state_incremental",
    "recon_history_incremental",
    "recon_history_first_seen",
    "latest_watermarks",
    "pass_fail_by_dimension",
]


def timed(action) -> float:
    """Median time of an action after one warm-up."""
    action()
    runs = []
    for _ in range(REPEAT):
        started = time.perf_counter()
        action()
        runs.append(time.perf_counter() - started)
    return round(statistics.median(runs), 4)


def drain(frame) -> None:
    """Execute the whole plan without moving rows to the driver."""
    frame.write.format("noop").mode("overwrite").save()


def run_times(spark) -> dict[str, float]:
    """A whole run of ``lineitem``'s rules through a store, with and without the failing rows."""
    times = {}
    for name, captured in (("run_dataset_capture", True), ("run_dataset_no_capture", False)):
        folder = tempfile.mkdtemp(prefix="plumbline-bench-")
        store = Store(spark, f"bench_{uuid.uuid4().hex[:8]}", folder).create()
        register_dataset(store, Dataset(1, "lineitem", path=f"{SF_DIR}/lineitem.parquet"))
        rules = [e[0] for e in LINE_RULES]
        rules = [Rule(r.rule_config_id, r.expectation, r.kwargs, dataset_id=1, error_flag=captured) for r in rules]
        register_rules(store, rules)
        times[name] = timed(lambda store=store: run_dataset(store, 1))
        spark.sql(f"DROP DATABASE {store.database} CASCADE")
    return times


def shuffle_mb(spark, action) -> float:
    """MB that an action's stages write to shuffles, from the status store."""
    tracker = spark.sparkContext._jsc.sc().statusStore()

    def written() -> int:
        stages = tracker.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = written()
    action()
    return round((written() - before) / 1e6, 3)


def main() -> None:
    spark = build_session(
        "plumbline-bench",
        master=f"local[{CPUS}]",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = suite.queries()
    times = {name: timed(lambda n=name: drain(queries[n](spark, SF_DIR))) for name in HEADLINE}

    # The same rules, once fused and once one job each.
    lineitem = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    rules = [entry[0] for entry in LINE_RULES]

    def one_by_one():
        for rule in rules:
            evaluate(Scope(lineitem, name="lineitem"), [rule]).collect()

    times["rules_fused"] = timed(lambda: evaluate(Scope(lineitem, name="lineitem"), rules).collect())
    times["rules_one_by_one"] = timed(one_by_one)
    times |= run_times(spark)
    value = F.col("l_extendedprice")
    for name, approximate in (("median_exact", False), ("median_approximate", True)):
        times[name] = timed(lambda a=approximate: median_frame(lineitem, value, value, a).collect())
    shuffled = {}
    for name in ("keys_unique_failing", "compound_unique_failing", "recon_history_full", "recon_history_incremental"):
        shuffled[name] = shuffle_mb(spark, lambda n=name: drain(queries[n](spark, SF_DIR)))
    spark.stop()
    found = re.search(r"sf([\d.]+)", SF_DIR)
    headline = sum(times[name] for name in HEADLINE)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(headline, 3),
                "unit": "sec",
                "queries": times,
                "shuffle_mb": shuffled,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )


if __name__ == "__main__":
    main()
