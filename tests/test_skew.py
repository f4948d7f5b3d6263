"""Hot keys: the salted paths give the same rows as the plain definition."""

from __future__ import annotations

import math
import random
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.operators import check, failing, skew
from plumbline.operators.median import median_frame, medians
from plumbline.operators.skew import group_counts, rows_beyond_first, rows_of_groups
from plumbline.operators.spec import group_rows


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows on one key, another third exact copies of one row."""
    random.seed(7)
    rows = [("hot", i, f"v{i}") for i in range(900)] + [("copy", 1, "same")] * 900 + [(None, 5, "n")] * 20
    rows += [(f"k{random.randint(0, 700)}", i, "x") for i in range(900)]
    random.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, a int, b string").repartition(6)


def test_rows_of_groups(hot):
    rows, df = hot
    counts = Counter(r[0] for r in rows)
    got = Counter(tuple(r) for r in rows_of_groups(df, ["k"], group_rows() > 1).collect())
    assert got == Counter(r for r in rows if counts[r[0]] > 1)


@pytest.mark.parametrize("parts", [1, 3, 32])
def test_rows_beyond_first(hot, monkeypatch, parts):
    monkeypatch.setattr(skew, "PARTS", parts)
    rows, df = hot
    order = [F.col(c).asc_nulls_first() for c in ("a", "b")]
    got = Counter(tuple(r) for r in rows_beyond_first(df, ["k"], group_rows() > 1, order).collect())
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    wanted = Counter()
    for members in groups.values():
        wanted.update(sorted(members, key=lambda r: (r[1], r[2]))[1:])
    assert got == wanted


@pytest.mark.parametrize("kind", ["spread", "two_values", "one_value", "hot_middle", "negative"])
@pytest.mark.parametrize("size", [1000, 1001])
def test_median_by_selection(spark, kind, size):
    random.seed(size)
    make = {
        "spread": lambda i: random.random() * 1e6,
        "two_values": lambda i: float(i % 2),
        "one_value": lambda i: 3.5,
        "hot_middle": lambda i: 10.0 if i % 3 else random.uniform(-5, 40),
        "negative": lambda i: -float(random.randint(0, 9)),
    }[kind]
    values = [make(i) for i in range(size)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(5)
    for sizes in ({}, {"sketch": 8, "steps": 3}, {"steps": 1, "bins": 1}):
        row = median_frame(df, F.col("v"), F.col("v"), **sizes).first()
        assert row["observed"] == statistics.median(values)
        assert (row["total"], row["missing"]) == (size + 1, 1)


@pytest.mark.parametrize("numbers", [0, 39, 40, 41, 60])
@pytest.mark.parametrize("sizes", [{}, {"sketch": 8, "steps": 50, "bins": 2}])
def test_median_with_nan(spark, numbers, sizes):
    """NaN ranks above every number, whichever way the median is found."""
    nan = float("nan")
    values = [float(k) for k in range(numbers)] + [nan] * 40
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    got = median_frame(df, F.col("v"), F.col("v"), **sizes).first()["observed"]
    middle = values[(len(values) - 1) // 2], values[len(values) // 2]
    wanted = sum(middle) / 2
    assert got == wanted or (got != got and wanted != wanted)


def test_medians_of_many_columns(spark):
    """Columns of every kind at once, each as if it were alone."""
    inf, nan = float("inf"), float("nan")
    draw = random.Random(3)
    columns = {
        "spread": [draw.gauss(0, 1e9) for _ in range(301)],
        "hot": [7.0] * 200 + [draw.random() * 20 for _ in range(101)],
        "huge": [draw.choice([-1.7e308, 1.7e308, 1e300]) for _ in range(301)],
        "infinite": [draw.choice([-inf, inf, 1.0]) for _ in range(301)],
        "few": [None] * 299 + [3.0, 4.0],
        "none": [None] * 301,
        "nans": [nan] * 301,
        "zeros": [draw.choice([0.0, -0.0]) for _ in range(301)],
    }
    rows = list(zip(*columns.values(), strict=True))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(4)
    row = medians(df, {c + "_": (F.col(c), F.col(c)) for c in columns}).first()
    for c, values in columns.items():
        assert row[f"{c}_total"] == 301 and row[f"{c}_missing"] == values.count(None)
        present = sorted(v for v in values if v is not None and v == v)
        if c == "nans":
            assert math.isnan(row[f"{c}_observed"])
        else:
            assert row[f"{c}_observed"] == (statistics.median(present) if present else None)
    empty = medians(df.limit(0), {"": (F.col("hot"), F.col("hot"))}).first()
    assert tuple(empty) == (0, 0, None)


@pytest.mark.parametrize("many", [False, True])
def test_long_texts_are_unique_by_value(spark, monkeypatch, many):
    """The hash step changes nothing, nor does skipping it when too many hashes repeat."""
    if many:
        monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    texts = [f"{i} " * 40 for i in range(30)] + ["again " * 40] * 3 + ["  ", None, "twice " * 50, "twice " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    kwargs = {"column": "t", "by_hash": True}
    row = check(df, "expect_column_values_to_be_unique", kwargs).first()
    assert (row["element_count"], row["missing_count"], row["unexpected_count"]) == (37, 2, 5)
    assert row["observed_value"] == 32
    rows = failing(df, "expect_column_values_to_be_unique", kwargs).collect()
    assert sorted(r["id"] for r in rows) == [30, 31, 32, 35, 36]


def test_group_keys_are_settled_in_the_checkpoint_folder(spark, hot):
    assert spark.sparkContext.getCheckpointDir()
    keys = group_counts(hot[1], ["k"])
    kept = skew.settled(keys)
    assert kept.count() == keys.count()
    assert "Aggregate" not in kept._jdf.queryExecution().optimizedPlan().toString()
