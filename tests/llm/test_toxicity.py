"""Toxicity against a plain version, planted words and held-out labels."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import op12_toxicity as op

SF = "/root/testdata/sf0.1"


def plain_ftrl(rows, toxic, passes):
    """The same regression, one coordinate at a time."""
    z, n = {}, {}

    def weight(k):
        least = 0 if k == -1 else op.L1
        if abs(z.get(k, 0.0)) <= least:
            return 0.0
        return -(z[k] - math.copysign(least, z[k])) / ((op.BETA + math.sqrt(n[k])) / op.ALPHA + op.L2)

    for _ in range(passes):
        for row, wanted in zip(rows, toxic, strict=True):
            held = {k: weight(k) for k in [*row, -1]}
            slope = 1 / (1 + math.exp(-sum(held.values()))) - wanted
            for k, w in held.items():
                rate = (math.sqrt(n.get(k, 0.0) + slope**2) - math.sqrt(n.get(k, 0.0))) / op.ALPHA
                z[k] = z.get(k, 0.0) + slope - rate * w
                n[k] = n.get(k, 0.0) + slope**2
    return {k: weight(k) for k in z if weight(k)}


def test_weights_equal_the_plain_regression():
    draw = random.Random(1)
    toxic = [draw.random() < 0.3 for _ in range(200)]
    rows = [np.unique([draw.randrange(60) for _ in range(12)] + [99] * y) for y in toxic]
    intercept, features, weights = op.ftrl(rows, toxic, passes=2)
    wanted = plain_ftrl([r.tolist() for r in rows], toxic, 2)
    assert math.isclose(intercept, wanted.pop(-1, 0.0), rel_tol=1e-9, abs_tol=1e-12)
    assert set(features.tolist()) == set(wanted) and 99 in wanted
    assert len(wanted) < 61  # L1 leaves some coordinates out
    for k, w in zip(features.tolist(), weights, strict=True):
        assert math.isclose(w, wanted[k], rel_tol=1e-9)


def test_features_are_words_pairs_and_skip_pairs():
    hasher = op.Hasher()

    def found(text):
        return set(hasher.features([text])[1].tolist())

    assert found(None) == found("") == found("12 ?_! 7") == set()
    assert len(found("one")) == 1 and len(found("one two")) == 3 and len(found("one two three four")) == 4 + 3 + 2 + 1
    assert found("One, TWO") == found("one two") == found("one*** 7two")
    assert len(found("one two") & found("two one")) == 2  # pairs keep their order
    assert found("a x b") & found("a y b") >= found("a") | found("b")
    assert len(found("a x b") & found("a y b")) == 3  # with the skip pair
    owner, numbers = hasher.features(["one two", None, "three one"])
    apart = [set(numbers[owner == k].tolist()) for k in range(3)]
    assert apart == [found("one two"), set(), found("three one")]  # no pair joins two texts
    assert hasher.features([])[0].tolist() == []


def corpus(spark, rows=400):
    draw = random.Random(2)
    texts = []
    for k in range(rows):
        words = ["".join(draw.choices("abcdefg", k=4)) for _ in range(30)]
        toxic = k % 4 == 0
        if toxic:
            words[draw.randrange(30)] = draw.choice(["vile", "wretch"])
        texts.append((k, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    return docs, spark.createDataFrame([(k, y) for k, _, y in texts], "doc_id long, toxic int"), texts


def test_planted_words_are_found_in_any_length(spark):
    docs, labels, texts = corpus(spark)
    weights = op.train(docs, labels)
    assert 0 < len(weights.features) < 500
    long = " ".join(t for _, t, y in texts if not y)
    more = docs.unionByName(
        spark.createDataFrame([(1000, long), (1001, long + " vile"), (1002, None), (None, "Vile!")], "doc_id long, text string")
    )
    found = {r["doc_id"]: r["score"] >= op.THRESHOLD for r in op.score(more, weights).collect()}
    held = [(found[k], bool(y)) for k, _, y in texts if zlib.crc32(str(k).encode()) % 4 == 2]
    assert len(held) > 50 and all(a == b for a, b in held)
    assert not found[1000] and found[1001] and not found[1002] and found[None]


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels, _ = corpus(spark)
    turned = labels.withColumn("toxic", F.when(op.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = op.train(docs, labels), op.train(docs.repartition(3), turned.repartition(5))
    assert one.intercept == two.intercept and one.features.tolist() == two.features.tolist()
    assert one.weights.tolist() == two.weights.tolist()


def test_the_sample_is_bounded_and_the_intercept_corrected(spark):
    docs, labels, _ = corpus(spark)
    marks = op.marked(labels, "doc_id", "toxic")
    sample, counts = op.chosen(marks, 30)
    taken = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    assert counts[False] > 200 and 10 < taken[False] < 60 and 10 < taken[True] < 60
    few = op.train(docs, labels, rows=60)
    scores = [r["score"] for r in op.score(docs.where("doc_id % 4 > 0"), few).collect()]
    assert sum(s >= op.THRESHOLD for s in scores) < 10


def test_labels_of_one_kind_and_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "some words", "a", 1), (1, "some words", "b", 2), (2, None, None, 3), (None, "", None, 4)],
        "doc_id long, text string, score string, toxic int",
    )
    for label, wanted in ((0, 0.0), (1, 1.0), (None, 0.0)):
        labels = spark.createDataFrame([(1, label), (1, label), (None, 1), (99, label)], "doc_id long, toxic int")
        found = op.score(docs, op.train(docs, labels))
        assert found.columns == ["doc_id", "text", "toxic", "score"]
        assert [r["score"] for r in found.collect()] == [wanted] * 4
    assert op.score(docs.limit(0), op.Weights()).collect() == []
    missing = spark.createDataFrame([(77, 0), (78, 1), (79, 1), (80, 0)], "doc_id long, toxic int")
    assert {r["score"] for r in op.score(docs, op.train(docs, missing)).collect()} == {0.0}
    renamed = op.score(docs.select(F.col("text").alias("score"), "doc_id"), op.Weights(), text_col="score", name="score")
    assert renamed.columns == ["doc_id", "score"] and {r["score"] for r in renamed.collect()} == {0.0}


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = op.op12_toxicity(spark, SF)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = found.where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r for r in held if r["toxic"]], [r for r in held if not r["toxic"]]
    assert len(held) > 900
    assert sum(r["predicted"] for r in toxic) > 0.75 * len(toxic)
    assert sum(r["predicted"] for r in clean) < 0.01 * len(clean)
    assert all(0 <= r["score"] <= 1 for r in held)
