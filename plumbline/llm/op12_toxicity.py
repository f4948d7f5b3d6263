"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters, lower-cased.  A text's features are the distinct
hashes of its words, of its pairs of neighbours and of its pairs with one or
two words between (``GAPS``), each kind hashed apart, ``2 ** HASH_BITS`` in
all.  A feature is there or not, whatever the text's length.

Follow-the-regularised-leader keeps for each coordinate the sum of gradients,
less what its weight has made up for, and the sum of their squares, which sets
the coordinate's own rate.  A coordinate whose sum stays within ``L1`` has
weight zero, so the model is a short list of (feature, weight) and is broadcast
(at most 12 bytes for each of the 2 ** HASH_BITS features, some kB in practice).

The sample is bounded: about ``TRAIN_ROWS`` labelled documents of each class
(all, if fewer), those whose hashed id lies lowest, of at most ``TRAIN_CHARS``
characters.  They are learned from in the order of that hash, ``PASSES`` times,
in one task that sees ids and feature numbers alone.  Where a class is sampled
thinner than the other, the intercept is corrected for it.  Scoring streams
over all rows and whole texts without a shuffle.

Learned are rows whose fold, crc32 of the id as text mod 4, isn't 2.  An id
with several labels counts as toxic if one of them says so; of several texts
with one id the least is learned from.

Cases: a null text counts as empty; a text without words has the intercept's
score; where no row is labelled, or none toxic, or all, every score is 0, 0 or
1; rows without id are scored, not learned from, and are not held out; repeated
rows get equal scores; an empty table gives an empty result; other columns pass
through ``score`` untouched, but those named like an output are replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import by_batches, read, settle, ship

HASH_BITS = 20
GAPS = (1, 2, 3)
TRAIN_ROWS, TRAIN_CHARS = 6000, 20_000
PASSES = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 1.0
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Characters that are hashed together, and words whose hashes a task remembers.
SLICE, REMEMBERED = 1 << 20, 1 << 18

WORD = re.compile(r"[^\W\d_]+")


class Hasher:
    """Feature numbers of texts; hashes of words are remembered."""

    def __init__(self):
        self.seen: dict[str, int] = {}

    def word(self, word: str) -> int:
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            data = word.encode("utf-8", "surrogatepass")
            found = self.seen[word] = zlib.crc32(data) << 32 | zlib.adler32(data)
        return found

    def features(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The text and the number of each feature, repeats included."""
        words = [WORD.findall((t or "").lower()) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        hashes = np.array([self.word(w) for found in words for w in found], np.uint64)
        owners, numbers = [owner], [number(hashes, 0)]
        for gap in GAPS:
            same = owner[gap:] == owner[:-gap] if len(owner) > gap else np.zeros(0, bool)
            pairs = hashes[:-gap][same] * np.uint64(0x9E3779B97F4A7C15) + hashes[gap:][same] if len(same) else hashes[:0]
            owners.append(owner[gap:][same] if len(same) else owner[:0])
            numbers.append(number(pairs, gap))
        return np.concatenate(owners), np.concatenate(numbers)


def number(hashes: np.ndarray, kind: int) -> np.ndarray:
    """Hashes spread over the features, another way for each kind."""
    x = hashes ^ np.uint64((kind + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


@dataclass
class Weights:
    """Features with a weight, ascending, their weights, and the intercept; infinite where all scores are one."""

    intercept: float = -math.inf
    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def scores(self, owner: np.ndarray, numbers: np.ndarray, texts: int) -> np.ndarray:
        """The probability of each text."""
        totals = np.full(texts, self.intercept)
        if len(self.features) and len(numbers):
            at = np.minimum(np.searchsorted(self.features, numbers), len(self.features) - 1)
            known = self.features[at] == numbers
            pairs = np.unique(owner[known] * len(self.features) + at[known])  # once a text
            totals = totals + np.bincount(pairs // len(self.features), self.weights[pairs % len(self.features)], texts)
        return sigmoid(totals)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700))) * (x > -np.inf)


def ftrl(rows: list[np.ndarray], toxic: list[bool], passes: int = PASSES) -> tuple[float, np.ndarray, np.ndarray]:
    """Intercept, features and weights after some passes over the rows' feature numbers."""
    size = 1 << HASH_BITS
    pulls, squares = np.zeros(size + 1), np.zeros(size + 1)
    shrink = np.full(size + 1, L1)
    shrink[size] = 0  # the intercept's coordinate is not thinned out

    def weights(at: np.ndarray) -> np.ndarray:
        z = pulls[at]
        steep = (BETA + np.sqrt(squares[at])) / ALPHA + L2
        return np.where(np.abs(z) <= shrink[at], 0.0, -(z - np.sign(z) * shrink[at]) / steep)

    for _ in range(passes):
        for row, wanted in zip(rows, toxic, strict=True):
            at = np.append(row, size)
            w = weights(at)
            slope = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w.sum()))))) - wanted
            rate = (np.sqrt(squares[at] + slope * slope) - np.sqrt(squares[at])) / ALPHA
            pulls[at] += slope - rate * w
            squares[at] += slope * slope
    found = weights(np.arange(size + 1))
    used = np.flatnonzero(found[:size])
    return float(found[size]), used, found[used]


def fold(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def held_out(doc_id):
    return F.coalesce(fold(doc_id) == HELD_OUT, F.lit(False))


def marked(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``doc_id, toxic`` of the labelled ids that may be learned from, one row an id."""
    doc_id = F.col(f"`{id_col}`")
    rows = labels.select(doc_id.alias("doc_id"), (F.col(f"`{label_col}`") > 0).alias("toxic"))
    return (
        rows.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )


def chosen(marks: DataFrame, rows: int) -> tuple[DataFrame, dict[bool, int]]:
    """About ``rows`` of each class, by a share of the hash's range, and the number of each class."""
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = [min(1.0, rows / counts[c]) if c in counts else 1.0 for c in (False, True)]
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return marks.where(place < F.when(F.col("toxic"), F.lit(share[1])).otherwise(F.lit(share[0]))), counts


SAMPLE = "doc_id string, place long, toxic boolean, features binary"
FITTED = "feature long, weight double, toxic long, clean long"


def _features(batches):
    hasher = Hasher()
    for batch in batches:
        found = []
        for text in batch.column(3).to_pylist():
            found.append(np.unique(hasher.features([text])[1]).astype("<i4").tobytes())
        columns = [*batch.columns[:3], pa.array(found, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "place", "toxic", "features"])


def _fit(sample: pa.Table) -> pa.Table:
    """Weights of the sample, feature -1 for the intercept, with the number of rows of each class."""
    rows = sample.sort_by([("place", "ascending"), ("doc_id", "ascending")])
    toxic = rows["toxic"].to_pylist()
    numbers = [np.frombuffer(f, "<i4").astype(np.int64) for f in rows["features"].to_pylist()]
    intercept, features, weights = ftrl(numbers, toxic)
    n = len(features) + 1
    columns = [
        pa.array(np.append(features, -1), pa.int64()),
        pa.array(np.append(weights, intercept), pa.float64()),
        pa.array([sum(toxic)] * n, pa.int64()),
        pa.array([len(toxic) - sum(toxic)] * n, pa.int64()),
    ]
    return pa.table(columns, names=["feature", "weight", "toxic", "clean"])


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows: int = TRAIN_ROWS,
) -> Weights:
    """Weights from a bounded sample of the labelled documents."""
    sample, counts = chosen(settle(marked(labels, id_col, label_col)), rows)
    if len(counts) < 2:
        return Weights(math.inf if counts.get(True) else -math.inf)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text")).where(F.length("text") <= TRAIN_CHARS)
    # About 2 * rows ids at most: a bounded side.
    found = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = found.select(F.col("doc_id").cast("string"), F.xxhash64("doc_id").alias("place"), "toxic", "text")
    ship(docs.sparkSession)
    fitted = by_batches(found, _features, SAMPLE).groupBy().applyInArrow(_fit, FITTED).collect()
    if not fitted:
        return Weights()
    toxic, clean = fitted[0]["toxic"], fitted[0]["clean"]
    if not toxic or not clean:
        return Weights(math.inf if toxic else -math.inf)
    intercept = next(r["weight"] for r in fitted if r["feature"] < 0)
    intercept += math.log(counts[True] / counts[False]) - math.log(toxic / clean)
    found = sorted((r["feature"], r["weight"]) for r in fitted if r["feature"] >= 0)
    return Weights(intercept, np.array([f for f, _ in found], np.int64), np.array([w for _, w in found]))


def score(docs: DataFrame, weights: Weights, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` with the score as the last one; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != name or c == text_col])
    where = docs.columns.index(text_col)
    kept = [k for k, c in enumerate(docs.columns) if c != name]

    def work(batches):
        weights, hasher = shared.value, Hasher()
        for batch in batches:
            found = []
            for part in slices(batch.column(where)):
                found.append(weights.scores(*hasher.features(part), len(part)))
            values = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in kept], pa.array(values, pa.float64())],
                names=[*[batch.schema.names[k] for k in kept], name],
            )

    schema = docs.select(*[F.col(f"`{docs.columns[k]}`") for k in kept], F.lit(0.0).alias(name)).schema
    return by_batches(docs, work, schema)


def slices(texts: pa.Array):
    """Lists of texts of about ``SLICE`` characters together, in order."""
    part, size = [], 0
    for text in texts.to_pylist():
        part.append(text)
        size += len(text or "")
        if size > SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    weights = train(docs, labels)
    return score(docs.select("doc_id", "text"), weights).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
