"""Personal data: fixed patterns, and candidates judged by boosted trees.

Base spans follow fixed patterns per kind, leftmost and non-overlapping; a match
that fails its check is dropped and not tried again.  On top of that, generous
generators propose overlapping spans (any grouped number, any spelled-out or
plain address).  Gradient-boosted trees judge a proposal by its format (length,
groups, separators) and its context (neighbouring characters, words before it),
not by the fixed checks themselves.  Only what touches no base span can be added,
so they learn from that, over every whole text: positive are base
spans written another way in their own context (a phone without its plus or its
country code, an address spelled out), negative are failed matches, numbers of
orders and the like, and plain words around "at" and "dot"; what may be either is
left out.  Per kind a threshold is calibrated on the proposals of held-out
documents, the least that keeps the given precision.  Proposals over their threshold
that touch no base span are added, best first.  Where there are too few proposals
of either class, nothing is added.

Features are small whole numbers, so the proposals to learn from are counted by
what they look like; the trees and thresholds take each once, weighted by its
count.  Up to ``BINS`` squared of those, every value of a feature is tried as a split.

Offsets are code points, ends exclusive.  Two passes over the rows, one to learn;
only counted proposals are shuffled, only the trees are sent to the tasks.

Cases: a null text counts as empty and has no spans; texts are read whole; rows
are judged one by one, so repeated rows give repeated results and ties can't
arise; an empty table gives an empty result; other columns stay untouched.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import by_batches, read, settle

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns of the four kinds.
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

NUMBER = re.compile(r"(?<![0-9A-Za-z])(?:\+|\()?[0-9](?:[0-9() ./-]*[0-9])(?![0-9A-Za-z])")
SPELLED = re.compile(r"(?:\(|\[| )at(?:\)|\]| )", re.I)
SPELLED_LEFT = re.compile(r"[A-Za-z0-9._%+-]+ ?\Z")
SPELLED_RIGHT = re.compile(r" ?[A-Za-z0-9-]+(?: ?(?:\(|\[| )dot(?:\)|\]| ) ?[A-Za-z0-9-]+)+", re.I)
DIGITS = re.compile(r"[0-9]+")
WORD = re.compile(r"(?<!\S)[^\W\d_]+(?!\S)")
HINTS = (
    re.compile(r"(?:tel|phone|call|fax|mobil)", re.I),
    re.compile(r"(?:card|credit|visa|carte|tarjeta|karte)", re.I),
    re.compile(r"(?:\bip\b|host|addr|server)", re.I),
    re.compile(r"(?:mail|contact|write)", re.I),
    re.compile(r"(?:hash|order|invoice|version|serial|isbn|\bno\b|#|=)", re.I),
)
CONTEXT = 24

LEAST_OF_CLASS = 20
PRECISION = 0.98
TREES, DEPTH = 8, 3
# Spark looks at all rows for its splits while they are at most the square of this.
BINS = 4096
ROWS_A_TASK = 50_000
NEVER = 2.0

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Every @ with a run of local characters before it and a domain after it.

    The run reaches back to the end of the previous match at most; an @ is no
    local character, so these are the pattern's leftmost matches.
    """
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        domain = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            floor = domain.end()
            found.append((start, floor, "email"))
        at = text.find("@", max(at + 1, floor))
    return found


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind."""
    found = emails(text) if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    for m in PHONE.finditer(text):
        if 10 <= sum(map(len, DIGITS.findall(m[0]))) <= 15:
            found.append((*m.span(), "phone"))
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def proposals(text: str, base: list[Span]) -> list[Span]:
    """Spans that may be personal data: grouped numbers and what is in them, and addresses."""
    found = [s for s in base if s[2] == "email"]
    for m in NUMBER.finditer(text):
        start, end = m.span()
        groups = DIGITS.findall(m[0])
        n = sum(map(len, groups))
        if n < 7:
            continue
        dots_only = not re.search(r"[() /+-]", m[0])
        if len(groups) == 4 and dots_only:
            found.append((start, end, "ip"))
        elif 13 <= n <= 19:
            found.append((start, end, "card"))
        if 9 <= n <= 15 and not (dots_only and len(groups) == 4):
            found.append((start, end, "phone"))
            if m[0][0] == "+":
                inner = start + m[0].find(groups[1]) - (m[0][m[0].find(groups[1]) - 1] == "(") if len(groups) > 2 else 0
                if inner:
                    found.append((inner, end, "phone"))
    for m in SPELLED.finditer(text):
        left = SPELLED_LEFT.search(text, max(0, m.start() - 64), m.start())
        right = SPELLED_RIGHT.match(text, m.end())
        if left and right:
            found.append((left.start(), right.end(), "email"))
    return ordered(list(set(found)))


def features(text: str, span: Span) -> list[float]:
    """Format and context of a proposal; none of the fixed checks is among them."""
    start, end, kind = span
    piece = text[start:end]
    groups = [len(g) for g in DIGITS.findall(piece)]
    before = text[max(0, start - CONTEXT) : start]
    after = text[end : end + 1]
    return [
        float(KINDS.index(kind)),
        float(end - start),
        float(sum(groups)),
        float(len(groups)),
        float(max(groups, default=0)),
        float(groups[0] if groups else 0),
        float(groups[-1] if groups else 0),
        *(float(piece.count(c)) for c in " .-(/@"),
        float(piece[:1] == "+"),
        float(before[-1:].isalnum()),
        float(before[-1:] in ("", " ", "\n")),
        float(after.isalnum()),
        float(after in ("", " ", "\n", ".", ",")),
        *(float(bool(h.search(before))) for h in HINTS),
    ]


def touches(span: Span, base: list[Span]) -> bool:
    return any(span[0] < e and s < span[1] for s, e, _ in base)


def refused(text: str, span: Span) -> bool:
    """Whether a proposal that touches no base span is surely not personal data; else it may be either."""
    start, end, kind = span
    if kind in ("ip", "card") or text[start] == "+":
        return True  # the fixed check failed
    before = text[max(0, start - CONTEXT) : start]
    alone = len(DIGITS.findall(text[start:end])) == 1
    return kind == "phone" and not HINTS[0].search(before) and (alone or bool(HINTS[4].search(before)))


def examples(text: str, base: list[Span]):
    """``(features, label, kind)`` of what the trees learn from in one text."""

    def rewritten(start: int, end: int, piece: str, kind: str) -> list[float]:
        before = text[max(0, start - CONTEXT) : start]
        return features(before + piece + text[end : end + 1], (len(before), len(before) + len(piece), kind))

    for start, end, kind in base:
        piece = text[start:end]
        if kind == "phone":
            yield rewritten(start, end, piece[1:], kind), 1.0, kind
            local = re.match(r"\+[0-9]+[ .-]*(?=[(0-9])", piece)
            if local and sum(map(len, DIGITS.findall(piece[local.end() :]))) >= 9:
                yield rewritten(start, end, piece[local.end() :], kind), 1.0, kind
        elif kind == "email":
            name, _, domain = piece.rpartition("@")
            for at, dot in ((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]")):
                yield rewritten(start, end, name + at + domain.replace(".", dot), kind), 1.0, kind
    for span in proposals(text, base):
        if not touches(span, base) and refused(text, span):
            yield features(text, span), 0.0, span[2]
    words = WORD.finditer(text)
    while len(nine := list(islice(words, 9))) > 2:
        a, b, c = nine[:3]
        if b.start() - a.end() == 1 == c.start() - b.end():
            yield rewritten(a.start(), c.end(), f"{a[0]} at {b[0]} dot {c[0]}", "email"), 0.0, "email"
            break


@dataclass
class Trees:
    """Boosted trees as nested tuples (feature, threshold, left, right) or leaf values."""

    trees: list = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def score(self, row: list[float]) -> float:
        margin = 0.0
        for weight, node in zip(self.weights, self.trees, strict=True):
            while isinstance(node, tuple):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            margin += weight * node
        return margin

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Proposals over their threshold, best first, that touch neither base nor better spans."""
        if not self.trees:
            return []
        judged = []
        for span in proposals(text, base):
            if touches(span, base):
                continue
            score = self.score(features(text, span))
            if score >= self.thresholds.get(span[2], NEVER):
                judged.append((-score, span))
        taken: list[Span] = []
        for _, span in sorted(judged):
            if not touches(span, taken):
                taken.append(span)
        return taken


def _node(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return (int(split.featureIndex()), float(split.threshold()), _node(node.leftChild()), _node(node.rightChild()))


def labelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``features, label, kind, held`` of the proposals of all documents, and how many (``n``) are alike."""

    def work(batches):
        for batch in batches:
            counts: Counter = Counter()
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    held = zlib.crc32(str(key).encode()) % 3 == 0
                    counts.update((tuple(row), label, kind, held) for row, label, kind in examples(text, base_spans(text)))
            columns = [*zip(*counts, strict=True)] if counts else [()] * 4
            kinds = [pa.list_(pa.float64()), pa.float64(), pa.string(), pa.bool_(), pa.int64()]
            arrays = [pa.array(v, k) for v, k in zip([*columns, [*counts.values()]], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["features", "label", "kind", "held", "n"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = by_batches(rows, work, "features array<double>, label double, kind string, held boolean, n long")
    return found.groupBy("features", "label", "kind", "held").agg(F.sum("n").alias("n"))


def thresholds(rows: DataFrame, model: Trees) -> dict[str, float]:
    """Per kind the least score whose proposals, with all better ones, keep the precision.

    Trees of a fixed number and depth give few scores, whatever the input; they are ranked by Spark.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        model = shared.value
        for batch in batches:
            scores = pa.array([model.score(row) for row in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores, *batch.columns[2:]], names=["kind", "score", "n", "right"])

    right = F.when(F.col("label") > 0, F.col("n")).otherwise(0).cast("long")
    judged = by_batches(
        rows.select("kind", "features", "n", right.alias("right")), work, "kind string, score double, n long, right long"
    )
    better = Window.partitionBy("kind").orderBy(F.desc("score"))
    passing = (
        judged.groupBy("kind", "score")
        .agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
        .select("kind", "score", F.sum("n").over(better).alias("n"), F.sum("right").over(better).alias("right"))
        .where((F.col("n") >= LEAST_OF_CLASS) & (F.col("right") >= F.lit(PRECISION) * F.col("n")))
    )
    never = NEVER * sum(map(abs, model.weights)) + NEVER
    least = passing.groupBy("kind").agg(F.min("score").alias("score")).collect()
    return dict.fromkeys(KINDS, never) | {r["kind"]: r["score"] for r in least}


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees and thresholds from the proposals of all documents."""
    rows = settle(labelled(docs, id_col, text_col))
    told = rows.where("NOT held").groupBy("label").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()
    counts = {r["label"]: r["n"] for r in told}
    if min(counts.get(0.0, 0), counts.get(1.0, 0)) < LEAST_OF_CLASS:
        return Trees()
    # Rows in one order, so that the same documents give the same trees however they are stored.
    parts = 1 + sum(r["rows"] for r in told) // ROWS_A_TASK
    learn = rows.where("NOT held").repartition(parts, "features").sortWithinPartitions("features", "label", "kind")
    fit = GBTClassifier(
        featuresCol="vector", labelCol="label", weightCol="n", maxIter=TREES, maxDepth=DEPTH, maxBins=BINS,
        stepSize=0.3, seed=7, cacheNodeIds=False,
    ).fit(learn.select(array_to_vector("features").alias("vector"), "label", F.col("n").cast("double").alias("n")))
    model = Trees([_node(t._call_java("rootNode")) for t in fit.trees], [float(w) for w in fit.treeWeights])
    model.thresholds = thresholds(rows.where("held"), model)
    return model


def find(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, counts of the base spans, and both span lists as text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        model = shared.value
        for batch in batches:
            counts, base_texts, all_texts = [[] for _ in KINDS], [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text else []
                kinds = [s[2] for s in base]
                for k, kind in enumerate(KINDS):
                    counts[k].append(kinds.count(kind))
                base_texts.append(written(base))
                all_texts.append(written(ordered(base + model.added(text, base))) if text else "")
            arrays = [
                batch.column(0),
                *[pa.array(c, pa.int64()) for c in counts],
                pa.array(base_texts, pa.string()),
                pa.array(all_texts, pa.string()),
            ]
            names = ["doc_id", *[f"n_{k}" for k in KINDS], "base", "spans"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return by_batches(rows, work, f"doc_id {kind}, {counts}, base string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each stretch of overlapping spans replaced by its first kind's name."""
    parts, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            parts += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, model: Trees, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with personal data replaced in the text, and its length where there is a column for it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    where, names = docs.columns.index(text_col), docs.columns

    def work(batches):
        model = shared.value
        for batch in batches:
            texts = []
            for text in batch.column(where).to_pylist():
                base = base_spans(text) if text else []
                spans = ordered(base + model.added(text, base)) if text else []
                texts.append(redacted(text, spans) if spans else text)
            columns = list(batch.columns)
            columns[where] = pa.array(texts, batch.column(where).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = by_batches(docs, work, docs.schema)
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col(text_col).isNotNull(), F.length(text_col)).cast(kind))
    return out


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = find(docs, train(docs))
    return found.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans"
    )
