"""Vector codes by product quantisation in whole numbers.

A vector becomes ``floor(256 * x)`` per component and is cut into 16 parts; a
part's code is the number of the nearest entry of its position's codebook.
Parts and entries are padded with zeros to a power of two and go through an
integer Walsh-Hadamard transform, rows in sequency order.  The transform of
length P multiplies every squared distance by P, so distances are compared and
summed without any floating point and divided by P at the end, exactly.

The coefficients of low sequency gather what neighbouring components share, so
they come first: squared differences are accumulated coefficient by coefficient
for all entries of a part that are still in the race.  A sum only grows, so an
entry whose sum already exceeds the whole distance of some other entry is out;
one with an equal sum stays, for ties go to the lower number.

A round is one pass over the table: tasks assign their rows and hand over one
exact sum a codebook entry and component, which Spark adds up; codebooks are
the only thing that comes to the driver and is broadcast (``ENTRIES`` times the
vector's length numbers).  No vector is shuffled.

Cases: rows whose vector is null or holds null or non-finite components are
dropped; vectors shorter than the longest, or of a length that is no multiple
of the parts, are filled with zeros at their end; fewer rows than entries make
smaller codebooks; a row without id is coded but comes last among the first
rows; rows with equal ids are rows of their own, the lesser vector first;
repeated rows get equal codes; null labels are one label; components beyond
2**40 / 256 are held to that, error sums to the largest long; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import by_batches, read, settle
from plumbline.llm.vectors import LONG_MAX, SUMS, Sums, largest, leaders, lists, moved, to_long, usable, whole

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Up to so many labels their sums are broadcast (a few MB); more are joined in shares of the rows.
BROADCAST_LABELS = 100_000
SHARES = 32


def transformed(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of each row, padded with zeros, in ascending sequency."""
    size = 1 << max(rows.shape[1] - 1, 0).bit_length()
    out = np.zeros((len(rows), size), rows.dtype)
    out[:, : rows.shape[1]] = rows
    step = 1
    while step < size:
        pairs = out.reshape(len(rows), -1, 2, step)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(rows), size)
        step *= 2
    return out[:, sequency(size)]


def sequency(size: int) -> np.ndarray:
    """The places of the natural order by the number of sign changes of their functions."""
    k = np.arange(size)
    signs = np.array([[(int(a) & int(b)).bit_count() & 1 for b in k] for a in k])
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1), kind="stable")


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each point's nearest entry and their scaled squared distance, from coefficients."""
    first = (points[:, :1] - entries[None, :, 0]) ** 2
    ahead = first.argmin(axis=1)
    bound = ((points - entries[ahead]) ** 2).sum(axis=1)
    rows, held = np.nonzero(first <= bound[:, None])
    sums = first[rows, held]
    for k in range(1, points.shape[1]):
        sums = sums + (points[rows, k] - entries[held, k]) ** 2
        stay = sums <= bound[rows]
        rows, held, sums = rows[stay], held[stay], sums[stay]
        if k + 1 < points.shape[1]:
            # The leader of this coefficient has a distance of its own, which may be the least yet.
            ahead = leaders(rows, held, sums)
            bound = np.minimum(bound, ((points - entries[ahead]) ** 2).sum(axis=1))
            stay = sums <= bound[rows]
            rows, held, sums = rows[stay], held[stay], sums[stay]
    best = leaders(rows, held, sums)
    return best, ((points - entries[best]) ** 2).sum(axis=1)


@dataclass
class Codebooks:
    """Entries of all positions: row ``position * entries + number`` is an entry."""

    parts: int
    entries: list[list[int]]

    @property
    def count(self) -> int:
        return len(self.entries) // self.parts

    @property
    def width(self) -> int:
        return self.parts * len(self.entries[0]) if self.entries else 0

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e).encode()).hexdigest()

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows by parts) and squared distances summed over the parts."""
        size, kind = self.width // self.parts, rows.dtype
        codes, error = np.zeros((len(rows), self.parts), np.int64), np.zeros(len(rows), kind)
        for p in range(self.parts if len(rows) else 0):
            book = np.array(self.entries[p * self.count : (p + 1) * self.count], dtype=kind)
            points, entries = transformed(rows[:, p * size : (p + 1) * size]), transformed(book)
            codes[:, p], scaled = nearest(points, entries)
            error = error + scaled // points.shape[1]
        return codes, error


def padded(vectors: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """Vectors of one length, a multiple of ``parts``, and that length."""
    sizes = vectors.agg(F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
    if sizes["high"] is None:
        return vectors, 0
    width = max(1, -(-sizes["high"] // parts)) * parts
    if sizes["low"] < width:
        rest = F.array_repeat(F.lit(0.0), F.lit(width) - F.size("vector"))
        vectors = vectors.withColumn("vector", F.concat("vector", rest))
    return vectors, width


def first_books(vectors: DataFrame, width: int, parts: int, entries: int) -> Codebooks:
    """Codebooks of the first rows by id."""
    rows = vectors.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    found = lists(whole(pa.array([r["vector"] for r in rows], pa.list_(pa.float64())), width)) if rows else []
    size = width // parts
    return Codebooks(parts, [row[p * size : (p + 1) * size] for p in range(parts) for row in found])


def train(vectors: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after ``rounds`` rounds over all rows of ``id, vector``."""
    books = first_books(vectors, width, parts, entries)
    for _ in range(rounds if books.entries else 0):
        books = Codebooks(parts, moved(round_sums(vectors, books), books.entries))
    return books


def round_sums(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """Exact sums of each entry's parts, a row a task, entry and component."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def work(batches):
        books = shared.value
        most, size = largest(books.entries), books.width // books.parts
        sums = Sums(len(books.entries), size)
        for batch in batches:
            rows = whole(batch.column(0), books.width, most)
            codes, _ = books.encode(rows)
            for p in range(books.parts if len(rows) else 0):
                sums.add(p * books.count + codes[:, p], rows[:, p * size : (p + 1) * size])
        yield sums.batch()

    return by_batches(vectors.select("vector"), work, SUMS)


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """All columns but the vector, with ``code`` and ``error``."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    kept = vectors.select(*[c for c in vectors.columns if c != "vector"], "vector")

    def work(batches):
        books = shared.value
        most = largest(books.entries)
        for batch in batches:
            codes, error = books.encode(whole(batch.column(batch.num_columns - 1), books.width, most))
            texts = [row.tobytes().hex() for row in codes.astype(np.uint8)]
            errors = [min(int(x), LONG_MAX) for x in error]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(errors, pa.int64())],
                names=[*batch.schema.names[:-1], "code", "error"],
            )

    schema = kept.drop("vector").withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}).schema
    return by_batches(kept, work, schema)


def with_label_error(coded: DataFrame, bound: int = BROADCAST_LABELS) -> DataFrame:
    """``coded`` with its errors summed over equal labels, nulls together.

    Sums are formed before the shuffle, so a label with a third of all rows
    moves one row a task.  Few labels go to the rows by broadcast, after they
    are counted; many are repeated once a share, and a label's rows are dealt
    to the shares, so none gathers in one task.
    """
    total = to_long(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error")
    totals = settle(coded.groupBy("label").agg(total).withColumnRenamed("label", "of"))
    same = F.col("label").eqNullSafe(F.col("of"))
    if totals.count() <= bound:
        return coded.join(F.broadcast(totals), same).drop("of")
    dealt = coded.withColumn("share", F.pmod(F.xxhash64("id", "code", F.monotonically_increasing_id()), F.lit(SHARES)))
    copies = totals.withColumn("held", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    return dealt.join(copies, same & (F.col("share") == F.col("held"))).drop("of", "share", "held")


def compress(
    frame: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, Codebooks]:
    """``id, label, code, error, label_error`` of every usable row, and the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part, so 1 to 256 entries")
    vectors = usable(frame, vector_col, id_col, label_col).toDF("id", "label", "vector")
    vectors, width = padded(vectors, parts)
    books = train(vectors, width, parts, entries, rounds)
    return with_label_error(settle(encode(vectors, books))), books


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = compress(read(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )


def _floor(total: str, count: str) -> str:
    return f"(({total}) - ((({total}) % {count}) + {count}) % {count}) // {count}"


def _oracle() -> str:
    """The same rounds over one row a component."""
    steps = [
        """
kept AS MATERIALIZED (
  SELECT vec_id, label, embedding, len(embedding) // 16 AS size FROM embeddings
  WHERE embedding IS NOT NULL AND NOT EXISTS (SELECT 1 FROM unnest(embedding) AS u(x) WHERE x IS NULL OR NOT isfinite(x)))""",
        """
comps AS MATERIALIZED (
  SELECT vec_id, (i - 1) // size AS part, (i - 1) % size AS pos,
         CAST(floor(256 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
  FROM kept, range(1, 1 + len(embedding)) AS t(i))""",
        """
book0 AS MATERIALIZED (
  SELECT part, pos, x, entry FROM comps
  JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) USING (vec_id) WHERE entry < 64)""",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (
  SELECT vec_id, part, min(gap) AS gap, arg_min(entry, gap * 64 + entry) AS entry FROM (
    SELECT c.vec_id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS gap
    FROM comps c JOIN book{k} b USING (part, pos) GROUP BY ALL) GROUP BY ALL)""")
        if k < ROUNDS:
            steps.append(f"""
sums{k} AS MATERIALIZED (
  SELECT part, pos, entry, sum(x) AS total, count(*) AS n
  FROM comps JOIN near{k} USING (vec_id, part) GROUP BY ALL)""")
            steps.append(f"""
book{k + 1} AS MATERIALIZED (
  SELECT b.part, b.pos, CASE WHEN s.n IS NULL THEN b.x ELSE CAST({_floor("s.total", "s.n")} AS BIGINT) END AS x, b.entry
  FROM book{k} b LEFT JOIN sums{k} s USING (part, pos, entry))""")
    steps.append(f"""
coded AS MATERIALIZED (
  SELECT vec_id, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(gap) AS BIGINT) AS error
  FROM near{ROUNDS} GROUP BY vec_id)""")
    return (
        "WITH "
        + ",".join(steps)
        + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""
    )


ORACLE = _oracle()
