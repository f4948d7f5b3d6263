"""Centroid clustering over a VA-file.

Every vector (``floor(256 * x)`` per component) is compressed once to one cell
of ``BITS`` bits a dimension; the cells are stored beside the vectors and serve
all rounds.  The cells of a dimension are cut at the quantiles of a normal
distribution with that dimension's mean and deviation, from its least to its
greatest component, all taken from the whole table in one pass.

A squared distance, taken from the middle of the table, is the vector's own
squared length plus, for each dimension, ``c * c - 2 * c * x``.  The length is
the same for all centroids of a vector and is left out.  For each centroid a
lookup table gives, a dimension and cell, the least and the greatest value of
the rest; summed over the dimensions they are an interval that holds the
centroid's distance.  (Intervals of ``(x - c) ** 2`` are so much wider that on
the test tables 35 of 40 of them overlap, in place of 3.)  A centroid whose lower
end exceeds another's upper end is out; a vector is fetched (its components
decoded and compared) only where intervals of several centroids overlap, and
only for those.  What is left is exact: whole numbers throughout, ties to the
smaller number.

Cells and vectors lie in one settled table, a row a vector, since a fetch by id
would shuffle vectors in each round and these stay where they are.  A round is
one pass of it; tasks hand over one exact sum a centroid and component.  Only
centroids, sums and the cuts come to the driver and are broadcast.

Where the cells are too wide for the data, more intervals overlap and more is
fetched; the result is the same.

Cases: vectors of another length than ``WIDTH``, null ones and those with null
or non-finite components take no part; fewer rows than centroids make fewer
centroids; rows without id are clustered but come last among the first
centroids; of rows with equal ids the lesser vector comes first; repeated rows
lie in one cluster; empty centroids stay; components beyond 2**40 / 256 are
held to that, distances and their sums to the largest long; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import by_batches, read, settle
from plumbline.llm.vectors import LONG_MAX, SUMS, Sums, fits, largest, leaders, lists, moved, usable, whole

WIDTH, CENTROIDS, ROUNDS, SEED = 64, 40, 5, "2"
BITS = 6
#: Rows that are compared at once; intervals take 16 bytes a row and centroid.
SLICE = 4096


@dataclass
class Cells:
    """The cells of each dimension: inner cuts, the least and greatest component of each cell, the middle."""

    bits: int
    cuts: np.ndarray
    low: np.ndarray
    high: np.ndarray
    middle: np.ndarray

    def of(self, rows: np.ndarray) -> np.ndarray:
        """The cell of every component."""
        found = np.empty(rows.shape, np.uint8)
        for d, cuts in enumerate(self.cuts):
            found[:, d] = np.searchsorted(cuts, rows[:, d], side="right")
        return found

    def packed(self, cells: np.ndarray) -> pa.Array:
        """``bits`` bits a dimension, a value a row."""
        bits = np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - self.bits :]
        return pa.array([row.tobytes() for row in np.packbits(bits.reshape(len(cells), -1), axis=1)], pa.binary())

    def unpacked(self, column: pa.Array) -> np.ndarray:
        width = len(self.cuts)
        held = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
        bits = np.unpackbits(held, axis=1, count=width * self.bits).reshape(len(column), width, self.bits)
        return np.packbits(bits, axis=2)[:, :, 0] >> (8 - self.bits)


def cells_of(least: list[int], greatest: list[int], means: list[float], spreads: list[float], bits: int) -> Cells:
    """Cells between normal quantiles; the outer ones reach to the ends."""
    marks = [NormalDist().inv_cdf(k / (1 << bits)) for k in range(1, 1 << bits)]
    cuts = np.array([[int(np.floor(m + s * q)) for q in marks] for m, s in zip(means, spreads, strict=True)], np.int64)
    ends = np.array(least, np.int64)[:, None], np.array(greatest, np.int64)[:, None]
    cuts = np.clip(cuts, ends[0], ends[1])
    low = np.concatenate([ends[0], cuts], axis=1)
    high = np.maximum(np.concatenate([cuts - 1, ends[1]], axis=1), low)
    return Cells(bits, cuts, low, high, np.floor(means).astype(np.int64))


STATS = "pos int, n long, low long, high long, total double, squares double"


def survey(vectors: DataFrame, width: int, bits: int) -> Cells | None:
    """The cells for a table, from one pass over all its vectors; None for an empty one."""

    def work(batches):
        n, low, high = 0, np.full(width, 1 << 62), np.full(width, -(1 << 62))
        total, squares = np.zeros(width), np.zeros(width)
        for batch in batches:
            rows = whole(batch.column(0), width).astype(np.int64)
            if len(rows):
                n += len(rows)
                low, high = np.minimum(low, rows.min(axis=0)), np.maximum(high, rows.max(axis=0))
                total += rows.sum(axis=0, dtype=np.float64)
                squares += (rows.astype(np.float64) ** 2).sum(axis=0)
        if n:
            columns = [np.arange(width, dtype=np.int32), np.full(width, n), low, high, total, squares]
            names = ["pos", "n", "low", "high", "total", "squares"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    found = by_batches(vectors.select("vector"), work, STATS)
    names = [F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")]
    names += [F.sum("total").alias("total"), F.sum("squares").alias("squares")]
    rows = found.groupBy("pos").agg(*names).orderBy("pos").collect()
    if not rows:
        return None
    means = [r["total"] / r["n"] for r in rows]
    spreads = [max(0.0, r["squares"] / r["n"] - m * m) ** 0.5 for r, m in zip(rows, means, strict=True)]
    return cells_of([r["low"] for r in rows], [r["high"] for r in rows], means, spreads, bits)


def va_file(vectors: DataFrame, cells: Cells, width: int) -> DataFrame:
    """``id, cells, vector``: each vector with its approximation, settled."""
    shared = vectors.sparkSession.sparkContext.broadcast(cells)

    def work(batches):
        for batch in batches:
            found = shared.value.of(whole(batch.column(1), width).astype(np.int64))
            packed = shared.value.packed(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, batch.column(1)], names=["id", "cells", "vector"])

    schema = vectors.select("id", F.lit(b"").alias("cells"), "vector").schema
    return settle(by_batches(vectors.select("id", "vector"), work, schema))


@dataclass
class Tables:
    """What each dimension, cell and centroid adds to a distance: the least and the most."""

    least: np.ndarray
    most: np.ndarray

    def intervals(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ends of the distance interval of each row and centroid, less the row's own length."""
        low, high = self.least[0][cells[:, 0]], self.most[0][cells[:, 0]]
        for d in range(1, cells.shape[1]):
            low = low + self.least[d][cells[:, d]]
            high = high + self.most[d][cells[:, d]]
        return low, high


def lookup(cells: Cells, centroids: list[list[int]]) -> Tables:
    """Tables in machine integers where every sum fits them, else in Python's."""
    ends = [int(np.abs(cells.low).max()), int(np.abs(cells.high).max()), largest(centroids)]
    kind = np.int64 if fits(4 * max(ends), len(cells.cuts)) else object
    middle = cells.middle.astype(kind)[:, None]
    low, high = ((ends.astype(kind) - middle)[:, :, None] for ends in (cells.low, cells.high))
    at = (np.array(centroids, dtype=kind).T - middle)[:, None, :]
    ends = at * at - 2 * at * low, at * at - 2 * at * high
    return Tables(np.minimum(*ends), np.maximum(*ends))


def assign(tables: Tables, centroids: list[list[int]], cells: np.ndarray, vectors: pa.Array) -> tuple[np.ndarray, int]:
    """The nearest centroid of each row, and how many rows had to be fetched."""
    width, most = cells.shape[1], largest(centroids)
    best, fetched = np.empty(len(cells), np.int64), 0
    for start in range(0, len(cells), SLICE):
        part = slice(start, start + SLICE)
        low, high = tables.intervals(cells[part])
        open_ = low <= high.min(axis=1)[:, None]
        best[part] = open_.argmax(axis=1)
        several = np.flatnonzero(open_.sum(axis=1) > 1)
        if len(several):
            fetched += len(several)
            rows, numbers = np.nonzero(open_[several])
            held = whole(vectors.take(pa.array(start + several)), width, most)
            at = np.array(centroids, dtype=held.dtype)
            gaps = ((held[rows] - at[numbers]) ** 2).sum(axis=1)
            best[start + several] = leaders(rows, numbers, gaps)
    return best, fetched


def first_centroids(vectors: DataFrame, width: int, count: int, seed: str) -> list[list[int]]:
    """The vectors whose seeded id has the least SHA-256."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.orderBy(rank.asc_nulls_last(), "vector").limit(count).select("vector").collect()
    return lists(whole(pa.array([r["vector"] for r in rows], pa.list_(pa.float64())), width)) if rows else []


def round_sums(held: DataFrame, cells: Cells, centroids: list[list[int]]) -> DataFrame:
    """Exact sums of each centroid's vectors, a row a task, centroid and component.

    A mean needs all its members, so the sums read every vector once; distances don't.
    """
    width = len(centroids[0])
    shared = held.sparkSession.sparkContext.broadcast((cells, centroids))

    def work(batches):
        cells, centroids = shared.value
        tables, sums = lookup(cells, centroids), Sums(len(centroids), width)
        for batch in batches:
            if batch.num_rows:
                best, _ = assign(tables, centroids, cells.unpacked(batch.column(0)), batch.column(1))
                sums.add(best, whole(batch.column(1), width))
        yield sums.batch()

    return by_batches(held.select("cells", "vector"), work, SUMS)


def assigned(held: DataFrame, cells: Cells, centroids: list[list[int]]) -> DataFrame:
    """``id, cluster, distance`` of every vector."""
    width = len(centroids[0])
    shared = held.sparkSession.sparkContext.broadcast((cells, centroids))

    def work(batches):
        cells, centroids = shared.value
        tables, most = lookup(cells, centroids), largest(centroids)
        for batch in batches:
            if not batch.num_rows:
                continue
            best, _ = assign(tables, centroids, cells.unpacked(batch.column(1)), batch.column(2))
            rows = whole(batch.column(2), width, most)
            gaps = ((rows - np.array(centroids, dtype=rows.dtype)[best]) ** 2).sum(axis=1)
            gaps = [min(int(g), LONG_MAX) for g in gaps]
            columns = [batch.column(0), pa.array(best, pa.int32()), pa.array(gaps, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "distance"])

    schema = held.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).schema
    return by_batches(held.select("id", "cells", "vector"), work, schema)


def cluster(
    frame: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    width: int = WIDTH,
    centroids: int = CENTROIDS,
    rounds: int = ROUNDS,
    seed: str = SEED,
    bits: int = BITS,
) -> tuple[DataFrame, list[list[int]]]:
    """``id, cluster, distance`` of every usable vector, and the final centroids."""
    vectors = usable(frame, vector_col, id_col).toDF("id", "vector").where(F.size("vector") == width)
    cells = survey(vectors, width, bits)
    if cells is None:
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    held = va_file(vectors, cells, width)
    centres = first_centroids(vectors, width, centroids, seed)
    for _ in range(rounds):
        centres = moved(round_sums(held, cells, centres), centres)
    return settle(assigned(held, cells, centres)), centres


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centres = cluster(read(spark, sf_dir, "embeddings"))
    sums = F.sum(F.col("distance").cast("decimal(38,0)"))
    # One row a centroid: at most CENTROIDS of them.
    by_cluster = found.groupBy("cluster").agg(sums.alias("total")).collect()
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    inertia = min(sum(int(r["total"]) for r in by_cluster), LONG_MAX)
    held = [(r["cluster"], min(int(r["total"]), LONG_MAX), digests[r["cluster"]]) for r in by_cluster]
    about = spark.createDataFrame(held, "cluster int, cluster_inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select(
        F.col("id").alias("vec_id"),
        "cluster",
        "distance",
        "cluster_inertia",
        F.lit(inertia).cast("long").alias("inertia"),
        "centroid_sha256",
    )


def _oracle() -> str:
    """The same rounds over one row a component, all distances computed."""
    floored = "(s.total - ((s.total % s.n) + s.n) % s.n) // s.n"
    steps = [
        f"""
kept AS MATERIALIZED (
  SELECT vec_id, embedding FROM embeddings
  WHERE len(embedding) = {WIDTH} AND NOT EXISTS (SELECT 1 FROM unnest(embedding) AS u(x) WHERE x IS NULL OR NOT isfinite(x)))""",
        f"""
comps AS MATERIALIZED (
  SELECT vec_id, i AS pos, CAST(floor(256 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
  FROM kept, range(1, {WIDTH + 1}) AS t(i))""",
        f"""
cent0 AS MATERIALIZED (
  SELECT cluster, pos, x FROM comps
  JOIN (SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS cluster FROM kept) USING (vec_id)
  WHERE cluster < {CENTROIDS})""",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (
  SELECT vec_id, min(gap) AS gap, arg_min(cluster, gap * {CENTROIDS} + cluster) AS cluster FROM (
    SELECT c.vec_id, m.cluster, sum((c.x - m.x) * (c.x - m.x)) AS gap
    FROM comps c JOIN cent{k} m USING (pos) GROUP BY ALL) GROUP BY ALL)""")
        if k < ROUNDS:
            steps.append(f"""
sums{k} AS MATERIALIZED (
  SELECT cluster, pos, sum(x) AS total, count(*) AS n FROM comps JOIN near{k} USING (vec_id) GROUP BY ALL)""")
            steps.append(f"""
cent{k + 1} AS MATERIALIZED (
  SELECT m.cluster, m.pos, CASE WHEN s.n IS NULL THEN m.x ELSE CAST({floored} AS BIGINT) END AS x
  FROM cent{k} m LEFT JOIN sums{k} s USING (cluster, pos))""")
    return (
        "WITH "
        + ",".join(steps)
        + f"""
SELECT vec_id, CAST(n.cluster AS INTEGER) AS cluster, CAST(gap AS BIGINT) AS distance,
       CAST(sum(gap) OVER (PARTITION BY n.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(gap) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM near{ROUNDS} n
JOIN (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256
      FROM cent{ROUNDS} GROUP BY cluster) USING (cluster)
"""
    )


ORACLE = _oracle()
