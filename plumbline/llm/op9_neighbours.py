"""Nearest neighbours by inner product over balanced posting lists.

Vectors get one more component that makes all norms equal, so the largest inner
product is the least distance.  A bounded sample (``SAMPLE``) is halved again
and again at the median of its two-means direction, which gives clusters of
equal size; their refined centres head the posting lists.  Every vector of the
table is put into its nearest list and, near a boundary, into up to
``REPLICAS`` lists: those at most ``REPLICA_RATIO`` times as far.  A query walks
a neighbour graph of the centres, held in memory, and selects ``LISTS_LEAST``
or ``LISTS_SHARE`` of all lists, whichever is more; beyond the first
``LISTS_LEAST`` only those within ``RATIO`` of the last of these.

Neighbouring lists are stored together in blocks of about ``BLOCK_VECTORS``
placements; a list with more, for many copies of one vector, is split over
several blocks by the hash of the ids.  A block and at most ``CELL_QUERIES`` of
its queries meet in a task, which looks at the selected lists alone and keeps
each query's best, so a query returns one short answer a block and no task
grows with a list.  Scores are recomputed pair by pair in double precision on
the original vectors, so equal vectors have equal scores, and ties go to the
smaller id.

The index is approximate; ``tests/llm`` holds its recall against brute force.

Cases: null, empty and zero vectors, vectors with null or non-finite components
and vectors of another length than most take no part, as query or candidate; of
rows with equal ids a query takes the least vector, a candidate the best score
(equal rows are dropped first, and a cell keeps distinct ids); fewer candidates than asked for give all; empty tables give an empty result;
other columns are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import by_batches, read, settle, ship

NEAREST = 20
SAMPLE = 20_000
LIST_VECTORS = 64
SAMPLE_PER_LIST = 20
REPLICAS = 3
REPLICA_RATIO = 1.02
RATIO = 1.25
LISTS_LEAST = 64
LISTS_SHARE = 0.4
GRAPH_DEGREE = 24
ENTRIES = 8
BLOCK_VECTORS, CELL_QUERIES = 8192, 2048
SLACK = 1e-9


@dataclass
class Lists:
    """Centres of the lists, the graph between them, and the norm all vectors are raised to."""

    centres: np.ndarray
    graph: np.ndarray
    top: float

    def raised(self, vectors: np.ndarray, queries: bool = False) -> np.ndarray:
        rest = np.maximum(0.0, self.top**2 - (vectors**2).sum(axis=1))
        return np.concatenate([vectors, (np.zeros_like(rest) if queries else np.sqrt(rest))[:, None]], axis=1)

    def homes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and list of each placement."""
        points = self.raised(vectors)
        gaps = distances(points, self.centres)
        near = np.argsort(gaps, axis=1, kind="stable")[:, :REPLICAS]
        far = np.take_along_axis(gaps, near, axis=1)
        rows, column = np.nonzero(far <= REPLICA_RATIO * far[:, :1])
        return rows, near[rows, column]

    def selected(self, query: np.ndarray) -> list[int]:
        """Lists for one query: a best-first walk of the graph, cut by the ratio of distances."""
        most = max(LISTS_LEAST, int(np.ceil(LISTS_SHARE * len(self.centres))))
        starts = np.unique(np.linspace(0, len(self.centres) - 1, ENTRIES).astype(int))
        seen = np.zeros(len(self.centres), bool)
        seen[starts] = True
        gaps = np.sqrt(((self.centres[starts] - query) ** 2).sum(axis=1))
        ahead = list(zip(gaps.tolist(), starts.tolist(), strict=True))
        heapq.heapify(ahead)
        best = [(-g, c) for g, c in ahead]
        heapq.heapify(best)
        while ahead:
            gap, at = heapq.heappop(ahead)
            if len(best) >= most and gap > -best[0][0]:
                break
            fresh = self.graph[at][~seen[self.graph[at]]]
            seen[fresh] = True
            gaps = np.sqrt(((self.centres[fresh] - query) ** 2).sum(axis=1))
            for g, c in zip(gaps.tolist(), fresh.tolist(), strict=True):
                if len(best) < most or g < -best[0][0]:
                    heapq.heappush(ahead, (g, c))
                    heapq.heappush(best, (-g, c))
                    if len(best) > most:
                        heapq.heappop(best)
        found = sorted((-g, c) for g, c in best)
        # A query may be nearly a centre itself, so the nearest distance is no measure of its surroundings.
        reach = RATIO * found[min(LISTS_LEAST, len(found)) - 1][0]
        return [c for g, c in found if g <= reach]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0.0))


def balanced(points: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Centres of clusters of equal size, each half cut at the median between two means."""
    random, parts = np.random.default_rng(seed), [("", points)]
    while len(parts) < lists:
        parts.sort(key=lambda p: len(p[1]))
        path, part = parts.pop()
        if len(part) < 2:
            parts.append((path, part))
            break
        means = part[random.choice(len(part), 2, replace=False)]
        for _ in range(4):
            side = distances(part, means).argmin(axis=1)
            if 0 < side.sum() < len(part):
                means = np.stack([part[side == 0].mean(axis=0), part[side == 1].mean(axis=0)])
        order = np.argsort(part @ (means[1] - means[0]), kind="stable")
        half = len(part) // 2
        parts += [(path + "0", part[order[:half]]), (path + "1", part[order[half:]])]
    # In the order of the halvings, so that neighbours have near numbers.
    centres = np.stack([p.mean(axis=0) for _, p in sorted(parts, key=lambda p: p[0])])
    for _ in range(3):
        home = distances(points, centres).argmin(axis=1)
        for k in np.unique(home):
            centres[k] = points[home == k].mean(axis=0)
    return centres


def neighbour_graph(centres: np.ndarray) -> np.ndarray:
    gaps = distances(centres, centres)
    np.fill_diagonal(gaps, np.inf)
    degree = min(GRAPH_DEGREE, max(1, len(centres) - 1))
    near = np.argsort(gaps, axis=1, kind="stable")[:, :degree]
    # A ring keeps every centre reachable.
    return np.concatenate([near, ((np.arange(len(centres)) + 1) % len(centres))[:, None]], axis=1)


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows that take part: ``vec_id, vec array<double>``."""
    vec = F.col("vec")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
        .where("vec_id IS NOT NULL AND size(vec) > 0")
        .where(~bad & F.exists(vec, lambda x: x != 0))
    )
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("vec") == (sizes[0]["d"] if sizes else 0))


def build_lists(rows: DataFrame) -> Lists | None:
    """The lists' centres from a bounded sample of the valid rows."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    count, top = rows.agg(F.count("*"), F.max(norm)).first()
    if not count:
        return None
    share = min(1.0, 1.2 * SAMPLE / count)
    chosen = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share * (1 << 20)).limit(SAMPLE)
    sample = np.array([r["vec"] for r in chosen.select("vec").collect()])
    sample = np.unique(sample, axis=0) if len(sample) else sample
    if not len(sample):
        sample = np.array([rows.first()["vec"]])
    points = Lists(sample, sample, top).raised(sample)
    lists = max(1, min(count // LIST_VECTORS, len(points) // SAMPLE_PER_LIST))
    centres = balanced(points, lists)
    return Lists(centres, neighbour_graph(centres), top)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def placed(rows: DataFrame, shared) -> DataFrame:
    """``list, vec_id, vec`` of each placement of a vector."""

    def work(batches):
        for batch in batches:
            rows, lists = shared.value.homes(matrix(batch.column(1)))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(lists, pa.int64()), batch.column(0).take(at), batch.column(1).take(at)],
                names=["list", "vec_id", "vec"],
            )

    return by_batches(rows, work, "list long, vec_id long, vec array<double>")


def layout(sizes: dict[int, int], lists: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each list."""
    first, many = np.zeros(lists, np.int64), np.ones(lists, np.int64)
    block = held = 0
    for k in range(lists):
        size = sizes.get(k, 0)
        if held and held + size > BLOCK_VECTORS:
            block, held = block + 1, 0
        first[k], many[k] = block, max(1, -(-size // BLOCK_VECTORS))
        held += size
        if many[k] > 1:
            block, held = block + int(many[k]), 0
    return first, many


def sent(queries: DataFrame, shared, blocks) -> DataFrame:
    """``block, vec_id, vec, lists`` of each query in each block that holds lists it selects."""

    def work(batches):
        first, many = blocks.value
        for batch in batches:
            owners, where, chosen = [], [], []
            for k, query in enumerate(shared.value.raised(matrix(batch.column(1)), True)):
                by_block: dict[int, list[int]] = {}
                for c in shared.value.selected(query):
                    for block in range(first[c], first[c] + many[c]):
                        by_block.setdefault(int(block), []).append(c)
                owners += [k] * len(by_block)
                where += by_block
                chosen += by_block.values()
            at = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(where, pa.int64()),
                    batch.column(0).take(at),
                    batch.column(1).take(at),
                    pa.array(chosen, pa.list_(pa.int64())),
                ],
                names=["block", "vec_id", "vec", "lists"],
            )

    return by_batches(queries, work, "block long, vec_id long, vec array<double>, lists array<long>")


def best_in_cell(nearest: int):
    def work(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if vectors.num_rows and queries.num_rows:
            vectors = vectors.sort_by("vec_id").combine_chunks()
            ids, lists = vectors["vec_id"].to_numpy(), vectors["list"].to_numpy()
            held = matrix(vectors["vec"].combine_chunks())
            starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            query_ids = queries["vec_id"].to_numpy()
            asked, chosen = matrix(queries["vec"].combine_chunks()), queries["lists"].to_pylist()
            low_list = int(lists.min())
            for low in range(0, len(asked), 256):
                rough = asked[low : low + 256] @ held.T
                for k, row in enumerate(rough, low):
                    picked = np.zeros(int(lists.max()) - low_list + 1, bool)
                    picked[[c - low_list for c in chosen[k] if 0 <= c - low_list < len(picked)]] = True
                    row[~picked[lists - low_list] | (ids == query_ids[k])] = -np.inf
                    best = np.maximum.reduceat(row, starts)  # an id may have several vectors, a vector several lists
                    n = min(nearest, len(best))
                    least = np.partition(best, len(best) - n)[len(best) - n]
                    slack = SLACK * (1 + abs(least)) if np.isfinite(least) else 0.0
                    at = np.flatnonzero((row >= least - slack) & (row > -np.inf))
                    exact = np.einsum("ij,j->i", held[at], asked[k])
                    order = np.lexsort((ids[at], -exact))
                    _, firsts = np.unique(ids[at][order], return_index=True)
                    order = order[np.sort(firsts)][:nearest]
                    out[0].append(np.full(len(order), query_ids[k]))
                    out[1].append(ids[at][order])
                    out[2].append(exact[order])
        empty = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        arrays = [pa.array(np.concatenate([e, *o])) for e, o in zip(empty, out, strict=True)]
        return pa.table(arrays, names=["query_id", "vec_id", "score"])

    return work


def search(
    vectors: DataFrame,
    queries: DataFrame,
    nearest: int = NEAREST,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """Each query's nearest rows: ``query_id, rank, vec_id, score``."""
    spark = vectors.sparkSession
    ship(spark)
    # Equal rows would fill lists and blocks without adding an answer.
    rows = settle(valid(vectors, id_col, vec_col).distinct())
    lists = build_lists(rows)
    if lists is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(lists)
    held = settle(placed(rows, shared))
    # One row for each list, of which there are SAMPLE / SAMPLE_PER_LIST at most.
    sizes = {r["list"]: r["count"] for r in held.groupBy("list").count().collect()}
    first, many = layout(sizes, len(lists.centres))
    blocks = spark.sparkContext.broadcast((first, many))
    table = [(k, int(a), int(n)) for k, (a, n) in enumerate(zip(first, many, strict=True))]
    table = F.broadcast(spark.createDataFrame(table, "list long, first long, many long"))
    asked = valid(queries, id_col, vec_col).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    asked = settle(sent(asked, shared, blocks))
    cells = asked.groupBy("block").agg(F.ceil(F.count("*") / CELL_QUERIES).cast("long").alias("cells"))
    every = F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)
    stored = held.join(table, "list").withColumn("block", F.col("first") + F.pmod(F.xxhash64("vec_id"), "many"))
    stored = stored.join(cells, "block").withColumn("cell", F.explode(every))
    asked = asked.join(cells, "block").withColumn("cell", F.pmod(F.xxhash64("vec_id"), "cells"))
    found = (
        stored.select("block", "cell", "list", "vec_id", "vec")
        .groupBy("block", "cell")
        .cogroup(asked.select("block", "cell", "vec_id", "vec", "lists").groupBy("block", "cell"))
        .applyInArrow(best_in_cell(nearest), "query_id long, vec_id long, score double")
    )
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % 20 == 0))
