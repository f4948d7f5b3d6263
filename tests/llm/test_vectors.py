"""Vector codes and centroid clusters against plain versions."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import op11_codes, op13_clusters, vectors

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def plain_whole(vector):
    return [math.floor(256 * x) for x in vector]


def usable(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def gap(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def closest(point, centres):
    return min(range(len(centres)), key=lambda k: (gap(point, centres[k]), k))


def step(points, centres):
    """Centres after one round of plain assignment."""
    homes = [closest(p, centres) for p in points]
    after = []
    for k, centre in enumerate(centres):
        own = [p for p, h in zip(points, homes, strict=True) if h == k]
        after.append([sum(c) // len(own) for c in zip(*own, strict=True)] if own else centre)
    return after


def plain_codes(rows, parts, entries, rounds):
    """``{row: (code, error, label_error)}`` and the digest of the codebooks, every pair compared."""
    kept = [(k, r) for k, r in enumerate(rows) if usable(r[1])]
    if not kept:
        return {}, None
    width = max(1, -(-max(len(r[1]) for _, r in kept) // parts)) * parts
    size = width // parts
    whole = {k: plain_whole(r[1]) + [0] * (width - len(r[1])) for k, r in kept}
    order = sorted(kept, key=lambda kr: (kr[1][0] is None, kr[1][0] or 0, kr[1][1]))
    books, codes, errors = [], {k: "" for k, _ in kept}, {k: 0 for k, _ in kept}
    for p in range(parts):
        cut = {k: v[p * size : (p + 1) * size] for k, v in whole.items()}
        book = [cut[k] for k, _ in order[:entries]]
        for _ in range(rounds):
            book = step(list(cut.values()), book)
        for k, v in cut.items():
            best = closest(v, book)
            codes[k] += f"{best:02x}"
            errors[k] += gap(v, book[best])
        books += book
    labels: dict = {}
    for k, r in kept:
        labels[r[2]] = labels.get(r[2], 0) + errors[k]
    digest = hashlib.sha256(",".join(str(x) for e in books for x in e).encode()).hexdigest()
    return {k: (codes[k], errors[k], labels[r[2]]) for k, r in kept}, digest


def plain_clusters(rows, width, count, rounds, seed="2"):
    kept = [r for r in rows if usable(r[1]) and len(r[1]) == width]
    rank = {None: "~"}
    rank |= {r[0]: hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() for r in kept if r[0] is not None}
    points = [plain_whole(r[1]) for r in kept]
    order = sorted(range(len(kept)), key=lambda k: (rank[kept[k][0]], kept[k][1]))
    centres = [points[k] for k in order[:count]]
    for _ in range(rounds):
        centres = step(points, centres)
    homes = [closest(p, centres) for p in points]
    return [(r[0], h, gap(p, centres[h])) for r, p, h in zip(kept, points, homes, strict=True)], centres


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 12), st.integers(0, 10**6), st.sampled_from([3, 200, 1 << 35]))
def test_nearest_entries_equal_plain_search(width, entries, seed, top):
    draw = random.Random(seed)
    rows = [[draw.randint(-top, top) for _ in range(width)] for _ in range(15)]
    book = [draw.choice(rows) if draw.random() < 0.5 else [draw.randint(-top, top) for _ in range(width)] for _ in range(entries)]
    kind = np.int64 if vectors.fits(top, width) else object
    points = op11_codes.transformed(np.array(rows, dtype=kind))
    best, scaled = op11_codes.nearest(points, op11_codes.transformed(np.array(book, dtype=kind)))
    assert best.tolist() == [closest(r, book) for r in rows]
    assert [int(s) for s in scaled // points.shape[1]] == [gap(r, book[b]) for r, b in zip(rows, best, strict=True)]
    assert not any(int(s) % points.shape[1] for s in scaled)


def test_transform_rows_are_in_sequency_order():
    for size in (1, 2, 4, 16):
        functions = op11_codes.transformed(np.eye(size, dtype=np.int64)).T
        assert (functions @ functions.T == size * np.eye(size)).all()
        changes = (functions[:, 1:] != functions[:, :-1]).sum(axis=1)
        assert changes.tolist() == list(range(size))


ODD = [
    (5, [0.5, -0.25, 0.125, 0.75, 1.0], 1, "x"),
    (3, [0.1, 0.2, 0.3], None, "x"),
    (3, [0.1, 0.2, 0.25], None, "y"),
    (3, [0.1, 0.2, 0.3], None, "x"),
    (None, [-3.0, 2.0, 0.0, 0.0, 7.5, 1.0], 2, None),
    (1, [], 1, None),
    (2, None, 1, None),
    (4, [0.5, None, 1.0], 1, None),
    (6, [0.5, NAN], 1, None),
    (7, [INF, 0.5], 1, None),
    (8, [1e6, -1e6, 0.5], 2, None),
]
SCHEMA = "vec_id long, embedding array<double>, label int, code string"


@pytest.mark.parametrize("entries", [1, 2, 4, 64])
def test_codes_of_odd_rows_equal_plain_ones(spark, entries):
    frame = spark.createDataFrame(ODD, SCHEMA)
    found, books = op11_codes.compress(frame, parts=2, entries=entries)
    wanted, digest = plain_codes(ODD, 2, entries, op11_codes.ROUNDS)
    rows = [(ODD[k][0], ODD[k][2], *v) for k, v in wanted.items()]
    got = found.select("id", "label", "code", "error", "label_error").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows))
    assert books.sha256() == digest


def test_codes_of_a_table_equal_plain_ones(spark):
    draw = random.Random(4)
    near = [[draw.gauss(0, 0.2) for _ in range(32)] for _ in range(5)]
    rows = [(k, [x + draw.gauss(0, 0.05) for x in draw.choice(near)], draw.choice([None, 1, 2])) for k in range(150)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    found, books = op11_codes.compress(frame, entries=8)
    wanted, digest = plain_codes(rows, 16, 8, 2)
    assert {r["id"]: (r["code"], r["error"], r["label_error"]) for r in found.collect()} == wanted
    assert books.sha256() == digest


def test_sums_of_many_labels_are_joined_in_shares(spark):
    coded = spark.range(60).selectExpr("id", "IF(id % 3 = 0, NULL, id % 5) AS label", "'00' AS code", "id AS error")
    wanted = {r["id"]: r["label_error"] for r in op11_codes.with_label_error(coded).collect()}
    shared = op11_codes.with_label_error(coded, bound=0)
    assert {r["id"]: r["label_error"] for r in shared.collect()} == wanted
    assert len(wanted) == 60 and shared.columns == ["id", "label", "code", "error", "label_error"]


def test_error_sums_stop_at_the_largest_long(spark):
    rows = [(1, [1e300, 0.0], 1), (2, [-1e300, 0.0], 1)]
    found, _ = op11_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), parts=1, entries=1)
    assert {r["error"] for r in found.collect()} == {vectors.LONG_MAX}
    assert {r["label_error"] for r in found.collect()} == {vectors.LONG_MAX}


def test_empty_tables_give_empty_results(spark):
    none = spark.createDataFrame([(1, None, 1, "x")], SCHEMA)
    for frame in (none, none.limit(0)):
        found, _ = op11_codes.compress(frame)
        assert found.columns == ["id", "label", "code", "error", "label_error"] and not found.collect()
        found, centres = op13_clusters.cluster(frame)
        assert found.columns == ["id", "cluster", "distance"] and not found.collect() and not centres


def test_intervals_hold_every_distance():
    draw = np.random.default_rng(5)
    rows = draw.integers(-90, 90, (300, 7))
    centres = [[int(x) for x in r] for r in draw.integers(-60, 60, (6, 7))]
    for bits in (1, 3, 6):
        cells = op13_clusters.cells_of(
            rows.min(axis=0).tolist(), rows.max(axis=0).tolist(), rows.mean(axis=0).tolist(), rows.std(axis=0).tolist(), bits
        )
        found = cells.of(rows)
        assert (cells.unpacked(cells.packed(found)) == found).all()
        place = np.arange(7)
        assert (cells.low[place, found] <= rows).all() and (rows <= cells.high[place, found]).all()
        low, high = op13_clusters.lookup(cells, centres).intervals(found)
        exact = ((rows[:, None, :] - np.array(centres)[None]) ** 2).sum(axis=2)
        own = ((rows - cells.middle) ** 2).sum(axis=1)[:, None]
        assert (low + own <= exact).all() and (exact <= high + own).all()


def test_vectors_are_fetched_only_where_intervals_overlap():
    draw = np.random.default_rng(6)
    spots = draw.integers(-2000, 2000, (5, 16))
    rows = spots[draw.integers(0, 5, 400)] + draw.integers(-20, 20, (400, 16))
    cells = op13_clusters.cells_of(
        rows.min(axis=0).tolist(), rows.max(axis=0).tolist(), rows.mean(axis=0).tolist(), rows.std(axis=0).tolist(), 6
    )
    centres = [[int(x) for x in s] for s in spots]
    held = pa.array((rows / 256).tolist(), pa.list_(pa.float64()))
    best, fetched = op13_clusters.assign(op13_clusters.lookup(cells, centres), centres, cells.of(rows), held)
    assert best.tolist() == [closest(r, centres) for r in rows.tolist()]
    assert fetched < 40
    twice = centres + centres  # every interval has its equal
    best, fetched = op13_clusters.assign(op13_clusters.lookup(cells, twice), twice, cells.of(rows), held)
    assert best.tolist() == [closest(r, centres) for r in rows.tolist()] and fetched == 400


@pytest.mark.parametrize("bits", [1, 6])
def test_clusters_equal_plain_ones(spark, bits):
    draw = random.Random(7)
    rows = [(k, [draw.gauss(0, 0.3) for _ in range(6)], "x") for k in range(120)]
    rows += [(None, [0.5] * 6, None), (7, [0.5] * 6, None), (7, [0.5] * 6, None), (9, [0.5] * 5, None), (10, None, None)]
    rows += [(11, [0.1, NAN, 0.0, 0.0, 0.0, 0.0], None), (12, [1e6, -1e6, 0.0, 0.0, 0.0, 3e5], "far"), (13, [None] * 6, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string").repartition(4)
    found, centres = op13_clusters.cluster(frame, width=6, centroids=9, bits=bits)
    wanted, plain = plain_clusters(rows, 6, 9, op13_clusters.ROUNDS)
    assert centres == plain
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, wanted))


def test_fewer_vectors_than_centroids(spark):
    rows = [(k, [k / 10] * 64) for k in range(3)]
    found, centres = op13_clusters.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert len(centres) == 3 and {r["distance"] for r in found.collect()} == {0}


def test_queries_return_a_row_a_vector(spark):
    whole = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    codes = op11_codes.op11_codes(spark, SF)
    assert codes.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert codes.count() == whole and codes.select("vec_id").distinct().count() == whole
    found = op13_clusters.op13_clusters(spark, SF)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    rows = found.collect()
    assert len(rows) == whole and rows[0]["inertia"] == sum(r["distance"] for r in rows)
