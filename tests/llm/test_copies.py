"""Exact dedup and near duplicates."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import common as common_helpers
from plumbline.llm import op3_jaccard, op8_exact_dedup, packed
from plumbline.llm.common import components
from tests.llm import plain

CLASHING = "digest string, row string, keep_id string, node long, component long"
CLASH = ("d", "r", "k", 1, 2)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], f"doc_id long, text string, {CLASHING}")


def test_perfect_hash_is_minimal_and_rejects_others():
    words = np.frombuffer(random.Random(1).randbytes(32 * 5000), "<u8").reshape(-1, 4)
    sizes, bits, slots = op8_exact_dedup.build(words)
    assert sorted(slots) == list(range(5000))
    assert (op8_exact_dedup.slots_of(words, sizes, bits) == slots).all()
    others = np.frombuffer(random.Random(2).randbytes(32 * 500), "<u8").reshape(-1, 4)
    at = op8_exact_dedup.slots_of(others, sizes, bits)
    held = words[np.argsort(slots)]
    assert not any((held[s] == others[k]).all() for k, s in enumerate(at) if s >= 0)
    with pytest.raises(ValueError):
        op8_exact_dedup.build(np.concatenate([words, words[:1]]))
    assert op8_exact_dedup.words_of(b"").shape == (0, 4)


def test_exact_groups(spark):
    draw = random.Random(4)
    rows = [(k, draw.choice(["a", "b", "B", "", None, "ab ", "x" * 50_000, f"t{k}"])) for k in range(400)]
    found = op8_exact_dedup.duplicates(frame(spark, rows)).collect()
    best = plain.kept_exact(rows)
    assert len(found) == 400
    texts = dict(rows)
    for row in found:
        text = texts[row["doc_id"]] or ""
        assert row["keep_id"] == best[text]
        assert row["kept"] == (row["doc_id"] == best[text])
        assert row["group_size"] == sum((t or "") == text for _, t in rows)
    kept = op8_exact_dedup.keep_first(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(best.values())


def test_exact_repeats_and_null_ids(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b")]
    found = op8_exact_dedup.duplicates(frame(spark, rows)).collect()
    kept = [(r["doc_id"], r["group_size"]) for r in found if r["kept"]]
    assert sorted(kept, key=str) == [(1, 3), (None, 2)]
    assert op8_exact_dedup.duplicates(frame(spark, [])).count() == 0
    assert op8_exact_dedup.keep_first(frame(spark, [])).count() == 0


def test_merging_with_and_without_an_index():
    empty = pa.table({"shard": pa.array([], pa.int32())})
    new = pa.table(
        {
            "shard": pa.array([0], pa.int32()),
            "digest": pa.array([bytes(32)]),
            "win_id": [5],
            "win_row": [1],
            "size": [2],
        }
    )
    assert op8_exact_dedup._merge(new, empty).to_pylist()[0]["win_id"] == 5
    index = op8_exact_dedup._index_of(new)
    assert op8_exact_dedup._merge(new.slice(0, 0), index).to_pylist()[0]["size"] == 2
    assert op8_exact_dedup._merge(new, index).to_pylist()[0]["size"] == 4


def near_texts(seed: int, n: int) -> dict[int, str | None]:
    """Families of edited copies, unrelated texts, a common passage, and odd texts."""
    draw = random.Random(seed)
    word = lambda: draw.choice("the of and".split()) if draw.random() < 0.3 else f"w{draw.randrange(3000)}"
    passage = [f"p{k}" for k in range(60)]
    texts: dict[int, str | None] = {}
    while len(texts) < n:
        base = [word() for _ in range(draw.choice([2, 5, 12, 40, 150, 600]))]
        for _ in range(draw.choice([1, 1, 2, 9])):
            copy = list(base)
            for _ in range(draw.choice([0, 1, 1, 2, len(base) // 30, len(base) // 50])):
                copy[draw.randrange(len(copy))] = word()
            if draw.random() < 0.2:
                copy += passage
            texts[len(texts)] = draw.choice([" ", "  ", "\n"]).join(copy)
    texts |= {n + 10: None, n + 11: "", n + 12: " \n ", n + 13: "One", n + 14: "oNE", n + 15: "one two", n + 16: "É", n + 17: "é"}
    return texts


@pytest.mark.parametrize(("words", "percent", "block"), [(3, 90, 2000), (5, 80, 2000), (5, 80, 3)])
def test_near_components(spark, monkeypatch, words, percent, block):
    monkeypatch.setattr(op3_jaccard, "BLOCK_MEMBERS", block)
    texts = near_texts(words + block, 260)
    rows, joined = op3_jaccard.link_components(frame(spark, texts.items()).repartition(4), words, percent)
    assert {r["doc_id"]: r["n"] for r in rows.collect()} == {k: len(plain.shingles(t, words)) for k, t in texts.items()}
    found = {k: k for k in texts} | {r["node"]: r["component"] for r in joined.collect()}
    assert found == plain.near_components(texts, words, percent)


def test_rows_with_equal_ids_are_one_document(spark):
    words = [f"w{k}" for k in range(60)]
    one, two = " ".join(words[:40]), " ".join(words[20:])
    rows = [(1, one), (2, two), (3, one), (3, two), (3, two), (4, two + " more"), (9, "alone"), (9, "alone")]
    counts, joined = op3_jaccard.link_components(frame(spark, rows), 5, 80)
    assert counts.count() == len(rows)
    found = {r["node"]: r["component"] for r in joined.collect()}
    assert [found.get(k, k) for k in (1, 2, 3, 4, 9)] == [1, 1, 1, 1, 9]
    assert joined.select("node").distinct().count() == joined.count()


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_common_counters_do_not_matter_for_the_result(spark, monkeypatch, share):
    """Leaving any shingles out of the segments loses no link."""
    common = np.random.default_rng(1).random(op3_jaccard.COUNTERS) < share
    monkeypatch.setattr(op3_jaccard, "common_counters", lambda rows: common)
    texts = near_texts(8, 200)
    _, joined = op3_jaccard.link_components(frame(spark, texts.items()), 5, 80)
    found = {k: k for k in texts} | {r["node"]: r["component"] for r in joined.collect()}
    assert found == plain.near_components(texts, 5, 80)


def test_common_shingles_stand_out(spark):
    texts = {k: f"only here {k} " * 3 + "a line that very many documents share" for k in range(500)}
    rows = op3_jaccard.set_rows(frame(spark, texts.items()).select("doc_id", "text").coalesce(2), 5)
    common = op3_jaccard.common_counters(rows)
    shared = next(op3_jaccard.shingle_sets(pa.array(["a line that very many documents share"]), 5))
    assert common[op3_jaccard.counter_of(shared)].all()
    assert common.sum() < 40


def test_linked_documents_always_meet():
    """The lossless step, tried on pairs of sets just at the limit."""
    draw = np.random.default_rng(2)
    for percent in (80, 90):
        for size in [*range(1, 60), 100, 333, 900]:
            for dropped in (0.0, 0.5, 0.98):
                common = draw.random(op3_jaccard.COUNTERS) < dropped
                a = np.unique(draw.integers(0, 1 << 63, size).astype(np.uint64))
                most = len(a) * (100 - percent) // (100 + percent)
                b = np.unique(np.append(a[most:], draw.integers(0, 1 << 63, most).astype(np.uint64)))
                if not op3_jaccard.linked(a, b, percent) or np.array_equal(a, b):
                    continue
                keys = [set(op3_jaccard.meeting_keys(s, percent, common).tolist()) for s in (a, b)]
                assert keys[0] & keys[1], (percent, size, dropped)


def test_near_copies_keep_one(spark):
    texts = near_texts(5, 150)
    docs = frame(spark, [*texts.items(), (None, "a b c d e f g"), (None, "a b c d e f g")])
    kept = op3_jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    plainly = plain.near_components(texts, 5, 80)
    found = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in found if x is not None) == sorted(set(plainly.values()))
    assert found.count(None) == 2
    assert op3_jaccard.keep_one(frame(spark, [])).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(6, 40)] + [(7, 7), (200, 201), (201, 200)]
    frame_ = spark.createDataFrame(edges, "src long, dst long")
    found = {r["node"]: r["component"] for r in components(frame_).collect()}
    assert all(found[k] == 100 for k in range(100, 161))
    assert all(found[k] == 5 for k in range(5, 40))
    assert found[201] == 200
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_trees_tell_members_of_other_sizes_apart(monkeypatch):
    """A family around one common line: few pairs of nodes are looked at, and no link is lost."""
    draw = np.random.default_rng(5)
    line = draw.integers(1 << 62, size=8, dtype=np.uint64)
    sets = []
    for k in range(900):
        own = draw.integers(1 << 62, size=int(10 * 1.012 ** (k % 450)), dtype=np.uint64)
        sets.append(np.unique(np.append(line, own)))
        if k % 7 == 0:
            sets.append(np.unique(np.append(sets[-1][: -len(sets[-1]) // 20 or None], draw.integers(1 << 62, size=1, dtype=np.uint64))))
    ids = list(range(len(sets)))
    looks, may_link = [], op3_jaccard.SignatureTree.may_link

    def counted(self, *args):
        looks.append(1)
        return may_link(self, *args)

    monkeypatch.setattr(op3_jaccard.SignatureTree, "may_link", counted)
    table = pa.table({"doc_id": ids, "blocks": [1] * len(ids), "shingles": [s.astype("<u8").tobytes() for s in sets]})
    found = op3_jaccard.tree_edges(90)(table)
    brute = op3_jaccard.Union(len(sets))
    for a in ids:
        for b in range(a):
            if 9 * len(sets[a]) <= 10 * len(sets[b]) and 9 * len(sets[b]) <= 10 * len(sets[a]):
                if op3_jaccard.linked(sets[a], sets[b], 90):
                    brute.join(a, b)
    edges = {(k, brute.find(k)) for k in ids if brute.find(k) != k}
    assert len(edges) > 50 and edges == set(zip(found["src"].to_pylist(), found["dst"].to_pylist(), strict=True))
    nodes = len(sets) / op3_jaccard.FAN_OUT
    assert len(looks) < nodes * nodes / 4


def test_one_component_search_for_small_families(spark, monkeypatch):
    """Each search is many small stages; the segments only need their documents, not components."""
    searches, search = [], op3_jaccard.components

    def counted(edges):
        searches.append(1)
        return search(edges)

    monkeypatch.setattr(op3_jaccard, "components", counted)
    texts = near_texts(3, 120)
    _, joined = op3_jaccard.link_components(frame(spark, texts.items()), 5, 80)
    found = {k: k for k in texts} | {r["node"]: r["component"] for r in joined.collect()}
    assert found == plain.near_components(texts, 5, 80)
    assert len(searches) == 1


@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_documents_that_share_a_segment(spark, monkeypatch, batch):
    """Whichever batch and task they come from; a document alone under its id shares with none."""
    monkeypatch.setattr(common_helpers, "BATCH_ROWS", batch)
    texts = near_texts(9, 90)
    alone = " ".join(f"alone{k}" for k in range(50))
    rows = [*texts.items(), (500, alone), (500, alone), (None, alone)]
    nothing = np.zeros(op3_jaccard.COUNTERS, bool)
    docs = frame(spark, rows).select("doc_id", "text").repartition(3)
    found = [r["doc_id"] for r in op3_jaccard.sharing(docs, 5, 80, nothing).collect()]
    owners: dict[int, set[int]] = {}
    for doc_id, text in rows:
        shingles = next(op3_jaccard.shingle_sets(pa.array([text], pa.string()), 5))
        if doc_id is not None and len(shingles):
            for key in op3_jaccard.meeting_keys(shingles, 80, nothing).tolist():
                owners.setdefault(key, set()).add(doc_id)
    assert sorted(found) == sorted(set().union(*(ids for ids in owners.values() if len(ids) > 1)))


def test_numbers_are_packed_and_dealt(monkeypatch):
    monkeypatch.setattr(packed, "LOAD_NUMBERS", 300)
    draw = np.random.default_rng(6)
    hashes = draw.integers(0, 1 << 48, 1000)
    ids = draw.choice([-(1 << 63), -5, 0, 7, (1 << 63) - 1], 1000)
    few = draw.integers(0, 3, 1000)
    sent = list(packed.loads(zip(*(np.split(c, 10) for c in (hashes, ids, few)), strict=True)))
    assert [len(load[0]) for load in sent] == [300, 300, 300, 100]
    batches = []
    for load in sent:
        order = np.argsort(load[0], kind="stable")
        load = [c[order] for c in load]
        place = packed.part_of(load[0], 48, 7)
        assert (np.diff(place) >= 0).all() and place.min() >= 0 and place.max() < 7
        batches.append(packed.dealt(place, 0, load))
    batches.append(packed.dealt(np.zeros(0, np.int64), 1, [np.zeros(0, np.int64)]))
    table = pa.Table.from_batches(batches)
    assert table.num_rows == 28
    found = packed.gathered(table, 0, 3)
    assert sorted(zip(*found, strict=True)) == sorted(zip(hashes, ids, few, strict=True))
    assert [len(c) for c in packed.gathered(table, 1, 1)] == [0]
    small = packed.pack([np.arange(1 << 40, (1 << 40) + 1000), np.full(1000, 300)])
    assert len(small) < 4000


def test_rare_shingles_come_first(spark):
    """A passage that all have doesn't make one family of documents that link in pairs."""
    passage = " ".join(f"p{k}" for k in range(60))
    texts = {}
    for k in range(40):
        own = [f"own{k}x{j}" for j in range(90)]
        texts[2 * k] = " ".join(own) + " " + passage
        texts[2 * k + 1] = " ".join([*own, "more"]) + " " + passage
    docs = frame(spark, texts.items()).select("doc_id", "text")
    members = spark.createDataFrame([(k, len(plain.shingles(t, 5))) for k, t in texts.items()], "doc_id long, n long")
    families = {r["node"]: r["component"] for r in components(op3_jaccard.shared_prefixes(docs, members, 5, 80)).collect()}
    assert families == {k: k - k % 2 for k in texts}


def test_sizes_end_a_run(spark):
    """The rarest shingles of a document, shared with a much smaller one, join nothing; with several texts they do."""
    small, base = " ".join(f"s{k}" for k in range(40)), " ".join(f"b{k}" for k in range(400))
    rows = [(1, small), (2, f"{base} {small}"), (3, f"{base} more"), (4, f"{base} and more")]
    docs = frame(spark, rows).select("doc_id", "text")
    for mixed_id, least in ((None, {2: 2, 3: 2, 4: 2}), (2, {1: 1, 2: 1, 3: 1, 4: 1})):
        sized = [(k, 0 if k == mixed_id else len(plain.shingles(t, 5))) for k, t in rows]
        members = spark.createDataFrame(sized, "doc_id long, n long")
        edges = op3_jaccard.shared_prefixes(docs, members, 5, 80)
        assert {r["node"]: r["component"] for r in components(edges).collect()} == least


def test_short_hashes_lose_no_link(spark, monkeypatch):
    """Hashes of so few bits that most are shared only make families larger."""
    texts = near_texts(12, 150)
    cut = lambda hashes: ((hashes >> np.uint64(58)) << np.uint64(42)).view(np.int64)
    monkeypatch.setattr(op3_jaccard, "short", cut)
    _, joined = op3_jaccard.link_components(frame(spark, texts.items()), 5, 80)
    found = {k: k for k in texts} | {r["node"]: r["component"] for r in joined.collect()}
    assert found == plain.near_components(texts, 5, 80)


def test_settled_frames_leave_no_shuffle_files(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", blocks.getAllFiles().mkString(" ")))
    before = files()
    kept = common_helpers.settle(spark.range(10_000).repartition(5, "id"))
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(common_helpers.DROP_SHUFFLED) == "false"
    assert kept.count() == 10_000
