"""Exact dedup: a minimal perfect hash over historical distinct digests.

The history's distinct SHA-256 digests are dealt to shards by their leading
bits.  A task builds a shard's minimal perfect hash: in each level every digest
picks a place, places picked once become slots, the rest goes on.  A slot holds
the full 32 bytes, the winner's locator (doc_id and row) and the group's size.
New digests are looked up in their shard; the slot's bytes are compared, so a
digest that the history lacks can't pass for a member.  Members add to their
slot's group, nonmembers form groups of their own.

Rows are reduced to one per digest and task before any shuffle, so a group that
holds a third of all rows moves a few rows; texts never move.  Equal texts are
those whose UTF-8 bytes have the same SHA-256.  Of a group the row with the
largest id stays (ids compare as numbers, null lowest); among rows with equal
id the one last in row order.

Cases: a null text counts as empty; a null id may win only a group without
others; repeated rows leave one; an empty history makes all rows nonmembers;
an empty table gives an empty result; other columns are neither read nor lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import read, settle

SHARD_DIGESTS = 100_000
SPREAD = 1.5
LEVELS = 40

GROUP = "shard int, digest binary, win_id long, win_row long, size long"
INDEX = "shard int, sizes array<int>, bits binary, slots binary, win_ids array<long>, win_rows array<long>, counts array<long>"
ROW = "__row"


def places(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """A place below ``size`` for each digest (four 64-bit words), another one in each level."""
    x = words[:, level % 4] ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def words_of(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, "<u8").reshape(-1, 4)


def build(words: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, the levels' bits end to end, and each digest's slot."""
    left, sizes, levels = np.arange(len(words)), [], []
    slots, taken = np.full(len(words), -1, np.int64), 0
    while len(left):
        if len(sizes) == LEVELS:
            raise ValueError("digests are not distinct")
        size = max(8, int(len(left) * SPREAD))
        at = places(words[left], len(sizes), size)
        single = np.bincount(at, minlength=size) == 1
        rank = np.cumsum(single) - 1 + taken
        done = single[at]
        slots[left[done]] = rank[at[done]]
        taken += int(done.sum())
        sizes.append(size)
        levels.append(single)
        left = left[~done]
    return sizes, np.concatenate(levels) if levels else np.zeros(0, bool), slots


def slots_of(words: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each digest; a nonmember gets some slot or -1."""
    rank = np.cumsum(bits) - 1
    slots, left, base = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for level, size in enumerate(sizes):
        at = places(words[left], level, size) + base
        hit = bits[at]
        slots[left[hit]] = rank[at[hit]]
        left, base = left[~hit], base + size
    return slots


def _index_of(groups: pa.Table) -> pa.Table:
    words = words_of(b"".join(groups["digest"].to_pylist()))
    sizes, bits, slots = build(words)
    order = np.empty(len(slots), np.int64)
    order[slots] = np.arange(len(slots))
    held = groups.take(pa.array(order))
    row = {
        "shard": groups["shard"][0].as_py(),
        "sizes": sizes,
        "bits": np.packbits(bits).tobytes(),
        "slots": b"".join(held["digest"].to_pylist()),
        "win_ids": held["win_id"].to_pylist(),
        "win_rows": held["win_row"].to_pylist(),
        "counts": held["size"].to_pylist(),
    }
    kinds = [pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 3]
    return pa.table([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))


def _merge(new: pa.Table, index: pa.Table) -> pa.Table:
    """Groups of a shard: the history's with what was added, then the nonmembers'."""
    names = ["shard", "digest", "win_id", "win_row", "size"]
    if index.num_rows == 0:
        return new.select(names)
    entry = index.to_pylist()[0]
    slots = words_of(entry["slots"])
    win_ids, win_rows, counts = entry["win_ids"], entry["win_rows"], entry["counts"]
    digests = new["digest"].to_pylist()
    words = words_of(b"".join(digests))
    bits = np.unpackbits(np.frombuffer(entry["bits"], np.uint8), count=sum(entry["sizes"])).astype(bool)
    at = slots_of(words, entry["sizes"], bits)
    member = at >= 0
    member[member] = (slots[at[member]] == words[member]).all(axis=1)  # the full bytes decide
    new_ids, new_rows, new_counts = (new[c].to_pylist() for c in names[2:])
    for k in np.flatnonzero(member):
        s = at[k]
        counts[s] += new_counts[k]
        lowest = float("-inf")
        if (lowest if new_ids[k] is None else new_ids[k], new_rows[k]) > (
            lowest if win_ids[s] is None else win_ids[s],
            win_rows[s],
        ):
            win_ids[s], win_rows[s] = new_ids[k], new_rows[k]
    others = np.flatnonzero(~member)
    held = [entry["slots"][i : i + 32] for i in range(0, len(entry["slots"]), 32)]
    columns = [
        [entry["shard"]] * (len(held) + len(others)),
        held + [digests[k] for k in others],
        win_ids + [new_ids[k] for k in others],
        win_rows + [new_rows[k] for k in others],
        counts + [new_counts[k] for k in others],
    ]
    kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=names)


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row, digest`` of each row; ``row`` numbers the rows as they are read."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"),
    )


def groups_of(rows: DataFrame, shards: int) -> DataFrame:
    """One row per digest: the winner's locator and the number of rows."""
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")
    best = F.max(F.struct("doc_id", "row"))
    return (
        rows.groupBy("digest")
        .agg(best.alias("win"), F.count(F.lit(1)).alias("size"))
        .select(
            shard.alias("shard"),
            "digest",
            F.col("win.doc_id").alias("win_id"),
            F.col("win.row").alias("win_row"),
            "size",
        )
    )


def build_index(groups: DataFrame) -> DataFrame:
    """One row per shard with its perfect hash and its slots."""
    return groups.groupBy("shard").applyInArrow(_index_of, INDEX)


def look_up(groups: DataFrame, index: DataFrame) -> DataFrame:
    """All groups after the new ones were looked up in the index."""
    return groups.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_merge_tables, GROUP)


def _merge_tables(new: pa.Table, index: pa.Table) -> pa.Table:
    return _merge(new, index)


def shard_count(rows: DataFrame) -> int:
    """So many that a shard's digests fit a task; rows are an upper bound of the digests."""
    return max(1, -(-rows.count() // SHARD_DIGESTS))


def resolve(history: DataFrame, new: DataFrame, shards: int) -> DataFrame:
    """Groups over two sets of digest rows, with the history behind a perfect hash."""
    index = settle(build_index(groups_of(history, shards)))
    return look_up(groups_of(new, shards), index)


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's group: ``doc_id, keep_id, group_size, kept, digest, row``.

    Rows whose id has an even checksum are taken as the history and the others
    as the new arrivals; all rows take part, and the groups don't depend on
    how they are dealt.
    """
    rows = settle(digest_rows(docs, id_col, text_col))
    shards = shard_count(rows)
    old = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    groups = resolve(rows.where(old), rows.where(~old), shards)
    return rows.join(groups.drop("shard"), "digest").select(
        "doc_id",
        F.col("win_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("win_row")).alias("kept"),
        "digest",
        "row",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    Row numbers are those of the reading order, which a repeated reading of the
    same files keeps.
    """
    kept = duplicates(docs, id_col, text_col).where("kept").select(F.col("row").alias(ROW))
    numbered = docs.withColumn(ROW, F.monotonically_increasing_id())
    return numbered.join(kept, ROW, "left_semi").drop(ROW)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicates(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
