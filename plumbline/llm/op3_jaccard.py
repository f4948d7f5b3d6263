"""N-gram Jaccard self-join by signature trees.

A document's set holds its distinct word shingles as 64-bit hashes.  Two
documents link when ``100 * |intersection| >= percent * |union|``; the result
is each document's component.

1. *Equal sets* form classes by a digest; a class is represented by its least id.
2. *Families.*  Linked sets of at most ``hi`` shingles differ in at most
   ``D = 2 hi (100 - percent) / (100 + percent)`` shingles.  Dealt into more than
   ``D`` segments by hash, they agree in one segment at least.  Each document
   sends a hash of every non-empty segment; those that share one with another
   document stay, the others link with nothing but equal sets.
   Size bands keep ``D`` near a document's own size.  Very common shingles are
   left out of the segments: that removes differences at most, so agreement
   holds.  A document with so many empty segments that agreement might be among
   those alone sends the segments of its full set as well.
   Of those that stay, shingles come in a common order, those that fewest of them have
   first; linked documents share one of the first ``n - ceil(n * percent / 100) + 1``
   shingles of each.  A document with that many shingles of its own leaves, the
   others are joined by the shingles they share there, as far as the place of the
   shingle leaves room for an overlap that is enough for both sizes; the connected
   components are the families.  No link leaves a family, and documents with a passage
   in common, but little else, lie in different ones.
3. *Signature trees.*  In a family, sets become bitmaps; a node holds the OR of
   its members' bitmaps and the range of their sizes.  A dual traversal drops
   node pairs whose greatest possible overlap is too small for their sizes, and
   those that already are one component; pairs of leaves that remain are
   checked on the full sets.
   A large family (``BLOCK_SHINGLES``, ``BLOCK_MEMBERS``) is dealt into blocks that
   all hold the family's first member; only if these leave it in several
   components, pairs of blocks are traversed, skipping what is joined.

Segment hashes repeated within a load of a task leave it once, with a row for each document
that has one, so a group with a third of all documents sends few rows a task.  Texts are read again instead of
moving sets: only documents of a family with different sets are ever shuffled.  Hashes
of segments and shingles are shuffled packed (``packed``), cut to ``SHORT`` bits: two
that become one make a family larger at most, links are checked on the full sets.

Cases: null, empty and blank texts have an empty set and link with nothing;
shorter texts than a shingle are one shingle; rows without id keep a null
component; rows with equal ids count as one document in the components; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import by_batches, components, read, settle, ship
from plumbline.llm.packed import PACKED, dealt, gathered, loads, part_of, parts_for

WORDS, PERCENT = 3, 90

COUNTERS, COUNTERS_A_ROW = 1 << 23, 1 << 16
BAND_STEPS = {True: 4, False: 2}  # of the size ratio, for percentages of at least 90 and below
BROADCAST_IDS = 500_000
BLOCK_SHINGLES, BLOCK_MEMBERS = 1 << 21, 8192
FAN_OUT = 16
BITS_PER_SHINGLE, MOST_BITS = 8, 1 << 15

MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
ODD = np.uint64(0x9E3779B97F4A7C15)
NONE = np.zeros(0, np.uint64)
SHORT = 48  # bits
ANY = (1 << 40) - 1  # more shingles than any document has


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, ASCII white space between) and each text's first."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    table = coded.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, table), np.uint64, len(table))
    empty = np.fromiter((not w for w in table), bool, len(table))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    first = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
    words = hashes[codes]
    if empty.any():
        real = ~empty[codes]
        first = np.append(0, np.cumsum(real))[first]
        words = words[real]
    return words, first


def shingle_sets(texts: pa.Array, words: int):
    """The sorted distinct shingle hashes of each text."""
    hashes, first = word_hashes(texts)
    n = max(0, len(hashes) - words + 1)
    rolled = np.full(n, ODD)
    for k in range(words):
        rolled = mixed(rolled * ODD + hashes[k : k + n])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(rolled[a : b - words + 1])
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for h in hashes[a:b]:
                whole = mixed(whole * ODD + h)
            yield whole
        else:
            yield np.zeros(0, np.uint64)


def short(hashes: np.ndarray) -> np.ndarray:
    """Fewer bits, for shuffles; where two hashes become one, more seems shared, and nothing less."""
    return (hashes >> np.uint64(64 - SHORT)).view(np.int64)


def _starts(values: np.ndarray) -> np.ndarray:
    """Which of sorted values differ from the one before."""
    return np.append(True, values[1:] != values[:-1])[: len(values)]


def counter_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(COUNTERS - 1)).astype(np.int64)


@lru_cache(maxsize=4)
def bands(percent: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """For each band of sizes: least, greatest, most differences of a linked pair, segments."""
    ratio = (100 / percent) ** BAND_STEPS[percent >= 90]
    lows, highs, most, segments = [], [], [], []
    low = 1
    while low < 1 << 32:
        high = max(low, int(low * ratio))
        differ = 2 * high * (100 - percent) // (100 + percent)
        spare, needed = 0, 1
        while needed > spare and spare < 2 * differ + 8:  # room for the segments that are empty by chance
            spare = needed
            n = differ + 1 + spare
            load = low / n
            mean = n * math.exp(-load)
            spread = math.sqrt(mean * max(0.0, 1 - (1 + load) * math.exp(-load)))
            needed = math.ceil(mean + 3 * spread + 1)
        lows.append(low)
        highs.append(high)
        most.append(differ)
        segments.append(differ + 1 + spare)
        low = high + 1
    return lows, highs, most, segments


def band_keys(shingles: np.ndarray, band: int, percent: int, tag: int) -> tuple[np.ndarray, bool]:
    """Hashes of the non-empty segments, and whether those suffice for a linked pair to meet."""
    _, _, most, segments = bands(percent)
    n = segments[band]
    at = ((shingles >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)  # ascending, as the shingles are
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
    sums = np.add.reduceat(mixed(shingles), starts) if len(at) else np.zeros(0, np.uint64)
    keys = mixed(sums + mixed(at[starts] * ODD + np.uint64(band * 4 + tag + 1)))
    return keys, n - len(starts) < n - most[band]


def meeting_keys(shingles: np.ndarray, percent: int, common: np.ndarray) -> np.ndarray:
    """All keys of a document; two linked documents share one unless their sets are equal."""
    lows, _, most, _ = bands(percent)
    size = len(shingles)
    own = bisect_right(lows, size) - 1
    chosen = [own] + ([own + 1] if size * 100 // percent >= lows[own + 1] else [])
    rare = shingles[~common[counter_of(shingles)]]
    keys = []
    for band in chosen:
        if not most[band]:
            continue
        more, enough = band_keys(rare, band, percent, 0)
        keys.append(more)
        if not enough:
            more, enough = band_keys(shingles, band, percent, 1)
            keys.append(more)
        if not enough:
            keys.append(mixed(np.array([band * 4 + 3], np.uint64)))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def set_rows(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n, digest`` of every row, and the counters of shingles that stand out in a task."""

    def work(batches):
        counters = np.zeros(COUNTERS, np.int32)
        for batch in batches:
            sizes, digests, parts = [], [], []
            for found in shingle_sets(batch.column(1), words):
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                parts.append(found)
            at, times = np.unique(counter_of(np.concatenate(parts or [np.zeros(0, np.uint64)])), return_counts=True)
            counters[at] += times.astype(np.int32)
            yield _rows(batch.column(0), sizes, digests)
        mean = counters.mean()
        often = np.flatnonzero(counters > max(3, mean + 4 * math.sqrt(mean) + 1))
        yield _rows(pa.nulls(len(often), pa.int64()), [0] * len(often), None, often)

    def _rows(ids, sizes, digests, counter=None):
        n = len(ids)
        arrays = [
            ids,
            pa.array(sizes, pa.int64()),
            pa.array(digests or [None] * n, pa.binary()),
            pa.nulls(n, pa.int64()) if counter is None else pa.array(counter, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "digest", "counter"])

    return by_batches(docs, work, "doc_id long, n long, digest binary, counter long")


def common_counters(rows: DataFrame) -> np.ndarray:
    """The counters that stand out in some task; ``COUNTERS`` bits are collected, whatever the input."""

    def packed(table: pa.Table) -> pa.Table:
        common = np.zeros(COUNTERS_A_ROW, bool)
        common[table["counter"].to_numpy() % COUNTERS_A_ROW] = True
        first = pa.array([table["row"][0].as_py()], pa.int64())
        return pa.table([first, pa.array([np.packbits(common).tobytes()], pa.binary())], names=["row", "bits"])

    found = rows.where("counter IS NOT NULL").select("counter").distinct()
    found = found.withColumn("row", F.floor(F.col("counter") / COUNTERS_A_ROW))
    common = np.zeros(COUNTERS, bool)
    for row in found.groupBy("row").applyInArrow(packed, "row long, bits binary").collect():
        at = row["row"] * COUNTERS_A_ROW
        common[at : at + COUNTERS_A_ROW] = np.unpackbits(np.frombuffer(row["bits"], np.uint8))
    return common


def distinct_pairs(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, sorted by key and id, without repeats, and which of them have a key that another id has too."""
    new = np.append(True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]))[: len(keys)]
    keys, ids = keys[new], ids[new]
    same = np.append(False, keys[1:] == keys[:-1])[: len(keys)]
    return keys, ids, same | np.append(same[1:], False)[: len(keys)]


def id_part(ids: np.ndarray, parts: int) -> np.ndarray:
    return part_of(mixed(ids.astype(np.uint64) + ODD), 64, parts)


def sharing(docs: DataFrame, words: int, percent: int, common: np.ndarray, shingles: int = 0) -> DataFrame:
    """``doc_id`` of the documents that share a segment with another one, each once."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    parts = parts_for(shingles)

    def keys_of(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found = [
                meeting_keys(s, percent, shared.value) if len(s) else s for s in shingle_sets(batch.column(1), words)
            ]
            yield short(np.concatenate(found or [NONE])), np.repeat(ids, [len(k) for k in found])

    def send(batches):
        for keys, owners in loads(keys_of(batches)):
            order = np.lexsort((owners, keys))
            keys, owners, same = distinct_pairs(keys[order], owners[order])
            # A document known to share one goes on at once; a key once, as others may wait for it.
            known = np.unique(owners[same])
            first = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
            yield dealt(part_of(keys[first], SHORT, parts), 0, [keys[first], owners[first]])
            place = id_part(known, parts)
            order = np.argsort(place, kind="stable")
            yield dealt(place[order], 1, [known[order]])

    def meet(table: pa.Table) -> pa.Table:
        keys, owners = gathered(table, 0, 2)
        order = np.lexsort((owners, keys))
        _, ids, same = distinct_pairs(keys[order], owners[order])
        return pa.table([pa.array(np.unique(np.append(ids[same], gathered(table, 1, 1)[0])), pa.int64())], names=["doc_id"])

    sent = by_batches(docs.where("doc_id IS NOT NULL"), send, PACKED)
    return sent.groupBy("part").applyInArrow(meet, "doc_id long").distinct()


def by_batches_of(frame: DataFrame, work, schema: str) -> DataFrame:
    """``mapInArrow`` over narrow rows; the batch settings of texts hold here too."""
    return frame.mapInArrow(work, schema)


class Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, k: int) -> int:
        parent = self.parent
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def is_one(self, spans) -> bool:
        """Whether all members of the ranges are one component."""
        root = self.find(spans[0][0])
        return all(self.find(k) == root for a, b in spans for k in range(a, b))


class SignatureTree:
    """Members in leaf order, and levels of nodes above them, ``FAN_OUT`` children each."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets], np.int64)
        bits = 64
        while bits < min(MOST_BITS, BITS_PER_SHINGLE * int(sizes.max(initial=1))):
            bits *= 2
        maps = np.zeros((len(sets), bits // 8), np.uint8)
        for k, s in enumerate(sets):
            at = np.zeros(bits, bool)
            at[(s & np.uint64(bits - 1)).astype(np.int64)] = True
            maps[k] = np.packbits(at)
        maps = maps.view(np.uint64)
        excess = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, sizes, sizes, excess)]
        while len(self.levels[-1][0]) > 1:
            maps, least, most, excess = self.levels[-1]
            starts = np.arange(0, len(maps), FAN_OUT)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(maps, starts),
                    np.minimum.reduceat(least, starts),
                    np.maximum.reduceat(most, starts),
                    np.maximum.reduceat(excess, starts),
                )
            )

    def members(self, level: int, node: int) -> tuple[int, int]:
        width = FAN_OUT**level
        return node * width, min(len(self.levels[0][0]), (node + 1) * width)

    def children(self, level: int, node: int) -> range:
        return range(node * FAN_OUT, min(len(self.levels[level - 1][0]), (node + 1) * FAN_OUT))

    def may_link(self, level: int, a: np.ndarray, b: np.ndarray, percent: int, wanted: np.ndarray | None = None) -> np.ndarray:
        """Which pairs ``a x b`` of a level's nodes can hold a linked pair: by sizes, and of those by overlap."""
        maps, least, most, excess = self.levels[level]
        may = (100 * most[a][:, None] >= percent * least[b][None, :]) & (
            100 * most[b][None, :] >= percent * least[a][:, None]
        )
        if wanted is not None:
            may &= wanted
        i, j = np.nonzero(may)
        one, two = a[i], b[j]
        common = np.bitwise_count(maps[one] & maps[two]).sum(axis=1, dtype=np.int64)
        common += np.minimum(excess[one], excess[two])
        overlap = np.minimum(common, np.minimum(most[one], most[two]))
        may[i, j] = (100 + percent) * overlap >= percent * (least[one] + least[two])
        return may


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    overlap = int((both[1:] == both[:-1]).sum())
    return 100 * overlap >= percent * (len(a) + len(b) - overlap)


def traverse(sets: list[np.ndarray], union: Union, percent: int, sides: list[int] | None = None) -> None:
    """Join all linked members; with ``sides`` only pairs from different sides matter."""
    tree = SignatureTree(sets)
    stack = [(len(tree.levels) - 1, 0, 0)]
    while stack:
        level, a, b = stack.pop()
        spans = [tree.members(level, a), tree.members(level, b)]
        if union.is_one(spans):
            continue
        if level == 0:
            if (sides is None or sides[a] != sides[b]) and linked(sets[a], sets[b], percent):
                union.join(a, b)
            continue
        one, two = np.array(tree.children(level, a)), np.array(tree.children(level, b))
        wanted = None
        if a == b:
            wanted = one[:, None] <= two[None, :] if level > 1 else one[:, None] < two[None, :]
        may = tree.may_link(level - 1, one, two, percent, wanted)
        # Pairs near the diagonal last: they are popped, and joined, first.
        pairs = sorted(zip(*(x.tolist() for x in np.nonzero(may)), strict=True), key=lambda p: p[0] - p[1])
        stack += [(level - 1, int(one[i]), int(two[j])) for i, j in pairs]


def in_leaf_order(ids: list[int], sets: list[np.ndarray], percent: int) -> list[int]:
    """Sets that may link next to each other: by bands of size, in them by their least shingles.

    Linked sets lie in one band or in two that follow each other, so the sizes
    of nodes tell most pairs of them apart.
    """
    width = math.log(100 / percent)
    band = [int(math.log(max(1, len(s))) / width) if width else len(s) for s in sets]
    return sorted(range(len(ids)), key=lambda k: (band[k], *sets[k][:2].tolist(), len(sets[k]), ids[k]))


def _sets_of(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(s, "<u8") for s in table["shingles"].to_pylist()]


EDGE = "src long, dst long"


def _edges(ids: list[int], union: Union) -> pa.Table:
    """Each member with the least id of its component, where that is another."""
    least: dict[int, int] = {}
    for k, key in enumerate(ids):
        root = union.find(k)
        least[root] = min(key, least.get(root, key))
    pairs = {(key, least[union.find(k)]) for k, key in enumerate(ids)}
    pairs = sorted(p for p in pairs if p[0] != p[1])
    return pa.table(
        [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())],
        names=["src", "dst"],
    )


def tree_edges(percent: int):
    """Joins the members of one block."""

    def work(table: pa.Table) -> pa.Table:
        ids, sets = table["doc_id"].to_pylist(), _sets_of(table)
        order = in_leaf_order(ids, sets, percent)
        ids, sets = [ids[k] for k in order], [sets[k] for k in order]
        union, firsts = Union(len(ids)), {}
        for k, key in enumerate(ids):  # rows with equal ids are one document
            union.join(k, firsts.setdefault(key, k))
        traverse(sets, union, percent)
        edges = _edges(ids, union)
        return edges.append_column("large", pa.array([table["blocks"][0].as_py() > 1] * len(edges), pa.bool_()))

    return work


def cross_edges(percent: int):
    """Joins members of two blocks; what is one component already is joined from the start."""

    def work(table: pa.Table) -> pa.Table:
        ids, sets = table["doc_id"].to_pylist(), _sets_of(table)
        known, blocks = table["component"].to_pylist(), table["block"].to_pylist()
        order = in_leaf_order(ids, sets, percent)
        union, first = Union(len(ids)), {}
        for k, at in enumerate(order):
            union.join(k, first.setdefault(known[at], k))
        traverse([sets[k] for k in order], union, percent, [blocks[k] for k in order])
        return _edges([ids[k] for k in order], union)

    return work


def with_texts(docs: DataFrame, members: DataFrame, count: int) -> DataFrame:
    """Rows of ``docs`` for the members; their ids are broadcast while they are few."""
    return docs.join(F.broadcast(members) if count <= BROADCAST_IDS else members, "doc_id")


def with_sets(rows: DataFrame, words: int, keep: list[str]) -> DataFrame:
    """Texts replaced by their shingle sets."""

    def work(batches):
        for batch in batches:
            sets = [s.astype("<u8").tobytes() for s in shingle_sets(batch.column(0), words)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sets, pa.binary()), *batch.columns[1:]], names=["shingles", *keep]
            )

    return by_batches(
        rows.select("text", *keep), work, ", ".join(["shingles binary", *[f"{c} long" for c in keep]])
    )


def shared_prefixes(docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges ``src, dst`` between members that share a shingle among the first of each and may link by it.

    ``members`` has ``doc_id, n``; an ``n`` of 0 says that a member has several
    texts: all its shingles count as first ones, at any size.
    Shingles of one member alone come first in the order, the others follow by
    the number of members that have them, then by hash.  ``n - r`` being a
    member's own shingles, its first ``p`` hold the least ``r - (n - p)`` of the
    ``r`` it shares with anyone.
    """
    parts = parts_for(members.agg(F.sum("n")).first()[0] or 0)

    def tokens_of(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), words))
            owners = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) for x in sets])
            yield short(np.concatenate(sets or [NONE])), owners

    def send(batches):
        for tokens, owners in loads(tokens_of(batches)):
            order = np.argsort(tokens, kind="stable")
            yield dealt(part_of(tokens[order], SHORT, parts), 0, [tokens[order], owners[order]])

    def counted(table: pa.Table) -> pa.Table:
        """To each member its tokens that others have too, and how many have them."""
        tokens, owners = gathered(table, 0, 2)
        order = np.argsort(tokens, kind="stable")
        times = np.diff(np.append(np.flatnonzero(_starts(tokens[order])), len(order)))
        times = np.repeat(times, times)
        order, times = order[times > 1], times[times > 1]
        place = id_part(owners[order], parts)
        by_part = np.argsort(place, kind="stable")
        order, times = order[by_part], times[by_part]
        return pa.Table.from_batches([dealt(place[by_part], 0, [tokens[order], owners[order], times])])

    def sizes(batches):
        for ids, n in loads(tuple(c.to_numpy(zero_copy_only=False) for c in b.columns) for b in batches):
            place = id_part(ids, parts)
            order = np.lexsort((ids, place))
            yield dealt(place[order], 1, [ids[order], n[order]])

    def firsts(table: pa.Table) -> pa.Table:
        """The first shared tokens of each member, and the greatest size of a set that may link by one."""
        tokens, owners, times = gathered(table, 0, 3)
        ids, n = gathered(table, 1, 2)
        order = np.lexsort((tokens, times, owners))
        tokens, owners = tokens[order], owners[order]
        starts = np.flatnonzero(_starts(owners))
        r = np.diff(np.append(starts, len(owners)))
        by_id = np.argsort(ids)
        n = n[by_id][np.searchsorted(ids[by_id], owners[starts])] if len(starts) else n[:0]
        needed = n - (n * percent + 99) // 100 + 1
        take = np.where(n > 0, r - (n - needed), r)
        rank = np.arange(len(owners)) - np.repeat(starts, r)
        # With ``before`` shingles that can't be shared, the overlap is ``n - before`` at most.
        n, before = np.repeat(n, r), np.repeat(n - r, r) + rank
        most = np.where(n > 0, np.clip((100 + percent) * (n - before) // percent - n, 0, ANY), ANY)
        keep = rank < np.repeat(take, r)
        columns = [tokens[keep], n[keep], owners[keep], most[keep]]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["token", "n", "doc_id", "most"])

    def runs(batches):
        """Rows come sorted by token and size; a run ends where the next size is too large for all before it."""
        last = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if last is not None:
                columns = [np.append(x, c) for x, c in zip(last, columns, strict=True)]
            token, n, doc_id, most = columns
            if not len(token):
                continue
            new = _starts(token)
            base = np.cumsum(new) * (ANY + 1)
            most = np.maximum.accumulate(base + most) - base
            new[1:] |= most[:-1] < n[1:]
            head = doc_id[np.flatnonzero(new)][np.cumsum(new) - 1]
            last = token[-1:], n[-1:], head[-1:], most[-1:]
            edge = head != doc_id
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_id[edge], pa.int64()), pa.array(head[edge], pa.int64())], names=["src", "dst"]
            )

    rows = with_texts(docs, members.select("doc_id"), members.count()).select("doc_id", "text")
    shared = by_batches(rows, send, PACKED).groupBy("part").applyInArrow(counted, PACKED)
    shared = shared.unionByName(by_batches_of(members.select("doc_id", "n"), sizes, PACKED))
    first = shared.groupBy("part").applyInArrow(firsts, "token long, n long, doc_id long, most long")
    return by_batches_of(first.repartition("token").sortWithinPartitions("token", "n", "doc_id"), runs, EDGE)


def link_components(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, n)`` of every row, and ``(node, component)`` of all documents that link."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ship(docs.sparkSession)
    rows = settle(set_rows(docs, words))
    sets = rows.where("counter IS NULL").select("doc_id", "n", "digest")
    named = sets.where("doc_id IS NOT NULL AND n > 0")
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"))
    equal = named.join(classes.select("digest", "first"), "digest").where("doc_id <> first").select(
        F.col("doc_id").alias("src"), F.col("first").alias("dst")
    )
    equal = settle(equal.distinct())

    firsts = classes.groupBy(F.col("first").alias("doc_id")).agg(F.max("n").alias("n"))
    shingles = sets.agg(F.sum("n")).first()[0] or 0
    members = settle(sharing(docs, words, percent, common_counters(rows), shingles).join(firsts, "doc_id"))
    several = named.groupBy("doc_id").agg((F.min("digest") != F.max("digest")).alias("several"))
    several = settle(several.where("several").select("doc_id", F.lit(0).cast("long").alias("none")))
    mixed_ids = not several.isEmpty()
    sized = members
    if mixed_ids:
        sized = members.join(several, "doc_id", "left").select("doc_id", F.coalesce("none", "n").alias("n"))
    families = components(shared_prefixes(docs, sized, words, percent))
    members = families.join(members.withColumnRenamed("doc_id", "node"), "node")
    sizes = members.groupBy("component").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.ceil(F.col("members") / BLOCK_MEMBERS))
    members = settle(
        members.join(sizes.where("members > 1"), "component").select(
            F.col("node").alias("doc_id"), F.col("component").alias("family"), blocks.cast("long").alias("blocks")
        )
    )
    count = members.count()

    placed = with_texts(docs, members, count)
    block = F.when(F.col("doc_id") == F.col("family"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("doc_id"), "blocks"))
    )
    dealt = with_sets(placed, words, ["doc_id", "family", "blocks"]).withColumn("block", F.explode(block))
    found = settle(dealt.groupBy("family", "block").applyInArrow(tree_edges(percent), f"{EDGE}, large boolean"))

    # A family in one block is done: its members point to the least of their component.
    joined = found.where("NOT large").select(F.col("src").alias("node"), F.col("dst").alias("component"))
    large = members.where("blocks > 1")
    if not large.isEmpty():
        edges = found.where("large").select("src", "dst")
        more = across_blocks(docs, large, components(edges), words, percent)
        joined = joined.unionByName(components(edges.unionByName(more)))
    if mixed_ids:  # an id with different texts joins what each of them links with
        links = joined.select(F.col("node").alias("src"), F.col("component").alias("dst"))
        return sets.select("doc_id", "n"), components(links.unionByName(equal))
    firsts = joined.select(F.col("node").alias("dst"), "component")
    copies = equal.join(firsts, "dst", "left").select(
        F.col("src").alias("node"), F.coalesce("component", "dst").alias("component")
    )
    joined = joined.where("node <> component").unionByName(copies)
    return sets.select("doc_id", "n"), joined


def across_blocks(docs: DataFrame, large: DataFrame, joined: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges between blocks of families that their blocks left in several components."""
    labelled = large.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id")
    )
    split = (
        labelled.groupBy("family")
        .agg(F.min("component").alias("a"), F.max("component").alias("b"))
        .where("a <> b")
        .select("family")
    )
    rest = settle(labelled.join(split, "family", "left_semi"))
    rows = with_texts(docs, rest, rest.count())
    rows = with_sets(rows, words, ["doc_id", "family", "blocks", "component"])
    own = F.pmod(F.xxhash64("doc_id"), "blocks")
    other = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: k != own)
    dealt = (
        rows.withColumn("block", own)
        .withColumn("other", F.explode(other))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
    )
    return settle(dealt.groupBy("family", "low", "high").applyInArrow(cross_edges(percent), EDGE))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id") -> DataFrame:
    """One document of each component stays, the one with the least id, with all its columns."""
    _, joined = link_components(docs, words, percent, id_col)
    gone = joined.where("node <> component").select(F.col("node").alias("__gone")).distinct()
    gone = settle(gone)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, joined = link_components(read(spark, sf_dir, "documents"))
    return rows.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )
