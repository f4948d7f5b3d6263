"""Order-preserving packing by dynamic programming.

Documents are tokenised and laid end to end in reading order.  A window may end
at a document's end, at a sentence's end or, at a higher price, at a place of a
coarse grid.  Of all ways to cut the stream into windows of at most ``size``
tokens the one with the least padding plus truncation penalties is taken:

    cost(j) = penalty(j) + min over i with p(j) - p(i) <= size of
              cost(i) + size - (p(j) - p(i))

The minimum of ``cost(i) + p(i)`` over the reachable ``i`` is the head of a
monotone queue, so each place enters and leaves it once.  A window that ends
with a document and whose length is a power of two needs no padding.

Each partition of the input packs its own documents as they stream by: nothing
is shuffled, a task holds one Arrow batch and what the last windows left over
(and whole the text it reads just now), and a lost task repeats the same cuts.
Sequence ids hold the partition's number, so they are unique over all tasks.

Cases: a null text counts as empty; an empty text is one piece with the end id
alone; a very long text fills many sequences; repeated rows are packed each; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.chunks import byte_chunks, ids_of
from plumbline.llm.common import by_batches, read

SIZE = 2048
END_ID = 1
GRID = 64
SENTENCE_PENALTY = 4
GRID_PENALTY = 20
SENTENCE_ENDS = tuple(b".!?\n")

PIECE = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def best_cuts(places: list[int], penalties: list[int], ends: list[int], size: int) -> tuple[list[float], list[int]]:
    """Least cost and best predecessor of each place; ``ends`` are the indices of documents' ends."""
    n = len(places)
    cost, back = [0.0] * n, [0] * n
    queue, keys, head = [], [], 0
    index = {p: k for k, p in enumerate(places)} if ends else {}
    powers = [2**k for k in range(size.bit_length()) if 2**k <= size]
    ends_at = iter([*ends, n])
    next_end = next(ends_at)
    for j in range(1, n):
        key = cost[j - 1] + places[j - 1]
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            queue.pop()
        keys.append(key)
        queue.append(j - 1)
        here = places[j]
        low = here - size
        while places[queue[head]] < low:
            head += 1
        best, i = keys[head] + size - here, queue[head]
        if j == next_end:
            next_end = next(ends_at)
            for power in powers:
                k = index.get(here - power)
                if k is not None and cost[k] < best:
                    best, i = cost[k], k
        cost[j], back[j] = best + penalties[j], i
    return cost, back


def windows(doc_ends: np.ndarray, sentence_ends: np.ndarray, total: int, size: int, last: bool) -> np.ndarray:
    """Ends of the windows to write now; without ``last`` the final ones stay open."""
    if not last and total < 4 * size:
        return np.zeros(0, np.int64)
    price = np.full(total + 1, -1, np.int16)
    price[::GRID] = GRID_PENALTY
    price[sentence_ends] = SENTENCE_PENALTY
    price[doc_ends] = 0
    price[0] = 0
    if last:
        price[total] = 0
    places = np.flatnonzero(price >= 0)
    ends = np.searchsorted(places, doc_ends)
    cost, back = best_cuts(places.tolist(), price[places].tolist(), ends[ends > 0].tolist(), size)
    at = len(places) - 1
    if not last:
        near = np.flatnonzero(places > total - size)
        at = int(near[np.argmin(np.asarray(cost)[near])])
    cuts = []
    while at:
        cuts.append(int(places[at]))
        at = back[at]
    cuts.reverse()
    return np.array(cuts if last else [c for c in cuts if c <= total - 2 * size], np.int64)


class Stream:
    """Documents that are not yet in a written window."""

    def __init__(self, size: int, first_sequence: int):
        self.size, self.sequence = size, first_sequence
        self.ids = np.zeros(0, np.uint32)
        self.stops = np.zeros(0, np.int64)  # of the sentences
        self.names: list = []
        self.lengths = np.zeros(0, np.int64)
        self.gone = 0  # tokens of the first document that are written

    def add(self, names: list, ids: np.ndarray, first: np.ndarray, is_stop: np.ndarray) -> None:
        sizes = np.diff(first) + 1
        ends = np.cumsum(sizes)
        fresh = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        inner = np.ones(len(fresh), bool)
        inner[ends - 1] = False
        fresh[inner] = ids
        fresh[ends - 1] = END_ID
        stops = np.zeros(len(fresh), bool)
        stops[inner] = is_stop[ids]
        self.stops = np.append(self.stops, np.flatnonzero(stops) + 1 + len(self.ids))
        self.ids = np.append(self.ids, fresh)
        self.names += names
        self.lengths = np.append(self.lengths, sizes)

    def pieces(self, last: bool):
        """Columns of the pieces that can be written now."""
        ends = np.cumsum(self.lengths) - self.gone
        cuts = windows(ends, self.stops, len(self.ids), self.size, last)
        if not len(cuts):
            return None
        upto = int(cuts[-1])
        begins = np.append(0, ends)
        edges = np.union1d(np.append(0, cuts), begins[(begins > 0) & (begins < upto)])
        starts, lengths = edges[:-1], np.diff(edges)
        doc = np.searchsorted(ends, starts, side="right")
        window = np.searchsorted(cuts, starts, side="right")
        opened = np.append(0, cuts)[window]
        doc_starts = (ends - self.lengths)[doc]
        bounds = pa.array((edges * 4).astype(np.int32), pa.int32()).buffers()[1]
        data = pa.py_buffer(np.ascontiguousarray(self.ids[:upto].astype("<u4")))
        columns = (
            [self.names[k] for k in doc],
            starts - doc_starts,
            lengths,
            self.lengths[doc],
            self.sequence + window,
            starts - opened,
            pa.Array.from_buffers(pa.binary(), len(starts), [None, bounds, data]),
        )
        self.sequence += len(cuts)
        done = int(np.searchsorted(ends, upto, side="right"))
        self.gone = int(upto - (ends[done] - self.lengths[done])) if done < len(ends) else 0
        self.names, self.lengths = self.names[done:], self.lengths[done:]
        self.ids = self.ids[upto:].copy()
        self.stops = self.stops[self.stops > upto] - upto
        return columns


def pack(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    size: int = SIZE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit numbers.
    """

    def work(batches):
        scheme = byte_chunks(ranks_path, pattern)
        stops = np.zeros(len(scheme.widths), bool)
        for rank in range(len(stops)):
            token = scheme.encoding.decode_single_token_bytes(rank) if scheme.widths[rank] else b""
            stops[rank] = token[-1:] != b"" and token[-1] in SENTENCE_ENDS
        stops = np.append(stops, False)  # the special token's place
        stream, kind = Stream(size, TaskContext.get().partitionId() << 33), None
        for batch in batches:
            kind = batch.column(0).type
            ids, first = ids_of(batch.column(1), scheme)
            stream.add(batch.column(0).to_pylist(), ids, first, stops)
            yield from written(stream, kind, False)
        if kind is not None:
            yield from written(stream, kind, True)

    def written(stream, kind, last):
        columns = stream.pieces(last)
        if columns is not None:
            arrays = [pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:6]], columns[6]]
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return by_batches(rows, work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {PIECE}")


def digests(pieces: DataFrame) -> DataFrame:
    """The contract's columns."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def packed(docs: DataFrame) -> DataFrame:
    """The pieces of documents under the byte-level vocabulary."""
    import public_tokenizers

    return digests(pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))
