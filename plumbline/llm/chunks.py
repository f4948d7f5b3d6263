"""Tokenising by distinct chunks.

A tokenizer whose tokens never cross certain places in a text gives the same
ids for each stretch between such places, wherever the stretch occurs.  A batch
of texts is cut there, the distinct chunks are encoded once, and the ids are
laid out again by position with numpy.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "\x01"
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
MARKER = "▁"


def laid_out(lengths: np.ndarray, starts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a flat table of all items of the chunks ``codes``, and where each chunk begins."""
    sizes = lengths[codes]
    ends = np.cumsum(sizes)
    begins = ends - sizes
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(starts[codes] - begins, sizes) + np.arange(total)
    return at, np.append(begins, total)


class ByteChunks:
    """Ids of a byte-level BPE with the usual English-first splitting pattern.

    A run of non-space characters takes one preceding space with it, so a text
    with single spaces can be cut before every space.  Texts with longer runs
    of white space, or with the special token, are cut by a pattern instead.
    """

    # White space as the tokenizer sees it: without the four separators U+001C to U+001F.
    CUT = re.compile(r" ?[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+(?![\S\x1c-\x1f])|[^\S\x1c-\x1f]+")
    JOINS = re.compile(r" \S(?:.*\S)?", re.S)

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.widths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.widths[rank] = len(token)

    @staticmethod
    def is_regular(texts: pa.Array) -> np.ndarray:
        odd = pc.match_substring(texts, "  ")
        for more in (
            pc.match_substring(texts, MARK),
            pc.match_substring(texts, SPECIAL),
            pc.ends_with(texts, " "),
            pc.starts_with(texts, " "),
        ):
            odd = pc.or_(odd, more)
        return ~odd.to_numpy(zero_copy_only=False)

    @staticmethod
    def cut_regular(texts: pa.Array) -> pa.ListArray:
        return pc.split_pattern(pc.replace_substring(texts, " ", MARK + " "), MARK)

    def cut(self, text: str) -> list[str]:
        chunks: list[str] = []
        for k, part in enumerate(text.split(SPECIAL)):
            if k:
                chunks.append(SPECIAL)
            chunks.extend(self.CUT.findall(part))
        return chunks

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the chunks and the number of each."""
        counts = np.zeros(len(chunks), np.int64)
        joined = [k for k, c in enumerate(chunks) if self.JOINS.fullmatch(c)]
        rest = sorted(set(range(len(chunks))) - set(joined))
        texts = [chunks[k] for k in joined]
        ids = np.asarray(self.encoding.encode_ordinary("".join(texts)), np.int64)
        widths = np.cumsum(np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts)))
        ends = np.searchsorted(np.cumsum(self.widths[ids]), widths) + 1
        counts[joined] = np.diff(ends, prepend=0)
        singles = [[SPECIAL_ID] if chunks[k] == SPECIAL else self.encoding.encode_ordinary(chunks[k]) for k in rest]
        counts[rest] = [len(x) for x in singles]
        starts = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int64)
        for where, values, sizes in (
            (joined, ids, counts[joined]),
            (rest, np.array([i for x in singles for i in x], np.int64), counts[rest]),
        ):
            if len(where):
                begins = np.cumsum(sizes) - sizes
                flat[np.repeat(starts[where] - begins, sizes) + np.arange(int(sizes.sum()))] = values
        return flat, counts


class PieceChunks:
    """Ids and decoded text of a piece model whose pieces hold white space only at their start.

    The model turns a space into a marker and puts one before the text.  A chunk
    is a run of markers with what follows up to the next; it is held without
    its first marker.
    """

    CUT = re.compile(f"{MARKER}+[^{MARKER}]*")

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        crossing = re.compile(f"[^{MARKER}]{MARKER}")
        for k in range(self.model.get_piece_size()):
            if crossing.search(self.model.id_to_piece(k)):
                raise ValueError(f"piece {k} crosses a white-space marker; chunks can't be encoded alone")

    @staticmethod
    def is_regular(texts: pa.Array) -> np.ndarray:
        odd = pc.match_substring(texts, "  ")
        for more in (
            pc.match_substring(texts, MARKER),
            pc.starts_with(texts, " "),
            pc.ends_with(texts, " "),
            pc.equal(pc.binary_length(texts), 0),
        ):
            odd = pc.or_(odd, more)
        return ~odd.to_numpy(zero_copy_only=False)

    @staticmethod
    def cut_regular(texts: pa.Array) -> pa.ListArray:
        return pc.split_pattern(texts, " ")

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        marked = MARKER + text.replace(" ", MARKER)
        return [c[1:] for c in self.CUT.findall(marked)]

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        alone = self.model.piece_to_id(MARKER)
        found = self.model.encode([c.replace(MARKER, " ") for c in chunks], num_threads=1)
        found = [ids if chunk else [alone] for ids, chunk in zip(found, chunks, strict=True)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.int64, int(counts.sum()))
        return flat, counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Text of each chunk without its first marker, from its ids."""
        values, ends = ids.tolist(), np.cumsum(counts).tolist()
        return self.model.decode([values[b - n : b] for b, n in zip(ends, counts.tolist(), strict=True)])


@lru_cache(maxsize=4)
def byte_chunks(ranks_path: str, pattern: str) -> ByteChunks:
    return ByteChunks(ranks_path, pattern)


@lru_cache(maxsize=4)
def piece_chunks(model_path: str) -> PieceChunks:
    return PieceChunks(model_path)


def cut_all(texts: pa.Array, scheme) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct chunks, the chunk code at every position, and the first position of each text."""
    texts = pc.fill_null(texts, "")
    regular = scheme.is_regular(texts)
    plain = np.flatnonzero(regular)
    odd = np.flatnonzero(~regular)
    lists = scheme.cut_regular(texts.take(pa.array(plain)))
    odd_lists = [scheme.cut(t) for t in texts.take(pa.array(odd)).to_pylist()]
    counts = np.zeros(len(texts), np.int64)
    counts[plain] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    counts[odd] = [len(x) for x in odd_lists]
    flat = lists.flatten()
    coded = pa.concat_arrays([flat, pa.array([c for x in odd_lists for c in x], flat.type)]).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if len(odd):
        # The odd texts' chunks stand at the end; put every chunk where its text is.
        order = np.concatenate([plain, odd])
        sizes = counts[order]
        begins = np.cumsum(counts) - counts
        here = np.cumsum(sizes) - sizes
        put = np.empty_like(codes)
        put[np.repeat(begins[order] - here, sizes) + np.arange(len(codes))] = codes
        codes = put
    return coded.dictionary, codes, np.append(0, np.cumsum(counts))


def ids_of(texts: pa.Array, scheme) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of a batch of texts and the first position of each text in them."""
    chunks, codes, first = cut_all(texts, scheme)
    table, counts = scheme.encode(chunks.to_pylist())
    at, begins = laid_out(counts, np.cumsum(counts) - counts, codes)
    return table[at], begins[first]
