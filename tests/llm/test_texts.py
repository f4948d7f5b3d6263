"""Chunked tokenising, piece coding and packing."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import op7_pieces, op10_packing
from plumbline.llm.chunks import byte_chunks, ids_of, piece_chunks

tokenizers_paths = pytest.importorskip("public_tokenizers")

PARTS = ["a", "b", " ", "  ", "\n", " \n", "é", ".", "'s", "<|endoftext|>", "\x1c", "\xa0", "1", "▁", "the ", "\x01"]
PARTS += ["ﬁ", "\t", "😀", "日本", "\x00", "<s>", "word", " and"]


def odd_texts(n: int) -> list[str | None]:
    draw = random.Random(5)
    made = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14))) for _ in range(n)]
    return [*made, None, "", "  ", " ", "a ", " a", "x" * 30_000, "the cat. " * 4000]


@lru_cache
def bytes_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizers_paths.path("byte_bpe_50k.json"))


def byte_ids(text: str | None) -> list[int]:
    return bytes_tokenizer().encode(text or "", add_special_tokens=False).ids


def test_byte_chunks_equal_the_tokenizer():
    texts = odd_texts(2000)
    scheme = byte_chunks(tokenizers_paths.path("byte_bpe_50k.tiktoken"), tokenizers_paths.PATTERN)
    ids, first = ids_of(pa.array(texts), scheme)
    for k, text in enumerate(texts):
        assert ids[first[k] : first[k + 1]].tolist() == byte_ids(text), text


def test_pieces_equal_the_model(spark):
    texts = odd_texts(1500)
    path = tokenizers_paths.path(op7_pieces.MODEL)
    rows = [(k, text, -k) for k, text in enumerate(texts)] + [(0, texts[0], 9), (None, "null id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long").repartition(3)
    found = op7_pieces.encode(docs, path).collect()
    assert len(found) == len(rows)
    model = piece_chunks(path).model
    by_id = {k: t for k, t, _ in rows}
    for row in found:
        ids = model.encode(by_id[row["doc_id"]] or "")
        assert list(row["ids"]) == ids
        assert row["decoded"] == model.decode(ids)


def test_no_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op7_pieces.encode(empty, tokenizers_paths.path(op7_pieces.MODEL)).count() == 0
    assert op10_packing.packed(empty).count() == 0


def check_pieces(rows, texts: dict, size: int) -> float:
    """Asserts that every token lies in one piece, in order; returns the padded share."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for row in rows:
        by_doc[row["doc_id"]].append(row)
        by_sequence[row["sequence_id"]].append(row)
    assert set(by_doc) == set(texts)
    for key, pieces in by_doc.items():
        ids, at = [*byte_ids(texts[key]), op10_packing.END_ID], 0
        for row in sorted(pieces, key=lambda r: r["start"]):
            assert (row["start"], row["doc_tokens"]) == (at, len(ids))
            part = np.array(ids[at : at + row["length"]], "<u4").tobytes()
            assert zlib.crc32(part) == row["ids_crc32"]
            at += row["length"]
        assert at == len(ids)
    total = padding = 0
    for pieces in by_sequence.values():
        at = 0
        for row in sorted(pieces, key=lambda r: r["offset"]):
            assert row["offset"] == at
            at += row["length"]
        assert at <= size
        total += at
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding / max(1, total)


def test_packing_keeps_every_token(spark):
    texts = dict(enumerate(odd_texts(400)))
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, offset long")
    share = check_pieces(op10_packing.packed(docs.coalesce(2)).collect(), texts, 2048)
    assert share < 0.02


def test_packing_pads_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert check_pieces(op10_packing.packed(docs).collect(), texts, 2048) < 0.01


def test_packed_documents_keep_their_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    order = [r["doc_id"] for r in docs.collect()]
    rows = op10_packing.packed(docs).orderBy("sequence_id", "offset").collect()
    assert list(dict.fromkeys(r["doc_id"] for r in rows)) == order


def test_cuts_are_optimal():
    draw = random.Random(3)
    for _ in range(200):
        size = draw.choice([4, 7, 8, 16])
        places = [0]
        while len(places) < 12:
            places.append(places[-1] + draw.randint(1, min(size, 5)))
        penalties = [draw.randint(0, 5) for _ in places]
        ends = sorted(draw.sample(range(1, 12), 4))
        cost, _ = op10_packing.best_cuts(places, penalties, ends, size)
        plain = [0.0] + [float("inf")] * 11
        for j in range(1, 12):
            for i in range(j):
                length = places[j] - places[i]
                if length <= size:
                    padding = 0 if j in ends and length & (length - 1) == 0 else size - length
                    plain[j] = min(plain[j], plain[i] + padding + penalties[j])
        assert cost == plain
