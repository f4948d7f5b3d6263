"""Piece encoding and decoding by a table of distinct chunks.

Pieces of the model never cross a white-space marker, so each distinct marked
word of a batch is segmented once and its ids are joined back by position.
White space is kept as it is: runs of markers belong to the following word.
A text's ids are those of the model without begin and end ids; decoding joins
the decoded chunks.  The table lives for one Arrow batch, whose size is bounded,
so memory doesn't grow with the vocabulary of the corpus and nothing is
shuffled; a lost task is simply run again.

Cases: a null text counts as empty; an empty text has no ids and decodes to an
empty text; texts with leading, trailing or repeated spaces and with literal
markers are cut by a pattern; repeated rows give repeated rows; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.chunks import cut_all, laid_out, piece_chunks
from plumbline.llm.common import by_batches, read

MODEL = "piece_bpe_32k.model"


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of each row: ``doc_id, ids array<int>, decoded string``."""

    def work(batches):
        scheme = piece_chunks(model_path)
        for batch in batches:
            chunks, codes, first = cut_all(batch.column(1), scheme)
            table, counts = scheme.encode(chunks.to_pylist())
            decoded = pa.array(scheme.decode(table, counts), pa.string())
            at, begins = laid_out(counts, np.cumsum(counts) - counts, codes)
            ids = pa.ListArray.from_arrays(
                pa.array(begins[first], pa.int32()), pa.array(table[at].astype(np.int32), pa.int32())
            )
            words = pa.ListArray.from_arrays(pa.array(first, pa.int32()), decoded.take(pa.array(codes)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), ids, pc.binary_join(words, " ")], names=["doc_id", "ids", "decoded"]
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return by_batches(rows, work, f"doc_id {kind}, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """The contract's columns, from the operator's ids and texts."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode(read(spark, sf_dir, "documents"), public_tokenizers.path(MODEL)))
