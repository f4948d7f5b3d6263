"""Language identification by cross-parsing entropy.

For each labelled language a suffix automaton of sample text is built.  A text
is parsed greedily against it: each phrase is the longest match that starts
where the last one ended.  Text of the automaton's language has long matches,
so it needs few phrases; the language with the least normalised number,
phrases * log2(sample length) / characters, wins, ties to the smaller name.

Texts are lower-cased; characters other than letters count as one space.  A
text is parsed in blocks of ``BLOCK`` characters that all advance together: a
step of the parse is one lookup in the automaton's table for every block.

The sample is bounded: ``TRAIN_DOCS`` documents a language, by the order of a
hash of their ids, and ``TRAIN_CHARS`` characters of those together, an equal
share of each.  A language's table knows its own letters alone; any other is
strange to it.  With few letters it is a plain table of states by letters, at
most ``DENSE`` entries of 4 bytes; with many it keeps the automaton's
transitions only, at most ``3 * TRAIN_CHARS`` of them with 16 bytes each, which
a step finds by binary search.  So a language takes 8 MB at most, whatever its
script, and the tables of all languages are broadcast together.  Prediction
streams over all rows without a shuffle, and every character of a text counts.

Cases: null, empty and letterless text gives ``und`` with score 0, and so does
every text where nothing can be learned; unlabelled rows and rows without id
are never learned from; repeated rows each get their result; an empty table
gives an empty result; other columns pass through ``predict`` untouched, but
those named like an output are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import by_batches, read

TRAIN_DOCS = 60
TRAIN_CHARS = 24_000
DENSE = 1 << 21
FOLDS = 5
BLOCK = 256
SLICE = 1 << 20
UNKNOWN = "und"
# How sharply a difference in bits turns into the score.
SHARPNESS = 0.1

SPACE, STRANGE, PAD, FIRST_LETTER = 0, 1, 2, 3


def suffix_automaton(text: list[int]) -> tuple[list[dict[int, int]], int]:
    """Transitions of the smallest automaton that reads every substring of ``text``."""
    moves, link, length, last = [{}], [-1], [0], 0
    for symbol in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        state = last
        while state != -1 and symbol not in moves[state]:
            moves[state][symbol] = new
            state = link[state]
        if state != -1:
            target = moves[state][symbol]
            if length[target] == length[state] + 1:
                link[new] = target
            else:
                copy = len(moves)
                moves.append(dict(moves[target]))
                length.append(length[state] + 1)
                link.append(link[target])
                while state != -1 and moves[state].get(symbol) == target:
                    moves[state][symbol] = copy
                    state = link[state]
                link[target] = link[new] = copy
        last = new
    return moves, len(moves)


@dataclass
class Table:
    """A language's parse: which letters it knows, and what a symbol does in a state.

    A step is ``next state * 4 + phrases ended``.  Where no match goes on, the
    next phrase starts with this symbol; a symbol that the sample lacks is a
    phrase of its own.  ``keys`` is None for a plain table of states by
    symbols, whose states are numbered by their rows' places.
    """

    symbols: np.ndarray
    width: int
    steps: np.ndarray
    keys: np.ndarray | None
    root: np.ndarray

    def step(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        if self.keys is None:
            return self.steps.take(state + symbols)
        wanted = state * self.width + symbols
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        missed = np.where(symbols == PAD, state * 4, self.root[symbols] + (state > 0))
        return np.where(self.keys[at] == wanted, self.steps[at], missed)


def parse_table(text: list[int], classes: int, dense: int = DENSE) -> Table:
    """The table of a sample text over symbols below ``classes``."""
    moves, states = suffix_automaton(text)
    used = sorted({SPACE, STRANGE, PAD, *text})
    symbols = np.full(classes, STRANGE, np.int32)
    symbols[used] = np.arange(len(used))
    width = len(used)
    unit = width if states * width <= dense else 1
    root = np.ones(width, np.int64)  # stay at the root, one phrase
    for symbol, target in moves[0].items():
        root[symbols[symbol]] = target * unit * 4
    if unit == 1:
        found = sorted((state * width + int(symbols[s]), t * 4) for state, row in enumerate(moves) for s, t in row.items())
        keys, steps = (np.array(column, np.int64) for column in zip(*found, strict=True))
        return Table(symbols, width, steps, keys, root)
    table = np.tile(root + 1, (states, 1))  # the phrase so far ends here
    table[0] = root
    for state, row in enumerate(moves):
        for symbol, target in row.items():
            table[state, symbols[symbol]] = target * unit * 4
    table[:, PAD] = np.arange(states) * unit * 4
    return Table(symbols, width, table.ravel().astype(np.int32), None, root)


@dataclass
class Model:
    """Languages, their tables, the price of a phrase, and the class of each letter."""

    languages: list[str]
    tables: list[Table]
    prices: list[float]
    letters: dict[str, int]

    @property
    def classes(self) -> int:
        return FIRST_LETTER + len(self.letters)


def class_table(letters: dict[str, int]) -> np.ndarray:
    table = np.fromiter((chr(k).isalpha() for k in range(0x110000)), np.int32, 0x110000)  # STRANGE or SPACE
    for letter, k in letters.items():
        table[ord(letter)] = k
    return table


def normal(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Which characters stay when each run of spaces becomes one; runs end with a text."""
    space = codes == SPACE
    stay = ~space
    stay[1:] |= space[1:] & ~space[:-1]
    stay[firsts[firsts < len(codes)]] = True
    return stay


def fit(samples: dict[str, list[str]]) -> Model:
    """A model from sample texts per language, each language's cut at ``TRAIN_CHARS``."""
    samples = {k: " ".join(t[:share] for t in v).lower()[:TRAIN_CHARS] for k, v in sorted(samples.items()) for share in [equal_share(v)]}
    seen = sorted({c for text in samples.values() for c in text if c.isalpha()})
    letters = {c: FIRST_LETTER + k for k, c in enumerate(seen)}
    model = Model([], [], [], letters)
    for language, text in samples.items():
        codes = [letters.get(c, SPACE) for c in text]
        codes = [c for k, c in enumerate(codes) if c or (k and codes[k - 1])]
        if not any(codes):
            continue
        model.languages.append(language)
        model.tables.append(parse_table(codes, model.classes))
        model.prices.append(math.log2(len(codes) + 1))
    return model


def equal_share(texts: list[str]) -> int:
    """The most characters of each text that ``TRAIN_CHARS`` allow, short ones leaving theirs to the others."""
    left = TRAIN_CHARS
    lengths = sorted(map(len, texts))
    for k, length in enumerate(lengths):
        if length * (len(lengths) - k) >= left:
            return max(1, left // (len(lengths) - k))
        left -= length
    return TRAIN_CHARS


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, list[str]]:
    """The training texts: rows whose fold isn't 0, by language."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).where(F.col("lang").isNotNull() & (F.length("text") > 0) & (fold(F.col("doc_id")) != 0))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = [
        r["doc_id"]
        for r in rows.select("doc_id", "lang")
        .withColumn("n", F.row_number().over(first))
        .where(F.col("n") <= TRAIN_DOCS)
        .select("doc_id")
        .distinct()
        .collect()
    ]
    texts = (
        rows.where(F.col("doc_id").isin(ids))
        .groupBy("lang", "doc_id")
        .agg(F.min(F.substring("text", 1, TRAIN_CHARS)).alias("text"))
        .orderBy("lang", F.xxhash64("doc_id"), "doc_id")
        .collect()
    )
    found: dict[str, list[str]] = {}
    for row in texts:
        found.setdefault(row["lang"], []).append(row["text"])
    return found


def fold(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def phrase_counts(model: Model, codes: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Phrases of each text in each language: an array of texts by languages."""
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(sizes)), blocks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = firsts[owner] + number * BLOCK
    ends = np.minimum(starts + BLOCK, (firsts + sizes)[owner])
    counts = np.zeros((len(sizes), len(model.tables)), np.int64)
    for low in range(0, len(owner), SLICE // BLOCK):
        part = slice(low, low + SLICE // BLOCK)
        at = starts[part] + np.arange(BLOCK)[:, None]
        rows = np.where(at < ends[part], codes[np.minimum(at, len(codes) - 1)], PAD).astype(np.int32)
        for k, table in enumerate(model.tables):
            state = np.zeros(rows.shape[1], np.int32 if table.keys is None else np.int64)
            ended = np.ones(rows.shape[1], np.int32)
            for row in table.symbols[rows]:
                step = table.step(state, row)
                ended += step & 3
                state = step >> 2
            counts[:, k] += np.bincount(owner[part], ended, len(sizes)).astype(np.int64)
    return counts


def predict_texts(model: Model, classes: np.ndarray, texts: list[str | None]) -> tuple[list[str], list[float]]:
    lowered = [(t or "").lower() for t in texts]
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    codes = classes[np.frombuffer("".join(lowered).encode("utf-32-le"), "<u4")]
    firsts = np.cumsum(lengths) - lengths
    stay = normal(codes, firsts) if len(codes) else np.zeros(0, bool)
    kept = np.append(0, np.cumsum(stay))
    ends = kept[firsts + lengths]
    firsts = kept[firsts]
    codes = codes[stay]
    sizes = ends - firsts
    letters = np.append(0, np.cumsum(codes != SPACE))
    known = letters[ends] > letters[firsts]
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model.languages and len(codes):
        bits = phrase_counts(model, codes, firsts, sizes) * np.array(model.prices)
        best = bits.argmin(axis=1)
        share = 1 / np.exp2(-SHARPNESS * (bits - bits.min(axis=1, keepdims=True))).sum(axis=1)
        for k in np.flatnonzero(known):
            names[k], scores[k] = model.languages[best[k]], float(share[k])
    return names, scores


def predict(
    docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """All columns of ``docs`` with the predicted language and its score under ``names``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names or c == text_col])
    where = docs.columns.index(text_col)
    kept = [k for k, c in enumerate(docs.columns) if c not in names]

    def work(batches):
        model, classes = shared.value, None
        for batch in batches:
            classes = class_table(model.letters) if classes is None else classes
            found, scores = [], []
            for part in slices(batch.column(where)):
                more = predict_texts(model, classes, part)
                found += more[0]
                scores += more[1]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in kept], pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                names=[*[batch.schema.names[k] for k in kept], *names],
            )

    columns = [F.col(f"`{docs.columns[k]}`") for k in kept]
    schema = docs.select(*columns, F.lit("").alias(names[0]), F.lit(0.0).alias(names[1])).schema
    return by_batches(docs, work, schema)


def slices(texts: pa.Array):
    """Lists of texts of about ``SLICE`` characters together, in order."""
    part, size = [], 0
    for text in texts.to_pylist():
        part.append(text)
        size += len(text or "")
        if size > SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def train(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> Model:
    return fit(sample(docs, id_col, text_col, lang_col))


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents whose language is recognised, with their own columns.

    Rejected are those without any letter; a clean text is never rejected for
    a low score, and where no language can be learned all with a letter stay.
    """
    model = train(docs)
    if not model.languages:
        return with_letters(docs)
    found = predict(docs, model, names=("__lang", "__score"))
    # The score is 0 only where there is no letter; a language may itself be labelled "und".
    return found.where("__score > 0").select(*[F.col(f"`{c}`") for c in docs.columns])


def with_letters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with a letter, by the text alone."""
    where = docs.columns.index(text_col)

    def work(batches):
        for batch in batches:
            keep = [any(map(str.isalpha, text or "")) for text in batch.column(where).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return by_batches(docs, work, docs.schema)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )
