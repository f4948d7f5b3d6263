"""URL filter: rules first, else logistic regression on hashed character n-grams.

A rule names a host and the start of a path; it fits the host, its subdomains
and every path that begins so, and the longest fitting rule wins.  For other
urls a logistic regression gives the verdict.  Its features are character
n-grams of the host and, marked apart, of the path, hashed to ``BUCKETS``
columns and scaled to length one.  It is trained from a small labelled table of
urls, ``labelled_urls()`` unless another is given; a table is bounded by
``TABLE_ROWS``.  One pass over the rows, no shuffle; rules and weights are sent
to the tasks.

Cases: a null url or one without ``://`` has empty host and path, and so the
verdict of an empty url; repeated rows get equal results; a page without id
keeps its null; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import by_batches, read

ALLOW, BLOCK = "allow", "block"
RULES = {"net/": BLOCK, "example.net/en/": ALLOW, "example.com/de/": BLOCK, "org/fr/": ALLOW}

BUCKETS = 1 << 14
GRAMS = (3, 4, 5)
PATH_WEIGHT = 0.25
TABLE_ROWS = 20_000
ROUNDS, STEP, DECAY = 400, 4.0, 1e-4

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
HOST_END, PATH_END = re.compile(r"[/?#]"), re.compile(r"[?#]")

# Words of unwanted and of ordinary sites, for the small labelled table.
UNWANTED = """casino poker bets betting slots jackpot lottery roulette pills pharma viagra cialis drugs adult xxx porn sex
escort nude cams dating hookup spam farm ads track tracker adserver banner click popunder malware phish crack keygen
warez torrent payday loans cheap free win prize bonus replica""".split()
ORDINARY = """news times post journal gazette herald library museum school college science nature history music art
garden kitchen recipes travel weather sports football health clinic hospital city council park bridge river mountain
forest ocean books author review forum wiki docs support help project software code data research lab energy solar
transport railway airport bank insurance market shop store design studio photo film theatre radio""".split()
SYLLABLES = """al an ber con der di el en er fi gar ha in ka le lo ma mi ne on or pa ra re sa sh ta th ti tion un""".split()
ENDINGS = ("example.com", "example.org", "example.net", "test")
FRONTS = ("", "www.", "m.", "blog.")
PATHS = ("/", "/en/1", "/de/2.html", "/fr/index", "/es/3?x=1", "/about", "/2024/05/item")


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: 1 for unwanted. Made by a rule from the two word lists."""
    rows = []
    for label, words in ((1, UNWANTED), (0, ORDINARY)):
        for k, word in enumerate(words):
            mate = words[(k * 7 + 3) % len(words)]
            for n, host in enumerate((word, f"{word}-{mate}", f"{mate}{word}", f"{word}-{k}")):
                at = k + n
                end, front, path = ENDINGS[at % len(ENDINGS)], FRONTS[at % len(FRONTS)], PATHS[at % len(PATHS)]
                rows.append((f"https://{front}{host}.{end}{path}", label))
    for k in range(300):  # invented names, as unknown sites have
        name = "".join(SYLLABLES[k * (n + 2) * 5 % 31] for n in range(2 + k % 3))
        at = k % len(PATHS)
        rows.append((f"https://{FRONTS[k % 4]}{name}.{ENDINGS[k // 4 % 4]}{PATHS[at]}", 0))
    return rows


def parts(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path."""
    start = -1 if url is None else url.find("://")
    if start < 0:
        return "", ""
    rest = url[start + 3 :]
    end = HOST_END.search(rest)
    host, rest = (rest, "") if end is None else (rest[: end.start()], rest[end.start() :])
    end = PATH_END.search(rest)
    return host.translate(LOWER), rest if end is None else rest[: end.start()]


class Rules:
    """Rules by host; each host's with the longest path first."""

    def __init__(self, rules: dict[str, str]):
        self.verdicts = rules
        self.by_host: dict[str, list[str]] = {}
        for rule in sorted(rules, key=len, reverse=True):
            host, _, path = rule.partition("/")
            self.by_host.setdefault(host, []).append("/" + path)

    def match(self, host: str, path: str) -> str | None:
        best, at = None, 0
        while at >= 0:
            name = host[at:]
            for start in self.by_host.get(name, ()):
                if path.startswith(start):
                    if best is None or len(name + start) > len(best):
                        best = name + start
                    break
            at = host.find(".", at) + 1 or -1
        return best


def grams(host: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a url's features."""
    counts: dict[int, float] = {}
    for text, weight in ((f"^{host}$", 1.0), (f"\t{path}\n" if path else "", PATH_WEIGHT)):
        for n in GRAMS:
            for k in range(len(text) - n + 1):
                bucket = zlib.crc32(text[k : k + n].encode()) % BUCKETS
                counts[bucket] = max(counts.get(bucket, 0.0), weight)
    at, values = np.fromiter(counts, np.int64, len(counts)), np.fromiter(counts.values(), float, len(counts))
    return at, values / max(1e-12, float(np.sqrt((values**2).sum())))


def train(table: list[tuple[str, int]]) -> tuple[np.ndarray, float]:
    """Weights and intercept by gradient steps on the whole small table."""
    if len(table) > TABLE_ROWS:
        raise ValueError(f"the labelled table has over {TABLE_ROWS} rows")
    feats = [grams(*parts(url)) for url, _ in table]
    labels = np.array([y for _, y in table], float)
    rows = np.repeat(np.arange(len(feats)), [len(a) for a, _ in feats])
    at = np.concatenate([a for a, _ in feats]) if feats else np.zeros(0, np.int64)
    values = np.concatenate([v for _, v in feats]) if feats else np.zeros(0)
    weights, intercept = np.zeros(BUCKETS), 0.0
    for _ in range(ROUNDS if len(table) else 0):
        margins = np.bincount(rows, values * weights[at], len(table)) + intercept
        error = 1 / (1 + np.exp(-margins)) - labels
        weights -= STEP * (np.bincount(at, values * error[rows], BUCKETS) / len(table) * 10 + DECAY * weights)
        intercept -= STEP * float(error.mean())
    return weights, intercept


def judge(
    pages: DataFrame,
    rules: dict[str, str] = RULES,
    table: list[tuple[str, int]] | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``page_id, host, path, rule, verdict, score``; the score is the regression's chance of unwanted."""
    model = train(labelled_urls() if table is None else table)
    shared = pages.sparkSession.sparkContext.broadcast((rules, model))

    def work(batches):
        found, (weights, intercept) = Rules(shared.value[0]), shared.value[1]
        for batch in batches:
            out = ([], [], [], [], [])
            for url in batch.column(1).to_pylist():
                host, path = parts(url)
                rule = found.match(host, path)
                at, values = grams(host, path)
                score = float(1 / (1 + np.exp(-(weights[at] @ values + intercept))))
                verdict = found.verdicts[rule] if rule else (BLOCK if score > 0.5 else ALLOW)
                for column, value in zip(out, (host, path, rule, verdict, score), strict=True):
                    column.append(value)
            kinds = [pa.string()] * 4 + [pa.float64()]
            arrays = [batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "host", "path", "rule", "verdict", "score"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return by_batches(
        rows, work, f"page_id {kind}, host string, path string, rule string, verdict string, score double"
    )


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))
