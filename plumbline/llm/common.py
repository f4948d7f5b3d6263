"""Helpers of the training-data operators: settled frames, Arrow tasks, components."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1000
BATCH_BYTES = 8 * 1024 * 1024
DROP_SHUFFLED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python tasks import this package, wherever the session was started.

    Spark's own file server hands the archive to the executors.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="plumbline-")) / "plumbline_tasks.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def settle(frame: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``; only where that is
    unset (tests on one machine) is a temporary folder used.  A lost executor
    loses nothing of a settled frame.  Files that were shuffled for it go as
    soon as it is kept, not when the driver happens to collect its garbage.
    """
    spark = frame.sparkSession
    ship(spark)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="plumbline-checkpoints-"))
    before = spark.conf.get(DROP_SHUFFLED, None)
    spark.conf.set(DROP_SHUFFLED, "true")
    try:
        return frame.select("*").checkpoint()  # a frame of its own, planned with the setting
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLED)
        else:
            spark.conf.set(DROP_SHUFFLED, before)


def by_batches(
    frame: DataFrame,
    work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """``mapInArrow`` with batches bounded in rows and bytes, so that long texts fit a worker."""
    ship(frame.sparkSession)
    conf = frame.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return frame.mapInArrow(work, schema)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that has an edge: ``(node, component)``.

    ``edges`` has two bigint columns ``src`` and ``dst``.  Rounds of large-star
    and small-star: each node hands its neighbours the smallest node it knows.
    The number of rounds grows with the logarithm of the longest path; a round
    moves each edge a few times and never gathers a neighbourhood (a minimum and
    a join instead), so a hub is split like any skewed join key.  The rounds end
    when every node points to one node that points nowhere.
    """
    now = settle(
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct()
    )
    while not _is_stars(now):
        # Large star: neighbours larger than a node point to the smallest around it.
        least = _both_ways(now).groupBy("src").agg(F.min("dst").alias("low"))
        least = least.select(F.col("src").alias("dst"), F.least("src", "low").alias("low"))
        large = now.join(least, "dst").select("src", F.col("low").alias("dst"))
        # Small star: smaller neighbours of a node point to the smallest of them.
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src")
        now = settle(_pairs(small, ("src", "low"), ("dst", "low")).where("src > dst").distinct())
    inner = now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return inner.unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())


def _pairs(frame: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """``src, dst`` for each of the pairs of columns, from one reading of the frame."""
    made = [F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in pairs]
    return frame.select(F.inline(F.array(*made)))


def _both_ways(edges: DataFrame) -> DataFrame:
    return _pairs(edges, ("src", "dst"), ("dst", "src"))


def _is_stars(edges: DataFrame) -> bool:
    """Whether every source has one target and no target is a source."""
    # Sources are larger than their targets, so the direction of a row tells which end a node is.
    degrees = _both_ways(edges).groupBy("src").agg(
        F.count(F.when(F.col("src") > F.col("dst"), 1)).alias("out"), F.max(F.col("src") < F.col("dst")).alias("into")
    )
    return not degrees.agg(F.max(F.expr("out > 1 OR (out = 1 AND into)"))).first()[0]
