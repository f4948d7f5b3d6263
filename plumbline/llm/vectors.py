"""Vectors as whole numbers, and sums of them that are exact at any size."""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
#: Whole components are held to this magnitude, so that sums of any number of rows fit a decimal(38, 0).
LARGEST = 1 << 40
LONG_MAX = (1 << 63) - 1

SUMS = "cell int, pos int, total decimal(38,0), n long"


def finite(column: Column) -> Column:
    """Whether an array is there and holds neither null nor a non-finite component."""
    every = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return column.isNotNull() & F.coalesce(every, F.lit(False))


def usable(frame: DataFrame, vector_col: str, *others: str) -> DataFrame:
    """The rows with usable vectors: ``others`` by their names, the vector as ``vector``."""
    vector = F.col(f"`{vector_col}`")
    if frame.select(vector).schema[0].dataType.simpleString() != "array<float>":
        vector = vector.cast("array<double>")
    vector = vector.alias("vector")
    return frame.select(*[F.col(f"`{c}`") for c in others], vector).where(finite(F.col("vector")))


def whole(vectors: pa.Array, width: int, largest: int = 0) -> np.ndarray:
    """``floor(256 * x)`` of every component, a row a vector.

    Machine integers where squared differences summed over a vector, times its
    length, fit them, against components up to ``largest`` too; else Python's.
    """
    values = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    found = np.clip(np.floor(values * SCALE), -LARGEST, LARGEST).astype(np.int64)
    most = max(int(np.abs(found).max(initial=0)), largest)
    return found if fits(most, width) else found.astype(object)


def fits(most: int, width: int) -> bool:
    padded = 1 << max(width - 1, 0).bit_length()
    return (2 * most * max(padded, 1)) ** 2 < 1 << 62


def largest(rows: Iterable[Iterable[int]]) -> int:
    return max((abs(x) for row in rows for x in row), default=0)


def lists(whole_numbers: np.ndarray) -> list[list[int]]:
    return [[int(x) for x in row] for row in whole_numbers]


def leaders(rows: np.ndarray, held: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Of each row's candidates the one with the least sum, the lowest number of equal ones.

    Rows ascend, and so do the candidates of a row.
    """
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    least = np.minimum.reduceat(sums, starts)
    equal = np.flatnonzero(sums == np.repeat(least, np.diff(np.append(starts, len(rows)))))
    return held[equal[np.append(True, rows[equal][1:] != rows[equal][:-1])]]


class Sums:
    """Exact component sums and counts of a task's cells."""

    def __init__(self, cells: int, width: int):
        self.totals = np.zeros((cells, width), np.int64)
        self.counts = np.zeros(cells, np.int64)

    def add(self, cells: np.ndarray, rows: np.ndarray) -> None:
        if rows.dtype == object and self.totals.dtype != object:
            self.totals = self.totals.astype(object)
        np.add.at(self.totals, cells, rows)
        self.counts += np.bincount(cells, minlength=len(self.counts))

    def batch(self) -> pa.RecordBatch:
        """A row for each component of each cell with members."""
        used = np.flatnonzero(self.counts)
        width = self.totals.shape[1]
        totals = [Decimal(int(x)) for x in self.totals[used].ravel()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(used, width), pa.int32()),
                pa.array(np.tile(np.arange(width), len(used)), pa.int32()),
                pa.array(totals, pa.decimal128(38, 0)),
                pa.array(np.repeat(self.counts[used], width), pa.int64()),
            ],
            names=["cell", "pos", "total", "n"],
        )


def moved(sums: DataFrame, centres: list[list[int]]) -> list[list[int]]:
    """The centres after a round: floored means of the cells with members, the others as they were.

    ``sums`` has one row a task, cell and component; what comes to the driver
    is one row a cell and component, as many as ``centres`` holds.
    """
    after = [list(row) for row in centres]
    for r in sums.groupBy("cell", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        after[r["cell"]][r["pos"]] = int(r["total"]) // r["n"]
    return after


def to_long(total: Column) -> Column:
    """A decimal sum as a long, held to the largest one."""
    return F.least(total, F.lit(Decimal(LONG_MAX))).cast("long")
