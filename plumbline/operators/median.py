"""Exact medians of columns of any size, three scans for any number of them.

``percentile`` keeps every distinct value of the input in one task.  Here the
middle values are found by narrowing an interval instead:

1. one scan makes a mergeable quantile sketch of every column, which gives an
   interval around the wanted ranks;
2. a second one counts, exactly, how many values lie below each interval and in
   each of its ``BINS`` equal parts, and at its two ends;
3. a third one keeps the values of the parts that hold the wanted ranks, copies
   collapsed, and takes the values at those ranks.

The counts decide, not the sketch: an interval that misses a rank only leaves
more values to the third scan.  Ends of an interval are parts of their own, so
copies of a hot value collapse to one row.  A part holds about
``4 / STEPS / BINS`` of a smooth column, a few in a million.  NaN ranks above
every number, as in sorting, and never takes part in the search.

The first two scans are jobs, whose results (``STEPS`` quantiles and ``BINS``
counts a column) the driver turns into literals; the third is a plan, run with
whatever it becomes a part of.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Size of a sketch (its ranks are off by about a thousandth), the quantiles taken
# from it, the parts of an interval between two of them.
SKETCH, STEPS, BINS = 4096, 1000, 1024
ACCURACY = 10_000


def median_frame(df: DataFrame, column: Column, value: Column, approximate: bool = False, **sizes) -> DataFrame:
    """One row: total, missing, observed."""
    if not approximate:
        return medians(df, {"": (column, value)}, **sizes)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(column.isNull()).alias("missing"),
        approximate_median(value).alias("observed"),
    )


def approximate_median(value: Column) -> Column:
    return F.percentile_approx(value.cast("double"), F.lit(0.5), F.lit(ACCURACY))


def medians(
    df: DataFrame,
    wanted: dict[str, tuple[Column, Column]],
    sketch: int = SKETCH,
    steps: int = STEPS,
    bins: int = BINS,
) -> DataFrame:
    """One row with ``total``, ``missing`` and ``observed`` of each column, behind its prefix.

    ``wanted`` has the column whose NULLs are missing and its numeric reading.
    """
    rows = df.select(
        *[
            part
            for k, (column, value) in enumerate(wanted.values())
            for part in (
                column.isNull().alias(f"absent{k}"),
                F.when(~F.isnan(value.cast("double")), value.cast("double")).alias(f"v{k}"),
                F.coalesce(F.isnan(value.cast("double")), F.lit(False)).alias(f"nan{k}"),
            )
        ]
    )
    facts = _sketched(rows, len(wanted), sketch, steps)
    sought = {k: f for k, f in enumerate(facts) if f.upper is not None and f.upper < f.finite}
    _count(rows, sought, bins)
    columns = []
    for k, (name, f) in enumerate(zip(wanted, facts, strict=True)):
        observed = F.lit(None if f.upper is None else float("nan")).cast("double")
        if k in sought:
            low, high = F.col(f"low{k}"), F.col(f"high{k}")
            observed = low if f.lower == f.upper else (low + high) / 2
        columns += [
            F.lit(f.total).cast("bigint").alias(f"{name}total"),
            F.lit(f.missing).cast("bigint").alias(f"{name}missing"),
            observed.alias(f"{name}observed"),
        ]
    found = _values(rows, sought, bins) if sought else df.sparkSession.range(1)
    return found.select(*columns)


@dataclass
class _Facts:
    """Counts of a column, its 0-based middle ranks, the interval around them and the parts that hold them."""

    total: int
    missing: int
    finite: int
    lower: int | None = None
    upper: int | None = None
    low: float | None = None
    high: float | None = None
    first: int = 0
    last: int = 0
    below: int = 0


def _sketched(rows: DataFrame, many: int, sketch: int, steps: int) -> list[_Facts]:
    aggregates = [F.count(F.lit(1)).alias("total")]
    shares = F.array(*[F.lit(k / steps) for k in range(steps + 1)])
    quantiles = []
    for k in range(many):
        aggregates += [
            F.count_if(F.col(f"absent{k}")).alias(f"missing{k}"),
            F.count(F.col(f"v{k}")).alias(f"finite{k}"),
            F.count_if(F.col(f"nan{k}")).alias(f"nans{k}"),
            F.kll_sketch_agg_double(F.col(f"v{k}"), F.lit(sketch)).alias(f"sketch{k}"),
        ]
        known = F.when(F.col(f"finite{k}") > 0, F.kll_sketch_get_quantile_double(f"sketch{k}", shares))
        quantiles.append(known.alias(f"quantiles{k}"))
    row = rows.agg(*aggregates).select("*", *quantiles).drop(*[f"sketch{k}" for k in range(many)]).first()
    out = []
    for k in range(many):
        fact = _Facts(row["total"], row[f"missing{k}"], row[f"finite{k}"])
        size = fact.finite + row[f"nans{k}"]
        if size:
            fact.lower, fact.upper = (size - 1) // 2, size // 2
        if fact.upper is not None and fact.upper < fact.finite:
            known = row[f"quantiles{k}"]
            fact.low = known[max(0, fact.lower * steps // fact.finite - 1)]
            fact.high = known[min(steps, -(-(fact.upper + 1) * steps // fact.finite) + 1)]
        out.append(fact)
    return out


def _part(value: Column, fact: _Facts, bins: int) -> Column:
    """The part a value lies in, ascending: below, low end, ``bins`` parts, high end, above."""
    low, high = F.lit(fact.low), F.lit(fact.high)
    # Halves first, so that the difference of large numbers stays finite.
    share = F.nanvl((value / 2 - low / 2) / (high / 2 - low / 2), F.lit(0.0))
    inside = F.lit(2) + F.least(F.lit(bins - 1), F.floor(share * bins)).cast("int")
    return (
        F.when(value < low, F.lit(0))
        .when(value == low, F.lit(1))
        .when(value < high, inside)
        .when(value == high, F.lit(bins + 2))
        .otherwise(F.lit(bins + 3))
    )


def _count(rows: DataFrame, sought: dict[int, _Facts], bins: int) -> None:
    """Find the parts that hold the middle ranks, and the number of values below them."""
    tagged = []
    for k, fact in sought.items():
        v = F.col(f"v{k}")
        # Values above the interval need no counting.
        tagged.append(F.when(v <= fact.high, F.struct(F.lit(k).alias("k"), _part(v, fact, bins).alias("part"))))
        fact.first = fact.last = bins + 3
    if not sought:
        return
    counts = rows.select(F.inline(F.array_compact(F.array(*tagged)))).groupBy("k", "part").count().collect()
    for k, fact in sought.items():
        upto = 0
        for row in sorted((r for r in counts if r["k"] == k), key=lambda r: r["part"]):
            if upto + row["count"] <= fact.lower:
                fact.below = upto + row["count"]
            elif upto <= fact.lower:
                fact.first = row["part"]
            upto += row["count"]
            if upto > fact.upper:
                fact.last = row["part"]
                break


def _values(rows: DataFrame, sought: dict[int, _Facts], bins: int) -> DataFrame:
    """One row with the values ``low`` and ``high`` at each sought column's middle ranks."""
    tagged, picks = [], []
    upto = F.sum("n").over(Window.partitionBy("k").orderBy("v"))
    for k, fact in sought.items():
        v = F.col(f"v{k}")
        held = v.isNotNull() & _part(v, fact, bins).between(fact.first, fact.last)
        tagged.append(F.when(held, F.struct(F.lit(k).alias("k"), v.alias("v"))))
        for name, rank in (("low", fact.lower), ("high", fact.upper)):
            at = (F.col("k") == k) & (F.col("upto") > rank - fact.below)
            picks.append(F.min(F.when(at, F.col("v"))).alias(f"{name}{k}"))
    return (
        rows.select(F.inline(F.array_compact(F.array(*tagged))))
        .groupBy("k", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", upto)
        .agg(*picks)
    )
