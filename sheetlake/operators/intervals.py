"""Range joins cut by the data: bins that hold about as many points each, wherever they lie.

The borders are quantiles of the points. A point has one bin, an interval all bins that
it meets, so the join has an equality to shuffle on and compares within bins only. Bins
that still hold more points than one task should take, as equal values cannot be told
apart by borders, are cut further: their points are dealt out by place, and their
intervals go to every part. The join has as many tasks as the pairs it compares call
for, since these may be far more than its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS_PER_BIN = 100_000
PAIRS_PER_TASK = 10_000_000  # what a task compares; a part of a bin at most as many
LEAST_BINS, MOST_BINS = 16, 10_000
BORDER_ERROR = 0.2  # of a bin, in the quantiles


def bin_borders(points: DataFrame, value: str, per_bin: int = POINTS_PER_BIN) -> list[float]:
    """From 1 to ``MOST_BINS`` - 1 different quantiles of the values that are neither null nor NaN."""
    usable = points.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    bins = max(min(MOST_BINS, -(-usable.count() // per_bin)), LEAST_BINS)
    shares = [i / bins for i in range(1, bins)]
    found = usable.select(F.col(value).cast("double").alias(value)).approxQuantile(value, shares, BORDER_ERROR / bins)
    return sorted(set(found)) or [0.0]


def bin_of(value: Column, borders: list[float]) -> Column:
    """How many borders are at or below a value. Looked up in two steps, each about the root of their number."""
    if not borders:
        return F.lit(0)
    step = max(int(len(borders) ** 0.5), 1)
    rows = [borders[i:i + step] for i in range(0, len(borders), step)]
    lasts = F.array(*[F.lit(r[-1]) for r in rows])
    parts = F.array(*[F.array(*[F.lit(b) for b in r]) for r in rows])
    whole = F.size(F.filter(lasts, lambda b: b <= value))  # rows that lie below in full
    rest = F.size(F.filter(F.get(parts, F.least(whole, F.lit(len(rows) - 1))), lambda b: b <= value))
    return F.when(whole == len(rows), F.lit(len(borders))).otherwise(whole * step + rest)


def _number_of(parts: list[int]) -> Column:
    """The number of parts of a row's bin, one at least."""
    return F.get(F.array(*[F.lit(max(n, 1)) for n in parts]), F.col("__bin"))


def range_join(points: DataFrame, intervals: DataFrame, value: str, low: str, high: str, per_bin: int = POINTS_PER_BIN,
               pairs_per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """All pairs of a point and an interval with ``low <= value <= high``; column names must differ.

    Nulls and NaN meet nothing, nor does an interval that ends before it begins. Infinite
    ends are ends like others. Values are compared as they are and binned as doubles.
    """
    borders = bin_borders(points, value, per_bin)
    ready = points.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).withColumn(
        # Generated, so that the planner does not carry what it is made of over to the other side of the join.
        "__bin", F.explode(F.array(bin_of(F.col(value).cast("double"), borders))))
    whole = intervals.where((F.col(low) <= F.col(high)) & ~F.isnan(F.col(low).cast("double")) & ~F.isnan(F.col(high).cast("double")))
    ends = [bin_of(F.col(c).cast("double"), borders) for c in (low, high)]
    spread = whole.withColumn("__first", ends[0]).withColumn("__last", ends[1]).withColumn(
        "__bin", F.explode(F.sequence("__first", "__last"))).drop("__first", "__last")
    # Two numbers for each bin, at most ``MOST_BINS``.
    counts, met = ({r["__bin"]: r["count"] for r in side.groupBy("__bin").count().collect()} for side in (ready, spread))
    bins = range(len(borders) + 1)
    cuts = [-(-counts.get(i, 0) // per_bin) for i in bins]
    # A part may meet more intervals than one task should compare: those are dealt out as well, and its points go to each.
    rows = [-(-min(counts.get(i, 0), per_bin) * met.get(i, 0) // pairs_per_task) for i in bins]
    keys = ["__bin"]
    if max(cuts) > 1:
        parts = _number_of(cuts)
        ready = ready.withColumn("__part", F.pmod(F.monotonically_increasing_id(), parts).cast("int"))
    if max(rows) > 1:
        # By a hash, as an interval's bins follow each other.
        dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), _number_of(rows)).cast("int")
        spread = spread.withColumn("__row", dealt)
        ready = ready.withColumn("__row", F.explode(F.sequence(F.lit(0), _number_of(rows) - 1)))
        keys.append("__row")
    if max(cuts) > 1:
        spread = spread.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
        keys.append("__part")
    compared = sum(counts.get(i, 0) * met.get(i, 0) for i in bins)
    if compared > pairs_per_task:
        # A merge, as generated intervals are not in Spark's size estimates, so left alone it may broadcast a side that grows
        # with the input, and the tasks are those that read the points.
        tasks = -(-compared // pairs_per_task)
        ready, spread = ready.repartition(tasks, *keys), spread.repartition(tasks, *keys).hint("merge")
    return (ready.join(spread, keys).where((F.col(low) <= F.col(value)) & (F.col(value) <= F.col(high))).drop(*keys))
