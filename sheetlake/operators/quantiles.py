"""Exact quantiles of groups of any size, by narrowing to the rank.

``percentile`` keeps every different value of a group in one place. Here each round
sketches, for each group and wanted rank, two values that should enclose it; one pass
counts exactly how many rows lie below, at, between and above them, which says where the
rank is. What is left shrinks about fiftyfold a round, and at least by those two values.
When few rows are left, they alone are sorted. Rows stay where they are: what moves is
one sketch and a few numbers for each task, group and rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, drop_scratch

FEW_ROWS = 100_000
MARKS = 100  # evenly spaced values in a sketch
ACCURACY = 10_000  # an error of one in so many ranks, well below the distance of two marks

_STATE = ("__g", "k", "lo", "hi", "below", "inside")


def exact_quantiles(rows: DataFrame, group: str, value: str, shares, few_rows: int = FEW_ROWS) -> DataFrame:
    """``group, share, value`` (a double): the continuous quantiles of each group's values, as SQL's ``percentile_cont``.

    Null values do not count, NaN is the greatest value, and null is a group like
    others; a group without values gives no row. Each group and share has a sketch, so
    they are broadcast with a few numbers each; their number does not grow with the rows
    of a group.
    """
    kept = rows.select(F.col(group).alias("__g"), F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL")
    totals = kept.groupBy("__g").agg(F.count(F.lit(1)).alias("inside"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    # A rank is a whole number and a part, which is a place between that row and the next.
    goals = checkpointed(
        totals.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
        .withColumn("rank", F.col("share") * (F.col("inside") - 1)).withColumn("first", F.floor("rank"))
        .withColumn("part", F.col("rank") - F.col("first")))
    ranks = F.explode(F.when(F.col("part") > 0, F.array(F.col("first"), F.col("first") + 1)).otherwise(F.array("first")))
    state = checkpointed(goals.withColumn("k", ranks).withColumn("below", F.lit(0).cast("long")).select(*_STATE).distinct())
    wide = (F.col("inside") > few_rows) & (F.col("lo") != F.col("hi"))
    while not state.where(wide).isEmpty():
        following = checkpointed(state.where(~wide).unionByName(_narrowed(kept, state.where(wide))))
        drop_scratch(state)
        state = following
    known = state.where("lo = hi").select("__g", "k", F.col("lo").alias("__v"))
    rest = _inside(kept, state.where("lo <> hi"))
    nth = F.row_number().over(Window.partitionBy("__g", "k").orderBy("__v")) - 1
    picked = rest.withColumn("nth", nth).where("below + nth = k").select("__g", "k", "__v")
    found = checkpointed(known.unionByName(picked)).withColumnsRenamed({"__g": "__h", "k": "__k"})
    here = F.col("__g").eqNullSafe(F.col("__h")) & (F.col("__k") - F.col("first")).isin(0, 1)
    ends = goals.join(found, here).groupBy("__g", "share", "part").agg(
        F.min(F.when(F.col("__k") == F.col("first"), F.col("__v"))).alias("low"),
        F.min(F.when(F.col("__k") > F.col("first"), F.col("__v"))).alias("high"))
    between = F.when(F.col("part") > 0, F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).otherwise(F.col("low"))
    return ends.select(F.col("__g").alias(group), "share", between.alias(value))


def _inside(kept: DataFrame, state: DataFrame) -> DataFrame:
    """The rows within the ranges of their group, once for each range."""
    ranges = F.broadcast(state.withColumnRenamed("__g", "__h"))
    return (kept.join(ranges, F.col("__g").eqNullSafe(F.col("__h")) & (F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi")))
            .drop("__h"))


def _narrowed(kept: DataFrame, state: DataFrame) -> DataFrame:
    """Every range cut to where its rank is, as seen from two values of a sketch."""
    steps = [i / MARKS for i in range(MARKS + 1)]
    sketched = _inside(kept, state).groupBy(*_STATE).agg(F.percentile_approx("__v", steps, ACCURACY).alias("marks"))
    at = (F.col("k") - F.col("below")) / F.col("inside") * MARKS
    marks = [F.element_at("marks", F.greatest(F.least(p, F.lit(MARKS)), F.lit(0)).cast("int") + 1) for p in (F.floor(at), F.floor(at) + 1)]
    cut = checkpointed(sketched.select(*_STATE, marks[0].alias("left"), marks[1].alias("right")))
    v = F.col("__v")
    seen = _inside(kept, cut).groupBy(*_STATE, "left", "right").agg(
        F.count_if(v < F.col("left")).alias("n1"), F.count_if(v <= F.col("left")).alias("n2"),
        F.count_if(v < F.col("right")).alias("n3"), F.count_if(v <= F.col("right")).alias("n4"),
        F.max(F.when(v < F.col("left"), v)).alias("top1"), F.min(F.when(v > F.col("left"), v)).alias("end2"),
        F.max(F.when(v < F.col("right"), v)).alias("top3"), F.min(F.when(v > F.col("right"), v)).alias("end4"))
    place = F.col("k") - F.col("below")
    # Below the first value, at it, between, at the second, above: (rows before, rows within, range).
    zones = [(F.col("n1"), F.lit(0), F.col("n1"), "lo", "top1"), (F.col("n2"), F.col("n1"), F.col("n2") - F.col("n1"), "left", "left"),
             (F.col("n3"), F.col("n2"), F.col("n3") - F.col("n2"), "end2", "top3"),
             (F.col("n4"), F.greatest("n2", "n3"), F.col("n4") - F.greatest("n2", "n3"), "right", "right"),
             (F.col("inside"), F.col("n4"), F.col("inside") - F.col("n4"), "end4", "hi")]
    chosen = None
    for until, before, within, lo, hi in zones:
        zone = F.struct((F.col("below") + before).alias("below"), within.cast("long").alias("inside"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
        chosen = F.when(place < until, zone) if chosen is None else chosen.when(place < until, zone)
    return seen.select("__g", "k", chosen.alias("z")).select("__g", "k", "z.lo", "z.hi", "z.below", "z.inside")
