"""Equality joins whose left side may hold a large share of its rows under few keys.

Where Spark broadcasts the right side, left rows stay where they are. Else the left keys
are counted, combined in each task. Keys of very many rows, of which there can be few,
are joined apart: their left rows are not shuffled at all, and their right rows, which
are few as well, are broadcast. So it does not matter whether the rows are wide or all
equal and next to nothing in bytes. All other rows are left to adaptive execution, which
splits a partition that is heavy in bytes where both inputs come straight from a
shuffle; a right side that was aggregated is stored first for that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

KINDS = ("inner", "left", "left_semi", "left_anti")
HEAVY_ROWS = 1_000_000  # rows of a key that one task may take
HEAVY_KEYS = 10_000  # of the heaviest; any other key then has less than that share of all rows
BROADCAST_ROWS = 100_000  # right rows of heavy keys


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark, by its own estimate and limit, would broadcast ``df``."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def stored_unless_small(df: DataFrame) -> DataFrame:
    return df if fits_broadcast(df) else checkpointed(df)


def heavy_keys(rows: DataFrame, keys: list[str], heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """The keys of more than ``heavy_rows`` rows, the heaviest ``HEAVY_KEYS`` of them, as ``__heavy_0`` on; stored."""
    counts = rows.groupBy(*[F.col(k).alias(f"__heavy_{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("__rows"))
    return checkpointed(counts.where(F.col("__rows") > heavy_rows).orderBy(F.col("__rows").desc()).limit(HEAVY_KEYS).drop("__rows"))


def split_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str = "inner",
               heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Join on pairs of a left and a right column; the right ones are dropped.

    ``how`` is inner, left, left_semi or left_anti; the other column names must not
    clash. Key types may differ as far as Spark compares them. Neither side may be
    the result of an aggregate or window that has not been stored, unless it is small.
    Right rows of heavy keys beyond ``BROADCAST_ROWS`` are joined by a shuffle of their own.
    """
    if how not in KINDS:
        raise ValueError(f"split_join cannot do {how}")
    renamed = {b: f"__right_{i}" for i, (_, b) in enumerate(on)}
    right = right.withColumnsRenamed(renamed)

    def joined(rows, others):
        equal = [F.col(a) == F.col(renamed[b]) for a, b in on]
        return rows.join(others, reduce(lambda x, y: x & y, equal), how).drop(*renamed.values())

    if fits_broadcast(right):
        return joined(left, right)
    heavy = heavy_keys(left, [a for a, _ in on], heavy_rows)
    if heavy.isEmpty():
        return joined(left, right)

    def among(rows, columns, kind):
        same = [F.col(c).eqNullSafe(F.col(f"__heavy_{i}")) for i, c in enumerate(columns)]
        return rows.join(F.broadcast(heavy), reduce(lambda x, y: x & y, same), kind)

    keys = [a for a, _ in on]
    others = checkpointed(among(right, [renamed[b] for _, b in on], "left_semi"))
    few = others.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return joined(among(left, keys, "left_anti"), right).unionByName(
        joined(among(left, keys, "left_semi"), F.broadcast(others) if few else others))
