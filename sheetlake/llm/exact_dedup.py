"""Exact duplicates by a tree of merged digest runs.

Every scan partition is one run: its rows' digests, with equal ones combined.
The runs then meet in rounds. In round k the run number loses three bits, so
eight neighbouring runs are merged into one, and the merged run is cut by three
more leading bits of the digest, so a piece holds about as many digests after
each round as before. Each level keeps, per digest, the count and the best row.
A digest that fills a third of the table sends one record per run into the first
round and an eighth of that into each later one; no task sees its rows together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlake.llm.common import SPACE, keyed, place_of, text_of, unkeyed
from sheetlake.session import checkpointed

FAN_IN_BITS = 3  # eight runs meet in a round


def digest_rows(docs: DataFrame, row: str | None = None, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """One stored record per row: row number, id, code points, digests of the text without white space, run."""
    bare = F.regexp_replace(text_of(text_column), SPACE + "+", "")
    return checkpointed(docs.select(
        F.col(row) if row else F.monotonically_increasing_id().alias("__row"),
        F.col(id_column).alias("__id"), F.length(text_of(text_column)).cast("long").alias("__chars"),
        bare.alias("__bare"), F.spark_partition_id().cast("long").alias("__run"),
    ).select("__row" if not row else F.col(row).alias("__row"), "__id", "__chars", "__run",
             F.sha2("__bare", 256).alias("__sha"), F.xxhash64("__bare").alias("__check")))


def merge_runs(records: DataFrame) -> DataFrame:
    """The tree: one record per digest with its group size and the row that stays.

    A digest is the SHA-256 together with an independent 64-bit hash; records
    merge only when both agree. The row that stays has the most code points, then
    the smallest id (null ids last), then the smallest row number.
    """
    best = F.struct((-F.col("__chars")).alias("chars"), F.col("__id").isNull().alias("no_id"),
                    F.col("__id").alias("id"), F.col("__row").alias("row"))
    runs = int(records.agg(F.coalesce(F.max("__run"), F.lit(0))).first()[0]) + 1
    level = records.groupBy("__run", "__sha", "__check").agg(
        F.min(best).alias("__best"), F.count("*").alias("__size"))
    bits = 0
    while (runs - 1) >> bits:
        bits += FAN_IN_BITS
        level = (level
                 .withColumn("__run", F.shiftright("__run", FAN_IN_BITS))
                 .withColumn("__slice", F.shiftrightunsigned("__check", max(64 - bits, 1)))
                 .groupBy("__run", "__slice", "__sha", "__check")
                 .agg(F.min("__best").alias("__best"), F.sum("__size").alias("__size")))
    return level.select("__sha", "__check", "__best", "__size")


def duplicate_groups(records: DataFrame) -> DataFrame:
    """Each record of :func:`digest_rows` with ``keep_id``, ``group_size`` and ``kept``."""
    merged = checkpointed(merge_runs(records))
    return (records.drop("__run").join(merged, ["__sha", "__check"], "inner")
            .select("__row", "__id", "__sha", F.col("__best.id").alias("keep_id"),
                    F.col("__size").alias("group_size"), (F.col("__row") == F.col("__best.row")).alias("kept")))


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: its group's survivor, the group's size and whether it is the survivor.

    Texts are equal when identical without white space; null counts as empty, so
    all empty and blank texts are one group. A null id gives a row like any
    other; it stays only when no row of its group and length has an id. Of rows
    equal in id and text exactly one is kept. An empty table gives no rows. Other
    columns of ``docs`` are not read, so their names do not matter.
    """
    groups = duplicate_groups(digest_rows(docs, None, id_column, text_column))
    return groups.select(F.col("__id").alias("doc_id"), "keep_id", "group_size", "kept",
                         F.col("__sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_duplicates` marks as dropped; all columns stay."""
    rows = keyed(docs)
    records = digest_rows(rows, "__row", place_of(docs, id_column), place_of(docs, text_column))
    kept = duplicate_groups(records).where("kept").select("__row")
    return unkeyed(rows.join(kept, "__row", "left_semi"), docs)
