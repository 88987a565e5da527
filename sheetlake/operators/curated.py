"""Raw row store, curated tables and the reports over them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import row_json
from ..session import checkpointed, drop_scratch, other_folders, remove_path
from ..sources.tables import qualified
from .catalog import describe
from .skew import split_join, stored_unless_small

BUCKET = "key_bucket"
VERSIONS = "_versions"
_INCOMING = "__incoming"


def raw_rows(rows: DataFrame, run_id: str, row_number: str = "row_number") -> DataFrame:
    """Rows as they arrived, tagged with their import run."""
    fields = [c for c in rows.columns if c != row_number]
    return rows.select(F.lit(run_id).alias("run_id"), F.col(row_number).alias("row_number"),
                       row_json(rows, fields).alias("raw"))


def newest_per_key(rows: DataFrame, key: str, order: str, prefer: Column | None = None) -> DataFrame:
    """The row with the highest ``order`` for each key.

    Null orders come before all others. Of equal orders the row with the higher
    ``prefer`` stays, then the one with the higher hash, so repeats agree. An
    aggregate and not a ranking window: each task keeps one row per key before the
    shuffle, so a key holding a third of all rows costs no more than any other.
    """
    others = [c for c in rows.columns if c != key]
    hashed = [F.to_json(c) if rows.schema[c].dataType.typeName() in ("map", "variant") else F.col(c) for c in rows.columns]
    rank = F.struct(F.col(order).isNotNull(), F.col(order), F.lit(0) if prefer is None else prefer, F.xxhash64(*hashed))
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*others), rank).alias("row"))
    return newest.select(key, *[F.col("row")[c].alias(c) for c in others])


def classify_changes(incoming: DataFrame, current: DataFrame, key: str, row_hash: str) -> DataFrame:
    """``incoming`` with ``change``: new, changed or unchanged against ``current``.

    ``current`` is a curated table: one row per key. The import may repeat keys.
    """
    known = current.select(F.col(key), F.col(row_hash).alias("current_hash"))
    return split_join(incoming, known, [(key, key)], "left").withColumn(
        "change",
        F.when(F.col("current_hash").isNull(), "new")
        .when(F.col("current_hash") == F.col(row_hash), "unchanged")
        .otherwise("changed"),
    ).drop("current_hash")


def upsert(current: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Curated rows after an import: the newest row per key, whichever side it comes from.

    Of equal orders the incoming row stays. Rows without a key cannot be matched, so
    they stay out of the curated table. The import is read once.
    """
    columns = current.columns
    both = current.withColumn(_INCOMING, F.lit(0)).unionByName(
        incoming.where(F.col(key).isNotNull()).select(*columns).withColumn(_INCOMING, F.lit(1)))
    return newest_per_key(both, key, order, F.col(_INCOMING)).select(*columns)


def create_curated(spark: SparkSession, table: str, schema: str, key: str, buckets: int = 256,
                   location: str | None = None) -> None:
    """A curated table, partitioned by a hash of its business key.

    Keys are unique in it, so the partitions are even whatever the imports hold.
    """
    spark.sql(f"CREATE TABLE {qualified(table)} ({schema}, {BUCKET} INT) USING parquet PARTITIONED BY ({BUCKET}) "
              + (f"LOCATION '{location}' " if location else "") +
              f"TBLPROPERTIES ('sheetlake.key' = '{key}', 'sheetlake.buckets' = '{buckets}')")


def upsert_table(spark: SparkSession, table: str, incoming: DataFrame, order: str) -> int:
    """Bring an import into a curated table; returns how many partitions were rewritten.

    Only the partitions that hold an incoming key are read, and each is written once, to
    a folder of its own beside the old one; when all are complete the catalog is pointed
    at them, and then the old ones go. A row of the table that is newer than the import's
    stays. The result depends on the newest rows alone, so a run that is cut short is put
    right by running it again. Large partitions are written by several tasks.
    """
    about = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {qualified(table)}").collect()}
    key, buckets = about["sheetlake.key"], int(about["sheetlake.buckets"])
    columns = [c for c in spark.table(qualified(table)).columns if c != BUCKET]
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    fresh = checkpointed(newest_per_key(incoming.where(F.col(key).isNotNull()).select(*columns), key, order)
                         .withColumn(BUCKET, bucket))
    touched = [r[0] for r in fresh.select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
    if touched:
        versions = f"{describe(spark, table)['location']}/{VERSIONS}"
        version = f"{versions}/{uuid.uuid4().hex}"
        current = spark.table(qualified(table)).where(F.col(BUCKET).isin(touched))
        merged = upsert(current.select(*columns, BUCKET), fresh.select(*columns, BUCKET), key, order)
        merged.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(version)
        _point_at(spark, table, touched, version)
        for old in other_folders(spark, versions, version):
            for number in touched:
                remove_path(spark, f"{old}/{BUCKET}={number}")
    drop_scratch(fresh)
    return len(touched)


def _point_at(spark: SparkSession, table: str, numbers: list[int], version: str) -> None:
    """Make the partitions those of ``version``: metadata alone."""
    parts = {n: f"PARTITION ({BUCKET} = {n})" for n in numbers}
    held = {r[0] for r in spark.sql(f"SHOW PARTITIONS {qualified(table)}").collect()}
    added = [f"{parts[n]} LOCATION '{version}/{BUCKET}={n}'" for n in numbers if f"{BUCKET}={n}" not in held]
    if added:
        spark.sql(f"ALTER TABLE {qualified(table)} ADD IF NOT EXISTS {' '.join(added)}")
    for n in numbers:
        if f"{BUCKET}={n}" in held:
            spark.sql(f"ALTER TABLE {qualified(table)} {parts[n]} SET LOCATION '{version}/{BUCKET}={n}'")
    spark.catalog.refreshTable(qualified(table))


def missing_related(left: DataFrame, right: DataFrame, left_key: str, right_key: str | None = None) -> DataFrame:
    """Left rows with no match on the join key; a null key never matches.

    The right side is reduced to its distinct keys first, combined in each task
    before the shuffle, and stored unless it is small enough to be broadcast.
    """
    right_key = right_key or left_key
    return split_join(left, stored_unless_small(right.select(right_key).distinct()), [(left_key, right_key)], "left_anti")


def duplicate_keys(rows: DataFrame, key: str = "business_key") -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("row_count")).where(F.col("row_count") > 1)


def join_related(left: DataFrame, right: DataFrame, mapping: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Join on a declared mapping of ``(left column, right column)`` pairs.

    The right side's key columns are dropped; other clashing names get ``right_``.
    """
    taken = set(left.columns)
    keys = [r for _, r in mapping]
    right = right.select(*[F.col(c) if c in keys or c not in taken else F.col(c).alias(f"right_{c}")
                           for c in right.columns])
    return split_join(left, right, mapping, how)


def report_summary(report: DataFrame, measures=()) -> DataFrame:
    """Row count and, for each measure, its filled rows, sum, minimum and maximum.

    Decimals and whole numbers keep every digit: sums are taken in the column's own
    scale. Floating measures are summed as floating numbers; cast them to a decimal
    first where cents must add up whatever the order.
    """
    totals = [F.count(F.lit(1)).alias("row_count")]
    for m in measures:
        kind = report.schema[m].dataType
        whole = isinstance(kind, (T.DecimalType, T.IntegralType))
        scale = kind.scale if isinstance(kind, T.DecimalType) else 0
        value = F.col(m).cast(f"decimal(38,{scale})") if whole else F.col(m)
        totals += [F.count(m).alias(f"{m}_filled"), F.sum(value).alias(f"{m}_sum"),
                   F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    return report.agg(*totals)
