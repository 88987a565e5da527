"""Snapshots of tables, restore, and the check that both sides agree."""

from __future__ import annotations

import json
import re
import uuid
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed, names_in, read_text, remove_path, shared_dir, write_text
from ..sources.tables import qualified, quote_name, split_table_name
from .catalog import describe, sketch_path

# Snapshot names, the word that confirms a restore, and the refusals.
SNAPSHOT_NAME = r"backup_[0-9]{8}_[0-9]{6}"
CONFIRM = "RESTORE"
NO_SNAPSHOT = "Backup file not found or invalid."
NO_TOKEN = "Confirmation token required to restore backups."
BAD_TOKEN = "Invalid confirmation token."
MANIFEST = "manifest"
BUCKETS = 4096  # sums of each level of the located check
_MANIFEST_SCHEMA = ("table_name STRING, definition STRING, statement STRING, location STRING, row_count BIGINT, "
                    "content_hash DECIMAL(38,0)")


def _hash_parts(df: DataFrame) -> list:
    parts = []
    for f in df.schema.fields:
        c = F.col(quote_name(f.name))
        if isinstance(f.dataType, (T.MapType, T.VariantType)):
            c = F.to_json(c)
        parts += [c, c.isNull()]
    return parts


def content_hash(df: DataFrame) -> DataFrame:
    """Row count and an order-free sum of row hashes: one pass, one row per task shuffled.

    Nulls leave a hash unchanged, so each column is hashed with its null flag.
    """
    return df.agg(F.count(F.lit(1)).alias("row_count"),
                  F.coalesce(F.sum(F.xxhash64(*_hash_parts(df)).cast("decimal(20,0)")).cast("decimal(38,0)"),
                             F.lit(0).cast("decimal(38,0)")).alias("content_hash"))


def snapshot_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Counts and hashes of both sides, and whether they are equal."""
    a = content_hash(left).select(F.col("row_count").alias("left_rows"), F.col("content_hash").alias("left_hash"))
    b = content_hash(right).select(F.struct(F.col("row_count").alias("right_rows"), F.col("content_hash").alias("right_hash")))
    # Both sides are one-row aggregates; a join of them would be planned as a product.
    return a.withColumn("right", b.scalar()).select("left_rows", "left_hash", "right.*").withColumn(
        "identical",
        (F.col("left_rows") == F.col("right_rows")) & (F.col("left_hash") == F.col("right_hash")))


def differing_rows(left: DataFrame, right: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The keys under which two tables differ, and how: ``missing`` on the right, ``extra`` there, or ``changed``.

    Both sides are summed up by a hash of the key, first into ``buckets`` sums; those that
    differ are cut into as many again, and only the rows of the finer ones that differ
    are compared, key by key. So equal tables are read once, and nearly equal ones give
    the last step a small share of their rows. Keys may repeat, and null is a key:
    rows of a key count as changed if their number or any of them differs.
    """
    if left.columns != right.columns:
        raise ValueError("Both sides need the same columns in the same order.")
    sides = [_hashed(df, keys) for df in (left, right)]
    coarse, fine = F.pmod("key_hash", F.lit(buckets)), F.pmod(F.floor(F.col("key_hash") / buckets), F.lit(buckets))
    sides = [s.withColumn("coarse", coarse).withColumn("fine", fine) for s in sides]
    for level in (["coarse"], ["coarse", "fine"]):
        found = _unequal(sides, level)
        sides = [s.join(F.broadcast(found), level, "left_semi") for s in sides]
    names = [f"__key_{i}" for i in range(len(keys))]
    one, other = (s.groupBy(*names).agg(*_sums()) for s in sides)
    one, other = one.withColumn("in_left", F.lit(True)), other.select(
        *[F.col(n).alias(f"{n}_r") for n in names], F.col("n").alias("m"), F.col("h").alias("g"), F.lit(True).alias("in_right"))
    same = [F.col(n).eqNullSafe(F.col(f"{n}_r")) for n in names]
    both = one.join(other, reduce(lambda x, y: x & y, same), "full")
    what = (F.when(F.col("in_right").isNull(), "missing").when(F.col("in_left").isNull(), "extra")
            .when((F.col("n") != F.col("m")) | (F.col("h") != F.col("g")), "changed"))
    shown = [F.when(F.col("in_left").isNull(), F.col(f"{n}_r")).otherwise(F.col(n)).alias(k) for n, k in zip(names, keys)]
    return both.withColumn("__what", what).where("__what IS NOT NULL").select(*shown, F.col("__what").alias("difference"))


def _sums() -> list:
    return [F.count(F.lit(1)).alias("n"), F.sum(F.col("row_hash").cast("decimal(20,0)")).alias("h")]


def _hashed(df: DataFrame, keys: list[str]) -> DataFrame:
    named = [F.col(quote_name(k)).alias(f"__key_{i}") for i, k in enumerate(keys)]
    flags = [F.col(quote_name(k)).isNull() for k in keys]
    return df.select(*named, F.xxhash64(*[F.col(quote_name(k)) for k in keys], *flags).alias("key_hash"),
                     F.xxhash64(*_hash_parts(df)).alias("row_hash"))


def _unequal(sides: list[DataFrame], level: list[str]) -> DataFrame:
    """The buckets whose sums differ; stored."""
    signed = sides[0].withColumn("sign", F.lit(1)).unionByName(sides[1].withColumn("sign", F.lit(-1)))
    sums = signed.groupBy(*level).agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("row_hash").cast("decimal(20,0)")).alias("h"))
    return checkpointed(sums.where("n <> 0 OR h <> 0").select(*level))


def _storable(df: DataFrame) -> DataFrame:
    """Variant columns travel as JSON text."""
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.VariantType)
                       else F.col(f.name) for f in df.schema.fields])


def take_snapshot(spark: SparkSession, tables, folder: str, now: datetime | None = None) -> str:
    """Write each table below ``folder/backup_<time>``; the manifest, written last,
    is the commit mark, so a snapshot cut short is never restorable."""
    name = (now or datetime.now(timezone.utc)).strftime("backup_%Y%m%d_%H%M%S")
    entries = []
    for table in tables:
        df = spark.table(qualified(table))
        path = f"{folder}/{name}/{table}"
        _storable(df).write.mode("errorifexists").parquet(path)
        about = describe(spark, table)
        statement = spark.sql(f"SHOW CREATE TABLE {qualified(table)}").first()[0]
        entries.append((table, df.schema.json(), statement, about["location"] if about["type"] == "EXTERNAL" else None,
                        *content_hash(spark.read.parquet(path)).first()))
    (spark.createDataFrame(entries, _MANIFEST_SCHEMA).coalesce(1)
     .write.mode("errorifexists").parquet(f"{folder}/{name}/{MANIFEST}"))
    return name


def restore_snapshot(spark: SparkSession, name: str, token: str, folder: str, tables=None) -> list[str]:
    """Replace tables by their state in a snapshot, all of them or none.

    ``token`` must be ``RESTORE`` or the snapshot's name. All tables are first
    written in full, as the snapshot's own statement creates them, and both the stored
    copy and what was written are compared with the manifest; only then are names
    swapped, which is metadata alone. So a table that was dropped comes back with its
    specification, and one that was changed has that of the snapshot again. What is to
    be swapped is written down before the first swap; a restore that is cut short from
    there on is carried through by the next call, or by :func:`finish_restores`.
    """
    ready = prepare_restore(spark, name, token, folder, tables)
    finish_restores(spark)
    return [table for table, _ in ready]


def prepare_restore(spark: SparkSession, name: str, token: str, folder: str, tables=None) -> list[tuple[str, str]]:
    """Write and check the versions of the tables, and write down that they are to be swapped; ``(table, version)`` of each."""
    name, token = name.strip(), token.strip()
    if not re.fullmatch(SNAPSHOT_NAME, name):
        raise ValueError(NO_SNAPSHOT)
    if not token:
        raise ValueError(NO_TOKEN)
    if token not in (CONFIRM, name):
        raise ValueError(BAD_TOKEN)
    manifest = spark.read.schema(_MANIFEST_SCHEMA).parquet(f"{folder}/{name}/{MANIFEST}").collect()
    finish_restores(spark)
    chosen = [m for m in manifest if tables is None or m["table_name"] in tables]
    ready = [(m["table_name"], _write_version(spark, m, f"{folder}/{name}")) for m in chosen]
    if ready:
        write_text(spark, f"{_journals(spark)}/{name}-{uuid.uuid4().hex}.json", json.dumps(ready))
    return ready


def _journals(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sheetlake/restores"


def finish_restores(spark: SparkSession) -> list[str]:
    """Carry through the swaps of restores that were cut short; returns their tables.

    Every version that a journal names is complete, so going on is always possible, and
    each step may be taken again: a version that is gone has been swapped in already.
    """
    done = []
    for journal in names_in(spark, _journals(spark)):
        if not journal.endswith(".json"):
            continue
        path = f"{_journals(spark)}/{journal}"
        for table, version in json.loads(read_text(spark, path)):
            if spark.catalog.tableExists(qualified(version)):
                swap_table(spark, table, version)
            remove_path(spark, sketch_path(spark, table))
            spark.sql(f"DROP TABLE IF EXISTS {qualified(_replaced(version))}")
            done.append(table)
        remove_path(spark, path)
    return done


def _replaced(version: str) -> str:
    return version.removesuffix("__restored") + "__replaced"


def _write_version(spark: SparkSession, entry, snapshot: str) -> str:
    table = entry["table_name"]
    schema, base = split_table_name(table)
    version = f"{schema + '.' if schema else ''}{base}__restored"
    stored = spark.read.parquet(f"{snapshot}/{table}")
    count, total = content_hash(stored).first()
    if (count, total) != (entry["row_count"], entry["content_hash"]):
        raise RuntimeError(f"Snapshot of {table} does not match its manifest.")
    spark.sql(f"DROP TABLE IF EXISTS {qualified(version)}")
    wanted = T.StructType.fromJson(json.loads(entry["definition"]))
    rows = stored.select(*[F.parse_json(f.name).alias(f.name) if isinstance(f.dataType, T.VariantType)
                           else F.col(f.name) for f in wanted.fields])
    # The statement names the table, then its columns, defaults, options, partitions and properties.
    statement = re.sub(r"^CREATE TABLE [^(]*\(", lambda _: f"CREATE TABLE {qualified(version)} (", entry["statement"])
    if entry["location"]:
        # A table with a folder of its own gets its next version beside it.
        beside = f"{entry['location'].rstrip('/')}-{uuid.uuid4().hex[:8]}"
        statement = re.sub(r"\nLOCATION '[^\n]*'", lambda _: f"\nLOCATION '{beside}'", statement)
    spark.sql(statement)
    if "'sheetlake.sequence'" in statement:
        # Ids go on as the snapshot had them, so the restored table has a sequence of its own.
        spark.sql(f"ALTER TABLE {qualified(version)} SET TBLPROPERTIES ('sheetlake.sequence' = '\"{uuid.uuid4().hex}\"')")
    rows.select(*spark.table(qualified(version)).columns).write.insertInto(qualified(version))
    written = spark.read.table(qualified(version)).select(*wanted.fieldNames())
    if tuple(content_hash(_storable(written)).first()) != (count, total):
        raise RuntimeError(f"The restored rows of {table} do not match the snapshot.")
    return version


def swap_table(spark: SparkSession, table: str, version: str) -> None:
    """Give the version the table's name; the table goes on as the replaced one until the restore is finished."""
    old = _replaced(version)
    held = spark.catalog.tableExists(qualified(table))
    if held:
        spark.sql(f"DROP TABLE IF EXISTS {qualified(old)}")
        spark.sql(f"ALTER TABLE {qualified(table)} RENAME TO {qualified(old)}")
    try:
        spark.sql(f"ALTER TABLE {qualified(version)} RENAME TO {qualified(table)}")
    except Exception:
        if held:
            spark.sql(f"ALTER TABLE {qualified(old)} RENAME TO {qualified(table)}")
        raise
