"""Clustering of load runs by a table's flagged columns, so that a lookup reads few of their files.

Each run is written anew as files of about ``FILE_ROWS`` rows that hold one range of the
flagged column; with several, of their buckets' interleaved bits, so that a file is
narrow in each of them. Rows stay in their run, which can still be repeated or dropped,
and the catalog is pointed at the new files when all of them are complete.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import remove_others
from ..sources.tables import qualified, quote_name
from .catalog import RUN_COLUMN, target_table
from .intervals import bin_of
from .load import bloom_filters, point_run, run_folder

FILE_ROWS = 2_000_000
BITS = 8  # buckets of a column, as a power of two, where several are interleaved
BORDER_ERROR = 0.001


def _as_number(df: DataFrame, name: str) -> Column:
    """A double that goes up with the column: of texts, their first six bytes."""
    kind, c = df.schema[name].dataType, F.col(quote_name(name))
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    return F.conv(F.rpad(F.substring(F.hex(c.cast("string")), 1, 12), 12, "0"), 16, 10).cast("double")


def _interleaved(df: DataFrame, names) -> Column:
    """The buckets of several columns as one number, bit by bit in turn; nulls lie in the first bucket."""
    numbers = df.select(*[_as_number(df, n).alias(f"c{i}") for i, n in enumerate(names)])
    shares = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    borders = numbers.approxQuantile([f"c{i}" for i in range(len(names))], shares, BORDER_ERROR)
    buckets = [F.coalesce(bin_of(_as_number(df, n), sorted(set(b))), F.lit(0)) for n, b in zip(names, borders)]
    bits = [F.shiftleft(F.shiftright(bucket, bit).bitwiseAND(F.lit(1)).cast("long"), bit * len(names) + i)
            for i, bucket in enumerate(buckets) for bit in range(BITS)]
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def compact_runs(spark: SparkSession, table: str, runs=None, file_rows: int = FILE_ROWS) -> dict[str, int]:
    """Cluster the runs (all by default) of a table with flagged columns; the number of files that each was dealt to.

    A run that is loaded at the same moment would win or lose as a whole; leave it out.
    """
    target = target_table(spark, table)
    if not target.by_run or not target.indexed:
        raise ValueError(f"{table} has no load runs or no flagged columns.")
    held = [r[0].split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {qualified(table)}").collect()]
    made = {}
    for run_id in held:
        if runs is not None and run_id not in runs:
            continue
        rows = spark.table(qualified(table)).where(F.col(RUN_COLUMN) == run_id).drop(RUN_COLUMN)
        flagged = [quote_name(n) for n in target.indexed]
        files = max(-(-rows.count() // file_rows), 1)
        order = flagged if len(flagged) == 1 else ["__place", *flagged]
        placed = rows if len(flagged) == 1 else rows.withColumn("__place", _interleaved(rows, target.indexed))
        clustered = placed.repartitionByRange(files, *order).sortWithinPartitions(*order).drop("__place")
        run = run_folder(spark, table, run_id)
        attempt = f"{run}/{uuid.uuid4().hex}"
        clustered.write.options(**bloom_filters(target)).parquet(attempt)
        point_run(spark, table, run_id, attempt)
        remove_others(spark, run, attempt)
        made[run_id] = files
    return made


def touched_files(spark: SparkSession, table: str, column: str, value) -> DataFrame:
    """``files, touched``: how many files a table has, and in how many of them a value lies within the column's limits."""
    sought = F.lit(value).cast(spark.table(qualified(table)).schema[column].dataType)
    limits = spark.table(qualified(table)).groupBy(F.input_file_name().alias("file")).agg(
        F.min(quote_name(column)).alias("low"), F.max(quote_name(column)).alias("high"))
    return limits.agg(F.count(F.lit(1)).alias("files"), F.count_if((F.col("low") <= sought) & (F.col("high") >= sought)).alias("touched"))
