"""Profiles of a table's columns from sketches kept with each load run.

A run's rows are read once, when a profile is first asked for after the run; then its
counts, limits and sketches (distinct values, quantiles) are kept, one row for each
column. A profile of many runs merges those rows and reads no data. What is published
or taken out of the table takes the run's sketches with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import make_folder
from ..sources.tables import qualified, quote_name
from .catalog import RUN_COLUMN, sketch_path, target_table

LOG_DISTINCT = 12  # 2^12 registers: a standard error of 1.6 percent
KLL = 200  # a rank error of 1.65 percent, with 99 percent confidence
SKETCHED = ("column_name STRING, row_count BIGINT, filled BIGINT, distinct_sketch BINARY, quantile_sketch BINARY, "
            f"low STRING, high STRING, number_low DOUBLE, number_high DOUBLE, {RUN_COLUMN} STRING")


def _of_column(field: T.StructField) -> Column:
    c = F.col(quote_name(field.name))
    number = isinstance(field.dataType, T.NumericType)
    plain = isinstance(field.dataType, (T.IntegerType, T.LongType, T.StringType))
    shown = F.to_json(c) if isinstance(field.dataType, (T.VariantType, T.MapType, T.StructType, T.ArrayType)) else c
    as_double = c.cast("double")
    nothing = F.lit(None)
    return F.struct(
        F.lit(field.name).alias("column_name"), F.count(F.lit(1)).alias("row_count"), F.count(c).alias("filled"),
        F.hll_sketch_agg(shown if plain else shown.cast("string"), LOG_DISTINCT).alias("distinct_sketch"),
        (F.kll_sketch_agg_double(as_double, KLL) if number else nothing.cast("binary")).alias("quantile_sketch"),
        (nothing.cast("string") if number else F.min(shown.cast("string"))).alias("low"),
        (nothing.cast("string") if number else F.max(shown.cast("string"))).alias("high"),
        (F.min(as_double) if number else nothing.cast("double")).alias("number_low"),
        (F.max(as_double) if number else nothing.cast("double")).alias("number_high"))


def run_sketches(spark: SparkSession, table: str) -> DataFrame:
    """One row for each run and column of a table with load runs; runs that have none yet are read, in one pass."""
    target = target_table(spark, table)
    if not target.by_run:
        raise ValueError(f"{table} has no load runs.")
    path = sketch_path(spark, table)
    make_folder(spark, path)
    held = spark.sql(f"SHOW PARTITIONS {qualified(table)}").select(F.substring_index("partition", "=", -1).alias(RUN_COLUMN))
    known = spark.read.schema(SKETCHED).parquet(path)
    missing = [r[0] for r in held.join(known.select(RUN_COLUMN).distinct(), RUN_COLUMN, "left_anti").collect()]  # names of new runs
    if missing:
        rows = spark.table(qualified(table)).where(F.col(RUN_COLUMN).isin(missing))
        columns = [f for f in rows.schema.fields if f.name != RUN_COLUMN]
        each = rows.groupBy(RUN_COLUMN).agg(F.array(*[_of_column(f) for f in columns]).alias("columns"))
        each.select(F.inline("columns"), RUN_COLUMN).write.mode("append").partitionBy(RUN_COLUMN).parquet(path)
        known = spark.read.schema(SKETCHED).parquet(path)
    return known.join(held, RUN_COLUMN, "left_semi")


def table_profile(spark: SparkSession, table: str, runs=None, shares=(0.25, 0.5, 0.75)) -> DataFrame:
    """For each column: rows, filled rows, about how many values differ, limits, and quantiles of numbers.

    ``runs`` names the load runs to take together, all by default. Counts and limits are
    exact. Limits of numbers are doubles, of other columns texts.
    """
    sketches = run_sketches(spark, table)
    if runs is not None:
        sketches = sketches.where(F.col(RUN_COLUMN).isin(list(runs)))
    merged = sketches.groupBy("column_name").agg(
        F.sum("row_count").alias("row_count"), F.sum("filled").alias("filled"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("number_low").alias("number_low"), F.max("number_high").alias("number_high"))
    has_numbers = F.col("number_low").isNotNull()
    quantiles = F.when(has_numbers, F.kll_sketch_get_quantile_double(
        "quantile_sketch", F.array(*[F.lit(float(s)) for s in shares])))
    return merged.select("column_name", "row_count", "filled", F.hll_sketch_estimate("distinct_sketch").alias("distinct_values"),
                         "low", "high", "number_low", "number_high", quantiles.alias("quantiles"))
