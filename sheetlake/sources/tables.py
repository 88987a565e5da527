"""Table scans: catalog tables by qualified name, and parquet folders as databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def quote_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def split_table_name(name: str) -> tuple[str | None, str]:
    """``schema.table`` split at the first dot; no dot means the default schema."""
    schema, dot, table = name.strip().partition(".")
    return (schema, table) if dot else (None, schema)


def qualified(name: str) -> str:
    schema, table = split_table_name(name)
    return f"{quote_name(schema)}.{quote_name(table)}" if schema else quote_name(table)


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(qualified(name))


def open_parquet(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One table of a parquet folder, its files listed anew."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def register_views(spark: SparkSession, folder: str, tables) -> None:
    """Make tables of a parquet folder readable by name from SQL."""
    for table in tables:
        open_parquet(spark, folder, table).createOrReplaceTempView(table)
