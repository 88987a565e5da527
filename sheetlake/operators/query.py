"""SQL as jobs: run, bounded preview, named queries."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import qualified

DEFAULT_PREVIEW = 1000  # fixed value: preview rows when QUERY_PREVIEW_LIMIT is not set


def preview_limit() -> int:
    return int(os.environ.get("QUERY_PREVIEW_LIMIT") or DEFAULT_PREVIEW)


def run_sql(spark: SparkSession, text: str, database: str | None = None, args=None) -> DataFrame:
    """The result of one statement; the field names are in ``schema``, rows or not."""
    if not text or not text.strip():
        raise ValueError("Query is required")
    before = spark.catalog.currentDatabase()
    if database:
        spark.catalog.setCurrentDatabase(database)
    try:
        return spark.sql(text.strip().rstrip(";"), args=args)  # names are resolved here
    finally:
        if database:
            spark.catalog.setCurrentDatabase(before)


def preview(df: DataFrame, limit: int | None = None) -> DataFrame:
    return df.limit(preview_limit() if limit is None else limit)


def preview_status(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``row_count`` of the preview and whether the full result has more rows.

    Reads at most one row past the limit.
    """
    limit = preview_limit() if limit is None else limit
    seen = df.limit(limit + 1).agg(F.count(F.lit(1)).alias("seen"))
    return seen.select(F.least("seen", F.lit(limit)).alias("row_count"),
                       (F.col("seen") > limit).alias("limit_reached"))


def preview_rows(df: DataFrame, limit: int | None = None):
    """Preview rows and the truncation flag in one bounded read."""
    limit = preview_limit() if limit is None else limit
    rows = df.limit(limit + 1).collect()
    return rows[:limit], len(rows) > limit


def save_query(spark: SparkSession, name: str, text: str, temporary: bool = False) -> None:
    """Store a query under a name; it is a view, so other queries can build on it."""
    if not name or not text or not text.strip():
        raise ValueError("Name and query are required")
    kind = "TEMPORARY VIEW" if temporary else "VIEW"
    spark.sql(f"CREATE OR REPLACE {kind} {qualified(name)} AS {text.strip().rstrip(';')}")


def named_query(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(qualified(name))
