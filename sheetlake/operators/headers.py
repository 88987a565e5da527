"""Header checks for any number of workbooks at once.

The input has one row per sheet, ``(path, sheet, headers)`` with ``headers`` an
array of ``(pos, header)``. A sheet has at most 16,384 columns, so each check is
an array expression on its own row: nothing is shuffled, and a folder of many
workbooks spreads over the cluster as it was scanned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import trim_text

# Rules for new table and column names.
TABLE_NAME = r"^[a-zA-Z_][a-zA-Z0-9_]*$"
COLUMN_NAME = r"^[a-zA-Z0-9_]+$"
MAX_NAME = 63


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def extract_headers(cells: DataFrame, column: str = "cells") -> DataFrame:
    """Trimmed header cells with their own column position; blank cells are left out."""
    placed = F.transform(F.col(column), lambda cell, i: F.struct(
        (i + 1).cast("int").alias("pos"), trim_text(cell).alias("header")))
    return cells.withColumn("headers", F.filter(placed, lambda h: h["header"] != "")).drop(column)


def header_names(column: str = "headers") -> Column:
    return F.col(column)["header"]


def sanitize_name(header) -> Column:
    """Lower case, other characters to ``_``, runs of ``_`` collapsed."""
    return F.regexp_replace(F.regexp_replace(F.lower(header), "[^a-z0-9]", "_"), "_+", "_")


def _repeated(names: Column) -> Column:
    """Values seen more than once: neighbours in sorted order, so n log n per sheet."""
    ordered = F.array_sort(names)
    return F.array_distinct(F.filter(
        ordered, lambda n, i: (i > 0) & (n == F.get(ordered, F.greatest(i - 1, F.lit(0))))))


def missing_required(columns) -> Column:
    """Required columns without a default that the header row does not name."""
    needed = [c.name for c in columns if c.required and c.default is None]
    return F.array_except(_strings(needed), header_names())


def extra_headers(columns) -> Column:
    """Headers that are no column of the table; case counts."""
    known = _strings([c.name for c in columns])
    return F.filter(header_names(), lambda h: ~F.array_contains(known, h))


def duplicate_headers() -> Column:
    return _repeated(header_names())


def sanitized_collisions() -> Column:
    """Column names that several different headers would get."""
    return _repeated(F.transform(F.array_distinct(header_names()), sanitize_name))


def header_report(headers: DataFrame, columns) -> DataFrame:
    """Everything that is wrong with each sheet's header row, and ``ok``."""
    checked = headers.select(
        "path", "sheet",
        missing_required(columns).alias("missing"),
        extra_headers(columns).alias("extra"),
        duplicate_headers().alias("duplicates"),
        _strings([c.name for c in columns]).alias("expected"),
        header_names().alias("provided"),
    )
    wrong = F.size("missing") + F.size("extra") + F.size("duplicates")
    return checked.withColumn("ok", (wrong == 0) & (F.size("provided") > 0))


def required_status(headers: DataFrame, columns) -> DataFrame:
    """Each NOT NULL column of the table, marked present or missing per sheet."""
    required = F.array(*[
        F.struct(F.lit(c.name).alias("name"), F.lit(c.default is not None).alias("has_default"))
        for c in columns if c.required])
    listed = headers.select("path", "sheet", header_names().alias("provided"),
                            F.explode(required).alias("column"))
    absent = ~F.array_contains("provided", F.col("column.name")) & ~F.col("column.has_default")
    return listed.select("path", "sheet", F.col("column.name").alias("column_name"),
                         F.when(absent, "missing").otherwise("present").alias("status"))


def name_problems(table_name, column_name) -> Column:
    """Why a proposed table and column name pair is refused, as an array of texts."""
    table, column = F.col(table_name), F.col(column_name)
    return F.array_compact(F.array(
        F.when(~table.rlike(TABLE_NAME), F.lit("Invalid table name")),
        F.when(F.length(table) > MAX_NAME, F.lit("Table name too long")),
        F.when(~column.rlike(COLUMN_NAME), F.lit("Invalid column name")),
        F.when(F.length(column) > MAX_NAME, F.lit("Column name too long")),
    ))
