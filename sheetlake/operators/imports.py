"""Workbook imports: a folder of sheets into one table, each sheet all or nothing."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove_path, shared_dir
from ..sources.workbook_reader import scan_headers, scan_rows
from .catalog import table_place, target_table
from .headers import header_report
from .load import (BATCH_ROWS, coerce_rows, drop_run, first_bad_batch, import_summary, publish_rows, table_rows,
                   with_key_errors, with_sequence)
from .mapping import row_errors
from .runs import check_run_id, record_run, run_log

PLACE = ("path", "sheet")


@dataclass(frozen=True)
class ImportReport:
    """``runs``: one row per workbook with its header check, counts and outcome.

    ``raw``: the rows as read, tagged with the run. ``published_rows``: rows now
    in the table. The error reports are computed when asked for.
    """

    run_id: str
    runs: DataFrame
    raw: DataFrame
    published_rows: int
    rejected: DataFrame

    def errors(self) -> DataFrame:
        """Every failed field of the rejected sheets."""
        return row_errors(self.rejected, (*PLACE, "row_number"))

    def first_errors(self) -> DataFrame:
        """Those of each sheet's first failing batch of 1000 rows."""
        failing = first_bad_batch(self.rejected, F.col("ordinal"), PLACE, BATCH_ROWS)
        return row_errors(failing, (*PLACE, "row_number", "batch"))


def store_path(spark: SparkSession, table: str, run_id: str) -> str:
    """Where the rows and the outcome of a run are kept."""
    check_run_id(run_id)
    return f"{shared_dir(spark)}/sheetlake/imports/{table_place(spark, table)}/{run_id}"


def import_workbooks(files: DataFrame, table: str, run_id: str, sheet: str | None = None) -> ImportReport:
    """Import every workbook of ``files`` into ``table`` as one load run.

    A sheet with a wrong header, or with any bad row, leaves nothing behind; the
    others are published together. The sheets are parsed once, into the raw
    store, and their rows typed once, into the store beside it; checks, publishing and
    error reports read those. Repeating a run replaces what the earlier attempt
    wrote; if nothing is good any more, its rows leave the table.
    """
    spark = files.sparkSession
    target = target_table(spark, table)
    store = store_path(spark, table, run_id)
    started, place = datetime.now(timezone.utc), table_place(spark, table)
    record_run(spark, run_id, table, place, started)

    scanned = scan_headers(files, sheet)
    report = (header_report(scanned.where("error IS NULL"), target.columns)
              .unionByName(scanned.where("error IS NOT NULL").select("path", "sheet", "error"), True))
    headers = _written(report, f"{store}/headers")

    columns = [c.name for c in target.columns]
    rows = scan_rows(files, columns, sheet).withColumn("run_id", F.lit(run_id))
    scanned_rows = _written(with_sequence(rows), f"{store}/raw")
    raw = scanned_rows.where("error IS NULL").drop("error")
    # A file may be damaged behind its header; what was read of it must not count.
    damaged = scanned_rows.where("error IS NOT NULL").groupBy("path").agg(F.min("error").alias("scan_error"))

    typed = _written(coerce_rows(raw, target, keep=(*PLACE, "row_number", "ordinal", "seq"), cells="cells", into="row"),
                     f"{store}/typed")
    checked = with_key_errors(spark, target, typed, run_id)
    runs = _written(_outcomes(headers, damaged, import_summary(checked, PLACE), run_id), f"{store}/runs")

    good = runs.where("outcome = 'success'")
    counts = _counts(runs)
    total = counts["published_rows"]
    if total:
        accepted = checked.join(good.select(*PLACE), list(PLACE), "left_semi")
        publish_rows(spark, table, table_rows(spark, target, accepted, scanned_rows), run_id)
    else:
        drop_run(spark, table, run_id)
    rejected = runs.where("outcome = 'rejected'").select(*PLACE)
    # Only rows of rejected sheets are read again.
    failing = _written(checked.join(rejected, list(PLACE), "left_semi") if counts["error_rows"] else checked.limit(0),
                       f"{store}/rejected")
    remove_path(spark, f"{store}/typed")
    outcome = "success" if counts.pop("files") == counts.pop("good_files") else "partial" if total else "rejected"
    record_run(spark, run_id, table, place, started, outcome, **counts)
    return ImportReport(run_id, runs, raw, total, failing)


def _counts(runs: DataFrame) -> dict:
    good = F.col("outcome") == "success"
    sums = {c: F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_rows", "ok_rows", "error_rows")}
    return runs.agg(*sums.values(), F.coalesce(F.sum(F.when(good, F.col("total_rows"))), F.lit(0)).alias("published_rows"),
                    F.count(F.lit(1)).alias("files"), F.count_if(good).alias("good_files")).first().asDict()


def import_run(spark: SparkSession, table: str, run_id: str) -> ImportReport:
    """What is kept of an earlier import: its outcomes, its rows as read, and its errors."""
    store = store_path(spark, table, run_id)
    runs, raw, rejected = (spark.read.parquet(f"{store}/{part}") for part in ("runs", "raw", "rejected"))
    return ImportReport(run_id, runs, raw.where("error IS NULL").drop("error"), _counts(runs)["published_rows"], rejected)


def import_by_id(spark: SparkSession, run_id: str) -> ImportReport:
    """:func:`import_run` by the run's id alone; an id that several tables share names none of them."""
    tables = [r["table_name"] for r in run_log(spark, run_id).select("table_name").collect()]
    if not tables:
        raise ValueError(f"No such run: {run_id}")
    if len(tables) > 1:
        raise ValueError(f"Run {run_id} went into several tables: {', '.join(sorted(tables))}")
    return import_run(spark, tables[0], run_id)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _outcomes(headers: DataFrame, damaged: DataFrame, summary: DataFrame, run_id: str) -> DataFrame:
    """A mismatched or unreadable sheet keeps its outcome whatever its rows hold."""
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("total_rows", "ok_rows", "error_rows")]
    error = F.coalesce("error", "scan_error")
    outcome = (F.when(error.isNotNull(), "failure")
               .when(~F.col("ok"), "header_mismatch")
               .otherwise(F.coalesce("outcome", F.lit("success"))))
    return headers.join(damaged, "path", "left").join(summary, list(PLACE), "left").select(
        F.lit(run_id).alias("run_id"), *PLACE, "missing", "extra", "duplicates", "expected", "provided",
        *counts, outcome.alias("outcome"), error.alias("error"))
