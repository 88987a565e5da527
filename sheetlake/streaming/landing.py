"""Landing folder: every content that arrives is imported once, whatever the name and age of its file.

Files are listed by name, time of change and length into small tables beside the
checkpoint, and the stream reads those; so a file that is replaced under its name is
listed again, and none is too old. What a file holds is known by a digest, computed in
the task that reads it. The contents that a table has taken in are kept in a ledger of
that table, and a file whose content is there is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalog import RUN_COLUMN, table_place, target_table
from ..operators.imports import ImportReport, import_workbooks
from ..session import checkpointed, drop_scratch, make_folder, shared_dir
from ..sources.files import open_input
from ..sources.tables import qualified
from ..sources.workbook_reader import dealt

LISTED = "path STRING, modificationTime TIMESTAMP, length BIGINT"
LEDGER = f"digest STRING, path STRING, {RUN_COLUMN} STRING"
CHUNK = 1 << 20
NEVER = "36500d"  # the age at which the stream may forget a listing


def list_landed(spark: SparkSession, folder: str, listings: str, pattern: str = "*.xlsx", max_files: int | None = None) -> int:
    """Add to ``listings`` the files that are not there with their time and length; returns how many.

    One listing names at most ``max_files``. Only names are listed, no content is read.
    """
    make_folder(spark, listings)
    found = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
             .load(folder).select("path", "modificationTime", "length"))
    known = spark.read.schema(LISTED).parquet(listings)
    fresh = checkpointed(found.join(known, ["path", "modificationTime", "length"], "left_anti"))
    count = fresh.count()
    if count:
        (fresh.repartition(1).write.option("maxRecordsPerFile", max_files or 0).mode("append").parquet(listings))
    drop_scratch(fresh)
    return count


def landed_files(spark: SparkSession, listings: str) -> DataFrame:
    """Stream of the listed files, one listing for each batch."""
    return (spark.readStream.schema(LISTED).option("maxFilesPerTrigger", 1).option("maxFileAge", NEVER)
            .parquet(listings).select("path", "length"))


def file_digests(files: DataFrame) -> DataFrame:
    """``path, length, digest``: files are dealt out to tasks; one that has gone meanwhile has a null digest."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path in batch.column("path").to_pylist():
                digest, length = hashlib.sha256(), 0
                try:
                    with open_input(path) as file:
                        while chunk := file.read(CHUNK):
                            digest.update(chunk)
                            length += len(chunk)
                    found = digest.hexdigest()
                except FileNotFoundError:
                    found = None
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([length], pa.int64()), pa.array([found], pa.string())], ["path", "length", "digest"])

    return dealt(files).mapInArrow(run, "path STRING, length BIGINT, digest STRING")


def ledger_path(spark: SparkSession, table: str) -> str:
    return f"{shared_dir(spark)}/sheetlake/landed/{table_place(spark, table)}"


def taken_contents(spark: SparkSession, table: str) -> DataFrame:
    """``digest, path, load_run``: contents of the runs that the table holds now.

    A run that was dropped, or that a restored snapshot does not have, counts no more.
    """
    path = ledger_path(spark, table)
    make_folder(spark, path)
    ledger = spark.read.schema(LEDGER).parquet(path)
    if target_table(spark, table).by_run:
        held = spark.sql(f"SHOW PARTITIONS {qualified(table)}").select(
            F.substring_index("partition", "=", -1).alias(RUN_COLUMN))
        ledger = ledger.join(held, RUN_COLUMN, "left_semi")
    return ledger


def import_landed(files: DataFrame, table: str, run_id: str, sheet: str | None = None) -> ImportReport:
    """Import those of ``files`` whose content the table does not hold, each content once, as one load run.

    What the same run took in before does not count, so a repeated run replaces it. A
    content counts as taken in once one of its sheets is published; rejected files are
    looked at again when they come again.
    """
    spark = files.sparkSession
    digests = checkpointed(file_digests(files.select("path", "length")).where("digest IS NOT NULL"))
    taken = taken_contents(spark, table).where(F.col(RUN_COLUMN) != run_id).select("digest")
    fresh = checkpointed(digests.join(taken, "digest", "left_anti").groupBy("digest").agg(
        F.min(F.struct("path", "length")).alias("file")).select("file.path", "file.length", "digest"))
    report = import_workbooks(dealt(fresh.select("path", "length")), table, run_id, sheet)
    good = report.runs.where("outcome = 'success'").select("path").distinct()
    fresh.join(good, "path", "left_semi").select("digest", "path").write.mode("overwrite").parquet(
        f"{ledger_path(spark, table)}/{RUN_COLUMN}={run_id}")
    for done in (digests, fresh):
        drop_scratch(done)
    return report


def import_landing(spark: SparkSession, folder: str, table: str, checkpoint: str, sheet: str | None = None,
                   on_report=None, max_files: int | None = None, pattern: str = "*.xlsx") -> StreamingQuery:
    """Import all files that have arrived and stop; run again for later ones.

    The checkpoint remembers which listings are done, and holds the stream's own id. A
    load run is named by that id and the batch's number, so a batch that is repeated
    after a failure replaces its first attempt, and streams of other folders or with
    other checkpoints have runs of their own: each content ends up in the table exactly
    once. A file replaced under its name is imported as well, and adds its rows; a copy
    under another name is not, nor a file that is older than those before it left out.
    Two streams that bring the same content at the same moment may both import it.
    """
    listings = f"{checkpoint}/listings"
    list_landed(spark, folder, listings, pattern, max_files)

    def each(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.read.json(f"{checkpoint}/metadata").first()["id"]
        report = import_landed(batch, table, f"landing_{stream}_{number:09d}", sheet)
        # The batch ran in the stream's own session; this one may hold an older file list.
        spark.catalog.refreshTable(qualified(table))
        if on_report:
            on_report(report)

    return (landed_files(spark, listings).writeStream
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(each).start())
