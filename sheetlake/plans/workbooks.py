"""Registered queries: workbooks written from the tables and read back."""

from __future__ import annotations

import shutil
import time

from pyspark.sql import functions as F

from ..operators.catalog import TargetColumn, TargetTable, target_table
from ..operators.imports import import_run, import_workbooks
from ..operators.load import coerce_rows
from ..session import make_folder, qualified_path, scratch_path
from ..sources.files import file_system, open_input
from ..sources.tables import open_parquet
from ..sources.workbook_reader import header_cells, scan_cells, scan_headers, scan_rows, workbook_files
from ..sources.workbook_writer import export_workbook, exported_files, numeric_as_double, template_workbook
from ..streaming.landing import import_landing
from .ingest import load_orders, new_load_table
from .registry import registry

QUERIES, ORACLES, register = registry()


PART_ROWS = 20_000  # so that also a table of one file becomes several workbooks
TASK_ROWS = 5 * PART_ROWS
COPY_BYTES = 1 << 20


def _export(df, path):
    """Dealt out to several tasks, as a table of one file is one split, and to more for more rows."""
    return export_workbook(df, path, PART_ROWS, tasks=max(8, -(-df.count() // TASK_ROWS)))


def _orders(spark, folder):
    return open_parquet(spark, folder, "orders").withColumn(
        "o_totalprice", F.col("o_totalprice").cast("decimal(15,2)"))


@register("export_numeric", """
SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS DOUBLE) AS o_totalprice FROM orders""")
def export_numeric(spark, folder):
    return numeric_as_double(_orders(spark, folder).select("o_orderkey", "o_totalprice"))


@register("export_manifest", """
SELECT count(*) AS row_count, true AS all_written, count(*) AS rows_read, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders""")
def export_manifest(spark, folder):
    """What the manifest says next to what is read back from the parts it lists."""
    path = scratch_path(spark, "export")
    manifest = _export(_orders(spark, folder), path)
    listed = manifest.agg(F.sum("rows").alias("row_count"), (F.min("bytes") > 0).alias("all_written"))
    cells = scan_cells(exported_files(spark, path)).where("ordinal > 0")
    read = cells.agg(F.struct(F.count(F.lit(1)).alias("rows_read"),
                              F.sum(F.col("cells")[1]["text"].cast("double")).cast("bigint").alias("key_sum")).alias("read"))
    return listed.withColumn("read", read.scalar()).select("row_count", "all_written", "read.*")


@register("scan_row_numbers", """
SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_orderstatus,
       CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS DECIMAL(38,9)) AS o_totalprice, o_orderdate, true AS numbered
FROM orders""")
def scan_row_numbers(spark, folder):
    """All orders through workbooks and back; data rows follow the header without gaps."""
    path = scratch_path(spark, "scan")
    _export(_orders(spark, folder), path)
    target = TargetTable("scanned", (
        TargetColumn("o_orderkey", "INTEGER"), TargetColumn("o_custkey", "INTEGER"), TargetColumn("o_orderstatus"),
        TargetColumn("o_totalprice", "NUMERIC"), TargetColumn("o_orderdate", "TIMESTAMP")))
    rows = scan_rows(workbook_files(spark, path), [c.name for c in target.columns])
    typed = coerce_rows(rows, target, keep=("row_number", "ordinal"), cells="cells")
    return typed.withColumn("numbered", F.col("row_number") == F.col("ordinal") + 1).drop(
        "row_number", "ordinal", "errors")


@register("scan_cell_kinds", """
SELECT 'b' AS kind, count(*) AS cell_count FROM events WHERE value IS NOT NULL
UNION ALL SELECT 'n', 2 * count(*) FROM events
UNION ALL SELECT 's', count(*) + count(nullif(event_type, 'view')) FROM events""")
def scan_cell_kinds(spark, folder):
    """Cells by kind over exported events: numbers, texts, booleans; nulls leave no cell."""
    path = scratch_path(spark, "kinds")
    events = open_parquet(spark, folder, "events").select(
        "event_id", "value", (F.col("value") > 10).alias("high"), "props",
        F.nullif("event_type", F.lit("view")).alias("event_type"))
    _export(events, path)
    cells = scan_cells(workbook_files(spark, path)).where("ordinal > 0")
    return cells.select(F.explode("cells")).groupBy(F.col("value.kind").alias("kind")).agg(
        F.count(F.lit(1)).alias("cell_count"))


def _sheets(spark, folder, status: str, with_errors: bool, others: bool = False):
    """Orders of a status; with ``others`` also those of none of the three."""
    total = F.lit("n/a") if with_errors else F.col("o_totalprice").cast("string")
    found = F.col("o_orderstatus")
    if others:
        found = F.when(found.isin(*"FOP"), found).otherwise(status)
    return _orders(spark, folder).where(found == status).select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"), total.alias("total"),
        F.col("o_orderdate").alias("placed"))


def mixed_folder(spark, folder) -> str:
    """A folder with good sheets, sheets of bad rows and sheets with a wrong header."""
    path = scratch_path(spark, "landing")
    _export(_sheets(spark, folder, "F", False), f"{path}/good")
    _export(_sheets(spark, folder, "O", True), f"{path}/bad")
    _export(_sheets(spark, folder, "P", False).withColumnRenamed("total", "Total"), f"{path}/mismatch")
    return path


_LOADED = """
SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS DECIMAL(38,9)) AS total,
       o_orderdate AS placed, 'sheet' AS channel FROM orders WHERE o_orderstatus = 'F'"""


@register("import_workbooks", _LOADED)
def import_folder(spark, folder):
    """Only the good sheets of a mixed folder end up in the table."""
    table = new_load_table(spark, "imported")
    import_workbooks(workbook_files(spark, mixed_folder(spark, folder)), table, "run_1")
    return spark.table(table).select("o_orderkey", "total", "placed", "channel")


@register("import_outcomes", """
SELECT outcome, CAST(sum(total_rows) AS BIGINT) AS total_rows, CAST(sum(error_rows) AS BIGINT) AS error_rows
FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'rejected' ELSE 'header_mismatch' END AS outcome,
             1 AS total_rows, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END AS error_rows FROM orders)
GROUP BY outcome""")
def import_outcomes(spark, folder):
    """Rows seen and rows refused per outcome of the same folder, looked up by the run's id."""
    table = new_load_table(spark, "outcomes")
    import_workbooks(workbook_files(spark, mixed_folder(spark, folder)), table, "run_1")
    return import_run(spark, table, "run_1").runs.groupBy("outcome").agg(
        F.sum("total_rows").alias("total_rows"), F.sum("error_rows").alias("error_rows"))


@register("landing_import", _LOADED)
def landing_import(spark, folder):
    """The mixed folder as a stream of files, in several batches."""
    table = new_load_table(spark, "landed")
    stream = import_landing(spark, mixed_folder(spark, folder), table, scratch_path(spark, "landing-checkpoint"), max_files=12)
    stream.awaitTermination()
    return spark.table(table).select("o_orderkey", "total", "placed", "channel")


@register("header_scan", """
SELECT pos, header, true AS same_in_all FROM (VALUES (1, 'o_orderkey'), (2, 'o_custkey'), (3, 'o_orderstatus'),
    (4, 'o_totalprice'), (5, 'o_orderdate'), (6, 'o_orderpriority')) AS t(pos, header)""")
def header_scan(spark, folder):
    """Header rows of all exported parts, read both ways: first rows only, and with all cells."""
    path = scratch_path(spark, "headers")
    _export(_orders(spark, folder), path)
    files = workbook_files(spark, path)
    quick = scan_headers(files).select("path", F.inline("headers"))
    full = header_cells(scan_cells(files)).select("path", F.inline("headers"))
    both = quick.unionByName(full).groupBy("pos", "header").agg(
        F.count(F.lit(1)).alias("seen"), F.count_distinct("path").alias("files"))
    return both.select("pos", "header", (F.col("seen") == 2 * F.col("files")).alias("same_in_all"))


@register("landing_two_folders", """
SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS DECIMAL(38,9)) AS total,
       o_orderdate AS placed, 'sheet' AS channel FROM orders""")
def landing_two_folders(spark, folder):
    """Two folders, each with a stream and a checkpoint of its own, into one table."""
    table, path = new_load_table(spark, "two_folders"), scratch_path(spark, "landing-two")
    for name, states in (("x", "FO"), ("y", "P")):
        for state in states:
            _export(_sheets(spark, folder, state, False), f"{path}/{name}/{state}")
        import_landing(spark, f"{path}/{name}", table, f"{path}-checkpoint-{name}").awaitTermination()
    return spark.table(table).select("o_orderkey", "total", "placed", "channel")


@register("landing_replaced_file", """
SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS DECIMAL(38,9)) AS total,
       o_orderdate AS placed, 'sheet' AS channel FROM orders""")
def landing_replaced_file(spark, folder):
    """A landing folder after its first import: files replaced under their names, some much older than the others, and
    copies under other names. The first two come in, each once; the copies do not."""
    table, path = new_load_table(spark, "replaced"), scratch_path(spark, "landing-replaced")
    checkpoint = f"{path}-checkpoint"
    sheets = {s: sheet_workbooks(_sheets(spark, folder, s, False, others=s == "P"), f"{path}-{s}") for s in "FOP"}
    copy_files(spark, sheets["F"], f"{path}/orders")
    import_landing(spark, path, table, checkpoint).awaitTermination()
    copy_files(spark, sheets["F"], f"{path}/again")
    copy_files(spark, sheets["O"], f"{path}/orders")
    copy_files(spark, sheets["P"], f"{path}/old", age_days=400)
    for _ in range(2):  # the second finds nothing new
        import_landing(spark, path, table, checkpoint).awaitTermination()
    return spark.table(table).select("o_orderkey", "total", "placed", "channel")


def sheet_workbooks(df, path: str) -> list[str]:
    """All rows in as many workbooks as they call for, one if they are few; the paths of all of them.

    A landing folder takes in a content once, and rows that come twice may fill two workbooks alike. So each task puts
    a mark of its own into its first row, in a column without a header, which no import reads.
    """
    rows = df.repartition(max(1, -(-df.count() // TASK_ROWS)))
    place = F.monotonically_increasing_id()  # the partition, and in the lower 33 bits the row within it
    first = place.bitwiseAND((1 << 33) - 1) == 0
    manifest = export_workbook(
        rows.withColumn(" ", F.when(first, F.concat(F.lit(f"{path} "), place.cast("string")))), path)
    return sorted(f"{qualified_path(df.sparkSession, path)}/{r['part']}" for r in manifest.select("part").collect())


def copy_files(spark, sources: list[str], name: str, age_days: int = 0) -> None:
    """Copies of workbooks under a name and their number, in place of any that have it; tasks copy, some files each."""
    targets = [f"{qualified_path(spark, name)}-{i:07d}.xlsx" for i in range(len(sources))]
    make_folder(spark, name.rsplit("/", 1)[0])

    def run(batches):
        for batch in batches:
            for source, target in zip(batch.column("source").to_pylist(), batch.column("target").to_pylist()):
                system, place = file_system(target)
                with open_input(source) as file, system.open_output_stream(place) as out:
                    shutil.copyfileobj(file, out, COPY_BYTES)
            yield batch

    pairs = spark.createDataFrame(list(zip(sources, targets)), "source STRING, target STRING")
    pairs.repartition(min(len(sources), spark.sparkContext.defaultParallelism)).mapInArrow(run, pairs.schema).count()
    if age_days:
        changed = int((time.time() - age_days * 86400) * 1000)
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        for target in targets:
            file = spark._jvm.org.apache.hadoop.fs.Path(target)
            file.getFileSystem(conf).setTimes(file, changed, -1)


@register("template_headers", """
SELECT pos, header, (SELECT count(*) FROM orders) AS table_rows, CAST(0 AS BIGINT) AS template_rows
FROM (VALUES (1, 'id'), (2, 'o_orderkey'), (3, 'total'), (4, 'placed'), (5, 'channel')) AS t(pos, header)""")
def template_headers(spark, folder):
    """The template of a loaded table: its column names in order, and none of its rows."""
    table, path = load_orders(spark, folder, "template"), scratch_path(spark, "template")
    columns = [c.name for c in target_table(spark, table).columns]
    template_workbook(spark.table(table).select(*columns), path)
    files = exported_files(spark, path)
    headers = scan_headers(files).select(F.inline("headers")).select("pos", "header")
    rows = scan_cells(files).where("ordinal > 0").agg(F.count(F.lit(1)).alias("template_rows"))
    held = spark.table(table).agg(F.count(F.lit(1)).alias("table_rows"))
    return headers.select("pos", "header", held.scalar().alias("table_rows"), rows.scalar().alias("template_rows"))
