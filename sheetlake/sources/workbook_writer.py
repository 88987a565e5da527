"""Workbook export: each partition of a query becomes part workbooks with one sheet.

The sink is a Python data source, so Spark's own write protocol applies: tasks
write parts under names of their job and attempt, and when the whole job has
succeeded the manifest lists those of the attempts Spark accepted.
"""

from __future__ import annotations

import json
import re
import time
import uuid
import zipfile
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..session import qualified_path
from .files import file_system
from .workbook_reader import dealt

# Limits of the format and the exported sheet's name.
SHEET_ROWS = 1048576
SHEET_NAME = "Export"
EXACT_INTEGER = 9007199254740992  # integers a spreadsheet number holds exactly
DAY_ZERO = 25569  # serial of 1970-01-01
MANIFEST = "manifest.json"
MANIFEST_SCHEMA = "part STRING, rows BIGINT, bytes BIGINT"

_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPES = "application/vnd.openxmlformats-officedocument.spreadsheetml"
# The parts every workbook file must have.
_FRAME = {
    "[Content_Types].xml": (
        f'<Types xmlns="{_PACKAGE}/content-types">'
        '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{_TYPES}.sheet.main+xml"/>'
        f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_TYPES}.worksheet+xml"/></Types>'),
    "_rels/.rels": (
        f'<Relationships xmlns="{_PACKAGE}/relationships">'
        f'<Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>'),
    "xl/workbook.xml": (
        f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}">'
        f'<sheets><sheet name="{SHEET_NAME}" sheetId="1" r:id="rId1"/></sheets></workbook>'),
    "xl/_rels/workbook.xml.rels": (
        f'<Relationships xmlns="{_PACKAGE}/relationships">'
        f'<Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'),
}
_SHEET_START = f'<worksheet xmlns="{_MAIN}"><sheetData>'
_SHEET_END = "</sheetData></worksheet>"
# Characters XML cannot carry, and text that already looks like their escape.
_NEEDS_ESCAPE = "[\\x00-\\x08\\x0b-\\x1f]|_x[0-9A-Fa-f]{4}_"


def _column_letters(index: int) -> str:
    letters = ""
    while index:
        index, rest = divmod(index - 1, 26)
        letters = chr(65 + rest) + letters
    return letters


def _escape(text):
    """``_xHHHH_`` for what XML cannot carry; a literal ``_xHHHH_`` has its underscore escaped."""
    def one(match):
        found = match.group(0)
        return "_x005F" + found if found.startswith("_") else f"_x{ord(found):04X}_"
    return None if text is None else re.sub(_NEEDS_ESCAPE, one, text)


def _text_xml(column):
    import pyarrow as pa
    import pyarrow.compute as pc

    if pc.any(pc.match_substring_regex(column, _NEEDS_ESCAPE)).as_py():
        column = pa.array([_escape(v) for v in column.to_pylist()], pa.string())
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        column = pc.replace_substring(column, char, entity)
    return column


def _cells_xml(column, letters: str, numbers):
    """One XML cell per value; nulls give no cell."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def joined(start, body, end):
        cell = pc.binary_join_element_wise(f'<c r="{letters}', numbers, start, body, end, "")
        return pc.fill_null(cell, "")

    def inline(values):
        return joined('" t="inlineStr"><is><t xml:space="preserve">', _text_xml(values), "</t></is></c>")

    def number(values):
        return joined('"><v>', pc.cast(values, pa.string()), "</v></c>")

    kind = column.type
    if pa.types.is_boolean(kind):
        return joined('" t="b"><v>', pc.cast(pc.cast(column, pa.int8()), pa.string()), "</v></c>")
    if pa.types.is_integer(kind):
        if kind.bit_width < 64:
            return number(column)
        exact = pc.and_(pc.less_equal(column, EXACT_INTEGER), pc.greater_equal(column, -EXACT_INTEGER))
        return pc.if_else(pc.fill_null(exact, True), number(column), inline(pc.cast(column, pa.string())))
    if pa.types.is_floating(kind):
        column = pc.cast(column, pa.float64())
        finite = pc.fill_null(pc.is_finite(column), True)
        return pc.if_else(finite, number(column), inline(pc.cast(column, pa.string())))
    if pa.types.is_date(kind):
        return number(pc.add(pc.cast(column, pa.int32()), DAY_ZERO))
    if pa.types.is_timestamp(kind):
        micros = pc.cast(pc.cast(column, pa.timestamp("us")), pa.int64())
        return number(pc.add(pc.divide(pc.cast(micros, pa.float64()), 86400e6), float(DAY_ZERO)))
    return inline(pc.cast(column, pa.string()))


def _rows_xml(batch, first_row: int) -> bytes:
    import pyarrow as pa
    import pyarrow.compute as pc

    numbers = pc.cast(pa.array(range(first_row, first_row + batch.num_rows), pa.int64()), pa.string())
    cells = [_cells_xml(column, _column_letters(i), numbers) for i, column in enumerate(batch.columns, 1)]
    rows = pc.binary_join_element_wise('<row r="', numbers, '">', *cells, "</row>", "")
    return "".join(rows.to_pylist()).encode("utf-8")


def _part_name(partition: int, file: int) -> str:
    """Names sort in row order."""
    return f"part-{partition:07d}-{file:04d}.xlsx"


class _Part:
    """One workbook file being written; its header row is already in."""

    def __init__(self, system, path: str, names):
        import pyarrow as pa

        self._out = system.open_output_stream(path)
        self._book = zipfile.ZipFile(self._out, "w", zipfile.ZIP_DEFLATED, compresslevel=2)
        for name, body in _FRAME.items():
            self._book.writestr(name, _XML + body)
        self._sheet = self._book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self._sheet.write((_XML + _SHEET_START).encode())
        header = pa.RecordBatch.from_arrays([pa.array([n], pa.string()) for n in names], names=list(names))
        self._sheet.write(_rows_xml(header, 1))
        self.rows = 0

    def add(self, batch) -> None:
        self._sheet.write(_rows_xml(batch, self.rows + 2))
        self.rows += batch.num_rows

    def close(self) -> int:
        self._sheet.write(_SHEET_END.encode())
        self._sheet.close()
        self._book.close()
        self._out.flush()
        size = self._out.tell()
        self._out.close()
        return size


@dataclass
class _Written(WriterCommitMessage):
    parts: list  # (part name, rows, bytes)


class WorkbookWriter(DataSourceArrowWriter):
    """Parts go to a folder of their job; the manifest, written last, says which of them count.

    Until the manifest is replaced, readers that go by it see the earlier result
    whole, and after it the new one. What it does not name is removed after that.
    """

    def __init__(self, options, names, overwrite: bool):
        self.folder = options["path"].rstrip("/")
        self.limit = int(options.get("maxRows", SHEET_ROWS - 1))
        self.names = names
        self.overwrite = overwrite
        self.job = f"export-{uuid.uuid4().hex[:12]}"
        # Made here, on the driver, and never by a task: after an abort has removed it, a late task cannot open a part.
        system, folder = file_system(self.folder)
        system.create_dir(f"{folder}/{self.job}", recursive=True)

    def write(self, iterator):
        from pyspark import TaskContext

        context = TaskContext.get()
        system, folder = file_system(self.folder)
        written, part, name = [], None, None

        def finish():
            if part is not None:
                written.append((name, part.rows, part.close()))

        for batch in iterator:
            start = 0
            while start < batch.num_rows:
                if part is None or part.rows >= self.limit:
                    finish()
                    name = self._name(context.partitionId(), len(written), context.taskAttemptId())
                    part = _Part(system, f"{folder}/{name}", self.names)
                taken = batch.slice(start, self.limit - part.rows)
                part.add(taken)
                start += taken.num_rows
        finish()
        return _Written(written)

    def _name(self, partition: int, file: int, attempt: int) -> str:
        return f"{self.job}/" + _part_name(partition, file).replace(".xlsx", f"-{attempt}.xlsx")

    def commit(self, messages):
        from pyarrow import fs

        system, folder = file_system(self.folder)
        accepted = sorted(p for m in messages if m is not None for p in m.parts)
        earlier = [] if self.overwrite else manifest_entries(system, folder)
        if not accepted and not earlier:
            name = self._name(0, 0, 0)
            accepted = [(name, 0, _Part(system, f"{folder}/{name}", self.names).close())]
        entries = earlier + [{"part": n, "rows": r, "bytes": b} for n, r, b in accepted]
        # An object store shows a file when it is closed; elsewhere a rename does as much.
        fresh = f"{folder}/_{MANIFEST}-{self.job}"
        with system.open_output_stream(fresh) as out:
            out.write("".join(json.dumps(e) + "\n" for e in entries).encode())
        system.move(fresh, f"{folder}/{MANIFEST}")
        kept = {e["part"] for e in entries}
        jobs = {name.split("/")[0] for name in kept}
        for entry in system.get_file_info(fs.FileSelector(folder)):
            if entry.base_name.startswith("export-") and entry.base_name not in jobs:
                system.delete_dir(entry.path)
        attempts = system.get_file_info(fs.FileSelector(f"{folder}/{self.job}", allow_not_found=True))
        lost = [f.path for f in attempts if f"{self.job}/{f.base_name}" not in kept]
        with ThreadPoolExecutor(32) as pool:
            list(pool.map(system.delete_file, lost))

    def abort(self, messages):
        from pyarrow import fs

        system, folder = file_system(self.folder)
        # A task that is still running may open a part while the folder is being emptied.
        for wait in (0, 0.2, 1, 5):
            time.sleep(wait)
            try:
                if system.get_file_info(f"{folder}/{self.job}").type == fs.FileType.Directory:
                    system.delete_dir(f"{folder}/{self.job}")
                return
            except OSError:
                continue


def manifest_entries(system, folder: str) -> list[dict]:
    """The parts that the last committed export of a folder lists; none without one."""
    if not system.get_file_info(f"{folder}/{MANIFEST}").is_file:
        return []
    with system.open_input_stream(f"{folder}/{MANIFEST}") as kept:
        return [json.loads(line) for line in kept.read().decode().splitlines()]


class WorkbookSink(DataSource):
    """``df.write.format("workbook").mode("overwrite").save(folder)``"""

    @classmethod
    def name(cls):
        return "workbook"

    def writer(self, schema, overwrite):
        return WorkbookWriter(self.options, [f.name for f in schema.fields], overwrite)


def numeric_as_double(df: DataFrame) -> DataFrame:
    """Decimal columns as floating numbers, the form they are exported in."""
    return df.select(*[F.col(_quoted(f.name)).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
                       else F.col(_quoted(f.name)) for f in df.schema.fields])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def exportable(df: DataFrame) -> DataFrame:
    """Distinct column names, decimals as doubles, nested values as JSON text."""
    names: list[str] = []
    for name in df.columns:
        unique, n = name, 1
        while unique in names:
            n += 1
            unique = f"{name}_{n}"
        names.append(unique)
    df = numeric_as_double(df.toDF(*names))
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)

    def shown(f):
        c = F.col(_quoted(f.name))
        if isinstance(f.dataType, nested):
            return F.to_json(c).alias(f.name)
        if isinstance(f.dataType, T.BinaryType):
            return F.base64(c).alias(f.name)
        if isinstance(f.dataType, T.TimestampType):
            return c.cast("timestamp_ntz").alias(f.name)
        return c

    return df.select(*[shown(f) for f in df.schema.fields])


def export_workbook(df: DataFrame, folder: str, max_rows: int = SHEET_ROWS - 1, tasks: int | None = None) -> DataFrame:
    """Write the whole result as part workbooks; returns the manifest ``(part, rows, bytes)``.

    The manifest commits the export: its parts are the result, and
    ``exported_files`` lists those. Parts follow partition order, so a sorted query reads in order part by part.
    ``tasks`` deals the rows out to so many, for a result of few splits whose order does not matter.
    """
    spark = df.sparkSession
    folder = qualified_path(spark, folder)
    spark.dataSource.register(WorkbookSink)
    rows = exportable(df)
    if tasks:
        rows = rows.repartition(tasks)
    rows.write.format("workbook").mode("overwrite").option("maxRows", str(max_rows)).save(folder)
    return spark.read.schema(MANIFEST_SCHEMA).json(f"{folder}/{MANIFEST}")


def exported_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, length)`` of the parts of the last committed export, dealt out for the readers of workbooks.

    The manifest is one small file, so left as it is read, one task would parse all parts.
    """
    folder = qualified_path(spark, folder)
    listed = spark.read.schema(MANIFEST_SCHEMA).json(f"{folder}/{MANIFEST}")
    return dealt(listed.select(F.concat(F.lit(folder.rstrip("/") + "/"), "part").alias("path"), F.col("bytes").alias("length")))


def template_workbook(df: DataFrame, folder: str) -> DataFrame:
    """A workbook with only the header row of a table."""
    return export_workbook(df.limit(0), folder)
