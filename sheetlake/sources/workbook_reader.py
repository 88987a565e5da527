"""Workbook scans: a folder of ``.xlsx`` files as rows with physical row numbers.

Spark lists the files and packs them into tasks by size; no file content passes
through Spark's own rows. A task opens each of its files, reads the sheet as a
stream and sends Arrow batches on. One sheet holds at most 1,048,576 rows, so a
task's work is bounded by the format however large the folder is.
"""

from __future__ import annotations

import json
import re
import zipfile
import zlib
from array import array
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import WHITESPACE
from ..operators.headers import extract_headers
from .files import open_input
from .tables import quote_name

BATCH_ROWS = 4096
TASK_BYTES = 16 << 20  # of workbooks in a task; they are compressed, and take a minute or two to parse
ALL_SHEETS = "*"
# What is said of a workbook that cannot be used.
NOT_FOUND = "Worksheet not found."
NO_HEADER = "Header row is empty or invalid."
CELL = "STRUCT<kind: STRING, text: STRING>"
_PLACE = "path STRING, sheet STRING, row_number INT, ordinal BIGINT"
# The format's escape for characters, and the name of the relation attribute.
_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


# What a damaged file raises: zip, deflate, XML, missing parts, bad references and numbers.
DAMAGED = (zipfile.BadZipFile, zlib.error, EOFError, ElementTree.ParseError, KeyError, IndexError, ValueError)


# ---- one workbook, inside a task ------------------------------------------------

def _decoded(text: str) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m.group(1), 16)), text) if "_x" in text else text


def _column_index(letters: str) -> int:
    index = 0
    for ch in letters:
        index = index * 26 + ord(ch) - 64
    return index


def _finished(book: zipfile.ZipFile, part: str, name: str) -> Iterator:
    """Elements called ``name`` as they end, whatever their namespace; each leaves the tree afterwards."""
    local: dict[str, str] = {}
    above: list = []
    with book.open(part) as stream:
        for event, element in ElementTree.iterparse(stream, events=("start", "end")):
            if event == "start":
                above.append(element)
                continue
            above.pop()
            tag = element.tag
            if (local.get(tag) or local.setdefault(tag, tag.rsplit("}", 1)[-1])) == name:
                yield element
                if above:
                    above[-1].remove(element)


def _text_runs(element) -> str:
    """The text of a string item: its runs joined, phonetic runs left out."""
    runs = []
    for child in element:
        tag = child.tag.rsplit("}", 1)[-1]
        if tag == "t":
            runs.append(child.text or "")
        elif tag != "rPh":
            runs.append(_text_runs(child))
    return "".join(runs)


def _shared_strings(book: zipfile.ZipFile) -> Iterator[str]:
    if "xl/sharedStrings.xml" in book.namelist():
        for item in _finished(book, "xl/sharedStrings.xml", "si"):
            yield _decoded(_text_runs(item))


class _Strings:
    """All shared strings of a book, as one run of bytes and where each ends: a fraction of what text objects take."""

    def __init__(self, values):
        self._bytes, self._ends = bytearray(), array("Q", [0])
        for value in values:
            self._bytes += value.encode("utf-8", "surrogatepass")
            self._ends.append(len(self._bytes))

    def __getitem__(self, number: int) -> str:
        if not 0 <= number < len(self._ends) - 1:
            raise IndexError(f"no shared string {number}")
        return self._bytes[self._ends[number]:self._ends[number + 1]].decode("utf-8", "surrogatepass")


def _sheet_rows(book: zipfile.ZipFile, part: str) -> Iterator[tuple[int, list]]:
    """``(row number, [(column, type, raw text)])`` per row, absent cells left out.

    A formula cell gives its stored result; cell references are honoured, so
    omitted cells leave their column empty.
    """
    columns: dict[str, int] = {}
    number = 0
    for row in _finished(book, part, "row"):
        number = int(row.get("r") or number + 1)
        digits = len(str(number))
        cells, column = [], 0
        for cell in row:
            ref = cell.get("r")
            if ref:
                letters = ref[:-digits]
                column = columns.get(letters) or columns.setdefault(letters, _column_index(letters))
            else:
                column += 1
            kind = cell.get("t", "n")
            for child in cell:
                tag = child.tag
                if tag.endswith("}v"):
                    cells.append((column, kind, child.text or ""))
                elif tag.endswith("}is"):
                    cells.append((column, kind, _text_runs(child)))
        yield number, cells


def _sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """``(sheet name, part)`` in workbook order."""
    relations = {
        r.get("Id"): r.get("Target")
        for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = []
    for element in ElementTree.fromstring(book.read("xl/workbook.xml")).iter():
        if element.tag.rsplit("}", 1)[-1] == "sheet":
            target = relations[element.get(_RELATION)]
            found.append((element.get("name"), target.lstrip("/") if target.startswith("/") else "xl/" + target))
    return found


def _chosen(book: zipfile.ZipFile, sheet: str | None) -> list[tuple[str, str]]:
    parts = _sheet_parts(book)
    return parts[:1] if sheet is None else [p for p in parts if p[0] == sheet][:1]


def _cell(kind: str, text: str, strings) -> tuple[str, str]:
    """``(kind, text)`` of a cell: s text, n number, b boolean, d ISO date, e error."""
    if kind == "s":
        return "s", strings[int(text)]
    if kind in ("inlineStr", "str"):
        return "s", _decoded(text)
    if kind == "b":
        return "b", "true" if text.strip() == "1" else "false"
    if kind == "e":
        return "e", json.dumps({"error": text}, separators=(",", ":"))
    return kind, text


def _strings_upto(book: zipfile.ZipFile, cells) -> dict[int, str]:
    """Only the shared strings one row needs, reading no further than the last of them."""
    wanted = {int(text) for _, kind, text in cells if kind == "s"}
    found: dict[int, str] = {}
    if wanted:
        last = max(wanted)
        for i, value in enumerate(_shared_strings(book)):
            if i in wanted:
                found[i] = value
            if i == last:
                break
    return found


def _header_cells(first, strings) -> list[tuple[int, str]]:
    named = [(column, _cell(kind, text, strings)[1].strip(WHITESPACE)) for column, kind, text in first]
    return [(column, name) for column, name in named if name]


def _each_file(batches, read, schema):
    """Run ``read(path, workbook, sheet)`` over every path; an unreadable file gives an error row.

    A file can turn out damaged after some of its rows are out, so whoever takes
    the rows has to look at the error rows too. Storage errors are raised, for
    Spark to repeat the task.
    """
    for batch in batches:
        for path, sheet in zip(batch.column("path").to_pylist(), batch.column("sheet").to_pylist()):
            try:
                with open_input(path) as raw, zipfile.ZipFile(raw) as book:
                    yield from read(path, book, sheet)
            except DAMAGED as error:
                yield _error_batch(schema, path, None, f"Cannot read workbook: {error}")


def _error_batch(schema, path, sheet, message):
    import pyarrow as pa

    known = {"path": path, "sheet": sheet, "error": message}
    return pa.RecordBatch.from_arrays(
        [pa.array([known.get(f.name)], type=f.type) for f in schema], schema=schema)


# ---- scans ----------------------------------------------------------------------

def workbook_files(spark: SparkSession, path: str, pattern: str = "*.xlsx") -> DataFrame:
    """``(path, length)`` of every workbook below a folder, packed into tasks by size."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", "true").load(path).select("path", "length"))


def dealt(files: DataFrame) -> DataFrame:
    """``path, length`` of files dealt out so that a task has about ``TASK_BYTES``, and all cores have some."""
    spark = files.sparkSession
    count, size = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(min(count, max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))), 1)
    return files.repartition(int(tasks))


def _run(files: DataFrame, read, schema: str, sheet: str | None) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    spark_schema = files.sparkSession.createDataFrame([], schema).schema
    arrow_schema = to_arrow_schema(spark_schema)

    def task(batches):
        return _each_file(batches, lambda path, book, name: read(path, book, arrow_schema, name), arrow_schema)

    listed = workbook_sheets(files) if sheet == ALL_SHEETS else files.select("path", F.lit(sheet).cast("string").alias("sheet"))
    return listed.mapInArrow(task, spark_schema)


def workbook_sheets(files: DataFrame) -> DataFrame:
    """``(path, sheet)`` of every sheet of the files, dealt out so that each may be a task of its own.

    Only the workbook's list of sheets is read. A file that cannot be read is listed
    with a null sheet; scanning it says why.
    """
    def task(batches):
        import pyarrow as pa

        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    with open_input(path) as raw, zipfile.ZipFile(raw) as book:
                        names = [name for name, _ in _sheet_parts(book)]
                except DAMAGED:
                    names = [None]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(names), pa.string()), pa.array(names, pa.string())],
                                                 ["path", "sheet"])

    return files.select("path").mapInArrow(task, "path STRING, sheet STRING").repartition("path", "sheet")


def scan_headers(files: DataFrame, sheet: str | None = None) -> DataFrame:
    """``(path, sheet, headers, error)``, reading no more than each sheet's first row."""
    def read(path, book, schema, sheet):
        import pyarrow as pa

        chosen = _chosen(book, sheet)
        if not chosen:
            yield _error_batch(schema, path, sheet, NOT_FOUND)
        for name, part in chosen:
            number, first = next(_sheet_rows(book, part), (1, []))
            found = _header_cells(first, _strings_upto(book, first)) if number == 1 else []
            entries = [{"pos": p, "header": h} for p, h in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([name]), pa.array([entries], type=schema.field("headers").type),
                 pa.array([None if found else NO_HEADER], type=pa.string())], schema=schema)

    return _run(files, read, "path STRING, sheet STRING, headers ARRAY<STRUCT<pos: INT, header: STRING>>, error STRING", sheet)


def _data_rows(book, part):
    """Header cells and an iterator of ``(row number, ordinal, cells)`` behind them."""
    rows = _sheet_rows(book, part)
    strings = _Strings(_shared_strings(book))
    number, first = next(rows, (0, []))
    header = _header_cells(first, strings) if number == 1 else []
    data = ((number, ordinal, cells) for ordinal, (number, cells) in enumerate(rows, 1))
    return header, strings, data


def _grouped(rows) -> Iterator[list]:
    group: list = []
    for row in rows:
        group.append(row)
        if len(group) == BATCH_ROWS:
            yield group
            group = []
    if group:
        yield group


def scan_cells(files: DataFrame, sheet: str | None = None) -> DataFrame:
    """Every row, header included (ordinal 0), with its cells by column number."""
    def read(path, book, schema, sheet):
        import pyarrow as pa

        chosen = _chosen(book, sheet)
        if not chosen:
            yield _error_batch(schema, path, sheet, NOT_FOUND)
        for name, part in chosen:
            strings = _Strings(_shared_strings(book))
            numbered = ((n, i, cells) for i, (n, cells) in enumerate(_sheet_rows(book, part)))
            for group in _grouped(numbered):
                values = [[(c, dict(zip(("kind", "text"), _cell(k, t, strings)))) for c, k, t in cells]
                          for _, _, cells in group]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(group)), pa.array([name] * len(group)),
                     pa.array([n for n, _, _ in group], pa.int32()), pa.array([i for _, i, _ in group], pa.int64()),
                     pa.array(values, type=schema.field("cells").type), pa.nulls(len(group), pa.string())],
                    schema=schema)

    return _run(files, read, f"{_PLACE}, cells MAP<INT, {CELL}>, error STRING", sheet)


def scan_rows(files: DataFrame, columns, sheet: str | None = None) -> DataFrame:
    """Data rows with the cells of the named ``columns`` in the struct ``cells``.

    Cells are found by header, at the header's own column. A column the sheet
    does not have is a null cell; a blank cell is a cell with null text.
    """
    columns = list(columns)

    def read(path, book, schema, sheet):
        import pyarrow as pa

        chosen = _chosen(book, sheet)
        if not chosen:
            yield _error_batch(schema, path, sheet, NOT_FOUND)
        for name, part in chosen:
            header, strings, rows = _data_rows(book, part)
            if not header:
                yield _error_batch(schema, path, name, NO_HEADER)
                continue
            place: dict[str, int] = {}
            for position, title in header:
                place.setdefault(title, position)
            positions = [place.get(title) for title in columns]
            wanted = {p for p in positions if p is not None}
            nothing = [None] * BATCH_ROWS
            for group in _grouped(rows):
                size = len(group)
                kinds = {p: [None] * size for p in wanted}
                texts = {p: [None] * size for p in wanted}
                for i, (_, _, cells) in enumerate(group):
                    for column, kind, text in cells:
                        if column in wanted:
                            kinds[column][i], texts[column][i] = (
                                (kind, text) if kind == "n" else _cell(kind, text, strings))
                structs = [pa.StructArray.from_arrays(
                    [pa.array(kinds.get(p, nothing[:size]), pa.string()),
                     pa.array(texts.get(p, nothing[:size]), pa.string())],
                    names=["kind", "text"], mask=pa.array([p is None] * size)) for p in positions]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * size), pa.array([name] * size),
                     pa.array([n for n, _, _ in group], pa.int32()), pa.array([i for _, i, _ in group], pa.int64()),
                     pa.StructArray.from_arrays(structs, fields=list(schema.field("cells").type)),
                     pa.nulls(size, pa.string())], schema=schema)

    listed = ", ".join(f"{quote_name(c)}: {CELL}" for c in columns)
    return _run(files, read, f"{_PLACE}, cells STRUCT<{listed}>, error STRING", sheet)


def header_cells(cells: DataFrame) -> DataFrame:
    """Header rows out of :func:`scan_cells`, as the header checks take them."""
    first = cells.where((F.col("row_number") == 1))
    width = F.coalesce(F.array_max(F.map_keys("cells")), F.lit(0))
    texts = F.when(width > 0, F.transform(
        F.sequence(F.lit(1), F.greatest(width, F.lit(1))), lambda i: F.try_element_at("cells", i)["text"]))
    return extract_headers(first.select("path", "sheet", texts.alias("cells")))
