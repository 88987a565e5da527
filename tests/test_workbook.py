"""Workbook codec: odd cells, sheets, limits, round trips."""

import pytest
from books import simple_book, write_book
from pyspark.sql import functions as F

from sheetlake.sources.workbook_reader import (
    ALL_SHEETS, NO_HEADER, NOT_FOUND, header_cells, scan_cells, scan_headers, scan_rows, workbook_files)
from sheetlake.sources.workbook_writer import export_workbook, template_workbook

ODD_SHARED = ("<si><t>name</t></si><si><r><t>rich </t></r><r><t>text</t></r><rPh><t>no</t></rPh></si>"
              "<si><t>a_x0001_b_x005F_x0041_</t></si>")
ODD_ROWS = (
    '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>  </t></is></c>'
    '<c r="C1" t="str"><f>1+1</f><v>value</v></c><c r="D1" t="inlineStr"><is><t> flag\t</t></is></c></row>'
    '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><f>A1*2</f><v>0</v></c><c r="D2" t="b"><v>0</v></c></row>'
    '<row r="5"><c r="A5" t="s"><v>2</v></c><c r="C5" t="e"><v>#N/A</v></c></row>'
    '<row r="6"/>'
    '<row><c t="inlineStr"><is><r><t>x</t></r><r><t xml:space="preserve"> y</t></r></is></c><c/><c><v>1.5</v></c></row>')


@pytest.mark.parametrize("prefix", ["", "x"])
def test_odd_cells(spark, tmp_path, prefix):
    shared, rows = ODD_SHARED, ODD_ROWS
    if prefix:
        import re
        def named(text):
            return re.sub(r"<(/?)(\w)", rf"<\1{prefix}:\2", text)
        shared, rows = named(shared), named(rows)
    write_book(tmp_path / "odd.xlsx", [("Data", rows)], shared, prefix)
    files = workbook_files(spark, str(tmp_path))
    headers = scan_headers(files).first()
    assert [(h["pos"], h["header"]) for h in headers["headers"]] == [(1, "name"), (3, "value"), (4, "flag")]
    got = scan_rows(files, ["name", "value", "flag", "absent"]).orderBy("row_number").collect()
    assert [(r["row_number"], r["ordinal"]) for r in got] == [(2, 1), (5, 2), (6, 3), (7, 4)]
    cells = [tuple(None if c is None else tuple(c) for c in r["cells"]) for r in got]
    assert cells == [
        (("s", "rich text"), ("n", "0"), ("b", "false"), None),
        (("s", "a\x01b_x0041_"), ("e", '{"error":"#N/A"}'), (None, None), None),
        ((None, None), (None, None), (None, None), None),
        (("s", "x y"), ("n", "1.5"), (None, None), None)]
    again = header_cells(scan_cells(files)).first()
    assert again["headers"] == headers["headers"]


def test_sheet_choice(spark, tmp_path):
    row = '<row r="1"><c r="A1" t="inlineStr"><is><t>{}</t></is></c></row>'
    write_book(tmp_path / "two.xlsx", [("One", row.format("a")), ("Two", row.format("b"))])
    files = workbook_files(spark, str(tmp_path))
    def found(sheet):
        return [(r["sheet"], r["headers"][0]["header"] if r["headers"] else None, r["error"])
                for r in scan_headers(files, sheet).orderBy("sheet").collect()]
    assert found(None) == [("One", "a", None)]
    assert found("Two") == [("Two", "b", None)]
    assert found("Three") == [("Three", None, NOT_FOUND)]
    assert found(ALL_SHEETS) == [("One", "a", None), ("Two", "b", None)]


def test_unreadable_and_headerless_files(spark, tmp_path):
    (tmp_path / "bad.xlsx").write_bytes(b"not a zip")
    write_book(tmp_path / "blank.xlsx", [("S", "")])
    write_book(tmp_path / "late.xlsx", [("S", '<row r="3"><c r="A3"><v>1</v></c></row>')])
    errors = {r["path"].rsplit("/", 1)[1]: r["error"]
              for r in scan_headers(workbook_files(spark, str(tmp_path))).collect()}
    assert errors["blank.xlsx"] == errors["late.xlsx"] == NO_HEADER
    assert errors["bad.xlsx"].startswith("Cannot read workbook")


def test_column_past_z(spark, tmp_path):
    write_book(tmp_path / "wide.xlsx", [("S", '<row r="1"><c r="AB1" t="inlineStr"><is><t>far</t></is></c></row>'
                                         '<row r="2"><c r="AB2"><v>7</v></c></row>')])
    files = workbook_files(spark, str(tmp_path))
    assert scan_headers(files).first()["headers"][0]["pos"] == 28
    assert scan_rows(files, ["far"]).first()["cells"]["far"]["text"] == "7"


def test_round_trip_keeps_every_value(spark, tmp_path):
    text = "a<&>\"' \x01\x1f_x0041_\r\n\t é 漢 " + "long" * 20000
    df = spark.sql("SELECT 1 AS a, 2.5D AS b, 1e300D AS c, true AS d, 1152921504606846977 AS e, "
                   "CAST(1.10 AS DECIMAL(5,2)) AS f, DATE'2024-01-05' AS g, TIMESTAMP_NTZ'2024-01-05 12:00:00' AS h, "
                   "array(1, 2) AS i, CAST(NULL AS STRING) AS j, CAST('NaN' AS DOUBLE) AS k, 1 AS a")
    df = df.withColumn("t", F.lit(text))
    manifest = export_workbook(df, str(tmp_path / "out")).collect()
    assert [(m["part"].split("/")[1][:17], m["rows"]) for m in manifest] == [("part-0000000-0000", 1)]
    names = list("abcdefghijk") + ["a_2", "t"]
    cells = scan_rows(workbook_files(spark, str(tmp_path / "out")), names).first()["cells"]
    assert cells["t"]["text"] == text
    assert [tuple(cells[n]) for n in names[:-1]] == [
        ("n", "1"), ("n", "2.5"), ("n", "1e+300"), ("b", "true"), ("s", "1152921504606846977"), ("n", "1.1"),
        ("n", "45296"), ("n", "45296.5"), ("s", "[1,2]"), (None, None), ("s", "nan"), ("n", "1")]


def test_parts_follow_query_order_and_sheet_limit(spark, tmp_path):
    df = spark.range(0, 5000, 1, 5).select((5000 - F.col("id")).alias("n")).orderBy("n")
    parts = export_workbook(df, str(tmp_path / "out"), max_rows=300).orderBy("part").collect()
    assert sum(p["rows"] for p in parts) == 5000 and max(p["rows"] for p in parts) <= 300
    rows = scan_rows(workbook_files(spark, str(tmp_path / "out")), ["n"]).select(
        F.element_at(F.split("path", "/"), -1).alias("part"), "row_number",
        F.col("cells.n.text").cast("int").alias("n"))
    by_part = [r["n"] for r in sorted(rows.collect(), key=lambda r: (r["part"], r["row_number"]))]
    assert by_part == list(range(1, 5001))


def test_overwrite_replaces_old_parts(spark, tmp_path):
    out = tmp_path / "out"
    export_workbook(spark.range(0, 100, 1, 4), str(out))
    export_workbook(spark.range(0, 10, 1, 1), str(out))
    assert sorted(p.name[:17] for p in out.rglob("*") if p.is_file()) == ["manifest.json", "part-0000000-0000"]
    assert scan_rows(workbook_files(spark, str(out)), ["id"]).count() == 10


def test_append_keeps_old_parts(spark, tmp_path):
    out = str(tmp_path / "out")
    export_workbook(spark.range(0, 10, 1, 2), out)
    spark.range(10, 30, 1, 2).write.format("workbook").mode("append").save(out)
    assert scan_rows(workbook_files(spark, out), ["id"]).count() == 30
    assert spark.read.json(out + "/manifest.json").agg(F.sum("rows")).first()[0] == 30


def test_failed_export_leaves_nothing(spark, tmp_path):
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") < 99, F.col("id")).otherwise(
        F.raise_error(F.lit("stop")).cast("bigint")).alias("n"))
    with pytest.raises(Exception, match="stop"):
        export_workbook(bad, str(tmp_path / "out"))
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]


def test_failed_export_keeps_the_earlier_one(spark, tmp_path):
    from sheetlake.sources.workbook_writer import exported_files

    out = str(tmp_path / "out")
    export_workbook(spark.range(0, 10, 1, 2), out)
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") < 99, F.col("id")).otherwise(
        F.raise_error(F.lit("stop")).cast("bigint")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        export_workbook(bad, out)
    assert scan_rows(exported_files(spark, out), ["id"]).count() == 10


def test_parts_are_read_back_by_several_tasks(spark, tmp_path):
    from sheetlake.sources.workbook_writer import exported_files

    out = str(tmp_path / "out")
    export_workbook(spark.range(0, 120, 1, 2), out, max_rows=10)
    files = exported_files(spark, out)
    each = [r[0] for r in files.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(each) == 12 and max(each) <= 3
    assert scan_rows(files, ["id"]).count() == 120


def test_template_and_empty_result_have_a_header(spark, tmp_path):
    df = spark.createDataFrame([("x", 1)], "name string, value int")
    assert [m["rows"] for m in template_workbook(df, str(tmp_path / "t")).collect()] == [0]
    headers = scan_headers(workbook_files(spark, str(tmp_path / "t"))).first()["headers"]
    assert [h["header"] for h in headers] == ["name", "value"]
    assert scan_rows(workbook_files(spark, str(tmp_path / "t")), ["name"]).count() == 0


def test_large_sheet_spans_batches(spark, tmp_path):
    simple_book(tmp_path / "big.xlsx", [["n"]] + [[i] for i in range(10000)])
    rows = scan_rows(workbook_files(spark, str(tmp_path)), ["n"])
    got = rows.agg(F.count("*"), F.sum(F.col("cells.n.text").cast("int")), F.max("ordinal")).first()
    assert tuple(got) == (10000, sum(range(10000)), 10000)
