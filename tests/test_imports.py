"""Loads and workbook imports end to end."""

import pytest
from books import simple_book
from pyspark.sql import functions as F

from sheetlake.operators.catalog import TargetColumn, create_table, target_table
from sheetlake.operators.imports import import_workbooks
from sheetlake.operators.load import assign_ids, load_rows, with_sequence
from sheetlake.operators.query import run_sql
from sheetlake.session import checkpointed, scratch_path
from sheetlake.sources.workbook_reader import workbook_files
from sheetlake.sources.workbook_writer import export_workbook
from sheetlake.streaming.landing import import_landing

COLUMNS = [TargetColumn("name", "TEXT"), TargetColumn("value", "INTEGER")]


def outcomes(report):
    return {r["path"].rsplit("/", 1)[1]: r["outcome"] for r in report.runs.collect()}


def test_small_sheet_end_to_end(spark, tmp_path, name):
    create_table(spark, name, COLUMNS)
    simple_book(tmp_path / "in.xlsx", [["name", "value"], ["Alice", 100], ["Bob", 200]])
    report = import_workbooks(workbook_files(spark, str(tmp_path)), name, "run_1")
    run = report.runs.first()
    assert (run["total_rows"], run["ok_rows"], run["error_rows"], run["outcome"]) == (2, 2, 0, "success")
    rows = run_sql(spark, f"SELECT id, name, value FROM {name} ORDER BY value;").collect()
    assert [tuple(r) for r in rows] == [(1, "Alice", 100), (2, "Bob", 200)]
    manifest = export_workbook(spark.table(name), str(tmp_path / "out")).first()
    assert manifest["rows"] == 2 and manifest["bytes"] >= 100


def test_bad_row_rejects_its_sheet_only(spark, tmp_path, name):
    create_table(spark, name, COLUMNS)
    simple_book(tmp_path / "a.xlsx", [["name", "value"], ["x", 1], ["y", "many"], ["z", 3.5]])
    simple_book(tmp_path / "b.xlsx", [["value", "name"], [5, " ok "], [None, None], [7.0, ""]])
    simple_book(tmp_path / "c.xlsx", [["name", "Value"], ["x", 1]])
    (tmp_path / "d.xlsx").write_bytes(b"junk")
    report = import_workbooks(workbook_files(spark, str(tmp_path)), name, "run_1")
    assert outcomes(report) == {"a.xlsx": "rejected", "b.xlsx": "success", "c.xlsx": "header_mismatch", "d.xlsx": "failure"}
    assert report.published_rows == 3
    rows = spark.table(name).orderBy("id").select("name", "value").collect()
    assert [tuple(r) for r in rows] == [("ok", 5), (None, None), (None, 7)]
    errors = report.errors().orderBy("row_number").select("row_number", "field", "error").collect()
    assert [tuple(e) for e in errors] == [
        (3, "value", 'invalid input syntax for type integer: "many"'),
        (4, "value", 'invalid input syntax for type integer: "3.5"')]
    mismatch = report.runs.where("outcome = 'header_mismatch'").first()
    assert mismatch["extra"] == ["Value"] and mismatch["expected"] == ["id", "name", "value"]


def test_first_bad_batch_is_reported_apart(spark, tmp_path, name):
    create_table(spark, name, COLUMNS)
    rows = [["name", "value"]] + [["n", "bad" if i in (1500, 1999, 2500) else i] for i in range(3000)]
    simple_book(tmp_path / "in.xlsx", rows)
    report = import_workbooks(workbook_files(spark, str(tmp_path)), name, "run_1")
    assert report.errors().count() == 3
    first = report.first_errors().orderBy("row_number").collect()
    assert [(r["row_number"], r["batch"]) for r in first] == [(1502, 1), (2001, 1)]


def test_file_damaged_behind_its_header_is_refused_whole(spark, tmp_path, name):
    from books import write_book

    create_table(spark, name, COLUMNS)
    row = '<row r="{0}"><c r="A{0}" t="inlineStr"><is><t>x</t></is></c></row>'
    head = '<row r="1"><c r="A1" t="inlineStr"><is><t>name</t></is></c></row>'
    write_book(tmp_path / "cut.xlsx", [("S", head + "".join(row.format(i) for i in range(2, 60000)) + "<row><c")])
    simple_book(tmp_path / "good.xlsx", [["name"], ["y"]])
    report = import_workbooks(workbook_files(spark, str(tmp_path)), name, "run_1")
    assert outcomes(report) == {"cut.xlsx": "failure", "good.xlsx": "success"}
    assert [r["name"] for r in spark.table(name).collect()] == ["y"]


def test_defaults_required_and_given_ids(spark, tmp_path, name):
    create_table(spark, name, [TargetColumn("name", "TEXT", True), TargetColumn("kind", "TEXT", True, "'plain'"),
                               TargetColumn("at", "TIMESTAMP"), TargetColumn("doc", "JSONB")])
    simple_book(tmp_path / "a.xlsx", [["name", "id", "at", "doc"], ["x", 500, 45292.5, "{}"], ["y", 501, None, None]])
    simple_book(tmp_path / "b.xlsx", [["name", "kind"], ["x", None]])
    simple_book(tmp_path / "c.xlsx", [["kind"], ["x"]])
    report = import_workbooks(workbook_files(spark, str(tmp_path)), name, "run_1")
    assert outcomes(report) == {"a.xlsx": "success", "b.xlsx": "rejected", "c.xlsx": "header_mismatch"}
    rows = spark.table(name).orderBy("id").select("id", "name", "kind", F.col("at").cast("string"), F.to_json("doc")).collect()
    assert [tuple(r) for r in rows] == [(500, "x", "plain", "2024-01-01 12:00:00", "{}"), (501, "y", "plain", None, None)]
    assert report.errors().first()["error"] == f'null value in column "kind" of relation "{name}" violates not-null constraint'


def test_repeated_run_replaces_itself(spark, tmp_path, name):
    create_table(spark, name, COLUMNS)
    simple_book(tmp_path / "in.xlsx", [["name", "value"], ["a", 1], ["b", 2]])
    files = workbook_files(spark, str(tmp_path))
    for _ in range(2):
        import_workbooks(files, name, "run_1")
    assert spark.table(name).count() == 2
    import_workbooks(files, name, "run_2")
    ids = [r["id"] for r in spark.table(name).select("id").collect()]
    assert len(ids) == len(set(ids)) == 4


def test_landing_folder_takes_each_file_once(spark, tmp_path, name):
    create_table(spark, name, COLUMNS)
    folder, checkpoint = tmp_path / "in", str(tmp_path / "checkpoint")
    folder.mkdir()
    simple_book(folder / "a.xlsx", [["name", "value"], ["a", 1]])
    simple_book(folder / "b.xlsx", [["name", "value"], ["b", "x"]])
    seen = []
    for extra in ("c", "d"):
        import_landing(spark, str(folder), name, checkpoint, on_report=lambda r: seen.append(outcomes(r))).awaitTermination()
        simple_book(folder / f"{extra}.xlsx", [["name", "value"], [extra, 2]])
    import_landing(spark, str(folder), name, checkpoint, on_report=lambda r: seen.append(outcomes(r))).awaitTermination()
    assert seen == [{"a.xlsx": "success", "b.xlsx": "rejected"}, {"c.xlsx": "success"}, {"d.xlsx": "success"}]
    assert sorted(r["name"] for r in spark.table(name).collect()) == ["a", "c", "d"]


def test_failed_load_publishes_nothing(spark, name):
    create_table(spark, name, COLUMNS)
    rows = spark.range(0, 5000, 1, 4).select(
        (F.col("id") + 2).alias("row_number"), F.lit("n").alias("name"),
        F.when(F.col("id") == 4321, "bad").otherwise(F.col("id").cast("string")).alias("value"))
    result = load_rows(spark, name, checkpointed(with_sequence(rows)), "run_1")
    assert result == (False, 5000, 1)
    assert spark.table(name).count() == 0 and target_table(spark, name).next_id == 1


def test_ids_are_dense_and_ordered_with_uneven_partitions(spark):
    rows = spark.range(0, 10000, 1, 3).where("id % 10 < 3 OR id < 4000").select((F.col("id") * 7 % 10007).alias("k"))
    got = assign_ids(rows, ["k"], base=10).orderBy("k").collect()
    assert [r["id"] for r in got] == list(range(11, 11 + len(got)))


def test_indexed_column_gets_bloom_filter_and_order(spark, name):
    import glob

    import pyarrow.parquet as pq

    location = scratch_path(spark, "indexed")
    create_table(spark, name, [TargetColumn("name", "TEXT", indexed=True), TargetColumn("value", "INTEGER")], location)
    rows = spark.range(0, 20000, 1, 4).select(
        (F.col("id") + 2).alias("row_number"), (F.col("id") * 7919 % 20000).cast("string").alias("name"),
        F.lit("1").alias("value"))
    load_rows(spark, name, checkpointed(with_sequence(rows)), "run_1")
    files = glob.glob(location.replace("file:", "") + "/load_run=run_1/*/*.parquet")
    assert files
    for f in files:
        names = pq.read_table(f, columns=["name"]).column("name").to_pylist()
        assert names == sorted(names)
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path("file:" + f)
        source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, jvm.org.apache.hadoop.conf.Configuration())
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        columns = {c.getPath().toDotString(): c for c in reader.getFooter().getBlocks().get(0).getColumns()}
        assert columns["name"].getBloomFilterOffset() > 0 > columns["value"].getBloomFilterOffset()
        reader.close()
    assert spark.table(name).where("name = '77'").count() == 1


def test_create_table_rules(spark, name):
    made = create_table(spark, name, [TargetColumn("id", "TEXT"), TargetColumn("name", "TEXT"), TargetColumn("n", "NUMERIC")])
    assert [c.name for c in made.columns] == ["id", "name", "n"] and made.columns[0].data_type == "SERIAL"
    with pytest.raises(ValueError, match="Table already exists"):
        create_table(spark, name, COLUMNS)
    for table, columns, message in (
            ("1abc", COLUMNS, "Invalid table name"), ("a" * 64, COLUMNS, "Invalid table name"),
            (name + "x", [], "at least one column"), (name + "x", [TargetColumn("a b")], "Invalid column name"),
            (name + "x", [TargetColumn("a", "FLOAT")], "Unknown column type")):
        with pytest.raises(ValueError, match=message):
            create_table(spark, table, columns)


def test_table_made_elsewhere(spark, tmp_path, name):
    spark.sql(f"CREATE TABLE {name} (n BIGINT, price DECIMAL(10,2), ratio DOUBLE, at TIMESTAMP_NTZ, "
              "note STRING DEFAULT 'none', small SMALLINT) USING parquet")
    simple_book(tmp_path / "a.xlsx", [["n", "price", "ratio", "at"], [2**40, 1.25, 0.5, 45292], [1, None, "1e3", "1/5/2024"]])
    simple_book(tmp_path / "b.xlsx", [["small"], [40000], ["5d"]])
    report = import_workbooks(workbook_files(spark, str(tmp_path)), name, "run_1")
    assert outcomes(report) == {"a.xlsx": "success", "b.xlsx": "rejected"}
    rows = spark.table(name).orderBy("n").select(*[F.col(c).cast("string") for c in ("n", "price", "ratio", "at", "note")])
    assert [tuple(r) for r in rows.collect()] == [
        ("1", None, "1000.0", "2024-01-05 00:00:00", "none"),
        (str(2**40), "1.25", "0.5", "2024-01-01 00:00:00", "none")]
    assert [r["error"] for r in report.errors().orderBy("row_number").collect()] == [
        'value "40000" is out of range for type integer', 'invalid input syntax for type integer: "5d"']


def test_numeric_cells_take_their_shortest_form(spark):
    from sheetlake.operators.catalog import TargetTable
    from sheetlake.operators.load import coerce_rows

    shown = {"100": "100", "100.0": "100", "1E2": "100", "1.1000000000000001": "1.1", "-0": "0", "0.5": "0.5", "1.50": "1.5",
             "0.0000001": "1e-7", "0.000001": "0.000001", "-12.25": "-12.25", "1000000000000000000.0": "1000000000000000000",
             "999999999999999": "999999999999999", "0.1234567890123456": "0.1234567890123456", "1e21": "1e+21"}
    df = spark.createDataFrame([(i, ("n", t)) for i, t in enumerate(shown)], "row_number int, c struct<kind:string,text:string>")
    got = coerce_rows(df, TargetTable("t", (TargetColumn("c"),))).orderBy("row_number").collect()
    assert [r["c"] for r in got] == list(shown.values())


def test_column_names_that_look_like_ours(spark, tmp_path, name):
    names = ["path", "sheet", "row_number", "seq", "errors", "row", "value", "value_value", "absent_value", "next_id"]
    create_table(spark, name, [TargetColumn(n, "INTEGER" if n.startswith("value") else "TEXT", indexed=n == "path")
                               for n in names])
    simple_book(tmp_path / "a.xlsx", [names, ["p", "s", "r", "q", "e", "w", 1, 2, "a", "n"]])
    simple_book(tmp_path / "b.xlsx", [names, ["p", "s", "r", "q", "e", "w", "x", 2, "a", "n"]])
    report = import_workbooks(workbook_files(spark, str(tmp_path)), name, "run_1")
    assert outcomes(report) == {"a.xlsx": "success", "b.xlsx": "rejected"}
    assert tuple(spark.table(name).first())[1:-1] == ("p", "s", "r", "q", "e", "w", 1, 2, "a", "n")
    assert [(e["field"], e["row_number"]) for e in report.first_errors().collect()] == [("value", 2)]
