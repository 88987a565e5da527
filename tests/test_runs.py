"""Load runs that are repeated, fail half-way, meet in one table, or share its ids."""

import threading

import pytest
from books import simple_book
from pyspark.sql import functions as F

from sheetlake.operators import catalog, imports, load, snapshot
from sheetlake.operators.catalog import TargetColumn, create_table
from sheetlake.session import checkpointed, shared_dir
from sheetlake.sources.workbook_reader import workbook_files
from sheetlake.streaming.landing import import_landing

COLUMNS = [TargetColumn("name", "TEXT", True), TargetColumn("value", "INTEGER")]


def book(folder, name, rows):
    folder.mkdir(exist_ok=True, parents=True)
    simple_book(folder / f"{name}.xlsx", [["name", "value"], *rows])
    return folder


def names(spark, table):
    return sorted(r["name"] for r in spark.table(table).collect())


def test_two_landing_folders_keep_their_rows(spark, tmp_path, name):
    create_table(spark, name, COLUMNS)
    for folder in ("x", "y"):
        book(tmp_path / folder, "a", [[f"from {folder}", 1]])
        import_landing(spark, str(tmp_path / folder), name, str(tmp_path / f"checkpoint-{folder}")).awaitTermination()
    assert names(spark, name) == ["from x", "from y"]
    assert spark.table(name).select(catalog.RUN_COLUMN).distinct().count() == 2


def test_repeat_with_nothing_good_takes_the_rows_out(spark, tmp_path, name):
    create_table(spark, name, COLUMNS)
    for n, row in enumerate((["first", 1], ["second", "n/a"], ["third", 3])):
        report = imports.import_workbooks(workbook_files(spark, str(book(tmp_path / str(n), "a", [row]))), name, "run_1")
        assert report.published_rows == (0 if n == 1 else 1)
        assert names(spark, name) == ([] if n == 1 else [row[0]])


def test_failing_repeat_keeps_what_was_published(spark, name):
    create_table(spark, name, COLUMNS)
    good = spark.sql("SELECT 1L AS id, 'kept' AS name, 1 AS value")
    load.publish_rows(spark, name, good, "run_1")
    broken = spark.sql("SELECT id, CAST(raise_error('lost') AS STRING) AS name, 1 AS value FROM range(10)")
    with pytest.raises(Exception, match="lost"):
        load.publish_rows(spark, name, broken, "run_1")
    assert names(spark, name) == ["kept"]
    load.publish_rows(spark, name, good.withColumn("name", F.lit("new")), "run_1")
    assert names(spark, name) == ["new"]
    load.drop_run(spark, name, "run_1")
    load.drop_run(spark, name, "run_1")
    assert names(spark, name) == []


def test_stores_of_equal_table_names_stay_apart(spark, tmp_path, name):
    other = f"db_{name}"
    spark.sql(f"CREATE DATABASE {other} LOCATION '{tmp_path}/db'")
    reports = {}
    for table in (name, f"{other}.{name}"):
        create_table(spark, table, COLUMNS)
        folder = book(tmp_path / table, "a", [[f"row of {table}", 1], ["bad", "x"]])
        reports[table] = imports.import_workbooks(workbook_files(spark, str(folder)), table, "run_1")
    for table, report in reports.items():
        assert [r.error_rows for r in report.runs.collect()] == [1] and report.raw.count() == 2
        again = imports.import_run(spark, table, "run_1")
        assert again.runs.collect() == report.runs.collect() and again.raw.count() == 2
        assert [r.field for r in again.errors().collect()] == ["value"]
    with pytest.raises(ValueError, match="Invalid run id"):
        imports.import_workbooks(workbook_files(spark, str(tmp_path / name)), name, "../run")
    with pytest.raises(ValueError, match="Invalid run id"):
        imports.import_run(spark, name, "a/b")


def sheet(spark, ids):
    rows = [(i + 2, None if v is None else str(v), f"n{i}", "1") for i, v in enumerate(ids)]
    df = spark.createDataFrame(rows, "row_number int, id string, name string, value string").coalesce(1)
    return checkpointed(load.with_sequence(df))


def test_repeated_and_used_ids_are_row_errors(spark, name):
    create_table(spark, name, COLUMNS)
    assert load.load_rows(spark, name, sheet(spark, [7, 8]), "run_1").published
    assert load.load_rows(spark, name, sheet(spark, [7, 8, 9]), "run_1").published  # its own earlier ids do not count
    for ids, bad in (([5, 5, 5], 2), ([9, 10], 1), ([11, 12, 8, 11], 2)):
        result = load.load_rows(spark, name, sheet(spark, ids), "run_2")
        assert (result.published, result.error_rows) == (False, bad)
    assert load.load_rows(spark, name, sheet(spark, [20, 21]), "run_2").published
    no_ids = sheet(spark, [None] * 3).drop("id")
    assert load.load_rows(spark, name, no_ids, "run_3").published
    ids = sorted(r["id"] for r in spark.table(name).collect())
    assert len(ids) == len(set(ids)) == 8 and ids[:5] == [7, 8, 9, 20, 21] and min(ids[5:]) > 21


def test_loads_at_a_time_never_share_an_id(spark, name):
    create_table(spark, name, COLUMNS)
    starts = []
    workers = [threading.Thread(target=lambda: starts.append(catalog.reserve_ids(spark, name, 10))) for _ in range(8)]
    for w in workers:
        w.start()
    for w in workers:
        w.join()
    assert sorted(starts) == list(range(0, 80, 10))


def test_dropped_table_comes_back_with_its_specification(spark, tmp_path, name):
    made = create_table(spark, name, [*COLUMNS, TargetColumn("channel", "TEXT", False, "'sheet'", True)])
    raw = sheet(spark, [None, None]).drop("id")
    load.load_rows(spark, name, raw, "run_1")
    before = spark.table(name).collect()
    taken = snapshot.take_snapshot(spark, [name], str(tmp_path))
    spark.sql(f"DROP TABLE {name}")
    assert snapshot.restore_snapshot(spark, taken, "RESTORE", str(tmp_path)) == [name]
    again = catalog.target_table(spark, name)
    assert again.columns == made.columns and again.by_run and again.indexed == ("channel",)
    assert sorted(spark.table(name).collect()) == sorted(before)
    load.load_rows(spark, name, raw, "run_2")
    load.load_rows(spark, name, raw, "run_1")
    assert sorted(r["id"] for r in spark.table(name).collect()) == [3, 4, 5, 6]


def test_imports_leave_only_what_is_read_again(spark, tmp_path, name):
    import os

    create_table(spark, name, COLUMNS)
    imports.import_workbooks(workbook_files(spark, str(book(tmp_path / "in", "a", [["x", 1]]))), name, "run_1")
    store = imports.store_path(spark, name, "run_1").replace("file://", "")
    assert store.startswith(shared_dir(spark).replace("file://", ""))
    assert sorted(os.listdir(store)) == ["headers", "raw", "rejected", "runs"]
