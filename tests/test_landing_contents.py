"""The landing folder goes by contents: replaced files, renamed copies, old files, dropped runs."""

import os
import shutil
import time

from books import simple_book

from sheetlake.operators.catalog import RUN_COLUMN, TargetColumn, create_table
from sheetlake.operators.load import drop_run
from sheetlake.streaming.landing import import_landing

COLUMNS = [TargetColumn("name", "TEXT", True), TargetColumn("value", "INTEGER")]


def book(path, *rows):
    simple_book(path, [["name", "value"], *rows])


def landed(spark, folder, name, checkpoint, **options):
    seen = []
    import_landing(spark, str(folder), name, str(checkpoint), on_report=lambda r: seen.append(
        sorted(os.path.basename(x["path"]) for x in r.runs.collect())), **options).awaitTermination()
    return seen, sorted(r["name"] for r in spark.table(name).collect())


def test_replaced_old_and_copied_files(spark, tmp_path, name):
    create_table(spark, name, COLUMNS)
    folder, checkpoint = tmp_path / "in", tmp_path / "checkpoint"
    folder.mkdir()
    book(folder / "a.xlsx", ["first", 1])
    book(folder / "b.xlsx", ["second", 2])
    assert landed(spark, folder, name, checkpoint) == ([["a.xlsx", "b.xlsx"]], ["first", "second"])
    assert landed(spark, folder, name, checkpoint)[0] == []
    shutil.copy(folder / "a.xlsx", folder / "copy.xlsx")
    time.sleep(0.01)
    book(folder / "b.xlsx", ["corrected", 3])
    book(folder / "old.xlsx", ["old", 4])
    month = time.time() - 30 * 86400
    os.utime(folder / "old.xlsx", (month, month))
    assert landed(spark, folder, name, checkpoint) == ([["b.xlsx", "old.xlsx"]], ["corrected", "first", "old", "second"])
    os.utime(folder / "a.xlsx")  # touched, with the same content
    assert landed(spark, folder, name, checkpoint)[1] == ["corrected", "first", "old", "second"]


def test_same_content_twice_in_one_batch_and_in_two_folders(spark, tmp_path, name):
    create_table(spark, name, COLUMNS)
    book(tmp_path / "only.xlsx", ["only", 1])
    for place in ("x", "y"):
        (tmp_path / place).mkdir()
        for copy in ("a.xlsx", "b.xlsx"):
            shutil.copy(tmp_path / "only.xlsx", tmp_path / place / copy)
        assert landed(spark, tmp_path / place, name, tmp_path / f"checkpoint-{place}")[1] == ["only"]


def test_rejected_and_dropped_contents_come_again(spark, tmp_path, name):
    create_table(spark, name, COLUMNS)
    folder, checkpoint = tmp_path / "in", tmp_path / "checkpoint"
    folder.mkdir()
    book(folder / "bad.xlsx", ["n", "x"])
    book(folder / "good.xlsx", ["good", 1])
    assert landed(spark, folder, name, checkpoint)[1] == ["good"]
    shutil.copy(folder / "bad.xlsx", folder / "bad again.xlsx")
    assert landed(spark, folder, name, checkpoint)[0] == [["bad again.xlsx"]]
    run = spark.table(name).select(RUN_COLUMN).first()[0]
    drop_run(spark, name, run)
    shutil.copy(folder / "good.xlsx", folder / "good again.xlsx")
    assert landed(spark, folder, name, checkpoint) == ([["good again.xlsx"]], ["good"])


def test_batches_of_so_many_files(spark, tmp_path, name):
    create_table(spark, name, COLUMNS)
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(7):
        book(folder / f"{i}.xlsx", [f"n{i}", i])
    seen, names = landed(spark, folder, name, tmp_path / "checkpoint", max_files=3)
    assert sorted(map(len, seen)) == [1, 3, 3] and names == [f"n{i}" for i in range(7)]


def test_empty_folder(spark, tmp_path, name):
    create_table(spark, name, COLUMNS)
    (tmp_path / "in").mkdir()
    assert landed(spark, tmp_path / "in", name, tmp_path / "checkpoint") == ([], [])
