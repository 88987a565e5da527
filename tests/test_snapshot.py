"""Snapshot, restore and their refusals."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sheetlake.operators.catalog import TargetColumn, create_table, target_table
from sheetlake.operators.load import load_rows, with_sequence
from sheetlake.operators.snapshot import restore_snapshot, snapshot_diff, take_snapshot
from sheetlake.session import checkpointed, scratch_path
from sheetlake.sources.tables import open_parquet

NOON = datetime(2024, 1, 5, 12, 0, 0)


def loaded(spark, name, run, rows):
    df = spark.createDataFrame([(i + 2, n, v) for i, (n, v) in enumerate(rows)], "row_number int, name string, doc string")
    return load_rows(spark, name, checkpointed(with_sequence(df)), run)


@pytest.fixture(params=["managed", "external"])
def table(spark, name, request):
    location = scratch_path(spark, "restored") if request.param == "external" else None
    create_table(spark, name, [TargetColumn("name", "TEXT", True), TargetColumn("doc", "JSONB")], location)
    loaded(spark, name, "run_1", [("a", '{"k": 1}'), ("b", None)])
    return name


def contents(spark, name):
    return sorted(tuple(r) for r in spark.table(name).select("id", "name", F.to_json("doc"), "load_run").collect())


def test_restore_brings_back_rows_runs_and_specification(spark, table, tmp_path):
    before, spec = contents(spark, table), target_table(spark, table)
    made = take_snapshot(spark, [table], str(tmp_path), NOON)
    assert made == "backup_20240105_120000"
    loaded(spark, table, "run_2", [("c", "[]")])
    assert len(contents(spark, table)) == 3
    assert restore_snapshot(spark, made, made, str(tmp_path)) == [table]
    assert contents(spark, table) == before
    assert target_table(spark, table).columns == spec.columns
    loaded(spark, table, "run_3", [("d", None)])
    ids = [r[0] for r in contents(spark, table)]
    assert len(set(ids)) == len(ids) == 3


def test_restore_of_a_dropped_table(spark, tmp_path, name):
    spark.range(5).write.saveAsTable(name)
    made = take_snapshot(spark, [name], str(tmp_path), NOON)
    spark.sql(f"DROP TABLE {name}")
    restore_snapshot(spark, made, "RESTORE", str(tmp_path))
    assert spark.table(name).count() == 5


@pytest.mark.parametrize("file,token,message", [
    ("../backup_20240105_120000", "RESTORE", "not found or invalid"),
    ("backup_2024", "RESTORE", "not found or invalid"),
    ("backup_20240105_120000", " ", "Confirmation token required"),
    ("backup_20240105_120000", "restore", "Invalid confirmation token"),
])
def test_refusals(spark, tmp_path, file, token, message):
    with pytest.raises(ValueError, match=message):
        restore_snapshot(spark, file, token, str(tmp_path))


def test_snapshot_without_manifest_or_with_lost_rows_is_refused(spark, table, tmp_path):
    before = contents(spark, table)
    made = take_snapshot(spark, [table], str(tmp_path), NOON)
    folder = tmp_path / made / table
    spark.createDataFrame([], spark.read.parquet(str(folder)).schema).write.mode("overwrite").parquet(str(folder))
    with pytest.raises(RuntimeError, match="does not match"):
        restore_snapshot(spark, made, "RESTORE", str(tmp_path))
    os.rename(tmp_path / made / "manifest", tmp_path / made / "_gone")
    with pytest.raises(Exception):
        restore_snapshot(spark, made, "RESTORE", str(tmp_path))
    assert contents(spark, table) == before


def test_diff_sees_one_changed_value(spark):
    orders = open_parquet(spark, "/root/testdata/sf0.001", "orders")
    changed = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 7, 0.0).otherwise(F.col("o_totalprice")))
    assert snapshot_diff(orders, orders.repartition(5)).first()["identical"]
    assert not snapshot_diff(orders, changed).first()["identical"]
    assert not snapshot_diff(orders, orders.where("o_orderkey > 0")).first()["identical"]
