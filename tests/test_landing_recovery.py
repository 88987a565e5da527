"""A landing batch that fails after publishing is repeated without doubling rows."""

import pytest
from books import simple_book
from pyspark.errors import StreamingQueryException

from sheetlake.operators.catalog import TargetColumn, create_table
from sheetlake.operators.load import publish_rows
from sheetlake.streaming.landing import import_landing


def test_failed_batch_is_repeated_once(spark, tmp_path, name):
    create_table(spark, name, [TargetColumn("name", "TEXT")])
    folder, checkpoint = tmp_path / "in", str(tmp_path / "checkpoint")
    folder.mkdir()
    for i in range(4):
        simple_book(folder / f"{i}.xlsx", [["name"], [f"n{i}"]])

    def stop(report):
        raise RuntimeError("driver lost")

    with pytest.raises(StreamingQueryException):
        import_landing(spark, str(folder), name, checkpoint, on_report=stop).awaitTermination()
    assert spark.table(name).count() == 4  # published, but the stream does not know it
    import_landing(spark, str(folder), name, checkpoint).awaitTermination()
    assert sorted(r["name"] for r in spark.table(name).collect()) == ["n0", "n1", "n2", "n3"]


def test_run_ids_are_plain(spark, name):
    create_table(spark, name, [TargetColumn("name", "TEXT")])
    with pytest.raises(ValueError, match="Invalid run id"):
        publish_rows(spark, name, spark.sql("SELECT 1L AS id, 'x' AS name"), "a' OR '1")
