"""Running SQL, previews and named queries."""

import pytest

from sheetlake.operators.query import (
    named_query, preview, preview_limit, preview_rows, preview_status, run_sql, save_query)
from sheetlake.plans import all_queries
from sheetlake.sources.tables import scan_table, split_table_name


@pytest.mark.parametrize("text", ["", "   ", None])
def test_empty_text_is_refused(spark, text):
    with pytest.raises(ValueError, match="Query is required"):
        run_sql(spark, text)


def test_fields_of_an_empty_result(spark):
    df = run_sql(spark, "SELECT 1 AS a, 'x' AS b WHERE false;")
    assert df.columns == ["a", "b"] and preview_rows(df) == ([], False)


def test_duplicate_names_are_kept(spark):
    assert run_sql(spark, "SELECT 1 AS a, 2 AS a").columns == ["a", "a"]


@pytest.mark.parametrize("rows,limit,count,reached", [(5, 10, 5, False), (10, 10, 10, False), (11, 10, 10, True), (0, 10, 0, False)])
def test_preview_edge(spark, rows, limit, count, reached):
    df = spark.range(rows)
    assert tuple(preview_status(df, limit).first()) == (count, reached)
    shown, more = preview_rows(df, limit)
    assert (len(shown), more) == (count, reached)
    assert preview(df, limit).count() == count


def test_preview_limit_setting(monkeypatch):
    monkeypatch.delenv("QUERY_PREVIEW_LIMIT", raising=False)
    assert preview_limit() == 1000
    monkeypatch.setenv("QUERY_PREVIEW_LIMIT", "25")
    assert preview_limit() == 25


def test_database_holds_for_one_query(spark, name):
    spark.sql(f"CREATE DATABASE {name}")
    spark.sql(f"CREATE TABLE {name}.inside USING parquet AS SELECT 5 AS v")
    before = spark.catalog.currentDatabase()
    assert run_sql(spark, "SELECT v FROM inside", database=name).first()["v"] == 5
    assert spark.catalog.currentDatabase() == before
    assert scan_table(spark, f"{name}.inside").first()["v"] == 5


def test_named_query_is_read_by_name_and_composes(spark, name):
    spark.range(10).write.saveAsTable(name)
    save_query(spark, f"{name}_even", f"SELECT id FROM {name} WHERE id % 2 = 0;")
    assert named_query(spark, f"{name}_even").count() == 5
    save_query(spark, f"{name}_even", f"SELECT id FROM {name} WHERE id % 5 = 0")
    assert run_sql(spark, f"SELECT count(*) AS n FROM {name}_even WHERE id > 0").first()["n"] == 1
    for bad in (("", "SELECT 1"), ("x", " ")):
        with pytest.raises(ValueError, match="Name and query are required"):
            save_query(spark, *bad)


def test_table_names_split_at_the_first_dot():
    assert split_table_name(" orders ") == (None, "orders")
    assert split_table_name("sales.orders") == ("sales", "orders")
    assert split_table_name("sales.a.b") == ("sales", "a.b")


def test_preview_does_not_sort_everything(spark):
    plan = all_queries()["sql_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
