"""Registered queries: running SQL, previews, named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import query
from ..sources.tables import register_views
from .registry import registry

QUERIES, ORACLES, register = registry()

_REVENUE = """
SELECT l_returnflag, l_linestatus, count(*) AS line_count,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS base_price
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"""
_REVENUE_SPARK = _REVENUE.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")
_LINES = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem"
_ORDERED = _LINES + " ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate"
_LIMIT = 1000


@register("sql_run", _REVENUE)
def sql_run(spark, folder):
    register_views(spark, folder, ["lineitem"])
    return query.run_sql(spark, _REVENUE_SPARK + ";")


@register("preview_rows", f"{_ORDERED} LIMIT {_LIMIT}")
def preview_rows(spark, folder):
    register_views(spark, folder, ["lineitem"])
    return query.preview(query.run_sql(spark, _ORDERED), _LIMIT)


@register("preview_status", f"""
SELECT least(count(*), {_LIMIT}) AS row_count, count(*) > {_LIMIT} AS limit_reached FROM ({_LINES})""")
def preview_status(spark, folder):
    register_views(spark, folder, ["lineitem"])
    return query.preview_status(query.run_sql(spark, _LINES), _LIMIT)


@register("named_query", f"""
SELECT l_returnflag, CAST(sum(line_count) AS BIGINT) AS line_count, CAST(sum(base_price) AS DECIMAL(38,2)) AS base_price
FROM ({_REVENUE}) GROUP BY l_returnflag""")
def named_query(spark, folder):
    register_views(spark, folder, ["lineitem"])
    query.save_query(spark, "revenue_by_status", _REVENUE_SPARK, temporary=True)
    return query.named_query(spark, "revenue_by_status").groupBy("l_returnflag").agg(
        F.sum("line_count").alias("line_count"), F.sum("base_price").cast("decimal(38,2)").alias("base_price"))
