"""Registered queries: what spans several tables, sessions or runs, and joins cut by the data."""

from __future__ import annotations

import threading

from pyspark.sql import functions as F

from ..operators import load, snapshot
from ..operators.catalog import RUN_COLUMN
from ..operators.compact import compact_runs, touched_files
from ..operators.imports import import_by_id, import_workbooks
from ..operators.intervals import range_join
from ..operators.quantiles import exact_quantiles
from ..operators.runs import run_log
from ..operators.sketches import table_profile
from ..session import scratch_path
from ..sources.tables import open_parquet
from ..sources.workbook_reader import workbook_files
from .ingest import _sheet_of_orders, _stage, new_load_table
from .registry import registry
from .workbooks import mixed_folder

QUERIES, ORACLES, register = registry()


@register("sql_join_interval", """
SELECT c_custkey, s_suppkey FROM customer JOIN (SELECT s_suppkey, s_acctbal - 20 AS low, s_acctbal + 20 AS high FROM supplier)
  ON c_acctbal BETWEEN low AND high""")
def sql_join_interval(spark, folder):
    """Customers whose balance is near a supplier's: bins by quantiles of the balances, small ones so that there are many."""
    points = open_parquet(spark, folder, "customer").select("c_custkey", "c_acctbal")
    intervals = open_parquet(spark, folder, "supplier").selectExpr("s_suppkey", "s_acctbal - 20 AS low", "s_acctbal + 20 AS high")
    return range_join(points, intervals, "c_acctbal", "low", "high", per_bin=500).select("c_custkey", "s_suppkey")


@register("exact_percentiles", """
SELECT l_returnflag, share, CAST(price AS DECIMAL(18,6)) AS price FROM (
    SELECT l_returnflag, unnest([0.0, 0.01, 0.5, 0.95, 1.0]) AS share,
           unnest(quantile_cont(l_extendedprice, [0.0, 0.01, 0.5, 0.95, 1.0])) AS price FROM lineitem GROUP BY l_returnflag)""")
def exact_percentiles(spark, folder):
    """Prices, nearly all of them different, at five ranks of each return flag; narrowed down to 5000 rows and less."""
    found = exact_quantiles(open_parquet(spark, folder, "lineitem"), "l_returnflag", "l_extendedprice",
                            [0.0, 0.01, 0.5, 0.95, 1.0], few_rows=5000)
    return found.select("l_returnflag", F.col("share").cast("decimal(3,2)").alias("share"),
                        F.col("l_extendedprice").cast("decimal(18,6)").alias("price"))


@register("snapshot_where", """
SELECT o_orderkey, CASE WHEN o_orderkey % 1009 = 3 THEN 'missing' WHEN o_orderkey % 1013 = 5 THEN 'changed' END AS difference
FROM orders WHERE o_orderkey % 1009 = 3 OR o_orderkey % 1013 = 5
UNION ALL SELECT -o_orderkey - 1, 'extra' FROM orders WHERE o_orderkey % 1511 = 7""")
def snapshot_where(spark, folder):
    """orders against a written copy with rows left out, changed and added: which keys differ, and how."""
    orders = open_parquet(spark, folder, "orders")
    path = scratch_path(spark, "copy")
    added = orders.where("o_orderkey % 1511 = 7").withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    changed = F.when(F.col("o_orderkey") % 1013 == 5, F.col("o_totalprice") + 0.01).otherwise(F.col("o_totalprice"))
    (orders.where("o_orderkey % 1009 <> 3").withColumn("o_totalprice", changed).unionByName(added).write.parquet(path))
    return snapshot.differing_rows(orders, spark.read.parquet(path), ["o_orderkey"])


@register("run_lookup", """
SELECT 'partial' AS outcome, count(*) AS total_rows, count(*) FILTER (WHERE o_orderstatus = 'F') AS ok_rows,
       count(*) FILTER (WHERE o_orderstatus <> 'F') AS error_rows, count(*) FILTER (WHERE o_orderstatus = 'F') AS published_rows,
       count(*) FILTER (WHERE o_orderstatus = 'O') AS errors_kept FROM orders""")
def run_lookup(spark, folder):
    """A mixed import by its run's id alone: the log's entry, and the errors that are kept."""
    table = new_load_table(spark, "looked_up")
    run = f"run_{table}"
    import_workbooks(workbook_files(spark, mixed_folder(spark, folder)), table, run)
    kept = import_by_id(spark, run).errors().agg(F.count(F.lit(1)).alias("errors_kept"))
    return run_log(spark, run).select("outcome", "total_rows", "ok_rows", "error_rows", "published_rows").withColumn(
        "errors_kept", kept.scalar())


@register("id_two_sessions", """
SELECT count(*) AS row_count, count(*) AS id_count, CAST(1 AS BIGINT) AS first_id, count(*) AS last_id, CAST(2 AS BIGINT) AS runs
FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def id_two_sessions(spark, folder):
    """Two sessions that load one table at the same time; no id is given twice, and none is left out."""
    table = new_load_table(spark, "two_sessions")
    failed = []

    def work(session, status):
        try:
            load.load_rows(session, table, _stage(session, f"session-{status}", _sheet_of_orders(session, folder, status, False)), f"run-{status}")
        except Exception as error:
            failed.append(error)

    workers = [threading.Thread(target=work, args=(spark.newSession(), s)) for s in ("F", "O")]
    for worker in workers:
        worker.start()
    for worker in workers:
        worker.join()
    if failed:
        raise failed[0]
    spark.catalog.refreshTable(table)
    return spark.table(table).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("id").alias("id_count"), F.min("id").alias("first_id"),
        F.max("id").alias("last_id"), F.count_distinct(RUN_COLUMN).alias("runs"))


@register("restore_many", """
SELECT 'first' AS held_by, o_orderkey FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'second', o_orderkey FROM orders WHERE o_orderstatus = 'O'""")
def restore_many(spark, folder):
    """Two tables taken together and changed; the restore stops behind its first swap, and is carried through later."""
    place = scratch_path(spark, "snapshots-many")
    tables = {n: new_load_table(spark, f"many_{n}") for n in ("first", "second")}
    for (name, table), status in zip(tables.items(), "FO"):
        load.load_rows(spark, table, _stage(spark, name, _sheet_of_orders(spark, folder, status, False)), "run-1")
    made = snapshot.take_snapshot(spark, list(tables.values()), place)
    for name, table in tables.items():
        load.load_rows(spark, table, _stage(spark, name, _sheet_of_orders(spark, folder, "P", False)), "run-2")
    ready = snapshot.prepare_restore(spark, made, made, place)
    snapshot.swap_table(spark, *ready[0])  # and here the driver is lost
    snapshot.finish_restores(spark)
    parts = [spark.table(t).select(F.lit(n).alias("held_by"), F.col("o_orderkey").cast("bigint").alias("o_orderkey"))
             for n, t in tables.items()]
    return parts[0].unionByName(parts[1])


@register("profile_runs", """
SELECT 'o_orderkey' AS column_name, count(*) AS row_count, count(*) AS filled, CAST(min(o_orderkey) AS DOUBLE) AS number_low,
       CAST(max(o_orderkey) AS DOUBLE) AS number_high, true AS distinct_near, true AS median_near FROM orders WHERE o_orderstatus IN ('O', 'P')
UNION ALL SELECT 'total', count(*), count(*), CAST(min(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE),
       CAST(max(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE), true, true FROM orders WHERE o_orderstatus IN ('O', 'P')""")
def profile_runs(spark, folder):
    """A profile of two runs, merged from their sketches after one of them was replaced; estimates against the rows."""
    table = new_load_table(spark, "profiled")
    for run, status in (("run-1", "F"), ("run-2", "O")):
        load.load_rows(spark, table, _stage(spark, run, _sheet_of_orders(spark, folder, status, False)), run)
    table_profile(spark, table).collect()
    load.load_rows(spark, table, _stage(spark, "run-1", _sheet_of_orders(spark, folder, "P", False)), "run-1")
    found = table_profile(spark, table).where(F.col("column_name").isin("o_orderkey", "total"))
    rows = spark.table(table).select(F.posexplode(F.array(F.col("o_orderkey").cast("double"), F.col("total").cast("double"))).alias("c", "v"))
    rows = rows.withColumn("column_name", F.when(F.col("c") == 0, "o_orderkey").otherwise("total"))
    marks = F.broadcast(found.select("column_name", F.col("quantiles")[1].alias("median")))  # two rows
    exact = rows.join(marks, "column_name").groupBy("column_name").agg(
        F.count_distinct("v").alias("values"), F.avg(F.when(F.col("v") <= F.col("median"), 1.0).otherwise(0.0)).alias("rank"))
    return found.join(exact, "column_name").select(
        "column_name", "row_count", "filled", "number_low", "number_high",
        (F.abs(F.col("distinct_values") / F.col("values") - 1) < 0.08).alias("distinct_near"),
        F.col("rank").between(0.45, 0.55).alias("median_near"))


@register("compacted_lookup", """
SELECT o_orderstatus AS load_run, count(*) AS row_count, CAST(sum(o_orderkey) AS BIGINT) AS key_sum, true AS few_files FROM orders
WHERE o_orderstatus IN ('F', 'O') AND date_trunc('month', o_orderdate) = TIMESTAMP '1997-03-01' GROUP BY 1""")
def compacted_lookup(spark, folder):
    """One month of two runs after they were clustered by the indexed column: the same rows, out of few files."""
    table = new_load_table(spark, "compacted")
    for status in "FO":
        rows = _sheet_of_orders(spark, folder, status, False).repartition(8)
        load.load_rows(spark, table, _stage(spark, f"compact-{status}", rows), status)
    count = spark.table(table).count()
    compact_runs(spark, table, file_rows=-(-count // 20))
    few = touched_files(spark, table, "placed", "1997-03-15 00:00:00").select((F.col("touched") * 4 <= F.col("files")).alias("few"))
    month = spark.table(table).where("placed >= TIMESTAMP_NTZ'1997-03-01' AND placed < TIMESTAMP_NTZ'1997-04-01'")
    return month.groupBy(RUN_COLUMN).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("o_orderkey").alias("key_sum")).withColumn("few_files", few.scalar())
