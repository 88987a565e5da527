"""Registered queries: keys, hashes, curated tables, reports, snapshots."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..functions.keys import business_key, row_hash
from ..operators import curated, load, runs, snapshot
from ..session import scratch_path
from ..sources.tables import open_parquet
from . import fixtures as fx
from .registry import registry

QUERIES, ORACLES, register = registry()

register("business_key", f"""
WITH raw_orders AS ({fx.RAW_ORDERS_DUCK})
SELECT row_number, {fx.duck_blank('customer_raw')} || '|' || {fx.duck_blank('flag_raw')} || '|' || row_number
       AS business_key FROM raw_orders""")(
    lambda spark, folder: (lambda raw: raw.select(
        "row_number", business_key(raw, ["customer_raw", "flag_raw", "row_number"]).alias("business_key")))(
        fx.raw_orders(spark, folder)))

register("row_hash", """
SELECT o_orderkey, sha256(json_object(
    'o_custkey', o_custkey,
    'o_orderdate', strftime(o_orderdate, '%Y-%m-%dT00:00:00.000Z'),
    'o_orderkey', o_orderkey, 'o_orderpriority', o_orderpriority,
    'o_orderstatus', nullif(o_orderstatus, 'P'), 'quoted', 'a "b" \\ ' || o_orderpriority)::VARCHAR) AS row_hash
FROM orders""")(
    lambda spark, folder: (lambda rows: rows.select("o_orderkey", row_hash(rows).alias("row_hash")))(
        open_parquet(spark, folder, "orders").select(
            "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority",
            F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"),
            F.concat(F.lit('a "b" \\ '), "o_orderpriority").alias("quoted"))))

register("raw_rows", f"""
WITH raw_orders AS ({fx.RAW_ORDERS_DUCK})
SELECT 'run-1' AS run_id, row_number, json_object('customer_raw', customer_raw, 'date_raw', date_raw,
       'flag_raw', flag_raw, 'total_raw', total_raw)::VARCHAR AS raw FROM raw_orders""")(
    lambda spark, folder: curated.raw_rows(fx.raw_orders(spark, folder), "run-1"))


def _curated_state(spark, folder):
    """Curated orders by customer and priority, and an import that repeats and changes keys.

    The table holds the newest non-pending order per key, the import all orders.
    """
    orders = open_parquet(spark, folder, "orders")
    rows = orders.select(
        "o_orderkey", "o_orderstatus", "o_orderdate",
        business_key(orders, ["o_custkey", "o_orderpriority"]).alias("business_key"))
    rows = rows.withColumn("row_hash", row_hash(rows, ["o_orderstatus", "o_orderdate", "business_key"]))
    current = curated.newest_per_key(
        rows.where("o_orderstatus <> 'P'"), "business_key", "o_orderkey").select(*rows.columns)
    return current, rows


_CURATED = """
rows AS (SELECT o_orderkey, o_orderstatus, o_orderdate, o_custkey || '|' || o_orderpriority AS business_key
         FROM orders),
hashed AS (SELECT *, sha256(json_object('business_key', business_key,
           'o_orderdate', strftime(o_orderdate, '%Y-%m-%dT00:00:00.000Z'),
           'o_orderstatus', o_orderstatus)::VARCHAR) AS row_hash FROM rows),
current AS (SELECT * FROM hashed WHERE o_orderstatus <> 'P'
            QUALIFY row_number() OVER (PARTITION BY business_key ORDER BY o_orderkey DESC) = 1)"""

register("upsert_classify", f"""
WITH {_CURATED}
SELECT h.o_orderkey, h.business_key,
       CASE WHEN c.row_hash IS NULL THEN 'new' WHEN c.row_hash = h.row_hash THEN 'unchanged' ELSE 'changed' END AS change
FROM hashed h LEFT JOIN current c USING (business_key)""")(
    lambda spark, folder: (lambda current, rows: curated.classify_changes(
        rows, current, "business_key", "row_hash").select("o_orderkey", "business_key", "change"))(
        *_curated_state(spark, folder)))

register("upsert_result", f"""
WITH {_CURATED},
incoming AS (SELECT * FROM hashed
             QUALIFY row_number() OVER (PARTITION BY business_key ORDER BY o_orderkey DESC) = 1)
SELECT * FROM incoming UNION ALL
SELECT * FROM current WHERE business_key NOT IN (SELECT business_key FROM incoming)""")(
    lambda spark, folder: (lambda current, rows: curated.upsert(
        current, rows, "business_key", "o_orderkey"))(*_curated_state(spark, folder)))

@register("upsert_table", f"""
WITH {_CURATED},
newest AS (SELECT * FROM hashed QUALIFY row_number() OVER (PARTITION BY business_key ORDER BY o_orderkey DESC) = 1)
SELECT * FROM newest""")
def upsert_table(spark, folder):
    """The same import in two halves, each rewriting only the partitions it touches."""
    _, rows = _curated_state(spark, folder)
    path = scratch_path(spark, "curated")
    table = path.rsplit("/", 1)[1].replace("-", "_")
    curated.create_curated(spark, table, "o_orderkey BIGINT, o_orderstatus STRING, o_orderdate TIMESTAMP_NTZ, "
                           "business_key STRING, row_hash STRING", "business_key", 16, path)
    middle = F.lit("1998-06-01").cast("timestamp_ntz")
    newer = F.col("o_orderdate") >= middle
    for part in (rows.where(newer), rows):
        curated.upsert_table(spark, table, part, "o_orderkey")
    return spark.table(table).drop(curated.BUCKET)


# The table holds the newest orders already; older ones that come late, with and without an order, change nothing.
register("upsert_out_of_order", f"""
WITH {_CURATED}
SELECT * FROM hashed QUALIFY row_number() OVER (PARTITION BY business_key ORDER BY o_orderkey DESC) = 1""")(
    lambda spark, folder: _out_of_order(spark, folder))


def _out_of_order(spark, folder):
    _, rows = _curated_state(spark, folder)
    newest = curated.newest_per_key(rows, "business_key", "o_orderkey").select(*rows.columns)
    late = rows.unionByName(rows.withColumn("o_orderkey", F.lit(None).cast("bigint")))
    return curated.upsert(newest, late, "business_key", "o_orderkey")


register("report_missing_related", """
SELECT o.o_orderkey, o.o_custkey FROM orders o
LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON l.l_orderkey = o.o_orderkey WHERE l.l_orderkey IS NULL""")(
    lambda spark, folder: curated.missing_related(
        open_parquet(spark, folder, "orders").select("o_orderkey", "o_custkey"),
        open_parquet(spark, folder, "lineitem"), "o_orderkey", "l_orderkey"))

register("report_duplicate_keys", """
SELECT l_orderkey || '|' || l_linenumber AS business_key, count(*) AS row_count
FROM lineitem GROUP BY 1 HAVING count(*) > 1""")(
    lambda spark, folder: (lambda lines: curated.duplicate_keys(
        lines.select(business_key(lines, ["l_orderkey", "l_linenumber"]).alias("business_key"))))(
        open_parquet(spark, folder, "lineitem")))

register("relationship_join", """
SELECT o.o_orderkey, o.o_custkey, c.c_name, c.c_mktsegment FROM orders o LEFT JOIN customer c
  ON o.o_custkey = c.c_custkey""")(
    lambda spark, folder: curated.join_related(
        open_parquet(spark, folder, "orders").select("o_orderkey", "o_custkey"),
        open_parquet(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment"),
        [("o_custkey", "c_custkey")], "left"))


def _big_orders(spark, folder):
    open_parquet(spark, folder, "orders").createOrReplaceTempView("orders")
    return spark.sql("SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice FROM orders "
                     "WHERE o_totalprice > :floor AND o_orderstatus = :status", args={"floor": 100000, "status": "O"})


register("report_summary", """
SELECT count(*) AS row_count, count(o_totalprice) AS o_totalprice_filled,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS o_totalprice_sum,
       min(CAST(o_totalprice AS DECIMAL(18,2))) AS o_totalprice_min,
       max(CAST(o_totalprice AS DECIMAL(18,2))) AS o_totalprice_max
FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'""")(
    lambda spark, folder: curated.report_summary(_big_orders(spark, folder), ["o_totalprice"]))


@register("import_runs", f"""
WITH {fx.COERCED_ORDERS_DUCK},
runs AS (SELECT c.row_number, CASE WHEN (c.row_number - 2) % 3 = 0 THEN 'run-a' ELSE 'run-b' END AS run_id FROM coerced c),
bad AS (SELECT DISTINCT row_number FROM coerced_errors)
SELECT run_id, count(*) AS total_rows, count(*) - count(bad.row_number) AS ok_rows, count(bad.row_number) AS error_rows,
       CASE WHEN count(bad.row_number) = 0 THEN 'success' ELSE 'rejected' END AS outcome
FROM runs LEFT JOIN bad USING (row_number) GROUP BY run_id""")
def import_runs(spark, folder):
    """Two imports, each with its summary in the log of runs, looked up by their ids."""
    checked = load.coerce_rows(fx.raw_orders(spark, folder), fx.ORDER_TARGET)
    first = (F.col("row_number") - 2) % 3 == 0
    place, started = scratch_path(spark, "logged").rsplit("/", 1)[1], datetime.now(timezone.utc)
    for run_id, part in (("run-a", checked.where(first)), ("run-b", checked.where(~first))):
        found = load.import_summary(part).first().asDict()
        runs.record_run(spark, run_id, place, place, started, **found)
    log = runs.run_log(spark, "run-a").unionByName(runs.run_log(spark, "run-b")).where(F.col("table_name") == place)
    return log.select("run_id", "total_rows", "ok_rows", "error_rows", "outcome")


@register("snapshot_diff", """
SELECT count(*) AS left_rows, count(*) AS right_rows, true AS identical FROM lineitem""")
def snapshot_diff(spark, folder):
    """lineitem against its own written copy."""
    path = scratch_path(spark, "snapshot")
    lines = open_parquet(spark, folder, "lineitem")
    lines.write.parquet(path)
    return snapshot.snapshot_diff(lines, spark.read.parquet(path)).select("left_rows", "right_rows", "identical")
