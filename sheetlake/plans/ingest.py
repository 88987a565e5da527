"""Registered queries: scans, cleaning, coercion, loading."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells
from ..operators import load, mapping, snapshot
from ..operators.catalog import TargetColumn, TargetTable, create_table, target_table
from ..session import checkpointed, scratch_path
from ..sources.tables import open_parquet, scan_table
from . import fixtures as fx
from .registry import registry

QUERIES, ORACLES, register = registry()


def _clean(spark, folder):
    return mapping.normalize_rows(fx.raw_orders(spark, folder), fx.ORDER_MAPPING)


def _coerced(spark, folder):
    return load.coerce_rows(fx.raw_orders(spark, folder), fx.ORDER_TARGET)


@register("segment_spend", f"""
WITH {fx.CLEAN_ORDERS_DUCK}
SELECT c_mktsegment AS segment, count(*) AS orders, CAST(sum(CAST(total AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS spend
FROM clean JOIN customer ON c_custkey = customer_id
WHERE customer_id_error IS NULL AND total_error IS NULL AND order_date_error IS NULL AND gift_error IS NULL
  AND total IS NOT NULL
GROUP BY 1""")
def segment_spend(spark, folder):
    """Clean the sheet, drop bad rows, total per customer before the join, then per segment."""
    valid = mapping.valid_rows(_clean(spark, folder)).where(F.col("total").isNotNull())
    per_customer = valid.groupBy(F.col("customer_id").cast("bigint").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum(F.col("total").cast("decimal(18,2)")).alias("spend"))
    customer = open_parquet(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return (per_customer.join(customer, "c_custkey").groupBy(F.col("c_mktsegment").alias("segment"))
            .agg(F.sum("orders").alias("orders"), F.sum("spend").cast("decimal(38,2)").alias("spend")))


register("scan_table", """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders""")(
    lambda spark, folder: (fx.raw_orders(spark, folder), scan_table(spark, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"))[1])

register("clean_text", f"""
WITH raw_orders AS ({fx.RAW_ORDERS_DUCK})
SELECT row_number, {fx.duck_trim('customer_raw')} AS customer, {fx.duck_trim('total_raw')} AS total,
       {fx.duck_trim('date_raw')} AS order_date, {fx.duck_trim('flag_raw')} AS gift FROM raw_orders""")(
    lambda spark, folder: fx.raw_orders(spark, folder).select(
        "row_number", cells.trim_text("customer_raw").alias("customer"),
        cells.trim_text("total_raw").alias("total"), cells.trim_text("date_raw").alias("order_date"),
        cells.trim_text("flag_raw").alias("gift")))

register("clean_blank_null", f"""
WITH raw_orders AS ({fx.RAW_ORDERS_DUCK})
SELECT row_number, {fx.duck_blank('total_raw')} AS total, {fx.duck_blank('date_raw')} AS order_date,
       {fx.duck_blank('flag_raw')} AS gift FROM raw_orders""")(
    lambda spark, folder: fx.raw_orders(spark, folder).select(
        "row_number", cells.blank_to_null("total_raw").alias("total"),
        cells.blank_to_null("date_raw").alias("order_date"), cells.blank_to_null("flag_raw").alias("gift")))


def _parsed(source, field, kind):
    def run(spark, folder):
        typed = mapping.normalize_rows(fx.raw_orders(spark, folder), {source: {"field": field, "type": kind}})
        return typed.select("row_number", field, F.col("errors")[field].alias("error"))
    return run


for _key, _source, _field, _kind in (
    ("clean_number", "total_raw", "total", "number"),
    ("clean_date", "date_raw", "order_date", "date"),
    ("clean_boolean", "flag_raw", "gift", "boolean"),
):
    register(_key, f"WITH {fx.CLEAN_ORDERS_DUCK} SELECT row_number, {_field}, {_field}_error AS error FROM clean")(
        _parsed(_source, _field, _kind))

register("serial_date", """
SELECT o_orderkey, o_totalprice / 10 AS serial,
       epoch_ms(CAST(trunc(-2209161600000.0::DOUBLE + o_totalprice / 10 * 24 * 60 * 60 * 1000) AS BIGINT)) AS shown
FROM orders""")(
    lambda spark, folder: open_parquet(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 10).alias("serial"),
        cells.serial_to_timestamp(F.col("o_totalprice") / 10).alias("shown")))

register("iso_text", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0')
       || 'Z' AS iso FROM events""")(
    lambda spark, folder: open_parquet(spark, folder, "events").select(
        "event_id", cells.iso_text(F.col("ts")).alias("iso")))

register("normalize_mapping", f"""
WITH {fx.CLEAN_ORDERS_DUCK}
SELECT row_number, customer_id, total, order_date, gift,
       CAST((customer_id_error IS NOT NULL)::INT + (total_error IS NOT NULL)::INT
            + (order_date_error IS NOT NULL)::INT + (gift_error IS NOT NULL)::INT AS INTEGER) AS error_count,
       order_date_error FROM clean""")(
    lambda spark, folder: _clean(spark, folder).select(
        "row_number", "customer_id", "total", "order_date", "gift",
        F.size("errors").alias("error_count"), F.col("errors")["order_date"].alias("order_date_error")))

register("coerce_to_schema", f"""
WITH {fx.COERCED_ORDERS_DUCK}
SELECT row_number, customer_raw, total_raw, date_raw, flag_raw, channel FROM coerced""")(
    lambda spark, folder: _coerced(spark, folder).drop("errors"))

register("import_errors", f"WITH {fx.COERCED_ORDERS_DUCK} SELECT row_number, field, error FROM coerced_errors")(
    lambda spark, folder: mapping.row_errors(_coerced(spark, folder)))

# Every event's value and payload put into columns they do not all fit.
EVENT_TARGET = TargetTable("event_cells", (
    TargetColumn("as_integer", "INTEGER"), TargetColumn("as_numeric", "NUMERIC"),
    TargetColumn("as_boolean", "BOOLEAN"), TargetColumn("as_date", "DATE"), TargetColumn("as_json", "JSONB")))


def _event_cells(spark, folder):
    return open_parquet(spark, folder, "events").select(
        F.col("event_id").alias("row_number"),
        F.when(F.col("event_type") == "click", (F.col("user_id") * 100000000).cast("string"))
        .when(F.col("event_type") == "error", F.col("event_type"))
        .otherwise(F.col("user_id").cast("string")).alias("as_integer"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("#"), F.col("user_id").cast("string")))
        .otherwise((F.col("user_id") / 4).cast("string")).alias("as_numeric"),
        F.col("user_id").cast("string").alias("as_boolean"),
        F.when(F.col("event_type") == "signup", F.lit("soon"))
        .otherwise(F.col("ts").cast("date").cast("string")).alias("as_date"),
        F.when(F.col("event_type") == "purchase", F.substring("props", 2, 1000000))
        .otherwise(F.col("props")).alias("as_json"))


register("cast_errors", """
WITH named AS (
    SELECT event_id AS row_number, event_type, CAST(user_id AS VARCHAR) AS u, user_id FROM events)
SELECT row_number, 'as_integer' AS field,
       CASE WHEN event_type = 'click' THEN 'value "' || user_id * 100000000 || '" is out of range for type integer'
            ELSE 'invalid input syntax for type integer: "error"' END AS error
FROM named WHERE event_type = 'error' OR (event_type = 'click' AND user_id * 100000000 > 2147483647)
UNION ALL SELECT row_number, 'as_numeric', 'invalid input syntax for type numeric: "#' || u || '"'
FROM named WHERE event_type = 'view'
UNION ALL SELECT row_number, 'as_boolean', 'invalid input syntax for type boolean: "' || u || '"'
FROM named WHERE user_id NOT IN (0, 1)
UNION ALL SELECT row_number, 'as_date', 'invalid input syntax for type date: "soon"'
FROM named WHERE event_type = 'signup'
UNION ALL SELECT row_number, 'as_json', 'invalid input syntax for type json'
FROM named WHERE event_type = 'purchase'""")(
    lambda spark, folder: mapping.row_errors(load.coerce_rows(_event_cells(spark, folder), EVENT_TARGET)))

register("required_errors", f"""
WITH {fx.COERCED_ORDERS_DUCK}
SELECT row_number, field, error FROM coerced_errors WHERE error LIKE 'null value in column%'""")(
    lambda spark, folder: mapping.row_errors(_coerced(spark, folder)).where(
        F.col("error").startswith("null value in column")))

register("json_extract", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
       json_extract(props, '$.missing') IS NULL AS no_missing FROM events""")(
    lambda spark, folder: open_parquet(spark, folder, "events").withColumn(
        "doc", F.try_parse_json("props")).select(
        "event_id", F.try_variant_get("doc", "$.k", "int").alias("k"),
        F.try_variant_get("doc", "$.missing", "string").isNull().alias("no_missing")))

register("import_first_bad_batch", f"""
WITH {fx.COERCED_ORDERS_DUCK},
failing AS (SELECT DISTINCT row_number, (row_number - 2) // 1000 AS batch FROM coerced_errors)
SELECT row_number, batch FROM failing WHERE batch = (SELECT min(batch) FROM failing)""")(
    lambda spark, folder: load.first_bad_batch(
        _coerced(spark, folder), F.col("row_number") - 1).select("row_number", "batch"))

register("import_summary", f"""
WITH {fx.COERCED_ORDERS_DUCK}, bad AS (SELECT count(DISTINCT row_number) AS n FROM coerced_errors)
SELECT count(*) AS total_rows, count(*) - any_value(n) AS ok_rows, any_value(n) AS error_rows,
       CASE WHEN any_value(n) = 0 THEN 'success' ELSE 'rejected' END AS outcome
FROM coerced, bad""")(
    lambda spark, folder: load.import_summary(_coerced(spark, folder)))

register("load_defaults", f"""
WITH {fx.COERCED_ORDERS_DUCK}
SELECT channel, count(*) AS row_count, count(total_raw) AS totals FROM coerced GROUP BY channel""")(
    lambda spark, folder: _coerced(spark, folder).groupBy("channel").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("total_raw").alias("totals")))


@register("load_ids", """
SELECT 100 + row_number() OVER (ORDER BY o_orderkey) AS id, o_orderkey FROM orders""")
def load_ids(spark, folder):
    orders = open_parquet(spark, folder, "orders").select("o_orderkey")
    return load.assign_ids(orders, ["o_orderkey"], base=100)


LOAD_COLUMNS = (
    TargetColumn("o_orderkey", "INTEGER", True), TargetColumn("total", "NUMERIC", True),
    TargetColumn("placed", "TIMESTAMP", indexed=True), TargetColumn("channel", "TEXT", True, "'sheet'"))


def new_load_table(spark, label: str) -> str:
    path = scratch_path(spark, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    create_table(spark, name, LOAD_COLUMNS, location=path)
    return name


def _stage(spark, label: str, rows):
    """Rows written to the shared folder with their sequence, as an import's raw store is."""
    path = scratch_path(spark, label)
    load.with_sequence(rows).write.parquet(path)
    return spark.read.parquet(path)


def _sheet_of_orders(spark, folder, status: str | None, with_errors: bool):
    total = F.col("o_totalprice").cast("decimal(15,2)").cast("string")
    if with_errors:
        total = F.when(F.col("o_orderkey") % 97 == 0, "n/a").otherwise(total)
    orders = open_parquet(spark, folder, "orders")
    if status:
        orders = orders.where(F.col("o_orderstatus") == status)
    return orders.select(
        (F.col("o_orderkey") + 2).alias("row_number"), F.col("o_orderkey").cast("string").alias("o_orderkey"),
        total.alias("total"), F.col("o_orderdate").cast("date").cast("string").alias("placed"))


_LOADED = """
SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS DECIMAL(38,9)) AS total,
       o_orderdate AS placed, 'sheet' AS channel FROM orders"""


@register("load_append", _LOADED)
def load_append(spark, folder):
    """Three clean sheets appended to one table, each its own run."""
    table = new_load_table(spark, "append")
    for run, status in (("run-1", "F"), ("run-2", "O"), ("run-3", "P")):
        load.load_rows(spark, table, _stage(spark, run, _sheet_of_orders(spark, folder, status, False)), run)
    return spark.table(table).select("o_orderkey", "total", "placed", "channel")


@register("load_all_or_nothing", f"{_LOADED} WHERE o_orderstatus IN ('F', 'P')")
def load_all_or_nothing(spark, folder):
    """Clean sheets are published; one with a few bad rows leaves no row behind."""
    table = new_load_table(spark, "atomic")
    for run, status, bad in (("run-1", "F", False), ("run-2", "O", True), ("run-3", "P", False)):
        load.load_rows(spark, table, _stage(spark, run, _sheet_of_orders(spark, folder, status, bad)), run)
    return spark.table(table).select("o_orderkey", "total", "placed", "channel")


def load_orders(spark, folder, label: str) -> str:
    """A new table with all orders as one run."""
    table = new_load_table(spark, label)
    load.load_rows(spark, table, _stage(spark, f"{label}-run", _sheet_of_orders(spark, folder, None, False)), "run-1")
    return table


@register("load_repeat", f"{_LOADED} WHERE o_orderstatus = 'P'")
def load_repeat(spark, folder):
    """Runs that are repeated: a good sheet that is bad now leaves no row, one that is good again replaces its first rows."""
    table = new_load_table(spark, "repeat")
    for run, status, bad in (("run-1", "F", False), ("run-2", "O", False), ("run-1", "F", True), ("run-2", "P", False)):
        load.load_rows(spark, table, _stage(spark, run, _sheet_of_orders(spark, folder, status, bad)), run)
    return spark.table(table).select("o_orderkey", "total", "placed", "channel")


@register("id_conflicts", """
WITH sheet AS (SELECT o_orderkey + 2 AS row_number, CASE WHEN o_orderkey % 50 = 3 THEN o_orderkey - 1 ELSE o_orderkey END AS id FROM orders
               WHERE o_orderstatus <> 'F'),
held AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_number) AS n FROM sheet)
SELECT row_number, 'id' AS field, 'duplicate key value violates unique constraint "ids_pkey"' AS error
FROM ranked WHERE n > 1 OR id IN (SELECT id FROM held)""")
def id_conflicts(spark, folder):
    """Ids that a sheet gives twice, or that the table holds, are errors of their rows."""
    table = new_load_table(spark, "ids")

    def sheet(orders, given):
        total = F.col("o_totalprice").cast("decimal(15,2)").cast("string")
        return _stage(spark, "ids-run", orders.select(
            (F.col("o_orderkey") + 2).alias("row_number"), given.cast("string").alias("id"),
            F.col("o_orderkey").cast("string").alias("o_orderkey"), total.alias("total"),
            F.col("o_orderdate").cast("date").cast("string").alias("placed")))

    orders, key = open_parquet(spark, folder, "orders"), F.col("o_orderkey")
    load.load_rows(spark, table, sheet(orders.where("o_orderstatus = 'F'"), key), "run-1")
    raw = sheet(orders.where("o_orderstatus <> 'F'").repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey"),
                F.when(key % 50 == 3, key - 1).otherwise(key))
    target = target_table(spark, table)
    typed = checkpointed(load.coerce_rows(raw, target, keep=("row_number", "seq"), into="row"))
    checked = load.with_key_errors(spark, target._replace(name=table), typed, "run-2")
    return mapping.row_errors(checked).withColumn("error", F.replace("error", F.lit(table), F.lit("ids")))


@register("indexed_lookup", f"{_LOADED} WHERE date_trunc('month', o_orderdate) = TIMESTAMP '1997-03-01'")
def indexed_lookup(spark, folder):
    """One month of a loaded table by its indexed column, read through the parquet filters."""
    table = load_orders(spark, folder, "lookup")
    return spark.table(table).where("placed >= TIMESTAMP_NTZ'1997-03-01' AND placed < TIMESTAMP_NTZ'1997-04-01'").select(
        "o_orderkey", "total", "placed", "channel")


@register("restore_round_trip", """
WITH numbered AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n FROM orders),
sizes AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders)
SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CASE o_orderstatus WHEN 'F' THEN n ELSE f + n END AS id, 'sheet' AS channel
FROM numbered, sizes WHERE o_orderstatus IN ('F', 'O')""")
def restore_round_trip(spark, folder):
    """Load, snapshot, load more, drop, restore, load again: ids and defaults go on as the snapshot had them."""
    table, place = new_load_table(spark, "restored"), scratch_path(spark, "snapshots")
    in_order = [_sheet_of_orders(spark, folder, s, False).repartitionByRange(4, "row_number").sortWithinPartitions("row_number")
                for s in ("F", "P", "O")]
    load.load_rows(spark, table, _stage(spark, "restore-1", in_order[0]), "run-1")
    made = snapshot.take_snapshot(spark, [table], place)
    load.load_rows(spark, table, _stage(spark, "restore-2", in_order[1]), "run-2")
    spark.sql(f"DROP TABLE {table}")
    snapshot.restore_snapshot(spark, made, made, place)
    load.load_rows(spark, table, _stage(spark, "restore-3", in_order[2]), "run-3")
    return spark.table(table).select("o_orderkey", "id", "channel")


@register("target_columns", """
WITH spec AS (SELECT * FROM (VALUES (1, 'id', 'SERIAL', true, 'serial'), (2, 'o_orderkey', 'INTEGER', true, NULL),
    (3, 'total', 'NUMERIC', true, NULL), (4, 'placed', 'TIMESTAMP', false, NULL),
    (5, 'channel', 'TEXT', true, '''sheet''')) AS s(position, name, data_type, required, default_value))
SELECT CAST(position AS INTEGER) AS position, name, data_type, required, default_value,
       CASE WHEN name IN ('id', 'o_orderkey', 'total', 'placed', 'channel')
            THEN (SELECT count(*) FROM orders) ELSE 0 END AS filled_rows
FROM spec""")
def target_columns(spark, folder):
    """The column specification next to how many loaded rows fill each column."""
    table = new_load_table(spark, "spec")
    load.load_rows(spark, table, _stage(spark, "spec-run", _sheet_of_orders(spark, folder, None, False)), "run-1")
    spec = target_table(spark, table).columns
    filled = spark.table(table).agg(*[F.count(F.col(c.name)).alias(c.name) for c in spec])
    entries = F.array(*[F.struct(
        F.lit(i).alias("position"), F.lit(c.name).alias("name"), F.lit(c.data_type).alias("data_type"),
        F.lit(c.required).alias("required"), F.lit(c.default).cast("string").alias("default_value"),
        F.col(c.name).alias("filled_rows")) for i, c in enumerate(spec, 1)])
    return filled.select(F.inline(entries))
