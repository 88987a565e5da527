"""Dirty sheets and header rows derived from the given tables.

Each fixture has a Spark form and the same rows as DuckDB text, so the cleaning
code is checked against SQL that shares none of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import ID_COLUMN, TargetColumn, TargetTable
from ..sources.tables import open_parquet

# One sheet row per order. {serial}, {us}, {named} and {g} differ by dialect.
_RAW_ORDERS = """
SELECT o_orderkey + 2 AS row_number,
       CASE o_orderkey % 11
            WHEN 0 THEN concat({tab}, CAST(o_custkey AS STRING), {nbsp})
            WHEN 1 THEN concat({wide}, CAST(o_custkey AS STRING), {tab}, ' ')
            ELSE concat(' ', CAST(o_custkey AS STRING), ' ') END AS customer_raw,
       CASE WHEN o_orderkey % 17 = 0 THEN '   '
            WHEN o_orderkey % 13 = 0 THEN 'n/a'
            WHEN o_orderkey % 23 = 0 THEN ' $ '
            WHEN o_orderkey % 7 = 0 THEN concat('$ ', regexp_replace(
                CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS STRING), '([0-9])([0-9]{{3}}[.])', '{g}1,{g}2'))
            WHEN o_orderkey % 5 = 0 THEN concat('$', CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS STRING))
            WHEN o_orderkey % 37 = 0 THEN '1.25e3'
            ELSE CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS STRING) END AS total_raw,
       CASE WHEN o_orderkey % 19 = 0 THEN 'not a date'
            WHEN o_orderkey % 29 = 0 THEN {nbsp}
            WHEN o_orderkey % 31 = 0 THEN '1999-02-30'
            WHEN o_orderkey % 9 = 0 THEN concat(CAST({serial} AS STRING), '.75')
            WHEN o_orderkey % 3 = 0 THEN CAST({serial} AS STRING)
            WHEN o_orderkey % 8 = 1 THEN {us}
            WHEN o_orderkey % 8 = 2 THEN {named}
            WHEN o_orderkey % 8 = 5 THEN concat(CAST(CAST(o_orderdate AS DATE) AS STRING), 'T10:30:00+02:00')
            ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date_raw,
       CASE o_orderkey % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'TRUE'
            WHEN 3 THEN '0' WHEN 4 THEN ' 1 ' WHEN 5 THEN 'maybe' ELSE '' END AS flag_raw
FROM orders
"""
RAW_ORDERS_DUCK = _RAW_ORDERS.format(
    tab="chr(9)", nbsp="chr(160)", wide="chr(12288)", g="\\",
    serial="datediff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE))",
    us="strftime(o_orderdate, '%-m/%-d/%Y')", named="strftime(o_orderdate, '%b %-d, %Y')")
_RAW_ORDERS_SPARK = _RAW_ORDERS.format(
    tab="'\\t'", nbsp="'\\u00a0'", wide="'\\u3000'", g="$",
    serial="datediff(DAY, DATE'1899-12-30', CAST(o_orderdate AS DATE))",
    us="date_format(CAST(o_orderdate AS DATE), 'M/d/yyyy')",
    named="date_format(CAST(o_orderdate AS DATE), 'MMM d, yyyy')")

ORDER_MAPPING = {
    "customer_raw": {"field": "customer_id", "type": "number"},
    "total_raw": {"field": "total", "type": "number"},
    "date_raw": {"field": "order_date", "type": "date"},
    "flag_raw": {"field": "gift", "type": "boolean"},
}
# The table the sheet is loaded into, with the sheet's headers as its columns.
ORDER_TARGET = TargetTable("sheet_orders", (
    ID_COLUMN,
    TargetColumn("customer_raw", "INTEGER", True),
    TargetColumn("total_raw", "NUMERIC", True),
    TargetColumn("date_raw", "TIMESTAMP"),
    TargetColumn("flag_raw", "BOOLEAN"),
    TargetColumn("channel", "TEXT", True, "'sheet'"),
))


def raw_orders(spark: SparkSession, folder: str) -> DataFrame:
    open_parquet(spark, folder, "orders").createOrReplaceTempView("orders")
    return spark.sql(_RAW_ORDERS_SPARK)


# Characters trimmed from cells, and the shape of a number.
DUCK_SPACES = " || ".join(
    f"chr({n})" for n in (9, 10, 11, 12, 13, 32, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288, 65279))
DUCK_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def duck_trim(column: str) -> str:
    return f"trim({column}, {DUCK_SPACES})"


def duck_blank(column: str) -> str:
    return f"nullif({duck_trim(column)}, '')"


def duck_date(text: str) -> str:
    """Date forms of the fixture, given trimmed text."""
    return f"""CASE
        WHEN regexp_matches({text}, '{DUCK_NUMBER}')
            THEN epoch_ms(CAST(trunc(-2209161600000.0::DOUBLE + CAST({text} AS DOUBLE) * 24 * 60 * 60 * 1000) AS BIGINT))
        WHEN contains({text}, 'T') THEN try_strptime(left({text}, 19), '%Y-%m-%dT%H:%M:%S') - INTERVAL 2 HOUR
        WHEN contains({text}, '/') THEN try_strptime({text}, '%m/%d/%Y')
        WHEN contains({text}, ',') THEN try_strptime({text}, '%b %d, %Y')
        ELSE try_strptime({text}, '%Y-%m-%d') END"""


# The sheet cleaned by mapping: values and one error text per field.
CLEAN_ORDERS_DUCK = f"""
raw_orders AS ({RAW_ORDERS_DUCK}),
trimmed AS (
    SELECT row_number, {duck_blank('customer_raw')} AS c, {duck_blank('total_raw')} AS t,
           {duck_blank('date_raw')} AS d, lower({duck_blank('flag_raw')}) AS f
    FROM raw_orders),
stripped AS (
    SELECT *, {duck_trim("replace(replace(t, '$', ''), ',', '')")} AS t_digits FROM trimmed),
parsed AS (
    SELECT row_number, c, t, d, f,
           CASE WHEN regexp_matches(c, '{DUCK_NUMBER}') THEN CAST(c AS DOUBLE) END AS customer_id,
           CASE WHEN regexp_matches(t_digits, '{DUCK_NUMBER}') THEN CAST(t_digits AS DOUBLE) END AS total,
           {duck_date('d')} AS order_date,
           CASE WHEN f IN ('true', 'yes', '1') THEN true WHEN f IN ('false', 'no', '0') THEN false END AS gift
    FROM stripped),
clean AS (
    SELECT row_number, customer_id, total, order_date, gift,
           CASE WHEN c IS NOT NULL AND customer_id IS NULL THEN 'Invalid number value' END AS customer_id_error,
           CASE WHEN t IS NOT NULL AND total IS NULL THEN 'Invalid number value' END AS total_error,
           CASE WHEN d IS NOT NULL AND order_date IS NULL THEN 'Invalid date value' END AS order_date_error,
           CASE WHEN f IS NOT NULL AND gift IS NULL THEN 'Invalid boolean value' END AS gift_error
    FROM parsed)"""

# The sheet coerced to ORDER_TARGET: values and one error text per column.
COERCED_ORDERS_DUCK = f"""
raw_orders AS ({RAW_ORDERS_DUCK}),
trimmed AS (
    SELECT row_number, {duck_blank('customer_raw')} AS c, {duck_blank('total_raw')} AS t,
           {duck_blank('date_raw')} AS d, {duck_blank('flag_raw')} AS f
    FROM raw_orders),
typed AS (
    SELECT row_number, c, t, d, f,
           CASE WHEN regexp_matches(c, '^[+-]?[0-9]+$') THEN try_cast(c AS INTEGER) END AS customer_raw,
           CASE WHEN regexp_matches(t, '{DUCK_NUMBER}') THEN try_cast(CAST(t AS DOUBLE) AS DECIMAL(38,9)) END AS total_raw,
           {duck_date('d')} AS date_raw,
           CASE WHEN lower(f) IN ('t','tr','tru','true','y','ye','yes','on','1') THEN true
                WHEN lower(f) IN ('f','fa','fal','fals','false','n','no','of','off','0') THEN false END AS flag_raw,
           'sheet' AS channel
    FROM trimmed),
coerced AS (
    SELECT row_number, customer_raw, total_raw, date_raw, flag_raw, channel,
           CASE WHEN total_raw IS NULL THEN coalesce('invalid input syntax for type numeric: "' || t || '"',
                'null value in column "total_raw" of relation "sheet_orders" violates not-null constraint') END
               AS total_raw_error,
           'invalid input syntax for type timestamp: "' || CASE WHEN date_raw IS NULL THEN d END || '"'
               AS date_raw_error,
           'invalid input syntax for type boolean: "' || CASE WHEN flag_raw IS NULL THEN f END || '"'
               AS flag_raw_error
    FROM typed),
coerced_errors AS (
    SELECT row_number, 'total_raw' AS field, total_raw_error AS error FROM coerced WHERE total_raw_error IS NOT NULL
    UNION ALL SELECT row_number, 'date_raw', date_raw_error FROM coerced WHERE date_raw_error IS NOT NULL
    UNION ALL SELECT row_number, 'flag_raw', flag_raw_error FROM coerced WHERE flag_raw_error IS NOT NULL)"""

# One uploaded workbook per customer, with the header row it brings.
UPLOAD_TARGET = (
    ID_COLUMN,
    TargetColumn("name", "TEXT", True),
    TargetColumn("value", "INTEGER"),
    TargetColumn("region", "TEXT", True, "'none'"),
)


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    nothing = F.lit(None).cast("string")
    choices = [
        ("name", "value"), ("value",), ("name", "value", F.col("c_name")), ("Name", "value"),
        ("name", "name", "value", "value"), ("Name", "name", "NAME"), ("name", nothing, "  ", "value"),
        (" name\t", "Unit Price ($)", "unit price  $", F.col("c_mktsegment")), ("region", "value", "id"),
    ]
    cells = None
    for i, choice in enumerate(choices):
        row = F.array(*[c if not isinstance(c, str) else F.lit(c) for c in choice])
        cells = F.when(key % len(choices) == i, row) if cells is None else cells.when(
            key % len(choices) == i, row)
    return open_parquet(spark, folder, "customer").select(
        F.concat(F.lit("in/"), key.cast("string"), F.lit(".xlsx")).alias("path"),
        F.lit("Sheet1").alias("sheet"), cells.alias("cells"))


# The same header cells one per row: (path, sheet, pos, header), blanks dropped.
UPLOADS_DUCK = f"""
upload_cells AS (
    SELECT 'in/' || c_custkey || '.xlsx' AS path, 'Sheet1' AS sheet,
           CASE c_custkey % 9
               WHEN 0 THEN ['name', 'value'] WHEN 1 THEN ['value'] WHEN 2 THEN ['name', 'value', c_name]
               WHEN 3 THEN ['Name', 'value'] WHEN 4 THEN ['name', 'name', 'value', 'value']
               WHEN 5 THEN ['Name', 'name', 'NAME'] WHEN 6 THEN ['name', NULL, '  ', 'value']
               WHEN 7 THEN [' name' || chr(9), 'Unit Price ($)', 'unit price  $', c_mktsegment]
               ELSE ['region', 'value', 'id'] END AS cells
    FROM customer),
positions AS (SELECT path, sheet, cells, unnest(range(1, len(cells) + 1)) AS pos FROM upload_cells),
uploads AS (SELECT path, sheet FROM upload_cells),
headers AS (
    SELECT path, sheet, CAST(pos AS INTEGER) AS pos, {duck_trim('cells[pos]')} AS header
    FROM positions WHERE coalesce({duck_trim('cells[pos]')}, '') <> ''),
target AS (
    SELECT * FROM (VALUES ('id', true, true), ('name', true, false), ('value', false, false), ('region', true, true))
        AS t(name, required, has_default))"""
