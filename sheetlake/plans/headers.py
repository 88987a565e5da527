"""Registered queries: header checks over one uploaded workbook per customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import headers as h
from ..sources.tables import open_parquet
from . import fixtures as fx
from .registry import registry

QUERIES, ORACLES, register = registry()


def _headers(spark, folder):
    return h.extract_headers(fx.uploads(spark, folder))


def _listed(column, name):
    """One output row per entry of an array column."""
    def run(spark, folder):
        return _headers(spark, folder).select("path", F.explode(column()).alias(name))
    return run


register("header_extract", f"WITH {fx.UPLOADS_DUCK} SELECT path, sheet, pos, header FROM headers")(
    lambda spark, folder: _headers(spark, folder).select("path", "sheet", F.inline("headers")))

register("header_missing", f"""
WITH {fx.UPLOADS_DUCK}
SELECT u.path, t.name AS column_name FROM uploads u JOIN target t ON t.required AND NOT t.has_default
LEFT JOIN headers h ON h.path = u.path AND h.header = t.name WHERE h.path IS NULL""")(
    _listed(lambda: h.missing_required(fx.UPLOAD_TARGET), "column_name"))

register("header_extra", f"""
WITH {fx.UPLOADS_DUCK}
SELECT h.path, h.header FROM headers h LEFT JOIN target t ON t.name = h.header WHERE t.name IS NULL""")(
    _listed(lambda: h.extra_headers(fx.UPLOAD_TARGET), "header"))

register("header_duplicates", f"""
WITH {fx.UPLOADS_DUCK} SELECT path, header FROM headers GROUP BY path, header HAVING count(*) > 1""")(
    _listed(h.duplicate_headers, "header"))

register("header_sanitize", f"""
WITH {fx.UPLOADS_DUCK}
SELECT path, pos, header,
       regexp_replace(regexp_replace(lower(header), '[^a-z0-9]', '_', 'g'), '_+', '_', 'g') AS column_name
FROM headers""")(
    lambda spark, folder: _headers(spark, folder).select("path", F.inline("headers")).select(
        "path", "pos", "header", h.sanitize_name(F.col("header")).alias("column_name")))

register("header_collisions", f"""
WITH {fx.UPLOADS_DUCK},
names AS (SELECT DISTINCT path, header,
    regexp_replace(regexp_replace(lower(header), '[^a-z0-9]', '_', 'g'), '_+', '_', 'g') AS column_name FROM headers)
SELECT path, column_name FROM names GROUP BY path, column_name HAVING count(*) > 1""")(
    _listed(h.sanitized_collisions, "column_name"))

register("header_report", f"""
WITH {fx.UPLOADS_DUCK},
missing AS (SELECT u.path, string_agg(t.name, ',' ORDER BY t.name) AS missing
            FROM uploads u JOIN target t ON t.required AND NOT t.has_default
            LEFT JOIN headers h ON h.path = u.path AND h.header = t.name WHERE h.path IS NULL GROUP BY u.path),
extra AS (SELECT h.path, string_agg(h.header, ',' ORDER BY h.pos) AS extra
          FROM headers h LEFT JOIN target t ON t.name = h.header WHERE t.name IS NULL GROUP BY h.path),
repeated AS (SELECT path, string_agg(header, ',' ORDER BY header) AS duplicates
             FROM (SELECT path, header FROM headers GROUP BY path, header HAVING count(*) > 1) GROUP BY path),
provided AS (SELECT path, string_agg(header, ',' ORDER BY pos) AS provided FROM headers GROUP BY path)
SELECT u.path, u.sheet, coalesce(missing, '') AS missing, coalesce(extra, '') AS extra,
       coalesce(duplicates, '') AS duplicates, 'id,name,value,region' AS expected, provided,
       missing IS NULL AND extra IS NULL AND duplicates IS NULL AS ok
FROM uploads u LEFT JOIN missing USING (path) LEFT JOIN extra USING (path)
LEFT JOIN repeated USING (path) LEFT JOIN provided USING (path)""")(
    lambda spark, folder: h.header_report(_headers(spark, folder), fx.UPLOAD_TARGET).select(
        "path", "sheet", *[F.array_join(c, ",").alias(c) for c in
                           ("missing", "extra", "duplicates", "expected", "provided")], "ok"))

register("header_required_status", f"""
WITH {fx.UPLOADS_DUCK}
SELECT u.path, u.sheet, t.name AS column_name,
       CASE WHEN h.path IS NULL AND NOT t.has_default THEN 'missing' ELSE 'present' END AS status
FROM uploads u JOIN target t ON t.required
LEFT JOIN (SELECT DISTINCT path, header FROM headers) h ON h.path = u.path AND h.header = t.name""")(
    lambda spark, folder: h.required_status(_headers(spark, folder), fx.UPLOAD_TARGET))


def _proposals(spark, folder):
    """A proposed table and column name per part, good and bad."""
    key = F.col("p_partkey")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    return open_parquet(spark, folder, "part").select(
        F.col("p_partkey").alias("proposal"),
        F.when(key % 5 == 0, F.concat(F.lit("1_"), name)).when(key % 7 == 0, F.repeat(name, F.lit(9)))
        .otherwise(name).alias("table_name"),
        F.when(key % 3 == 0, F.col("p_brand")).when(key % 4 == 0, F.col("p_name"))
        .when(key % 11 == 0, F.repeat("p_type", 12)).otherwise(F.lower("p_type")).alias("column_name"))


register("name_rules", """
WITH proposals AS (
    SELECT p_partkey AS proposal,
           CASE WHEN p_partkey % 5 = 0 THEN '1_' || replace(p_name, ' ', '_')
                WHEN p_partkey % 7 = 0 THEN repeat(replace(p_name, ' ', '_'), 9)
                ELSE replace(p_name, ' ', '_') END AS table_name,
           CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 4 = 0 THEN p_name
                WHEN p_partkey % 11 = 0 THEN repeat(p_type, 12) ELSE lower(p_type) END AS column_name
    FROM part)
SELECT proposal, concat_ws('; ',
    CASE WHEN NOT regexp_full_match(table_name, '[a-zA-Z_][a-zA-Z0-9_]*') THEN 'Invalid table name' END,
    CASE WHEN length(table_name) > 63 THEN 'Table name too long' END,
    CASE WHEN NOT regexp_full_match(column_name, '[a-zA-Z0-9_]+') THEN 'Invalid column name' END,
    CASE WHEN length(column_name) > 63 THEN 'Column name too long' END) AS problems
FROM proposals""")(
    lambda spark, folder: _proposals(spark, folder).select(
        "proposal", F.array_join(h.name_problems("table_name", "column_name"), "; ").alias("problems")))
