"""Run registered queries in Spark and DuckDB and compare columns, types and rows."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
TYPE_NAMES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT",
              "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET threads = 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def type_name(spark_type) -> str:
    name = spark_type.simpleString()
    if name.startswith("decimal"):
        return name.upper()
    if name.startswith("array<"):
        return TYPE_NAMES.get(name[6:-1], name) + "[]"
    return TYPE_NAMES.get(name, name)


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return str(value) if value is not None else None


def compare(spark, con, run, sql: str, folder: str) -> str | None:
    """None when equal, else what differs."""
    df = run(spark, folder)
    names = sorted(df.columns)
    if sql is None:
        return None if df.count() >= 0 else "no rows"
    result = con.execute(sql)
    found = [d[0] for d in result.description]
    if sorted(found) != names:
        return f"columns {names} against {sorted(found)}"
    kinds = {d[0]: str(d[1]).replace(" ", "") for d in result.description}
    for f in df.schema.fields:
        if type_name(f.dataType) != kinds[f.name]:
            return f"type of {f.name}: {type_name(f.dataType)} against {kinds[f.name]}"
    at = [found.index(n) for n in names]
    theirs = Counter(tuple(_plain(r[i]) for i in at) for r in result.fetchall())
    ours = Counter(tuple(_plain(r[n]) for n in names) for r in df.collect())
    if ours != theirs:
        return (f"rows {sum(ours.values())} against {sum(theirs.values())}; "
                f"only Spark {list((ours - theirs).items())[:3]}; only oracle {list((theirs - ours).items())[:3]}")
    return None


def main(argv) -> int:
    """python tests/oracle.py FOLDER [KEY ...]; ORACLE_CONF adds settings, as ``key=value key=value``."""
    from sheetlake.plans import all_oracles, all_queries
    from sheetlake.session import build_session

    folder, wanted = argv[0], argv[1:]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        **dict(p.split("=", 1) for p in os.environ.get("ORACLE_CONF", "").split() if p)})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = all_queries(), all_oracles()
    failed = 0
    for name, run in queries.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, run, oracles.get(name), folder)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - start:6.2f}s {name}"
              f"{'' if name in oracles else ' (no oracle)'} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
