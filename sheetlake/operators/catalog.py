"""Target tables: column specifications, creation and layout."""

from __future__ import annotations

import json
import re
import threading
import uuid
from typing import NamedTuple

from pyspark.sql import SparkSession

from ..functions.assign import SPARK_TYPES
from ..session import create_only, names_in, read_text, shared_dir
from ..sources.tables import qualified, quote_name, split_table_name
from .headers import COLUMN_NAME, MAX_NAME, TABLE_NAME

RUN_COLUMN = "load_run"
_PREFIX = "sheetlake."


class TargetColumn(NamedTuple):
    """A column of a target table; ``default`` is SQL text, or None for no default."""

    name: str
    data_type: str = "TEXT"
    required: bool = False
    default: str | None = None
    indexed: bool = False


class TargetTable(NamedTuple):
    name: str
    columns: tuple[TargetColumn, ...]
    indexed: tuple[str, ...] = ()
    next_id: int = 1
    by_run: bool = False  # rows live in one partition per load run


ID_COLUMN = TargetColumn("id", "SERIAL", True, "serial")


def check_names(table: str, columns) -> None:
    _, base = split_table_name(table)
    if not re.fullmatch(TABLE_NAME.strip("^$"), base) or len(base) > MAX_NAME:
        raise ValueError(f"Invalid table name: {base}")
    if not columns:
        raise ValueError("A table needs at least one column.")
    for column in columns:
        if not re.fullmatch(COLUMN_NAME.strip("^$"), column.name) or len(column.name) > MAX_NAME:
            raise ValueError(f"Invalid column name: {column.name}")
        if column.data_type not in SPARK_TYPES:
            raise ValueError(f"Unknown column type: {column.data_type}")


def create_table(spark: SparkSession, name: str, columns, location: str | None = None) -> TargetTable:
    """Create a parquet table: ``id`` first, then ``columns`` in order.

    Rows live in one partition per load run, registered in the catalog only
    after all its files are committed. A column flagged ``indexed`` gets parquet
    bloom filters, and loads sort each file by the flagged columns, so lookups on
    them skip row groups and pages.
    """
    columns = [TargetColumn(*c) if not isinstance(c, TargetColumn) else c for c in columns]
    check_names(name, columns)
    if spark.catalog.tableExists(qualified(name)):
        raise ValueError("Table already exists.")
    kept = [c for c in columns if c.name != "id"]
    lines = ["`id` BIGINT"]
    for c in kept:
        default = f" DEFAULT {c.default}" if c.default is not None else ""
        lines.append(f"{quote_name(c.name)} {SPARK_TYPES[c.data_type]}{default}")
    indexed = [c.name for c in kept if c.indexed]
    properties = {
        "types": {c.name: c.data_type for c in kept},
        "required": [c.name for c in kept if c.required],
        "indexed": indexed,
        "next_id": 1,
        "sequence": uuid.uuid4().hex,
    }
    described = ", ".join(f"'{_PREFIX}{k}' = '{json.dumps(v)}'" for k, v in properties.items())
    blooms = ", ".join(f"'parquet.bloom.filter.enabled#{n}' 'true'" for n in indexed)
    spark.sql(
        f"CREATE TABLE {qualified(name)} ({', '.join(lines)}, {RUN_COLUMN} STRING) USING parquet "
        + (f"OPTIONS ({blooms}) " if blooms else "")
        + f"PARTITIONED BY ({RUN_COLUMN}) "
        + (f"LOCATION '{location}' " if location else "")
        + f"TBLPROPERTIES ({described})")
    return target_table(spark, name)


def _properties(spark: SparkSession, name: str) -> dict:
    rows = spark.sql(f"SHOW TBLPROPERTIES {qualified(name)}").collect()
    return {r["key"][len(_PREFIX):]: json.loads(r["value"]) for r in rows
            if r["key"].startswith(_PREFIX)}


def target_table(spark: SparkSession, name: str) -> TargetTable:
    """Column specification of an existing table, in column order. Metadata only."""
    about = describe(spark, name)
    kept = _properties(spark, name)
    types, required, indexed = kept.get("types", {}), kept.get("required", []), kept.get("indexed", [])
    by_run = RUN_COLUMN in about.get("partition_columns", [])
    known = {v: k for k, v in SPARK_TYPES.items()}
    schema = spark.table(qualified(name)).schema
    columns = []
    for c in about["columns"]:
        field = c["name"]
        if by_run and field == RUN_COLUMN:
            continue
        if field == "id" and "next_id" in kept:
            columns.append(ID_COLUMN)
            continue
        found = schema[field].dataType.simpleString()
        columns.append(TargetColumn(
            field, types.get(field) or known.get(found, found),
            field in required or not c["nullable"], c.get("default"), field in indexed))
    return TargetTable(name, tuple(columns), tuple(indexed), kept.get("next_id", 1), by_run)


def describe(spark: SparkSession, name: str) -> dict:
    return json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {qualified(name)} AS JSON").first()[0])


def table_place(spark: SparkSession, table: str) -> str:
    """A folder name for each table: catalog, database, table."""
    about = describe(spark, table)
    return "/".join([about["catalog_name"], *about["namespace"], about["table_name"]])


def sketch_path(spark: SparkSession, table: str) -> str:
    """Where the sketches of a table's runs are kept, one folder for each run."""
    return f"{shared_dir(spark)}/sheetlake/sketches/{table_place(spark, table)}"


_SEQUENCES = threading.Lock()


def reserve_ids(spark: SparkSession, name: str, count: int, past: int = 0) -> int:
    """Advance the table's id sequence by ``count``, to begin after ``past`` at least; returns the last id before.

    No load scans the table for its highest id. A range is taken by creating the next
    numbered file of the table's sequence in the shared folder, which can be done once
    only, so drivers that load one table at the same time never share an id; the one
    that comes second takes the range behind. As with any sequence, a load that fails
    afterwards leaves a gap. There is one small file for each load, and the table's own
    property follows it.
    """
    with _SEQUENCES:
        kept = _properties(spark, name)
        # A table that was made elsewhere has no sequence of its own, and goes by its name.
        folder = f"{shared_dir(spark)}/sheetlake/sequences/{kept.get('sequence') or table_place(spark, name)}"
        while True:
            claims = [n for n in names_in(spark, folder) if n.isdigit()]
            last = int(read_text(spark, f"{folder}/{claims[-1]}")) if claims else 0
            start = max(kept.get("next_id", 1), last + 1, past + 1)
            number = int(claims[-1]) + 1 if claims else 0
            if create_only(spark, f"{folder}/{number:012d}", str(start + count - 1)):
                break
        spark.sql(f"ALTER TABLE {qualified(name)} SET TBLPROPERTIES ('{_PREFIX}next_id' = '{start + count}')")
    return start - 1
