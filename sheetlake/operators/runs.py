"""The log of load runs over all tables, looked up by the run's id alone.

An entry is one small file, named by run and table, so a repeated attempt replaces what
the earlier one said. It is written when a run begins and again when it ends; a run that
was cut short stays ``running``.
"""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from ..session import make_folder, shared_dir, write_text

RUN_LOG = ("run_id STRING, table_name STRING, outcome STRING, total_rows BIGINT, ok_rows BIGINT, error_rows BIGINT, "
           "published_rows BIGINT, started TIMESTAMP, ended TIMESTAMP")
RUNNING = "running"


def check_run_id(run_id: str) -> None:
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", run_id) or not run_id.strip("."):
        raise ValueError(f"Invalid run id: {run_id}")


def _folder(spark: SparkSession, run_id: str) -> str:
    check_run_id(run_id)
    return f"{shared_dir(spark)}/sheetlake/runs/{run_id}"


def record_run(spark: SparkSession, run_id: str, table: str, place: str, started: datetime, outcome: str = RUNNING,
               total_rows: int = 0, ok_rows: int = 0, error_rows: int = 0, published_rows: int = 0) -> None:
    """Write the entry of a run; ``place`` is the table's own folder name."""
    ended = None if outcome == RUNNING else datetime.now(timezone.utc).isoformat()
    entry = {"run_id": run_id, "table_name": table, "outcome": outcome, "total_rows": total_rows, "ok_rows": ok_rows,
             "error_rows": error_rows, "published_rows": published_rows, "started": started.isoformat(), "ended": ended}
    write_text(spark, f"{_folder(spark, run_id)}/{place.replace('/', '.')}.json", json.dumps(entry))


def run_log(spark: SparkSession, run_id: str | None = None) -> DataFrame:
    """The entries of one run (one for each table that it went into), or of all; none for an unknown id."""
    folder = _folder(spark, run_id) if run_id is not None else f"{shared_dir(spark)}/sheetlake/runs"
    make_folder(spark, folder)
    return spark.read.schema(RUN_LOG).option("recursiveFileLookup", "true").json(folder)
