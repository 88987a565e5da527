"""The query of replaced, old and copied files lands every order, in however many workbooks they come."""

import hashlib
from datetime import datetime, timedelta
from functools import partial

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from oracle import compare

from sheetlake.plans import all_oracles, workbooks
from sheetlake.sources.workbook_writer import export_workbook

SQL = all_oracles()["landing_replaced_file"]


def orders(folder, statuses, times=1):
    """One order for each status, each row so many times in a row."""
    n = range(len(statuses))
    table = pa.table({
        "o_orderkey": pa.array(n, pa.int64()), "o_custkey": pa.array(n, pa.int64()),
        "o_orderstatus": pa.array(statuses, pa.string()), "o_totalprice": pa.array([i * 10.25 for i in n], pa.float64()),
        "o_orderdate": pa.array([datetime(2024, 1, 1) + timedelta(hours=i) for i in n], pa.timestamp("us")),
        "o_orderpriority": pa.array(["LOW"] * len(statuses), pa.string())})
    pq.write_table(table.take([i for i in n for _ in range(times)]), folder / "orders.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{folder}/orders.parquet')")
    return duck


def test_every_workbook_of_an_export_lands(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbooks, "export_workbook", partial(export_workbook, max_rows=10))
    # Fewer workbooks replace than there were; some orders have none of the three statuses.
    duck = orders(tmp_path, ["F"] * 45 + ["O"] * 25 + ["P"] * 31 + [None, "X", ""])
    assert compare(spark, duck, workbooks.landing_replaced_file, SQL, str(tmp_path)) is None


def test_workbooks_of_rows_that_come_twice_are_no_copies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbooks, "TASK_ROWS", 10)
    duck = orders(tmp_path, ["F"] * 20 + ["O"] * 10 + ["P"] * 5, times=2)
    assert compare(spark, duck, workbooks.landing_replaced_file, SQL, str(tmp_path)) is None
    paths = workbooks.sheet_workbooks(workbooks._sheets(spark, str(tmp_path), "F", False), str(tmp_path / "out"))
    found = {hashlib.sha256(open(p.removeprefix("file://"), "rb").read()).hexdigest() for p in paths}
    assert len(found) == len(paths) == 4
