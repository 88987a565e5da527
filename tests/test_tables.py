"""Ids between drivers, the log of runs, restores cut short, located differences, range joins and quantiles."""

import contextlib
import math
import random
import threading
from datetime import datetime

import pytest
from books import simple_book
from pyspark.sql import functions as F

from sheetlake.operators import catalog, curated, imports, load, runs, snapshot
from sheetlake.operators.catalog import TargetColumn, create_table
from sheetlake.operators.intervals import bin_of, range_join
from sheetlake.operators.quantiles import exact_quantiles
from sheetlake.operators.skew import split_join
from sheetlake.session import checkpointed, create_only, read_text, scratch_path
from sheetlake.sources.workbook_reader import workbook_files

COLUMNS = [TargetColumn("name", "TEXT", True), TargetColumn("value", "INTEGER")]


def rows_of(spark, *names):
    df = spark.createDataFrame([(i + 2, n, "1") for i, n in enumerate(names)], "row_number int, name string, value string")
    return checkpointed(load.with_sequence(df))


def held(spark, name):
    return sorted(r["name"] for r in spark.table(name).collect())


def test_a_file_is_made_once(spark):
    path = f"{scratch_path(spark, 'claims')}/0"
    made = []
    workers = [threading.Thread(target=lambda i=i: made.append((create_only(spark, path, f"by {i}"), i))) for i in range(8)]
    for w in workers:
        w.start()
    for w in workers:
        w.join()
    winners = [i for ok, i in made if ok]
    assert len(winners) == 1 and read_text(spark, path) == f"by {winners[0]}"


def test_drivers_without_a_common_lock_never_share_an_id(spark, name, monkeypatch):
    create_table(spark, name, COLUMNS)
    monkeypatch.setattr(catalog, "_SEQUENCES", contextlib.nullcontext())
    starts = []
    workers = [threading.Thread(target=lambda: starts.extend(catalog.reserve_ids(spark, name, 7) for _ in range(4))) for _ in range(6)]
    for w in workers:
        w.start()
    for w in workers:
        w.join()
    assert sorted(starts) == list(range(0, 7 * 24, 7))


def test_runs_are_found_by_id_alone(spark, tmp_path, name):
    create_table(spark, name, COLUMNS)
    (tmp_path / "in").mkdir()
    simple_book(tmp_path / "in" / "a.xlsx", [["name", "value"], ["a", 1], ["b", 2]])
    simple_book(tmp_path / "in" / "b.xlsx", [["name", "value"], ["c", "x"]])
    run = f"run_{name}"
    for _ in range(2):  # a repeat replaces the entry
        imports.import_workbooks(workbook_files(spark, str(tmp_path / "in")), name, run)
        entry = [r.asDict() for r in runs.run_log(spark, run).drop("started", "ended").collect()]
        assert entry == [{"run_id": run, "table_name": name, "outcome": "partial", "total_rows": 3, "ok_rows": 2, "error_rows": 1,
                          "published_rows": 2}]
    assert [r.field for r in imports.import_by_id(spark, run).errors().collect()] == ["value"]
    other = f"{name}_2"
    create_table(spark, other, COLUMNS)
    assert load.load_rows(spark, other, rows_of(spark, "x"), run).published
    assert {(r.table_name, r.outcome) for r in runs.run_log(spark, run).collect()} == {(name, "partial"), (other, "success")}
    with pytest.raises(ValueError, match="several tables"):
        imports.import_by_id(spark, run)
    with pytest.raises(ValueError, match="No such run"):
        imports.import_by_id(spark, f"no_{run}")
    with pytest.raises(ValueError, match="Invalid run id"):
        runs.run_log(spark, "../x")
    assert runs.run_log(spark).where(F.col("run_id") == run).count() == 2


def test_ids_are_looked_up_without_broadcasting_the_table(spark, tmp_path, name, monkeypatch):
    create_table(spark, name, COLUMNS)

    def loaded(run, rows):
        df = spark.createDataFrame([(i + 2, n, "1", k) for i, (n, k) in enumerate(rows)],
                                   "row_number int, name string, value string, id string")
        return load.load_rows(spark, name, checkpointed(load.with_sequence(df)), run)

    assert loaded("run_1", [("a", "5"), ("b", "7"), ("c", "900")])[:2] == (True, 3)
    plans, stored = [], load.checkpointed
    monkeypatch.setattr(load, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df))
    assert loaded("run_2", [("d", "6"), ("e", "7"), ("f", "6"), ("g", "8")])[1:] == (4, 2)
    lookup = [line for p in plans for line in p.splitlines() if "LeftSemi" in line]
    assert lookup and all("SortMergeJoin" in line for line in lookup)
    plans.clear()
    # A workbook that gives no id has nothing to be looked up.
    simple_book(tmp_path / "a.xlsx", [["name", "value"], ["h", 1], ["i", 2]])
    assert imports.import_workbooks(workbook_files(spark, str(tmp_path)), name, "run_3").published_rows == 2
    assert plans and not any("LeftSemi" in p for p in plans)
    assert held(spark, name) == ["a", "b", "c", "h", "i"]


def test_a_run_that_is_cut_short_stays_running(spark, name, monkeypatch):
    create_table(spark, name, COLUMNS)

    def lost(*_):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(load, "publish_rows", lost)
    with pytest.raises(RuntimeError):
        load.load_rows(spark, name, rows_of(spark, "x"), f"run_{name}")
    assert [r.outcome for r in runs.run_log(spark, f"run_{name}").collect()] == ["running"]


def test_restore_cut_short_between_two_tables_is_carried_through(spark, tmp_path, name, monkeypatch):
    tables = [name, f"{name}_2"]
    for table in tables:
        create_table(spark, table, COLUMNS)
        load.load_rows(spark, table, rows_of(spark, f"before {table}"), "run_1")
    made = snapshot.take_snapshot(spark, tables, str(tmp_path), datetime(2024, 1, 5, 12, 0, 0))
    for table in tables:
        load.load_rows(spark, table, rows_of(spark, f"after {table}"), "run_2")
    swap, calls = snapshot.swap_table, []

    def once(*args):
        calls.append(args)
        if len(calls) > 1:
            raise RuntimeError("driver lost")
        swap(*args)

    monkeypatch.setattr(snapshot, "swap_table", once)
    with pytest.raises(RuntimeError):
        snapshot.restore_snapshot(spark, made, "RESTORE", str(tmp_path))
    assert len(held(spark, tables[0])) == 1 and len(held(spark, tables[1])) == 2
    monkeypatch.setattr(snapshot, "swap_table", swap)
    assert set(snapshot.finish_restores(spark)) >= set(tables)
    assert [held(spark, t) for t in tables] == [[f"before {t}"] for t in tables]
    assert snapshot.finish_restores(spark) == []
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(name) and "__" in t.name]


def test_restore_goes_on_between_two_renames(spark, tmp_path, name):
    create_table(spark, name, COLUMNS)
    load.load_rows(spark, name, rows_of(spark, "before"), "run_1")
    made = snapshot.take_snapshot(spark, [name], str(tmp_path), datetime(2024, 1, 5, 12, 0, 0))
    load.load_rows(spark, name, rows_of(spark, "after"), "run_2")
    snapshot.prepare_restore(spark, made, "RESTORE", str(tmp_path))
    spark.sql(f"ALTER TABLE {name} RENAME TO {name}__replaced")  # and here the driver is lost
    assert snapshot.finish_restores(spark) == [name] and held(spark, name) == ["before"]


@pytest.mark.parametrize("buckets", [2, 4096])
def test_differing_rows(spark, buckets):
    rng = random.Random(1)
    left = [(rng.choice([None, *range(300)]), rng.choice("ab"), rng.choice([None, 1.5, 2.5]), {"m": 1}) for _ in range(900)]
    right = [(k, s, 9.0 if k == 17 else v, m) for k, s, v, m in left if k != 5] + [(1000, "a", 1.5, None), (20, "a", 1.5, None)]
    schema = "k long, s string, v double, m map<string, int>"
    one, other = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    keys = {(r[0], r[1]) for r in left} | {(r[0], r[1]) for r in right}
    want = set()
    for key in keys:
        a, b = (sorted(str(r[2:]) for r in side if r[:2] == key) for side in (left, right))
        if a != b:
            want.add((*key, "missing" if not b else "extra" if not a else "changed"))
    got = [tuple(r) for r in snapshot.differing_rows(one, other, ["k", "s"], buckets).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert snapshot.differing_rows(one, one.repartition(3), ["k", "s"], buckets).count() == 0
    assert snapshot.differing_rows(one, one.limit(0), ["k"], buckets).where("difference <> 'missing'").count() == 0
    with pytest.raises(ValueError):
        snapshot.differing_rows(one, one.drop("v"), ["k"])


def test_bins(spark):
    for borders in ([], [1.0], [1.0, 2.0, 5.0], [float(i) for i in range(10)], [float(i) for i in range(13)]):
        values = [-1.0, 0.0, 0.5, 1.0, 1.5, 2.0, 4.9, 5.0, 8.9, 9.0, 11.9, 12.0, 99.0]
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert [r[0] for r in df.select(bin_of(F.col("v"), borders)).collect()] == [sum(b <= v for b in borders) for v in values]


@pytest.mark.parametrize("per_bin", [5, 40, 100_000])
def test_range_join(spark, per_bin):
    rng = random.Random(2)
    points = [(i, rng.choice([None, math.nan, 7.0, 7.0, rng.random() * 100, rng.random()])) for i in range(400)]
    ends = [(i, rng.choice([None, rng.random() * 100, 7.0, -math.inf]), rng.choice([math.nan, rng.random() * 100, 7.0, math.inf])) for i in range(60)]
    want = sorted((i, j) for i, v in points for j, a, b in ends
                  if v is not None and a is not None and b is not None and not math.isnan(v) and not math.isnan(b) and a <= v <= b)
    got = range_join(spark.createDataFrame(points, "i int, v double"), spark.createDataFrame(ends, "j int, a double, b double"),
                     "v", "a", "b", per_bin)
    assert sorted((r.i, r.j) for r in got.collect()) == want
    shown = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in shown and "NestedLoop" not in shown


@pytest.mark.parametrize("per_bin", [5, 40, 100_000])
def test_range_join_tasks_by_pairs(spark, per_bin):
    """Few rows that make many pairs: no task compares more than a part of them, and none is lost where one bin has most."""
    points = [(i, 7.0 if i % 2 else float(i % 100)) for i in range(200)]
    ends = [(j, j - 30.0, j + 30.0) for j in range(80)]
    want = sorted((i, j) for i, v in points for j, a, b in ends if a <= v <= b)
    got = range_join(spark.createDataFrame(points, "i int, v double"), spark.createDataFrame(ends, "j int, a double, b double"),
                     "v", "a", "b", per_bin, pairs_per_task=100)
    assert sorted((r.i, r.j) for r in got.collect()) == want
    each = [r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(each) == len(want) and len(each) > len(want) // 400 and max(each) < len(want) // 4


@pytest.mark.parametrize("few", [1, 20, 100_000])
def test_exact_quantiles(spark, few):
    rng = random.Random(3)
    groups = {"even": [rng.random() for _ in range(501)], "ties": [5.0] * 700 + [1.0, 2.0, 9.0], "one": [3.0], None: [float(i) for i in range(40)],
              "tail": [10.0 ** (i % 30) for i in range(300)] + [-1.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None), ("none", None)]
    rng.shuffle(rows)
    shares = [0.0, 0.001, 0.25, 0.5, 0.999, 1.0]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {(r.g, r.share): r.v for r in exact_quantiles(df, "g", "v", shares, few).collect()}
    want = {}
    for g, vs in groups.items():
        ordered = sorted(vs)
        for s in shares:
            rank = s * (len(ordered) - 1)
            low, high = ordered[math.floor(rank)], ordered[math.ceil(rank)]
            want[g, s] = low + (high - low) * (rank - math.floor(rank))
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)
    assert exact_quantiles(df.limit(0), "g", "v", shares, few).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_heavy_equal_rows_are_not_shuffled(spark, how, tmp_path):
    """A million equal narrow rows under one key, and as many under null: no task gets more than its share."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = 1_000_000
        left = spark.range(0, 2 * n + 1000, 1, 16).selectExpr(f"CASE WHEN id < {n} THEN 7L WHEN id >= {2 * n} THEN id END AS key")
        right = spark.range(0, 2 * n + 500, 1, 4).selectExpr(f"IF(id < {2 * n}, id % 1000, id) AS code", f"id AS label").where(
            f"label < 1000 OR label >= {2 * n}")
        joined = split_join(left, right, [("key", "code")], how, heavy_rows=100_000)
        joined.write.parquet(f"{tmp_path}/joined")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    written = spark.read.parquet(f"{tmp_path}/joined")
    sizes = [r["count"] for r in written.groupBy(F.input_file_name()).count().collect()]
    want = {"inner": n + 500, "left_semi": n + 500, "left": 2 * n + 1000, "left_anti": n + 500}[how]
    assert sum(sizes) == want and max(sizes) <= 2 * (2 * n) / 16


def test_heavy_key_with_many_right_rows(spark, monkeypatch):
    from sheetlake.operators import skew

    monkeypatch.setattr(skew, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(skew, "fits_broadcast", lambda df: False)
    left = spark.range(500).selectExpr("IF(id % 2 = 0, 1, id) AS key", "id")
    right = spark.range(20).selectExpr("IF(id < 10, 1, id) AS code", "id AS label")
    for how in skew.KINDS:
        got = split_join(left, right, [("key", "code")], how, heavy_rows=100)
        plain = left.join(right.withColumnRenamed("code", "key"), "key", how).select(*got.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_upserts_write_each_partition_once(spark, name):
    import os

    folder = scratch_path(spark, "once")
    curated.create_curated(spark, name, "id BIGINT, key STRING, v INT", "key", 4, folder)
    for turn in range(3):
        part = spark.range(100).selectExpr(f"id + {turn * 50} AS id", "concat('k', id) AS key", f"{turn} AS v")
        assert curated.upsert_table(spark, name, part, "id") == 4
        assert {r["v"] for r in spark.table(name).select("v").distinct().collect()} == {turn}
        assert spark.table(name).count() == 100
    versions = folder.replace("file://", "") + f"/{curated.VERSIONS}"
    kept = [v for v in os.listdir(versions) if any(p.startswith(curated.BUCKET) for p in os.listdir(f"{versions}/{v}"))]
    assert len(kept) == 1
    assert curated.upsert_table(spark, name, spark.sql("SELECT 999L AS id, 'k1' AS key, 7 AS v"), "id") == 1
    assert spark.table(name).where("v = 7").count() == 1 and spark.table(name).count() == 100


def test_profiles_merge_to_the_whole(spark, name):
    from sheetlake.operators.sketches import run_sketches, table_profile

    create_table(spark, name, COLUMNS)
    rng = random.Random(4)
    parts = {f"run_{i}": [(f"n{rng.randrange(2000)}", None if rng.random() < 0.1 else rng.randrange(10**6)) for _ in range(1500)] for i in range(3)}
    for run, part in parts.items():
        df = spark.createDataFrame([(i + 2, n, None if v is None else str(v)) for i, (n, v) in enumerate(part)], "row_number int, name string, value string")
        assert load.load_rows(spark, name, checkpointed(load.with_sequence(df)), run).published

    def check(runs=None):
        got = {r.column_name: r for r in table_profile(spark, name, runs, [0.5, 0.9]).collect()}
        rows = [r for run, part in parts.items() if runs is None or run in runs for r in part]
        values = sorted(v for _, v in rows if v is not None)
        assert set(got) == {"id", "name", "value"}
        assert (got["value"].row_count, got["value"].filled) == (len(rows), len(values))
        assert (got["value"].number_low, got["value"].number_high) == (values[0], values[-1])
        assert (got["name"].low, got["name"].high) == (min(n for n, _ in rows), max(n for n, _ in rows))
        for column, exact in (("name", {n for n, _ in rows}), ("value", set(values))):
            assert abs(got[column].distinct_values / len(exact) - 1) < 0.08
        for share, value in zip((0.5, 0.9), got["value"].quantiles):
            assert abs(sum(v <= value for v in values) / len(values) - share) < 0.03

    check()
    check(["run_0", "run_2"])
    before = run_sketches(spark, name).count()
    parts["run_1"] = [("only", 5)]
    assert load.load_rows(spark, name, rows_of(spark, "only").withColumn("value", F.lit("5")), "run_1").published
    check()
    load.drop_run(spark, name, "run_0")
    del parts["run_0"]
    check()
    assert run_sketches(spark, name).count() == before - 3


def test_compaction_by_one_and_by_several_columns(spark, name):
    from sheetlake.operators.compact import compact_runs, touched_files

    for indexed in (["name"], ["name", "value"]):
        table = f"{name}_{len(indexed)}"
        create_table(spark, table, [TargetColumn("name", "TEXT", True, None, "name" in indexed), TargetColumn("value", "INTEGER", False, None, "value" in indexed)])
        rng = random.Random(5)
        for run in ("run_1", "run_2"):
            rows = [(i + 2, f"{rng.randrange(10**6):06d}", None if rng.random() < 0.05 else str(rng.randrange(10**6))) for i in range(3000)]
            df = spark.createDataFrame(rows, "row_number int, name string, value string").repartition(8)
            assert load.load_rows(spark, table, checkpointed(load.with_sequence(df)), run).published
        before = sorted(map(str, spark.table(table).collect()))
        ids = load.reserve_ids(spark, table, 0)
        assert compact_runs(spark, table, file_rows=200) == {"run_1": 15, "run_2": 15}
        assert sorted(map(str, spark.table(table).collect())) == before and load.reserve_ids(spark, table, 0) == ids
        for column, values in (("name", ["000123", "500000", "999000"]), ("value", [123, 500000, 999000])):
            if column in indexed:
                for value in values:
                    found = touched_files(spark, table, column, value).first()
                    assert found.files == 30 and found.touched <= (4 if len(indexed) == 1 else 16)
        load.drop_run(spark, table, "run_1")
        assert spark.table(table).count() == 3000 and compact_runs(spark, table, ["run_1"]) == {}
    plain = f"{name}_plain"
    create_table(spark, plain, COLUMNS)
    with pytest.raises(ValueError):
        compact_runs(spark, plain)
