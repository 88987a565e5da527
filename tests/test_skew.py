"""One key holding a third of the rows, against brute force in Python; plans stay splittable."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sheetlake.operators import curated
from sheetlake.plans import all_queries
from sheetlake.plans import fixtures as fx
from sheetlake.operators import load, mapping

FOLDER = "/root/testdata/sf0.001"


def skewed(spark, n=6000, seed=7):
    pick = random.Random(seed)
    rows = [(i, "hot" if i % 3 == 0 else f"k{pick.randrange(400)}", pick.choice("abc"), pick.randrange(10**6))
            for i in range(n)]
    return rows, spark.createDataFrame(rows, "seq int, key string, payload string, row_hash int").repartition(8)


def test_newest_per_key(spark):
    rows, df = skewed(spark)
    newest = {}
    for r in rows:
        if r[1] not in newest or r[0] > newest[r[1]][0]:
            newest[r[1]] = r
    got = curated.newest_per_key(df, "key", "seq").select("seq", "key", "payload", "row_hash").collect()
    assert sorted(map(tuple, got)) == sorted(newest.values())


def test_upsert_keeps_others_and_drops_keyless(spark):
    rows, df = skewed(spark)
    current = curated.newest_per_key(df.where("seq < 3000"), "key", "seq")
    incoming = df.where("seq >= 4500").withColumn("key", F.when(F.col("seq") % 50 != 1, F.col("key")))
    expected = {}
    for r in rows:
        if r[0] < 3000:
            expected[r[1]] = r
    for r in rows:
        if r[0] >= 4500 and r[0] % 50 != 1:
            expected[r[1]] = r
    got = curated.upsert(current, incoming, "key", "seq").select("seq", "key", "payload", "row_hash").collect()
    assert sorted(map(tuple, got)) == sorted(expected.values())


def test_duplicates_and_missing(spark):
    rows, df = skewed(spark)
    counts = Counter(r[1] for r in rows)
    got = {r["key"]: r["row_count"] for r in curated.duplicate_keys(df, "key").collect()}
    assert got == {k: n for k, n in counts.items() if n > 1}
    right = df.where("payload = 'a'")
    have = {r[1] for r in rows if r[2] == "a" and r[1] != "hot"}
    right = right.where("key <> 'hot'")
    missing = curated.missing_related(df, right, "key")
    assert sorted(r["seq"] for r in missing.collect()) == sorted(r[0] for r in rows if r[1] not in have)


KINDS = ["inner", "left", "left_semi", "left_anti"]


@pytest.mark.parametrize("how", KINDS)
def test_split_join(spark, how):
    """Nulls match nothing, and the result is that of a plain join."""
    from sheetlake.operators.skew import split_join

    rows, df = skewed(spark)
    df = df.withColumn("key", F.when(F.col("seq") % 10 != 1, F.col("key")))
    pick = random.Random(5)
    names = [("hot", "Hot"), ("hot", "Hot again"), (None, "nobody")] + [
        (f"k{i}", f"K{i}") for i in range(400) if pick.random() < 0.5]
    right = spark.createDataFrame(names, "code string, label string")
    got = split_join(df, right, [("key", "code")], how)
    plain = df.join(right.withColumnRenamed("code", "key"), "key", how).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


@pytest.fixture
def splitting(spark):
    """Thresholds under which adaptive execution splits test-sized partitions."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256b",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256b",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def rows_per_task(spark, joined, tmp_path):
    """The largest part that the join's own tasks write."""
    joined.write.parquet(f"{tmp_path}/joined")
    written = spark.read.parquet(f"{tmp_path}/joined").groupBy(F.input_file_name()).count().collect()
    return max(r["count"] for r in written), sum(r["count"] for r in written)


@pytest.mark.parametrize("case", ["hot", "null", "many heavy", "types"])
def test_heavy_keys_are_dealt_to_many_tasks(spark, splitting, case, tmp_path):
    from sheetlake.operators.skew import split_join

    n = 40_000
    key = {"hot": "IF(id % 3 = 0, 7, id)", "null": "IF(id % 2 = 0, NULL, id)", "many heavy": "id % 40", "types": "IF(id % 3 = 0, 7, id)"}[case]
    kind = "INT" if case == "types" else "BIGINT"
    left = spark.range(n).repartition(16).selectExpr(f"CAST({key} AS {kind}) AS key", "id AS payload")
    right = spark.range(n).repartition(4).selectExpr("id AS code", "id * 2 AS label")
    joined = split_join(left, right, [("key", "code")], "left")
    largest, total = rows_per_task(spark, joined, tmp_path)
    assert total == n and largest <= n / 8


def test_missing_related_splits_a_heavy_key(spark, splitting, tmp_path):
    left = spark.range(40_000).repartition(16).selectExpr("IF(id % 2 = 0, -1, id) AS key", "id")
    right = spark.range(20_000).repartition(4).selectExpr("id AS code")
    largest, total = rows_per_task(spark, curated.missing_related(left, right, "key", "code"), tmp_path)
    assert total == 30_000 and largest <= 8000


def test_split_join_on_two_columns_and_mixed_types(spark):
    from sheetlake.operators.skew import split_join

    left = spark.range(1000).selectExpr("CAST(id % 7 AS INT) AS a", "id % 3 AS b", "id")
    right = spark.range(7).selectExpr("id AS x", "id % 3 AS y", "id * 10 AS z")
    expected = sum(1 for i in range(1000) if (i % 7) % 3 == i % 3)
    assert split_join(left, right, [("a", "x"), ("b", "y")]).count() == expected
    with pytest.raises(ValueError):
        split_join(left, right, [("a", "x")], "full")


def test_newest_with_null_orders_and_ties(spark):
    rows = [("a", None, "x"), ("a", None, "y"), ("b", 1, "x"), ("b", None, "y"), ("c", 2, "x"), ("c", 2, "y")]
    df = spark.createDataFrame(rows, "key string, seq int, payload string")
    found = [{r["key"]: (r["seq"], r["payload"]) for r in curated.newest_per_key(d, "key", "seq").collect()}
             for d in (df, spark.createDataFrame(rows[::-1], df.schema))]
    assert found[0] == found[1] and found[0]["b"] == (1, "x")
    assert found[0]["a"][1] in "xy" and found[0]["c"][0] == 2


def test_upsert_does_not_go_backwards(spark, tmp_path, name):
    schema = "key string, seq int, payload string"
    current = spark.createDataFrame([("a", 5, "now"), ("b", 5, "now"), ("c", None, "now"), ("d", 5, "now")], schema)
    late = spark.createDataFrame([("a", 4, "late"), ("b", 5, "same time"), ("c", None, "late"), ("d", None, "late"),
                                  ("e", None, "new"), (None, 9, "keyless")], schema)
    want = [("a", 5, "now"), ("b", 5, "same time"), ("c", None, "late"), ("d", 5, "now"), ("e", None, "new")]
    assert sorted(map(tuple, curated.upsert(current, late, "key", "seq").collect())) == want
    curated.create_curated(spark, name, schema, "key", 2, f"file://{tmp_path}/{name}")
    for part in (current, late, late):
        curated.upsert_table(spark, name, part, "seq")
    assert sorted(map(tuple, spark.table(name).drop(curated.BUCKET).collect())) == want


def test_summary_keeps_all_digits(spark):
    df = spark.sql("SELECT CAST(0.004 AS DECIMAL(10,3)) AS d, 9007199254740993 AS n, 0.25D AS f FROM range(1000)")
    got = curated.report_summary(df, ["d", "n", "f"]).first()
    assert (str(got.d_sum), str(got.d_min), int(got.n_sum), got.f_sum) == ("4.000", "0.004", 9007199254740993000, 250.0)
    huge = spark.sql("SELECT CAST('12345678901234567890.5' AS DECIMAL(38,1)) AS d")
    assert str(curated.report_summary(huge, ["d"]).first().d_sum) == "12345678901234567890.5"


def test_as_of_with_equal_times(spark, tmp_path):
    from datetime import datetime

    at = [datetime(2024, 1, 1, 0, 0, s) for s in (1, 2)]
    rows = [(1, at[0], 1, "view", 1.0, ""), (2, at[1], 1, "view", 2.0, ""), (3, at[1], 1, "purchase", 0.0, ""),
            (4, at[1], 1, "view", 3.0, "")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
                          ).write.parquet(str(tmp_path / "events.parquet"))
    assert [r.view_id for r in all_queries()["sql_asof"](spark, str(tmp_path)).collect()] == [1]


def test_months_over_two_centuries(spark, tmp_path):
    spark.sql("SELECT timestamp_ntz'1900-03-01' + make_interval(years) AS o_orderdate, 500000D AS o_totalprice "
              "FROM (SELECT explode(array(0, 7, 210)) AS years)").write.parquet(str(tmp_path / "orders.parquet"))
    got = all_queries()["sql_recursive"](spark, str(tmp_path)).collect()
    assert len(got) == 210 * 12 + 1 and sum(r.order_count for r in got) == 3
    assert len({(r.year, r.month) for r in got}) == len(got)


def test_files_that_arrive_later_are_read(spark, tmp_path):
    from sheetlake.sources.tables import open_parquet

    for n in (3, 6):
        spark.range(3).write.mode("append").parquet(str(tmp_path / "grows.parquet"))
        assert open_parquet(spark, str(tmp_path), "grows").count() == n


def test_relationship_join_renames_clashes(spark):
    rows, df = skewed(spark)
    names = spark.createDataFrame([("hot", "Hot", "x")] + [(f"k{i}", f"K{i}", "y") for i in range(0, 400, 2)],
                                  "code string, label string, payload string")
    got = curated.join_related(df, names, [("key", "code")], "left")
    assert got.columns == ["seq", "key", "payload", "row_hash", "label", "right_payload"]
    assert got.count() == len(rows)
    assert got.where("label IS NOT NULL").count() == sum(
        1 for r in rows if r[1] == "hot" or int(r[1][1:]) % 2 == 0)


def test_as_of_with_a_busy_user(spark, tmp_path):
    """A third of the events belong to one user, many within the same minute."""
    from datetime import datetime, timedelta

    pick = random.Random(3)
    start = datetime(2024, 1, 1)
    rows, at = [], start
    for i in range(3000):
        at += timedelta(milliseconds=pick.choice((1, 500, 20000, 200000)))
        rows.append((i, at, 1 if i % 3 == 0 else 2 + pick.randrange(50), pick.choice(("view", "purchase", "click")),
                     float(i), "{}"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
                          ).write.parquet(str(tmp_path / "events.parquet"))
    last, expected = {}, []
    for i, ts, user, kind, value, _ in rows:
        if kind == "view":
            last[user] = (i, ts, value)
        elif kind == "purchase":
            expected.append((i, user, *last.get(user, (None, None, None))))
    got = all_queries()["sql_asof"](spark, str(tmp_path)).select(
        "event_id", "user_id", "view_id", "view_ts", "view_value").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_first_bad_batch_in_one_large_sheet(spark):
    checked = mapping.normalize_rows(fx.raw_orders(spark, FOLDER), fx.ORDER_MAPPING)
    got = load.first_bad_batch(checked, F.col("row_number") - 1, batch_rows=100).select("row_number").collect()
    bad = sorted(r["row_number"] for r in checked.where(F.size("errors") > 0).collect())
    first = min((n - 2) // 100 for n in bad)
    assert sorted(r["row_number"] for r in got) == [n for n in bad if (n - 2) // 100 == first]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["clean_number", "normalize_mapping", "coerce_to_schema", "import_errors", "header_report",
                                 "header_extra", "row_hash", "business_key", "raw_rows", "json_extract"])
def test_row_work_does_not_shuffle(spark, key):
    assert "Exchange" not in plan(all_queries()[key](spark, FOLDER))


@pytest.mark.parametrize("key", list(all_queries()))
def test_no_pair_products(spark, key):
    if key == "sql_join_cross":
        return  # its right side is one row by construction
    if key.startswith(("load_", "import_", "landing", "scan_", "header_scan", "target_", "restore_", "run_", "id_two")):
        return  # these act when called; the comparison tests run them
    shown = plan(all_queries()[key](spark, FOLDER))
    assert "CartesianProduct" not in shown and "BroadcastNestedLoopJoin" not in shown


def test_bad_row_filter_does_not_repeat_the_typing(spark):
    shown = plan(mapping.row_errors(load.coerce_rows(fx.raw_orders(spark, FOLDER), fx.ORDER_TARGET)))
    assert shown.count("not a date") == 1


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    shown = plan(all_queries()["sql_filter"](spark, FOLDER))
    assert "PushedFilters" in shown and "GreaterThanOrEqual(o_orderdate" in shown
    narrow = plan(all_queries()["sql_having"](spark, FOLDER))
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_extendedprice:double>" in narrow
