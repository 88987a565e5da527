"""Cell parsing against a small Python model of the same rules."""

import math
import re
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetlake.functions.assign import ASSIGN
from sheetlake.functions.cells import WHITESPACE, iso_text, strip
from sheetlake.functions.keys import number_text, row_hash
from sheetlake.operators.mapping import normalize_rows

NUMBER = re.compile(r"[+-]?(Infinity|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)\Z")


def typed(spark, values, kind):
    """(value, error) per input text, in input order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_number int, raw string")
    out = normalize_rows(df, {"raw": {"field": "v", "type": kind}})
    return [(r["v"], r["errors"].get("v")) for r in out.orderBy("row_number").collect()]


def model_number(text):
    text = (text or "").strip(WHITESPACE)
    if not text:
        return None, None
    bare = text.replace("$", "").replace(",", "").strip(WHITESPACE)
    if not NUMBER.match(bare):
        return None, "Invalid number value"
    return float(bare), None


def model_boolean(text):
    text = (text or "").strip(WHITESPACE).lower()
    if not text:
        return None, None
    if text in ("true", "yes", "1"):
        return True, None
    if text in ("false", "no", "0"):
        return False, None
    return None, "Invalid boolean value"


cell = st.one_of(
    st.none(),
    st.text(alphabet="0123456789.,$+-eE \t ", max_size=9),
    st.sampled_from(["TRUE", " yes　", "No", "0", "1", "on", "t", "Infinity", "-Infinity", "NaN", "0x1F", "1_000",
                     "5d", "1f", "$", "$ 5", "1,2,3", "1e3", ".5", "5.", ".", "+-1", "﻿7﻿"]),
    st.floats(allow_nan=False, allow_infinity=False, width=32).map(repr),
    st.text(max_size=5).filter(lambda t: "\x00" not in t and not any(0xD800 <= ord(c) < 0xE000 for c in t)))
slow = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


@slow
@given(st.lists(cell, min_size=40, max_size=80))
def test_number_model(spark, values):
    for value, got in zip(values, typed(spark, values, "number")):
        assert got == model_number(value), repr(value)


@slow
@given(st.lists(cell, min_size=40, max_size=80))
def test_boolean_model(spark, values):
    for value, got in zip(values, typed(spark, values, "boolean")):
        assert got == model_boolean(value), repr(value)


@slow
@given(st.lists(st.floats(min_value=-60000, max_value=200000), min_size=40, max_size=80))
def test_serial_model(spark, values):
    def model(v):
        ms = -2209161600000.0 + v * 24 * 60 * 60 * 1000
        return datetime(1970, 1, 1) + timedelta(milliseconds=math.trunc(ms))

    for value, (got, error) in zip(values, typed(spark, [repr(v) for v in values], "date")):
        assert error is None and got == model(value), value


@pytest.mark.parametrize("text,expected", [
    ("2024-01-05", datetime(2024, 1, 5)),
    ("2024-01-05T10:30", datetime(2024, 1, 5, 10, 30)),
    ("2024-01-05 10:30:15", datetime(2024, 1, 5, 10, 30, 15)),
    ("2024-01-05T10:30:15.1239Z", datetime(2024, 1, 5, 10, 30, 15, 123000)),
    ("2024-01-05T01:30:00+02:00", datetime(2024, 1, 4, 23, 30)),
    ("2024-01-05T01:30-0530", datetime(2024, 1, 5, 7, 0)),
    ("1/5/2024", datetime(2024, 1, 5)),
    ("12/31/1999", datetime(1999, 12, 31)),
    ("Feb 9, 2021", datetime(2021, 2, 9)),
    ("september 30, 2021", datetime(2021, 9, 30)),
    ("45292", datetime(2024, 1, 1)),
    ("45292.5", datetime(2024, 1, 1, 12)),
    ("0", datetime(1899, 12, 30)),
])
def test_date_forms(spark, text, expected):
    assert typed(spark, [f" {text} "], "date") == [(expected, None)]


def test_bad_dates(spark):
    bad = ["2024-02-30", "2/30/2024", "13/1/2024", "soon", "Foo 5, 2024", "Infinity", "1e20", "2024-1-5x"]
    assert typed(spark, bad, "date") == [(None, "Invalid date value")] * len(bad)
    assert typed(spark, ["", "  ", None], "date") == [(None, None)] * 3


def test_strip_covers_unicode_space(spark):
    text = WHITESPACE + "a b" + WHITESPACE
    assert spark.createDataFrame([(text,)], "t string").select(strip("t")).first()[0] == "a b"


def test_iso_text(spark):
    rows = [(datetime(2024, 1, 5, 10, 30, 15, 123456), "2024-01-05T10:30:15.123Z"),
            (datetime(1, 2, 3), "0001-02-03T00:00:00.000Z")]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t timestamp_ntz")
    assert [r[0] for r in df.select(iso_text(F.col("t"))).collect()] == [e for _, e in rows]
    far = spark.sql("SELECT timestampadd(YEAR, 10000, TIMESTAMP_NTZ'2024-01-05 00:00:00') AS t")
    assert far.select(iso_text(F.col("t"))).first()[0] == "+012024-01-05T00:00:00.000Z"


@pytest.mark.parametrize("value,text", [
    (100.0, "100"), (0.5, "0.5"), (-0.0, "0"), (1e21, "1e+21"), (1.5e-7, "1.5e-7"), (1e-7, "1e-7"), (1e7, "10000000"),
    (12345678.9, "12345678.9"), (0.000123, "0.000123"), (0.1 + 0.2, "0.30000000000000004"),
    (123456789012345670000.0, "123456789012345670000"), (float("nan"), None), (float("inf"), None)])
def test_number_text(spark, value, text):
    assert spark.createDataFrame([(value,)], "v double").select(number_text(F.col("v"))).first()[0] == text


def test_row_hash_is_of_sorted_json(spark):
    import hashlib

    df = spark.createDataFrame(
        [("x\"y\n", 1, 2.5, 3.0, None, True, datetime(2024, 1, 5))],
        "zeta string, b int, a double, whole double, gone string, ok boolean, at timestamp_ntz")
    text = ('{"a":2.5,"at":"2024-01-05T00:00:00.000Z","b":1,"gone":null,"ok":true,"whole":3,'
            '"zeta":"x\\"y\\n"}')
    assert df.select(row_hash(df)).first()[0] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("type_name,text,value,error", [
    ("INTEGER", "2147483647", 2147483647, None),
    ("INTEGER", "2147483648", None, 'value "2147483648" is out of range for type integer'),
    ("INTEGER", "12.7", None, 'invalid input syntax for type integer: "12.7"'),
    ("NUMERIC", "1e3", 1000, None),
    ("NUMERIC", "$5", None, 'invalid input syntax for type numeric: "$5"'),
    ("NUMERIC", "1e40", None, "numeric field overflow"),
    ("BOOLEAN", "Y", True, None), ("BOOLEAN", "off", False, None),
    ("BOOLEAN", "o", None, 'invalid input syntax for type boolean: "o"'),
    ("DATE", "soon", None, 'invalid input syntax for type date: "soon"'),
    ("TIMESTAMP", "x", None, 'invalid input syntax for type timestamp: "x"'),
    ("TEXT", "anything", "anything", None),
])
def test_assignment(spark, type_name, text, value, error):
    from sheetlake.operators.catalog import TargetColumn, TargetTable
    from sheetlake.operators.load import coerce_rows

    df = spark.createDataFrame([(1, text)], "row_number int, c string")
    row = coerce_rows(df, TargetTable("t", (TargetColumn("c", type_name),))).first()
    assert row["c"] == value and row["errors"].get("c") == error
    assert type_name in ASSIGN


def test_json_is_exactly_one_value(spark):
    from sheetlake.operators.catalog import TargetColumn, TargetTable
    from sheetlake.operators.load import coerce_rows

    good = ['{"a": [1, 2]}', "[1]", "5", '"x"', "null", ' {"b": null} ']
    bad = ['{"a": 1', "1, 2", "1] , [2", "1}, {2", '"k": 1}', '1, "b": 2', "tru", "{} {}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "row_number int, j string")
    out = coerce_rows(df, TargetTable("t", (TargetColumn("j", "JSONB"),))).orderBy("row_number")
    failed = [bool(r["errors"]) for r in out.select("row_number", "errors").collect()]
    assert failed == [False] * len(good) + [True] * len(bad)
    assert isinstance(out.schema["j"].dataType, T.VariantType)
