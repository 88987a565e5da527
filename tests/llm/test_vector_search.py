"""One-bit codes: recall against brute force, exact scores, ties, unusable rows."""

import math

import numpy as np
import pytest
from sheetlake.llm import vector_search as V
from sheetlake.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, row string, dim string"


def brute_force(rows, every, nearest):
    good = [(i, np.array(v, float)) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for n, (query, q) in enumerate(good):
        if query is None or query % every:
            continue
        scored = sorted((-float((v * q).sum()), math.inf if i is None else i, i)
                        for m, (i, v) in enumerate(good) if m != n and len(v) == len(q))
        out.setdefault(query, []).append([(i, -s) for s, _, i in scored[:nearest]])
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], SCHEMA)
    out = {}
    for r in sorted(V.nearest_neighbours(df, **options).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    return out


def as_floats(matrix):
    return [[float(np.float32(x)) for x in row] for row in matrix]


@pytest.mark.parametrize("block,query_block", [(100, 10), (8192, 8192)])
def test_recall_and_scores(spark, block, query_block):
    rng = np.random.default_rng(0)
    rows = list(enumerate(as_floats(rng.standard_normal((900, 48)) + 0.5)))
    got, want = found(spark, rows, block=block, query_block=query_block), brute_force(rows, 20, 20)
    assert set(got) == set(want)
    hits = 0
    for query, near in got.items():
        assert [n[2] for n in near] == list(range(1, 21))
        hits += len({n[0] for n in near} & {i for i, _ in want[query][0]})
        truth = dict(want[query][0])
        assert all(abs(s - truth[i]) < 1e-12 for i, s, _ in near if i in truth)
    assert hits >= 0.97 * 20 * len(got)


def test_unusable_rows_ties_and_few_candidates(spark):
    one = [1.0, 2.0, 0.0, 0.5]
    rows = [(0, one), (5, None), (6, [0.0] * 4), (7, [1.0, None, 0.0, 0.0]), (8, [math.nan, 1.0, 1.0, 1.0]),
            (9, [math.inf, 1.0, 1.0, 1.0]), (30, one), (2, one), (None, one), (20, [1.0, 0.0, 0.0, 0.0]),
            (40, []), (60, [1.0, 2.0]), (3, one), (3, one)]
    got = found(spark, rows)
    assert [n[0] for n in got[0]] == [2, 3, 3, 30, None, 20]
    assert [n[0] for n in got[20]] == [0, 2, 3, 3, 30, None]
    assert set(got) == {0, 20}


def test_many_copies_of_one_vector(spark):
    rng = np.random.default_rng(2)
    base = as_floats(rng.standard_normal((1, 16)))[0]
    rows = [(i, base) for i in range(300)] + list(enumerate(as_floats(rng.standard_normal((50, 16))), 1000))
    got = found(spark, rows, block=64)
    assert [n[0] for n in got[40]] == list(range(20))
    assert [n[0] for n in got[0]] == list(range(1, 21))


def test_empty_table(spark):
    assert found(spark, []) == {} and found(spark, [(1, [1.0, 2.0])]) == {} and found(spark, [(0, [1.0])]) == {}


def test_recall_on_the_given_table(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute_force(rows, 20, 20)
    got = {}
    for r in V.nearest_neighbours(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[q] & {i for i, _ in w[0]}) for q, w in want.items())
    assert hits >= 0.97 * 20 * len(want)
