"""Clusters against plain whole-number rounds."""

import hashlib
import math

import numpy as np
import pytest
from sheetlake.llm import clustering as C

SCHEMA = "vec_id long, embedding array<float>, cluster string, ids string"


def plain(rows, clusters=16, rounds=3, dimensions=64, scale=64, seed=1):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, v) for i, v in kept if max(map(abs, v)) <= C.largest_component(dimensions)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            mine = [v for (_, v), a in zip(kept, at) if a == n]
            if mine:
                centroids[n] = [sum(column) // len(mine) for column in zip(*mine)]
    found = [(i, *nearest(v)) for i, v in kept]
    own = {n: sum(d for _, d, m in found if m == n) for _, _, n in found}
    return sorted((str(i), n, d, own[n], sum(own.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest())
                  for i, d, n in found)


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], SCHEMA)
    out = C.cluster_report(df, **options)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert [t for _, t in out.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
    return sorted((str(r[0]), *r[1:]) for r in out.collect())


def as_rows(matrix):
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(matrix)]


def test_rounds(spark):
    rng = np.random.default_rng(0)
    rows = as_rows(rng.standard_normal((400, 64)) * rng.choice([0.05, 1, 3], (400, 1)))
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, clusters=3, rounds=1) == plain(rows, 3, 1)


def test_unusable_rows_ties_and_repeats(spark):
    one = [0.5] * 64
    rows = [(0, one), (1, one), (1, [-0.01] * 64), (None, one), (None, [1.0] * 64), (2, None), (3, [0.1] * 63), (4, [0.1] * 65), (5, []),
            (6, [None] + [0.1] * 63), (7, [math.nan] + [0.1] * 63), (8, [math.inf] + [0.1] * 63), (9, [3e38] * 64), (10, [0.0] * 64),
            (11, [-2.0e6] * 64), (12, [2.0e6] * 64)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, clusters=2) == plain(rows, 2)


def test_long_vectors_and_many_values(spark):
    rng = np.random.default_rng(3)
    rows = as_rows(rng.standard_normal((90, 700)) * 1000)
    assert found(spark, rows, dimensions=700, clusters=4) == plain(rows, 4, dimensions=700)


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_blocks_give_the_vectors_back(spark, size):
    rng = np.random.default_rng(4)
    rows = as_rows(rng.standard_normal((50, 64)))
    vectors = C.whole_vectors(spark.createDataFrame([(i, v, "a", "b") for i, v in rows], SCHEMA), 64, 64, "vec_id", "embedding")
    centroids = np.zeros((1, 64), np.int64)
    got = {}
    for batch in C.blocks(vectors, size).toArrow().to_batches():
        for ids, matrix, _, distance in C.assigned(batch, centroids):
            got |= {i: (m.tolist(), d) for i, m, d in zip(ids, matrix, distance)}
    want = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    assert {i: g[0] for i, g in got.items()} == want and all(d == sum(x * x for x in m) for m, d in got.values())


def test_few_vectors_and_none(spark):
    assert found(spark, []) == [] and found(spark, [(1, [1.0])]) == []
    rows = as_rows(np.random.default_rng(5).standard_normal((5, 64)))
    assert found(spark, rows) == plain(rows)
