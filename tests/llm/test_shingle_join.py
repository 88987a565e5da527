"""Components of similar shingle sets against all pairs."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from sheetlake.llm import shingle_join as J
from sheetlake.llm.common import table

SCHEMA = "doc_id long, text string, node string, __id string, key string"


def plain_set(text, size=5):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^ \t\n\x0b\x0c\r]+", lowered)
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute_force(rows, size=5):
    sets = [plain_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and find(i) != find(j):
                n = len(a & b)
                if 100 * n >= 80 * (len(a) + len(b) - n):
                    parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((str(doc), len(s), str(doc if not s else least.get(find(i)))) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


def found(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows], SCHEMA)
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.similar_documents(docs, **options).collect())


def near(rng, words, changes, vocabulary):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
    return words


def samples(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for _ in range(30):
        words = rng.choices(vocabulary, k=rng.choice([1, 3, 5, 6, 12, 60, 300])) + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.randint(1, 7)):
            other = near(rng, words, rng.choice([0, 1, 2, 3, 6]) if len(words) > 20 else 0, vocabulary)[:len(words) - rng.choice([0, 0, 1])]
            rows.append((len(rows), rng.choice([" ", "  ", "\n"]).join(other)))
    n = len(rows)
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 2, " \t\n"), (None, "w1 w2"), (None, "a b é  É"), (n + 3, "W1 w2"),
                   (n + 4, "x " * 30000), (n + 5, "X " * 40000), (None, None)]


@pytest.mark.parametrize("page", [4, 512])
def test_components_match_all_pairs(spark, page):
    rows = samples()
    assert found(spark, rows, page=page) == brute_force(rows)


def test_other_shingle_length(spark):
    rows = samples(8)
    assert found(spark, rows, size=2) == brute_force(rows, 2)


def test_search_alone_finds_all_links(spark):
    """Without pivots: every node apart, so that boxes, bands and pages have to find each pair."""
    rng, vocabulary = random.Random(3), [f"w{i}" for i in range(900)]
    base = rng.choices(vocabulary, k=200)
    rows = [(i, " ".join(near(rng, base, rng.choice([1, 2, 3, 5]), vocabulary)[:rng.choice([200, 190, 170])])) for i in range(90)]
    docs = spark.createDataFrame(rows, "__id long, __text string").selectExpr("__id", "xxhash64(__id) AS __at", "__text")
    nodes = J.set_nodes(docs, 5)
    index = J.indexed(docs.select("__text"), J.slot_ranks(nodes), 5)
    shared = J.entries(index)
    points = J.entered_points(docs, nodes, index, shared, 5)
    members = shared.selectExpr("key", "node", "node AS root", "0L AS major")
    by_node = {r.node: r.doc_id for r in nodes.where("node IS NOT NULL").selectExpr("node", "__id AS doc_id").collect()}
    got = {tuple(sorted((by_node[r.a], by_node[r.b]))) for r in J.searched_links(members, points, page=16).collect()}
    plain = {d: plain_set(t) for d, t in rows if d in by_node.values()}
    want = {(a, b) for a in plain for b in plain if a < b
            and 100 * len(plain[a] & plain[b]) >= 80 * len(plain[a] | plain[b])}
    assert want and got == want


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 3000), dtype=np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, max(1, len(a) // 2), replace=False), rng.integers(0, 1 << 63, 20, dtype=np.uint64)]))
        points = J._points([J.group_counts(a), J.group_counts(b)])
        assert np.minimum(*points).sum() >= len(np.intersect1d(a, b)) and points.sum() == len(a) + len(b)
    large = np.unique(np.concatenate([np.arange(70000, dtype=np.uint64) * np.uint64(J.GROUPS), a]))
    assert J._points([J.group_counts(large)]).sum() == len(large)


def test_points_of_a_batch_are_compared_a_part_at_a_time():
    rng, n = np.random.default_rng(5), 10_000
    points = [rng.integers(0, 3, J.GROUPS).astype(np.uint8).tobytes() for _ in range(n)]
    numbers, sizes = pa.array(range(n)), pa.array([sum(p) for p in points])
    others = [p if i % 2 else points[0] for i, p in enumerate(points)]
    batch = pa.RecordBatch.from_arrays([numbers, numbers, sizes, pa.array([sum(p) for p in others]), pa.array(points), pa.array(others)],
                                       ["a", "b", "s", "t", "p", "q"])
    tracemalloc.start()
    found = [x for part in J._near_points(iter([batch])) for x in part.column("a").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [i for i in range(n) if i % 2 or not i]
    assert peak < 4 * n * J.GROUPS


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(2)
    ranks = rng.permutation(1 << J.SLOT_BITS).astype(np.uint64)
    for size in [*range(1, 30), 100, 777]:
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        for gone in range(len(a) // 5 + 1):
            b = rng.choice(a, len(a) - gone, replace=False)
            assert set(J.first_shingles(a, ranks).tolist()) & set(J.first_shingles(b, ranks).tolist())


def test_one_group_of_a_third_of_all_rows(spark):
    """Near copies of one text, of which two differ too much from each other, copies, and a passage all others share."""
    rng, vocabulary = random.Random(7), [f"w{i}" for i in range(3000)]
    base, passage = rng.choices(vocabulary, k=120), rng.choices(vocabulary, k=60)
    rows = [(i, " ".join(near(rng, base, rng.choice([0, 1, 2]), vocabulary))) for i in range(500)]
    rows += [(i, " ".join(rng.choices(vocabulary, k=rng.randint(20, 90)) + passage)) for i in range(500, 1000)]
    rows += [(i, "one and the same text in many rows of the table") for i in range(1000, 1500)]
    rng.shuffle(rows)
    assert found(spark, rows) == brute_force(rows)


def test_text_ids_and_empty_table(spark):
    docs = spark.createDataFrame([("b", "one two three"), ("a", "One two  three"), ("c", None)], "doc_id string, text string")
    assert sorted(tuple(r) for r in J.similar_documents(docs).collect()) == [("a", 1, "a"), ("b", 1, "a"), ("c", 0, "c")]
    assert J.similar_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_given_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.similar_documents(docs).collect())
    assert got == brute_force([(r.doc_id, r.text) for r in docs.collect()])
