"""SimHash components against all pairs, Golay keys against the definition."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from sheetlake.llm import simhash_dedup as S
from sheetlake.llm.common import table

SCHEMA = "doc_id long, text string, fp string, n string"


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\f\r":
            words, word = (words + [word] if word else words), ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_force(rows):
    prints = [plain_fingerprint(text) for _, text in rows]
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if bin(a ^ b).count("1") <= 2:
                parent[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for (doc, _), p in zip(rows, prints):
        if doc is not None:
            root = find(p)
            least[root] = doc if least[root] is None else min(least[root], doc)
    return sorted((str(doc), f"{p:016x}", least[find(p)]) for (doc, _), p in zip(rows, prints))


def found(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    return sorted((str(r.doc_id), r.fingerprint, r.component_id)
                  for r in S.near_duplicates(docs, **options).collect())


def samples():
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        words = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 40, 300]))
        for _ in range(rng.randint(1, 6)):
            near = list(words)
            for _ in range(rng.randint(0, 2)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            rows.append((n, rng.choice([" ", "  ", "\n"]).join(near)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 2, " \t\n"), (None, "w1 w2"), (None, "a b   É"),
             (n + 3, "W1 w2"), (n + 4, "x " * 30000)]
    return rows


@pytest.mark.parametrize("paired", [0, 1, 3, 64])
def test_components_match_all_pairs(spark, paired):
    rows = samples()
    assert found(spark, rows, paired=paired) == brute_force(rows)


def test_words_near_each_other_share_a_key():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    for flips in (0, 1, 2):
        other = base.copy()
        for i in range(len(other)):
            for b in rng.choice(64, flips, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(b)
        keys = [defaultdict(set), defaultdict(set)]
        for side, prints in zip(keys, (base, other)):
            for at, key in zip(*S.golay_keys(prints)):
                side[int(at)].add(int(key))
        assert all(keys[0][i] & keys[1][i] for i in range(len(base)))


def test_golay_code_is_perfect():
    remainders = S._remainders()
    codewords = (np.arange(4096) << 11) | remainders
    weights = np.array([bin(c).count("1") for c in codewords.tolist()])
    assert sorted(set(weights.tolist())) == [0, 7, 8, 11, 12, 15, 16, 23]
    assert len(S._errors_by_syndrome()[0]) == 1 + 23 + 253 + 1771 + 8855


def test_large_ball_without_pairs(spark):
    rng = random.Random(1)
    center = rng.getrandbits(64)
    prints = {center} | {center ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(a)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    from sheetlake.llm.graph import component_roots
    roots = component_roots(S.linked_fingerprints(df, paired=8))
    assert {r.root for r in roots.collect()} == {min(signed)} and roots.count() == len(signed) - 1


def test_empty_table_and_pipeline_form(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert S.near_duplicates(docs).count() == 0 and S.drop_near_duplicates(docs).count() == 0
    rows = [(3, "a b c d"), (1, "A b c  d"), (1, "a b c d"), (None, "a b c d"), (7, "other words here now")]
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 7]


def test_given_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect())
    assert got == brute_force(rows)
