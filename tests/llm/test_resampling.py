"""Weights, scores and draws against the definition."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from sheetlake.llm import resampling as R
from sheetlake.llm.common import table

SCHEMA = "doc_id long, text string, n_words string, __row string, score string"


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(rows, target, runs=(1, 1), buckets=10000, least=20, percent=10, seed=2024):
    def features(text):
        words = plain_words(text)
        return [zlib.crc32(" ".join(words[i:i + n]).encode()) % buckets
                for n in range(runs[0], runs[1] + 1) for i in range(len(words) - n + 1)]
    s = Counter(f for _, t in rows for f in features(t))
    t = Counter(f for text in target for f in features(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(float(t[b] + 1) * (all_s + buckets) / (float(s[b] + 1) * (all_t + buckets)))) for b in range(buckets)}
    out = []
    for place, (doc, text) in enumerate(rows):
        own = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[f] for f in own)
        out.append([doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, place,
                    len(plain_words(text)) >= least])
    fit = sorted((o for o in out if o[6]), key=lambda o: (-o[3], o[0] is None, o[0] or 0, o[5]))
    for rank, o in enumerate(fit[:len(fit) * percent // 100], 1):
        o[4] = rank
    return sorted(tuple(map(str, o[:5])) for o in out)


def rows_of():
    rng = random.Random(1)
    words = ["Alpha", "beta9", "É", "ß", "漢字", "x", "don't", "a_b", "Z", "\x00", "naïve", "—", "1,000"]
    rows = [(rng.randint(0, 300), rng.choice([" ", "\n", "-"]).join(rng.choices(words, k=rng.choice([0, 1, 19, 20, 21, 60])))) for _ in range(300)]
    return rows + [(None, "alpha beta " * 15), (None, "alpha beta " * 15), (None, None), (7, ""), (8, "word " * 30000), (9, "é" * 5000),
                   (7, "x y " * 20), (7, "x y " * 20)]


def found(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


@pytest.mark.parametrize("runs", [(1, 1), (1, 2), (2, 3)])
def test_matches_the_definition(spark, runs):
    rows, target = rows_of(), ["alpha naïve É", None, "", "don't don't 漢字 x"]
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], SCHEMA).coalesce(1)
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = R.importance_ranks(docs, wanted, runs=runs, percent=40)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 5 or dict(got.dtypes)["rank"] in ("bigint", "int")
    assert found(got) == plain(rows, target, runs, percent=40)


def test_offsets():
    text = "Über-Straße, 1a É\nZ"
    assert [(w, text[a:b].lower() if w.isascii() else text[a:b]) for w, (a, b) in R.word_offsets(text)] == [
        ("Über", "Über"), ("straße", "Straße"), ("1a", "1a"), ("É", "É"), ("z", "z")]


def test_drawn_rows_keep_their_columns(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], SCHEMA).coalesce(1)
    wanted = spark.createDataFrame([("alpha naïve",)], "text string")
    drawn = R.resampled_documents(docs, wanted, percent=30)
    assert drawn.columns == docs.columns
    want = Counter(p[0] for p in plain(rows, ["alpha naïve"], percent=30) if p[4] != "None")
    assert Counter(str(r.doc_id) for r in drawn.collect()) == want


def test_ranks_across_many_ranges(spark):
    docs = spark.range(4000).selectExpr("id % 1500 AS doc_id", "repeat('alpha beta gamma delta ', 6) AS text")
    wanted = spark.createDataFrame([("alpha",)], "text string")
    ranks = [r["rank"] for r in R.importance_ranks(docs, wanted, percent=50).where("rank IS NOT NULL").orderBy("score", ascending=False).collect()]
    assert sorted(ranks) == list(range(1, 2001))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    rows = [(1, "some words here"), (2, None)]
    some = spark.createDataFrame([(i, t, "", "", "") for i, t in rows], SCHEMA)
    assert R.importance_ranks(docs, some).count() == 0 and R.resampled_documents(docs, some).count() == 0
    assert found(R.importance_ranks(some, docs)) == plain(rows, [])


def test_given_table(spark):
    docs, target = (table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "benchmark"))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert found(R.importance_ranks(docs, target)) == plain(rows, [r.text for r in target.collect()])
