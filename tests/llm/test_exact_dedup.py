"""Exact groups against plain Python, many runs, odd rows."""

import hashlib
import random
from collections import defaultdict

import pytest
from sheetlake.llm import exact_dedup as E

SCHEMA = "doc_id long, text string, keep_id string, run string"


def bare(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def plain(rows):
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        groups[bare(text)].append((-len(text or ""), doc is None, doc or 0, i))
    out = []
    for text, members in groups.items():
        keep = rows[min(members)[3]][0]
        sha = hashlib.sha256(text.encode()).hexdigest()
        for n, m in enumerate(sorted(members)):
            out.append((str(rows[m[3]][0]), str(keep), len(members), n == 0, sha))
    return sorted(out)


def samples():
    rng = random.Random(7)
    texts = ["", " ", None, "a b", "ab", "a\tb ", "é x", "é x", "x" * 50000] + ["t%d" % (i % 40) for i in range(100)]
    rows = [(rng.choice([None, *range(30)]), rng.choice(texts)) for _ in range(600)]
    return rows + [(5, "same row")] * 4 + [(None, "no id")] * 3


def frame(spark, rows, parts=8):
    return spark.createDataFrame([(d, t, "k", "r") for d, t in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("parts", [1, 3, 8, 70])
def test_groups(spark, parts):
    rows = samples()
    out = E.exact_duplicates(frame(spark, rows, parts))
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in out.collect()) == plain(rows)


def test_kept_documents(spark):
    rows = samples()
    kept = E.drop_duplicates(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "keep_id", "run"]
    got = sorted((str(r.doc_id), bare(r.text)) for r in kept.collect())
    want = sorted((d, s) for d, _, _, k, s in plain(rows) if k)
    assert [(d, hashlib.sha256(t.encode()).hexdigest()) for d, t in got] and sorted(
        (d, hashlib.sha256(t.encode()).hexdigest()) for d, t in got) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert E.exact_duplicates(docs).count() == 0 and E.drop_duplicates(docs).count() == 0


def test_rounds_merge_eight_runs(spark):
    """64 runs meet in two rounds; a digest in all of them enters the last round at most eight times."""
    records = E.digest_rows(frame(spark, [(i, "same") for i in range(640)], 64))
    plan = E.merge_runs(records)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("shiftright(") - plan.count("shiftrightunsigned(") <= 2 and plan.count("Aggregate") == 3
    assert E.merge_runs(records).first()["__size"] == 640
