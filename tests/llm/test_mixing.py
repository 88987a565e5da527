"""Targets by plain resharing, the schedule's evenness, pieces and odd rows."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from sheetlake.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size string, target string"


def words(text):
    return re.findall(r"[^ \t\n\x0b\x0c\r]+", text or "")


def plain_targets(sizes):
    """Repeated resharing: capped sources keep their cap, the rest is shared by weight again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    pool, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if pool * weight[s] / total > 2 * sizes[s]}
        if not over:
            target |= {s: pool * weight[s] / total for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        pool -= sum(2 * sizes[s] for s in over)
        free -= over
    return target


def samples(seed=1, n=400):
    rng = random.Random(seed)
    sources = ["hot"] * 8 + ["a", "b", "é", "Z", "😀", "", None, "tiny"]
    rows = [(i, rng.choice(["w "] * 9 + ["w\n"]) * rng.randint(0, 60), rng.choice(sources)) for i in range(n)]
    rows += [(None, "no id here", "a"), (7, "same row", "b"), (7, "same row", "b"), (9000, None, "a"), (9001, "", "none at all"),
             (9002, "x " * 5000, "long"), (9003, " \t", "hot")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", "t") for r in rows], SCHEMA)


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_targets_and_taken_words(spark, block):
    rows = samples()
    out = M.mixed_words(M.mix_sources(frame(spark, rows), block_words=block)).collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(words(text))
    targets = plain_targets(dict(sizes))
    assert sorted((str(r.doc_id), r.size) for r in out) == sorted((str(i), len(words(t))) for i, t, _ in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    by_target = defaultdict(lambda: [0, set()])
    for r in out:
        by_target[r.target, r.source_size][0] += r.taken
    want = {(round(targets[s], 6), sizes[s]) for s in sizes}
    assert {(round(t, 6), s) for t, s in by_target} == want
    for (target, size), (taken, _) in by_target.items():
        same = sum((round(targets[s], 6), sizes[s]) == (round(target, 6), size) for s in sizes)
        assert abs(taken - same * target) <= same


def test_schedule_is_even(spark):
    """Along any stretch of the schedule each source has its share of the slots, but for a few."""
    mix = M.mix_sources(frame(spark, samples(n=800)), block_words=4)
    slots = [r["__rank"] for r in mix.schedule.orderBy("slot").collect()]
    share = {s: slots.count(s) / len(slots) for s in set(slots)}
    for upto in range(50, len(slots), 37):
        for s in share:
            assert abs(slots[:upto].count(s) - share[s] * upto) <= 12
    per_source = mix.schedule.groupBy("__rank").agg(F.count("*").alias("n"), F.max("block").alias("m"), F.countDistinct("block").alias("d"))
    assert all(r.n == r.m + 1 == r.d for r in per_source.collect())


def test_bit_reversal(spark):
    df = spark.range(1 << 6).select("id", M.bit_reversed(F.col("id"), F.lit(6)).alias("r"))
    assert all(r.r == int(f"{r.id:06b}"[::-1], 2) for r in df.collect())
    big = spark.sql("SELECT 5L AS v, 62 AS b").select(M.bit_reversed(F.col("v"), F.col("b")).alias("r")).first().r
    assert big == int(f"{5:062b}"[::-1], 2)


def test_documents_of_the_mix(spark):
    rows = samples(3)
    docs = frame(spark, rows)
    taken = {}
    for r in M.mixed_words(M.mix_sources(docs)).collect():
        taken.setdefault(r.doc_id, []).append(r.taken)
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got, texts = defaultdict(int), defaultdict(set)
    for r in mixed.collect():
        got[r.doc_id] += len(words(r.text))
        texts[r.doc_id].add(r.text)
    assert {d: n for d, n in got.items() if n} == {d: sum(n) for d, n in taken.items() if sum(n)}
    assert all(any(i == d and (text or "").startswith(t) for i, text, _ in rows) for d, some in texts.items() for t in some)


def test_reruns_agree_and_empty_tables(spark):
    rows = samples(5)
    one, two = (sorted((str(r.doc_id), r.size, r.taken) for r in M.mixed_words(M.mix_sources(frame(spark, some))).collect())
                for some in (rows, rows[::-1]))
    assert one == two
    for some in ([], [(1, None, "a")], [(1, " ", None)]):
        out = M.mixed_words(M.mix_sources(frame(spark, some))).collect()
        assert len(out) == len(some) and all(r.taken == 0 and r.target == 0 for r in out)
        assert M.mixed_documents(frame(spark, some)).count() == 0
