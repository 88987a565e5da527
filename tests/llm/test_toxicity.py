"""The string kernel against its definition, held-out accuracy, odd rows."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from sheetlake.llm import toxicity as T
from sheetlake.llm.common import table

DOCS = "doc_id long, text string, held_out string, decision string, score string"
LABELS = "doc_id long, quality int, toxic int"


def plain_vector(unit):
    text = "^" + unit + "$"
    out = Counter()
    for i, j, k in itertools.combinations(range(len(text)), 3):
        if k - i < T.SPAN and all(c.isalpha() or c in "^$" for c in (text[i], text[j], text[k])):
            out[text[i], text[j], text[k]] += T.DECAY ** (k - i + 1)
    return out


def plain_kernel(a, b):
    x, y = plain_vector(a), plain_vector(b)
    return sum(x[u] * y[u] for u in x) / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def test_kernel_matches_its_definition():
    units = ["idiot", "i.d.i.o.t", "idxiot", "abab", "aaa", "ab", "q", "banana", "worthlessness", "st*upid"]
    kernels = T._kernels(units, units)
    for i, a in enumerate(units):
        for j, b in enumerate(units):
            assert abs(kernels[i, j] - plain_kernel(a, b)) < 1e-5
    weights = T._table(units) @ np.arange(1, len(units) + 1, dtype=np.float32)
    assert np.allclose(T.unit_decisions(units, weights, 0.5), kernels @ np.arange(1, len(units) + 1) + 0.5, atol=1e-4)


def test_decision_is_the_nystrom_machine():
    toxic = ["idiot", "moron", "stupid", "clown"]
    clean = ["thereof", "nation", "edition", "stupendous", "motion", "crown", "other", "ration"]
    weights, bias, marks = T.fit_units(toxic, clean)
    value = T.unit_decisions(toxic + clean, weights, bias)
    assert (value[:4] > 0.5).all() and (value[4:] < -0.5).all() and set(marks) <= set(toxic + clean)
    gapped = T.unit_decisions(["mo-ron", "i.diot", "stuxpid", "cl.own"], weights, bias)
    assert (gapped > value[4:].max()).all()


def test_long_units_are_read_to_the_end():
    weights, bias, _ = T.fit_units(["idiot"], ["nation", "other"])
    end, none = "x." * 2500 + "idiot", "x." * 2503
    assert T.unit_decisions([end], weights, bias)[0] > T.unit_decisions([none], weights, bias)[0] + 0.05


def test_units():
    assert T.text_units("You, i d i o t! (Really)") >= {"you", "idiot", "really"}
    assert T.text_units("a b") == {"a", "b"} and T.text_units("") == set()


def pages(n, seed=0):
    rng = random.Random(seed)
    syllables = ["ta", "re", "mi", "no", "ster", "ing", "ble", "con", "pa", "lo"]
    insults = ["idiot", "moron", "worthless"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(60)]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(insults))
        docs.append((i, " ".join(words), "a", "b", "c"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_pages_and_odd_rows(spark):
    docs, labels = pages(400)
    odd = [(1000, None), (1001, ""), (1002, " \n"), (1003, "word " * 20000 + "idiot"), (1003, "ta re mi"),
           (None, "you moron"), (1004, "m o r o n"), (1005, "wor*thless you are")]
    rows = spark.createDataFrame(docs + [(i, t, "a", "b", "c") for i, t in odd], DOCS)
    marks = spark.createDataFrame(labels + [(1000, 1, None), (None, 1, 1), (5, None, labels[5][2])], LABELS)
    out = T.toxicity_scores(rows, marks).collect()
    assert len(out) == len(docs) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    truth = {i: t for i, _, t in labels}
    held = [(r.predicted, truth[r.doc_id]) for r in out if r.doc_id in truth and r.held_out]
    assert len(held) > 80 and sum(p == t for p, t in held) >= 0.97 * len(held)
    by_id = {}
    for r in out:
        by_id.setdefault(r.doc_id, []).append(r)
    assert [by_id[i][0].score for i in (1000, 1001, 1002)] == [0.0] * 3
    assert sorted(r.predicted for r in by_id[1003]) == [0, 1]
    assert by_id[None][0].predicted == by_id[1004][0].predicted == by_id[1005][0].predicted == 1


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame(pages(5)[0], DOCS)
    for labels in ([], [(1, 1, 0), (2, 1, 0)], [(1, 1, 1)]):
        out = T.toxicity_scores(docs, spark.createDataFrame(labels, LABELS)).collect()
        assert len(out) == 5 and all(r.score == 0 and r.predicted == 0 for r in out)
    assert T.toxicity_scores(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


def test_given_table(spark):
    folder = "/root/testdata/sf0.1"
    labels = table(spark, folder, "labels")
    out = T.toxicity_scores(table(spark, folder, "documents"), labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in out)
    assert hit >= 0.9 * sum(r.predicted for r in out) and hit >= 0.6 * sum(r.toxic for r in out)


def test_spelled_words_of_two_letters():
    assert "ass" in T.text_units("you a s s there") and "poop" in T.text_units("P o o p!")


def test_held_out_labels_do_not_move_the_scores(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(T.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, other = T.fit_model(docs, labels), T.fit_model(docs, flipped)
    assert (one.middle, one.slope, one.bias) == (other.middle, other.slope, other.bias)
