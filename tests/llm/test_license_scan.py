"""Phrases against a plain scan, templates found whole, edited and missing, odd rows."""

import random
import re

from sheetlake.llm import license_scan as L
from sheetlake.llm.common import table

SCHEMA = "doc_id long, text string, word string, template string, idf string"


def plain(text):
    low = re.sub("[A-Z]", lambda m: chr(ord(m.group()) + 32), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in L.PHRASES for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], SCHEMA)
    return L.license_labels(docs).collect()


def checked(rows, out):
    assert sorted(map(str, ((i, *plain(t)) for i, t in rows))) == sorted(
        str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in out)
    for r in out:
        labels = r.labels.split(",") if r.labels else []
        assert labels == sorted(set(labels)) and 0 <= r.score <= 1
        assert set(r.base_labels.split(",") if r.base_labels else []) <= set(labels)
        assert (r.score > 0) == bool(labels)


ODD = ["", None, "MIT License", "mit\n-license MIT LICENSE, mit  license", "mit licenses amit license mit_license",
       "général public license General, Public; LICENSE", "KMIT license İ mit license", "mit mit license license",
       "x " * 20000 + "apache license", "mit license " * 3000, "😀mit license", "a\x00mit\x7flicense", "漢字 apache license 漢字"]


def test_phrases_in_odd_texts(spark):
    rng = random.Random(2)
    rows = list(enumerate(ODD)) + [(None, "mit license"), (2, "MIT License"), (2, "MIT License")]
    words = ["mit", "MIT", "license", "Apache", "general", "public", "the", "é", "9"]
    rows += [(100 + i, "".join(w + rng.choice([" ", "-", "\n", "", "_"]) for w in rng.choices(words, k=30))) for i in range(300)]
    checked(rows, run(spark, rows))


def filler(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(n))


def test_templates_are_found_and_verified(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for n, (label, text, _) in enumerate(L.TEMPLATES):
        rows.append((n, f"{filler(rng, 40)} {text} {filler(rng, 40)}"))
        want[n] = label
        rows.append((100 + n, "# " + text.upper().replace(" ", "\n# ")))
        want[100 + n] = label
    bsd = L.TEMPLATES[3][1]
    rows.append((200, bsd.replace("provided that", "provided by all of us that")))  # words put in
    want[200] = "bsd"
    rows.append((201, bsd.replace("source and binary forms", "binary forms")))  # key phrase broken
    rows.append((202, filler(rng, 30) + " redistribution of the above copyright notice " + filler(rng, 30)))
    rows.append((203, " ".join(sorted(bsd.split()))))
    rows += [(300 + i, filler(rng, 50) + " the and of to") for i in range(200)]
    out = {r.doc_id: r for r in run(spark, rows)}
    checked(rows, list(out.values()))
    for n, label in want.items():
        assert label in out[n].labels.split(","), (n, label, out[n])
    assert all(out[n].labels == "" and out[n].score == 0 for n in (201, 202, 203, *range(300, 500)))


def test_several_notices_in_one_file(spark):
    """Each notice keeps its label beside others, and in a long file whose other template words are rarer than its own."""
    rng = random.Random(3)
    notices = {label: text for label, text, _ in reversed(L.TEMPLATES)}  # of each label the first, which is the longest
    some = [("mit", "bsd", "apache"), ("mit", "isc", "mpl"), ("mit", "bsd", "apache", "gpl", "mpl", "unlicense")]
    rows = [(n, "\n\n".join(f"{notices[x]} {filler(rng, 30)}" for x in labels)) for n, labels in enumerate(some)]
    rare = [w for label, text, _ in L.TEMPLATES if label != "bsd" for w in L.template_words(text)
            if w not in L.template_words(notices["bsd"])]
    rows.append((10, notices["bsd"] + " " + " ".join(f"{w} {filler(rng, 20)}" for w in sorted(set(rare)))))
    rows += [(100 + i, f"{filler(rng, 20)} {notices['bsd']}") for i in range(40)]
    out = {r.doc_id: r for r in run(spark, rows + [(200 + i, filler(rng, 30)) for i in range(40)])}
    for n, labels in enumerate(some):
        assert set(labels) <= set(out[n].labels.split(",")), (n, out[n])
    assert "bsd" in out[10].labels.split(",")


def test_empty_table(spark):
    assert run(spark, []) == []


def test_given_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = L.license_labels(docs).collect()
    checked(rows, out)
    notice = {i for i, t in rows if re.search(r"licensed under CC BY-NC 4\.0", t, re.I)}
    assert notice and notice == {r.doc_id for r in out if "cc-by-nc" in r.labels.split(",")}
