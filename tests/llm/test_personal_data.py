"""Seeds against plain patterns in Python, discovery of unseen identifiers, odd rows."""

import hashlib
import random
import re

from sheetlake.llm import personal_data as P
from sheetlake.llm.common import table

SCHEMA = "doc_id long, text string, kind string, start string, value string"
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for n, d in enumerate(map(int, reversed(digits))):
        total += d if n % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def seeds(text):
    found = [(m.start(), n, m.end(), k) for n, (k, p) in enumerate(PLAIN.items())
             for m in re.finditer(p, text or "") if good(k, m.group())]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], SCHEMA)
    return P.personal_data(docs).collect()


def checked(rows, out):
    assert len(rows) == len(out)
    want = sorted((str(i), ",".join(seeds(t))) for i, t in rows)
    shas = sorted((str(r.doc_id), r.base_sha256) for r in out)
    assert shas == sorted((i, hashlib.sha256(s.encode()).hexdigest()) for i, s in want)
    for kind in PLAIN:
        assert sorted((str(r.doc_id), r[f"n_{kind}"]) for r in out) == sorted(
            (str(i), sum(s.startswith(kind) for s in seeds(t))) for i, t in rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for r in out:
        spans = r.spans.split(",") if r.spans else []
        assert any(set(seeds(t)) <= set(spans) for t in texts[r.doc_id])
        keys = [(int(s.split(":")[1]), P.KINDS.index(s.split(":")[0])) for s in spans]
        assert keys == sorted(keys)


ODD = ["", None, "a@b.c", "a@b.c_d@e.f", "x@y", "@@a.b@c.d@e.f", "é😀a.b+c@d-e.fr, 1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.255",
       "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "4111 1111 1111 1112", "+1 (555) 123-4567 +12 +1((((",
       "1" * 6000, "a" * 40000, "a." * 9000 + "@", "x@" + "b." * 9000 + "c", "+1" + "(" * 5000, "1 " * 8000, "12-" * 4000,
       "a@b.c" * 50, "1.2.3.4" * 20, "+1 555 123 4567+1 555 123 4567"]


def test_odd_texts(spark):
    rng = random.Random(6)
    rows = list(enumerate(ODD)) + [(None, "mail a@b.c"), (3, "mail a@b.c"), (3, "mail a@b.c")]
    rows += [(100 + i, "".join(rng.choices("ab1.2@+- ()9é😀\n%_", k=80))) for i in range(600)]
    checked(rows, run(spark, rows))


def test_unseen_identifiers_are_discovered(spark):
    rng = random.Random(3)
    rows = []
    for i in range(30):
        rows.append((i, f"Please call my phone: +1 555 {rng.randint(100, 999)} {rng.randint(1000, 9999)} today"))
    rows += [(100, "word word my phone: 555-123-4567 today"), (101, "my phone: 555-987-6543"),
             (102, "the year is 20156 and room 12345"), (103, "MY PHONE: (555-111-2222).")]
    out = {r.doc_id: r for r in run(spark, rows)}
    checked(rows, list(out.values()))
    assert out[100].spans == "phone:20:32" and out[101].spans == "phone:10:22"
    assert out[102].spans == "" and out[103].spans == "phone:10:24"
    assert out[100].n_phone == 0


def test_second_round_learns_from_discovered_identifiers(spark):
    rows = [(i, f"reach us at u{i}@x.org now") for i in range(10)]
    rows += [(20 + i, f"reach us at u{i}#corp{i} now") for i in range(3)]  # accepted by the first pattern
    rows += [(30 + i, f"the old handle u{i}#corp{i} there") for i in range(3)]  # which bear out a second one
    rows += [(40, "the old handle z9#corp9 there")]
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], SCHEMA)
    found = P.extract(docs)
    assert {(p.context, p.kind) for p in found.patterns.collect()} == {("us at", 0), ("old handle", 0)}
    out = {r.doc_id: r.spans for r in run(spark, rows)}
    assert out[40] == "email:15:23"


def test_empty_table(spark):
    assert run(spark, []) == []


def test_given_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    checked(rows, P.personal_data(docs).collect())


def test_discovery_goes_on_for_as_many_rounds_as_find_something(spark):
    """Each level's contexts are known by the identifiers of the level before, and bring three new ones."""
    known, sentences = ["ann@mail.example", "bob@mail.example", "cid@mail.example"], []
    for level in "abcdef":
        fresh = []
        for place in "xyz":
            value = f"id-{ord(level)}{ord(place)}-{level}{place}"
            fresh.append(value)
            sentences += [f"contact lead{level}{place} {v} . " for v in [*known, value]]
        known = fresh
    out = run(spark, [(n, s) for n, s in enumerate(sentences)])
    found = {sentences[r.doc_id].split()[2] for r in out if r.spans}
    assert set(known) <= found


def test_long_words_are_contexts_in_full(spark):
    rows = [(n, f"my a{'w' * 120} user{n}@mail.example") for n in range(3)] + [(3, f"my b{'w' * 120} key-77-x"),
                                                                             (4, f"my a{'w' * 120} key-88-x")]
    found = {r.doc_id: r.spans for r in run(spark, rows)}
    assert found[3] == "" and found[4] != ""
