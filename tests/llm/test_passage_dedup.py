"""Repeated passages against a plain scan in ranked order."""

import random
import re

import pytest
from sheetlake.llm import passage_dedup as D
from sheetlake.llm.common import table

SCHEMA = "doc_id long, text string, units string, __row string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows, least):
    """``{row number: (units, removed units, spans)}`` and the kept texts."""
    ranked = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, out, kept = set(), {}, {}
    for i in ranked:
        text = rows[i][1] or ""
        words = [(m.start(), m.end(), lowered(m.group())) for m in re.finditer(r"[^ \t\n\x0b\x0c\r]+", text)]
        stops = [n + 1 for n, w in enumerate(words) if w[2][-1] in ".!?,;:" or n + 1 == len(words)]
        units, gone = 0, []
        for begin in [0, *stops[:-1]] if stops else []:
            end = next((s for s in stops if s >= begin + least), None)
            if end is None:
                continue
            units += 1
            normal = tuple(w[2] for w in words[begin:end])
            if normal in seen:
                gone.append((words[begin][0], words[end - 1][1]))
            seen.add(normal)
        held = [False] * len(text)
        for a, b in gone:
            held[a:b] = [True] * (b - a)
        spans = [(m.start(), m.end()) for m in re.finditer("1+", "".join("01"[h] for h in held))]
        out[i] = (units, len(gone), ",".join(f"{a}:{b}" for a, b in spans))
        kept[i] = "".join(c for c, h in zip(text, held) if not h)
    return out, kept


def rows_of(seed):
    rng = random.Random(seed)
    clauses = [" ".join(rng.choices(["alpha", "Beta", "é😀", "x", "gamma", "A.b"], k=rng.randint(1, 7))) + rng.choice(".,;!?:") for _ in range(12)]
    rows = []
    for _ in range(80):
        some = [rng.choice(clauses) if rng.random() < 0.85 else " ".join(rng.choices("abcdefghij", k=5)) for _ in range(rng.randint(0, 14))]
        shown = [s.upper() if rng.random() < 0.1 else s.replace(" ", rng.choice(["  ", "\n", " "])) for s in some]
        rows.append((rng.randint(0, 50), rng.choice(["\n", " ", " \n\t"]).join(shown) + rng.choice(["", "\n", " end"])))
    same = " ".join(clauses[:6])
    return rows + [(None, None), (3, ""), (None, same + "\n" + same), (7, " \t\n"), (97, same), (97, same), (99, "w " * 30000),
                   (98, "w, " * 9000)]


@pytest.mark.parametrize("least", [6, 40])
def test_spans_and_kept_texts(spark, least):
    rows = rows_of(4)
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], SCHEMA).coalesce(1)
    want, kept = plain(rows, least)
    out = D.passage_report(docs, least).collect()
    assert sorted((str(r.doc_id), r.n_units, r.n_removed, r.removed_spans, r.kept_chars) for r in out) == sorted(
        (str(rows[i][0]), *w, len(kept[i])) for i, w in want.items())
    assert any(r.n_removed for r in out) and not all(r.n_removed for r in out)
    clean = D.without_passages(docs, least)
    assert clean.columns == [*docs.columns, "removed_spans"]
    assert sorted((str(r.doc_id), r.text or "") for r in clean.collect()) == sorted((str(rows[i][0]), t) for i, t in kept.items())


def test_moved_line_breaks_and_edited_edges(spark):
    rng = random.Random(2)
    words = [f"w{i}" + ("." if i % 7 == 6 else "") for i in range(80)]
    mine = [f"v{i}" for i in range(30)]
    docs = spark.createDataFrame([
        (1, " ".join(words)), (2, "own words here. " + "\n".join(words[3:])), (3, " ".join(mine)),
        (4, "".join(w + rng.choice(["\n", "  "]) for w in [*mine, *words[:66]]))], "doc_id long, text string")
    out = {r.doc_id: r for r in D.passage_report(docs).collect()}
    assert [out[i].n_removed > 0 for i in (1, 2, 3, 4)] == [False, True, False, True]


def test_frequent_passage(spark):
    passage = " ".join(f"p{i}" for i in range(49)) + "."
    docs = spark.createDataFrame([(i, f"own line {i}.\n{passage}\nother {i * 7}.", "a", "b") for i in range(3000)], SCHEMA)
    out = {r.doc_id: r for r in D.passage_report(docs).collect()}
    assert out[0].removed_spans == ""
    assert all(out[i].removed_spans == f"{len(f'own line {i}.') + 1}:{len(f'own line {i}.') + 1 + len(passage)}" for i in range(1, 3000))


def test_passages_of_fifty_words_on_the_given_table(spark):
    """Texts that share 50 words in a row with an earlier, different one lose some; others do but by repeating themselves."""
    rows, seen = [], set()
    for r in sorted(table(spark, "/root/testdata/sf0.01", "documents").collect(), key=lambda r: r.doc_id):
        bare = re.sub(r"\s", "", r.text)
        if bare not in seen:
            seen.add(bare)
            rows.append((r.doc_id, r.text))
    runs, later, alone = {}, set(), set()
    for doc, text in rows:
        words = text.lower().split()
        mine = {tuple(words[i:i + 50]) for i in range(len(words) - 49)}
        (later if any(m in runs for m in mine) else alone).add(doc)
        if len(mine) < len(words) - 49:
            alone.discard(doc)
        for m in mine:
            runs.setdefault(m, doc)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = {r.doc_id for r in D.passage_report(docs).where("n_removed > 0").collect()}
    assert len(later) >= 20 and len(cut & later) >= 0.85 * len(later) and len(cut & alone) <= 0.03 * len(alone)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert D.passage_report(docs).count() == 0 and D.without_passages(docs).count() == 0
