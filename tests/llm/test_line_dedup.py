"""Repeated units against a plain scan in ranked order."""

import random
import re

import pytest
from sheetlake.llm import line_dedup as D

SCHEMA = "doc_id long, text string, unit string, digest string"


def plain(rows, unit, least):
    """``{row number: spans}`` and the kept texts."""
    ranked = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, spans, kept = set(), {i: [] for i in range(len(rows))}, {}
    for i in ranked:
        text, at = rows[i][1] or "", 0
        cut = re.compile("\n" if unit == "line" else "\n[ \t\x0b\x0c\r]*\n")
        begins = [0] + [m.end() for m in cut.finditer(text)]
        ends = [m.start() for m in cut.finditer(text)] + [len(text)]
        out = text
        for a, b in zip(begins, ends):
            words = re.findall(r"[^ \t\n\x0b\x0c\r]+", text[a:b].lower())
            if len(words) >= least:
                if tuple(words) in seen:
                    spans[i].append((a, b))
                seen.add(tuple(words))
        for a, b in reversed(spans[i]):
            out = out[:a] + out[b:]
        kept[i] = out
    return spans, kept


def rows_of(seed):
    rng = random.Random(seed)
    lines = [" ".join(rng.choices(["alpha", "Beta", "é😀", "x", "gamma"], k=rng.choice([1, 2, 8, 9, 12]))) for _ in range(30)]
    rows = []
    for i in range(60):
        some = [rng.choice(lines) if rng.random() < 0.5 else " ".join(rng.choices("abcdefghij", k=12)) for _ in range(rng.randint(0, 6))]
        shown = [s.upper() if rng.random() < 0.2 else s.replace(" ", "  ") for s in some]
        rows.append((rng.randint(0, 40), rng.choice(["\n", "\n\n", "\n \n"]).join(shown)))
    return rows + [(None, None), (3, ""), (None, lines[0] + "\n" + lines[0]), (99, "w " * 30000), (98, "w  " * 30000 + "\n\n\n")]


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_spans_and_kept_texts(spark, unit):
    rows = rows_of(4)
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], SCHEMA).coalesce(1)
    spans, kept = plain(rows, unit, 8)
    out = D.repeated_spans(docs, unit).collect()
    want = sorted((str(rows[i][0]), ",".join(f"{a}:{b}" for a, b in s), len(rows[i][1] or "") - sum(b - a for a, b in s))
                  for i, s in spans.items())
    assert sorted((str(r.doc_id), r.removed_spans, r.kept_chars) for r in out) == want
    assert all(r.n_removed == len(r.removed_spans.split(",")) if r.removed_spans else r.n_removed == 0 for r in out)
    clean = D.without_repeats(docs, unit)
    assert clean.columns == [*docs.columns, "removed_spans"]
    assert sorted((str(r.doc_id), r.text or "") for r in clean.collect()) == sorted((str(rows[i][0]), t) for i, t in kept.items())


def test_frequent_line(spark):
    line = "this very line is on all of the pages"
    docs = spark.createDataFrame([(i, f"{line}\nown line {i}", "a", "b") for i in range(3000)], SCHEMA)
    out = {r.doc_id: r for r in D.repeated_spans(docs).collect()}
    assert out[0].removed_spans == "" and all(out[i].removed_spans == f"0:{len(line)}" for i in range(1, 3000))


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert D.repeated_spans(docs).count() == 0 and D.without_repeats(docs).count() == 0
    with pytest.raises(ValueError):
        D.repeated_spans(docs, "page")
