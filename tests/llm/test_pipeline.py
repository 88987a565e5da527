"""The pipeline: each stage decides on what the one before it kept, and packs every document of the mix."""

import re
from collections import Counter, defaultdict

import corpus_pipeline as C
from sheetlake.llm.common import table
from sheetlake.llm.exact_dedup import exact_duplicates
from sheetlake.llm.simhash_dedup import near_duplicates
from sheetlake.llm.toxicity import toxicity_scores

FOLDER = "/root/testdata/sf0.01"


def size(text):
    return len(re.findall(r"[^ \t\n\x0b\x0c\r]+", text or ""))


def test_stages(spark, tmp_path):
    docs, results = table(spark, FOLDER, "documents"), {}
    for name, stage in C.STAGES:
        out = stage(spark, docs, FOLDER)
        out.write.parquet(f"{tmp_path}/{name}")
        results[name] = (docs, spark.read.parquet(f"{tmp_path}/{name}"))
        docs = results[name][1]
    before, after = results["toxicity"]
    assert after.columns == before.columns
    toxic = {r.doc_id for r in toxicity_scores(before, table(spark, FOLDER, "labels")).collect() if r.predicted}
    assert toxic and {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - toxic
    before, after = results["exact_dedup"]
    assert after.columns == before.columns
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in exact_duplicates(before).collect() if r.kept}
    before, after = results["near_dedup"]
    assert {r.doc_id for r in after.collect()} == {r.component_id for r in near_duplicates(before).collect()}
    before, after = results["mix"]
    assert after.columns == before.columns
    sizes, mixed = defaultdict(int), defaultdict(int)
    for rows, into in ((before, sizes), (after, mixed)):
        for r in rows.collect():
            into[r.source] += size(r.text)
    assert abs(sum(mixed.values()) - 1.5 * sum(sizes.values())) <= len(sizes)
    assert max(Counter(r.doc_id for r in after.collect()).values()) <= 2
    before, after = results["pack"]
    pieces = after.collect()
    assert Counter(p.doc_id for p in pieces if p.start == 0) == Counter(r.doc_id for r in before.collect())


def test_run_reads_the_given_tables(spark):
    out = C.run(spark, "/root/testdata/sf0.001")
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, __row string, c0 int, fp string, __score string"


def test_stages_on_odd_documents(spark, tmp_path):
    """Nulls everywhere, empty and very long texts, repeated rows, extra columns with names used inside, no rows at all."""
    rows = [(1, "same text here to keep", "en", "a", 1, "r", 1, "f", "s"), (1, "same text here to keep", "en", "a", 1, "r", 1, "f", "s"),
            (None, None, None, None, None, None, None, None, None), (None, "", None, "", 0, "r", 2, "f", "s"),
            (3, "word " * 60000, "en", "a", 9, "r", 3, "f", "s"), (4, " \t\n", "de", None, 3, "r", 4, "f", "s"),
            (5, "you idiot, you pathetic moron", "en", "b", 9, "r", 5, "f", "s"), (6, "quite another text é 漢字", "fr", "b", 9, "r", 6, "f", "s")]
    for number, some in enumerate((rows, [])):
        docs = spark.createDataFrame(some, ODD)
        columns = docs.columns
        for name, stage in C.STAGES:
            out = stage(spark, docs, FOLDER)
            assert out.columns == columns or name == "pack"
            out.write.parquet(f"{tmp_path}/{number}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{number}/{name}")
            ids = [r.doc_id for r in docs.collect()]
            if not some:
                assert ids == []
            elif name == "toxicity":
                assert Counter(ids) == Counter([1, 1, None, None, 3, 4, 5, 6])  # these labels teach no insult
            elif name in ("exact_dedup", "near_dedup"):
                assert Counter(ids) == Counter([1, 3, 4, 5, 6])
                assert {r["__row"] for r in docs.collect()} == {"r"}
            else:
                assert set(ids) <= {1, 3, 5, 6} and len(ids) >= 3
