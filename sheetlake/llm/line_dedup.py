"""Repeated lines or paragraphs: the earliest occurrence in the whole corpus stays.

A text is cut into units at line ends (or blank lines). A unit's digest is taken of
its words in lower case with single spaces between. All units of enough words are
grouped by digest; of each group the occurrence in the row of the smallest id stays,
there the one that starts first, and the others are removed. What is removed is given
as spans of the original text, end exclusive, in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetlake.llm.common import SPACE, keyed, place_of, text_of
from sheetlake.session import checkpointed

CUTS = {"line": "\n", "paragraph": "\n[\\x20\\x09\\x0B-\\x0D]*\n"}
LEAST_WORDS = 8  # shorter units recur by chance


@dataclass
class Repeats:
    """``rows``: ``__row, __id, units, chars`` of each row; ``removed``: ``__row, unit, start, end, kept_row, kept_start``
    of each unit that goes."""

    rows: DataFrame
    removed: DataFrame


def repeated_units(docs: DataFrame, row: str | None = None, unit: str = "line", least_words: int = LEAST_WORDS,
                   id_column: str = "doc_id", text_column: str = "text") -> Repeats:
    """The units to remove.

    Null texts count as empty. Null ids rank last; rows of one id rank by row number,
    and a repeated row loses all its units of enough words. Empty units and units of
    fewer than ``least_words`` words always stay. An empty table gives empty results.
    Other columns are not read.
    """
    if unit not in CUTS:
        raise ValueError(f"no such unit: {unit}")
    rows = docs.select(F.col(row).alias("__row") if row else F.monotonically_increasing_id().alias("__row"),
                       F.col(id_column).alias("__id"), text_of(text_column).alias("__text"))
    normal = F.trim(F.regexp_replace(F.lower("part"), SPACE + "+", " "))
    pieces = F.split("__text", CUTS[unit], -1)
    if unit == "line":  # every cut is one code point
        pieces = F.transform(pieces, lambda part: F.struct(part.alias("part"), F.lit(1).alias("gap")))
    else:
        pieces = F.zip_with(pieces, F.regexp_extract_all("__text", F.lit(CUTS[unit]), 0),
                            lambda part, cut: F.struct(part.alias("part"), F.length(cut).alias("gap")))
    # The length is taken first, so that no unit carries its whole text along.
    parts = (rows.withColumn("chars", F.length("__text"))
             .select("__row", "__id", "chars", F.posexplode(pieces).alias("unit", "p"))
             .select("__row", "__id", "chars", "unit", "p.part", "p.gap")
             .withColumn("normal", normal)
             .select("__row", "__id", "chars", "unit", "gap", F.length("part").alias("length"),
                     (F.length("normal") - F.length(F.replace("normal", F.lit(" "))) + 1).alias("words"),
                     F.unhex(F.md5("normal")).alias("digest"), F.length("normal").alias("size")))
    stored = checkpointed(parts)
    before = Window.partitionBy("__row").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    placed = checkpointed(stored.withColumn("start", F.coalesce(F.sum(F.col("length") + F.coalesce("gap", F.lit(0))).over(before), F.lit(0)))
                          .withColumn("end", F.col("start") + F.col("length")))
    rank = F.struct(F.col("__id").isNull().alias("no_id"), F.col("__id").alias("id"), F.col("__row").alias("row"),
                    F.col("unit").alias("unit"), F.col("start").alias("start"))
    long_enough = placed.where((F.col("words") >= least_words) & (F.col("size") > 0))
    firsts = checkpointed(long_enough.groupBy("digest", "size").agg(F.min(rank).alias("first"), F.count("*").alias("n"))
                          .where("n > 1").select("digest", "size", "first"))
    removed = (long_enough.join(firsts, ["digest", "size"])
               .where((F.col("first.row") != F.col("__row")) | (F.col("first.unit") != F.col("unit")))
               .select("__row", "unit", "start", "end", F.col("first.row").alias("kept_row"), F.col("first.id").alias("kept_id"),
                       F.col("first.start").alias("kept_start")))
    summary = placed.groupBy("__row").agg(F.first("__id").alias("__id"), F.count("*").alias("units"), F.max("chars").alias("chars"))
    return Repeats(summary, removed)


def repeated_spans(docs: DataFrame, unit: str = "line", least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per row of ``docs``: its units, how many go, the code points left, and the spans that go.

    Spans are ``start:end`` in order, joined by commas, empty if none; see
    :func:`repeated_units` for odd rows.
    """
    found = repeated_units(docs, None, unit, least_words)
    gone = found.removed.groupBy("__row").agg(
        F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("size"),
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    none = F.lit(0).cast("long")
    return found.rows.join(gone, "__row", "left").select(
        F.col("__id").alias("doc_id"), F.col("units").alias("n_units"), F.coalesce("n", none).alias("n_removed"),
        (F.col("chars") - F.coalesce("size", none)).alias("kept_chars"), F.coalesce(joined, F.lit("")).alias("removed_spans"))


def without_repeats(docs: DataFrame, unit: str = "line", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the repeated units cut out of ``text``; the cuts between units stay. Adds ``removed_spans``,
    an array of ``start, end`` in the original text."""
    rows, text = keyed(docs), F.col(place_of(docs, "text"))
    gone = repeated_units(rows, "__row", unit, least_words, place_of(docs, "doc_id"), place_of(docs, "text")).removed
    gone = gone.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    # Kept stretches lie between the spans: each begins where a span ends (or at 0) and ends where the next begins.
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("__spans", lambda s: s["end"].cast("long")))
    ends = F.concat(F.transform("__spans", lambda s: s["start"].cast("long")), F.array(F.length(text).cast("long")))
    kept = F.array_join(F.zip_with(begins, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))), "")
    spans = "array<struct<start:bigint,end:bigint>>"
    cut = rows.join(gone, "__row", "left").withColumn(
        place_of(docs, "text"), F.when(F.size("__spans") > 0, kept).otherwise(text))
    return (cut.withColumn(f"c{len(docs.columns)}", F.coalesce(F.col("__spans").cast(spans), F.array().cast(spans)))
            .select(*[f"c{i}" for i in range(len(docs.columns) + 1)]).toDF(*docs.columns, "removed_spans"))
