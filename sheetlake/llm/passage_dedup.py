"""Repeated passages, wherever lines break: the earliest occurrence in the whole corpus stays.

White space of any kind separates words, so line ends do not matter. A clause ends with
a word that ends in one of ``CLAUSE_ENDS``. A unit is a paragraph of whole clauses: one
begins at every clause and ends with the first clause that makes it ``least_words``
words long. A unit's digest is taken of its words with A-Z in lower case. All units are
grouped by digest; of each group the occurrence in the row of the smallest id stays,
there the one that starts first, and the others go. Units of a text overlap, so what
goes is their union, given as spans of the original text in code points, end exclusive.
A word that goes stays in an earlier place, as that place lost it only to one that is
earlier still.

Units are counted by digest first. Those counted more than once are sent to the tasks as
one bitmap of fixed size, and only units that it lets through are grouped with their
places. Digests are 128 bits, made for all units of a text at once from running sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlake.llm.common import FACTORS, hash_bitmap, keyed, mixed, place_of, text_groups, text_of, words_of
from sheetlake.session import checkpointed, drop_scratch

LEAST_WORDS = 40
CLAUSE_ENDS = ".!?,;:"
FILTER_BITS = 1 << 24
_SHIFT = np.uint64(32)
_CLOSES = np.array([chr(c) in CLAUSE_ENDS for c in range(256)])
POWERS_KEPT = 1 << 19
SPANS = "array<struct<start:bigint,end:bigint>>"


@lru_cache(maxsize=1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(POWERS_KEPT)


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of a factor, and of its inverse, modulo 2^64."""
    both = int(FACTORS[0]), pow(int(FACTORS[0]), -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(count - 1, f, np.uint64)))) for f in both)


def _runs(words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of ``words[begin:end]`` for each pair; the same words give the same, wherever they stand."""
    powers, back = _kept_powers() if len(words) < POWERS_KEPT else _powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers[:len(words)], out=sums[1:])
    return mixed((sums[ends] - sums[begins]) * back[begins] + (ends - begins).astype(np.uint64))


def passage_units(texts: list[bytes], least_words: int = LEAST_WORDS) -> tuple[np.ndarray, ...]:
    """``count, starts, ends, high, low``: how many units each text has, and of all units in turn the place in
    their text, in code points, and both halves of the digest."""
    words = words_of(texts)
    until = words.until
    joined = np.frombuffer(b" ".join(texts), np.uint8)
    closes = _CLOSES[joined[words.past - 1]]
    closes[until[np.diff(np.concatenate(([0], until))) > 0] - 1] = True  # the last word of each text
    stops = np.flatnonzero(closes) + 1  # how many words there are up to the end of each clause
    begins = np.concatenate(([0], stops[:-1])) if len(stops) else stops
    at = np.searchsorted(stops, begins + least_words)
    begins, at = begins[at < len(stops)], at[at < len(stops)]
    ends = stops[at]
    owner = np.searchsorted(until, begins, "right")
    whole = ends <= until[owner]  # of one text
    begins, ends, owner = begins[whole], ends[whole], owner[whole]
    low = _runs(words.hashes, begins, ends)
    high = _runs((words.hashes ^ (words.hashes >> _SHIFT)) * FACTORS[0], begins, ends)
    starts, stops = words.first[begins], words.past[ends - 1]
    base = words.begins[owner]
    inner = np.flatnonzero((joined & 0xC0) == 0x80)  # bytes that go on with a code point do not count
    starts, stops, base = (x - np.searchsorted(inner, x) for x in (starts, stops, base))
    return np.bincount(owner, minlength=len(texts)), starts - base, stops - base, high.view(np.int64), low.view(np.int64)


def unit_table(rows: DataFrame, least_words: int) -> DataFrame:
    """``__row, __id, chars, starts, ends, high, low`` of each row of ``__row, __id, __text``, stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text")
            found = [passage_units(group, least_words) for group in text_groups(t.as_py() for t in texts.cast(pa.binary()))]
            count, *parts = (np.concatenate([np.zeros(0, np.int64), *part]) for part in (zip(*found) if found else [()] * 5))
            ends = pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("__row"), batch.column("__id"), pc.utf8_length(texts).cast(pa.int64()),
                 *(pa.ListArray.from_arrays(ends, pa.array(part)) for part in parts)],
                ["__row", "__id", "chars", "starts", "ends", "high", "low"])

    kinds = dict(rows.dtypes)
    return checkpointed(rows.select("__row", "__id", "__text").mapInArrow(run, (
        f"__row {kinds['__row']}, __id {kinds['__id']}, chars long, starts array<long>, ends array<long>, high array<long>, low array<long>")))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The units of each row as few spans that do not overlap."""
    for batch in batches:
        rows, starts, ends = [], [], []
        for row in batch.column("units").to_pylist():
            spans: list[list[int]] = []
            for unit in sorted((u["start"], u["end"]) for u in row):
                if spans and unit[0] < spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], unit[1])
                else:
                    spans.append(list(unit))
            rows.append(len(row))
            starts.append(sum(b - a for a, b in spans))
            ends.append([{"start": a, "end": b} for a, b in spans])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(rows, pa.int64()), pa.array(starts, pa.int64()),
                                          pa.array(ends, kind)], ["__row", "n", "size", "spans"])


def repeated_passages(rows: DataFrame, least_words: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """For rows ``__row, __id, __text``: ``__row, __id, chars, units`` of each, and ``__row, n, size, spans`` of
    those that lose ``n`` units, in all ``size`` code points."""
    stored = unit_table(rows, least_words)
    several = checkpointed(stored.select(F.explode(F.arrays_zip("high", "low")).alias("u")).groupBy("u.high", "u.low")
                           .agg(F.count("*").alias("n")).where("n > 1").select("high", "low"))
    bitmap = hash_bitmap(several, "low", FILTER_BITS)
    drop_scratch(several)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("low")
            flat = {c: batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("starts", "ends", "high", "low")}
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            place = (flat["low"] & (FILTER_BITS - 1)).astype(np.int64)
            held = np.flatnonzero(bitmap[place >> 3] >> (place & 7) & 1)
            at = pa.array(owner[held])
            yield pa.RecordBatch.from_arrays(
                [batch.column("__row").take(at), batch.column("__id").take(at), *(pa.array(flat[c][held]) for c in flat)],
                ["__row", "__id", "start", "end", "high", "low"])

    kinds = dict(stored.dtypes)
    units = checkpointed(stored.select("__row", "__id", "starts", "ends", "high", "low").mapInArrow(
        run, f"__row {kinds['__row']}, __id {kinds['__id']}, start long, end long, high long, low long"))
    rank = F.struct(F.col("__id").isNull().alias("no_id"), F.col("__id").alias("id"), F.col("__row").alias("row"), "start")
    firsts = checkpointed(units.groupBy("high", "low").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    gone = checkpointed(units.join(firsts, ["high", "low"])
                        .where((F.col("first.row") != F.col("__row")) | (F.col("first.start") != F.col("start")))
                        .select("__row", "start", "end"))
    drop_scratch(units)
    spans = gone.groupBy("__row").agg(F.collect_list(F.struct("start", "end")).alias("units")).mapInArrow(
        _merged, f"__row {kinds['__row']}, n long, size long, spans {SPANS}")
    return stored.select("__row", "__id", "chars", F.size("low").cast("long").alias("units")), spans


def passage_report(docs: DataFrame, least_words: int = LEAST_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: its units, how many go, the code points left, and the spans that go.

    Spans are ``start:end`` in order, joined by commas, empty if none. Null texts count
    as empty; texts of fewer than ``least_words`` words have no units and stay whole. Very
    long texts are read in full. Null ids rank last; rows of one id rank by their place,
    and a repeated row loses all its units. A passage repeated within one text goes as
    well. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(id_column).alias("__id"), text_of(text_column).alias("__text"))
    found, gone = repeated_passages(rows, least_words)
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    none = F.lit(0).cast("long")
    return found.join(gone, "__row", "left").select(
        F.col("__id").alias("doc_id"), F.col("units").alias("n_units"), F.coalesce("n", none).alias("n_removed"),
        (F.col("chars") - F.coalesce("size", none)).alias("kept_chars"), F.coalesce(joined, F.lit("")).alias("removed_spans"))


def without_passages(docs: DataFrame, least_words: int = LEAST_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the repeated passages cut out of the text; adds ``removed_spans``, as spans of the original text."""
    rows, text = keyed(docs), F.col(place_of(docs, text_column))
    asked = rows.select("__row", F.col(place_of(docs, id_column)).alias("__id"), text_of(place_of(docs, text_column)).alias("__text"))
    _, gone = repeated_passages(asked, least_words)
    gone = gone.select("__row", F.col("spans").alias("__spans"))
    # Kept stretches lie between the spans: each begins where a span ends (or at 0) and ends where the next begins.
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("__spans", lambda s: s["end"]))
    ends = F.concat(F.transform("__spans", lambda s: s["start"]), F.array(F.length(text).cast("long")))
    kept = F.array_join(F.zip_with(begins, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))), "")
    cut = rows.join(gone, "__row", "left").withColumn(
        place_of(docs, text_column), F.when(F.size("__spans") > 0, kept).otherwise(text))
    return (cut.withColumn(f"c{len(docs.columns)}", F.coalesce(F.col("__spans"), F.array().cast(SPANS)))
            .select(*[f"c{i}" for i in range(len(docs.columns) + 1)]).toDF(*docs.columns, "removed_spans"))
