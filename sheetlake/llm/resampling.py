"""Importance resampling towards a target text: bucketed word runs, gains per bucket, Gumbel noise per document.

Words come from the pre-tokeniser of ``tokenizers``: an untrained split by a regular
expression over the text with A-Z lowered, which returns each word with its offsets.
The words are then laid out with one space between them, so a run of words is a pair
of offsets, from the start of its first word to the end of its last. The CRC of that
slice, modulo ``buckets``, is its bucket.

Each text is read once. It is kept as its buckets and their counts (at most
``buckets`` of each); the histograms and the weights are made from those. What
reaches the driver is one number for each bucket. Ranks come from a range partition
of all scores, with the rows of a partition numbered after those of the ones before,
so no task holds more than one range.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetlake.llm.common import keyed, place_of, text_of, unkeyed
from sheetlake.session import checkpointed, drop_scratch

BUCKETS = 10_000
RUN_WORDS = (1, 1)
LEAST_WORDS = 20
DRAWN_PERCENT = 10
SEED = 2024
ROWS_PER_RANGE = 1_000_000
RESAMPLE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@lru_cache(maxsize=1)
def _splitter():
    """Keeps what the expression matches and removes the rest; one for each worker."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(RESAMPLE_WORD), behavior="removed", invert=True)


def word_offsets(text: str) -> list[tuple[str, tuple[int, int]]]:
    """The words of a text with A-Z lowered, and where each begins and ends."""
    lowered = text.encode().lower().decode()  # of bytes: only A-Z is lowered
    return _splitter().pre_tokenize_str(lowered) if lowered else []


def run_buckets(words: list[bytes], shortest: int, longest: int, buckets: int) -> np.ndarray:
    """The bucket of every run of ``shortest`` to ``longest`` words, repeats included."""
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(words)]
    crc = zlib.crc32
    found = [np.fromiter((crc(joined[a:b]) for a, b in zip(starts[:len(words) - n + 1].tolist(), ends[n - 1:].tolist())),
                         np.int64, max(len(words) - n + 1, 0)) for n in range(shortest, longest + 1)]
    return np.concatenate(found) % buckets


def bucket_counts(rows: DataFrame, runs: tuple[int, int], buckets: int) -> DataFrame:
    """``__row, __id, n_words, n_features, buckets, counts`` for each row of ``__row, __id, __text``, stored."""
    shortest, longest = runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, places, counts, ends = [], [], [], [], [0]
            for text in batch.column("__text").to_pylist():
                words = [word.encode() for word, _ in word_offsets(text)]
                found = run_buckets(words, shortest, longest, buckets)
                place, count = np.unique(found, return_counts=True)
                n_words.append(len(words))
                n_features.append(len(found))
                places.append(place)
                counts.append(count)
                ends.append(ends[-1] + len(place))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *x])))
                     for x in (places, counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__row"), batch.column("__id"), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), *lists],
                ["__row", "__id", "n_words", "n_features", "buckets", "counts"])

    kinds = dict(rows.dtypes)
    return checkpointed(rows.select("__row", "__id", "__text").mapInArrow(run, (
        f"__row {kinds['__row']}, __id {kinds['__id']}, n_words long, n_features long, buckets array<long>, counts array<long>")))


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def histogram(counted: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all rows fall into each bucket; a task sends one row for each bucket it has met."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, _flat(batch.column("buckets")), _flat(batch.column("counts")))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    total = np.zeros(buckets, np.int64)
    parts = counted.select("buckets", "counts").mapInArrow(run, "bucket long, n long")
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row.bucket] = row.n
    return total


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 * ln)`` of how much likelier each bucket is in the target, one feature added to every bucket."""
    more, less, buckets = float(target.sum() + len(target)), float(source.sum() + len(source)), len(source)
    return np.array([math.floor(1000.0 * math.log((float(target[b]) + 1.0) * less / ((float(source[b]) + 1.0) * more)))
                     for b in range(buckets)], np.int64)


def noise(id_column: str, seed: int) -> Column:
    """``floor(-1000 * ln(-ln(u)))`` with ``u`` from the first 32 bits of the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def _weighted(counted: DataFrame, gains: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            gained = gains[_flat(lists)] * _flat(batch.column("counts"))
            ends = np.concatenate(([0], np.cumsum(gained)))
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            weights = ends[offsets[1:]] - ends[offsets[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("__row", "__id", "n_words", "n_features")), pa.array(weights, pa.int64())],
                ["__row", "__id", "n_words", "n_features", "weight"])

    kinds = dict(counted.dtypes)
    return counted.mapInArrow(run, f"__row {kinds['__row']}, __id {kinds['__id']}, n_words long, n_features long, weight long")


def _resampled(rows: DataFrame, target: DataFrame, target_text: str, runs: tuple[int, int], buckets: int, least_words: int,
               percent: int, seed: int) -> DataFrame:
    """``__row, __id, n_features, weight, score, rank`` for each row of ``__row, __id, __text``."""
    counted = bucket_counts(rows, runs, buckets)
    wanted = bucket_counts(target.select(F.lit(0).alias("__row"), F.lit(0).alias("__id"), text_of(target_text).alias("__text")),
                           runs, buckets)
    gains = bucket_gains(histogram(counted, buckets), histogram(wanted, buckets))
    drop_scratch(wanted)
    scored = _weighted(counted, gains).withColumn("score", F.col("weight") + noise("__id", seed)).withColumn(
        "fits", F.col("n_words") >= least_words)
    total, fit = counted.agg(F.count("*"), F.count(F.when(F.col("n_words") >= least_words, 1))).first()
    drawn = fit * percent // 100
    order = [F.col("fits").desc(), F.col("score").desc(), F.col("__id").asc_nulls_last(), F.col("__row")]
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / ROWS_PER_RANGE))
    dealt = checkpointed(scored.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()))
    drop_scratch(counted)
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))  # one row for each range
    before = sizes.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    rank = F.col("before") + F.col("nth")
    return numbered.join(F.broadcast(before), "part").select(
        "__row", "__id", "n_features", "weight", "score", F.when(F.col("fits") & (rank <= drawn), rank).alias("rank"))


def importance_ranks(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                     target_text: str = "text", runs: tuple[int, int] = RUN_WORDS, buckets: int = BUCKETS,
                     least_words: int = LEAST_WORDS, percent: int = DRAWN_PERCENT, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: its features, weight, score, and its rank if it is drawn, else null.

    Null and empty texts have no features and weight 0; they, and texts of fewer than
    ``least_words`` words, are scored but never drawn. Very long texts are read in full.
    Equal scores go by the smaller id, a null id last, then by the row's place. Repeated
    rows are drawn each for itself; ids that are null share one noise. An empty table
    gives no rows; an empty target has no features, so each bucket counts one. Other
    columns are not read, whatever their names.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(id_column).alias("__id"),
                       text_of(text_column).alias("__text"))
    return _resampled(rows, target, target_text, runs, buckets, least_words, percent, seed).select(
        F.col("__id").alias("doc_id"), "n_features", "weight", "score", "rank")


def resampled_documents(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                        target_text: str = "text", runs: tuple[int, int] = RUN_WORDS, buckets: int = BUCKETS,
                        least_words: int = LEAST_WORDS, percent: int = DRAWN_PERCENT, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that :func:`importance_ranks` draws, with all their columns."""
    rows = keyed(docs)
    asked = rows.select("__row", F.col(place_of(docs, id_column)).alias("__id"), text_of(place_of(docs, text_column)).alias("__text"))
    ranked = _resampled(asked, target, target_text, runs, buckets, least_words, percent, seed)
    return unkeyed(rows.join(ranked.where("rank IS NOT NULL").select("__row"), "__row", "left_semi"), docs)
