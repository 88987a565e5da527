"""What the operators of this subpackage share: text rules, row numbers, running sums."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetlake.session import checkpointed
from sheetlake.sources.tables import quote_name

# White space of the text rules: space and the controls 9 to 13. Words are the runs between.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the given folder, listed anew on every call."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def place_of(df: DataFrame, column: str) -> str:
    """The name that a column has in :func:`keyed`."""
    return f"c{df.columns.index(column)}"


def keyed(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by place (``c0`` on), so that none can clash, and ``__row``, a key for each row.

    Later steps may join on the key also where ``doc_id`` is null or repeated. Rows
    read straight from Parquet are known by their file and place in it, which no
    repeated task changes, so nothing is copied. Other rows are stored once in the
    shared folder with a number; numbers made on the fly may change when a task is
    repeated on a cluster of another size.
    """
    places = [f"c{i}" for i in range(len(df.columns))]
    if df._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" and "_metadata" not in df.columns:
        try:
            return df.select(*[F.col(quote_name(c)).alias(p) for c, p in zip(df.columns, places)],
                             F.struct("_metadata.file_path", "_metadata.row_index").alias("__row"))
        except AnalysisException:  # a file format whose rows have no place
            pass
    return checkpointed(df.toDF(*places).withColumn("__row", F.monotonically_increasing_id()))


def unkeyed(rows: DataFrame, df: DataFrame) -> DataFrame:
    """Rows of :func:`keyed` with the columns of ``df`` again."""
    return rows.select(*[f"c{i}" for i in range(len(df.columns))]).toDF(*df.columns)


FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_SHIFT = np.uint64(32)
_WHITE = bytes(c == 32 or 9 <= c <= 13 for c in range(256))
# Of eight bytes read at a word's start, those that belong to a word of so many bytes.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mixed(hashes: np.ndarray) -> np.ndarray:
    """64-bit numbers whose every bit depends on all bits of the given ones; different ones stay different."""
    hashes = (hashes ^ (hashes >> _SHIFT)) * FACTORS[1]
    hashes = (hashes ^ (hashes >> _SHIFT)) * FACTORS[1]
    return hashes ^ (hashes >> _SHIFT)


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``first, past, hash`` of each word of a text in UTF-8, all words at once; places are in bytes.

    White space is that of the text rules. A-Z are not lowered here. Each word is read
    eight bytes at a time; equal words give equal hashes.
    """
    white = np.frombuffer(b"\x01" + text.translate(_WHITE) + b"\x01", np.uint8)
    edges = np.flatnonzero(white[1:] != white[:-1])
    first, past = edges[::2], edges[1::2]
    eight = np.ndarray(len(text) + 1, "<u8", text + bytes(8), strides=(1,))
    sizes = past - first
    hashes = (eight[first] & _MASKS[np.minimum(sizes, 8)]) * FACTORS[0] + sizes.astype(np.uint64)
    longer, done = np.flatnonzero(sizes > 8), 8
    while len(longer):
        part = eight[first[longer] + done] & _MASKS[np.minimum(sizes[longer] - done, 8)]
        held = hashes[longer]
        hashes[longer] = ((held ^ (held >> _SHIFT)) * FACTORS[1] + part) * FACTORS[0]
        done += 8
        longer = longer[sizes[longer] > done]
    return first, past, (hashes ^ (hashes >> _SHIFT)) * FACTORS[1]


BYTES_AT_ONCE = 1 << 20


def text_groups(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Texts in groups of about ``BYTES_AT_ONCE``, as short texts cost mostly the calls made for each."""
    group, held = [], 0
    for text in texts:
        group.append(text)
        held += len(text)
        if held >= BYTES_AT_ONCE:
            yield group
            group, held = [], 0
    if group:
        yield group


@dataclass
class Words:
    """The words of several texts, laid out one behind the other with a space between.

    ``first`` and ``past`` are places in all of it, ``begins`` where each text begins,
    ``until`` how many words there are up to the end of each text.
    """

    first: np.ndarray
    past: np.ndarray
    hashes: np.ndarray
    begins: np.ndarray
    until: np.ndarray


def words_of(texts: list[bytes]) -> Words:
    """The words of the texts with A-Z in lower case."""
    first, past, hashes = word_hashes(b" ".join(texts).lower())  # of bytes: only A-Z is lowered
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return Words(first, past, hashes, np.concatenate(([0], ends[:-1])), np.searchsorted(first, ends))


def hash_bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """One bit for each place that a hash of ``column`` takes modulo ``bits``, as bytes, the lowest bit first.

    The driver gets ``bits`` bits at most, however many hashes there are; a bitmap that
    is full lets everything through, so what it chooses is to be joined once more.
    """
    place = F.pmod(F.col(column), F.lit(bits)) + 1  # Spark's buckets begin at one
    parts = (df.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("part"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("held")).collect())
    bitmap = np.zeros(max(bits // 8, 4096), np.uint8)
    for row in parts:
        held = np.frombuffer(bytes(row.held), np.uint8)
        bitmap[(row.part - 1) * len(held):row.part * len(held)] = held
    return bitmap


def words_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def running_before(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: Column,
                   out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one within ``group``.

    ``bucket`` must rise with ``order`` and take few values (some thousands), so a
    group of any size is summed by bucket first, the bucket sums are run up in one
    small window per group, and only the rows of one bucket are sorted together.
    The join is a merge: rows that were generated are not in Spark's size estimates,
    so left alone it may broadcast a side that grows with the input.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("__sum"))
    per_group = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate([*group, bucket])],
                        F.coalesce(F.sum("__sum").over(per_group), F.lit(0)).alias("__ahead"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate([*group, bucket])]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    return (df.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(ahead.hint("merge"), condition, "inner")
            .withColumn(out, F.col("__ahead") + F.col("__inside"))
            .drop("__ahead", "__inside", *[f"__g{i}" for i in range(len(group) + 1)]))
