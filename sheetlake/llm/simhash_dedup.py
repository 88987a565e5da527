"""SimHash near-duplicates, found by Golay-code fuzzy keys.

A fingerprint has 64 bits, cut into three segments of 22, 21 and 21. Two
fingerprints that differ in at most two bits agree in at least one segment
(pigeonhole), and every other segment differs in at most two bits. The binary
Golay code is perfect: each 23-bit word lies within 3 of exactly one codeword. So
the word half-way between two segments that differ in two bits has a codeword
within 3, which is within 4 of both. A segment therefore gets as keys the indices
of all codewords within 4 of it, 5.3 on average; a fingerprint's keys are one
segment as it is with a codeword index of the next. Candidates that share a key
are verified by counting bits.

Frequent keys are not paired up. A key of more than ``PAIRED`` different
fingerprints sends its members to a second exact search: two words within two
bits share a word within one bit of both, so each member lists the 65 words of
its own ball, and the fingerprints listed under one word (never more than 65) are
linked to the smallest of them. That is linear in the members.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlake.llm.common import keyed, place_of, unkeyed
from sheetlake.llm.graph import component_roots
from sheetlake.session import checkpointed

SHINGLE_WORDS = 3
MOST_BITS = 2
PAIRED = 64
HASHED_AT_ONCE = 1 << 16
# The binary Golay code of length 23: its generator polynomial, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
LENGTH, CHECK_BITS, RADIUS = 23, 11, 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and number of bits


def _shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 with seed 42 of each run of ``size`` words, or of all words if there are fewer."""
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:len(words) - size + 1].tolist()
    stops = (ends[size - 1:] - 1).tolist()
    view = memoryview(joined)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(view[a:b], 42) for a, b in zip(starts, stops)), dtype=np.uint64, count=len(starts))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, lowest first."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), HASHED_AT_ONCE):
        part = np.ascontiguousarray(hashes[at:at + HASHED_AT_ONCE])
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lanes = bits.view(np.uint64)  # eight counters of one byte each, so 255 rows at a time
        for first in range(0, len(lanes), 255 * 256):
            block = lanes[first:first + 255 * 256]
            sums = np.add.reduceat(block, np.arange(0, len(block), 255), axis=0)
            total += sums.view(np.uint8).sum(axis=0, dtype=np.int64)
    return total


def text_fingerprint(text: bytes, size: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text; 0 for one without words."""
    words = text.lower().split()  # of bytes: only A-Z is lowered, only space and 9 to 13 split
    if not words:
        return 0
    hashes = _shingle_hashes(words, size)
    bits = np.packbits(_bit_counts(hashes) * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, row: str | None = None, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """``__row``, ``__id`` and the fingerprint ``fp`` (64 bits as a signed long) of each row, stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text").cast(pa.binary())
            found = np.fromiter((text_fingerprint(t.as_py()) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("__row"), batch.column("__id"), pa.array(found.view(np.int64))], ["__row", "__id", "fp"])

    rows = docs.select(F.col(row).alias("__row") if row else F.monotonically_increasing_id().alias("__row"),
                       F.col(id_column).cast("long").alias("__id"),
                       F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("__text"))
    kind = rows.schema["__row"].dataType.simpleString()
    return checkpointed(rows.mapInArrow(run, f"__row {kind}, __id long, fp long"))


def _remainders() -> np.ndarray:
    """For each 12-bit message the check bits that make it a codeword."""
    values = np.arange(1 << (LENGTH - CHECK_BITS), dtype=np.int64) << CHECK_BITS
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        values = np.where(values >> bit & 1, values ^ (GOLAY << (bit - CHECK_BITS)), values)
    return values


def _errors_by_syndrome() -> tuple[np.ndarray, np.ndarray]:
    """Error patterns of weight up to RADIUS, sorted by syndrome, and where each syndrome's begin."""
    patterns = np.array([sum(1 << b for b in bits) for weight in range(RADIUS + 1)
                         for bits in itertools.combinations(range(LENGTH), weight)], dtype=np.int64)
    syndromes = _syndromes(patterns, _remainders())
    order = np.argsort(syndromes, kind="stable")
    return patterns[order], np.searchsorted(syndromes[order], np.arange((1 << CHECK_BITS) + 1))


def _syndromes(words: np.ndarray, remainders: np.ndarray) -> np.ndarray:
    return remainders[words >> CHECK_BITS] ^ (words & ((1 << CHECK_BITS) - 1))


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(at, key)``: the keys of each fingerprint, as positions in ``prints`` and 36-bit numbers."""
    remainders = _remainders()
    errors, begins = _errors_by_syndrome()
    parts = [(prints >> np.uint64(first)).astype(np.int64) & ((1 << bits) - 1) for first, bits in SEGMENTS]
    ats, keys = [], []
    for i, exact in enumerate(parts):
        fuzzy = parts[(i + 1) % len(parts)]
        syndrome = _syndromes(fuzzy, remainders)
        count = begins[syndrome + 1] - begins[syndrome]
        at = np.repeat(np.arange(len(prints)), count)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        codeword = (fuzzy[at] ^ errors[begins[syndrome][at] + nth]) >> CHECK_BITS
        ats.append(at)
        keys.append(i << 34 | exact[at] << 12 | codeword)
    return np.concatenate(ats), np.concatenate(keys)


def fingerprint_keys(prints: DataFrame) -> DataFrame:
    """``key, fp`` for the distinct fingerprints of ``prints``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            at, keys = golay_keys(values.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values[at])], ["key", "fp"])

    return prints.select("fp").mapInArrow(run, "key long, fp long")


def linked_fingerprints(prints: DataFrame, paired: int = PAIRED) -> DataFrame:
    """``a, b``: links that join up all distinct fingerprints within ``MOST_BITS`` of each other.

    A key of at most ``paired`` members is compared in full. Members of a larger
    one go through their balls; what they are linked to is within two bits as well.
    """
    keys = checkpointed(fingerprint_keys(prints))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = checkpointed(keys.join(sizes, "key"))
    groups = shared.where(F.col("n") <= paired).groupBy("key").agg(F.collect_list("fp").alias("members"))
    pairs = (groups.select(F.explode("members").alias("b"), "members")
             .select("b", F.explode(F.expr(f"filter(members, x -> x < b and bit_count(x ^ b) <= {MOST_BITS})")).alias("a")))
    balls = (shared.where(F.col("n") > paired).select("fp").distinct()
             .select("fp", F.explode(F.expr(
                 "concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("word")))
    near = balls.groupBy("word").agg(F.collect_set("fp").alias("members")).where("size(members) > 1")
    through = (near.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a < b"))
    return pairs.select("a", "b").union(through.select("a", "b")).distinct()


def near_components(prints: DataFrame, paired: int = PAIRED) -> DataFrame:
    """``fp`` and ``__first``, the first row (by id, null last) of all that can be reached from it, stored."""
    first = F.struct(F.col("__id").isNull().alias("no_id"), F.col("__id").alias("id"), F.col("__row").alias("row"))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min(first).alias("__first")))
    roots = component_roots(linked_fingerprints(distinct, paired))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "__first", F.coalesce("root", "fp").alias("__root"))
    rooted = checkpointed(rooted)
    firsts = checkpointed(rooted.groupBy("__root").agg(F.min("__first").alias("__least")))
    return checkpointed(rooted.join(firsts, "__root").select("fp", F.col("__least").alias("__first")))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    paired: int = PAIRED) -> DataFrame:
    """One row per row of ``docs``: its fingerprint and the smallest id reachable by links.

    Null texts count as empty. Texts without words have fingerprint zero and are
    one component, joined by whatever links to zero. Null ids give rows too; their
    component has the smallest id that is not null, or null if none is. Repeated
    rows stay repeated. An empty table gives no rows; other columns are not read.
    """
    prints = fingerprints(docs, None, id_column, text_column)
    groups = near_components(prints, paired)
    return prints.join(groups, "fp").select(
        F.col("__id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("__first.id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the first row of each component of :func:`near_duplicates`; all columns stay."""
    rows = keyed(docs)
    prints = fingerprints(rows, "__row", place_of(docs, id_column), place_of(docs, text_column))
    kept = near_components(prints).select(F.col("__first.row").alias("__row")).distinct()
    return unkeyed(rows.join(kept, "__row", "left_semi"), docs)
