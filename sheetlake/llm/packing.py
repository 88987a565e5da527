"""Lexical retrieval packing: a seed document's window is filled by its BM25 neighbours.

One pass turns each text into ids and gives away its full windows at once; only the
last piece of a document, shorter than a window, has to share one. Those pieces are
the documents of the index and their ids its terms, so the statistics are bounded by
the vocabulary: one document frequency per id, counted over all pieces. The index is
sharded: pieces are sorted by their two heaviest terms, dealt out in ranges, and each
run of ``SHARD_PIECES`` is one shard with its own posting lists. A frequent term
only makes more shards; ties are broken by a checksum, so equal pieces spread as well.

Within a shard the longest unused piece is the seed. Its unused neighbours follow in
order of score; those that fit are added whole, then the nearest that does not fit is
cut to fill the window, and its rest stays in the index. What a shard leaves goes into
the next one; the last window of a partition is cut into sequences whose lengths are
powers of two, which need no padding.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sheetlake.session import checkpointed

WINDOW = 1024
SHARD_PIECES = 512
LEAST_CUT = 8  # a smaller gap is left as padding
K1, B = 1.2, 0.75
END = np.array([0], dtype="<u4").tobytes()
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Texts to little-endian 32-bit ids, the same as the tokenizer file gives.

    ``vocabulary`` is the same vocabulary as ranks, for the faster library; texts
    with a special token, and texts on which that library fails, go through the
    tokenizer file itself.
    """

    def __init__(self, tokenizer: str, pattern: str | None = None, vocabulary: dict[bytes, int] | None = None):
        self.file = tokenizer
        self.fast = vocabulary and tiktoken.Encoding(
            "given", pat_str=pattern, mergeable_ranks=vocabulary, special_tokens={})
        with open(tokenizer, encoding="utf-8") as described:
            self.special = [token["content"] for token in json.load(described).get("added_tokens", ())]

    @cached_property
    def whole(self) -> Tokenizer:
        """The tokenizer file; a worker that never needs it does not hold it."""
        return Tokenizer.from_file(self.file)

    def encode(self, text: str) -> bytes:
        if self.fast and not any(s in text for s in self.special):
            try:
                return _packed(self.fast.encode_ordinary(text))
            except BaseException as fault:  # a panic of the library is not an Exception
                if isinstance(fault, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return _packed(self.whole.encode(text, add_special_tokens=False).ids)


@lru_cache(maxsize=4)
def load_encoder(tokenizer: str, ranks: str | None) -> Encoder:
    if ranks is None:
        return Encoder(tokenizer)
    import base64

    import public_tokenizers
    with open(ranks, "rb") as lines:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return Encoder(tokenizer, public_tokenizers.PATTERN, known)


def encoded_pieces(docs: DataFrame, tokenizer: str, ranks: str | None, id_column: str = "doc_id",
                   text_column: str = "text") -> DataFrame:
    """Per row: id, number of ids (with the closing 0), checksums of its full windows, ids of the rest; stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(tokenizer, ranks)
        size = WINDOW * 4
        for batch in batches:
            tokens, sums, rests = [], [], []
            for text in batch.column("__text"):
                ids = memoryview(encoder.encode(text.as_py()) + END)
                full = len(ids) // size
                tokens.append(len(ids) // 4)
                sums.append([zlib.crc32(ids[i * size:(i + 1) * size]) for i in range(full)])
                rests.append(np.frombuffer(ids[full * size:], dtype="<u4").astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(sums, pa.list_(pa.int64())),
                 pa.array(rests, pa.binary())], ["doc_id", "tokens", "sums", "rest"])

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"),
                        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("__text"))
    return checkpointed(texts.mapInArrow(run, "doc_id long, tokens long, sums array<long>, rest binary"))


def _terms(rests: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(piece, term, count)`` of each different term of each piece, by piece and term."""
    if len(rests) > 1 << 16:  # so that piece and term make one 32-bit number, which sorts fast
        parts = [_terms(rests[a:a + (1 << 16)]) for a in range(0, len(rests), 1 << 16)]
        return tuple(np.concatenate([part[i] + (n << 16) * (i == 0) for n, part in enumerate(parts)]) for i in range(3))
    lengths = [len(r) for r in rests]
    flat = np.concatenate(rests).astype(np.uint32) if rests else np.zeros(0, np.uint32)
    keys = np.sort(np.repeat(np.arange(len(rests), dtype=np.uint32), lengths) << 16 | flat)
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(begins, len(keys)))
    return (keys[begins] >> 16).astype(np.int64), (keys[begins] & 0xFFFF).astype(np.int64), counts


def term_statistics(pieces: DataFrame) -> np.ndarray:
    """BM25 inverse document frequency of every id, then the mean length of a piece.

    Each task counts its own pieces into one row per id, so at most a vocabulary's
    worth of rows (65,536) leaves it and reaches the driver.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n, length = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            rests = [np.frombuffer(r.as_py(), "<u2") for r in batch.column("rest")]
            found += np.bincount(_terms(rests)[1], minlength=1 << 16)
            n, length = n + sum(map(bool, map(len, rests))), length + sum(map(len, rests))
        terms = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((terms, [-1, -2]))), pa.array(np.concatenate((found[terms], [n, length])))],
            ["term", "pieces"])

    rows = (pieces.select("rest").mapInArrow(run, "term long, pieces long")
            .groupBy("term").agg(F.sum("pieces").alias("pieces")).toPandas())
    count = dict(zip(rows.term.tolist(), rows.pieces.tolist()))
    n, length = count.pop(-1, 0), count.pop(-2, 0)
    frequency = np.zeros(1 << 16)
    frequency[list(count)] = list(count.values())
    return np.append(np.log1p((n - frequency + 0.5) / (frequency + 0.5)), length / max(n, 1)).astype(np.float32)


def _weights(term: np.ndarray, count: np.ndarray, length: np.ndarray, statistics: np.ndarray) -> np.ndarray:
    return statistics[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * length / statistics[-1]))


def routed(pieces: DataFrame, statistics: np.ndarray) -> DataFrame:
    """``pieces`` with the two heaviest terms of each and a checksum to break ties."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rests = [np.frombuffer(r.as_py(), "<u2") for r in batch.column("rest")]
            routes = np.full((len(rests), 2), -1, np.int32)
            if rests:
                lengths = np.array([len(r) for r in rests])
                piece, term, count = _terms(rests)
                order = np.lexsort((term, -_weights(term, count, lengths[piece], statistics), piece))
                begins = np.searchsorted(piece, np.arange(len(rests)))
                sizes = np.diff(np.append(begins, len(piece)))
                for nth in (0, 1):
                    some = sizes > nth
                    routes[some, nth] = term[order][begins[some] + nth]
            salts = pa.array([zlib.crc32(r.tobytes() + str(d).encode()) for r, d in zip(
                rests, batch.column("doc_id").to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(routes[:, 0]), pa.array(routes[:, 1]), salts],
                                             [*batch.schema.names, "route", "route2", "salt"])

    return pieces.mapInArrow(
        run, "doc_id long, tokens long, sums array<long>, rest binary, route int, route2 int, salt long")


class Shard:
    """An inverted index over some pieces, from which windows are filled."""

    def __init__(self, rests: list[np.ndarray], statistics: np.ndarray):
        piece, self.term, count = _terms(rests)
        lengths = np.array([len(r) for r in rests])
        weight = _weights(self.term, count, lengths[piece], statistics)
        by_term = np.argsort(self.term.astype(np.uint16), kind="stable")
        self.holders, self.weights = piece[by_term], weight[by_term]
        terms, begins = np.unique(self.term[by_term], return_index=True)
        ends = np.append(begins[1:], len(by_term))
        slot = np.searchsorted(terms, self.term)
        self.begin, self.size = begins[slot], (ends - begins)[slot]  # the posting list of each (piece, term)
        self.bounds = np.searchsorted(piece, np.arange(len(rests) + 1))
        self.n = len(rests)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every piece for the terms of one of them."""
        own = slice(self.bounds[seed], self.bounds[seed + 1])
        begin, size = self.begin[own], self.size[own]
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(self.holders[at], self.weights[at], self.n)


def _filled(rests: list[np.ndarray], left: np.ndarray, statistics: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of ``(piece, start, length)`` until less than a window is left; updates ``left``, the first id unused."""
    index = Shard(rests, statistics)
    sizes = np.array([len(r) for r in rests]) - left
    while sizes.sum() >= WINDOW:
        seed = int(sizes.argmax())
        window, room = [(seed, int(left[seed]), int(sizes[seed]))], WINDOW - int(sizes[seed])
        left[seed], sizes[seed] = len(rests[seed]), 0
        if room:
            ranked = np.argsort(-index.scores(seed), kind="stable")
            order = ranked[sizes[ranked] > 0]
            while room and len(order):
                fits = sizes[order] <= room
                nth = int(fits.argmax())
                if not fits[nth]:
                    break
                piece = int(order[nth])
                window.append((piece, int(left[piece]), int(sizes[piece])))
                room -= int(sizes[piece])
                left[piece], sizes[piece] = len(rests[piece]), 0
                order = order[nth + 1:]
            rest = ranked[sizes[ranked] > 0]
            if room >= LEAST_CUT and len(rest):
                piece = int(rest[0])
                window.append((piece, int(left[piece]), room))
                left[piece] += room
                sizes[piece] -= room
        yield window


def _halved(rests: list[np.ndarray], left: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """What is left, less than a window, as sequences whose lengths are powers of two."""
    queue = [[i, int(a), len(r) - int(a)] for i, (r, a) in enumerate(zip(rests, left)) if len(r) > a]
    total = sum(q[2] for q in queue)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        sequence = []
        while room:
            piece, start, size = queue[0]
            take = min(size, room)
            sequence.append((piece, start, take))
            room -= take
            if take == size:
                queue.pop(0)
            else:
                queue[0] = [piece, start + take, size - take]
        yield sequence


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, id_column: str = "doc_id",
                   text_column: str = "text") -> DataFrame:
    """The pieces of all documents and their places in sequences of at most ``WINDOW`` ids.

    ``tokenizer`` is the tokenizer file; ``ranks`` may name the same vocabulary for
    the faster library. Every row is a document of its own, also with a null or
    repeated id; null texts count as empty, and an empty text is the one id 0. An
    empty table gives no pieces. Other columns are not read. Sequence ids are
    unique, not dense.
    """
    pieces = encoded_pieces(docs, tokenizer, ranks, id_column, text_column)
    statistics = term_statistics(pieces)
    parts = pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = (routed(pieces, statistics)
             .repartitionByRange(int(parts), "route", "route2", "salt")
             .sortWithinPartitions("route", "route2", "salt", "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = task.partitionId() << 40
        ids: list = []
        counts: list[int] = []
        rests: list[np.ndarray] = []
        starts: list[int] = []
        left: list[int] = []
        out: list[tuple] = []

        def place(windows) -> None:
            nonlocal number
            for window in windows:
                offset = 0
                for piece, start, length in window:
                    sum32 = zlib.crc32(rests[piece][start:start + length].astype("<u4").tobytes())
                    out.append((ids[piece], starts[piece] + start, length, sum32, counts[piece], number, offset))
                    offset += length
                number += 1

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [
                "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        def packed() -> None:
            nonlocal ids, counts, rests, starts, left
            used = np.array(left, dtype=np.int64)
            place(_filled(rests, used, statistics))
            still = [i for i, r in enumerate(rests) if used[i] < len(r)]
            ids, counts, rests, starts, left = ([column[i] for i in still] for column in (
                ids, counts, rests, starts, used.tolist()))

        for batch in batches:
            for doc, tokens, sums, rest in zip(*(batch.column(i) for i in range(4))):
                doc, tokens = doc.as_py(), tokens.as_py()
                sums = sums.as_py()
                for i, sum32 in enumerate(sums):
                    out.append((doc, i * WINDOW, WINDOW, sum32, tokens, number, 0))
                    number += 1
                if tokens > len(sums) * WINDOW:
                    ids.append(doc)
                    counts.append(tokens)
                    rests.append(np.frombuffer(rest.as_py(), "<u2"))
                    starts.append(len(sums) * WINDOW)
                    left.append(0)
                if len(rests) >= SHARD_PIECES:
                    packed()
                if len(out) >= 10_000:
                    yield flushed()
        packed()
        place(_halved(rests, np.array(left, dtype=np.int64)))
        yield flushed()

    return dealt.select("doc_id", "tokens", "sums", "rest").mapInArrow(run, PIECES)
