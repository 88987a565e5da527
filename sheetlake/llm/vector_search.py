"""Nearest neighbours by inner product, from randomly rotated one-bit codes.

Each vector is centred on the mean of all, rotated by one random rotation and kept
as one sign bit per dimension with two correction scalars: its distance from the
mean, and the inner product of its direction with its own code. From these, the
inner product with a query has an unbiased estimate and an error bound that holds
for all but a small share of pairs; ``CONFIDENCE`` is its width in standard
deviations. Per block and query the best estimates are scored exactly first, which
gives a threshold, and then every vector whose upper bound reaches it.

The scan is flat: the given set of queries meets all codes, block by block. A block
pair is one group of bounded size, so neither side is ever whole in a task; the
work grows with queries times vectors, at one bit per dimension.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetlake.session import checkpointed

NEAREST = 20
QUERY_EVERY = 20
CONFIDENCE = 1.9
BLOCK, QUERY_BLOCK, AT_ONCE = 8192, 8192, 256
SEED = 7
CODED = "row long, vec_id long, dim int, bits binary, length double, aligned double, vector binary"


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random rotation, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & whole & F.exists(vector, lambda x: x != 0)


def _matrices(batch: pa.RecordBatch, column: str = "vector") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(dimension, positions, matrix)`` for the vectors of a batch, by dimension."""
    lists = batch.column(column)
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begins = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dim)
        yield dim, at, flat[begins[at][:, None] + np.arange(dim)]


def mean_vectors(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The mean of all vectors of each dimension; each task sends one row per dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for dim, at, matrix in _matrices(batch):
                n, total = sums.get(dim, (0, 0.0))
                sums[dim] = n + len(at), total + matrix.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()),
             pa.array([t.tolist() for _, t in sums.values()], pa.list_(pa.float64()))], ["dim", "n", "total"])

    parts = vectors.select("vector").mapInArrow(run, "dim int, n long, total array<double>")
    rows = (parts.select("dim", "n", F.posexplode("total")).groupBy("dim", "pos")
            .agg((F.sum("col") / F.sum("n")).alias("mean")).groupBy("dim")
            .agg(F.sort_array(F.collect_list(F.struct("pos", "mean"))).alias("means")).collect())
    return {r.dim: np.array([m.mean for m in r.means]) for r in rows}


def coded(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The index: every usable row with its code, correction scalars and original vector, stored."""
    kinds = table.select(F.col(id_column).cast("long").alias("vec_id"),
                         F.col(vector_column).cast("array<double>").alias("vector"))
    vectors = kinds.where(usable("vector"))
    means = mean_vectors(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id")
            rows = batch.column("row")
            for dim, at, matrix in _matrices(batch):
                centred = matrix - means[dim]
                length = np.sqrt((centred ** 2).sum(axis=1))
                turned = centred @ rotation(dim)
                with np.errstate(invalid="ignore", divide="ignore"):
                    aligned = np.abs(turned).sum(axis=1) / np.sqrt(dim) / length
                aligned[length == 0] = 1.0
                bits = np.packbits(turned > 0, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [rows.take(pa.array(at)), ids.take(pa.array(at)), pa.array(np.full(len(at), dim, np.int32)),
                     pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(length), pa.array(aligned),
                     pa.array([v.tobytes() for v in matrix], pa.binary())],
                    ["row", "vec_id", "dim", "bits", "length", "aligned", "vector"])

    index = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector")
    stored = checkpointed(index.mapInArrow(run, CODED))
    stored.means = means
    return stored


def _nearest(queries: pa.Table, block: pa.Table, means: dict[int, np.ndarray], nearest: int,
             confidence: float) -> pa.Table:
    """The best of one block for each query of one query block."""
    out: list[tuple] = []
    if len(queries) and len(block):
        dim = block.column("dim")[0].as_py()
        vectors = np.frombuffer(b"".join(block.column("vector").to_pylist())).reshape(-1, dim)
        packed = np.frombuffer(b"".join(block.column("bits").to_pylist()), np.uint8).reshape(len(vectors), -1)
        signs = np.unpackbits(packed, axis=1, count=dim).astype(np.float32) * 2 - 1
        length, aligned = (block.column(c).to_numpy() for c in ("length", "aligned"))
        scale = length / (aligned * np.sqrt(dim))
        spread = confidence * length * np.sqrt(np.maximum(1 - aligned ** 2, 0)) / aligned / np.sqrt(max(dim - 1, 1))
        rows = block.column("row").to_numpy()
        ids = block.column("vec_id")
        order_ids = ids.combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        ids = ids.to_pylist()
        asked = np.frombuffer(b"".join(queries.column("vector").to_pylist())).reshape(-1, dim)
        asked_rows = queries.column("row").to_numpy()
        asked_ids = queries.column("vec_id").to_pylist()
        for first in range(0, len(asked), AT_ONCE):
            part = asked[first:first + AT_ONCE]
            turned = (part @ rotation(dim)).astype(np.float32)
            estimates = (turned @ signs.T) * scale + (part @ means[dim])[:, None]
            norms = np.sqrt((part ** 2).sum(axis=1))
            for i, estimate in enumerate(estimates):
                query, own = part[i], asked_rows[first + i]
                ready = min(2 * nearest + 1, len(estimate))
                best = np.argpartition(-estimate, ready - 1)[:ready]
                best = best[rows[best] != own]
                exact = np.sort((vectors[best] * query).sum(axis=1))
                threshold = exact[-nearest] if len(exact) >= nearest else -np.inf
                slack = 1e-5 * norms[i] * (length + 1e-30)
                some = np.flatnonzero(estimate + spread * norms[i] + slack >= threshold)
                some = np.union1d(some[rows[some] != own], best)
                score = (vectors[some] * query).sum(axis=1)
                top = np.lexsort((rows[some], order_ids[some], -score))[:nearest]
                out += [(own, asked_ids[first + i], ids[some[t]], rows[some[t]], score[t]) for t in top]
    columns = list(zip(*out)) or [[]] * 5
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(),) * 4 + (pa.float64(),))],
                    names=["query_row", "query_id", "vec_id", "row", "score"])


def nearest_neighbours(table: DataFrame, every: int = QUERY_EVERY, nearest: int = NEAREST,
                       confidence: float = CONFIDENCE, block: int = BLOCK, query_block: int = QUERY_BLOCK,
                       id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``every``: its ``nearest`` rows by inner product.

    Rows whose vector is null, zero, or holds a null or non-finite component are
    neither queries nor candidates. A query leaves out its own row only; repeated
    ids are rows of their own, and a null id can be found (after equal scores)
    but does not ask. Vectors of different length do not meet. Equal scores go by
    the smaller id, then the earlier row. With fewer candidates all are returned,
    and an empty table gives no rows. Other columns are not read.
    """
    index = coded(table, id_column, vector_column)
    means = index.means
    asks = F.col("vec_id") % every == 0
    counts = index.groupBy("dim").agg(F.count("*").alias("n"), F.count(F.when(asks, 1)).alias("asking"))
    blocks = counts.select(F.col("dim").alias("__dim"), F.ceil(F.col("n") / block).alias("blocks"),
                           F.ceil(F.col("asking") / query_block).alias("query_blocks"))
    dealt = (index.join(blocks, F.col("dim") == F.col("__dim")).drop("__dim"))
    own_block = F.expr("pmod(xxhash64(row), blocks)")
    candidates = (dealt.where("query_blocks > 0").withColumn("block", own_block)
                  .withColumn("query_block", F.explode(F.expr("sequence(0L, query_blocks - 1)"))))
    queries = (dealt.where(asks).select(*[F.col(c).alias(c) for c in ("row", "vec_id", "dim", "vector", "blocks")],
                                        F.expr("pmod(xxhash64(row, 1), query_blocks)").alias("query_block"))
               .withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))))
    keys = ["dim", "block", "query_block"]
    found = (queries.drop("blocks").groupBy(*keys)
             .cogroup(candidates.drop("blocks", "query_blocks").groupBy(*keys))
             .applyInArrow(lambda left, right: _nearest(left, right, means, nearest, confidence),
                           "query_row long, query_id long, vec_id long, row long, score double"))
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)
            .select("query_id", "rank", "vec_id", "score"))
