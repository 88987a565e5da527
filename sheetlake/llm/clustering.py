"""Centroid clustering of whole-number vectors, by scalar lookup tables.

Components become whole numbers, so a dimension takes few different values. Vectors
are stored in blocks; a block keeps, for each dimension, the values that occur in it
and each vector's position among them. In every round a task tabulates, for each
dimension, the squared difference of each occurring value and each centroid. The
distances of a block are then gathers from those tables and sums, all in whole
numbers.

A task sends one row for each cluster and round (count and sums); the driver holds
the centroids only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlake.session import checkpointed, drop_scratch

DIMENSIONS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = 1
BLOCK = 4096
BLOCKED = "ids array<long>, values array<array<long>>, places binary"


def largest_component(dimensions: int) -> int:
    """Scaled components up to this, of either sign, have squared distances that a long can hold."""
    return math.isqrt((2 ** 63 - 1) // dimensions) // 2


def whole_vectors(table: DataFrame, dimensions: int, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id`` and the scaled ``vector`` of the rows that take part."""
    vectors = table.select(F.col(id_column).cast("long").alias("vec_id"),
                           F.col(vector_column).cast("array<double>").alias("vector"))
    scaled = vectors.where((F.size("vector") == dimensions) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)))
    fits = F.forall("vector", lambda x: F.abs(x * scale) <= float(largest_component(dimensions)))
    return scaled.where(fits).select("vec_id", F.transform("vector", lambda x: F.floor(x * scale)).alias("vector"))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the smallest digests, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(digest.alias("digest"), "vector").orderBy("digest", "vector").limit(clusters).collect()
    return np.array([r.vector for r in rows], np.int64)


def blocks(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """The vectors in blocks: ids, the values that occur in each dimension, and each vector's places among them, stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                matrix = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                found = [np.unique(column, return_inverse=True) for column in matrix.T]
                places = np.stack([place for _, place in found]).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                     pa.array([[values.tolist() for values, _ in found]], pa.list_(pa.list_(pa.int64()))),
                     pa.array([places.tobytes()], pa.binary())], ["ids", "values", "places"])

    return checkpointed(vectors.mapInArrow(run, BLOCKED))


def _distances(values: list[list[int]], places: bytes, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, vectors by centroids."""
    tables = [(np.array(occurring, np.int64)[:, None] - centroids[:, d]) ** 2 for d, occurring in enumerate(values)]
    total = 0
    for table, place in zip(tables, np.frombuffer(places, np.uint16).reshape(len(values), -1)):
        total = total + table[place]
    return total


def assigned(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple]:
    """``ids, matrix of values, clusters, distances`` for each block of a batch."""
    for row in batch.to_pylist():
        total = _distances(row["values"], row["places"], centroids)
        nearest = total.argmin(axis=1)  # the first of equal ones
        places = np.frombuffer(row["places"], np.uint16).reshape(len(row["values"]), -1)
        matrix = np.stack([np.array(v, np.int64)[p] for v, p in zip(row["values"], places)], axis=1)
        yield row["ids"], matrix, nearest, total[np.arange(len(nearest)), nearest]


def moved_centroids(stored: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the floor of the exact mean of its vectors; one without vectors stays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(centroids), np.int64)
        totals = np.zeros_like(centroids)
        for batch in batches:
            for _, matrix, nearest, _ in assigned(batch, centroids):
                counts += np.bincount(nearest, minlength=len(centroids))
                for cluster in np.unique(nearest):
                    totals[cluster] += matrix[nearest == cluster].sum(axis=0)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met.astype(np.int32)), pa.array(counts[met]), pa.array(totals[met].tolist(), pa.list_(pa.int64()))],
            ["cluster", "n", "totals"])

    parts = stored.mapInArrow(run, "cluster int, n long, totals array<long>")
    sums = (parts.select("cluster", "n", F.posexplode("totals").alias("dimension", "total")).groupBy("cluster", "dimension")
            .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(19,0)")).alias("total")).collect())
    moved = centroids.copy()
    for row in sums:  # clusters times dimensions
        moved[row.cluster, row.dimension] = int(row.total) // row.n
    return moved


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clustered(table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE,
              seed: int = SEED, id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of every vector that takes part, stored, and the final centroids.

    A vector takes part if it has exactly ``dimensions`` components, none null or
    non-finite, and none beyond :func:`largest_component` once scaled, whose distances a
    long could not hold. Ids may be null (digested as the empty text) or repeated: each row is a vector
    of its own, and equal digests go by the vector. With fewer vectors than clusters
    there are fewer clusters; without any there are no rows. Equal distances go to the
    smaller number. Other columns are not read.
    """
    vectors = whole_vectors(table, dimensions, scale, id_column, vector_column)
    centroids = first_centroids(vectors, clusters, seed).reshape(-1, dimensions)
    stored = blocks(vectors)
    if len(centroids):
        for _ in range(rounds):
            centroids = moved_centroids(stored, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, nearest, distance in assigned(batch, centroids):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nearest.astype(np.int32)), pa.array(distance)],
                                                 ["vec_id", "cluster", "distance"])

    found = checkpointed(stored.mapInArrow(run, "vec_id long, cluster int, distance long"))
    drop_scratch(stored)
    return found, centroids


def cluster_report(table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS,
                   scale: int = SCALE, seed: int = SEED, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """:func:`clustered` with the sums of distances and the digest of each centroid; a sum past a long is null."""
    found, centroids = clustered(table, clusters, rounds, dimensions, scale, seed, id_column, vector_column)
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("total")).collect()
    digests = [(r.cluster, r.total, sum(s.total for s in sums), centroid_digest(centroids[r.cluster])) for r in sums]
    each = table.sparkSession.createDataFrame(digests, "number int, own decimal(38,0), whole decimal(38,0), centroid_sha256 string")
    return found.join(F.broadcast(each), F.col("cluster") == F.col("number")).select(
        "vec_id", "cluster", "distance", F.col("own").try_cast("long").alias("cluster_inertia"),
        F.col("whole").try_cast("long").alias("inertia"), "centroid_sha256")
