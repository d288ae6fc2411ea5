"""Centroid clustering of quantised vectors with scalar lookup tables.

A component x becomes the integer floor(scale * x). Squared distances are
never computed from vectors: a task tabulates, for every dimension, integer
value that occurs in its batch, and centroid, the squared difference once; the
distance of a vector to all centroids is then the sum of one gathered table
row for each dimension. A table holds as many rows as its batch has distinct
(dimension, value) pairs, so its size is bounded by ``batch_rows`` whatever
the table.

A round assigns every vector to its nearest centroid (ties: the smaller
number) and sends, for each task, one partial sum for each cluster; Spark adds
those up and the driver sees k x dims sums, never vectors. A non-empty
cluster's centroid becomes the componentwise floor(sum / count), exactly, as
integers; an empty cluster's stays. After the last round the vectors are
assigned once more.

The quantised vectors are written once and read by every round, so a lost
executor repeats part of one round.

Defined cases: a vector that is null, has another number of components, or
holds a null or non-finite component has no row in the result. First centroids
are the k vectors with the smallest hex digest of ``seed:vec_id``; vectors
that share an id go by their components, a null vec_id comes last and is
clustered like any other. With fewer than k vectors each is a first centroid,
copies included. Repeated rows are vectors of their own. An empty table gives
an empty result; other columns are ignored. A component of 2**19 or more in
magnitude raises, as a distance could then exceed a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesflow.llm._common import materialize, scratch

# Rows that a task looks at in one go.
BATCH_ROWS = 4096
# Integers below this keep a squared distance over 64 dimensions within a long.
LARGEST = 1 << 27


def quantised(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id, q (integers) of the vectors that take part."""
    finite = f"forall(embedding, x -> x IS NOT NULL AND abs(CAST(x AS DOUBLE)) < double('Infinity'))"
    whole = (f"transform(embedding, x -> CAST(CASE WHEN abs({scale}D * x) < {LARGEST} THEN floor({scale}D * x) "
             f"ELSE raise_error('component out of range') END AS INT))")
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
            .filter(f"size(embedding) = {dims}").filter(finite)
            .select("vec_id", F.expr(whole).alias("q")))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("q").flatten().to_numpy().reshape(-1, dims).astype(np.int64)


def scalar_codes(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of every component in the lookup table, and the dimension and value of each of its rows."""
    low = int(q.min())
    span = int(q.max()) - low + 1
    keys = np.arange(q.shape[1]) * span + (q - low)
    if q.shape[1] * span <= 4 * q.size:  # few values: mark those that occur
        seen = np.zeros(q.shape[1] * span, bool)
        seen[keys.ravel()] = True
        found, codes = np.flatnonzero(seen), (np.cumsum(seen) - 1)[keys]
    else:
        found, codes = np.unique(keys, return_inverse=True)
        codes = codes.reshape(q.shape)
    return codes, found // span, found % span + low


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and the squared distance, from table gathers and sums."""
    codes, dim, value = scalar_codes(q)
    table = np.square(value[:, None] - centroids.T[dim])
    total = np.zeros((len(q), len(centroids)), np.int64)
    for d in range(q.shape[1]):
        total += table[codes[:, d]]
    cluster = total.argmin(axis=1)  # the first of equals
    return cluster, total[np.arange(len(q)), cluster]


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _partial_sums(centroids: np.ndarray, batch_rows: int):
    """One row for each cluster and dimension of a task's vectors: their sum and number."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for part in _pieces(batches, batch_rows):
            q = _matrix(part, dims)
            cluster, _ = nearest(q, centroids)
            np.add.at(sums, cluster, q)
            counts += np.bincount(cluster, minlength=k)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, dims).astype(np.int32)), pa.array(np.tile(np.arange(dims, dtype=np.int32), len(used))),
             pa.array(sums[used].ravel()), pa.array(np.repeat(counts[used], dims))],
            ["cluster", "dim", "total", "n"])
    return run


def _assign(centroids: np.ndarray, batch_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches, batch_rows):
            cluster, distance = nearest(_matrix(part, centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                ["vec_id", "cluster", "distance"])
    return run


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The components of the k vectors whose ids hash lowest (k rows at most reach the driver)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = rows.orderBy(digest.asc_nulls_last(), "q").limit(k).select("q").collect()
    return np.array([r.q for r in chosen], np.int64)


def moved(rows: DataFrame, centroids: np.ndarray, batch_rows: int) -> np.ndarray:
    """The centroids after one round over all vectors."""
    sums = (rows.mapInArrow(_partial_sums(centroids, batch_rows), "cluster int, dim int, total long, n long")
            .groupBy("cluster", "dim")
            .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")))
    out = centroids.copy()
    for r in sums.collect():  # k x dims rows at most
        out[r.cluster, r.dim] = int(r.total) // r.n
    return out


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2,
             batch_rows: int = BATCH_ROWS, folder: str | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    folder = folder or scratch(spark, "clusters")
    rows = materialize(quantised(vectors, dims, scale), folder + "/rows")
    centroids = first_centroids(rows, k, seed).reshape(-1, dims)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, "
                                         "inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(rows, centroids, batch_rows)
    assigned = materialize(rows.mapInArrow(_assign(centroids, batch_rows), "vec_id long, cluster int, distance long"),
                           folder + "/assigned")
    digests = spark.createDataFrame(
        [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())],
        "own int, centroid_sha256 string")
    per = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # k rows: each cluster's sums and digest.
    facts = (per.join(F.broadcast(digests), per.cluster == digests.own)
             .select("own", "cluster_inertia", per.agg(F.sum("cluster_inertia")).scalar().alias("inertia"),
                     "centroid_sha256"))
    return (assigned.join(F.broadcast(facts), F.col("cluster") == F.col("own"))
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
