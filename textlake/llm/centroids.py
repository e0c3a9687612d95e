"""Centroid clustering of vectors with scalar lookup tables.

1. Vectors with exactly ``dims`` components, none null or non-finite, become
   integers floor(scale * x) and are written once; the others are left out.
2. The first centroids are the ``k`` vectors with the smallest sha256 of
   ``seed:id``.
3. A round reads the written vectors.  For each dimension a task tabulates the
   squared difference of every integer value that occurs in a block of vectors
   to every centroid; a vector's distances are gathers from these tables, summed
   over the dimensions.  A task sends one row of sums for each centroid, so the
   shuffle carries k rows a task however the vectors are spread; the driver
   holds the k centroids and nothing else.
4. A centroid becomes the exact floor of sum / count of its vectors; one without
   vectors stays.  After the last round vectors are assigned once more.

Distances, sums and means are whole numbers, so the result doesn't depend on
the order of the rows, and a task that runs again gives the same.

Defined results.  A null vector, one of another length or with a null, NaN or
infinite component has no row in the result.  Scaled components beyond 2 ** 27
count as 2 ** 27 (of their sign), so that a distance fits a long; totals beyond
a long are its largest value.  Of equally near centroids the smaller number
wins.  Rows that repeat an id are vectors of their own; as first centroids they
come in order of their components.  Null ids come last there.  With fewer than
``k`` vectors each is a centroid.  An empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from textlake.llm.common import first_rows, save
from textlake.llm.words import bounded_batches, lists

#: Scaled components are held within plus and minus this.
MOST = 1 << 27
LONGEST = (1 << 63) - 1
#: Vectors of a block, for which tables are made.
BLOCK = 4096


def whole_vectors(rows: DataFrame, id_col: str, vec_col: str, dims: int, scale: float) -> DataFrame:
    """(id, q): the integer vectors of the rows that have ``dims`` finite components."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    scaled = lambda x: F.greatest(F.least(x.cast("double") * F.lit(float(scale)), F.lit(float(MOST))), F.lit(float(-MOST)))
    return rows.where((F.size(vec_col) == dims) & finite).select(
        F.col(id_col).alias("id"), F.transform(vec_col, lambda x: F.floor(scaled(x)).cast("int")).alias("q"))


def _vectors(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("q").flatten().to_numpy().astype(np.int64).reshape(-1, dims)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (vectors x centroids) by one table for each dimension."""
    total = np.zeros((len(vectors), len(centroids)), np.int64)
    for d in range(vectors.shape[1]):
        values, code = np.unique(vectors[:, d], return_inverse=True)
        table = (values[:, None] - centroids[:, d]) ** 2
        total += table[code]
    return total


def _sums(centroids: np.ndarray):
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            vectors = _vectors(batch, dims)
            for at in range(0, len(vectors), BLOCK):
                block = vectors[at:at + BLOCK]
                near = distances(block, centroids).argmin(axis=1)
                count += np.bincount(near, minlength=k)
                np.add.at(total, near, block)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(count[some]),
             lists(pa.array(total[some].reshape(-1)), np.full(len(some), dims))], names=["cluster", "n", "total"])
    return sums


def _assign(centroids: np.ndarray):
    dims = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _vectors(batch, dims)
            near, least = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for at in range(0, len(vectors), BLOCK):
                far = distances(vectors[at:at + BLOCK], centroids)
                near.append(far.argmin(axis=1))
                least.append(far.min(axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.concatenate(near).astype(np.int32)), pa.array(np.concatenate(least))],
                names=["id", "cluster", "distance"])
    return assign


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    place = F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("double") / F.lit(2.0**32)
    first = first_rows(vectors, [digest.asc_nulls_last(), F.col("q")], place, k)
    return np.array([r["q"] for r in first.collect()], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: exact floors of their vectors' means."""
    dims = centroids.shape[1]
    parts = vectors.select("q").mapInArrow(_sums(centroids), "cluster int, n bigint, total array<bigint>")
    sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(
        *[F.sum(F.col("total")[d]) for d in range(dims)]).alias("total")).collect()
    out = centroids.copy()
    for row in sums:
        out[row["cluster"]] = [s // row["n"] for s in row["total"]]
    return out


def centroid_clusters(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 40, rounds: int = 5,
                      dims: int = 64, scale: float = 256, seed: int = 2) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance, cluster_size, cluster_inertia, inertia, centroid_sha256), centroids):
    one row for each kept vector, and the final centroids as whole numbers."""
    spark = rows.sparkSession
    bounded_batches(spark)
    vectors = save(whole_vectors(rows, id_col, vec_col, dims, scale), "vectors")
    kind = vectors.schema["id"].dataType.simpleString()
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        none = vectors.select(F.col("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (
            ("cluster", "int"), ("distance", "bigint"), ("cluster_size", "bigint"), ("cluster_inertia", "bigint"),
            ("inertia", "bigint"), ("centroid_sha256", "string"))])
        return none, np.empty((0, dims), np.int64)
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    found = save(vectors.mapInArrow(_assign(centroids), f"id {kind}, cluster int, distance bigint"), "assigned")
    totals = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    inertia = min(LONGEST, sum(int(r["s"]) for r in totals))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of_cluster = spark.createDataFrame(
        [Row(r["cluster"], r["n"], min(LONGEST, int(r["s"])), inertia, digest[r["cluster"]]) for r in totals],
        "cluster int, cluster_size bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # k rows at most
    out = found.join(F.broadcast(of_cluster), on="cluster")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_size", "cluster_inertia", "inertia", "centroid_sha256"), centroids
