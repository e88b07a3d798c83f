"""Operator 11: centroid clustering with scalar lookup tables.

Vectors become integers once, floor(scale * x). In each round every task tabulates, for each dimension, the squared
difference between each integer that occurs there and each centroid; a vector's distances to all centroids
are then gathers from these tables and their sum, with no product in the loop. A task hands on one row for each of its
clusters (a count and the components' sums), so what is shuffled grows with tasks and centroids alone, however uneven
the clusters are. Only the centroids, k rows, come to the driver between rounds.

All arithmetic is exact: integers beyond 2**27 on either side count as that bound, so that a squared distance of up to
100 components fits 64 bits. A sum of distances that doesn't fit is null. Vectors that are null, of another
length, or that hold null or non-finite components take no part. Repeated rows are vectors of their own. A null
vec_id is clustered as any other, but starts as a centroid only where fewer than k ids aren't null; equal ids are
ordered by their integers. Fewer than k vectors give as many centroids; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import pick, stored

BOUND = 1 << 27


def integers(vectors: DataFrame, dims: int, scale: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v, the integers of every vector that takes part."""
    given = pick(vectors, vec_id=id_col, e=vector_col).select("vec_id", F.col("e").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("e", lambda x: F.greatest(F.least(F.floor(x * F.lit(float(scale))), F.lit(BOUND)), F.lit(-BOUND)).cast("int"))
    return given.filter((F.size("e") == dims) & finite).select("vec_id", whole.alias("v"))


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The integers of the k vectors whose hashed ids are smallest, in that order."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select(named.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k)
    return np.array([r["v"] for r in first.collect()], np.int64)


def occurring(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The integers that occur in a column, and each row's place among them."""
    low = int(column.min())
    span = int(column.max()) - low + 1
    if span > 1 << 16:
        return np.unique(column, return_inverse=True)
    seen = np.zeros(span, bool)
    seen[column - low] = True
    return np.flatnonzero(seen) + low, (np.cumsum(seen) - 1)[column - low]


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid (the first of equal ones) and squared distance, by tables of scalars."""
    total = np.zeros((len(v), len(centroids)), np.int64)
    for d in range(v.shape[1]):
        values, places = occurring(v[:, d])
        squares = (values[:, None] - centroids[None, :, d]) ** 2
        total += squares.take(places, axis=0)
    best = total.argmin(1)
    return best, total[np.arange(len(v)), best]


def blocks(batches: Iterator[pa.RecordBatch], dims: int, rows: int = 4096) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for b in batches:
        for k in range(0, b.num_rows, rows):
            part = b.slice(k, rows)
            yield part.column("vec_id"), part.column("v").flatten().to_numpy().reshape(-1, dims).astype(np.int64)


def summed(centroids: np.ndarray):
    """One row for each cluster that the task meets: its vectors' number, and the sums of their components."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, v in blocks(batches, dims):
            best, _ = nearest(v, centroids)
            order = best.argsort(kind="stable")
            own, first = np.unique(best[order], return_index=True)
            sums[own] += np.add.reduceat(v[order], first)
            n += np.bincount(best, minlength=k)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n[own]), *map(pa.array, sums[own].T)], names=["cluster", "n", *(f"s{d}" for d in range(dims))])

    return run


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round."""
    dims = centroids.shape[1]
    names = ["n", *(f"s{d}" for d in range(dims))]
    parts = vectors.mapInArrow(summed(centroids), "cluster int, " + ", ".join(f"{c} long" for c in names))
    after = centroids.copy()
    for r in parts.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in names]).collect():
        after[r["cluster"]] = [r[f"s{d}"] // r["n"] for d in range(dims)]
    return after


def assigned(centroids: np.ndarray, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v in blocks(batches, centroids.shape[1]):
            best, distance = nearest(v, centroids)
            yield pa.RecordBatch.from_arrays([ids.cast(id_type), pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: float = 256.0, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and the centroid (array) of every vector that takes part."""
    spark = vectors.sparkSession
    table = stored(integers(vectors, dims, scale, id_col, vector_col))
    centroids = starts(table, k, seed)
    kind = table.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    for _ in range(rounds):
        centroids = moved(table, centroids)
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    found = stored(table.mapInArrow(assigned(centroids, id_type), f"vec_id {kind}, cluster int, distance long"))
    # k rows, made from the centroids that the driver has.
    own = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}
    total = None if None in own.values() or sum(own.values()) >= 1 << 63 else sum(own.values())
    rows = [(c, own.get(c), total, centroid.tolist()) for c, centroid in enumerate(centroids)]
    ends = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    ends = ends.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256))
    return found.join(F.broadcast(ends), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
