"""Centroid clustering by sort-means over integer vectors.

Vectors become integers, so distances, sums and centroids are exact and any run gives the same clusters. Each round the driver orders, for each centroid, the other centroids by
their distance from it (k lists of k numbers). A vector begins at the centroid it had and walks that centroid's list; it stops strictly beyond twice its distance to the
centroid it had, as no centroid from there on can be nearer or as near. Then the centroids' sums are one aggregation that combines before the shuffle: a row a cluster comes back.

Vectors and their clusters stay cached on the executors from round to round. A round is a narrow step over the one before, so a lost executor's part is computed again from the
input table; nothing is shuffled but the sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

CLUSTERS, ROUNDS, DIM, SCALE, SEED = 8, 10, 64, 1024, 3
#: Components beyond this have no squared distance of DIM components in a long.
LARGEST = 1 << 27
ROWS = "vec_id long, v array<int>, cluster int, distance long"


def whole(rows: DataFrame, key: str, vector: str, dim: int, scale: float) -> DataFrame:
    """(vec_id, v): vectors with exactly dim components, none null or non-finite, as floor(scale * component)."""
    own = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    large = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * F.lit(float(scale))) >= float(LARGEST)))
    kept = own.filter(F.col("x").isNotNull() & (F.size("x") == dim) & ~large)
    return kept.select("vec_id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale))).cast("int")).alias("v"))


def first_centroids(v: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of "seed:id", those without an id last; of equal ids the smallest vectors. Fewer, if there are no more."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    found = v.withColumn("h", digest).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in found], dtype=np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def nearest(x: np.ndarray, was: np.ndarray, centroids: np.ndarray, order: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of the vectors x that were in clusters ``was``; of equally near centroids that of the smaller number.

    order[c]: the other centroids from the nearest to c on, apart[c]: their squared distances from c.
    """
    cluster, distance = was.copy(), squared(x, centroids[was])
    for c in np.unique(was):
        rows = np.flatnonzero(was == c)
        own = distance[rows].copy()
        for other, gap in zip(order[c], apart[c], strict=True):
            near = gap <= 4 * own  # beyond twice the distance, in squares
            rows, own = rows[near], own[near]
            if not len(rows):
                break
            d = squared(x[rows], centroids[other])
            better = (d < distance[rows]) | ((d == distance[rows]) & (other < cluster[rows]))
            cluster[rows[better]], distance[rows[better]] = other, d[better]
    return cluster, distance


def assigning(centroids: np.ndarray):
    """For mapInArrow over (vec_id, v[, cluster, distance]): each vector's cluster and squared distance."""
    gaps = np.array([squared(centroids, c) for c in centroids])
    order = np.array([[j for j in np.argsort(row, kind="stable") if j != i] for i, row in enumerate(gaps)], dtype=np.int64).reshape(len(gaps), -1)
    apart = np.take_along_axis(gaps, order, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.int64)
            was = batch.column(2).to_numpy().astype(np.int64) if batch.num_columns > 2 else np.zeros(batch.num_rows, dtype=np.int64)
            cluster, distance = nearest(x, was, centroids, order, apart) if batch.num_rows else (was, was)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "v", "cluster", "distance"])

    return run


def moved(centroids: np.ndarray, assigned: DataFrame) -> np.ndarray:
    """Every centroid that has vectors at the exact floor of their mean; the others stay."""
    dim = centroids.shape[1]
    sums = assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("v")[i].cast("long")) for i in range(dim)]).alias("sums"))
    out = centroids.copy()
    for r in sums.collect():  # a row a cluster
        out[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return out


def cluster(
    rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding", dim: int = DIM, scale: float = SCALE, seed: int = SEED
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, size), a row for each vector that takes part.

    Those are the vectors with exactly dim components, none null or non-finite, whose integers stay below LARGEST; rows that repeat an id, or all of a row, are vectors of their own, and ids may
    be null. The first centroids are the vectors with the smallest hashes of their ids; with fewer than k vectors there are as many centroids. Each of the rounds assigns all
    vectors, then moves the centroids; at the end vectors are assigned once more. distance is squared, cluster_inertia and inertia are its sums over the cluster and over all, size counts the
    cluster's vectors. No vector gives no rows; other columns are not read.
    """
    spark = rows.sparkSession
    v = whole(rows, key, vector, dim, scale)
    centroids = first_centroids(v, k, seed)
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, size long"
    if not len(centroids):
        return spark.createDataFrame([], result)
    held, at = None, v
    for _ in range(rounds):
        was, held = held, at.mapInArrow(assigning(centroids), ROWS).persist(StorageLevel.MEMORY_AND_DISK)
        centroids = moved(centroids, held)
        if was is not None:
            was.unpersist()
        at = held
    last = materialise(at.mapInArrow(assigning(centroids), ROWS).select("vec_id", "cluster", "distance"), "clusters")
    if held is not None:
        held.unpersist()
    each = last.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"), F.count("*").alias("size")).collect()  # a row a cluster
    total = sum(r["cluster_inertia"] for r in each)
    facts = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], total, [int(x) for x in centroids[r["cluster"]]], r["size"]) for r in each], "cluster int, cluster_inertia long, inertia long, centroid array<long>, size long")
    named = facts.withColumn("centroid_sha256", F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",").cast("binary"), 256))
    return last.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "size")
