"""Centroid clustering by matrix products: |x|^2 - 2 x.c + |c|^2 in float64 blocks.

All numbers are whole. Where a block's greatest component m and the centroids' greatest M give width * (m + M)^2 < 2**53, each
product, partial sum and distance is a whole number that float64 holds, so BLAS gives exact distances in whatever order it
adds. Other blocks use int64, and Python's numbers beyond that. New centroids are floored means of sums that each
partition makes of its own rows and that a treeAggregate adds.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import staged
from leafmill.llm.whole_vectors import as_longs, finite, floors, grouped_sums, magnitude, matrices, tree_sum, whole_mean


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows x to centroids: float64 by matrix product, int64 or Python's numbers, as they fit."""
    bound = x.shape[1] * (magnitude(x) + magnitude(centroids)) ** 2
    kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object
    x, centroids = x.astype(kind), centroids.astype(kind)
    return (x * x).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(1)[None]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's nearest centroid, ties to the smaller one, and the squared distance."""
    away = squared_distances(x, centroids)
    least = away.min(1)
    return (away == least[:, None]).argmax(1), least


def starting_centroids(kept: DataFrame, k: int, width: int, scale: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes with the seed, by hash; of repeated ids, by vector. Null ids start none."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.where("vec_id is not null").select(key.alias("key"), "embedding").orderBy("key", "embedding").limit(k).collect()
    return floors(np.array([r["embedding"] for r in rows], dtype=np.float64).reshape(len(rows), width), scale)


def fitted_centroids(kept: DataFrame, k: int, rounds: int, width: int, scale: int, seed: int) -> np.ndarray:
    centroids = starting_centroids(kept, k, width, scale, seed)

    def partial(now):
        def run(batches):
            total = None
            for batch in batches:
                for _, x in matrices(batch, "embedding", width, scale):
                    sums = grouped_sums(nearest(x, now)[0], x, len(now))
                    total = sums if total is None else total + sums
            if total is not None:
                yield total

        return run

    for _ in range(rounds if len(centroids) else 0):
        centroids = whole_mean(tree_sum(kept.select("embedding"), partial(centroids)), centroids)
    return centroids


def assigned(kept: DataFrame, centroids: np.ndarray, width: int, scale: int) -> DataFrame:
    """vec_id, cluster, distance of every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            clusters, distances = [], []
            for _, x in matrices(batch, "embedding", width, scale):
                found, away = nearest(x, centroids)
                clusters += found.tolist()
                distances += as_longs(away)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(clusters, pa.int32()), pa.array(distances, pa.int64())], names=["vec_id", "cluster", "distance"])

    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, cluster int, distance long")


def centroid_sha256(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in centroid.tolist()).encode()).hexdigest()


def centroid_clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia, inertia of every vector; the centroids as whole numbers, k x width).

    Components become floor(scale * x). Centroids start as the k vectors whose sha256 of `seed:vec_id` is smallest, and each round
    assigns every vector to the nearest and moves each centroid to its vectors' floored mean; empty ones stay.

    vectors: vec_id and embedding; other columns are not read. Vectors that are null, have another width or hold null or
    non-finite components take no part. Rows with one id are vectors of their own, all of which may start a centroid; a null id
    starts none, so without any id there are no clusters and no rows. With fewer vectors than k there are fewer centroids.
    Sums and distances are exact at any size; a distance beyond a long is null, and so are the sums that hold it. Empty
    tables give empty results.
    """
    kept = vectors.select("vec_id", "embedding").where(finite() & (F.size("embedding") == width))
    centroids = fitted_centroids(kept, k, rounds, width, scale, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long"), centroids
    out = staged(assigned(kept, centroids, width, scale), "clusters")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r["cluster"]: r["total"] for r in out.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), total).alias("total")).collect()}
    long_or_null = lambda v: F.lit(int(v) if v is not None and v < 2**63 else None).cast("long")
    each = F.array(*(long_or_null(sums.get(i, 0)) for i in range(len(centroids))))
    whole = long_or_null(None if None in sums.values() else sum(sums.values()))
    return out.select("vec_id", "cluster", "distance", each[F.col("cluster")].alias("cluster_inertia"), whole.alias("inertia")), centroids
