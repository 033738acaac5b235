"""Nearest vectors by inner product through an inverted file: clusters of all vectors, of which a query opens few.

An index has the clusters' centroids and radii, and each vector with its cluster. No vector x of a cluster can score more for a query q
than q.c + |q| r, with the centroid c and the radius r. A search first scores the clusters of the best bounds, which gives each query
a k-th best score; exact search then opens all clusters whose bound reaches it, and no others can hold a better vector. The
approximate search ends after the first step.

Clusters are cut into blocks of rows, and what a query and a block give is one matrix product in the task that has both, so a
cluster with a third of all vectors, or one that every query opens, is the work of many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.staging import staged

#: Clusters at most, as their centroids go to all tasks; rows a block, and queries that a block meets at a time.
MOST_CLUSTERS, BLOCK_ROWS, BLOCK_QUERIES = 4096, 8192, 2048
#: Scores are rounded to so many digits, so bounds are wider by more than half of the last one.
DIGITS, SLACK = 6, 2e-6
#: Vectors that the clusters are fitted on at most, by the smallest hashes of their ids; all are indexed.
FIT_ROWS = 100_000


@dataclass
class Index:
    """rows: id, embedding, cluster, block; centroids (clusters x components) and radii; sizes: rows of each cluster."""

    rows: DataFrame
    centroids: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    id: str


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _whole(vector: str, width: int):
    return F.col(vector).isNotNull() & (F.size(vector) == width) & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids * centroids).sum(1)[None] - 2 * x @ centroids.T).argmin(1)


def fitted(rows: DataFrame, id: str, vector: str, clusters: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids of up to FIT_ROWS rows by rounds of assigning and averaging; sums are made in the tasks."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")))
    sample = staged(rows.select(key.alias("key"), F.col(vector).alias("v")).orderBy("key", "v").limit(FIT_ROWS), "sample")
    first = sample.orderBy("key", "v").limit(clusters).collect()
    centroids = np.array([r["v"] for r in first], dtype=np.float64)

    def sums(now):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                x = _matrix(batch.column("v"))
                own, back = np.unique(_nearest(x, now), return_inverse=True)
                total = np.zeros((len(own), x.shape[1]))
                np.add.at(total, back, x)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(np.bincount(back), pa.int64()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["cluster", "n", "total"])

        return run

    for _ in range(rounds if len(centroids) else 0):
        parts = sample.select("v").mapInArrow(sums(centroids), "cluster int, n long, total array<double>")
        moved = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(centroids.shape[1]))).collect()
        for r in moved:
            centroids[r["cluster"]] = np.array([r[f"s{i}"] for i in range(centroids.shape[1])]) / r["n"]
    return centroids


def build(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", clusters: int | None = None, rounds: int = 5, seed: int = 1) -> Index:
    """An index of all vectors; by default of the square root of their number of clusters, MOST_CLUSTERS at most. Null vectors, ones with
    null or non-finite components and ones of another width than the commonest take no part; repeated ids are rows of their own."""
    width = vectors.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("w")).count().where("w > 0").orderBy(F.desc("count"), "w").first()
    kept = vectors.where(F.col(id).isNotNull() & _whole(vector, width["w"] if width else 0)).select(F.col(id), F.col(vector).alias("embedding"))
    n = kept.count()
    clusters = min(MOST_CLUSTERS, max(1, round(sqrt(n))) if clusters is None else clusters)
    centroids = fitted(kept, id, "embedding", clusters, rounds, seed)
    kind = kept.schema[id].dataType.simpleString()

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch.column("embedding"))
            own = _nearest(x, centroids)
            away = np.sqrt(((x - centroids[own]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(id), batch.column("embedding"), pa.array(own, pa.int32()), pa.array(away)], names=[id, "embedding", "cluster", "away"])

    inner = kept.schema["embedding"].dataType.simpleString()
    rows = staged(kept.mapInArrow(assign, f"`{id}` {kind}, embedding {inner}, cluster int, away double"), "assigned")
    found = {r["cluster"]: r for r in rows.groupBy("cluster").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
    sizes = np.array([found[c]["n"] if c in found else 0 for c in range(len(centroids))], dtype=np.int64)
    radii = np.array([found[c]["radius"] if c in found else 0.0 for c in range(len(centroids))])
    blocks = F.array(*(F.lit(max(1, ceil(s / BLOCK_ROWS))) for s in sizes.tolist())) if len(sizes) else F.array(F.lit(1))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.get(blocks, F.col("cluster"))).cast("int"))
    return Index(staged(dealt.drop("away").repartition("cluster", "block"), "index"), centroids, radii * (1 + 1e-9) + 1e-12, sizes, id)


def _opened(queries: DataFrame, index: Index, kind: str, parts: int, choose) -> DataFrame:
    """src, q and each block of the clusters that choose(bounds, order, the batch) names for a query."""
    centroids, radii, sizes = index.centroids, index.radii, index.sizes

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            q = _matrix(batch.column("q"))
            bounds = q @ centroids.T + np.sqrt((q * q).sum(1))[:, None] * radii[None] + SLACK
            bounds[:, sizes == 0] = -np.inf
            order = np.argsort(-bounds, axis=1, kind="stable")
            row, cluster = choose(bounds, order, batch)
            blocks = np.maximum(1, -(-sizes[cluster] // BLOCK_ROWS))
            row, cluster = np.repeat(row, blocks), np.repeat(cluster, blocks)
            block = np.concatenate([np.arange(b) for b in blocks]) if len(blocks) else np.zeros(0, dtype=np.int64)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("src").take(at), batch.column("q").take(at), pa.array(cluster, pa.int32()), pa.array(block, pa.int32())], names=["src", "q", "cluster", "block"])

    out = queries.mapInArrow(run, f"src {kind}, q array<double>, cluster int, block int")
    return out.withColumn("part", F.pmod(F.xxhash64("src"), F.lit(parts)).cast("int"))


def _scored(pairs: DataFrame, index: Index, kind: str, parts: int, k: int) -> DataFrame:
    """src, dst, score: the k best of each block for each query that opens it."""

    def run(left, right):
        import pyarrow as pa

        src, dst, score = [], [], []
        if left.num_rows and right.num_rows:
            x, q = (_matrix(t[c].combine_chunks()) for t, c in ((left, "embedding"), (right, "q")))
            ids, own = left["dst"].to_numpy(zero_copy_only=False), right["src"].to_numpy(zero_copy_only=False)
            for i, s in enumerate(np.round(q @ x.T, DIGITS)):
                s[ids == own[i]] = -np.inf
                cut = np.partition(s, -k)[-k] if len(s) > k else -np.inf
                some = np.flatnonzero((s >= cut) & (s > -np.inf))
                some = some[np.lexsort((ids[some], -s[some]))[:k]]
                src += [own[i]] * len(some)
                dst += ids[some].tolist()
                score += s[some].tolist()
        return pa.table({"src": pa.array(src, right.schema.field("src").type), "dst": pa.array(dst, left.schema.field("dst").type), "score": pa.array(score, pa.float64())})

    met = pairs.select(F.col("cluster").alias("_c"), F.col("block").alias("_b"), F.col("part").alias("_p")).distinct()
    rows = index.rows.select(F.col(index.id).alias("dst"), "embedding", F.col("cluster").alias("_oc"), F.col("block").alias("_ob"))
    rows = rows.join(met, (F.col("_oc") == F.col("_c")) & (F.col("_ob") == F.col("_b"))).select("dst", "embedding", "_c", "_b", "_p")
    return rows.groupBy("_c", "_b", "_p").cogroup(pairs.groupBy("cluster", "block", "part")).applyInArrow(run, f"src {kind}, dst {kind}, score double")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 10, probes: int = 4, exact: bool = True, vector: str = "embedding") -> DataFrame:
    """src, rank, dst, score of each query's k best vectors but its own, ties to the smaller id; scores are rounded to six digits.

    queries: the index's id, unique, and a vector of its width; others have no rows. probes: clusters that are opened first; with
    exact, all others that may hold one of the k best are opened too."""
    kind = index.rows.schema[index.id].dataType.simpleString()
    width = index.centroids.shape[1] if index.centroids.size else 0
    asked = queries.where(_whole(vector, width)).select(F.col(index.id).cast(kind).alias("src"), F.transform(vector, lambda x: x.cast("double")).alias("q"))
    if not width:
        return asked.select("src", F.lit(0).alias("rank"), F.col("src").alias("dst"), F.lit(0.0).alias("score")).where("false")
    asked = staged(asked, "queries")
    parts = max(1, ceil(asked.count() / BLOCK_QUERIES))

    def first(bounds, order, batch):
        rows, cols = np.nonzero(np.take_along_axis(bounds, order[:, :probes], 1) > -np.inf)
        return rows, order[rows, cols]

    near = staged(_ranked(_scored(staged(_opened(asked, index, kind, parts, first), "opened"), index, kind, parts, k), k), "near")
    if not exact:
        return near.select("src", "rank", "dst", "score")
    kth = near.where(F.col("rank") == k).select("src", F.col("score").alias("kth"))
    held = asked.join(kth, "src", "left").select("src", "q", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))

    def others(bounds, order, batch):
        seen = np.zeros(bounds.shape, dtype=bool)
        np.put_along_axis(seen, order[:, :probes], True, 1)
        need = batch.column("kth").to_numpy(zero_copy_only=False)
        return np.nonzero(~seen & (bounds >= need[:, None]) & (bounds > -np.inf))

    rest = staged(_opened(held, index, kind, parts, others), "opened")
    both = near.select("src", "dst", "score").unionByName(_scored(rest, index, kind, parts, k))
    return _ranked(both, k).select("src", "rank", "dst", "score")


def recall(found: DataFrame, right: DataFrame) -> float:
    """The share of right's (src, dst) that found has."""
    n = right.count()
    return found.join(right.select("src", "dst"), ["src", "dst"], "left_semi").count() / n if n else 1.0
