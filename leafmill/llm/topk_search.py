"""Exact top-k search by inner product with MaxScore.

Components are terms: a vector is a document that holds each component with its value, and a query weighs the terms by its
own components. In a shard, a term's impact is its product less the least product of any document there, so impacts are not
negative and have an upper bound for each query. MaxScore splits the terms by these bounds: documents that only have the
non-essential ones cannot reach the k-th best score. The postings of the essential terms are traversed, and the other terms
probed, largest bound first, for the documents that are still competitive. Shards' results are merged.
"""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors a shard and queries a block; a task holds one of each.
SHARD_ROWS, BLOCK_ROWS = 8192, 2048


def maxscore(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, own: int, k: int, lows: np.ndarray, highs: np.ndarray, order: np.ndarray) -> list[tuple[int, int]]:
    """The k best (score, id) of vectors for query, own left out. lows, highs: least and greatest value of each term; order: each
    term's postings by value. All comparisons are of whole numbers, and ties are never pruned, so the result is exact."""
    a, b = query * lows, query * highs
    least, bounds = np.minimum(a, b), np.abs(b - a)
    terms = np.argsort(-bounds, kind="stable")
    # the documents with the greatest impacts of the weightiest terms give a first threshold
    ends = [order[-4 * k :, t] if query[t] > 0 else order[: 4 * k, t] for t in terms[:8]]
    seeds = np.unique(np.concatenate(ends)) if ends else np.arange(0)
    seeds = seeds[ids[seeds] != own]
    scores = np.sort(vectors[seeds] @ query)
    floor = least.sum()
    need = scores[-k] - floor if len(scores) >= k else None
    rest = np.concatenate([np.cumsum(bounds[terms][::-1])[::-1], [0]])  # rest[i]: bound of all terms from the i-th on
    essential = len(terms) if need is None else int(np.searchsorted(-rest, -need, side="right"))  # rest[i] < need from here on
    ess = terms[:essential]
    alive = np.flatnonzero(ids != own)
    gained = vectors[alive][:, ess] @ query[ess] - least[ess].sum() if len(ess) < vectors.shape[1] else vectors[alive] @ query - floor
    for i in range(len(ess), len(terms)):
        keep = gained + rest[i] >= need
        alive, gained = alive[keep], gained[keep]
        t = terms[i]
        gained = gained + vectors[alive, t] * query[t] - least[t]
    if len(alive) > k:
        cut = np.partition(gained, -k)[-k]
        alive, gained = alive[gained >= cut], gained[gained >= cut]
    best = np.lexsort((ids[alive], -gained))[:k]
    return [(int(gained[i] + floor), int(ids[alive[i]])) for i in best]


def _matrix(column, width: int) -> np.ndarray:
    lists = column.to_pylist()
    out = np.zeros((len(lists), width), dtype=np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _searcher(k: int):
    def search(left, right):
        import pyarrow as pa

        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            width = max(1, *(len(x) for t in (left, right) for x in t["v"].to_pylist()))
            ids, vectors = left["vec_id"].to_numpy(), _matrix(left["v"], width)
            queries = _matrix(right["v"], width)
            biggest = [max(1, *(abs(int(y)) for y in (x.min(), x.max()))) for x in (vectors, queries)]
            bound = biggest[0] * biggest[1] * width * 2
            kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object  # whole numbers, exact in each
            vectors, queries = vectors.astype(kind), queries.astype(kind)
            order = np.argsort(vectors, axis=0, kind="stable")
            lows, highs = vectors.min(axis=0), vectors.max(axis=0)
            for own, q in zip(right["vec_id"].to_pylist(), queries):
                for score, found in maxscore(ids, vectors, q, own, k, lows, highs, order):
                    out[0].append(own), out[1].append(found), out[2].append(max(-(2**63), min(2**63 - 1, score)))
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    return search


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and v = floor(256 * x), of the vectors that take part: not null, without null or non-finite components, with an
    id. Rows with one vec_id stay rows of their own."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v"))


def topk_search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Per query its k best vectors but itself: query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id.

    vectors, queries: vec_id and embedding; both are dealt by row number into shards of SHARD_ROWS and blocks of BLOCK_ROWS, and
    each pair of a shard and a block is one group, so no task or broadcast grows with the data. Shorter vectors are
    padded with zeros. Vectors that are null, or hold null or non-finite components, take no part; a query without any
    other vector has no rows. Rows with one id are candidates of their own, all of which are left out for that id's query; query
    rows with one id are one query, whose results are the best of all of them. Scores beyond 64 bits become the nearest number of
    64 bits. Empty tables give empty results; other columns are not read.
    """
    cands, asked = quantised(vectors), quantised(queries)
    n, m = (x.select("vec_id").where(F.col("vec_id").isNotNull()).count() for x in (vectors, queries))
    shards, blocks = max(1, ceil(n / SHARD_ROWS)), max(1, ceil(m / BLOCK_ROWS))
    deal = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")  # noqa: E731  an id may have many rows
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # a row is dealt before it is repeated, so that each candidate meets each query in one group
    left = cands.withColumn("shard", deal(shards)).select("vec_id", "v", "shard", each(blocks).alias("block"))
    right = asked.withColumn("block", deal(blocks)).select("vec_id", "v", each(shards).alias("shard"), "block")
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_searcher(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
