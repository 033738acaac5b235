"""Vector code compression: vectors cut into parts, each part replaced by the index of the nearest entry of its codebook.

A part's squared distances to all entries, less the part's own square, are one float32 matrix product: [x, 1] times [-2c, |c|^2].
Each result has an interval that holds the exact value: a product of k terms, with factors rounded before, is off by no more
than gamma(k + 2) times the sum of the terms' magnitudes, in whatever order it is added, with gamma(n) = n u / (1 - n u) and
u = 2**-24; and the magnitudes sum to 2 |x| |c| + |c|^2 at most. Every entry whose interval overlaps that of the best is
computed again in whole numbers; ties go to the lower index. So codes are exact, and few entries need the second look.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import small, staged
from leafmill.llm.whole_vectors import as_longs, finite, floors, grouped_sums, magnitude, matrices, tree_sum, whole_mean

#: A label's error is broadcast for up to so many labels; beyond it, it comes by a shuffle.
BROADCAST_LABELS = 200_000
_UNIT = 2.0**-24
#: Parts with components from here on are compared with all entries, as float32 cannot hold their squares.
FLOAT32 = 2**56


def overlapping(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, entries) of all pairs that may be the nearest of their row, by row, then entry."""
    d = x.shape[1]
    # Euclidean norms and squares in float64, whose errors of some 2**-53 of the same magnitudes one more rounding of float32 covers
    squares = (entries.astype(np.float64) ** 2).sum(1)
    norm_x, norm_c = np.sqrt((x.astype(np.float64) ** 2).sum(1)), np.sqrt(squares)
    a, b = np.ones((len(x), d + 1), dtype=np.float32), np.empty((d + 1, len(entries)), dtype=np.float32)
    a[:, :d], b[:d], b[d] = x, -2 * entries.T, squares
    found = (a @ b).astype(np.float64)
    gamma = (d + 4) * _UNIT / (1 - (d + 4) * _UNIT)
    radius = 1.0001 * gamma * (2 * norm_x[:, None] * norm_c[None] + squares[None])
    best = (found + radius).min(1)
    return np.nonzero(found - radius <= best[:, None])


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, ties to the lower one, and the exact squared distance."""
    if max(magnitude(x), magnitude(entries)) < FLOAT32:
        rows, cols = overlapping(x, entries)
    else:
        rows, cols = (v.ravel() for v in np.indices((len(x), len(entries))))
    if x.shape[1] * (magnitude(x) + magnitude(entries)) ** 2 >= 2**63:
        x, entries = x.astype(object), entries.astype(object)
    away = x[rows] - entries[cols]
    away = (away * away).sum(1)
    least = np.minimum.reduceat(away, np.searchsorted(rows, np.arange(len(x)))) if len(x) else away
    ties = np.flatnonzero(away == least[rows])
    first = ties[np.unique(rows[ties], return_index=True)[1]]
    return cols[first], least


def coded(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and summed squared distances of rows x."""
    parts, _, d = books.shape
    found = [nearest(x[:, p * d : (p + 1) * d], books[p]) for p in range(parts)]
    each = [e for _, e in found]
    total = sum(e.astype(object) for e in each) if any(magnitude(e) >= 2**62 // parts for e in each) else sum(each)
    return np.stack([c for c, _ in found], axis=1), total


def vectors_of(df: DataFrame, parts: int, vector: str = "embedding") -> tuple[DataFrame, int]:
    """The rows that take part, and their vectors' width: the commonest one that can be cut into so many parts (ties: the smaller)."""
    kept = df.where(finite(vector))
    size = F.size(vector)
    widths = kept.groupBy(size.alias("width")).count().where((F.col("width") > 0) & (F.col("width") % parts == 0))
    first = widths.orderBy(F.desc("count"), "width").first()
    width = first["width"] if first else 0
    return kept.where(size == width), width


def starting_books(kept: DataFrame, width: int, parts: int, entries: int, scale: int) -> np.ndarray:
    """parts x entries x (width / parts): the parts of the vectors with the smallest ids, ascending. A repeated id counts once, by its
    least vector."""
    ids = [r[0] for r in kept.select("vec_id").where("vec_id is not null").distinct().orderBy("vec_id").limit(entries).collect()]
    rows = kept.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("embedding").alias("v")).orderBy("vec_id").collect()
    start = floors(np.array([r["v"] for r in rows], dtype=np.float64).reshape(len(rows), width), scale)
    return np.stack(np.split(start, parts, axis=1))


def fitted_books(kept: DataFrame, width: int, parts: int, entries: int, rounds: int, scale: int) -> np.ndarray:
    """The codebooks after so many rounds of assigning every part and moving each entry to its parts' floored mean."""
    books = starting_books(kept, width, parts, entries, scale)
    count = books.shape[1]

    def partial(books):
        def run(batches):
            total = None
            for batch in batches:
                for _, x in matrices(batch, "embedding", width, scale):
                    codes, _ = coded(x, books)
                    d = books.shape[2]
                    sums = np.concatenate([grouped_sums(codes[:, p], x[:, p * d : (p + 1) * d], count) for p in range(parts)])
                    total = sums if total is None else total + sums
            if total is not None:
                yield total

        return run

    for _ in range(rounds if count else 0):
        flat = books.reshape(parts * count, -1)
        books = whole_mean(tree_sum(kept.select("embedding"), partial(books)), flat).reshape(books.shape)
    return books


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in books.ravel().tolist()).encode()).hexdigest()


def encode(kept: DataFrame, books: np.ndarray, width: int, scale: int, columns: list[str]) -> DataFrame:
    """The columns named, codes (array<int>) and error (squared distances over all parts; null where it is no long) of every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            codes, errors = [], []
            for _, x in matrices(batch, "embedding", width, scale):
                c, e = coded(x, books)
                codes.append(c)
                errors += as_longs(e)
            if not errors:
                continue
            flat = pa.array(np.concatenate(codes).ravel().astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(errors) + 1, dtype=np.int32) * books.shape[0]), flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), lists, pa.array(errors, pa.int64())], names=[*columns, "codes", "error"])

    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in columns)
    return kept.select(*columns, "embedding").mapInArrow(run, f"{schema}, codes array<int>, error long")


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, codes, error, label_error of every vector; the codebooks as whole numbers, parts x entries x width).

    Components become floor(scale * x). Codebooks start as the parts of the vectors with the smallest ids and are moved `rounds`
    times; then each part gets the index of its nearest entry. label_error is the error over all vectors of a label.

    vectors: vec_id, embedding, label; other columns are not read. Vectors that are null or hold null or non-finite components
    take no part, nor do those of another width than the commonest that parts divide (an empty one has none). Repeated
    rows are coded one by one and weigh in the means; a repeated id starts one entry, by its least vector; a null id
    starts none. With fewer ids than entries the codebooks are smaller; without any id there are none, and no rows. Null labels are one label. Sums and errors are exact
    at any size; an error beyond a long is null, and so is its label's. Empty tables give empty results.
    """
    spark = vectors.sparkSession
    kept, width = vectors_of(vectors.select("vec_id", "embedding", "label"), parts)
    books = fitted_books(kept, width, parts, entries, rounds, scale) if width else np.zeros((parts, 0, 1), dtype=np.int64)
    if not books.shape[1]:
        label = vectors.schema["label"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id long, label {label}, codes array<int>, error long, label_error long"), books
    out = staged(encode(kept, books, width, scale, ["vec_id", "label"]), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    fits = (F.count("error") == F.count("*")) & (total < F.lit(str(2**63)).cast("decimal(38,0)"))
    sums = out.groupBy(F.col("label").alias("_of")).agg(F.when(fits, total).cast("long").alias("label_error"))
    joined = out.join(small(sums, BROADCAST_LABELS), F.col("label").eqNullSafe(F.col("_of")))
    return joined.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "codes", "error", "label_error"), books
