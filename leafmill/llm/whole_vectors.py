"""Vectors as whole numbers, and exact sums of them over all partitions; shared by vector codes and centroid clustering."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors that a task holds as matrices at a time.
BLOCK = 4096


def finite(vector: str = "embedding") -> Column:
    """Whether a vector is not null and all its components are finite numbers."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(whole, F.lit(False))


def floors(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, exactly: int64, or Python's numbers where a product is beyond 2**62. scale is a power of
    two, so the products are exact while they are finite."""
    with np.errstate(over="ignore"):
        out = np.floor(scale * values)
    if not values.size or np.abs(out).max() < 2**62:
        return out.astype(np.int64)
    return np.array([int(np.floor(v)) * scale if np.isinf(scale * v) else int(np.floor(scale * v)) for v in values.ravel().tolist()], dtype=object).reshape(values.shape)


def matrices(batch, vector: str, width: int, scale: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, whole numbers of up to BLOCK rows) of an Arrow batch of vectors of one width."""
    values = batch.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    for at in range(0, len(values), BLOCK):
        yield at, floors(values[at : at + BLOCK], scale)


def magnitude(values: np.ndarray) -> int:
    return max(abs(int(values.max())), abs(int(values.min()))) if values.size else 0


def grouped_sums(groups: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """For each of `count` groups its rows' componentwise sum and, as the last component, their number; Python's numbers."""
    exact = np.int64 if magnitude(values) * max(1, len(values)) < 2**62 else object
    out = np.zeros((count, values.shape[1] + 1), dtype=exact)
    np.add.at(out[:, :-1], groups, values.astype(exact))
    out[:, -1] += np.bincount(groups, minlength=count)
    return out.astype(object)


def tree_sum(df: DataFrame, partial: Callable[[Iterator], Iterator[np.ndarray]], depth: int = 2) -> np.ndarray | None:
    """The sum of the arrays that `partial` makes of each partition's Arrow batches: one array a partition travels, and they are added
    in a tree of tasks, so that neither the driver nor a task gets one of every partition. None if there is none."""

    def run(batches):
        import pyarrow as pa

        for array in partial(batches):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(array)], pa.binary())], names=["part"])

    def add(a, b):
        return b if a is None else a if b is None else a + b

    return df.mapInArrow(run, "part binary").rdd.treeAggregate(None, lambda a, row: add(a, pickle.loads(row["part"])), add, depth)


def whole_mean(sums: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of grouped_sums; what has no rows stays as before."""
    out = [[s // row[-1] for s in row[:-1]] if row[-1] else list(old) for row, old in zip(sums.tolist(), before.tolist(), strict=True)]
    return numbers(out, before.shape)


def numbers(values: list, shape: tuple[int, ...]) -> np.ndarray:
    """Whole numbers as int64 if all are below 2**62, else as Python's."""
    out = np.array(values, dtype=object).reshape(shape)
    return out.astype(np.int64) if magnitude(out) < 2**62 else out


def as_longs(values) -> list[int | None]:
    """Whole numbers for a column of longs; null where one does not fit."""
    return [int(v) if abs(v) < 2**63 else None for v in values.tolist()]
