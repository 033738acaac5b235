import numpy as np
import pytest

from leafmill.operators import dedup as D
from leafmill.operators import vector_index as V


def themed(n, width=12, themes=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(themes, width))
    x = centres[rng.integers(themes, size=n)] + 0.3 * rng.normal(size=(n, width))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(rows, asked, k):
    out = []
    for i, q in asked:
        scored = sorted((-round(sum(a * b for a, b in zip(q, v)), 6), j) for j, v in rows if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def got(frame):
    return sorted((r.src, r.rank, r.dst, r.score) for r in frame.collect())


@pytest.mark.parametrize(("rows_a_block", "queries_a_block"), [(8192, 2048), (16, 5)])
def test_exact_search_equals_brute_force(spark, monkeypatch, rows_a_block, queries_a_block):
    monkeypatch.setattr(V, "BLOCK_ROWS", rows_a_block)
    monkeypatch.setattr(V, "BLOCK_QUERIES", queries_a_block)
    rows = [(i, v.tolist()) for i, v in enumerate(themed(400))] + [(400 + i, themed(1).tolist()[0]) for i in range(60)]  # copies
    asked = [r for r in rows if r[0] % 20 == 0]
    index = V.build(table(spark, rows))
    for probes in (1, 3):
        found = got(V.search(index, table(spark, asked), 5, probes))
        want = brute(rows, asked, 5)
        assert [f[:3] for f in found] == [w[:3] for w in want] and [f[3] for f in found] == pytest.approx([w[3] for w in want], abs=1.1e-6)


def test_plan_has_no_nested_loop_and_few_clusters_are_opened(spark):
    v = themed(2000)
    df = table(spark, [(i, x.tolist()) for i, x in enumerate(v)])
    index, asked = V.build(df), df.where("vec_id % 50 = 0")
    assert "NestedLoop" not in V.search(index, asked)._jdf.queryExecution().executedPlan().toString()
    right = D.knn(df, asked, 10).select("src", "dst")
    near = V.search(index, asked, 10, probes=8, exact=False)
    assert V.recall(near, right) >= 0.9 and V.recall(V.search(index, asked, 10, probes=2), right) == 1.0
    # what an exact search need not look at
    q = v[::50].astype(np.float64)
    bounds = q @ index.centroids.T + np.linalg.norm(q, axis=1)[:, None] * index.radii
    kth = np.sort(q @ v.T.astype(np.float64), axis=1)[:, -11]
    assert ((bounds < kth[:, None]) * index.sizes).sum() / (len(q) * len(v)) > 0.4


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [float("nan"), 1.0]), (3, [1.0, None]), (4, [1.0]), (5, []), (None, [1.0, 1.0]), (6, [0.5, 0.5]), (6, [0.25, 0.0]), (7, [-1.0, 0.0])]
    index = V.build(table(spark, rows), clusters=3)
    assert got(V.search(index, table(spark, [rows[0], rows[2], rows[4]]), 5, 1)) == [(0, 1, 6, 0.5), (0, 2, 6, 0.25), (0, 3, 7, -1.0)]
    none = V.build(table(spark, []))
    assert V.search(none, table(spark, rows)).count() == 0
    assert V.search(index, table(spark, [])).count() == 0
