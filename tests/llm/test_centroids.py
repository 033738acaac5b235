import hashlib
import math
import random

import numpy as np

from leafmill.llm import centroids as C


def brute(rows, k, rounds, width, scale=64):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    whole = lambda v: [math.floor(scale * x) for x in v]
    now = [whole(v) for _, _, v in sorted((key(i), v, v) for i, v in kept if i is not None)[:k]]
    if not now:
        return [], []
    best = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(now))
    for _ in range(rounds):
        held = [[] for _ in now]
        for _, v in kept:
            held[best(whole(v))[1]].append(whole(v))
        now = [[sum(c) // len(h) for c in zip(*h)] if h else old for h, old in zip(held, now)]
    found = [(i, *best(whole(v))[::-1]) for i, v in kept]
    fits = lambda v: v if v < 2**63 else None
    each = {j: sum(d for _, c, d in found if c == j) for j in range(len(now))}
    whole_sum = sum(each.values())
    bad = {c for _, c, d in found if d >= 2**63}
    return [(i, c, fits(d), None if c in bad else fits(each[c]), None if bad else fits(whole_sum)) for i, c, d in found], now


def same(spark, rows, k, rounds, width):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as cluster", "2 as distance", "'x' as key")
    out, now = C.centroid_clusters(df, k=k, rounds=rounds, width=width)
    want, want_now = brute(rows, k, rounds, width)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert now.tolist() == want_now


def test_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(rng.choice([-1, 1]), 0.3) for _ in range(6)]) for i in range(400)]
    same(spark, rows, 16, 3, 6)
    same(spark, rows, 1, 0, 6)
    same(spark, rows[:5], 16, 3, 6)


def test_copies_ties_and_odd_vectors(spark):
    grid = [(i, [(i & 3) / 64, (i >> 2 & 3) / 64]) for i in range(48)] + [(7, [0.5, 0.5])] * 5
    odd = [(70, None), (71, [1.0, None]), (72, [float("nan"), 0.0]), (73, [float("-inf"), 0.0]), (74, []), (75, [0.5]), (None, [0.25, 9.0])]
    same(spark, grid + odd, 8, 3, 2)
    same(spark, [(1, None)], 8, 3, 2)
    same(spark, [(None, [1.0, 2.0])], 8, 3, 2)


def test_large_numbers(spark):
    rng = random.Random(4)
    for scale in (1e6, 1e8, 1e20, 1e60):
        same(spark, [(i, [rng.uniform(-1, 1) * scale for _ in range(3)]) for i in range(60)], 5, 3, 3)


def test_products_are_exact_on_both_sides_of_the_bounds():
    rng = np.random.default_rng(2)
    for m in (10, 2**22, 2**23, 2**24, 2**27, 2**28, 2**29, 2**33):
        x, c = rng.integers(-m, m, (50, 64)), rng.integers(-m, m, (7, 64))
        x[0], c[0] = m, -m
        exact = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(2)
        assert [[int(v) for v in row] for row in C.squared_distances(x, c).tolist()] == exact.tolist()
