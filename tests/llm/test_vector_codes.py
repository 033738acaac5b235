import math
import random

import numpy as np

from leafmill.llm import vector_codes as V


def usable(rows, width):
    return [r for r in rows if r[1] is not None and len(r[1]) == width and all(x is not None and math.isfinite(x) for x in r[1])]


def brute(rows, width, parts, entries, rounds, scale=256):
    """vec_id, label, codes, error of each row, label errors and the codebooks, with Python's numbers only."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in usable(rows, width)]
    d = width // parts
    start = {}
    for i, v, _ in kept:
        if i is not None:
            start[i] = min(start.get(i, v), v)
    first = [start[i] for i in sorted(start)[:entries]]
    books = [[v[p * d : (p + 1) * d] for v in first] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda part, book: min((away(part, c), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = [[] for _ in books[p]]
            for _, v, _ in kept:
                part = v[p * d : (p + 1) * d]
                held[best(part, books[p])[1]].append(part)
            books[p] = [[sum(c) // len(h) for c in zip(*h)] if h else old for h, old in zip(held, books[p])]
    out = []
    for i, v, label in kept:
        found = [best(v[p * d : (p + 1) * d], books[p]) for p in range(parts)]
        out.append((i, label, [j for _, j in found], sum(e for e, _ in found)))
    return out, books


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as codes", "2 as error", "'x' as _of")
    out, books = V.vector_codes(df, **options)
    return [tuple(r) for r in out.collect()], books


def same(spark, rows, width, parts, entries, rounds):
    got, books = found(spark, rows, parts=parts, entries=entries, rounds=rounds)
    want, want_books = brute(rows, width, parts, entries, rounds)
    sums = {}
    for _, label, _, e in want:
        sums[label] = sums.get(label, 0) + e
    fits = lambda v: v if v < 2**63 else None
    assert sorted(got, key=str) == sorted(((i, label, c, fits(e), None if sums[label] >= 2**63 else sums[label]) for i, label, c, e in want), key=str)
    assert books.tolist() == want_books


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)], rng.choice([0, 1, None])) for i in range(300)]
    same(spark, rows, 8, 4, 16, 2)
    same(spark, rows, 8, 2, 7, 0)


def test_ties_copies_and_odd_vectors(spark):
    grid = [(i, [(i >> k & 3) / 256 for k in range(4)], i % 2) for i in range(64)]
    odd = [(70, None, 1), (71, [1.0, None, 0.0, 0.0], 1), (72, [float("nan")] * 4, None), (73, [float("inf"), 0.0, 0.0, 0.0], 1), (74, [], 1), (75, [0.5] * 5, 1), (None, [0.25] * 4, None), (3, [0.0] * 4, 0), (3, [0.0] * 4, 0)]
    same(spark, grid + odd, 4, 2, 9, 2)
    same(spark, grid[:3], 4, 2, 9, 2)
    assert found(spark, [(1, None, 1)], parts=2)[0] == []
    assert found(spark, [(None, [1.0, 2.0], 1)], parts=2)[0] == []


def test_large_numbers(spark):
    rng = random.Random(5)
    for scale in (1e5, 1e9, 1e17, 1e40):
        rows = [(i, [rng.uniform(-1, 1) * scale for _ in range(4)], i % 2) for i in range(40)]
        same(spark, rows, 4, 2, 5, 2)


def test_intervals_hold_the_nearest_entry():
    rng = np.random.default_rng(1)
    for spread in (3, 300, 2**20, 2**30):
        x, entries = rng.integers(-spread, spread, (500, 4)), rng.integers(-spread, spread, (64, 4))
        entries[40] = entries[3]
        exact = ((x[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(2)
        rows, cols = V.overlapping(x, entries)
        pairs = set(zip(rows.tolist(), cols.tolist()))
        assert all((i, int(j)) in pairs for i, row in enumerate(exact) for j in np.flatnonzero(row == row.min()))
        assert len(pairs) < 500 * 8
        code, least = V.nearest(x, entries)
        assert code.tolist() == [int(np.flatnonzero(row == row.min())[0]) for row in exact] and least.tolist() == [int(r.min()) for r in exact]
