import math
import random

from leafmill.llm import topk_search as K


def brute(rows, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % 50 == 0}):
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for j, own in ok if j == q for i, v in ok if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


def found(spark, rows, k=5):
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as shard", "2 as block", "3 as score")
    return sorted(map(tuple, K.topk_search(v, v.where("vec_id % 50 = 0"), k).collect()))


def test_equals_brute_force_over_shards_and_blocks(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, [rng.choice([rng.gauss(0, 0.2), 0.0, 0.25]) for _ in range(8)]) for i in range(400)]
    rows = [(i, [float(__import__("struct").unpack("f", __import__("struct").pack("f", x))[0]) for x in v]) for i, v in rows]
    rows += [(400 + i, rows[3][1]) for i in range(20)]  # ties
    monkeypatch.setattr(K, "SHARD_ROWS", 64)
    monkeypatch.setattr(K, "BLOCK_ROWS", 3)
    assert found(spark, rows) == brute(rows, 5)


def test_odd_vectors(spark):
    rows = [(0, [0.5, -0.5]), (50, None), (100, [1.0, None]), (150, [float("nan"), 1.0]), (1, [float("inf"), 0.0]), (2, [0.25, 0.25]), (2, [0.25, 0.25]), (None, [1.0, 1.0]), (3, []), (4, [-1.0, 1.0]), (200, [0.0, 0.0])]
    assert found(spark, rows) == brute(rows, 5)
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, [(1, [1.0]), (2, [1.0])]) == []


def test_rows_of_one_id_are_candidates_of_their_own(spark):
    rows = [(50, [1.0]), (1, [0.5]), (1, [0.9]), (2, [0.2]), (50, [0.5]), (1, [0.9])]
    assert found(spark, rows) == brute(rows, 5) and [r[3] for r in brute(rows, 5)] == [58880, 58880, 32768, 29440, 29440]
    many = [(7, [0.25, -0.5])] * 300 + [(i, [i / 900, 0.5]) for i in range(0, 300, 3)]
    assert found(spark, many) == brute(many, 5)
