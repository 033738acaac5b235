import random

from pyspark.sql import functions as F

from leafmill.operators import phrase_finder as P
from leafmill.operators import search as S


def naive(words, phrase, slop):
    offsets = {(q, i - q) for q, token in enumerate(phrase) for i, w in enumerate(words) if w == token}
    return any(all(any((q, o) in offsets for o in range(start, start + slop + 1)) for q in range(len(phrase))) for start in {o for _, o in offsets})


def test_all_lengths_and_slops_against_offsets(spark):
    rng = random.Random(7)
    texts = {k: [rng.choice("abcd") for _ in range(rng.choice([0, 1, 3, 9, 40, 200]))] for k in range(40)}
    asked = []
    for k in range(120):
        source = texts[rng.randrange(40)] or ["a"]
        at, n = rng.randrange(len(source)), rng.choice([1, 2, 3, 4, 5, 8, 13, 70])
        phrase = source[at : at + n]
        if k % 3 == 0:
            phrase = [rng.choice("abcd") for _ in phrase]
        asked.append((k, k % 4 if k % 2 else 0, " ".join(phrase)))
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "id int, t string")
    phrases = S.phrase_words(spark.createDataFrame(asked, "q int, slop int, phrase string"))
    expected = sorted((q, k) for q, slop, phrase in asked for k, w in texts.items() if naive(w, phrase.split(), slop))
    for posts in (S.texts(docs, "id", ["t"]), S.postings(docs, "id", ["t"])):
        found = S.phrase_hits(posts, phrases, ["q"])
        assert sorted((r.q, r.id) for r in found.collect()) == expected


def test_blocks_of_phrases(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 2)
    docs = spark.createDataFrame([(1, "a b c d e f")], "id int, t string")
    phrases = S.phrase_words(spark.createDataFrame([(k, 0, p) for k, p in enumerate(["a", "b c", "d e f", "f a", "a b c d e f", "a"])], "q int, slop int, phrase string"))
    assert sorted(r.q for r in S.phrase_hits(S.texts(docs, "id", ["t"]), phrases, ["q"]).collect()) == [0, 1, 2, 4, 5]


def test_texts_are_not_shuffled(spark):
    """Only what is found, and numbers of words, are sent: common words with slop no longer make rows of their own (F9, F12)."""
    docs = spark.range(50).select(F.col("id"), F.repeat(F.lit("the of "), 2000).alias("t"))
    phrases = S.phrase_words(spark.createDataFrame([(k, 2, "the of rare%d" % k) for k in range(50)] + [(99, 0, "the of the")], "q int, slop int, phrase string"))
    hits = S.phrase_hits(S.texts(docs, "id", ["t"]), phrases, ["q"])
    assert hits.count() == 50
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate posexplode" not in plan


def test_weights_count_ids_once(spark):
    rows = [(1, "a b"), (1, "a c"), (2, "a a"), (3, ""), (4, None)]
    docs = spark.createDataFrame(rows, "id int, t string")
    of = lambda posts: sorted((r.field, r.token, round(r.weight, 9)) for r in S.weights(posts).collect())
    assert of(S.texts(docs, "id", ["t"])) == of(S.postings(docs, "id", ["t"]))
    lists = spark.createDataFrame([(1, ["a b", "a"]), (2, ["b", "c"]), (3, [])], "id int, t array<string>")
    assert of(S.texts(lists, "id", ["t"])) == of(S.postings(lists, "id", ["t"]))


def test_keys_of_many_phrases_are_those_of_each():
    import numpy as np

    n = np.array([1, 2, 3, 4, 7, 8, 9, 33, 1])
    h = np.random.default_rng(1).integers(0, 2**62, n.sum()).astype(np.uint64)
    starts, slop = np.cumsum(n) - n, np.array([0, 1, 0, 2, 0, 0, 3, 0, 4])
    together = list(zip(*(x.tolist() for x in P.phrase_keys(h, starts, n, slop))))
    each = [tuple(x.tolist()[0] for x in P.phrase_keys(h[a : a + k], np.array([0]), np.array([k]), np.array([s]))) for a, k, s in zip(starts, n, slop)]
    assert together == each and [level for level, _, _ in each] == [0, 1, 1, 2, 2, 3, 3, 5, 0]


def test_counts_and_not_words_meet_many_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a c"), (3, "d")], "id int, t string")
    posts, terms = S.texts(docs, "id", ["t"]), spark.createDataFrame([("a",), ("d",), ("x",), ("a",)], "token string")
    few = sorted(map(str, S.weights(posts, terms).collect()))
    monkeypatch.setattr(S, "TERMS", 1)
    many = S.weights(posts, terms)
    assert sorted(map(str, many.collect())) == few and len(few) == 2
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") < plan.index("Generate explode")  # read from the result down: the join is above the counts
