import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators import embeddings as E

SMALL = E.Settings(dim=16, epochs=4, min_count=2, buckets=5000, block_words=25, block_cells=10**9, rate=0.2, window=3, common=1.0)


def texts(n=300, seed=1):
    """Two themes with words of their own: of one theme all begin alike."""
    rng = random.Random(seed)
    themes = [[f"stone{c}" for c in "abcdefghijklmnopqrst"], [f"{c}water" for c in "abcdefghijklmnopqrst"]]
    return [[rng.choice(themes[k % 2]) for _ in range(12)] for k in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(t,) for t in texts()], "words array<string>")


@pytest.fixture(scope="module")
def model(corpus):
    return E.train(corpus, SMALL)


def matrix(model):
    rows = sorted(model.words.collect(), key=lambda r: r.word)
    m = np.array([r.vec for r in rows])
    return [r.word for r in rows], m / np.linalg.norm(m, axis=1, keepdims=True)


def test_vocabulary_and_cells_equal_brute_force(spark):
    own = [["a", "b", "a", "c"], ["b", "b"], [], ["c", "x", "a"]]
    df = spark.createDataFrame([(t,) for t in own], "words array<string>")
    s = E.Settings(window=2, min_count=2, common=1.0)
    words = E.vocabulary(df, s)
    names = {r.key: r.word for r in words.collect()}
    assert {r.word: r.n for r in words.collect()} == {"a": 3, "b": 3, "c": 2}
    want = {}
    for t in own:
        for i, x in enumerate(t):
            for k in (1, 2):
                if i + k < len(t) and {x, t[i + k]} <= {"a", "b", "c"}:
                    pair = tuple(sorted((x, t[i + k])))
                    want[pair] = want.get(pair, 0) + (3 - k) / 2
    found = {tuple(sorted((names[r.a], names[r.b]))): r.weight for r in E.cells(df, words, s).collect()}
    assert found == pytest.approx(want)
    half = E.cells(df, words, E.Settings(window=2, min_count=2, common=0.01)).agg(F.sum("weight")).first()[0]
    assert 0 < half < sum(want.values())


def test_held_out_loss_falls_and_themes_part(model):
    assert len(model.losses) == 4 and model.losses[-1] < 0.8 * model.losses[0]
    names, m = matrix(model)
    near = m @ m.T
    first = np.array([n.startswith("stone") for n in names])
    inside = (near[np.ix_(first, first)].sum() - first.sum()) / (first.sum() * (first.sum() - 1))
    assert len(names) == 40 and inside > near[np.ix_(first, ~first)].mean() + 0.3


def test_reruns_agree_whatever_the_partitions(corpus, model):
    again = E.train(corpus.repartition(7), SMALL)
    assert again.losses == pytest.approx(model.losses, rel=1e-6) and matrix(again)[0] == matrix(model)[0]
    assert np.allclose(matrix(again)[1], matrix(model)[1], atol=1e-5)


def test_words_that_share_pieces_are_nearer(spark):
    rng = random.Random(5)
    words = [f"{stem}{end}" for stem in ("karmo", "tulpe", "fistra") for end in ("", "n", "ra", "los", "mi")]
    df = spark.createDataFrame([([rng.choice(words) for _ in range(10)],) for _ in range(60)], "words array<string>")


    def gap(**options):
        """How much nearer words of one stem are than others, about the mean of all."""
        model = E.train(df, E.Settings(dim=24, epochs=1, buckets=100_000, rate=0.01, **options))
        rows = sorted(model.words.collect(), key=lambda r: r.word)
        m = np.array([r.vec for r in rows])
        m -= m.mean(0)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        near, names = m @ m.T, [r.word for r in rows]
        same = np.array([[a != b and a[:4] == b[:4] for b in names] for a in names])
        other = np.array([[a[:4] != b[:4] for b in names] for a in names])
        return near[same].mean() - near[other].mean()

    assert gap(block_words=8) > 0.3 and gap(maxn=0) < 0.15


def test_pieces():
    s = E.Settings(minn=2, maxn=4, buckets=10**6)
    grams = {("<ab>"[i : i + n]) for n in (2, 3, 4) for i in range(5 - n)} - {"<ab>"}
    assert E.pieces("ab", 7, s)[0] == 7 and len(E.pieces("ab", 7, s)) == 1 + len(grams) and E.pieces("ab", 7, E.Settings(maxn=0)) == [7]
    assert (E.first_vector(-5, s) == E.first_vector(-5, s)).all() and (E.first_vector(1, s) != E.first_vector(2, s)).any()


def test_texts_are_encoded(spark, model):
    names, _ = matrix(model)
    vectors = {r.word: np.array(r.vec) for r in model.words.collect()}
    df = spark.createDataFrame([(1, f"{names[0]} {names[0]} {names[1]}"), (2, "unknown"), (3, None), (4, names[2].upper())], "id int, text string")
    found = {r.id: np.array(r.vec) for r in E.encoded(df, "id", model).collect()}
    mean = (2 * vectors[names[0]] + vectors[names[1]]) / 3
    assert set(found) == {1, 4} and np.allclose(found[1], mean / np.linalg.norm(mean), atol=1e-5)
    most = np.maximum(vectors[names[0]], vectors[names[1]])
    assert np.allclose({r.id: np.array(r.vec) for r in E.encoded(df, "id", model, pooling="max").collect()}[1], most / np.linalg.norm(most), atol=1e-5)


def test_empty_corpus(spark):
    empty = E.train(spark.createDataFrame([], "words array<string>"), E.Settings(dim=4, epochs=1))
    assert empty.words.count() == 0 and empty.losses == [0.0]
