import zlib

import numpy as np
from pyspark.sql import functions as F

from leafmill.llm import quality_classifier as C


def test_forest_learns_and_its_arrays_step_like_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    forest = C.fit_forest(x[:2000], y[:2000], trees=40)
    p = forest.score(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.95

    def walk(row):
        total = forest.start
        for f, c, leaf in zip(forest.feature, forest.cut, forest.leaf):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + (row[f[at]] > c[at])
            total += leaf[at - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(p[:50], [walk(r) for r in x[2000:2050]])


def test_no_labels_and_one_class():
    assert C.fit_forest(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert C.fit_forest(np.ones((8, 3)), np.ones(8)).score(np.zeros((1, 3)))[0] > 0.8


def corpus(make):
    good = [(i, " ".join(f"word{(i * 7 + k * k) % 97}" for k in range(60)) + ".") for i in range(150)]
    bad = [(500 + i, f"SHOUT{i % 5}!! " * 60) for i in range(150)]
    return make(good + bad)


def test_held_out_accuracy_and_fold(spark, make):
    docs = corpus(make)
    labels = docs.select("doc_id", (F.col("doc_id") < 500).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    found = C.quality_classifier(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r.held_out]
    assert held and all(r.predicted == (r.doc_id < 500) == (r.score >= 0.7) for r in held)
    # labels of the held-out fold are never read
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(tuple, C.quality_classifier(docs, flipped).collect())) == sorted(map(tuple, found))
    kept = C.good_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if r.predicted}


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, None), (None, 1), (6, 1)], "doc_id long, quality int")
    out = C.quality_classifier(odd, labels).collect()
    assert len(out) == 9 and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in C.quality_classifier(odd, labels.where("false")).collect()} == {0.5}
    assert C.quality_classifier(none, labels).count() == 0
