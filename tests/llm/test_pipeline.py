from pyspark.sql import functions as F

import corpus_pipeline as P
import public_tokenizers
from leafmill.llm.byte_bpe import decode, load_ranks

SF = "/root/testdata/sf0.001"


def test_stages_against_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert len(names) == 5
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = docs.count()
    kept = P.quality(spark, docs, SF).cache()
    assert kept.columns == docs.columns and 0 < kept.count() < before
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert sum(q == (i in ids) for i, q in labels.items()) / len(labels) > 0.9
    lined = P.lines(spark, kept, SF).cache()
    assert lined.columns == docs.columns and lined.count() == kept.count()
    near = P.near_duplicates(spark, lined, SF).cache()
    assert near.columns == docs.columns and 0 < near.count() < lined.count()
    assert near.where("text <> ''").count() == near.where("text <> ''").select("text").distinct().count()
    mixed = P.mixed(spark, near, SF).cache()
    sizes = near.select("source", F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).alias("n")).agg(F.sum("n")).first()[0]
    taken = mixed.select(F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).alias("n")).agg(F.sum("n")).first()[0]
    assert mixed.columns == docs.columns and abs(taken / sizes - 1.5) < 0.2
    out = P.encoded(spark, mixed, SF)
    ranks = load_ranks(public_tokenizers.path(P.TOKENIZER))
    assert sorted(bytes(r.decoded).decode() for r in decode(out, ranks).collect()) == sorted(r.text for r in mixed.collect())


def test_near_duplicates_keep_one(spark, make):
    text = " ".join(f"w{k}" for k in range(100))
    docs = make([(5, text), (3, text.upper()), (9, text + " more"), (7, "other text of its own here"), (7, "other text of its own here"), (8, ""), (11, None)])
    assert sorted((r.doc_id for r in P.near_duplicates(spark, docs, SF).collect())) == [3, 7, 8, 11]


def test_near_duplicates_by_doc_id_and_text(spark, make):
    text = " ".join(f"w{k}" for k in range(100))
    other = " ".join(f"v{k}" for k in range(60))
    rows = [(3, text), (7, text + " more"), (7, other), (7, other), (None, text), (None, other + " x"), (None, "alone here"), (2, ""), (2, ""), (4, text), (4, text + " less")]
    left = sorted(((r.doc_id, r.text) for r in P.near_duplicates(spark, make(rows), SF).collect()), key=str)
    assert left == sorted([(3, text), (7, other), (None, "alone here"), (2, ""), (2, "")], key=str)
    assert P.near_duplicates(spark, make(rows).where("false"), SF).count() == 0


def test_stages_on_odd_rows(spark, odd, none):
    for stage in (P.quality, P.lines, P.near_duplicates, P.mixed):
        assert stage(spark, odd, SF).columns == odd.columns
        assert stage(spark, none, SF).count() == 0
    assert sorted(r.n_tokens for r in P.encoded(spark, odd, SF).collect())[:2] == [0, 0]
    assert P.encoded(spark, none, SF).count() == 0


def test_run(spark):
    out = P.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.where("n_tokens <> size(ids)").count() == 0
