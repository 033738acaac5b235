from pyspark.sql import functions as F
from pytest import approx

from leafmill import schemas
from leafmill.operators import matching as X
from leafmill.operators import search as S


def hits(spark, text, phrase, slop=0):
    posts = S.postings(spark.createDataFrame([(1, text)], "id int, t string"), "id", ["t"])
    table = S.phrase_table(spark.createDataFrame([(0, slop, phrase)], "q int, slop int, phrase string"))
    return S.phrase_hits(posts, table, ["q"]).count()


def test_phrases_and_slop(spark):
    assert hits(spark, "a b c d", "b c") == 1 and hits(spark, "a b x c", "b c") == 0
    assert hits(spark, "a b x c", "b c", 1) == 1 and hits(spark, "a b x y c", "b c", 1) == 0 and hits(spark, "a b x y c", "b c", 2) == 1
    assert hits(spark, "a a b", "a a b") == 1 and hits(spark, "a b", "a a b") == 0


def test_array_fields_do_not_join(spark):
    posts = S.postings(spark.createDataFrame([(1, ["a b", "c d"])], "id int, t array<string>"), "id", ["t"])
    table = S.phrase_table(spark.createDataFrame([(0, 0, "b c"), (1, 0, "c d")], "q int, slop int, phrase string"))
    assert [r.q for r in S.phrase_hits(posts, table, ["q"]).collect()] == [1]


def test_plan():
    words = [f"w{k}" for k in range(12)]
    plan = S.plan(" ".join(words), words, " ")
    assert [c.scope for c in plan[:3]] == ["top", "segments", "chunks"] and plan[0].slop == 2 and plan[2].slop == 0
    assert [len(c.phrases[0].split()) for c in plan[3:]] == [6, 5, 7, 4, 8]
    assert S.cuts(["a", "ལ", "b"]) == [2] and S.cuts(["a"]) == [] and S.plan("", []) == []
    assert [S.slop_of(n) for n in (5, 6, 29, 30, 99)] == [0, 1, 4, 5, 5]


def test_best_clause_wins(spark):
    docs = spark.createDataFrame([(1, "red small ring"), (2, "red ring small"), (3, "other")], "id int, label string")
    found = S.search(spark, {"top": S.postings(docs, "id", ["label"])}, S.plan("red small", ["red", "small"], " "), {}).collect()
    assert [r.id for r in found] == [1, 2] and found[0].score == approx(found[1].score / 0.2 * 1.1)


def test_find_work(spark):
    texts = spark.createDataFrame([("q", "one two three")], "id string, text string")
    chunks = S.postings(spark.createDataFrame([("v1", "zero one two three four"), ("v2", "one two"), ("v3", "one two three")], "id string, t string"), "id", ["t"])
    chunks = chunks.selectExpr("named_struct('volume_id', id, 'n', 0) as id", "field", "pos", "token")
    scores = X.volume_scores(texts, "id", "text", chunks)
    assert {r.volume_id for r in scores.collect()} == {"v1", "v3"}
    segments = spark.createDataFrame([("v1", "W1", None), ("v3", "W1", "title"), ("v3", None, None)], "volume_id string, wa_id string, title string")
    (found,) = X.candidates(scores, segments).collect()
    assert (found.wa_id, found.volumes, found.title, found.rank) == ("W1", ["v1", "v3"], "title", 1)
    works = spark.createDataFrame([("W1", "label", ["P1"])], "id string, pref_label_bo string, authors array<string>")
    persons = spark.createDataFrame([("P1", "Ann")], "id string, pref_label_bo string")
    assert X.resolved(X.candidates(scores, segments), works, persons).first().author_names == ["Ann"]
    matches = spark.createDataFrame([("W1", "W1", 6.0), ("W1", "W2", 6.0), ("W1", "W3", 4.9)], "source_wa string, match_wa string, score double")
    assert sorted(r.classification for r in X.classified(matches).collect()) == ["confirm_duplicate", "propose_merge"]


def test_highlight(spark):
    assert spark.createDataFrame([("a b. c",)], "t string").select(S.highlighted(__import__("pyspark").sql.functions.col("t"), ["b."])).first()[0] == "a <em>b.</em> c"


def test_queries_of_equal_samples_are_scored_once(spark, monkeypatch):
    """40 copies of a long text, two that share its beginning and one of its own: each leaves itself out, and hits grow with the texts."""
    tables, keep = [], X.staged
    monkeypatch.setattr(X, "staged", lambda df, label, **options: tables.append((label, keep(df, label, **options))) or tables[-1][1])
    body = " ".join(f"w{100 + k}" for k in range(200))
    texts = [body] * 40 + [body[:300] + f" only{k} " + "x y z " * 60 for k in range(2)] + [f"q r{k} s" for k in range(60)]
    docs = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "id string, text string")
    chunk = F.struct(F.lit(0).alias("cstart"), F.length("text").alias("cend"), F.col("text").alias("text_bo"))
    volumes = docs.select("id", F.lit("w").alias("wa_id"), F.lit(None).cast("string").alias("mw_id"), F.array(chunk).alias("chunks"), F.lit(None).cast(f"array<{schemas.SEGMENT}>").alias("segments"))
    found = {}
    for r in X.segment_duplicates(volumes).collect():
        found.setdefault(r.volume_id, set()).add(r.match_volume)
    copies = sorted(map(str, range(40)))
    assert all(found[k] == set([x for x in copies if x != k][:10]) for k in copies)
    # their middle and end are their own, and their beginning is that of all others
    assert all(len(found[k]) == 10 and k not in found[k] for k in ("40", "41")) and "42" not in found
    assert sum(df.count() for label, df in tables if label == "hits") <= 400 < 3 * 40 * 40
