from pytest import approx

from leafmill.operators import metrics as M


def test_sweep_ignores_scores_of_zero_but_recall_counts_them(spark):
    pairs = spark.createDataFrame([("a", "b", 0.0, True, "g1"), ("a", "c", -1.0, False, None), ("b", "c", 0.8, True, "g1")], "a string, b string, score double, positive boolean, group string")
    rows = M.threshold_sweep(pairs).collect()
    assert [(r.threshold, r.recall) for r in rows] == [(0.8, 0.5)]
    assert M.pr_auc(M.threshold_sweep(pairs)).first()[0] == approx(0.5)


def test_a_lone_zero_positive_has_recall_zero(spark):
    pairs = spark.createDataFrame([("a", "b", 0.0, True, "g1")], "a string, b string, score double, positive boolean, group string")
    assert {r.group: r.recall for r in M.group_recall(pairs).collect()} == {"g1": 0.0}


def test_missing_scores(spark):
    docs = spark.createDataFrame([("a", "g1"), ("b", "g1"), ("c", "g2")], "id string, d_id string")
    positives = M.positive_pairs(M.groups(docs, "id", "d_id"))
    scores = spark.createDataFrame([("b", "a", 0.9)], "a string, b string, score double")
    dense = M.dense_pair_scores(docs, scores, positives, -1.0)
    found = {(r.a, r.b): (r.score, r.positive) for r in dense.collect()}
    assert found == {("a", "b"): (0.9, True), ("a", "c"): (-1.0, False), ("b", "c"): (-1.0, False)}


def test_recall_drops_outside_ids_after_the_cut(spark):
    docs = spark.createDataFrame([("a", "g1"), ("b", "g1"), ("c", "g1")], "id string, d_id string")
    positives = M.positive_pairs(M.groups(docs, "id", "d_id"))
    ranking = spark.createDataFrame([("a", "x", 1), ("a", "b", 2)], "src string, dst string, rank int")
    found = {r.k: r.recall for r in M.recall_at_k(ranking, positives, docs, [1, 2]).collect()}
    assert found == {1: 0.0, 2: approx(1 / 6)}


def test_groups_need_two_members(spark):
    docs = spark.createDataFrame([("a", "g1"), ("b", "g1"), ("c", "g2"), ("d", None)], "id string, d_id string")
    assert sorted(map(tuple, M.groups(docs, "id", "d_id").collect())) == [("g1", "a"), ("g1", "b")]


def test_a_row_may_stand_for_many_pairs(spark):
    rows = [("a", "a", 1.0, True, "g1", 10), ("a", "b", 1.0, False, None, 3), ("a", "c", 0.5, False, None, 2), ("d", "d", 0.0, True, "g2", 4)]
    kind = "a string, b string, score double, positive boolean, group string"
    one = spark.createDataFrame(rows, kind + ", n long")
    each = spark.createDataFrame([r[:5] for r in rows for _ in range(r[5])], kind)
    shown = lambda df: sorted(map(str, df.collect()))
    assert shown(M.threshold_sweep(one)) == shown(M.threshold_sweep(each))
    assert shown(M.group_recall(one)) == shown(M.group_recall(each))


def test_recall_by_members_equals_that_by_pairs(spark):
    members = spark.createDataFrame([("g1", k) for k in range(4)] + [("g2", 7), ("g2", 8), ("g3", 9)], "group string, id long")
    ranking = spark.createDataFrame([(0, 1, 1), (0, 9, 2), (0, 2, 3), (1, 7, 1), (1, 3, 2), (7, 0, 1), (7, 8, 2), (9, 0, 1)], "src long, dst long, rank int")
    by_pairs = M.recall_at_k(ranking, M.positive_pairs(members), members.select("id"), [1, 2, 3])
    assert sorted(map(tuple, M.member_recall_at_k(ranking, members, [1, 2, 3]).collect())) == sorted(map(tuple, by_pairs.collect()))


def test_evaluation_pairs_no_copies(spark, tmp_path):
    """60 copies of a text, five without words and two near ones: rows by texts, and what the pairs give."""
    from leafmill.plans import q_dedup as Q

    texts = ["a b c d e f g h"] * 60 + ["A b c d e f g h", "a b c d e f g x"] + ["--- "[3:]] * 5 + [None, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pairs, few = Q.evaluated(spark, tmp_path), Q.weighed_pairs(spark, tmp_path)
    assert few.count() == 5 < 1770 < pairs.count()
    shown = lambda df: sorted(map(str, df.collect()))
    assert shown(M.threshold_sweep(few)) == shown(M.threshold_sweep(pairs))
    assert shown(M.group_recall(few)) == shown(M.group_recall(pairs))
    scores = pairs.where("score > 0").select("a", "b", "score")
    both = scores.toDF("src", "dst", "score").union(scores.select("b", "a", "score"))
    ranking = Q.D.top_k(both, "src", Q.F.col("score"), "dst", 50)
    ids = spark.range(len(texts))
    want = M.recall_at_k(ranking, pairs.where("positive").select("a", "b"), ids, [1, 5, 20, 50])
    assert sorted((r.k, round(r.recall, 6)) for r in want.collect()) == sorted(map(tuple, Q.recall_at_k(spark, tmp_path).collect()))
