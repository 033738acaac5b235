from leafmill.operators import analysis as A
from leafmill.operators import nested as N

SCHEMA = "parent string, child string, element int, field string, value int, text string"


def scores(found):
    return sorted((r.q, r.parent, r.child or "", r.element, r.value, round(r.score, 9)) for r in found.collect())


def test_elements_count_once_without_a_shuffle_of_all(spark, monkeypatch):
    """Elements of several values or repeated rows count once; where there are none, nothing is told apart (F22)."""
    plans, store = [], N.staged

    def staged(df, label, **options):
        if label == "weights":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString().lower())
        return store(df, label, **options)

    monkeypatch.setattr(N, "staged", staged)
    rows = [("p", None, 0, "t", 0, "red ring"), ("p", None, 1, "t", 0, "red"), ("r", "c", 0, "t", 0, "small ring"), ("r", "d", 0, "t", 0, None)]
    several = [*rows, ("p", None, 0, "t", 1, "red ring"), ("r", "c", 0, "t", 1, "ring"), ("s", None, 0, "t", 0, "ring")]
    phrases = A.graph_phrases(spark.createDataFrame([(0, 0, "ring"), (1, 0, "red ring")], "q int, slop int, phrase string"))
    for texts in (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(several, SCHEMA)):
        stored = N.element_hits(N.block_postings(texts, {"": "words"}), phrases, ["q"])
        plans.clear()
        found = N.search_elements(texts, "words", phrases, ["q"])
        assert scores(found) == scores(stored) and found.count() > 0
        if texts.count() == len(rows):
            assert "count(distinct" not in plans[-1]
