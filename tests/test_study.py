import pytest
from pytest import approx

from leafmill import schemas
from leafmill.api import Catalog
from leafmill.operators import catalog as C
from leafmill.operators import joins as J
from leafmill.operators import matching as X
from leafmill.operators import methods as K
from leafmill.operators import study as Y
from leafmill.sources import writers as W

WORDS = "ka kha ga nga ca cha ja nya ta tha da na pa pha ba ma".split()


def test_summary_takes_nearest_ranks(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (5, 1, 3, 1)] + [("b", None)], "g string, v double")
    (found,) = Y.summary(rows, "v", ["g"], {"p10": 0.1, "p95": 0.95, "all": 1.0}).collect()
    assert (found.g, found.n, found.mean, found.median, found.least, found.most, found.p10, found.p95, found["all"]) == ("a", 4, 2.5, 2.0, 1.0, 5.0, 1.0, 5.0, 5.0)
    assert Y.summary(rows.limit(0), "v", ["g"]).count() == 0


def test_strengths(spark):
    rows = spark.createDataFrame([(0, s) for s in (0.5, 0.49, 0.2, 0.1, None)], "k int, s double")
    assert tuple(Y.strengths(rows, "s", ["k"]).first()) == (0, 1, 2, 1)


def test_ground_truth_rows_outside_the_index_go(spark):
    truth = spark.createDataFrame([("mw1", "d1", "r1", None), ("mw2", "d1", None, None), ("mw3", "d2", "r3", None)], schemas.GROUND_TRUTH)
    texts = spark.createDataFrame([("mw1", "wa1", None), ("mw3", "wa3", "text")], "mw_id string, wa_id_orig string, text_bo string").selectExpr("*", "CAST(NULL AS STRING) AS title_bo", "'ocr' AS etext_source", "0 AS text_length")
    found = {r.mw_id: (r.wa_id_orig, r.text_bo, r.text_length) for r in Y.ground_truth_corpus(truth, texts).collect()}
    assert found == {"mw1": ("wa1", "", 0), "mw3": ("wa3", "text", 4)}
    assert {r.text_bo for r in Y.ground_truth_corpus(truth, texts, with_text=False).collect()} == {""}
    assert Y.ground_truth_corpus(truth, texts, in_index=False).count() == 3


def test_group_pairs_are_all_or_thirty(spark):
    members = spark.createDataFrame([("s", k) for k in range(5)] + [("s", 1), (None, 7)] + [("l", k) for k in range(500)], "group string, id int")
    found = Y.group_pairs(members).collect()
    assert sorted((r.a, r.b) for r in found if r.group == "s") == [(a, b) for a in range(5) for b in range(a + 1, 5)]
    assert len({(r.a, r.b) for r in found if r.group == "l"}) == 30 == sum(r.group == "l" for r in found)
    assert sorted(found) == sorted(Y.group_pairs(members.repartition(7)).collect())


def test_pair_jaccard(spark):
    docs = spark.createDataFrame([(1, "a b c", "tei"), (2, "a b d", "ocr"), (3, None, None)], "doc_id int, text string, source string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    found = {(r.a, r.b, r["size"]): r for r in Y.pair_jaccard(pairs, docs, [1, 2]).collect()}
    assert found[1, 2, 1].jaccard == 0.5 and found[1, 2, 2].jaccard == approx(1 / 3)
    assert found[1, 2, 1].kind == "ocr-tei" and found[1, 3, 1].kind == "tei-unknown" and found[1, 3, 2].jaccard == 0.0 == found[1, 3, 1].len_ratio


def test_two_candidate_lists(spark):
    asked = spark.createDataFrame([(1,), (2,)], "id int")
    left = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 6, 3)], "src int, dst int, rank int")
    right = spark.createDataFrame([(1, 6, 1)], "src int, dst int, rank int")
    found = {r.id: tuple(r)[1:] for r in Y.compared(asked, left, right).collect()}
    assert found == {1: (2, 1, 1, 0.5), 2: (0, 0, 0, None)}
    docs = spark.createDataFrame([(1, "a b", "x"), (5, "a b", "x"), (6, "z", "x")], "doc_id int, text string, source string")
    (row,) = Y.candidate_quality(left, docs, 1).collect()
    assert (row.n, row.most, row.least, row.strong, row.weak) == (3, 1.0, 0.0, 1, 2)


def test_parts_at_content_locations(spark):
    at = "http://x/"
    quads = [("cl1", "contentLocationInstance", "W1"), ("cl1", "contentLocationVolume", "1"), ("cl1", "contentLocationEndVolume", "2"), ("cl1", "contentLocationPage", "3"), ("cl1", "contentLocationEndPage", "9")]
    quads += [("cl2", "contentLocationInstance", "W1"), ("cl2", "contentLocationVolume", "2"), ("mw1", "contentLocation", "cl1"), ("mw1", "partType", "PartTypeText"), ("mw1", "instanceOf", "WA1")]
    quads += [("mw2", "contentLocation", "cl2"), ("mw2", "partType", "PartTypeTableOfContent"), ("mw3", "contentLocation", "cl2"), ("mw3", "partType", "PartTypeVolume")]
    iri = lambda v: v if v.isdigit() else at + v
    table = spark.createDataFrame([("", iri(s), iri(p), iri(o), None) for s, p, o in quads], schemas.QUADS)
    volumes = spark.createDataFrame([("W1", 1), ("W1", 2), ("W2", 1)], "rep string, volume int")
    found = sorted(tuple(r) for r in J.content_locations(table, volumes).collect())
    assert found == [("W1", 1, "mw1", "WA1", "text", 3, None), ("W1", 2, "mw1", "WA1", "text", 3, 9), ("W1", 2, "mw2", None, "editorial", None, None)]


@pytest.fixture
def volumes(spark):
    text = " ".join(WORDS)
    other = " ".join(reversed(WORDS)) + " " + text
    full = lambda id, t, wa, segments: {"id": id, "wa_id": wa, "chunks": [{"cstart": 0, "cend": len(t), "text_bo": t}], "segments": segments}
    part = {"mw_id": "mw", "wa_id": "WA2", "cstart": 0, "cend": len(other), "title_bo": ["title"]}
    rows = [full("v1", text, "WA1", None), full("v2", other, None, [part, part | {"cend": 0}]), {"id": "v3"}, *(full(f"f{k}", f"filler {k}", None, None) for k in range(8))]
    return spark.createDataFrame(rows, schemas.VOLUMES)


def test_segments_and_whole_volumes(volumes):
    found = {(r.volume_id, r.segment_idx): (r.wa_id, r.title, len(r.text)) for r in X.segment_texts(volumes).where("volume_id LIKE 'v%'").collect()}
    n = len(" ".join(WORDS))
    assert found == {("v1", 0): ("WA1", None, n), ("v2", 0): ("WA2", "title", 2 * n + 1)}


def test_duplicates_of_segments_leave_their_volume_out(volumes):
    (row,) = X.segment_duplicates(volumes).collect()
    assert (row.volume_id, row.source_wa, row.match_volume, row.match_wa, row.classification) == ("v1", "WA1", "v2", "WA2", "propose_merge")


def test_references(spark, volumes):
    refs = spark.createDataFrame([("q1", "v1", 0, 30), ("q2", "v3", 0, 5), ("q3", "v9", 0, 5), ("q4", "v1", 900, 901)], "query string, volume_id string, cstart int, cend int")
    assert {r.query: r.fault for r in X.reference_texts(refs, volumes).collect()} == {"q1": None, "q2": "no chunks", "q3": "no volume", "q4": "no text"}
    assert [(r.query, r.wa_id, r.volumes) for r in X.find_by_reference(refs, volumes).collect()] == [("q1", "WA2", ["v2"])]


def test_service_finds_works_and_syncs(spark, volumes, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}")
    catalog.save("volumes", volumes)
    for wrong in ({}, {"text": " "}, {"text": "x", "volume_id": "v1"}, {"volume_id": "v1", "cstart": 5, "cend": 5}):
        with pytest.raises(ValueError):
            catalog.find_work(**wrong)
    with pytest.raises(C.NotFoundError):
        catalog.find_work(volume_id="v9", cstart=0, cend=5)
    released = spark.createDataFrame([("WA1", True, None, "one"), ("WA2", True, None, "two"), ("WA3", False, None, "three")], "id string, released boolean, replacement string, pref_label_bo string")
    assert {r.id: r.outcome for r in catalog.sync("works", released).collect()}["WA1"] == "upsert"
    assert {r.id: r.record_status for r in catalog.table("works").collect()} == {"WA1": "active", "WA2": "active"}
    assert [r.wa_id for r in catalog.find_work(volume_id="v1", cstart=0, cend=30).collect()] == ["WA2"]
    assert {r.wa_id for r in catalog.find_work(text=" ".join(WORDS)).collect()} == {"WA1", "WA2"}
    catalog.sync("works", spark.createDataFrame([("WA2", False, "WA1", "two")], "id string, released boolean, replacement string, pref_label_bo string"))
    assert catalog.get("works", "WA2")["record_status"] == "duplicate" and catalog.get("works", "WA2")["canonical_id"] == "WA1"
    catalog.sync("works", spark.createDataFrame([("WA1", False, None, "one")], "id string, released boolean, replacement string, pref_label_bo string"))
    assert catalog.get("works", "WA1")["record_status"] == "withdrawn"


def test_stored_fingerprints_stand_for_documents(spark):
    docs = spark.createDataFrame([("a", "x y z"), ("b", "x y z"), ("c", "q r s")], "doc_id string, text string")
    found = K.create("minhash_sidecar")
    made = found.fingerprints(docs)
    found.preload(spark.createDataFrame([("a", "1:own"), ("a", "1:own"), ("z", "1:own")], "id string, item string"))
    both = sorted(map(tuple, found.fingerprints(docs).collect()))
    assert both == sorted([("a", "1:own"), *map(tuple, made.where("id <> 'a'").collect())])


def test_open_evaluation(spark):
    text = " ".join(WORDS)
    corpus = spark.createDataFrame([("a", text, "g"), ("b", text, "g"), ("x", text, None), ("y", "other words than these", None)], "doc_id string, text string, g string")
    docs = corpus.where("g IS NOT NULL")
    found = K.open_evaluation(K.create("minhash_query", msm_pct=0.005), docs, corpus, "g", [1, 2])
    assert found == {"corpus": 4, "open_recall_at": {1: 1.0, 2: 1.0}}
    with pytest.raises(ValueError):
        K.open_evaluation(K.create("minhash_bands"), docs, corpus, "g", [1])


def test_results_are_saved_and_reported_again(spark, tmp_path):
    figures = {"docs": 2, "groups": 1, "f1": 0.5, "recall_at": {20: 0.25}, "open_recall_at": {50: 0.125}}
    for _ in range(2):
        path = W.save_result(spark, str(tmp_path), "minhash_bands", "d_id", {"bands": 20}, figures)
    assert path.endswith(W.result_name("minhash_bands", "d_id", {"bands": 20}))
    (found,) = W.saved_results(spark, str(tmp_path))
    assert found == figures | {"method": "minhash_bands", "field": "d_id", "options": {"bands": 20}}
    assert "| minhash_bands | 2 | 1 | 0.500 | - | - | - | - | 0.250 | 0.125 |" in W.report([found])
