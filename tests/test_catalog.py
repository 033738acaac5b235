import pytest
from pyspark.sql import functions as F

from leafmill.api import Catalog
from leafmill.operators import catalog as C


def test_life_of_a_record(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    ann = c.create("persons", {"pref_label_bo": "Ann"}, "me")
    bob = c.create("persons", {"pref_label_bo": "Bob"}, "me")
    assert (ann, bob) == ("P1BC1", "P1BC2")
    work = c.create("works", {"pref_label_bo": "red small book", "authors": [bob, "P9", ann]}, "me")
    assert work == "WA1BC10"
    assert c.list("works").count() == 0  # new records are not active
    assert c.list("works", status="new").first().total == 1
    c.update("works", work, {"alt_label_bo": ["little book"], "record_status": "active"}, "you")
    got = c.get("works", work)
    assert got["curation"]["edit_version"] == 2 and got["curation"]["modified_by"] == "you" and got["pref_label_bo"] == "red small book"
    assert C.with_authors(c.table("works"), c.table("persons")).first().author_names == ["Bob", "Ann"]
    assert [r.id for r in c.search("works", "small book").collect()] == [work]
    assert c.search("works", "no such words").count() == 0
    assert [r.id for r in c.list("works", author=bob).collect()] == [work] and c.list("works", label="small").count() == 1 and c.list("works", label="tall").count() == 0
    with pytest.raises(C.ConflictError):
        c.delete("persons", bob, "me")
    other = c.create("works", {"pref_label_bo": "copy"}, "me")
    for error, args in ((C.ConflictError, (other, other)), (C.NotFoundError, (other, "W0"))):
        with pytest.raises(error):
            c.merge("works", *args, "me")
    c.merge("works", other, work, "me")
    with pytest.raises(C.ConflictError):
        c.merge("works", other, work, "me")
    c.delete("works", work, "me")
    assert c.get("works", work)["record_status"] == "deleted" and c.get("works", other)["canonical_id"] == work
    assert [r.action for r in c.history(work).orderBy("n").collect()] == ["delete", "edit", "create"]
    assert {(r.type, r.status): r.n for r in c.stats().collect()}[("work", None)] == 2


def test_reviewed_volumes_make_works_active(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    p = c.create("persons", {"pref_label_bo": "Ann"}, "me")
    w = c.create("works", {"pref_label_bo": "book", "authors": [p]}, "me")
    v = spark.createDataFrame([{"id": "V1", "type": "volume_etext", "rep_id": "R", "vol_id": "I", "status": "active", "segments": [{"wa_id": w, "cstart": 0, "cend": 5}]}], c.table("volumes").schema)
    c.save("volumes", v)
    c.set_volume_status("V1", "reviewed")
    assert c.get("works", w)["record_status"] == "active" and c.get("persons", p)["record_status"] == "active"
    assert c.volume("R", "I")["status"] == "reviewed"
    with pytest.raises(ValueError):
        c.set_volume_status("V1", "none")


def test_upsert_keeps_curation_and_nulls_never_overwrite(spark):
    now = spark.createDataFrame([("a", "x", True), ("b", "x", False), ("c", "x", False)], "id string, label string, modified boolean").selectExpr("*", "2 as edit_version", "'active' as record_status", "'local' as origin")
    new = spark.createDataFrame([("a", "y"), ("b", None), ("d", "y")], "id string, label string")
    found = {r.id: (r.label, r.outcome) for r in C.upserted(now, new, ["label"]).collect()}
    assert found == {"a": ("x", "kept"), "b": ("x", "updated"), "c": ("x", "untouched"), "d": ("y", "created")}


def test_empty_lists_overwrite(spark):
    now = spark.createDataFrame([("a", ["x"], False)], "id string, alt array<string>, modified boolean").selectExpr("*", "1 as edit_version", "'active' as record_status", "'imported' as origin")
    assert C.upserted(now, spark.createDataFrame([("a", [])], "id string, alt array<string>"), ["alt"]).first().alt == []


def test_deleted_records_come_back_unless_kept(spark):
    works = spark.createDataFrame([("W1", "deleted", ["P1"]), ("W2", "duplicate", ["P2"])], "id string, record_status string, authors array<string>")
    persons = spark.createDataFrame([("P1", "new"), ("P2", "new")], "id string, record_status string")
    segments = spark.createDataFrame([("W1",), ("W2",), (None,)], "wa_id string")
    assert {r.id for r in C.activated(segments, works, persons).collect()} == {"W1", "P1"}
    assert C.activated(segments, works, persons, keep_deleted=True).count() == 0


def test_paging_bounds(spark):
    with pytest.raises(ValueError):
        C.page(spark.range(3), 0, 500, F.col("id"))


def test_a_reopened_catalog_has_its_tables(spark, tmp_path):
    c = Catalog(spark, str(tmp_path), buckets=4)
    ids = [c.create("persons", {"pref_label_bo": f"name {k}"}, "me") for k in range(3)]
    again = Catalog(spark, str(tmp_path))
    assert set(again.get_many("persons", [*ids, "P9"])) == set(ids) and again.get("persons", ids[1])["pref_label_bo"] == "name 1"
    before = again.store("persons").manifest()
    again.update("persons", ids[0], {"pref_label_bo": None}, "you")
    after = again.store("persons").manifest()
    changed = [b for b in after["deltas"] if after["deltas"][b] != before["deltas"].get(b)]
    assert len(changed) == 1 and after["base"] == before["base"] and c.get("persons", ids[0])["pref_label_bo"] is None
    again.compact()
    assert again.table("persons").count() == 3 and not again.store("persons").manifest()["deltas"]


def test_two_curators_at_a_time(spark, tmp_path, monkeypatch):
    c, other = Catalog(spark, str(tmp_path), buckets=2), Catalog(spark, str(tmp_path))
    p = c.create("persons", {"pref_label_bo": "Ann"}, "me")
    read = c.get

    def slow(name, id):
        found = read(name, id)
        other.update("persons", p, {"dates": "1400"}, "you")
        return found

    monkeypatch.setattr(c, "get", slow)
    with pytest.raises(C.ConflictError):
        c.update("persons", p, {"pref_label_bo": "Anne"}, "me")
    got = other.get("persons", p)
    assert got["dates"] == "1400" and got["pref_label_bo"] == "Ann" and got["curation"]["edit_version"] == 2


def volume(spark, **more):
    row = {"id": "V1", "type": "volume_etext", "mw_id": "MW1", "cend": 10, "status": "active", "chunks": [{"cstart": 0, "cend": 4, "text_bo": "abcd"}, {"cstart": 4, "cend": 10, "text_bo": "efghij"}]}
    return spark.createDataFrame([row | more], Catalog(spark, "/none").table("volumes").schema)


def test_annotated_volumes_are_checked_and_saved(spark, tmp_path):
    c = Catalog(spark, str(tmp_path), buckets=2)
    p = c.create("persons", {"pref_label_bo": "Ann"}, "me")
    w = c.create("works", {"pref_label_bo": "book", "authors": [p]}, "me")
    c.save("volumes", volume(spark))
    good = [{"mw_id": "MW1_b", "wa_id": None, "cstart": 4, "cend": 10, "part_type": "editorial", "title_bo": ["t", "u"]}, {"mw_id": "MW1_a", "wa_id": w, "cstart": 0, "cend": 4, "part_type": "text", "title_bo": "one", "author_name_bo": ""}]
    wrong = {
        "no volume": ("V9", "abcdefghij", good),
        "another work": ("V1", "abcdefghij", [good[0] | {"mw_id": "MW2_a"}]),
        "base_text": ("V1", "abcdefghi", good),
        "starts at 4": ("V1", "abcdefghij", good[:1]),
        "ends at 4": ("V1", "abcdefghij", good[1:]),
    }
    for message, args in wrong.items():
        with pytest.raises(ValueError, match=message):
            c.save_annotated_volume(*args, "in_review")
    with pytest.raises(ValueError, match="status"):
        c.save_annotated_volume("V1", "abcdefghij", good, "done")
    c.save_annotated_volume("V1", "abcdefghij", good, "in_review")
    saved = c.get("volumes", "V1")
    assert [(s["mw_id"], s["segment_type"], s["title_bo"], s["author_name_bo"]) for s in saved["segments"]] == [("MW1_b", "editorial", ["t", "u"], None), ("MW1_a", "text", ["one"], None)]
    assert saved["status"] == "in_review" and c.get("works", w)["record_status"] == "new"
    c.save_annotated_volume("V1", "abcdefghij", good, "reviewed")
    assert c.get("works", w)["record_status"] == "active" and c.get("persons", p)["record_status"] == "active"


def test_ocr_imports_keep_what_curators_did(spark, tmp_path):
    c = Catalog(spark, str(tmp_path), buckets=2)
    assert [(r.id, r.outcome) for r in c.import_ocr(volume(spark, status=None)).collect()] == [("V1", "created")]
    first = c.get("volumes", "V1")
    assert first["status"] == "active" and first["first_imported_at"] == first["last_updated_at"] is not None
    c.save_annotated_volume("V1", "abcdefghij", [{"mw_id": "MW1_a", "cstart": 0, "cend": 10, "part_type": "text", "title_bo": "x"}], "in_review")
    new = volume(spark, status="active", nb_pages=7).unionByName(volume(spark, id="V2"))
    assert {r.id: r.outcome for r in c.import_ocr(new).collect()} == {"V1": "updated", "V2": "created"}
    again = c.get("volumes", "V1")
    assert again["nb_pages"] == 7 and again["status"] == "in_review" and len(again["segments"]) == 1 and again["first_imported_at"] == first["first_imported_at"]


def test_works_and_persons_are_searched_with_filters(spark, tmp_path):
    c = Catalog(spark, str(tmp_path), buckets=2)
    schema = c.table("works").schema
    rows = [("W1", "red book by ann", "active", "local"), ("W2", "red book", "active", "imported"), ("W3", "red book by ann", "duplicate", "local")]
    c.save("works", spark.createDataFrame([{"id": i, "pref_label_bo": t, "record_status": s, "origin": o, "authors": ["P1"] if i == "W2" else []} for i, t, s, o in rows], schema))
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(c.search_works("red book", "by ann")) == ["W1"] and sorted(ids(c.search_works(title="red book"))) == ["W1", "W2"]
    assert ids(c.search_works("red book", author="P1")) == ["W2"] and ids(c.search_works(origin="local")) == ["W1"] and ids(c.search_works("red", status="duplicate")) == ["W3"]
    for wrong in ({}, {"title": ""}):
        with pytest.raises(ValueError, match="text or a filter"):
            c.search_works(**wrong)
    with pytest.raises(ValueError, match="text or a filter"):
        c.search_persons()
    with pytest.raises(TypeError):
        c.search_works(colour="red")
    assert ids(c.search_persons("ann")) == []


def test_canonical_keeps_a_flat_plan(spark):
    """Chains and cycles by doubling; the plan holds the records twice at most, however long the chain is (F23)."""
    chain = [(k, "duplicate", k - 1) for k in range(1, 40)]
    rows = [(0, "active", None), *chain, (100, "duplicate", 101), (101, "duplicate", 100), (200, "duplicate", 999), (300, "duplicate", None), (301, "duplicate", 301), (302, "active", 0)]
    out = C.canonical(spark.createDataFrame(rows, "id int, record_status string, canonical_id int"))
    found = {r.id: r.canonical for r in out.collect()}
    assert all(found[k] == 0 for k in range(40)) and found[100] in (100, 101) and found[101] in (100, 101)
    assert (found[200], found[300], found[301], found[302]) == (999, 300, 301, 302) and len(found) == len(rows)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
