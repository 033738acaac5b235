import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import ingest as I
from leafmill.operators.standoff import to_standoff, verification
from leafmill.operators.joins import overlapping

MARKS = re.compile(I.SENTENCE_END)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab །.\n", max_size=400), st.integers(5, 40))
def test_chunks_cover_the_text(text, size):
    spans = I.sentence_chunks(text, MARKS, size)
    assert "".join(text[a:b] for a, b in spans) == text
    assert all(a < b <= a + 2 * size + 1 for a, b in spans)


def test_chunk_breaks():
    assert I.sentence_chunks("aaa. bbb. ccc", MARKS, 10) == [(0, 5), (5, 13)] or I.sentence_chunks("aaa. bbb. ccc", MARKS, 10)[0] == (0, 5)
    assert I.sentence_chunks("x" * 30, MARKS, 10) == [(0, 20), (20, 30)]
    assert I.sentence_chunks("xxxxxxxxxxxx yyyyyyyyyyyy", MARKS, 10) == [(0, 13), (13, 25)] or I.sentence_chunks("xxxxxxxxxxxx yyyyyyyyyyyy", MARKS, 10)[0] == (0, 13)
    assert I.sentence_chunks("", MARKS, 10) == []


def test_pages_and_spans(spark):
    pages = spark.createDataFrame([("v", "b", "two"), ("v", "a", "one"), ("v", "c", "x"), ("v", "0", "intro")], "volume_id string, name string, text string")
    numbers = spark.createDataFrame([("v", "0", 1), ("v", "a", 2), ("v", "b", 3)], "volume_id string, name string, pnum int")
    a = I.assembled_pages(pages, "volume_id", "name", numbers, intro=1)
    rows = {r.name: (r.cstart, r.cend) for r in a.collect()}
    text = I.volume_texts(a, "volume_id").first().text
    assert text == "one\n\ntwo\n\nx" and {k: text[s:e] for k, (s, e) in rows.items()} == {"a": "one", "b": "two", "c": "x"}


def test_boundaries_of_odd_and_even_overlaps(spark):
    s = spark.createDataFrame([("v", 0, 0, 10), ("v", 1, 7, 20), ("v", 2, 16, 30), ("v", 3, 30, 40)], "volume_id string, idx int, cstart long, cend long")
    rows = [(r.cstart_clean, r.cend_clean, r.boundary_start, r.boundary_end) for r in I.clean_boundaries(s).orderBy("idx").collect()]
    assert rows == [(0, 8, "clean", "shared_page"), (9, 18, "shared_page", "shared_page"), (18, 30, "shared_page", "clean"), (30, 40, "clean", "clean")]
    starts = spark.createDataFrame([("v", 0)], "volume_id string, cstart long")
    assert [r.boundary_start for r in I.snapped(I.clean_boundaries(s), starts).orderBy("idx").collect()] == ["clean", "shared_page", "shared_page", "page_snap"]


def test_texts_of_49_and_50_characters(spark):
    s = spark.createDataFrame([("v", 0, 0, 50, None), ("v", 1, 50, 99, "MW7"), ("v", 2, 99, 99, None)], "volume_id string, idx int, cstart long, cend long, mw_id string")
    vols = spark.createDataFrame([("v", None, "x" * 99)], "volume_id string, volume_mw string, text string")
    assert [(r.doc_id, r.text_length) for r in I.text_documents(I.clean_boundaries(s), vols).collect()] == [("v_S0", 50)]


def test_span_over_chunks(spark):
    row = spark.createDataFrame([([(0, 4, "abcd"), (4, 8, "efgh"), (8, 9, "i")],)], "c array<struct<cstart:int,cend:int,text_bo:string>>")
    for a in range(9):
        for b in range(a, 10):
            assert row.select(I.span_text(F.col("c"), F.lit(a), F.lit(b))).first()[0] == "abcdefghi"[a:b]


def test_overlap_join_equals_comparison(spark):
    import random

    rng = random.Random(1)
    spans = [("v", i, s := rng.randrange(300), s + rng.randrange(60)) for i in range(40)]
    chunks = [("v", i, s := rng.randrange(300), s + rng.randrange(60)) for i in range(40)]
    got = overlapping(spark.createDataFrame(spans, "k string, a int, cstart int, cend int"), spark.createDataFrame(chunks, "k string, b int, c_start int, c_end int"), "k", 16)
    want = {(a, b) for _, a, s, e in spans for _, b, x, y in chunks if e > s and y > x and y > s and x < e}
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(want)


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><idno type="src_path">a/b.txt</idno></teiHeader><text><body><div><milestone xml:id="D1"/><pb n="1a"/><p>one <hi rend="small">two</hi> &lt;x&gt;<lb/> three<note>no</note></p><pb n="1b"/><p>four <choice><orig>o</orig><corr>c</corr></choice> <gap/> <unclear><supplied>u</supplied></unclear></p></div><div><milestone xml:id="D2"/><p>five<figure><caption><p>cap</p></caption></figure></p></div></body></text></TEI>"""


def test_standoff():
    found = to_standoff(TEI)
    text = found["text"]
    assert text == "one two <x>\nthree\n\nfour c X u\n\nfivecap" and found["source_path"] == "a/b.txt"
    assert [(p["pname"], text[p["cstart"] : p["cend"]]) for p in found["pages"]] == [("1a", "one two <x>\nthree"), ("1b", "four c X u\n\nfivecap")]
    assert [(h["rend"], text[h["cstart"] : h["cend"]]) for h in found["hi"]] == [("small", "two"), ("unclear", "u")]
    assert text[found["milestones"]["D2"] :] == "fivecap" and found["milestones"]["eop:1"] == found["pages"][0]["cend"]
    assert to_standoff("<broken") is None and to_standoff("<TEI/>") is None


def test_verification(spark):
    from leafmill.operators.standoff import standoff

    made = standoff(spark.createDataFrame([("v", TEI)], "id string, content string"), "id", "content")
    src = spark.createDataFrame([("v", "one two <x>\nthree\nfour c X u\nfivecap", ["1b", "2a"], ["D1", "D3"])], "id string, text string, pages array<string>, milestones array<string>")
    assert {r.check: r.detail for r in verification(made, src).collect()} == {"milestones_missing": "D3", "milestones_extra": "D2", "pages_missing": "2a"}


def test_functions(spark):
    row = spark.createDataFrame([("1#D1", "x#D1", "http://r/W12#a/b", "W1", "mkhan po blo lags")], "c string, d string, u string, w string, h string")
    got = row.select(T.coordinate(F.col("c")).alias("c"), T.coordinate(F.col("d")).alias("d"), T.local_name(F.col("u")).alias("u"), T.record_type(F.col("w")).alias("w"), T.without_affixes(F.col("h"), ["mkhan ", "mkhan po "], [" lags"]).alias("h")).first()
    assert tuple(got.c) == (1, "D1") and got.d is None and got.u == "b" and got.w == "work" and got.h == "blo"
    v = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>").select(T.l2_normalised(F.col("a")).alias("a"), T.l2_normalised(F.col("b")).alias("b"), T.dot(F.col("a"), F.array(F.lit(1.0))).alias("d")).first()
    assert v.a == [0.6, 0.8] and v.b == [0.0, 0.0] and v.d == 0.0
    n = spark.range(1, 30).select(F.col("id"), T.chunk_bounds(F.col("id"), 10).alias("b")).collect()
    assert all([(x.lo, x.hi) for x in r.b] == [(round(i * r.id / (k := min(10, r.id))), round((i + 1) * r.id / k)) for i in range(min(10, r.id))] for r in n)
