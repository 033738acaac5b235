import gzip
import json

import pytest
from pyspark.sql import functions as F

from leafmill.sources import readers as R
from leafmill.sources import writers as W


def put(path, text, zipped=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt") if zipped else path.open("w") as out:
        out.write(text)
    return str(path)


def test_ocr_pages(spark, tmp_path):
    spark.createDataFrame([("b.jpg", True, "x", ["no"]), ("a.jpg", None, "y", None), ("c.jpg", True, None, None)], "img_file_name string, ok boolean, text string, line_texts array<string>").write.parquet(str(tmp_path / "one"))
    assert sorted((r.name, r.text) for r in R.ocr_pages(spark, str(tmp_path / "one")).collect()) == [("b.jpg", "x"), ("c.jpg", "")]
    spark.createDataFrame([("a.jpg", ["l1", "l2"]), ("b.jpg", None)], "img_file_name string, line_texts array<string>").write.parquet(str(tmp_path / "two"))
    assert sorted((r.name, r.text) for r in R.ocr_pages(spark, str(tmp_path / "two")).collect()) == [("a.jpg", "l1\nl2"), ("b.jpg", "")]
    spark.createDataFrame([("a",)], "img_file_name string").write.parquet(str(tmp_path / "three"))
    with pytest.raises(ValueError):
        R.ocr_pages(spark, str(tmp_path / "three"))


def test_image_list(spark, tmp_path):
    images = [{"filename": "a.jpg", "width": 1, "height": 1}, {"filename": "d.json", "width": 1, "height": 1}, {"filename": "b.jpg", "width": None, "height": 1}, {"filename": "c.jpg", "width": 1, "height": 1}]
    put(tmp_path / "dimensions.json.gz", json.dumps(images), True)
    assert [(r.name, r.pnum) for r in R.image_list(spark, str(tmp_path)).orderBy("pnum").collect()] == [("a.jpg", 1), ("c.jpg", 2)]


def test_csvs(spark, tmp_path):
    assert [tuple(r) for r in R.batch_list(spark, put(tmp_path / "batch.csv", " W1 ,I1,v1,google_books\n,I2,v1,x\n")).collect()] == [("W1", "I1", "v1", "google_books")]
    truth = put(tmp_path / "t.csv", "mw_id,d_id,rkts_id,nlm_id\nmw1,d1,r1,n1\nmw2,d1,,n2\nmw3,d2,r3,\nmw4,d3,,\n,d4,,\nmw1, d1 ,r9,n1\n")
    rows = {r.mw_id: r for r in R.ground_truth(spark, truth).collect()}
    assert set(rows) == {"mw1", "mw2", "mw3", "mw4"} and rows["mw1"].rkts_id == "r9" and rows["mw2"].rkts_id is None and rows["mw1"].d_id == "d1"
    ids = lambda name, text: R.id_list(spark, put(tmp_path / name, text))
    kept = R.scoped(R.ground_truth(spark, truth), ids("a", "mw1\nmw2\nmw3\n# x\n"), ids("d", "mw2\n"), ids("s", "mw1\nmw2\n"))
    assert [r.mw_id for r in kept.collect()] == ["mw1"]
    outline = put(tmp_path / "o.csv", "part type,label,img grp start,etext start,etext end\nT,lost,,1#D1,\nV,one,3,,\nT,a,,1#D1,1#D2\nV,bad,x,,\nT,lost,,1#D3,\nV,two,4,,\nT,b,,bad,\n")
    got = [(r.label, r.volume, r.start and r.start.milestone) for r in R.outline_rows(spark, outline).orderBy("line").collect()]
    assert got == [("a", 3, "D1"), ("b", 4, None)]
    assert [tuple(r) for r in R.mapping_list(spark, put(tmp_path / "m.csv.gz", "mw,w,i\nMW1,W1,I1\nMW2,,I2\nMW3\n", True)).collect()] == [("MW1", "W1", "I1")]


TRIG = '''@prefix bdo: <http://x/o/> . @prefix r: <http://r/> .
<http://g/1> { r:W1 a bdo:Work ; bdo:label "ka \\"x\\""@bo , "kha"@bo-x-ewts ; bdo:creator r:C1 , r:C2 , r:C3 .
r:C1 bdo:agent r:P1 ; bdo:role r:R1 . r:C2 bdo:agent r:P2 ; bdo:role r:R2 . r:C3 bdo:agent r:P3 ; bdo:role r:R9 . r:W2 bdo:label "ga"@bo-x-ewts ; bdo:creator r:C4 . r:C4 bdo:agent r:P4 ; bdo:role r:R2 . }
'''


def test_graphs(spark, tmp_path):
    quads = R.trig(spark, put(tmp_path / "a" / "W1.trig", TRIG)).cache()
    assert quads.where("g = 'http://g/1'").count() == quads.count() == 16
    assert {r.id: r.label for r in R.preferred_label(quads, "http://x/o/label").collect()} == {"W1": 'ka "x"', "W2": "ga"}
    found = R.authors(quads, "http://x/o/creator", "http://x/o/agent", "http://x/o/role", ["R1", "R2"], "R1")
    assert {r.id: r.authors for r in found.collect()} == {"W1": ["P1"], "W2": ["P4"]}
    lines = '<http://s> <http://p> "a \\"b\\""@en <http://g> .\n<http://s> <http://p> <http://o> .\n# no\nbroken\n'
    assert [tuple(r) for r in R.nquads(spark, put(tmp_path / "q.nq", lines)).collect()] == [("http://g", "http://s", "http://p", 'a "b"', "en"), ("", "http://s", "http://p", "http://o", None)]


def test_files_and_snapshots(spark, tmp_path):
    for name in ("archive/VE1/b.xml", "archive/VE1/a.xml", "archive/VE0/c.xml", "other/VE2/d.xml"):
        put(tmp_path / name, "<x/>")
    assert [(r.volume, r.path[-5:], r.n) for r in R.tei_files(spark, str(tmp_path)).orderBy("n").collect()] == [("VE0", "c.xml", 1), ("VE1", "a.xml", 2)]
    before, after = (spark.createDataFrame(x, "path string, hash string") for x in ([("a", "1"), ("b", "1")], [("a", "1"), ("b", "2"), ("c", "1")]))
    assert {r.path for r in R.changed_files(before, after).collect()} == {"b", "c"} and R.changed_files(before, after, True).count() == 3 and R.changed_files(None, after).count() == 3
    keys = spark.createDataFrame([("gv/W1/I1/v1/x",), ("gv/W1/I1/v2/x",), ("gv/W2/I1/v1/x",), ("zz",)], "key string")
    cache = spark.createDataFrame([("W1", "I1", "v0")], "w string, i string, version string")
    assert sorted(map(tuple, R.latest_versions(keys, cache).collect())) == [("W1", "I1", "v0"), ("W2", "I1", "v1")]
    assert R.bytes_at(spark, str(tmp_path / "none")).count() == 0 and R.bytes_at(spark, str(tmp_path / "archive/VE0/c.xml")).count() == 1
    text = spark.createDataFrame([(1, "[1a][1a.1]x{D1}y(o,c)[1b]z")], "id int, t string")
    row = R.source_text(text, "id", "t").first()
    assert (row.text, row.pages, row.milestones) == ("xyoz", ["1a", "1b"], ["D1"])


def test_writers(spark, tmp_path):
    assert W.options(["a=1", "b=0.5", "c=true", "d=x"]) == {"a": 1, "b": 0.5, "c": True, "d": "x"}
    with pytest.raises(ValueError):
        W.options(["a"])
    assert W.options_hash({"a": 1, "b": 2}) == W.options_hash({"b": 2, "a": 1}) and W.result_name("m", "d_id", {}).startswith("m_d_id_")
    text = W.report([{"method": "b", "docs": 5, "f1": 0.5}, {"method": "a", "docs": 5, "f1": 0.5}, {"method": "c", "docs": 9, "f1": 0.1}])
    assert [x.split(" | ")[0] for x in text.splitlines()[2:]] == ["| c", "| a", "| b"] and "-" in text
    rows = spark.createDataFrame([(1, "x"), (2, None)], "id int, job string")
    W.matched_split(rows, "job", str(tmp_path / "m"), str(tmp_path / "u"))
    assert spark.read.csv(str(tmp_path / "m"), header=True).count() == spark.read.csv(str(tmp_path / "u"), header=True).count() == 1
    W.tokenised(spark.createDataFrame([("a  b",), ("",)], "t string"), "t", str(tmp_path / "tok"))
    assert [r.value for r in spark.read.text(str(tmp_path / "tok")).collect()] == ["a b"]
    assert spark.createDataFrame([(None, " ", "x")], "a string, b string, c string").select(W.first_text("a", "b", "c")).first()[0] == "x"
    assert not W.append_audit(rows.select(F.lit(None).alias("v")), "/proc/none/x")
