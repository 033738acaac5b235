import sqlite3
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leafmill.sources import keyed as K


def counted(fetch, log, broken=()):
    """fetch that leaves a file for each time it is asked, named by its first key and turn, and fails the first time for some chunks."""

    def run(keys):
        turn = len(list(Path(log).glob(f"{keys[0]}.*")))
        (Path(log) / f"{keys[0]}.{turn}").write_text(",".join(map(str, keys)))
        if keys[0] in broken and turn == 0:
            raise OSError("gone for a moment")
        return fetch(keys)

    return run


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "o").mkdir()
    for k in range(10):
        (tmp_path / "o" / f"k{k}").write_bytes(bytes([k]) * k)
    (tmp_path / "log").mkdir()
    return tmp_path


def asked(folder):
    return sorted(f.read_text() for f in (folder / "log").iterdir())


def test_only_the_keys_are_fetched(spark, folder):
    K.register(spark, "objects_a", "key string, content binary", counted(K.objects(f"{folder}/o"), f"{folder}/log"), chunk=2)
    df = spark.read.format("objects_a").load().where(F.col("key").isin("k1", "k3", "none", "k1") & (F.length("content") > 0))
    assert {r.key: bytes(r.content) for r in df.collect()} == {"k1": b"\1", "k3": b"\3\3\3"}
    assert asked(folder) == ["k1,k3", "none"]
    both = spark.read.format("objects_a").load().where(F.col("key").isin("k1", "k5", "none")).where("key = 'none'")
    assert [(r.key, r.content) for r in both.collect()] == [("none", None)]
    with pytest.raises(Exception, match="asked by key"):
        spark.read.format("objects_a").load().collect()
    with pytest.raises(Exception, match="out of the folder"):
        spark.read.format("objects_a").load().where("key = '../log'").collect()


def test_a_failed_chunk_is_tried_alone(spark, folder):
    K.register(spark, "objects_b", "key string, content binary", counted(K.objects(f"{folder}/o"), f"{folder}/log", {"k2"}), chunk=2, wait=0.0)
    keys = [f"k{k}" for k in range(6)]
    assert spark.read.format("objects_b").load().where(F.col("key").isin(keys)).count() == 6
    assert sorted(f.name for f in (folder / "log").iterdir()) == ["k0.0", "k2.0", "k2.1", "k4.0"]


def test_keys_of_a_table(spark, folder):
    keys = spark.createDataFrame([(f"k{k % 12}",) for k in range(40)] + [(None,)], "key string")
    found = K.fetched(keys, "key string, content binary", K.objects(f"{folder}/o"), chunk=3).collect()
    assert sorted(r.key for r in found) == sorted(f"k{k}" for k in range(12)) and sum(r.content is None for r in found) == 2


def test_rows_of_a_database(spark, folder):
    at = f"{folder}/db"
    with sqlite3.connect(at) as db:
        db.execute("create table t (id integer, name text)")
        db.executemany("insert into t values (?, ?)", [(i, f"n{i}") for i in range(100)] + [(7, "again")])
    fetch = K.rows_by_key(lambda: sqlite3.connect(at), "SELECT id, name FROM t WHERE id IN ({keys})")
    K.register(spark, "rows_a", "id long, name string", counted(fetch, f"{folder}/log"), chunk=5)
    df = spark.read.format("rows_a").load().where(F.col("id").isin(7, 9, 500) & (F.col("name") != "n9"))
    assert sorted(tuple(r) for r in df.collect()) == [(7, "again"), (7, "n7")] and asked(folder) == ["7,9,500"]
