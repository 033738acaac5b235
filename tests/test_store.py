import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import catalog as C
from leafmill.sources import store as S

SCHEMA = "id string, name string, tags array<string>, n int"


@pytest.fixture
def store(spark, tmp_path):
    return S.Store.create(spark, f"file://{tmp_path}/s", SCHEMA, "id", 8)


def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(frame):
    return {r.id: (r.name, r.tags, r.n) for r in frame.collect()}


def test_changes_equal_a_dictionary(spark, store):
    rng, want = random.Random(1), {}
    first = [(f"k{i}", f"n{i}", ["x"], i) for i in range(60)]
    store.replace(df(spark, first))
    want |= {r[0]: r[1:] for r in first}
    past = {store.manifest()["version"]: dict(want)}
    for turn in range(4):
        rows = [(f"k{rng.randrange(90)}", f"t{turn}", None, rng.randrange(9)) for _ in range(15)]
        rows = list({r[0]: r for r in rows}.values())
        version = store.upsert(df(spark, rows))
        want |= {r[0]: r[1:] for r in rows}
        gone = [f"k{rng.randrange(90)}" for _ in range(5)]
        version = store.delete(spark.createDataFrame([(g,) for g in gone], "id string"))
        want = {k: v for k, v in want.items() if k not in gone}
        past[version] = dict(want)
        if turn == 2:
            store.compact()
            assert not store.manifest()["deltas"]
        assert held(store.read()) == want
    some = ["k1", "k2", "k70", "k999"]
    assert held(store.multi_get(some)) == {k: want[k] for k in some if k in want}
    assert all(held(store.read(v)) == rows for v, rows in past.items())
    assert held(S.Store(spark, store.folder).read()) == want
    assert store.clear() > 0 and held(store.read()) == want
    with pytest.raises(C.NotFoundError):
        store.read(1)


def test_an_update_writes_one_bucket(spark, store):
    store.replace(df(spark, [(f"k{i}", "n", None, i) for i in range(100)]))
    before = store.manifest()
    store.upsert(df(spark, [("k5", "new", [], 1)]))
    after = store.manifest()
    assert after["base"] == before["base"] and len(after["deltas"]) == 1 and store.get("k5") == {"id": "k5", "name": "new", "tags": [], "n": 1}
    assert store.get("none") is None and store.multi_get([]).count() == 0
    plan = store.read()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Union" in plan  # the other buckets are scanned as they are


def test_writers_of_one_version_conflict(spark, store):
    version = store.manifest()["version"]
    other = S.Store(spark, store.folder)
    store.upsert(df(spark, [("a", "mine", None, 1)]), expect=version)
    with pytest.raises(S.VersionConflict):
        other.upsert(df(spark, [("a", "yours", None, 1)]), expect=version)
    manifest = store.manifest()
    assert not store._commit(manifest) and store.manifest() == manifest  # a number that is taken stays as it is
    other.upsert(df(spark, [("b", "yours", None, 1)]))
    assert set(held(store.read())) == {"a", "b"}
    with pytest.raises(C.ConflictError):
        S.Store.create(spark, store.folder, SCHEMA)


def test_compaction_keeps_what_comes_meanwhile(spark, store, monkeypatch):
    store.replace(df(spark, [("a", "1", None, 1), ("b", "1", None, 1)]))
    store.upsert(df(spark, [("a", "2", None, 2)]))
    write = store._write

    def slow(manifest, rows):
        out = write(manifest, rows)
        monkeypatch.setattr(store, "_write", write)
        store.upsert(df(spark, [("a", "3", None, 3)]))
        return out

    monkeypatch.setattr(store, "_write", slow)
    store.compact()
    assert held(store.read()) == {"a": ("3", None, 3), "b": ("1", None, 1)}


def test_patches_and_odd_rows(spark, store):
    store.upsert(df(spark, [("a", "1", ["x"], 1), ("a", "2", ["x"], 1), (None, "3", None, 3), ("c", None, None, None)]))
    assert held(store.read()) == {"a": ("2", ["x"], 1), "c": (None, None, None)}
    patches = spark.createDataFrame([("a", ["name"], None, 9), ("z", ["n"], None, 1)], "id string, given array<string>, name string, n int")
    store.patch(patches, ["name", "n"])
    assert held(store.read()) == {"a": (None, ["x"], 1), "c": (None, None, None)}
    assert store.upsert(df(spark, [])) == store.manifest()["version"]
    store.delete(spark.createDataFrame([("a",), ("a",), ("q",)], "id string"))
    store.compact()
    assert held(store.read()) == {"c": (None, None, None)}
    store.upsert(spark.createDataFrame([("d",)], "id string"))
    assert held(store.read())["d"] == (None, None, None)


def test_a_lookup_reads_few_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "GROUP_BYTES", 16 << 10)
    store = S.Store.create(spark, f"file://{tmp_path}/s", "id long, name string", "id", 16)
    n = 200_000
    store.replace(spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias("name")))

    def scanned(frame):
        rows = frame.collect()
        leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
        return len(rows), sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))

    found, read = scanned(store.multi_get([7]))
    assert found == 1 and read < n / 100
    near = list(range(50_000, 51_000))
    found, read = scanned(store.multi_get(near))
    assert found == 1000 and read < n / 10
    monkeypatch.setattr(S, "KEYS_AS_VALUES", 10)
    assert sorted(r.id for r in store.multi_get([*near, -5]).collect()) == near


def words(texts):
    made = texts.select("id", F.array(F.size(F.split("text", " ")).cast("float")).alias("vec"))
    return made.where("text <> ''")


def test_backfill_resumes_and_repeats_nothing(spark, tmp_path):
    store = S.backfill_store(spark, f"file://{tmp_path}/b", buckets=4)
    texts = spark.createDataFrame([(f"t{i}", " ".join("w" * (i % 5))) for i in range(40)] + [("none", None)], "id string, text string")
    calls = []

    def encode(some):
        calls.append(sorted(r.id for r in some.select("id").collect()))
        return words(some)

    first = S.backfill(texts, store, encode, "m1", batches=4, stop_after=2)
    assert len(first) == 2 and S.pending(texts, store, "m1").count() == 41 - sum(first)
    rest = S.backfill(texts, S.Store(spark, store.folder), encode, "m1", batches=4)
    assert sum(first) + sum(rest) == 41 and len({i for c in calls for i in c}) == sum(map(len, calls)) == 41
    version = store.manifest()["version"]
    assert S.backfill(texts, store, encode, "m1") == [] and store.manifest()["version"] == version
    changed = texts.withColumn("text", F.when(F.col("id") == "t7", "a b c").otherwise(F.col("text")))
    assert {r.id: r.vec for r in S.with_backfilled(changed, store, "m1").collect()}["t7"] is None
    assert S.backfill(changed, store, encode, "m1") == [1] and calls[-1] == ["t7"]
    got = {r.id: r.vec for r in S.with_backfilled(changed, store, "m1").collect()}
    assert got["t7"] == [3.0] and got["t0"] is None and got["none"] is None and got["t3"] == [3.0] and len(got) == 41
    assert sum(S.backfill(texts, store, encode, "m2")) == 41 and store.read().where("model = 'm1'").count() == 0
