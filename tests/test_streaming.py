from pyspark.sql import functions as F

from leafmill.streaming import sync


def test_upserts_are_idempotent_and_keep_the_latest(spark, tmp_path):
    schema, snapshots = "id string, at timestamp, v int", []
    src = str(tmp_path / "in")
    rows = lambda x: spark.createDataFrame(x, "id string, at string, v int").withColumn("at", F.to_timestamp("at"))

    def save(df, n):
        path = str(tmp_path / f"out-{len(snapshots)}")
        df.write.parquet(path)
        snapshots.append(path)

    load = lambda: spark.read.schema(schema).parquet(snapshots[-1]) if snapshots else None
    rows([("a", "2024-01-01", 1), ("a", "2024-01-02", 2), ("b", "2024-01-01", 1)]).write.mode("append").parquet(src)
    sync.upsert_stream(sync.file_stream(spark, src, schema), "id", "at", load, save, str(tmp_path / "cp")).awaitTermination()
    rows([("a", "2024-01-01", 9), ("b", "2024-01-03", 3), ("c", "2024-01-01", 4)]).write.mode("append").parquet(src)
    sync.upsert_stream(sync.file_stream(spark, src, schema), "id", "at", load, save, str(tmp_path / "cp")).awaitTermination()
    assert {r.id: r.v for r in load().collect()} == {"a": 2, "b": 3, "c": 4}


def test_audit_without_repeats_and_windows(spark, tmp_path):
    src = str(tmp_path / "events")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(50).union(spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(50)).write.parquet(src)
    stream = sync.file_stream(spark, src, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    sync.append_stream(sync.audit_stream(stream, "event_id", "ts"), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 50
    batch = spark.read.parquet(src)
    assert sync.activity(batch, "ts", "event_type").agg(F.sum("n")).first()[0] == 100
