"""Incremental work with Structured Streaming: files and records into snapshots, and the audit log without repeats.

The catalog itself is synchronised in batches; these streams do the same work as data arrives, with the stream's own
checkpoint in place of a stored revision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(rows: DataFrame, id: str, at: str) -> DataFrame:
    """One row for each id, the latest; a batch may bring several."""
    order = Window.partitionBy(id).orderBy(F.desc(at), F.md5(F.to_json(F.struct(*rows.columns))))
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def upsert_stream(source: DataFrame, id: str, at: str, load: Callable[[], DataFrame | None], save: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Merges each micro-batch into a snapshot: newer rows replace those of their id, and rows that are not newer are skipped, so a batch
    that is run again changes nothing. load gives the snapshot, save writes the next one, with the batch's number."""

    def merge(batch: DataFrame, number: int) -> None:
        fresh, old = latest(batch, id, at), load()
        if old is not None:
            known = old.select(F.col(id).alias("_i"), F.col(at).alias("_a"))
            newer = fresh.join(known, F.col(id) == F.col("_i"), "left").where(F.col("_i").isNull() | (F.col(at) > F.col("_a"))).select(*fresh.columns)
            fresh = old.join(newer.select(id), id, "left_anti").select(*old.columns).unionByName(newer, allowMissingColumns=True)
        save(fresh, number)

    writer = source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files: int = 5000) -> DataFrame:
    """New files under path, at most `files` a batch."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files).load(path)


def audit_stream(events: DataFrame, id: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Events without repeats of an id that come within delay; state older than that is dropped."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([id])


def activity(events: DataFrame, at: str, by: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """start, by, n: events in windows of event time; late ones count until the watermark has passed their window."""
    counted = events.withWatermark(at, delay).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window")["start"].alias("start"), by, "n")


def append_stream(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
