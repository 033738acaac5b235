"""Queries of the versioned store: documents' rows as records, labels as changes, lookups and backfill of a derived column."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.plans.registry import query
from leafmill.sources import store as S
from leafmill.staging import shared_dir


def t(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


RECORDS = "doc_id long, lang string, source string, n_chars long"


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/leafmill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def records(spark, d) -> S.Store:
    store = S.Store.create(spark, folder(spark, "records"), RECORDS, "doc_id", 32)
    store.replace(t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"))
    return store


@query(
    "k03_store_changes",
    """WITH u AS (SELECT doc_id, CAST(NULL AS VARCHAR) AS lang, 'low' AS source, CAST(toxic AS BIGINT) AS n_chars FROM labels WHERE quality = 0),
a AS (SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM u) UNION ALL SELECT * FROM u)
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN NULL ELSE lang END AS lang, source, n_chars FROM a WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def store_changes(spark, d):
    """A full load, an upsert of whole rows, an update that sets one field to null, a compaction and a deletion, read as one table."""
    store, labels = records(spark, d), t(spark, d, "labels")
    store.upsert(labels.where("quality = 0").select("doc_id", F.lit(None).cast("string").alias("lang"), F.lit("low").alias("source"), F.col("toxic").cast("long").alias("n_chars")))
    store.patch(labels.where("quality = 1").select("doc_id", F.array(F.lit("lang")).alias("given"), F.lit(None).cast("string").alias("lang")), ["lang"])
    store.compact()
    store.delete(labels.where("toxic = 1").select("doc_id"))
    return store.read()


@query("s11_multi_get", "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def multi_get(spark, d):
    """The records that labels of low quality name."""
    return records(spark, d).multi_get(t(spark, d, "labels").where("quality = 0").select("doc_id"))


@query("e13_backfill", r"""SELECT doc_id AS id, CAST(length(coalesce(text, '')) AS BIGINT) AS chars, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[་།\s]+'), lambda x: x <> '')) AS BIGINT) AS words FROM documents""")
def backfilled(spark, d):
    """Sizes of all texts as a derived column: a run that ends after one of two batches, one that does the rest, and one with nothing to do."""
    texts = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    store = S.backfill_store(spark, folder(spark, "sizes"), "long", "chars long, words long", 32)

    def sizes(some: DataFrame) -> DataFrame:
        return some.select("id", F.length("text").cast("long").alias("chars"), F.size(T.words(F.col("text"))).cast("long").alias("words"))

    for stop in (1, None, None):
        S.backfill(texts, store, sizes, "sizes", batches=2, stop_after=stop)
    return S.with_backfilled(texts, store, "sizes").select("id", "chars", "words")
