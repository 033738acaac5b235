"""The queries of this subpackage for __spark_entry__.py: opN_<name> on whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import table
from leafmill.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.html_extract import html_extract

    return html_extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "base")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from leafmill.llm.byte_bpe import digests, load_ranks

    return digests(table(spark, sf_dir, "documents"), load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.line_dedup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.common import map_columns
    from leafmill.llm.secret_scan import KINDS, joined, secret_scan, sha256

    def digest(ids, spans):
        base = [[x for x in row if x["kind"] != "guess"] for row in spans]
        counts = [[sum(x["kind"] == k for x in row) for row in spans] for k in KINDS]
        return ids, *counts[:3], [sha256(joined(row)) for row in base], [joined(row) for row in spans], counts[3]

    found = secret_scan(table(spark, sf_dir, "documents"))
    return map_columns(found, digest, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_guess bigint")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.substring_dedup import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.topk_search import topk_search

    vectors = table(spark, sf_dir, "embeddings")
    return topk_search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.quality_classifier import quality_classifier

    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.vector_codes import books_sha256, vector_codes

    out, books = vector_codes(table(spark, sf_dir, "embeddings"))
    code = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from leafmill.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.centroids import centroid_clusters, centroid_sha256

    out, centroids = centroid_clusters(table(spark, sf_dir, "embeddings"))
    digests = F.array(*(F.lit(centroid_sha256(c)) for c in centroids)) if len(centroids) else F.array(F.lit(None).cast("string"))
    return out.withColumn("centroid_sha256", digests[F.col("cluster")])


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_substring_dedup, op3_topk_search, op4_html_extract, op5_mix_sources, op6_byte_bpe, op7_ngram_join, op8_quality_rules, op9_quality_classifier, op10_line_dedup, op11_vector_codes, op12_best_fit_packing, op13_centroid_clusters)}
