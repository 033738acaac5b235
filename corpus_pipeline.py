"""A training-data pipeline over documents: quality classifier, line dedup, near-duplicate join, source mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of
documents. No stage shuffles whole texts unless its list of decisions is too large to broadcast.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.byte_bpe import encode, load_ranks
from leafmill.llm.common import driver_gives_back, staged, table
from leafmill.llm.line_dedup import line_dedup
from leafmill.llm.mixing import mixture
from leafmill.llm.ngram_join import one_of_each_group
from leafmill.llm.quality_classifier import good_documents

TOKENIZER = "byte_bpe_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels outside the held-out fold, predicts good. A null text is judged as an
    empty one; repeated rows are judged alike; other columns pass; empty tables give empty results."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand on more than a tenth of their source's pages. Equal pages count once here, as copies
    are the next stage's concern. Null texts stay null; repeated rows and other columns pass; empty tables give empty results."""
    return line_dedup(docs, copies_once=True).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles: the one with the least
    doc_id. Documents without words are no group's and stay. Rows of one doc_id and equal text stay once; where a doc_id has
    several texts, each is judged by itself, and of those of one group the first by code point stays, as it is the case for a
    group without doc_ids. Empty tables give empty results; other columns are carried along."""
    return one_of_each_group(docs, n=5, num=80, den=100).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them: whole ones, so a source misses its target by the documents of one
    boundary cell (2**-24 of its hashes) at most. Rows without words are not taken; a null source is a source of its own;
    repeated rows are documents of their own; other columns pass; empty tables give empty results."""
    return mixture(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every row. A null or empty text has no ids; repeated rows are encoded one by one; empty tables give
    empty results."""
    out = encode(docs, load_ranks(public_tokenizers.path(TOKENIZER)), public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("mixing", mixed), ("byte-level BPE", encoded)]

#: The classifier is a fitted model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        driver_gives_back(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
