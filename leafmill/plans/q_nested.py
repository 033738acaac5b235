"""Queries of analyzers, nested search and highlights. Benchmark passages are phrases; lines of documents are nested elements of a
document, or chunks of documents that are children of their source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators import analysis as A
from leafmill.operators import nested as N
from leafmill.plans.registry import query
from leafmill.staging import spread, staged


def t(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


WORDS = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[་།\s]+'), lambda x: x <> '')"

#: Words that stand for each other in ft01_analyzed.
SYNONYMS = ([("in", "the"), ("inthe",)], [("is",), ("was",), ("are",)])
#: How its phrases differ from the passages: each word by another of its group.
OTHER = {"is": "was", "was": "are", "are": "is"}


def phrases(spark, d, text=None, analyzer="words") -> DataFrame:
    table = t(spark, d, "benchmark").select("item_id", F.lit(0).alias("slop"), (F.col("text") if text is None else text).alias("phrase"))
    return staged(A.graph_phrases(table, "phrase", analyzer), "phrases")


@query(
    "ft01_analyzed",
    rf"""WITH dw AS (SELECT doc_id, ' ' || array_to_string(list_transform({WORDS.format("text")}, lambda x: CASE WHEN x IN ('was', 'are') THEN 'is' ELSE x END), ' ') || ' ' AS s FROM documents),
qw AS (SELECT item_id, ' ' || array_to_string(list_transform({WORDS.format("text")}, lambda x: CASE WHEN x IN ('was', 'are') THEN 'is' ELSE x END), ' ') || ' ' AS p FROM benchmark)
SELECT item_id, doc_id AS id FROM qw JOIN dw ON contains(s, p) WHERE length(p) > 2""",
)
def analyzed(spark, d):
    """Passages with other words of equal meaning, some of which are two words in the documents."""
    other = lambda x: F.coalesce(*(F.when(x == own, new) for own, new in OTHER.items()), x)
    words = F.transform(F.filter(F.split(F.lower("text"), r"[་།\s]+"), lambda x: x != ""), other)
    text = F.replace(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(" in the "), F.lit(" inthe "))
    analyzer = A.ANALYZERS["words"].with_synonyms(*SYNONYMS)
    docs = spread(t(spark, d, "documents").select("doc_id", "text"))
    return A.text_hits(docs, ["doc_id"], "text", analyzer, phrases(spark, d, text, analyzer), ["item_id"]).select("item_id", F.col("doc_id").alias("id"))


LINES_SQL = rf"""el AS (SELECT doc_id, source, unnest(range(len(l))) AS element, unnest(l) AS line FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
ew AS (SELECT doc_id, source, element, w, ' ' || array_to_string(w, ' ') || ' ' AS s FROM (SELECT doc_id, source, element, {WORDS.format("line")} AS w FROM el) WHERE len(w) > 0),
qw AS (SELECT item_id, {WORDS.format("text")} AS w FROM benchmark), hit AS (SELECT item_id, doc_id, source, element FROM qw JOIN ew ON contains(s, ' ' || array_to_string(qw.w, ' ') || ' ') WHERE len(qw.w) > 0)"""


def blocks(spark, d, parent: str, child: str | None) -> DataFrame:
    docs = spread(t(spark, d, "documents").select("doc_id", "source", "text"))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.struct(x.alias("line")))
    return N.block_texts(docs.withColumn("chunks", lines), parent, ["line"], nested="chunks", child=child)


@query(
    "j19_nested_hits",
    f"""WITH {LINES_SQL}, tf AS (SELECT tok, count(*) AS n FROM (SELECT DISTINCT doc_id, element, unnest(w) AS tok FROM ew) GROUP BY 1), tt AS (SELECT count(*) AS total FROM ew),
ws AS (SELECT item_id, sum(ln(1 + (total - n + 0.5) / (n + 0.5))) AS score FROM (SELECT item_id, unnest(w) AS tok FROM qw) JOIN tf USING (tok), tt GROUP BY 1),
rk AS (SELECT item_id, doc_id, element, score, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY score DESC, element) AS rank FROM hit JOIN ws USING (item_id))
SELECT item_id, doc_id, CAST(element AS INT) AS element, CAST(rank AS INT) AS rank, round(score, 6) AS score, round(max(score) OVER (PARTITION BY item_id, doc_id), 6) AS best FROM rk WHERE rank <= 3""",
)
def nested_hits(spark, d):
    """Passages inside one line of a document, never across two: the document's score is its best line's, and its three best lines come along."""
    hits = staged(N.search_elements(blocks(spark, d, "doc_id", None), "words", phrases(spark, d), ["item_id"]), "hits")
    best = N.parents_of(hits, ["item_id"]).withColumnRenamed("score", "best")
    inner = N.inner_hits(hits, ["item_id"]).join(best, ["item_id", "parent"])
    return inner.select("item_id", F.col("parent").alias("doc_id"), "element", "rank", F.round("score", 6).alias("score"), F.round("best", 6).alias("best"))


@query(
    "j19_has_child",
    f"""WITH {LINES_SQL}, el2 AS (SELECT *, row_number() OVER (PARTITION BY item_id, source, doc_id ORDER BY element) AS rank FROM hit),
ch AS (SELECT item_id, source, doc_id, row_number() OVER (PARTITION BY item_id, source ORDER BY doc_id) AS child_rank FROM el2 WHERE rank = 1)
SELECT el2.item_id, el2.source AS parent, el2.doc_id AS child, CAST(child_rank AS INT) AS child_rank, CAST(element AS INT) AS element, CAST(rank AS INT) AS rank FROM el2 JOIN ch ON el2.item_id = ch.item_id AND el2.doc_id = ch.doc_id AND el2.source IS NOT DISTINCT FROM ch.source WHERE rank <= 3 AND child_rank <= 3""",
)
def has_child(spark, d):
    """Sources that have a document with a line that holds a passage; of each, three documents and three lines come along."""
    found = A.text_hits(blocks(spark, d, "source", "doc_id"), N.KEYS, "text", "words", phrases(spark, d), ["item_id"])
    hits = staged(found.withColumn("score", F.lit(1.0)), "hits")
    inner = N.inner_hits(hits, ["item_id"], mode="none")
    return inner.select("item_id", "parent", "child", "child_rank", "element", "rank")


# twice, as passages side by side share the space between them
@query(
    "ft08_highlight",
    rf"""WITH dw AS (SELECT doc_id, text, ' ' || array_to_string({WORDS.format("text")}, ' ') || ' ' AS s FROM documents), qw AS (SELECT item_id, {WORDS.format("text")} AS w FROM benchmark),
hit AS (SELECT item_id, doc_id, text, array_to_string(list_transform(w, lambda x: regexp_escape(x)), '[་།\s]+') AS p FROM qw JOIN dw ON contains(s, ' ' || array_to_string(w, ' ') || ' ') WHERE len(w) > 0)
SELECT item_id, doc_id, regexp_replace(regexp_replace(text, '(^|[་།\s])(' || p || ')($|[་།\s])', '\1<em>\2</em>\3', 'gi'), '(^|[་།\s])(' || p || ')($|[་།\s])', '\1<em>\2</em>\3', 'gi') AS highlight FROM hit""",
)
def highlight(spark, d):
    """Documents that hold a passage, with it marked wherever it stands, by offsets into the whole text."""
    docs = spread(t(spark, d, "documents").select("doc_id", "text"))
    hits = A.text_hits(docs, ["doc_id"], "text", "words", phrases(spark, d), ["item_id"])
    return A.highlights(hits, docs, ["doc_id"], "text", ["item_id"])
