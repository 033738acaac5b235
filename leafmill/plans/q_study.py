"""Queries of the studies and of matching by volumes. Documents stand for volumes of one chunk and without segments, sources for works."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill import schemas
from leafmill.operators import matching as X
from leafmill.operators import study as Y
from leafmill.plans.registry import query


def t(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query(
    "a07_summary",
    """WITH v AS (SELECT l_returnflag, l_quantity AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS c FROM lineitem WHERE l_quantity IS NOT NULL)
SELECT l_returnflag, count(*) AS n, round(avg(v), 6) AS mean, median(v) AS median, min(v) AS least, max(v) AS most, max(CASE WHEN k = CAST(floor(c * 0.1) AS BIGINT) THEN v END) AS p10, max(CASE WHEN k = least(CAST(floor(c * 0.95) AS BIGINT), c - 1) THEN v END) AS p95 FROM v GROUP BY 1""",
)
def summary(spark, d):
    return Y.summary(t(spark, d, "lineitem"), "l_quantity", ["l_returnflag"]).withColumn("mean", F.round("mean", 6))


@query("a08_strengths", "SELECT l_linestatus, count(*) FILTER (l_discount * 10 >= 0.5) AS strong, count(*) FILTER (l_discount * 10 >= 0.2 AND l_discount * 10 < 0.5) AS partial, count(*) FILTER (l_discount * 10 < 0.2) AS weak FROM lineitem GROUP BY 1")
def strengths(spark, d):
    return Y.strengths(t(spark, d, "lineitem").withColumn("score", F.col("l_discount") * 10), "score", ["l_linestatus"])


def pairs_sql(table: str, group: str, id: str) -> str:
    return f"""one AS (SELECT DISTINCT {group} AS g, {id} AS id FROM {table} WHERE {group} IS NOT NULL AND {id} IS NOT NULL),
held AS (SELECT g, id FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY md5('42:' || id), id) AS r FROM one) WHERE r <= 60),
every AS (SELECT x.g, x.id AS a, y.id AS b FROM held x JOIN held y ON x.g = y.g AND x.id < y.id),
pr AS (SELECT g, a, b FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY md5('42:' || a || ':' || b), a, b) AS r FROM every) WHERE r <= 30)"""


@query("j07_group_pairs", f"WITH {pairs_sql('customer', 'c_nationkey', 'c_custkey')} SELECT g AS \"group\", a, b FROM pr")
def group_pairs(spark, d):
    return Y.group_pairs(t(spark, d, "customer").select(F.col("c_nationkey").alias("group"), F.col("c_custkey").alias("id")))


@query("j05_ground_truth", "SELECT CAST(l.doc_id AS VARCHAR) AS mw_id, CAST(quality AS VARCHAR) AS d_id, CAST(toxic AS VARCHAR) AS rkts_id, coalesce(text, '') AS text_bo, source AS wa_id_orig, CAST(NULL AS VARCHAR) AS title_bo, lang AS etext_source, CAST(n_chars AS INT) AS text_length FROM labels l JOIN documents USING (doc_id)")
def ground_truth(spark, d):
    truth = t(spark, d, "labels").select(F.col("doc_id").cast("string").alias("mw_id"), F.col("quality").cast("string").alias("d_id"), F.col("toxic").cast("string").alias("rkts_id"))
    texts = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("mw_id"), F.col("text").alias("text_bo"), F.col("source").alias("wa_id_orig"), F.lit(None).cast("string").alias("title_bo"), F.col("lang").alias("etext_source"), F.col("n_chars").cast("int").alias("text_length"))
    return Y.ground_truth_corpus(truth, texts)


@query("j18_titled", "SELECT source AS d_id, doc_id AS mw_id FROM documents WHERE lang = 'en' AND source IN (SELECT source FROM documents WHERE lang = 'de')")
def titled(spark, d):
    docs = t(spark, d, "documents")
    truth = docs.where("lang = 'de'").select(F.col("source").alias("d_id"))
    return Y.titled(docs.select(F.col("doc_id").alias("mw_id"), F.col("source").alias("title_bo"), F.col("lang").alias("etext_source")), truth, "en")


BASELINE_SQL = rf"""WITH {pairs_sql('documents', 'source', 'doc_id')}, dw AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[་།\s]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT doc_id, lang, s.size AS size, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(0, greatest(len(w) - s.size, 0) + 1), lambda i: array_to_string(list_slice(w, i + 1, i + s.size), '_'))) END AS items FROM dw, (SELECT unnest([1, 2, 3]) AS size) s),
j AS (SELECT pr.a, pr.b, x.size, least(x.lang, y.lang) || '-' || greatest(x.lang, y.lang) AS kind, len(list_intersect(x.items, y.items)) AS c, len(x.items) + len(y.items) AS t FROM pr JOIN sh x ON x.doc_id = a JOIN sh y ON y.doc_id = b AND y.size = x.size),
v AS (SELECT kind, size, CASE WHEN t > 0 THEN c / (t - c) ELSE 0.0 END AS v FROM j UNION ALL SELECT 'all', size, CASE WHEN t > 0 THEN c / (t - c) ELSE 0.0 END FROM j),
k AS (SELECT *, row_number() OVER (PARTITION BY kind, size ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY kind, size) AS n FROM v)
SELECT kind, CAST(size AS INT) AS size, count(*) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(min(v), 6) AS least, round(max(v), 6) AS most, round(max(CASE WHEN k = CAST(floor(n * 0.1) AS BIGINT) THEN v END), 6) AS p10, CAST(floor(min(v) * 512) AS BIGINT) AS msm_least, CAST(floor(max(CASE WHEN k = CAST(floor(n * 0.1) AS BIGINT) THEN v END) * 512) AS BIGINT) AS msm_p10 FROM k GROUP BY 1, 2"""


@query("e10_baseline", BASELINE_SQL)
def baseline(spark, d):
    docs = t(spark, d, "documents")
    pairs = Y.group_pairs(docs.select(F.col("source").alias("group"), F.col("doc_id").alias("id")))
    found = Y.baseline(Y.pair_jaccard(pairs, docs.select("doc_id", "text", F.col("lang").alias("source")), [1, 2, 3]))
    return found.select("kind", "size", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "least", "most", "p10")), "msm_least", "msm_p10")


@query(
    "e09_compared",
    """WITH l AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS dst FROM lineitem WHERE l_returnflag = 'N'), r AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS dst FROM lineitem WHERE l_linestatus = 'O'),
m AS (SELECT id, count(*) FILTER (l.dst IS NOT NULL) AS nl, count(*) FILTER (r.dst IS NOT NULL) AS nr, count(*) FILTER (l.dst IS NOT NULL AND r.dst IS NOT NULL) AS c, count(*) AS n FROM l FULL JOIN r USING (id, dst) GROUP BY 1)
SELECT o_orderkey AS id, coalesce(nl, 0) AS "left", coalesce(nr, 0) AS "right", coalesce(c, 0) AS common, round(c / n, 6) AS overlap FROM orders LEFT JOIN m ON o_orderkey = id""",
)
def compared(spark, d):
    side = lambda condition: t(spark, d, "lineitem").where(condition).select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    asked = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return Y.compared(asked, side("l_returnflag = 'N'"), side("l_linestatus = 'O'")).withColumn("overlap", F.round("overlap", 6))


def volumes(spark, d) -> DataFrame:
    n = F.length("text").cast("int")
    chunk = F.struct(F.lit(0).alias("cstart"), n.alias("cend"), F.col("text").alias("text_bo"))
    docs = t(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("wa_id"), F.lit(None).cast("string").alias("mw_id"), F.array(chunk).alias("chunks"), F.lit(None).cast(f"array<{schemas.SEGMENT}>").alias("segments"))


def matched_sql(asked: str) -> str:
    """hits of samples of asked (query, own, t) in documents, as vs (query, own, doc_id, score)."""
    return rf"""dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[་།\s]+'), lambda x: x <> '') AS w FROM documents), ds AS (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS s FROM dw WHERE len(w) > 0),
sm AS ({asked}), sp AS (SELECT query, own, 'beginning' AS sample, 1.2 AS boost, substr(t, 1, 200) AS p FROM sm WHERE length(t) > 0 UNION ALL SELECT query, own, 'middle', 1.0, substr(t, CAST((length(t) - 200) // 2 AS INT) + 1, 200) FROM sm WHERE length(t) > 400 UNION ALL SELECT query, own, 'end', 1.0, substr(t, CAST(length(t) - 200 AS INT) + 1, 200) FROM sm WHERE length(t) > 200),
qw AS (SELECT query, own, sample, boost, list_filter(regexp_split_to_array(lower(p), '[་།\s]+'), lambda x: x <> '') AS w FROM sp), hit AS (SELECT query, own, sample, boost, doc_id FROM qw JOIN ds ON doc_id <> own AND contains(s, ' ' || array_to_string(qw.w, ' ') || ' ')),
tf AS (SELECT tok, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(w) AS tok FROM dw) GROUP BY 1), tt AS (SELECT count(*) AS total FROM ds),
ws AS (SELECT query, sample, sum(ln(1 + (total - n + 0.5) / (n + 0.5))) AS score FROM (SELECT query, sample, unnest(w) AS tok FROM qw) JOIN tf USING (tok), tt GROUP BY 1, 2),
vs AS (SELECT query, own, doc_id, round(sum(score * boost), 9) AS score FROM hit JOIN ws USING (query, sample) GROUP BY 1, 2, 3)"""


TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(
    "ft12_by_reference",
    f"""WITH {matched_sql(f"SELECT doc_id AS query, doc_id AS own, {TRIM.format('substr(text, 1, 400)')} AS t FROM (SELECT DISTINCT doc_id FROM labels) JOIN documents USING (doc_id)")},
wa AS (SELECT query, source AS wa_id, max(score) AS score, count(DISTINCT vs.doc_id) AS volumes FROM vs JOIN documents USING (doc_id) WHERE coalesce(source, '') <> '' GROUP BY 1, 2)
SELECT query, CAST(rank AS INT) AS rank, wa_id, round(score, 6) AS score, volumes FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, wa_id) AS rank FROM wa) WHERE rank <= 20""",
)
def by_reference(spark, d):
    refs = t(spark, d, "labels").select(F.col("doc_id").alias("query"), F.col("doc_id").cast("string").alias("volume_id"), F.lit(0).alias("cstart"), F.lit(400).alias("cend")).distinct()
    found = X.find_by_reference(refs, volumes(spark, d))
    return found.select("query", "rank", "wa_id", F.round("score", 6).alias("score"), F.size("volumes").cast("long").alias("volumes"))


@query(
    "ft13_segment_duplicates",
    f"""WITH {matched_sql(f"SELECT doc_id AS query, doc_id AS own, {TRIM.format('text')} AS t FROM documents WHERE text IS NOT NULL")},
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank FROM vs) WHERE rank <= 10 AND score >= 5.0)
SELECT CAST(query AS VARCHAR) AS volume_id, 0 AS segment_idx, x.source AS source_wa, CAST(best.doc_id AS VARCHAR) AS match_volume, y.source AS match_wa, round(score, 3) AS score, CASE WHEN x.source = y.source THEN 'confirm_duplicate' ELSE 'propose_merge' END AS classification FROM best JOIN documents x ON x.doc_id = query JOIN documents y ON y.doc_id = best.doc_id""",
)
def segment_duplicates(spark, d):
    return X.segment_duplicates(volumes(spark, d)).drop("mw_id", "title")
