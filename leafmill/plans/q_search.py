"""Search and matching queries. Benchmark passages are the texts looked up, documents the volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators import matching as X
from leafmill.operators import search as S
from leafmill.plans.registry import query


def t(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Phrases: the first eight words of each passage.
SEARCH_SQL = r"""dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[་།\s]+'), lambda x: x <> '') AS w FROM documents),
ds AS (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS s FROM dw WHERE len(w) > 0), qw AS (SELECT item_id, list_slice(list_filter(regexp_split_to_array(lower(text), '[་།\s]+'), lambda x: x <> ''), 1, 8) AS w FROM benchmark),
hit AS (SELECT item_id, doc_id FROM qw JOIN ds ON contains(s, ' ' || array_to_string(qw.w, ' ') || ' ')),
tf AS (SELECT tok, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(w) AS tok FROM dw) GROUP BY 1), tt AS (SELECT count(*) AS total FROM ds),
ws AS (SELECT item_id, sum(ln(1 + (total - n + 0.5) / (n + 0.5))) AS score FROM (SELECT item_id, unnest(w) AS tok FROM qw) JOIN tf USING (tok), tt GROUP BY 1)"""


def phrases(spark, d, slop=0) -> DataFrame:
    first = F.array_join(F.slice(F.filter(F.split(F.lower("text"), r"[་།\s]+"), lambda x: x != ""), 1, 8), " ")
    return S.phrase_words(t(spark, d, "benchmark").select("item_id", F.lit(slop).alias("slop"), first.alias("phrase")))


def posts(spark, d) -> DataFrame:
    return S.texts(t(spark, d, "documents"), "doc_id", ["text"])


@query("ft02_phrase", f"WITH {SEARCH_SQL} SELECT item_id, doc_id AS id FROM hit")
def phrase(spark, d):
    return S.phrase_hits(posts(spark, d), phrases(spark, d), ["item_id"]).select("item_id", "id")


@query("ft02_sloppy_phrase", r"""WITH dt AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS token FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[་།\s]+'), lambda x: x <> '') AS w FROM documents)),
qt AS (SELECT item_id, unnest(range(len(w))) AS qpos, unnest(w) AS token, len(w) AS n FROM (SELECT item_id, list_slice(list_filter(regexp_split_to_array(lower(text), '[་།\s]+'), lambda x: x <> ''), 1, 8) AS w FROM benchmark)),
nr AS (SELECT item_id, doc_id, n, qpos, pos - qpos AS o FROM dt JOIN qt USING (token)), st AS (SELECT DISTINCT item_id, doc_id, n, o FROM nr),
ok AS (SELECT st.item_id, st.doc_id, st.o, st.n, count(DISTINCT qpos) AS f FROM st JOIN nr ON nr.item_id = st.item_id AND nr.doc_id = st.doc_id AND nr.o BETWEEN st.o AND st.o + 2 GROUP BY 1, 2, 3, 4)
SELECT DISTINCT item_id, doc_id AS id FROM ok WHERE f = n""")
def sloppy_phrase(spark, d):
    return S.phrase_hits(posts(spark, d), phrases(spark, d, 2), ["item_id"]).select("item_id", "id")


@query("ft09_idf_topk", f"""WITH {SEARCH_SQL} SELECT item_id, CAST(rank AS INT) AS rank, id, round(score, 6) AS score FROM (SELECT item_id, doc_id AS id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM hit JOIN ws USING (item_id)) WHERE rank <= 5""")
def idf_topk(spark, d):
    from leafmill.operators.dedup import top_k

    hits = S.scored_hits(posts(spark, d), phrases(spark, d), ["item_id"])
    return top_k(hits, "item_id", F.col("score"), "id", 5).select("item_id", "rank", "id", F.round("score", 6).alias("score"))


# clauses: the whole phrase in the label and in the segment, and its three cuts in two in the label
PART_WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[་།\s]+'), lambda x: x <> '')"


@query(
    "ft03_best_clause",
    f"""WITH p AS (SELECT p_partkey AS id, {PART_WORDS.format("p_name")} AS l, {PART_WORDS.format("concat_ws(' ', p_type, p_brand, p_name)")} AS s FROM part),
tk AS (SELECT id, 'l' AS f, unnest(l) AS t FROM p UNION ALL SELECT id, 's', unnest(s) FROM p), tt AS (SELECT f, count(DISTINCT id) AS total FROM tk GROUP BY 1),
w AS (SELECT f, t, ln(1 + (total - n + 0.5) / (n + 0.5)) AS w FROM (SELECT f, t, count(DISTINCT id) AS n FROM tk GROUP BY 1, 2) JOIN tt USING (f)),
c AS (SELECT * FROM (VALUES (0, 0, 1, 'l', 1.1, 'economy brand#2 small ring'), (1, 0, 1, 's', 0.9, 'economy brand#2 small ring'), (2, 0, 2, 'l', 0.2, 'economy brand#2'), (2, 1, 2, 'l', 0.2, 'small ring'),
 (3, 0, 2, 'l', 0.2, 'economy'), (3, 1, 2, 'l', 0.2, 'brand#2 small ring'), (4, 0, 2, 'l', 0.2, 'economy brand#2 small'), (4, 1, 2, 'l', 0.2, 'ring')) v(k, part, parts, f, boost, ph)),
v AS (SELECT k, part, sum(w) AS score FROM (SELECT k, part, f, unnest(string_split(ph, ' ')) AS t FROM c) JOIN w USING (f, t) GROUP BY 1, 2),
h AS (SELECT id, k, parts, boost, score FROM p JOIN c ON contains(' ' || array_to_string(CASE c.f WHEN 'l' THEN l ELSE s END, ' ') || ' ', ' ' || ph || ' ') JOIN v USING (k, part)),
b AS (SELECT id, k, any_value(boost)::DOUBLE * sum(score) AS score FROM h GROUP BY id, k HAVING count(*) = any_value(parts))
SELECT id, round(score, 6) AS score FROM (SELECT id, max(score) AS score FROM b GROUP BY id ORDER BY 2 DESC, id LIMIT 20)""",
)
def best_clause(spark, d):
    part = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("label"), F.concat_ws(" ", "p_type", "p_brand", "p_name").alias("segment"))
    text = "economy brand#2 small ring"
    by_scope = {"top": S.texts(part, "p_partkey", ["label"]), "segments": S.texts(part, "p_partkey", ["segment"])}
    return S.search(spark, by_scope, S.plan(text, text.split(), " "), {"segment": 0.9}).select("id", F.round("score", 6).alias("score"))


FIND_SQL = r"""dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[་།\s]+'), lambda x: x <> '') AS w FROM documents), ds AS (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS s FROM dw WHERE len(w) > 0),
sm AS (SELECT item_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM benchmark), sp AS (SELECT item_id, 'beginning' AS sample, 1.2 AS boost, substr(t, 1, 200) AS p FROM sm WHERE length(t) > 0 UNION ALL SELECT item_id, 'middle', 1.0, substr(t, CAST((length(t) - 200) // 2 AS INT) + 1, 200) FROM sm WHERE length(t) > 400 UNION ALL SELECT item_id, 'end', 1.0, substr(t, CAST(length(t) - 200 AS INT) + 1, 200) FROM sm WHERE length(t) > 200),
qw AS (SELECT item_id, sample, boost, list_filter(regexp_split_to_array(lower(p), '[་།\s]+'), lambda x: x <> '') AS w FROM sp), hit AS (SELECT item_id, sample, boost, doc_id FROM qw JOIN ds ON contains(s, ' ' || array_to_string(qw.w, ' ') || ' ')),
tf AS (SELECT tok, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(w) AS tok FROM dw) GROUP BY 1), tt AS (SELECT count(*) AS total FROM ds),
ws AS (SELECT item_id, sample, sum(ln(1 + (total - n + 0.5) / (n + 0.5))) AS score FROM (SELECT item_id, sample, unnest(w) AS tok FROM qw) JOIN tf USING (tok), tt GROUP BY 1, 2),
vs AS (SELECT item_id, doc_id, sum(score * boost) AS score FROM hit JOIN ws USING (item_id, sample) GROUP BY 1, 2),
wa AS (SELECT vs.item_id, source AS wa_id, max(score) AS score, count(DISTINCT vs.doc_id) AS volumes FROM vs JOIN documents USING (doc_id) WHERE source IS NOT NULL GROUP BY 1, 2)"""


def volume_scores(spark, d) -> DataFrame:
    p = posts(spark, d)
    chunks = p.select(F.struct(F.col("id").alias("volume_id"), F.lit(0).alias("n")).alias("id"), "field", "w")
    return X.volume_scores(t(spark, d, "benchmark"), "item_id", "text", chunks)


@query("ft11_volume_scores", f"WITH {FIND_SQL} SELECT item_id AS query, doc_id AS volume_id, round(score, 6) AS score FROM vs")
def scores(spark, d):
    return volume_scores(spark, d).select("query", "volume_id", F.round("score", 6).alias("score"))


@query("ft11_find_work", f"WITH {FIND_SQL} SELECT item_id AS query, CAST(rank AS INT) AS rank, wa_id, round(score, 6) AS score, volumes FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, wa_id) AS rank FROM wa) WHERE rank <= 20")
def find_work(spark, d):
    segments = t(spark, d, "documents").select(F.col("doc_id").alias("volume_id"), F.col("source").alias("wa_id"), F.lit(None).cast("string").alias("title"))
    found = X.candidates(volume_scores(spark, d).withColumn("score", F.round("score", 9)), segments)
    return found.select("query", "rank", "wa_id", F.round("score", 6).alias("score"), F.size("volumes").cast("long").alias("volumes"))


@query("ft13_dedup_batch", f"WITH {FIND_SQL} SELECT item_id AS query, doc_id AS volume_id, round(vs.score, 6) AS score, source AS match_wa, CASE WHEN 'src' || (item_id % 20) = source THEN 'confirm_duplicate' ELSE 'propose_merge' END AS classification FROM vs JOIN documents USING (doc_id) WHERE round(vs.score, 6) >= 5.0")
def dedup_batch(spark, d):
    own = t(spark, d, "documents").select(F.col("doc_id").alias("volume_id"), F.col("source").alias("match_wa"))
    matches = volume_scores(spark, d).withColumn("score", F.round("score", 6)).join(own, "volume_id")
    matches = matches.withColumn("source_wa", F.concat(F.lit("src"), (F.col("query") % 20).cast("string")))
    return X.classified(matches).select("query", "volume_id", "score", "match_wa", "classification")
