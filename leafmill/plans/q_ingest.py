"""Ingestion queries. Conversations stand for volumes, their turns for pages and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import ingest as I
from leafmill.operators.joins import outline_segments, overlapping
from leafmill.plans.registry import query


def t(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pages(spark, d) -> DataFrame:
    """Turns as pages; every fifth turn has no known page number, and pages are numbered from 1."""
    rows = t(spark, d, "conversations").where("turn is not null")
    number = F.when(F.col("turn") % 5 != 4, F.col("turn") + 1)
    return rows.select(F.col("conv_id").alias("volume_id"), F.lpad(F.col("turn").cast("string"), 6, "0").alias("name"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"), number.alias("pnum"))


PAGES_SQL = """pg AS (SELECT conv_id AS volume_id, lpad(turn::VARCHAR, 6, '0') AS name, turn, role, coalesce(text, '') AS text, CASE WHEN turn % 5 <> 4 THEN turn + 1 END AS pnum FROM conversations WHERE turn IS NOT NULL),
ap AS (SELECT *, CAST(coalesce(sum(length(text) + 2) OVER w, 0) AS BIGINT) AS cstart FROM pg WHERE pnum IS NULL OR pnum > 1 WINDOW w AS (PARTITION BY volume_id ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aq AS (SELECT *, cstart + length(text) AS cend FROM ap)"""


def assembled(spark, d) -> DataFrame:
    return I.assembled_pages(pages(spark, d), "volume_id", "name", intro=1)


@query("t02_page_assembly", f"WITH {PAGES_SQL} SELECT volume_id, name, pnum, cstart, cend FROM aq")
def page_assembly(spark, d):
    return assembled(spark, d).select("volume_id", "name", "pnum", "cstart", "cend")


@query("a12_volume_texts", f"WITH {PAGES_SQL} SELECT volume_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY cstart, text)) AS text_md5, count(*) AS nb_pages FROM aq GROUP BY 1")
def volume_texts(spark, d):
    return I.volume_texts(assembled(spark, d), "volume_id").select("volume_id", F.md5("text").alias("text_md5"), "nb_pages")


# Segments reach 7 characters into their successor at even turns and 4 at every third, so that overlaps are odd and even.
def segments(spark, d) -> DataFrame:
    over = F.when(F.col("turn") % 2 == 0, 9).when(F.col("turn") % 3 == 0, 6).otherwise(0)
    mw = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("MW"), F.col("volume_id").cast("string"), F.lit("_"), F.col("turn").cast("string")))
    return assembled(spark, d).select("volume_id", F.col("turn").alias("idx"), "cstart", (F.col("cend") + over).alias("cend"), mw.alias("mw_id"))


SEGMENTS_SQL = f"""{PAGES_SQL}, sg AS (SELECT volume_id, turn AS idx, cstart, cend + CASE WHEN turn % 2 = 0 THEN 9 WHEN turn % 3 = 0 THEN 6 ELSE 0 END AS cend, CASE WHEN turn % 4 = 0 THEN 'MW' || volume_id || '_' || turn END AS mw_id FROM aq),
nb AS (SELECT *, lag(cend) OVER w - cstart AS ob, cend - lead(cstart) OVER w AS oa, lead(cstart) OVER w AS nx FROM sg WINDOW w AS (PARTITION BY volume_id ORDER BY idx)),
bd AS (SELECT volume_id, idx, cstart, cend, mw_id, CAST(CASE WHEN ob > 0 THEN cstart + (ob + 1) // 2 ELSE cstart END AS BIGINT) AS cstart_clean, CAST(CASE WHEN oa > 0 THEN nx + oa // 2 ELSE cend END AS BIGINT) AS cend_clean,
CASE WHEN ob > 0 THEN 'shared_page' ELSE 'clean' END AS boundary_start, CASE WHEN oa > 0 THEN 'shared_page' ELSE 'clean' END AS boundary_end FROM nb)"""


@query("w01_clean_boundaries", f"WITH {SEGMENTS_SQL} SELECT volume_id, idx, cstart_clean, cend_clean, boundary_start, boundary_end FROM bd")
def clean_boundaries(spark, d):
    return I.clean_boundaries(segments(spark, d)).select("volume_id", "idx", "cstart_clean", "cend_clean", "boundary_start", "boundary_end")


@query("a09_boundary_counts", f"WITH {SEGMENTS_SQL} SELECT boundary_start, boundary_end, count(*) AS n, round(avg(CASE WHEN mw_id IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS named FROM bd GROUP BY 1, 2")
def boundary_counts(spark, d):
    named = F.round(F.avg(F.col("mw_id").isNotNull().cast("double")), 6)
    return I.clean_boundaries(segments(spark, d)).groupBy("boundary_start", "boundary_end").agg(F.count("*").alias("n"), named.alias("named"))


TEXT_DOCS_SQL = f"""{SEGMENTS_SQL}, vt AS (SELECT volume_id, string_agg(text, chr(10) || chr(10) ORDER BY cstart, text) AS text FROM aq GROUP BY 1),
td AS (SELECT coalesce(mw_id, volume_id || '_S' || idx) AS doc_id, volume_id, idx AS segment_idx, CASE WHEN cend_clean > cstart_clean THEN substr(text, cstart_clean + 1, cend_clean - cstart_clean) ELSE '' END AS text FROM bd JOIN vt USING (volume_id) WHERE cend > cstart),
tk AS (SELECT * FROM td WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 50)"""


def text_docs(spark, d) -> DataFrame:
    vols = I.volume_texts(assembled(spark, d), "volume_id").select("volume_id", F.lit(None).cast("string").alias("volume_mw"), "text")
    return I.text_documents(I.clean_boundaries(segments(spark, d)), vols)


@query("t06_text_documents", f"WITH {TEXT_DOCS_SQL} SELECT doc_id, volume_id, segment_idx, md5(text) AS text_md5, CAST(length(text) AS INT) AS text_length FROM tk")
def text_documents(spark, d):
    return text_docs(spark, d).select("doc_id", "volume_id", "segment_idx", F.md5("text").alias("text_md5"), "text_length")


@query("j04_sync_actions", f"""WITH {TEXT_DOCS_SQL}, ex AS (SELECT doc_id, CASE WHEN segment_idx % 3 = 1 THEN text || '!' ELSE text END AS text, CASE WHEN segment_idx % 2 = 0 THEN 'WA1' END AS w FROM tk WHERE volume_id % 4 <> 0)
SELECT tk.doc_id, CASE WHEN ex.doc_id IS NULL THEN 'insert' WHEN ex.text = tk.text THEN 'skip' ELSE 'update' END AS action, coalesce(w, 'WA9') AS wa_id_orig FROM tk LEFT JOIN ex USING (doc_id)""")
def sync_actions(spark, d):
    docs = text_docs(spark, d)
    changed = F.when(F.col("segment_idx") % 3 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    old = docs.where("volume_id % 4 <> 0").select("doc_id", changed.alias("text"), F.when(F.col("segment_idx") % 2 == 0, "WA1").alias("wa_id_orig"))
    return I.sync_actions(docs.withColumn("wa_id_orig", F.lit("WA9")), old)


@query("j11_span_overlap", f"WITH {PAGES_SQL}, s AS (SELECT volume_id, turn AS span, cstart + 5 AS cstart, cend + 400 AS cend FROM aq WHERE cend > cstart) SELECT s.volume_id, span, name FROM s JOIN aq c ON c.volume_id = s.volume_id AND c.cend > c.cstart AND c.cend > s.cstart AND c.cstart < s.cend AND s.cend > s.cstart")
def span_overlap(spark, d):
    a = assembled(spark, d)
    spans = a.where("cend > cstart").select("volume_id", F.col("turn").alias("span"), (F.col("cstart") + 5).alias("cstart"), (F.col("cend") + 400).alias("cend"))
    return overlapping(spans, a.select("volume_id", "name", F.col("cstart").alias("c_start"), F.col("cend").alias("c_end")), "volume_id").select("volume_id", "span", "name")


@query("f11_span_text", f"""WITH {PAGES_SQL}, vt AS (SELECT volume_id, string_agg(text, chr(10) || chr(10) ORDER BY cstart, text) AS text FROM aq GROUP BY 1) SELECT volume_id, md5(substr(text, 11, 290)) AS span_md5 FROM vt""")
def span_text(spark, d):
    gap = F.when(F.row_number().over(Window.partitionBy("volume_id").orderBy("name")) > 1, I.PAGE_GAP).otherwise("")
    a = assembled(spark, d).withColumn("text", F.concat(gap, "text")).withColumn("cstart", F.col("cend") - F.length("text"))
    chunk = F.array_sort(F.collect_list(F.struct("cstart", "cend", F.col("text").alias("text_bo"))))
    return a.groupBy("volume_id").agg(chunk.alias("chunks")).select("volume_id", F.md5(I.span_text(F.col("chunks"), F.lit(10), F.lit(300))).alias("span_md5"))


@query("w03_milestone_spans", f"""WITH {PAGES_SQL}, l AS (SELECT volume_id, max(cend) AS length FROM aq GROUP BY 1), m AS (SELECT volume_id, CASE WHEN role = 'assistant' THEN 'bop:' ELSE 'D' END || turn AS milestone, cstart AS pos FROM aq)
SELECT m.volume_id, milestone, pos AS cstart, coalesce(lead(pos) OVER (PARTITION BY m.volume_id ORDER BY pos, milestone), length) AS cend FROM m JOIN l ON l.volume_id = m.volume_id WHERE NOT starts_with(milestone, 'bop:')""")
def milestone_spans(spark, d):
    a = assembled(spark, d)
    stones = a.select("volume_id", F.concat(F.when(F.col("role") == "assistant", "bop:").otherwise("D"), F.col("turn").cast("string")).alias("milestone"), F.col("cstart").alias("at"))
    return I.milestone_spans(stones, a.groupBy("volume_id").agg(F.max("cend").alias("length")))


@query("w02_page_ends", f"WITH {PAGES_SQL} SELECT volume_id, n, cstart, coalesce(lead(cstart) OVER (PARTITION BY volume_id ORDER BY n) - 2, max(cend) OVER (PARTITION BY volume_id)) AS cend FROM (SELECT volume_id, turn AS n, cstart, cend FROM aq)")
def page_ends(spark, d):
    a = assembled(spark, d)
    return I.page_ends(a.select("volume_id", F.col("turn").alias("n"), "cstart"), a.groupBy("volume_id").agg(F.max("cend").alias("length"))).select("volume_id", "n", "cstart", "cend")


@query("t14_outline_segments", f"""WITH {PAGES_SQL}, l AS (SELECT volume_id, max(cend) AS e FROM aq GROUP BY 1), p AS (SELECT conv_id AS volume_id, turn AS part, turn + 1 AS page_start, turn + 3 AS page_end, CASE WHEN role = 'user' THEN 'TOC' ELSE 'T' END AS kind FROM conversations),
j AS (SELECT p.volume_id, part, p.page_start, coalesce(s.cstart, 0) AS cstart, coalesce(x.cend, e) AS cend, CASE WHEN kind = 'TOC' THEN 'editorial' ELSE 'text' END AS segment_type FROM p LEFT JOIN aq s ON s.volume_id = p.volume_id AND s.pnum = page_start LEFT JOIN aq x ON x.volume_id = p.volume_id AND x.pnum = page_end LEFT JOIN l ON l.volume_id = p.volume_id)
SELECT volume_id, part, cstart, cend, segment_type, coalesce(lead(cstart) OVER (PARTITION BY volume_id ORDER BY coalesce(page_start, 0), part) < cend, false) AS overlap FROM j""")
def outline(spark, d):
    a = assembled(spark, d)
    parts = t(spark, d, "conversations").select(F.col("conv_id").alias("volume_id"), F.col("turn").alias("part"), (F.col("turn") + 1).alias("page_start"), (F.col("turn") + 3).alias("page_end"), F.when(F.col("role") == "user", "TOC").otherwise("T").alias("kind"))
    out = outline_segments(parts, a.where("pnum is not null").select("volume_id", "pnum", "cstart", "cend"), a.groupBy("volume_id").agg(F.max("cend").alias("cend")))
    return out.select("volume_id", "part", "cstart", "cend", "segment_type", "overlap")


@query("w12_inherited_volume", """WITH r AS (SELECT conv_id AS file, turn AS line, CASE WHEN turn % 3 = 0 THEN 'V' ELSE 'T' END AS type, CASE WHEN turn % 9 <> 3 THEN turn END AS volume FROM conversations),
g AS (SELECT *, max(CASE WHEN type = 'V' THEN line END) OVER (PARTITION BY file ORDER BY line ROWS UNBOUNDED PRECEDING) AS vl FROM r)
SELECT g.file, g.line, v.volume FROM g JOIN r v ON v.file = g.file AND v.line = g.vl WHERE g.type = 'T' AND v.volume IS NOT NULL""")
def inherited_volume(spark, d):
    rows = t(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), F.when(F.col("turn") % 3 == 0, "V").otherwise("T").alias("type"), F.when(F.col("turn") % 9 != 3, F.col("turn")).alias("volume"))
    return I.inherited_volumes(rows).select("file", "line", "volume")


@query("s15_seeded_sample", "SELECT doc_id FROM documents WHERE length(text) >= 200 ORDER BY md5('42:' || doc_id), doc_id LIMIT 50")
def seeded_sample(spark, d):
    return I.sampled(t(spark, d, "documents").withColumn("text_length", F.length("text")), 50, 200).select("doc_id")


@query("f10_text_samples", """WITH s AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 0 THEN md5(substr(t, 1, 200)) END AS beginning, CASE WHEN length(t) > 400 THEN md5(substr(t, CAST((length(t) - 200) // 2 AS INT) + 1, 200)) END AS middle, CASE WHEN length(t) > 200 THEN md5(substr(t, CAST(length(t) - 200 AS INT) + 1, 200)) END AS "end" FROM s""")
def text_samples(spark, d):
    s = t(spark, d, "documents").select("doc_id", T.samples(F.coalesce("text", F.lit(""))).alias("s"))
    return s.select("doc_id", *(F.md5(F.col("s")[k]).alias(k) for k in ("beginning", "middle", "end")))


@query("f12_edit_similarity", """WITH n AS (SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey) SELECT a, b, CAST(levenshtein(a, b) AS INT) AS distance, round(1 - levenshtein(a, b) / ((length(a) + length(b)) / 2), 6) AS similarity, round(least(length(a), length(b)) / greatest(length(a), length(b)), 6) AS length_ratio,
round(len(list_intersect(list_distinct(string_split(a, '')), list_distinct(string_split(b, '')))) / len(list_distinct(list_concat(string_split(a, ''), string_split(b, '')))), 6) AS char_jaccard FROM n""")
def edit_similarity(spark, d):
    n = t(spark, d, "nation")
    left, right = (n.select(F.col("n_nationkey").alias(f"k{x}"), F.col("n_name").alias(x)) for x in "ab")
    s = left.join(right, F.col("ka") < F.col("kb")).select("a", "b", T.edit_similarity(F.col("a"), F.col("b")).alias("s"))
    return s.select("a", "b", F.col("s")["distance"].alias("distance"), *(F.round(F.col("s")[k], 6).alias(k) for k in ("similarity", "length_ratio", "char_jaccard")))


@query("f21_affixes", "SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name, '^(?:small |red |blue |large )', ''), '(?: ring| widget)$', '')) AS core FROM part")
def affixes(spark, d):
    return t(spark, d, "part").select("p_partkey", T.without_affixes(F.col("p_name"), ["red ", "small ", "large ", "blue "], [" ring", " widget"]).alias("core"))


@query("f25_keys", """SELECT o_orderkey, 'W' || o_custkey || '_I' || o_orderkey || '_v1_' || s AS volume_id, CASE s WHEN 'google_books' THEN 'google_books/W' || o_custkey || '/I' || o_orderkey || '/v1/W' || o_custkey || '_I' || o_orderkey || '_v1_gb.parquet' WHEN 'google_vision' THEN 'gv/W' || o_custkey || '/I' || o_orderkey || '/v1/W' || o_custkey || '-I' || o_orderkey || '-v1-gv.parquet'
ELSE s || '/W' || o_custkey || '/I' || o_orderkey || '/v1/W' || o_custkey || '-I' || o_orderkey || '-v1_ocrv1.parquet' END AS ocr_key, substr(md5('W' || o_custkey), 1, 2) AS folder,
'Works/' || substr(md5('W' || o_custkey), 1, 2) || '/W' || o_custkey || '/images/W' || o_custkey || '-' || CASE WHEN regexp_full_match('I' || o_orderkey, 'I[0-9]{4}') THEN o_orderkey::VARCHAR ELSE 'I' || o_orderkey END || '/' AS images FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'google_books' WHEN 1 THEN 'google_vision' ELSE 'ocrv1-ws-ldv1' END AS s FROM orders)""")
def keys(spark, d):
    k = F.col("o_orderkey")
    source = F.when(k % 3 == 0, "google_books").when(k % 3 == 1, "google_vision").otherwise("ocrv1-ws-ldv1")
    rows = t(spark, d, "orders").select("o_orderkey", F.concat(F.lit("W"), F.col("o_custkey").cast("string")).alias("w"), F.concat(F.lit("I"), k.cast("string")).alias("i"), F.lit("v1").alias("v"), source.alias("s"))
    args = [F.col(x) for x in "wivs"]
    return rows.select("o_orderkey", T.volume_id(*args).alias("volume_id"), T.ocr_key(*args).alias("ocr_key"), T.hash_prefix(F.col("w")).alias("folder"), T.image_folder(F.col("w"), F.col("i")).alias("images"))


# each chunk from the one before, as the definition says: the last end of a sentence before the target, else the first up to twice the size,
# else behind the last space or line end there, else at twice the size
SENTENCES = r"[།༎༏༐༑༔]+\s*|[.!?]\s+|\n+"


@query(
    "t01_sentence_chunks",
    rf"""WITH RECURSIVE m AS (SELECT doc_id AS id, coalesce(text, '') AS t, regexp_split_to_array(coalesce(text, ''), '{SENTENCES}') AS p, regexp_extract_all(coalesce(text, ''), '{SENTENCES}') AS g FROM documents),
e AS (SELECT id, any_value(t) AS t, list(s ORDER BY i) AS ends FROM (SELECT id, t, i, sum(length(x) + length(y)) OVER (PARTITION BY id ORDER BY i) AS s FROM (SELECT id, t, unnest(range(len(g))) AS i, unnest(p[1:len(g)]) AS x, unnest(g) AS y FROM m)) GROUP BY id),
d AS (SELECT m.id, m.t, coalesce(list_transform(e.ends, lambda x: CAST(x AS BIGINT)), []) AS ends FROM m LEFT JOIN e USING (id)),
c AS (SELECT id, t, ends, -1 AS n, CAST(0 AS BIGINT) AS cstart, CAST(0 AS BIGINT) AS cend FROM d UNION ALL
 SELECT id, t, ends, n + 1, cend, CASE WHEN length(t) - cend <= {I.CHUNK} THEN length(t) ELSE coalesce(list_max(list_filter(ends, lambda x: x > cend AND x < cend + {I.CHUNK})), list_min(list_filter(ends, lambda x: x >= cend + {I.CHUNK} AND x <= least(length(t), cend + {2 * I.CHUNK}))),
  least(length(t), cend + {2 * I.CHUNK}) + 1 - nullif(instr(reverse(replace(substr(t, CAST(cend + 2 AS INT), CAST(least(length(t), cend + {2 * I.CHUNK}) - cend - 1 AS INT)), chr(10), ' ')), ' '), 0), least(length(t), cend + {2 * I.CHUNK})) END FROM c WHERE cend < length(t))
SELECT id, CAST(n AS INT) AS n, CAST(cstart AS INT) AS cstart, CAST(cend AS INT) AS cend, md5(substr(t, CAST(cstart + 1 AS INT), CAST(cend - cstart AS INT))) AS text_md5 FROM c WHERE n >= 0""",
)
def sentence_chunks(spark, d):
    return I.chunked(t(spark, d, "documents"), "doc_id", "text").select("id", "n", "cstart", "cend", F.md5("text").alias("text_md5"))
