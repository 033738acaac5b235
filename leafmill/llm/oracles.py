"""SQL twins of the queries that SQL can express, on whole tables."""

from __future__ import annotations

from leafmill.llm.quality_rules import CLASSES, COMMON_WORDS

WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP2 = rf"""WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
lo AS (SELECT h, min(doc_id) AS low FROM v GROUP BY 1), g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM v JOIN lo USING (h) WHERE low < doc_id),
gl AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY 1), k AS (SELECT d.doc_id, unnest(range(1, len(w) + 1)) AS q, unnest(w) AS x FROM d JOIN gl USING (doc_id)),
kt AS (SELECT k.doc_id, coalesce(string_agg(x, ' ' ORDER BY q) FILTER (WHERE g.p IS NULL), '') AS t, count(g.p) AS n FROM k LEFT JOIN g ON g.doc_id = k.doc_id AND g.p = k.q GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, array_to_string(w, ' '))) AS kept_sha256 FROM d LEFT JOIN kt USING (doc_id)"""

OP3 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

KEPT = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def vector_codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """c0, c1, ...: the codebooks before and after each round; a0, a1, ...: every part's nearest entry."""
    floor = lambda s, n: f"(({s} - (({s} % {n}) + {n}) % {n}) // {n})"
    steps = [f"""v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE {KEPT}),
p AS (SELECT r, k, list_slice(e, (k * len(e)) // {parts} + 1, ((k + 1) * len(e)) // {parts}) AS x FROM v, range({parts}) t(k)),
c0 AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS j, x AS c FROM p JOIN (SELECT r, vec_id FROM v ORDER BY vec_id LIMIT {entries}) USING (r))"""]
    for i in range(rounds + 1):
        steps.append(f"""d{i} AS (SELECT r, p.k, j, x, CAST(list_sum(list_transform(list_zip(x, c), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS BIGINT) AS d FROM p JOIN c{i} ON p.k = c{i}.k),
a{i} AS MATERIALIZED (SELECT r, k, arg_min(j, (d, j)) AS j, min(d) AS d, any_value(x) AS x FROM d{i} GROUP BY r, k)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT k, j, pos, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT k, j, unnest(range(len(x))) AS pos, unnest(x) AS y FROM a{i}) GROUP BY ALL),
m{i} AS (SELECT k, j, list({floor("s", "n")} ORDER BY pos) AS m FROM s{i} GROUP BY k, j),
c{i + 1} AS MATERIALIZED (SELECT c{i}.k, c{i}.j, coalesce(m, c) AS c FROM c{i} LEFT JOIN m{i} ON c{i}.k = m{i}.k AND c{i}.j = m{i}.j)""")
    last = f"""o AS (SELECT r, string_agg(printf('%02x', j), '' ORDER BY k) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, j)) FROM c{rounds}) AS codebooks_sha256 FROM v JOIN o USING (r)"""
    return "WITH " + ",\n".join([*steps, last])


def centroid_clusters_sql(k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: int = 1) -> str:
    """c0, c1, ...: the centroids before and after each round; a0, a1, ...: every vector's nearest centroid."""
    steps = [f"""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE {KEPT} AND len(embedding) = {width}),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS j, x AS c FROM (SELECT x, sha256('{seed}:' || vec_id) AS h FROM v ORDER BY h LIMIT {k}))"""]
    for i in range(rounds + 1):
        steps.append(f"""d{i} AS (SELECT r, j, x, CAST(list_sum(list_transform(list_zip(x, c), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS BIGINT) AS d FROM v CROSS JOIN c{i}),
a{i} AS MATERIALIZED (SELECT r, arg_min(j, (d, j)) AS j, min(d) AS d, any_value(x) AS x FROM d{i} GROUP BY r)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT j, pos, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT j, unnest(range(len(x))) AS pos, unnest(x) AS y FROM a{i}) GROUP BY ALL),
m{i} AS (SELECT j, list(((s - ((s % n) + n) % n) // n) ORDER BY pos) AS m FROM s{i} GROUP BY j),
c{i + 1} AS MATERIALIZED (SELECT c{i}.j, coalesce(m, c) AS c FROM c{i} LEFT JOIN m{i} ON c{i}.j = m{i}.j)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(a{rounds}.j AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM v JOIN a{rounds} USING (r) JOIN c{rounds} ON c{rounds}.j = a{rounds}.j"""


OP5 = rf"""WITH d AS (SELECT doc_id, source, CAST(len({WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 6)) AS BIGINT) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM w WINDOW b AS (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level AS lvl FROM l WHERE level * w <= cap ORDER BY cap / w, i LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN (SELECT lvl FROM f) IS NULL THEN cap ELSE least(cap, (SELECT lvl FROM f) * w) END AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS base FROM t), r AS (SELECT *, greatest(0.0, target - base * source_size) AS rest FROM b),
c AS (SELECT source, h, sum(size) AS n FROM d GROUP BY 1, 2), u AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM c),
e AS (SELECT u.source, min(h) AS edge FROM u JOIN r ON u.source IS NOT DISTINCT FROM r.source WHERE upto > rest GROUP BY 1),
p AS (SELECT r.*, edge, (rest - (upto - n)) / n AS part FROM r LEFT JOIN e ON e.source IS NOT DISTINCT FROM r.source LEFT JOIN u ON u.source IS NOT DISTINCT FROM r.source AND u.h = edge)
SELECT doc_id, size, source_size, target, CAST(base * size + coalesce(CASE WHEN h < edge THEN size WHEN h = edge THEN CAST(round(size * part) AS BIGINT) ELSE 0 END, 0) AS BIGINT) AS taken, d.source, base FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source"""

OP7 = rf"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), m AS (SELECT x FROM s GROUP BY 1 HAVING count(*) > 1), t AS (SELECT s.* FROM s JOIN m USING (x)),
c AS (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS k FROM t l JOIN t r ON l.x = r.x AND l.doc_id < r.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)), e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
g(v, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, g.r FROM g JOIN e ON e.a = g.v)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(r) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN g ON g.v = d.doc_id GROUP BY d.doc_id, n"""


def _op8() -> str:
    steps, last = [], "t0"
    for k, (name, pattern) in enumerate(CLASSES):
        quoted = pattern.replace("'", "''")
        steps.append(f"s{k} AS (SELECT *, regexp_replace(t{k}, '{quoted}', '', 'g') AS t{k + 1} FROM {'d' if k == 0 else f's{k - 1}'})")
        last = f"t{k + 1}"
    names = [n for n, _ in CLASSES]
    chars = ", ".join(f"length(t{k}) - length(t{k + 1}) AS c_{n}" for k, n in enumerate(names)) + f", length({last}) AS c_other"
    every = [f"c_{n}" for n in (*names, "other")]
    lists = " ".join(f"WHEN '{lang}' THEN [{', '.join(repr(w) for w in words)}]" for lang, words in COMMON_WORDS.items())
    size = max(map(len, COMMON_WORDS.values()))
    words = WORDS.format("t0")
    div = "sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: (CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) ELSE 0 END) / 2))))"
    share = lambda v: f"list_transform({v}, lambda y: y / list_sum({v}))"
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t0 FROM documents), {", ".join(steps)},
a AS (SELECT r, doc_id, lang, t0, {words} AS w, {chars} FROM s{len(CLASSES) - 1}),
li AS (SELECT r, count(*) - count(DISTINCT x) AS dup FROM (SELECT r, unnest(string_split(t0, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1),
v AS (SELECT r, i, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM a WHERE len(w) >= 3)), h AS (SELECT r, g FROM v GROUP BY 1, 2 HAVING count(*) > 1),
rp AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT v.r, unnest(range(i, i + 3)) AS p FROM v JOIN h ON h.r = v.r AND h.g = v.g) GROUP BY 1),
cw AS (SELECT r, unnest(range(len(cl))) AS i, unnest(cl) AS cwd FROM (SELECT r, CASE lang {lists} END AS cl FROM a)), wf AS (SELECT r, x, count(*) AS n FROM (SELECT r, lower(unnest(w)) AS x FROM a) GROUP BY 1, 2),
wh AS (SELECT cw.r, list(coalesce(n, 0)::DOUBLE ORDER BY i) AS hits FROM cw LEFT JOIN wf ON wf.r = cw.r AND wf.x = cwd GROUP BY 1),
b AS (SELECT a.*, [{", ".join(f"{c}::DOUBLE" for c in every)}] AS cs, hits FROM a LEFT JOIN wh USING (r)),
rc AS (SELECT lang AS l, [{", ".join(f"sum({c})::DOUBLE" for c in every)}] AS rcs, [{", ".join(f"coalesce(sum(hits[{i + 1}]), 0)::DOUBLE" for i in range(size))}] AS rws FROM b GROUP BY 1),
j AS (SELECT b.*, rcs, rws, list_concat(hits, list_transform(range({size} - len(hits)), lambda q: 0.0::DOUBLE)) AS hp FROM b LEFT JOIN rc ON rc.l IS NOT DISTINCT FROM lang),
o AS (SELECT *, CASE WHEN list_sum(cs) > 0 AND list_sum(rcs) > 0 THEN {div.format(p=share("cs"), q=share("rcs"))} END AS cd, CASE WHEN hits IS NOT NULL AND list_sum(rws) > 0 THEN CASE WHEN list_sum(hp) > 0 THEN {div.format(p=share("hp"), q=share("rws"))} WHEN len(w) >= 100 THEN 1 END END AS wd FROM j),
z AS (SELECT o.*, CAST(len(w) AS BIGINT) AS n_words, coalesce(rp.n, 0) AS n_repeat_words, coalesce(li.dup, 0) AS n_dup_lines FROM o LEFT JOIN rp USING (r) LEFT JOIN li USING (r)),
y AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM z)
SELECT doc_id, n_words, CAST({" + ".join(c for c in every if c != "c_space")} AS BIGINT) AS word_chars, CAST(c_symbol AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed, round(cd, 6) AS char_distance, round(wd, 6) AS word_distance,
NOT base_failed AND NOT (n_words >= 100 AND (coalesce(cd, 0) > 0.3162 OR coalesce(wd, 0) > 0.7071)) AS kept FROM y"""


OP8 = _op8()

OP10 = r"""WITH d AS (SELECT row_number() OVER () AS r, * FROM documents), p AS (SELECT r, source, coalesce(text, '') AS t FROM d), n AS (SELECT source, count(*) AS total FROM p GROUP BY 1),
l AS (SELECT DISTINCT source, r, trim(unnest(string_split(t, chr(10)))) AS x FROM p), f AS (SELECT l.source, x, count(*) AS k FROM l WHERE NOT regexp_full_match(x, '[\x20\x09-\x0D]*') GROUP BY 1, 2),
g AS (SELECT f.source, list(x) AS dropped FROM f JOIN n ON n.source IS NOT DISTINCT FROM f.source WHERE k >= 2 AND k / total > 0.1 GROUP BY 1),
o AS (SELECT doc_id, d.source, string_split(coalesce(text, ''), chr(10)) AS a, coalesce(dropped, []) AS dropped, text FROM d LEFT JOIN g ON g.source IS NOT DISTINCT FROM d.source),
q AS (SELECT *, list_filter(a, lambda x: regexp_full_match(x, '[\x20\x09-\x0D]*') OR NOT list_contains(dropped, trim(x))) AS kept FROM o)
SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(a) END AS n_lines, CAST(len(a) - len(kept) AS BIGINT) AS n_dropped, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM q"""

ORACLES = {"op2_substring_dedup": OP2, "op3_topk_search": OP3, "op5_mix_sources": OP5, "op7_ngram_join": OP7, "op8_quality_rules": OP8, "op10_line_dedup": OP10, "op11_vector_codes": vector_codes_sql(), "op13_centroid_clusters": centroid_clusters_sql()}
