"""Catalog queries. Orders stand for volumes or works, line items for segments, customers and suppliers for persons, events for the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators import catalog as C
from leafmill.plans.registry import query


def t(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def works(spark, d) -> DataFrame:
    """Orders as works: authors are the distinct suppliers of their line items by line."""
    lines = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda s: s["l_suppkey"]).alias("authors"))
    return t(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("id"), "authors", record_status().alias("record_status"))


def record_status() -> Column:
    """The status of an order as a work."""
    return F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderkey") % 7 == 0, "duplicate").when(F.col("o_orderkey") % 11 == 0, "withdrawn").when(F.col("o_orderkey") % 13 == 0, "deleted").otherwise("new")


WORKS_SQL = """wk AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'active' WHEN o_orderkey % 7 = 0 THEN 'duplicate' WHEN o_orderkey % 11 = 0 THEN 'withdrawn' WHEN o_orderkey % 13 = 0 THEN 'deleted' ELSE 'new' END AS record_status FROM orders)"""


@query("p01_filter_status", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def filter_status(spark, d):
    return C.where_all(t(spark, d, "orders"), "O", "o_orderstatus", o_orderpriority="1-URGENT").select("o_orderkey", "o_custkey", "o_totalprice")


@query("p04_missing_means_pending", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN nullif(CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN '' ELSE lower(o_orderstatus) END, '') IS NULL THEN 'pending' ELSE lower(o_orderstatus) END AS status FROM orders) GROUP BY 1")
def missing_means_pending(spark, d):
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.lit(None).cast("string")).when(F.col("o_orderkey") % 5 == 1, "").otherwise(F.lower("o_orderstatus"))
    return t(spark, d, "orders").select(C.matching_status(raw).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("p03_array_membership", "SELECT l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7) GROUP BY 1")
def array_membership(spark, d):
    return works(spark, d).where(F.array_contains("authors", 7)).select("id", F.size("authors").cast("long").alias("n"))


@query("p06_nested_predicate", "SELECT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1")
def nested_predicate(spark, d):
    nested = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "l_quantity")).alias("segments"))
    return nested.where(F.exists("segments", lambda s: (s["l_returnflag"] == "R") & (s["l_quantity"] > 45))).select(F.col("l_orderkey").alias("id"))


@query("p17_exists_not_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW') AND c_acctbal > 0")
def exists_not_exists(spark, d):
    orders = t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    kept = t(spark, d, "customer").where("c_acctbal > 0").join(orders.where("o_orderstatus = 'F'"), "c_custkey", "left_semi")
    return kept.join(orders.where("o_orderpriority = '5-LOW'"), "c_custkey", "left_anti").select("c_custkey")


@query("s01_page_with_total", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def page_with_total(spark, d):
    return C.page(t(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice"), 100, 50, F.col("o_orderkey"))


def volumes(spark, d) -> DataFrame:
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("b"), (F.col("o_custkey") % 97).cast("string")).alias("batch_id"), F.lower("o_orderstatus").alias("status_matching"))


@query("a01_batch_report", """WITH c AS (SELECT 'b' || (o_custkey % 97) AS batch_id, lower(o_orderstatus) AS status, count(*) AS n FROM orders GROUP BY 1, 2), b AS (SELECT DISTINCT batch_id FROM c ORDER BY 1 LIMIT 40)
SELECT batch_id, status, n FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY n DESC, status) AS r FROM c WHERE batch_id IN (SELECT batch_id FROM b)) WHERE r <= 2""")
def batch_report(spark, d):
    return C.batch_report(volumes(spark, d), 40, 2)


@query("a02_catalog_stats", """WITH s AS (SELECT 'volume' AS type, o_orderstatus AS status, count(l_orderkey) AS s FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 10 GROUP BY o_orderkey, o_orderstatus
UNION ALL SELECT 'person', c_mktsegment, 0 FROM customer UNION ALL SELECT 'work', p_type, 0 FROM part) SELECT type, status, count(*) AS n, CAST(sum(s) AS BIGINT) AS segments FROM s GROUP BY GROUPING SETS ((type, status), (type))""")
def catalog_stats(spark, d):
    lines = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.when(F.col("l_quantity") > 10, F.col("l_linenumber")).alias("cstart"))).alias("segments"))
    kind = "array<struct<cstart:int>>"
    vols = t(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.lit("volume").alias("type"), F.col("o_orderstatus").alias("status"), F.col("segments").cast(kind).alias("segments"))
    persons = t(spark, d, "customer").select(F.lit("person").alias("type"), F.col("c_mktsegment").alias("status"), F.lit(None).cast(kind).alias("segments"))
    others = t(spark, d, "part").select(F.lit("work").alias("type"), F.col("p_type").alias("status"), F.lit(None).cast(kind).alias("segments"))
    return C.catalog_stats(vols.unionByName(persons).unionByName(others))


@query("w10_best_version", """SELECT o_custkey AS rep_id, o_orderpriority AS vol_id, o_orderkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY (n > 0) DESC, o_orderdate DESC, o_orderkey) AS r
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey) WHERE r = 1""".replace("(n > 0) DESC", "(coalesce(n, 0) > 0) DESC"))
def best_version(spark, d):
    seg = t(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("segments"))
    vols = t(spark, d, "orders").join(seg, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_custkey").alias("rep_id"), F.col("o_orderpriority").alias("vol_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("last_updated_at"), "segments")
    return C.best_versions(vols).select("rep_id", "vol_id", "id")


@query("k07_audit_history", "SELECT user_id, CAST(n AS INT) AS n, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 20")
def audit_history(spark, d):
    return C.history(t(spark, d, "events"), 20, "user_id", "ts", "event_id").select("user_id", "n", "event_id", "event_type")


@query("j01_ordered_authors", """SELECT o_orderkey AS id, coalesce(a, '') AS authors FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(s_name, '|' ORDER BY l_linenumber, l_suppkey) AS a FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0 GROUP BY 1) ON l_orderkey = o_orderkey""")
def ordered_authors(spark, d):
    persons = t(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("pref_label_bo"))
    return C.with_authors(works(spark, d), persons).select("id", F.array_join("author_names", "|").alias("authors"))


@query("j03_propagation", f"""WITH {WORKS_SQL}, nm AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderpriority = '2-HIGH'), us AS (SELECT wk.* FROM wk JOIN nm USING (id)),
au AS (SELECT DISTINCT l_suppkey AS id FROM lineitem JOIN us ON us.id = l_orderkey WHERE us.record_status NOT IN ('duplicate', 'withdrawn'))
SELECT 'work' AS type, id FROM us WHERE record_status NOT IN ('duplicate', 'withdrawn', 'active') UNION ALL SELECT 'person', s_suppkey FROM supplier JOIN au ON au.id = s_suppkey WHERE s_acctbal < 0""")
def propagation(spark, d):
    segments = t(spark, d, "orders").where("o_orderpriority = '2-HIGH'").select(F.col("o_orderkey").alias("wa_id"))
    persons = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") < 0, "new").otherwise("active").alias("record_status"))
    return C.activated(segments, works(spark, d), persons)


@query("t11_upsert", """WITH cu AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS seg, c_custkey % 4 = 0 AS modified, 1 AS edit_version FROM customer WHERE c_custkey % 3 <> 0),
inc AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE upper(c_name) END AS name, 'IMPORTED' AS seg FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(cu.id, inc.id) AS id, CASE WHEN coalesce(modified, false) THEN cu.name ELSE coalesce(inc.name, cu.name) END AS name, CASE WHEN coalesce(modified, false) THEN cu.seg ELSE coalesce(inc.seg, cu.seg) END AS seg, coalesce(modified, false) AS modified, 'active' AS record_status, 'imported' AS origin,
CASE WHEN cu.id IS NULL THEN 'created' WHEN inc.id IS NULL THEN 'untouched' WHEN coalesce(modified, false) THEN 'kept' ELSE 'updated' END AS outcome FROM cu FULL JOIN inc ON cu.id = inc.id""")
def upsert(spark, d):
    c = t(spark, d, "customer")
    current = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"), (F.col("c_custkey") % 4 == 0).alias("modified"), F.lit(1).alias("edit_version"), F.lit("active").alias("record_status"), F.lit("imported").alias("origin"))
    incoming = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 != 0, F.upper("c_name")).alias("name"), F.lit("IMPORTED").alias("seg"))
    return C.upserted(current, incoming, ["name", "seg"]).drop("edit_version")


@query("a10_sync_counters", """SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN c_acctbal > 0 THEN 'upsert' WHEN s_suppkey IS NULL THEN 'skip' WHEN c_nationkey < 12 THEN 'duplicate' ELSE 'withdraw' END AS outcome FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey) GROUP BY 1""")
def sync_counters(spark, d):
    return release(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


@query("t12_release_logic", """SELECT c_custkey AS id, CASE WHEN c_nationkey < 12 THEN c_custkey + 1 END AS replacement, CASE WHEN c_acctbal > 0 THEN 'upsert' WHEN s_suppkey IS NULL THEN 'skip' WHEN c_nationkey < 12 THEN 'duplicate' ELSE 'withdraw' END AS outcome FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def release(spark, d):
    parsed = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("released"), F.when(F.col("c_nationkey") < 12, F.col("c_custkey") + 1).alias("replacement"))
    return C.release_outcomes(parsed, t(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))


@query("t09_merge_rules", f"""WITH {WORKS_SQL}, rc AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'work' ELSE 'person' END AS type, record_status FROM wk), cm AS (SELECT o_orderkey AS id, o_custkey AS canonical_id FROM orders)
SELECT cm.id, canonical_id, CASE WHEN cm.id = canonical_id THEN 'conflict' WHEN o.id IS NULL OR c.id IS NULL THEN 'not_found' WHEN o.record_status = 'duplicate' THEN 'conflict' WHEN o.type <> c.type THEN 'conflict' ELSE 'merged' END AS outcome FROM cm LEFT JOIN rc o ON o.id = cm.id AND o.id % 10 <> 9 LEFT JOIN rc c ON c.id = canonical_id AND c.id % 10 <> 9""")
def merge_rules(spark, d):
    records = works(spark, d).where("id % 10 <> 9").select("id", F.when(F.col("id") % 2 == 0, "work").otherwise("person").alias("type"), "record_status")
    return C.merge_outcomes(t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("canonical_id")), records)


@query("t10_soft_delete", """SELECT 'WA' || p_partkey AS id, CASE WHEN p_size = 1 THEN 'not_found' WHEN NOT starts_with('WA' || p_partkey, 'WA1') THEN 'forbidden' WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) THEN 'conflict' ELSE 'deleted' END AS outcome FROM part""")
def soft_delete(spark, d):
    part = t(spark, d, "part").select(F.concat(F.lit("WA"), F.col("p_partkey").cast("string")).alias("id"), "p_size")
    used = t(spark, d, "lineitem").where("l_quantity = 50").select(F.concat(F.lit("WA"), F.col("l_partkey").cast("string")).alias("id"))
    return C.delete_outcomes(part.select("id"), part.where("p_size <> 1").select("id"), used, "WA1")


@query("a11_next_id", "SELECT greatest(coalesce(max(CAST(substr(id, 5) AS BIGINT)) + 1, 10), 10) AS next FROM (SELECT 'WA1B' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'O')")
def next_id(spark, d):
    records = t(spark, d, "orders").select(F.concat(F.lit("WA1B"), F.col("o_orderkey").cast("string")).alias("id"), F.when(F.col("o_orderstatus") == "O", "local").otherwise("imported").alias("origin"))
    return C.next_number(records, "WA1B", 10)


@query("j17_mark_batch", """SELECT DISTINCT l_orderkey AS id, CASE WHEN o_orderkey IS NULL THEN 'missing' WHEN o_orderpriority = '1-URGENT' THEN 'ok' WHEN o_orderstatus <> 'F' THEN 'conflict' ELSE 'update' END AS state FROM (SELECT DISTINCT l_orderkey + 3 AS l_orderkey FROM lineitem) LEFT JOIN orders ON o_orderkey = l_orderkey""")
def mark_batch(spark, d):
    vols = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") == "1-URGENT", "1-URGENT").when(F.col("o_orderstatus") != "F", "other").otherwise("").alias("batch_id"))
    return C.batch_marks(t(spark, d, "lineitem").select((F.col("l_orderkey") + 3).alias("id")), vols, "1-URGENT")


@query("t16_follow_canonical", f"""WITH RECURSIVE {WORKS_SQL}, h AS (SELECT id, CASE WHEN record_status = 'duplicate' AND id >= 7 THEN id - 7 ELSE id END AS nx FROM wk), w(id, cur) AS (SELECT id, id FROM h UNION SELECT w.id, h.nx FROM w JOIN h ON h.id = w.cur)
SELECT id, min(cur) AS canonical FROM w GROUP BY 1""")
def follow_canonical(spark, d):
    own = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), record_status().alias("record_status")).select("id", "record_status", F.when(F.col("id") >= 7, F.col("id") - 7).otherwise(F.col("id")).alias("canonical_id"))
    return C.canonical(own)


@query("t07_annotation_faults", """WITH s AS (SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS INT)) OVER w AS INT) AS cend, CAST(l_quantity AS INT) AS q, l_suppkey, l_returnflag FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey ROWS UNBOUNDED PRECEDING)),
g AS (SELECT l_orderkey, max(cend) AS last_end, count(*) AS n, count(DISTINCT l_suppkey) AS u, bool_or(l_returnflag = 'R' AND l_suppkey % 10 = 0) AS nowa FROM s GROUP BY 1), v AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE last_end END AS cend, last_end, coalesce(n, 0) AS n, u, nowa FROM orders LEFT JOIN g ON l_orderkey = o_orderkey)
SELECT id, 'no_segments' AS rule FROM v WHERE n < 1 UNION ALL SELECT id, 'last_end' FROM v WHERE n > 0 AND last_end <> cend UNION ALL SELECT id, 'wa_id' FROM v WHERE nowa UNION ALL SELECT id, 'unique' FROM v WHERE u < n""")
def annotation_faults(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("l_quantity").cast("int")).over(order).cast("int")
    seg = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", end.alias("cend"), F.col("l_quantity").cast("int").alias("q"))
    item = F.struct("cend", (F.col("cend") - F.col("q")).alias("cstart"), F.concat(F.lit("MW1_"), F.col("l_suppkey").cast("string")).alias("mw_id"), F.when(F.col("l_suppkey") % 10 != 0, F.concat(F.lit("WA"), F.col("l_suppkey").cast("string"))).alias("wa_id"), F.when(F.col("l_returnflag") == "R", "text").otherwise("editorial").alias("segment_type"))
    nested = seg.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("segments"), F.max("cend").alias("e"))
    vols = t(spark, d, "orders").join(nested, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    cend = F.when(F.col("o_orderstatus") == "P", 0).otherwise(F.col("e"))
    return C.annotation_faults(vols.select(F.col("o_orderkey").alias("id"), F.lit("MW1").alias("mw_id"), cend.alias("cend"), cend.alias("base_length"), "segments"))


@query("j16_fill_batch", """SELECT o_orderkey, min(s_suppkey) AS suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey IN (1, 2) GROUP BY 1""")
def fill_batch(spark, d):
    from leafmill.operators.joins import filled

    jobs = t(spark, d, "nation").where(F.col("n_regionkey").isin(1, 2)).select(F.col("n_nationkey").alias("s_nationkey"))
    runs = t(spark, d, "supplier").join(jobs, "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"))
    found = t(spark, d, "lineitem").join(runs, "l_suppkey").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("suppkey"))
    matched, _ = filled(t(spark, d, "orders").select("o_orderkey"), found, ["o_orderkey"], "suppkey")
    return matched


@query("j16_unmatched", """SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey IN (1, 2))""")
def unmatched(spark, d):
    from leafmill.operators.joins import filled

    jobs = t(spark, d, "nation").where(F.col("n_regionkey").isin(1, 2)).select(F.col("n_nationkey").alias("s_nationkey"))
    runs = t(spark, d, "supplier").join(jobs, "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"))
    found = t(spark, d, "lineitem").join(runs, "l_suppkey").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("suppkey"))
    return filled(t(spark, d, "orders").select("o_orderkey"), found, ["o_orderkey"], "suppkey")[1]


@query("j20_entity_scores", "SELECT o_orderkey AS id, CAST(least(o_totalprice, 65504.0) AS FLOAT)::DOUBLE AS db_score FROM orders")
def entity_scores(spark, d):
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), C.capped_score(F.col("o_totalprice")).cast("double").alias("db_score"))


@query("p18_volume_range", """SELECT p_partkey, s_suppkey FROM part JOIN supplier ON CASE WHEN p_size % 3 = 0 THEN s_nationkey = p_size % 25 ELSE s_nationkey BETWEEN p_size % 25 AND p_size % 25 + 1 END""")
def volume_range(spark, d):
    from leafmill.operators.joins import in_volume_range

    parts = t(spark, d, "part").select("p_partkey", (F.col("p_size") % 25).alias("v"), F.when(F.col("p_size") % 3 != 0, F.col("p_size") % 25 + 1).alias("v_end"))
    return in_volume_range(t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("volume")), parts, "volume", "v", "v_end").select("p_partkey", "s_suppkey")


@query("k02_partial_update", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_name END AS name, CASE WHEN s_suppkey % 3 = 0 THEN 0.0 ELSE s_acctbal END AS balance FROM supplier")
def partial_update(spark, d):
    own = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    given = F.array_compact(F.array(F.when(F.col("id") % 2 == 0, "name"), F.when(F.col("id") % 3 == 0, "balance")))
    return C.patched(own, own.select("id", given.alias("given"), F.lit(None).cast("string").alias("name"), F.lit(0.0).alias("balance")), ["name", "balance"])
