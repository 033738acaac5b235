"""Search in nested elements and in children of records, with the elements that matched.

Texts of blocks are rows: parent, child (null for a parent's own elements), element (number in its array), field, value (number in
the field, where it has several), text. Their postings keep these keys, so a phrase is found inside one value of one element and
never across two. Matches go up to parents by a score mode, and the best elements of each come along as inner hits.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.operators import search as S
from leafmill.operators.analysis import ANALYZERS, Analyzer, graph_hits, graph_phrases, graph_postings, graph_presence, highlights, text_hits
from leafmill.operators.dedup import idf
from leafmill.staging import COMPACT, small, staged

KEYS = ["parent", "child", "element", "field", "value"]
#: Elements a record that come along with a match, and code points of their best fragments.
INNER_HITS, FRAGMENT = 3, 100
PHONETIC = ".tibetan-phonetic"


def block_texts(df: DataFrame, parent: str, fields: list[str], nested: str | None = None, child: str | None = None) -> DataFrame:
    """KEYS and text of the fields of df's rows, or of the elements of the array of structs `nested`. Fields are strings or arrays of
    strings; null and missing ones have no rows. Elements of a child are those of its own array."""
    key = df.select(F.col(parent).alias("parent"), (F.col(child) if child else F.lit(None).cast("string")).alias("child"), *([nested] if nested else fields))
    rows = key.select("parent", "child", F.posexplode(nested).alias("element", "_e")).select("parent", "child", "element", "_e.*") if nested else key.withColumn("element", F.lit(0))
    out = None
    for field in fields:
        values = F.col(field) if rows.schema[field].dataType.typeName() == "array" else F.array(field)
        name = f"{nested}.{field}" if nested else field
        each = rows.select("parent", "child", "element", F.lit(name).alias("field"), F.posexplode(values).alias("value", "text")).where("text is not null")
        out = each if out is None else out.unionByName(each)
    return out


def block_postings(texts: DataFrame, analyzers: dict[str, Analyzer | str]) -> DataFrame:
    """KEYS and the edges of the texts' graphs, staged. analyzers: suffix of the field's name -> analyzer, so that one field has postings
    for each way of reading it."""
    out = None
    for suffix, analyzer in analyzers.items():
        posts = graph_postings(texts, KEYS, "text", analyzer).withColumn("field", F.concat("field", F.lit(suffix)))
        out = posts if out is None else out.unionByName(posts)
    return staged(out, "block-postings", **COMPACT)


def element_hits(posts: DataFrame, phrases: DataFrame, by: list[str], boosts: dict[str, float] | None = None) -> DataFrame:
    """by, KEYS, n, spans, score of each phrase found in an element: the idf of its tokens among the elements that have the field, times
    the field's boost; posts: of block_postings; phrases: of graph_phrases."""
    total = posts.groupBy("field").agg(F.count_distinct(F.struct("parent", "child", "element")).alias("_t"))
    return _scored(graph_hits(posts, phrases, by, KEYS), posts, total, phrases, by, boosts)


def search_elements(texts: DataFrame, analyzer: Analyzer | str, phrases: DataFrame, by: list[str], boosts: dict[str, float] | None = None, suffix: str = "") -> DataFrame:
    """As element_hits, of block_texts without stored postings. An element counts as having the field where its text has a word."""
    named = texts.withColumn("field", F.concat("field", F.lit(suffix)))
    found = analyzer if isinstance(analyzer, Analyzer) else ANALYZERS[analyzer]
    presence = staged(graph_presence(named, KEYS, "text", analyzer, phrases), "presence", **COMPACT)
    own = named.where(F.col("text").rlike(found.word))
    # an element counts once, so what elements with several such values have more of them is taken off
    element = F.struct("parent", "child", "element", "field")
    several = own.where("value > 0").select(element.alias("_e")).distinct()
    more = own.select("field", element.alias("_e")).join(small(several, S.TERMS), "_e", "left_semi").groupBy("field", "_e").agg((1 - F.count("*")).alias("_t"))
    total = own.groupBy("field").agg(F.count("*").alias("_t")).unionByName(more.select("field", "_t")).groupBy("field").agg(F.sum("_t").alias("_t"))
    rows = named.groupBy("parent", "child", "element", "field").count().where("count > 1")
    repeated = staged(rows.select(element.alias("_e")), "repeated")
    return _scored(text_hits(named, KEYS, "text", analyzer, phrases, by, presence), presence, total, phrases, by, boosts, repeated)


def _scored(hits: DataFrame, held: DataFrame, total: DataFrame, phrases: DataFrame, by: list[str], boosts: dict[str, float] | None, repeated: DataFrame | None = None) -> DataFrame:
    """hits with score. held: KEYS and token; total: field, and _t elements that have it. repeated: the elements (_e) of which held may
    have a token more than once, if they are known, so that only their rows are shuffled to be told apart."""
    asked = small(phrases.select("token").distinct(), S.TERMS)
    own = held.join(asked, "token", "left_semi")
    told = lambda rows: rows.groupBy("field", "token").agg(F.count_distinct(F.struct("parent", "child", "element")).alias("_h"))
    if repeated is None:
        counts = told(own)
    elif repeated.isEmpty():
        counts = own.groupBy("field", "token").agg(F.count("*").alias("_h"))
    else:
        own, many = own.withColumn("_e", F.struct("parent", "child", "element", "field")), small(repeated, S.TERMS)
        once = own.join(many, "_e", "left_anti").groupBy("field", "token").agg(F.count("*").alias("_h"))
        counts = once.unionByName(told(own.join(many, "_e", "left_semi"))).groupBy("field", "token").agg(F.sum("_h").alias("_h"))
    weight = counts.join(F.broadcast(total), "field").select("field", "token", idf(F.col("_h"), F.col("_t")).alias("weight"))
    weight = staged(weight, "weights")
    worth = phrases.select(*by, "token").join(small(weight, S.TERMS), "token").groupBy(*by, "field").agg(F.sum("weight").alias("_w"))
    boost = F.lit(1.0)
    for field, value in (boosts or {}).items():
        boost = F.when(F.col("field") == field, value).otherwise(boost)
    return hits.join(small(worth, S.TERMS), [*by, "field"]).withColumn("score", F.col("_w") * boost).drop("_w")


def parents_of(hits: DataFrame, by: list[str], mode: str = "max") -> DataFrame:
    """by, parent, score: the best element's score, or 1 with mode none, as matches then only count as such."""
    if mode not in ("max", "none"):
        raise ValueError(f"no score mode {mode}")
    return hits.groupBy(*by, "parent").agg((F.max("score") if mode == "max" else F.lit(1.0)).alias("score"))


def inner_hits(hits: DataFrame, by: list[str], size: int = INNER_HITS, child_size: int = INNER_HITS, mode: str = "max") -> DataFrame:
    """The best elements of each parent: by, KEYS, n, spans, score, child_rank (of the child among the parent's; 1 for a parent's own
    elements), rank (of the element among its child's or parent's). Best means score (with mode none, all are equal), then element;
    of children the smaller id. Spark bounds each rank's rows in every task before they meet, so a parent with many is no one
    task's work."""
    score = F.col("score") if mode == "max" else F.lit(1.0)
    field = Window.partitionBy(*by, "parent", "child", "element").orderBy(F.desc(score), "field", "value")
    best = hits.withColumn("_f", F.row_number().over(field)).where("_f = 1").drop("_f")
    own = Window.partitionBy(*by, "parent", "child").orderBy(F.desc(score), "element")
    best = best.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= size)
    heads = best.where("rank = 1").withColumn("child_rank", F.row_number().over(Window.partitionBy(*by, "parent").orderBy(F.desc(score), F.col("child").asc_nulls_first()))).where(F.col("child_rank") <= child_size)
    heads = heads.select(*(F.col(c).alias(f"_{c}") for c in [*by, "parent", "child"]), "child_rank")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, "parent", "child"]]
    return best.join(heads, same).select(*by, *KEYS, "n", "spans", "score", "child_rank", "rank")


def fragments(inner: DataFrame, texts: DataFrame, by: list[str], size: int | None = FRAGMENT, suffixes: tuple[str, ...] = (PHONETIC,)) -> DataFrame:
    """inner with highlight: the best fragment of the element's text, with what was found marked."""
    plain = F.col("field")
    for suffix in suffixes:
        plain = F.when(plain.endswith(suffix), F.expr(f"substring(field, 1, length(field) - {len(suffix)})")).otherwise(plain)
    read = inner.withColumns({"_field": F.col("field"), "field": plain})
    shown = highlights(read, texts, KEYS, "text", by, size)
    key = lambda df: df.withColumn("_key", F.struct(*by, *KEYS))
    return key(read).join(key(shown).select("_key", "highlight"), "_key").withColumn("field", F.col("_field")).drop("_field", "_key", "spans")


def volume_search(spark: SparkSession, records: DataFrame, etexts: DataFrame, text: str, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """(id, score of the best records; their inner hits) for a query text.

    records: id, pref_label_bo, alt_label_bo, segments (array of structs with title_bo and author_name_bo); etexts: id, parent, chunks
    (array of structs with text_bo). A record is as good as its best clause: the whole phrase in its labels, in one of its
    segments, or in a chunk of an etext of its own (which counts 1), or the two halves of a cut in its labels. Labels and segments
    are read in two ways, as spelt and as they sound. An empty text has no clauses: all records come, by id, with score 0."""
    tokens = [x for x in re.split(rf"[{S.T.QUERY_MARKS}\s]+", text) if x]
    clauses = S.plan(text.strip(), tokens)
    if not clauses:
        none = spark.createDataFrame([], "parent string, child string, element int, field string, value int, score double, child_rank int, rank int, highlight string")
        return records.select("id", F.lit(0.0).alias("score")).orderBy("id").limit(size), none
    rows = [(k, p, c.scope, c.slop, c.boost, len(c.phrases), phrase) for k, c in enumerate(clauses) for p, phrase in enumerate(c.phrases)]
    table = spark.createDataFrame(rows, "clause int, part int, scope string, slop int, boost double, parts int, phrase string")
    texts = {
        "top": block_texts(records, "id", ["pref_label_bo", "alt_label_bo"]),
        "segments": block_texts(records, "id", ["title_bo", "author_name_bo"], nested="segments"),
        "chunks": block_texts(etexts, "parent", ["text_bo"], nested="chunks", child="id"),
    }
    boosts = S.TOP_FIELDS | S.SEGMENT_FIELDS
    best, inner = None, None
    by = ["clause", "part"]
    for scope, own in texts.items():
        asked, hits = table.where(F.col("scope") == scope), None
        for suffix, name in {"": "lenient"}.items() if scope == "chunks" else {"": "lenient", PHONETIC: "phonetic"}.items():
            phrases = staged(graph_phrases(asked.select(*by, "slop", "phrase"), "phrase", name), "phrases")
            found = search_elements(own, name, phrases, by, boosts, suffix)
            hits = found if hits is None else hits.unionByName(found)
        hits = staged(hits, "hits")
        scores = parents_of(hits, by, "none" if scope == "chunks" else "max").join(F.broadcast(asked.select(*by, "boost", "parts")), by)
        whole = scores.groupBy("clause", "parent", "boost", "parts").agg(F.count("*").alias("_n"), F.sum("score").alias("_s")).where("_n = parts")
        whole = whole.select(F.col("parent").alias("id"), (F.col("_s") * F.col("boost")).alias("score"))
        best = whole if best is None else best.unionByName(whole)
        if scope != "top":
            shown = fragments(inner_hits(hits, by, mode="none" if scope == "chunks" else "max"), own, by).select("parent", "child", "element", "field", "value", "score", "child_rank", "rank", "highlight")
            inner = shown if inner is None else inner.unionByName(shown)
    top = staged(best.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(size), "best-records")
    return top.orderBy(F.desc("score"), "id"), inner.join(F.broadcast(top.select(F.col("id").alias("parent"))), "parent", "left_semi")
