"""Phrase search over positional postings, with idf scoring (term frequency and length do not count) and best-clause combination.

Texts are a table (id, field, w) or postings (id, field, pos, token); queries are tables of phrases, so many queries run as one plan.
Phrases are looked up in the texts where these lie (phrase_finder.py), so only what is found is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import phrase_finder
from leafmill.operators.dedup import idf
from leafmill.staging import at_most, small, spread, staged

SLOP_EVERY, SLOP_MOST = 6, 5
#: Rows of phrases and tokens are broadcast up to so many, and else joined by a shuffle.
TERMS = 500_000
FULL, SPLIT = 1.1, 0.2
# Weights of the fields of records and of their segments, as parts of a best-field phrase match.
TOP_FIELDS = {"pref_label_bo": 1.0, "pref_label_bo.tibetan-phonetic": 0.90, "alt_label_bo": 0.95, "alt_label_bo.tibetan-phonetic": 0.85}
SEGMENT_FIELDS = {"segments.title_bo": 0.9, "segments.title_bo.tibetan-phonetic": 0.85, "segments.author_name_bo": 0.7, "segments.author_name_bo.tibetan-phonetic": 0.65}
# Particles that no second phrase starts with.
PARTICLES = frozenset("ཏུ དུ སུ གི ཀྱི གྱི གིས ཀྱིས གྱིས ཀྱང ཡང སྟེ དེ ཏེ གོ ངོ དོ ནོ བོ རོ སོ འོ ཏོ པ བ གིན ཀྱིན གྱིན ཡིན པས པའི པའོ བས བའི ལ".split())
STOP_WORDS = ("འི", "འིས", "ཡིས")

#: name -> tokens of a text column; further analyzers may be added.
ANALYZERS = {
    "words": lambda c: T.words(F.lower(c)),
    "syllables": lambda c: F.filter(T.syllables(c), lambda x: ~x.isin(*STOP_WORDS)),
    "query": T.query_tokens,
}


def postings(docs: DataFrame, id: str, fields: list[str], analyzer: str = "words") -> DataFrame:
    """id, field, pos, token of the fields of docs; array fields have one run of positions for each element, far apart."""
    gap, out = 1000, None
    docs = spread(docs.select(id, *fields))
    for field in fields:
        values = F.col(field) if docs.schema[field].dataType.typeName() == "array" else F.array(field)
        each = docs.select(F.col(id).alias("id"), F.posexplode(values).alias("_k", "_v")).where(F.col("_v").isNotNull())
        tokens = each.select("id", "_k", F.posexplode(ANALYZERS[analyzer](F.col("_v"))).alias("_p", "token"))
        # elements of one field follow each other with a gap, so that no phrase spans two
        run = Window.partitionBy("id", "_k")
        placed = tokens.withColumn("_n", F.max("_p").over(run))
        starts = placed.groupBy("id", "_k").agg(F.max("_n").alias("_n"))
        starts = starts.select("id", "_k", F.coalesce(F.sum(F.col("_n") + gap).over(Window.partitionBy("id").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
        rows = tokens.join(starts, ["id", "_k"]) if docs.schema[field].dataType.typeName() == "array" else tokens.withColumn("_s", F.lit(0))
        rows = rows.select("id", F.lit(field).alias("field"), (F.col("_p") + F.col("_s")).cast("long").alias("pos"), "token")
        out = rows if out is None else out.unionByName(rows)
    return out


def texts(docs: DataFrame, id: str, fields: list[str], analyzer: str = "words") -> DataFrame:
    """id, field, w: the tokens of the fields of docs, side by side; array fields have one row for each element. What postings() tells, with
    each text in one row."""
    out = None
    docs = spread(docs.select(id, *fields))
    for field in fields:
        value = F.explode(field) if docs.schema[field].dataType.typeName() == "array" else F.col(field)
        each = docs.select(F.col(id).alias("id"), F.lit(field).alias("field"), value.alias("_v")).where(F.col("_v").isNotNull())
        rows = each.select("id", "field", ANALYZERS[analyzer](F.col("_v")).alias("w"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _distinct_ids(posts: DataFrame, by: list[str], rows: DataFrame) -> DataFrame:
    """by, n: the ids that rows (id, by; once for each row of texts) have by `by`. Only ids of several rows are told apart by a shuffle."""
    several = staged(posts.groupBy("id", "field").count().where("count > 1").select("id", "field"), "several")
    once, twice = rows, None
    if several.limit(1).count():
        several = small(several, TERMS)
        once, twice = rows.join(several, ["id", "field"], "left_anti"), rows.join(several, ["id", "field"], "left_semi").distinct()
    counted = once.groupBy(*by).agg(F.count("*").alias("n"))
    return counted if twice is None else counted.unionByName(twice.groupBy(*by).agg(F.count("*").alias("n"))).groupBy(*by).agg(F.sum("n").alias("n"))


def weights(posts: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """field, token, weight: idf of the tokens of each field among the documents that have the field; of the tokens in terms only,
    if given. posts: of postings or texts."""
    asked = None if terms is None else staged(terms.select("token").distinct(), "terms")
    few = asked is not None and at_most(asked, TERMS)
    of_asked = lambda rows: rows.join(F.broadcast(asked), "token", "left_semi") if few else rows
    if "w" in posts.columns:
        total = _distinct_ids(posts, ["field"], posts.where(F.size("w") > 0).select("id", "field")).withColumnRenamed("n", "_t")
        tokens = posts.select("id", "field", F.explode(F.array_distinct("w")).alias("token"))
        held = _distinct_ids(posts, ["field", "token"], of_asked(tokens)).withColumnRenamed("n", "_n")
    else:
        total = posts.groupBy("field").agg(F.count_distinct("id").alias("_t"))
        held = of_asked(posts).groupBy("field", "token").agg(F.count_distinct("id").alias("_n"))
    if asked is not None and not few:
        held = held.join(asked, "token", "left_semi")  # counts meet many terms, not the words themselves
    return held.join(F.broadcast(total), "field").select("field", "token", idf(F.col("_n"), F.col("_t")).alias("weight"))


def phrase_words(phrases: DataFrame, text: str = "phrase", analyzer: str = "words") -> DataFrame:
    """phrases with w, their tokens, and n; those without tokens go. Other columns (query, clause, slop) stay."""
    keep = [c for c in phrases.columns if c != text]
    return phrases.select(*keep, ANALYZERS[analyzer](F.col(text)).alias("w")).where(F.size("w") > 0).withColumn("n", F.size("w"))


def phrase_table(phrases: DataFrame, text: str = "phrase", analyzer: str = "words") -> DataFrame:
    """phrase_words with a row for each token: qpos, token, n."""
    toks = phrase_words(phrases, text, analyzer)
    return toks.select(*(c for c in toks.columns if c != "w"), F.posexplode("w").alias("qpos", "token"))


def keyed_phrases(phrases: DataFrame, by: list[str]) -> DataFrame:
    """by, slop, n, w, p and the keys to look for, staged, one row a phrase; p: equal for equal phrases. phrases: of phrase_words or
    phrase_table."""
    if "w" not in phrases.columns:
        rows = phrases.groupBy(*by, "slop", "n").agg(F.array_sort(F.collect_list(F.struct("qpos", "token"))).alias("w"))
        phrases = rows.withColumn("w", F.col("w")["token"])
    return staged(phrase_finder.keyed(phrases.select(*by, "slop", "n", "w")), "phrases")


def found_phrases(posts: DataFrame, own: DataFrame) -> DataFrame:
    """id, field, p of the phrases p found. posts: of postings or texts; own: of keyed_phrases."""
    if "w" in posts.columns:
        hashed = posts.select("id", "field", F.transform("w", lambda x: F.xxhash64(x)).alias("h"), F.lit(None).cast("array<long>").alias("pos"))
    else:
        rows = posts.groupBy("id", "field").agg(F.array_sort(F.collect_set(F.struct(F.col("pos").cast("long").alias("pos"), F.xxhash64("token").alias("h")))).alias("_w"))
        hashed = rows.select("id", "field", F.col("_w")["h"].alias("h"), F.col("_w")["pos"].alias("pos"))
    return phrase_finder.found(hashed, own)


def _found(posts: DataFrame, phrases: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    own = keyed_phrases(phrases, by)
    return own, found_phrases(posts, own)


def phrase_hits(posts: DataFrame, phrases: DataFrame, by: list[str]) -> DataFrame:
    """by, id, field, once for each phrase (one value of by) found in a field: all tokens at one offset or, with slop, within slop
    positions of it."""
    own, hits = _found(posts, phrases, by)
    return hits.join(small(own.select(*by, "p"), TERMS), "p").select(*by, "id", "field")


def scored(posts: DataFrame, own: DataFrame, hits: DataFrame, by: list[str], boosts: dict[str, float] | None = None) -> DataFrame:
    """by, id, score of hits (by, id, field, p): as scored_hits. own: of keyed_phrases, those that have hits at least."""
    words = own.select("p", F.explode("w").alias("token"))
    weight = small(staged(weights(posts, words), "weights"), TERMS)
    worth = own.dropDuplicates(["p"]).select("p", F.explode("w").alias("token")).join(weight, "token").groupBy("p", "field").agg(F.sum("weight").alias("_w"))
    boost = F.lit(1.0)
    for field, value in (boosts or {}).items():
        boost = F.when(F.col("field") == field, value).otherwise(boost)
    return hits.join(worth, ["p", "field"]).groupBy(*by, "id").agg(F.max(F.col("_w") * boost).alias("score"))


def scored_hits(posts: DataFrame, phrases: DataFrame, by: list[str], boosts: dict[str, float] | None = None) -> DataFrame:
    """by, id, score: the best field's sum of the weights of a phrase's tokens, times the field's boost."""
    own, hits = _found(posts, phrases, by)
    best = scored(posts, own, hits, ["p"], boosts)
    return best.join(small(own.select(*by, "p"), TERMS), "p").select(*by, "id", "score")


def slop_of(n: int) -> int:
    return min(n // SLOP_EVERY, SLOP_MOST)


def cuts(tokens: list[str], clauses: int = 3) -> list[int]:
    """Where a query of these tokens is cut in two, the middle first and then outwards by turns, until there are 18 - 0.9 n clauses
    with the ones before; not before a particle."""
    n, out = len(tokens), []
    middle = n // 2
    order = [middle] + [c for k in range(1, middle + 1) for c in (middle - k, middle + k)]
    for c in order if n > 1 else []:
        if clauses + len(out) >= 18 - 0.9 * n:
            break
        if 0 < c < n and tokens[c] not in PARTICLES:
            out.append(c)
    return out


@dataclass(frozen=True)
class Clause:
    """One way to match: all phrases must be found, and the sum of their scores is boosted. scope names the fields it looks at."""

    scope: str
    phrases: tuple[str, ...]
    slop: int
    boost: float


def plan(text: str, tokens: list[str], joiner: str = "་") -> list[Clause]:
    """The clauses of a query: the full phrase in a record's fields, in its segments, in its chunks, and its cuts in two. No tokens, no
    clauses: everything matches."""
    if not tokens:
        return []
    slop = slop_of(len(tokens))
    halves = [(joiner.join(tokens[:c]), joiner.join(tokens[c:])) for c in cuts(tokens)]
    return [Clause("top", (text,), slop, FULL), Clause("segments", (text,), slop, 1.0), Clause("chunks", (text,), 0, 1.0), *(Clause("top", h, 0, SPLIT) for h in halves)]


def search(spark: SparkSession, posts: dict[str, DataFrame], clauses: list[Clause], boosts: dict[str, float], size: int = 20, analyzer: str = "words") -> DataFrame:
    """id, score: the best clause's score, highest first, ties by id; size rows. posts: postings by scope."""
    rows = [(k, p, c.scope, c.slop, c.boost, len(c.phrases), phrase) for k, c in enumerate(clauses) for p, phrase in enumerate(c.phrases)]
    table = spark.createDataFrame(rows, "clause int, part int, scope string, slop int, boost double, parts int, phrase string")
    phrases = phrase_words(table, "phrase", analyzer)
    out = None
    for scope in sorted({c.scope for c in clauses} & set(posts)):
        own = phrases.where(F.col("scope") == scope)
        hits = scored_hits(posts[scope], own, ["clause", "part", "boost", "parts"], boosts)
        whole = hits.groupBy("clause", "id", "boost", "parts").agg(F.count("*").alias("_n"), F.sum("score").alias("_s")).where("_n = parts")
        best = whole.select("id", (F.col("_s") * F.col("boost")).alias("score"))
        out = best if out is None else out.unionByName(best)
    return out.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(size)


def highlighted(text: Column, phrases: list[str], before: str = "<em>", after: str = "</em>") -> Column:
    """text with literal phrases marked, the longest first."""
    for phrase in sorted(phrases, key=len, reverse=True):
        literal = "".join(f"\\{c}" if not c.isalnum() and not c.isspace() else c for c in phrase)
        text = F.regexp_replace(text, f"({literal})", f"{before}$1{after}")
    return text
