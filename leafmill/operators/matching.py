"""Which works a text is of: samples of it as phrases against volumes' chunks and titles, grouped by work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import search as S
from leafmill.staging import at_most, small, staged

BOOSTS = {"beginning": 1.2, "middle": 1.0, "end": 1.0}
TITLE = 0.3
LEAST_SCORE = 5.0


def sample_phrases(texts: DataFrame, id: str, text: str) -> DataFrame:
    """query, sample, slop, phrase: up to three samples of each text."""
    s = texts.select(F.col(id).alias("query"), T.samples(F.col(text)).alias("_s"))
    rows = F.array(*(F.struct(F.lit(k).alias("sample"), F.col("_s")[k].alias("phrase")) for k in BOOSTS))
    return s.select("query", F.inline(rows)).where(F.col("phrase").isNotNull()).withColumn("slop", F.lit(0))


def volume_scores(texts: DataFrame, id: str, text: str, chunks: DataFrame, titles: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    """query, volume_id, score: for each sample the best of a volume's chunks, boosted, and its beginning in the titles, added up.
    chunks: texts or postings whose id is struct<volume_id, n>; a sample must be within one chunk. titles: the same by volume_id. own: the
    volumes (query, volume_id) that a query leaves out; they count for the weights of tokens all the same."""
    scores, queries = class_scores(texts, id, text, chunks, titles, own)
    rows = scores.join(queries, "c").select("query", "volume_id", "score")
    return rows if own is None else rows.join(own.select("query", "volume_id").distinct(), ["query", "volume_id"], "left_anti")


def class_scores(texts: DataFrame, id: str, text: str, chunks: DataFrame, titles: DataFrame | None = None, own: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """scores: c, volume_id, score, as volume_scores, for classes c of queries with equal samples; queries: c, query. The volumes of own are
    left out before scores are made where a class is one query, and are still there where it is several."""
    phrases = S.keyed_phrases(S.phrase_words(sample_phrases(texts, id, text)), ["query", "sample"])
    queries = staged(phrases.groupBy("query").agg(F.xxhash64(F.sort_array(F.collect_list(F.struct("sample", "p")))).alias("c")), "queries")
    single = queries.groupBy("c").agg(F.min("query").alias("query"), F.count("*").alias("_n")).where("_n = 1").select("c", "query")
    asked = staged(phrases.select("query", "sample", "p").join(queries, "query").select("c", "sample", "p").distinct(), "asked")
    left_out = None if own is None else staged(own.select("query", "volume_id").distinct().join(single, "query").select("c", "volume_id"), "own")

    def scored(posts: DataFrame, wanted: DataFrame, sought: DataFrame, volume: Column) -> DataFrame:
        rows = S.found_phrases(posts, sought).join(small(wanted, S.TERMS), "p").select("c", "sample", "p", "id", "field")
        if left_out is not None:
            rows = rows.withColumn("volume_id", volume).join(small(left_out, S.TERMS), ["c", "volume_id"], "left_anti").drop("volume_id")
        rows = staged(rows, "hits")
        with_hits = staged(sought.select("p", "w").dropDuplicates(["p"]).join(small(rows.select("p").distinct(), S.TERMS), "p", "left_semi"), "found")
        return S.scored(posts, with_hits, rows, ["c", "sample"]).withColumn("volume_id", volume)

    boost = F.lit(1.0)
    for sample, value in BOOSTS.items():
        boost = F.when(F.col("sample") == sample, value).otherwise(boost)
    hits = scored(chunks, asked, phrases, F.col("id")["volume_id"])
    parts = hits.groupBy("c", "sample", "volume_id").agg((F.max("score") * F.first(boost)).alias("score"))
    if titles is not None and not at_most(titles, 0):
        first = "sample = 'beginning'"
        named = scored(titles, asked.where(first), phrases.where(first), F.col("id"))
        parts = parts.unionByName(named.select("c", "sample", "volume_id", (F.col("score") * TITLE).alias("score")))
    return parts.groupBy("c", "volume_id").agg(F.sum("score").alias("score")), queries


def volume_postings(volumes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tokens of volumes' (VOLUMES) chunks, by struct<volume_id, n>, and of the titles of their segments, by volume."""
    chunks = volumes.select("id", F.posexplode("chunks").alias("n", "_c")).select(F.struct(F.col("id").alias("volume_id"), "n").alias("place"), F.col("_c")["text_bo"].alias("text"))
    titles = volumes.select("id", F.flatten(F.transform("segments", lambda s: F.coalesce(s["title_bo"], F.array().cast("array<string>")))).alias("title"))
    return S.texts(chunks, "place", ["text"]), S.texts(titles, "id", ["title"])


def segment_texts(volumes: DataFrame) -> DataFrame:
    """query, volume_id, segment_idx, wa_id, mw_id, title, cstart, cend, text of volumes' segments, each with its own work or else its
    volume's. A volume without segments is one, from its first chunk to its last. Empty spans and blank texts go."""
    from leafmill.operators.ingest import span_text

    whole = F.struct(F.lit(0).alias("idx"), F.col("wa_id").alias("wa_id"), F.col("mw_id").alias("mw_id"), F.lit(None).cast("string").alias("title"), F.lit(0).alias("cstart"), F.array_max(F.transform("chunks", lambda c: c["cend"])).alias("cend"))
    one = lambda s, k: F.struct(k.alias("idx"), F.coalesce(F.nullif(s["wa_id"], F.lit("")), F.col("wa_id")).alias("wa_id"), s["mw_id"].alias("mw_id"), F.get(s["title_bo"], F.lit(0)).alias("title"), F.coalesce(s["cstart"], F.lit(0)).alias("cstart"), F.coalesce(s["cend"], F.lit(0)).alias("cend"))
    parts = F.when(F.coalesce(F.size("segments"), F.lit(0)) > 0, F.transform("segments", one)).otherwise(F.array(whole))
    rows = volumes.select(F.col("id").alias("volume_id"), "chunks", F.explode(parts).alias("_s")).where("_s.cend > _s.cstart")
    out = rows.select(F.concat_ws("#", "volume_id", F.col("_s")["idx"].cast("string")).alias("query"), "volume_id", F.col("_s")["idx"].alias("segment_idx"), *(F.col("_s")[c].alias(c) for c in ("wa_id", "mw_id", "title", "cstart", "cend")), span_text(F.col("chunks"), F.col("_s")["cstart"], F.col("_s")["cend"]).alias("text"))
    return out.where(F.col("text").rlike(r"\S"))


def reference_texts(refs: DataFrame, volumes: DataFrame) -> DataFrame:
    """query, volume_id, text, fault of references (query, volume_id, cstart, cend): the span's text, or why there is none: the volume is
    unknown, it has no chunks, or the span has no text."""
    from leafmill.operators.ingest import span_text

    held = refs.join(volumes.select(F.col("id").alias("volume_id"), "chunks", F.lit(True).alias("_known")), "volume_id", "left")
    text = span_text(F.col("chunks"), F.col("cstart"), F.col("cend"))
    rows = held.select("query", "volume_id", F.coalesce(text, F.lit("")).alias("text"), "_known", F.coalesce(F.size("chunks"), F.lit(0)).alias("_n"))
    fault = F.when(F.col("_known").isNull(), "no volume").when(F.col("_n") < 1, "no chunks").when(F.length(T.stripped(F.col("text"))) == 0, "no text")
    return rows.select("query", "volume_id", "text", fault.alias("fault"))


def find_by_reference(refs: DataFrame, volumes: DataFrame, k: int = 20) -> DataFrame:
    """As candidates, for spans of volumes (query, volume_id, cstart, cend) without the span's own volume. References at fault find
    nothing; reference_texts names their faults."""
    asked = reference_texts(refs, volumes).where(F.col("fault").isNull())
    chunks, titles = volume_postings(volumes)
    scores = volume_scores(asked, "query", "text", chunks, titles, own=asked).withColumn("score", F.round("score", 9))
    return candidates(scores, works_of(volumes), k)


def works_of(volumes: DataFrame) -> DataFrame:
    """volume_id, wa_id, title: the works of volumes' segments, and those of volumes themselves."""
    inner = volumes.select(F.col("id").alias("volume_id"), F.explode("segments").alias("_s")).select("volume_id", F.col("_s")["wa_id"].alias("wa_id"), F.get(F.col("_s")["title_bo"], F.lit(0)).alias("title"))
    own = volumes.select(F.col("id").alias("volume_id"), "wa_id", F.lit(None).cast("string").alias("title"))
    return inner.unionByName(own).where("coalesce(wa_id, '') <> ''")


def segment_duplicates(volumes: DataFrame, least: float = LEAST_SCORE, k: int = 10) -> DataFrame:
    """volume_id, segment_idx, source_wa, mw_id, title, match_volume, match_wa, score, classification: for each segment the k best other
    volumes of a score of `least` or more, once for each of their works, or with a null work for a volume without any."""
    from leafmill.operators.dedup import top_k

    segments = segment_texts(volumes)
    chunks, titles = volume_postings(volumes)
    scores, queries = class_scores(segments, "query", "text", chunks, titles, own=segments)
    # a segment leaves out its own volume only, so that of equal segments k + 1 volumes are enough
    few = top_k(scores.withColumn("score", F.round("score", 9)), "c", F.col("score"), "volume_id", k + 1).where(F.col("score") >= least)
    mine = segments.select("query", "volume_id").distinct()
    rows = few.join(queries, "c").select("query", "volume_id", "score").join(mine, ["query", "volume_id"], "left_anti")
    best = top_k(rows, "query", F.col("score"), "volume_id", k)
    matched = best.select("query", F.col("volume_id").alias("match_volume"), F.round("score", 3).alias("score"))
    works = works_of(volumes).select(F.col("volume_id").alias("match_volume"), F.col("wa_id").alias("match_wa")).distinct()
    source = segments.select("query", "volume_id", "segment_idx", F.col("wa_id").alias("source_wa"), "mw_id", "title")
    rows = matched.join(works, "match_volume", "left").join(source, "query")
    return classified(rows, 0.0).select("volume_id", "segment_idx", "source_wa", "mw_id", "title", "match_volume", "match_wa", "score", "classification")


def candidates(scores: DataFrame, segments: DataFrame, k: int = 20) -> DataFrame:
    """query, rank, wa_id, score, volumes, title: matched volumes by the works of their segments (volume_id, wa_id, title): the best score,
    the volumes in order, the first title by volume; the k best works of each query."""
    from leafmill.operators.dedup import top_k

    rows = scores.join(segments.where(F.col("wa_id").isNotNull()), "volume_id")
    grouped = rows.groupBy("query", "wa_id").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("volume_id")).alias("volumes"), F.min_by("title", F.when(F.col("title").isNotNull(), F.col("volume_id"))).alias("title"))
    return top_k(grouped, "query", F.col("score"), "wa_id", k)


def resolved(found: DataFrame, works: DataFrame, persons: DataFrame) -> DataFrame:
    """found with the work's label where there was no title, and its authors' names."""
    from leafmill.operators.catalog import with_authors

    names = with_authors(works, persons).withColumnRenamed("id", "wa_id")
    labels = works.select(F.col("id").alias("wa_id"), F.col("pref_label_bo").alias("_l"))
    return found.join(labels, "wa_id", "left").join(names, "wa_id", "left").withColumn("title", F.coalesce("title", "_l")).drop("_l")


def classified(matches: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """matches (source_wa, match_wa, score) of `least` or more: the same work confirms a duplicate, another proposes a merge."""
    kind = F.when(F.col("source_wa") == F.col("match_wa"), "confirm_duplicate").otherwise("propose_merge")
    return matches.where(F.col("score") >= least).withColumn("classification", kind)
