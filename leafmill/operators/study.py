"""Studies of near-duplicate data: ground truth joined to the corpus, pairs within groups, Jaccard by shingle size, two candidate lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import dedup as D

MOST_PAIRS, CHECKED = 30, 5
STRONG, PARTIAL = 0.5, 0.2


def _counts(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))


def summary(rows: DataFrame, value: str, by: list[str], shares: dict[str, float] | None = None) -> DataFrame:
    """by, n, mean, median, least, most and a column for each of shares: the value at place floor(share * n) of the sorted ones, not
    interpolated. An even number's median is the mean of the middle two. Nulls do not count, and groups of them have no row.

    Equal values are counted first, so a group sends each of its different values once; places are then told by running counts."""
    shares = {"p10": 0.10, "p95": 0.95} if shares is None else shares
    counted = _counts(rows, by, value)
    order = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_end", F.sum("_c").over(order)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    at = lambda place: F.max(F.when((place >= F.col("_end") - F.col("_c")) & (place < F.col("_end")), F.col("_v")))
    n = F.col("_n")
    middle = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
    own = [at(F.least(F.floor(n * F.lit(s)), n - 1)).alias(name) for name, s in shares.items()]
    mean = F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")
    return placed.groupBy(*by).agg(F.sum("_c").alias("n"), mean.alias("mean"), middle.alias("median"), F.min("_v").alias("least"), F.max("_v").alias("most"), *own)


def strengths(rows: DataFrame, score: str, by: list[str]) -> DataFrame:
    """by, strong, partial, weak: rows with scores of 0.5 or more, of 0.2 or more, and below; nulls count nowhere."""
    s = F.col(score)
    return rows.groupBy(*by).agg(F.count_if(s >= STRONG).alias("strong"), F.count_if((s >= PARTIAL) & (s < STRONG)).alias("partial"), F.count_if(s < PARTIAL).alias("weak"))


def ground_truth_corpus(truth: DataFrame, texts: DataFrame, in_index: bool = True, with_text: bool = True) -> DataFrame:
    """mw_id, d_id, rkts_id, text_bo, wa_id_orig, title_bo, etext_source, text_length of ground-truth rows, in_index: those only that texts
    (TEXTS) hold. Without an index no text is known; texts left out are "", and the length is then the stored one, if any."""
    # The columns of a document of the evaluation.
    known = ["wa_id_orig", "title_bo", "etext_source"]
    if in_index:
        found = truth.join(texts.select("mw_id", "text_bo", "text_length", *known), "mw_id")
    else:
        found = truth.select("*", *(F.lit(None).cast("string").alias(c) for c in ("text_bo", *known)), F.lit(None).cast("int").alias("text_length"))
    body = F.coalesce("text_bo", F.lit("")) if with_text else F.lit("")
    length = F.coalesce(F.nullif("text_length", F.lit(0)), F.length(body))
    return found.select("mw_id", "d_id", "rkts_id", body.alias("text_bo"), *known, length.alias("text_length"))


def titled(texts: DataFrame, truth: DataFrame, source: str = "tei") -> DataFrame:
    """d_id, mw_id: texts of a source whose title is one of the ground truth's d_ids."""
    asked = truth.select("d_id").where(F.col("d_id").isNotNull()).distinct()
    return texts.where(F.col("etext_source") == source).select(F.col("title_bo").alias("d_id"), "mw_id").join(asked, "d_id")


def group_pairs(members: DataFrame, most: int = MOST_PAIRS, seed: int = 42) -> DataFrame:
    """group, a < b: up to `most` pairs of each group (group, id), all if there are no more, else a sample by seeded hashes; reruns agree.

    The 2 * most members of least hash stand for a larger group, so no group's pairs are all made; what Spark keeps of a group
    is limited before the shuffle. Repeated rows count once, null groups are none."""
    mark = lambda *c: F.md5(F.concat_ws(":", F.lit(seed), *(F.col(x).cast("string") for x in c)))
    one = members.select("group", "id").where(F.col("group").isNotNull() & F.col("id").isNotNull()).distinct()
    kept = one.withColumn("_r", F.row_number().over(Window.partitionBy("group").orderBy(mark("id"), "id"))).where(F.col("_r") <= 2 * most).select("group", "id")
    pairs = kept.select("group", F.col("id").alias("a")).join(kept.select("group", F.col("id").alias("b")), "group").where("a < b")
    order = Window.partitionBy("group").orderBy(mark("a", "b"), "a", "b")
    return pairs.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select("group", "a", "b")


def pair_kind(a: Column, b: Column) -> Column:
    """The two sources in order, joined by "-"; unknown if there is none."""
    both = F.array_sort(F.array(F.coalesce(a, F.lit("unknown")), F.coalesce(b, F.lit("unknown"))))
    return F.array_join(both, "-")


def pair_jaccard(pairs: DataFrame, docs: DataFrame, sizes: list[int], source: str = "source") -> DataFrame:
    """a, b, kind, size, jaccard, len_ratio, char_jaccard: exact Jaccard similarity of the given pairs (a, b) by shingle size, the shorter
    text's share of the longer, and the Jaccard similarity of the sets of characters. docs: doc_id, text, source. Two empty
    sets are similar by 0. Each pair is worked out in its own row."""
    words = lambda c: T.words(F.lower(F.coalesce(c, F.lit(""))))
    side = lambda x: docs.select(F.col("doc_id").alias(x), F.coalesce("text", F.lit("")).alias(f"t{x}"), words("text").alias(f"w{x}"), F.col(source).alias(f"s{x}"))
    both = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")

    def similar(left: Column, right: Column) -> Column:
        union = F.size(F.array_union(left, right))
        return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(0.0)

    sized = both.withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
    value = F.lit(0.0)
    for size in sizes:
        value = F.when(F.col("size") == size, similar(T.shingles(F.col("wa"), size), T.shingles(F.col("wb"), size))).otherwise(value)
    longest = F.greatest(F.length("ta"), F.length("tb"))
    ratio = F.when(longest > 0, F.least(F.length("ta"), F.length("tb")) / longest).otherwise(0.0)
    letters = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    return sized.select("a", "b", pair_kind(F.col("sa"), F.col("sb")).alias("kind"), "size", value.alias("jaccard"), ratio.alias("len_ratio"), similar(letters(F.col("ta")), letters(F.col("tb"))).alias("char_jaccard"))


def baseline(scores: DataFrame, buckets: int = D.BUCKETS) -> DataFrame:
    """kind, size, n, mean, median, least, most, p10, msm_least, msm_p10 of pair_jaccard's rows by kind of pair and for all pairs (kind
    "all"): what least overlap of `buckets` hashes the worst pair, and nine in ten pairs, would pass."""
    every = scores.unionByName(scores.withColumn("kind", F.lit("all")))
    found = summary(every, "jaccard", ["kind", "size"], {"p10": 0.10})
    return found.withColumn("msm_least", F.floor(F.col("least") * buckets)).withColumn("msm_p10", F.floor(F.col("p10") * buckets))


def compared(asked: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """id, left, right, common, overlap for each of asked (id): how many candidates (src, dst) either side has, and the Jaccard similarity of
    the two lists, null where both are empty. Repeated candidates count once."""
    rows = left.select(F.col("src").alias("id"), "dst", F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(F.col("src").alias("id"), "dst", F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    each = rows.groupBy("id", "dst").agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    sums = each.groupBy("id").agg(F.sum("_l").alias("left"), F.sum("_r").alias("right"), F.sum(F.col("_l") * F.col("_r")).alias("common"), F.count("*").alias("_n"))
    out = asked.select("id").distinct().join(sums, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("id", zero("left"), zero("right"), zero("common"), (F.col("common") / F.col("_n")).alias("overlap"))


def candidate_quality(ranking: DataFrame, docs: DataFrame, size: int, source: str = "source") -> DataFrame:
    """n, mean, median, least, most, strong, partial, weak: exact Jaccard similarity of each query with its first candidates (src, rank, dst)."""
    first = ranking.where(F.col("rank") <= CHECKED).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    scores = pair_jaccard(first, docs, [size], source).select("a", "b", "jaccard")
    each = first.join(scores, ["a", "b"])
    every = each.withColumn("_k", F.lit(0))
    return summary(every, "jaccard", ["_k"], {}).join(strengths(every, "jaccard", ["_k"]), "_k").drop("_k")
