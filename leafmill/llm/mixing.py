"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only).

Sizes are summed by (source, hash bucket); running sums over the buckets give, for each source, the bucket in which its
budget ends; only that bucket is split again by the next bits of the hash, and documents are then filtered by comparing
their hash with the thresholds. Nothing is sorted but the histograms, whose size is sources x buckets. The thresholds of
smaller budgets are below those of larger ones, so the mixes are nested.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import staged, words_of

#: Levels of refinement and bits a level; the boundary of a source shrinks by 2**BITS at each level.
LEVELS, BITS = 3, 8
#: Thresholds are broadcast for up to so many sources.
BROADCAST_SOURCES = 100_000


def sized(docs: DataFrame) -> DataFrame:
    """docs with size (words; 0 for null texts) and h, the leading LEVELS * BITS bits of the hash of doc_id."""
    hexed = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, LEVELS * BITS // 4)
    return docs.withColumns({"size": F.size(words_of(F.col("text"))).cast("long"), "h": F.conv(hexed, 16, 10).cast("long")})


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target: weights repeat over the sources by code point (null last) and divide share x all
    sizes; a target stops at most x its source's size, and the excess is dealt again by weight until none is above.

    The fixed point is min(most x size, level x weight) with one level for all sources. In order of cap / weight the
    capped sources come first, so the level follows from running sums; rows here are sources, not documents."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = reduce(lambda rest, iw: F.when(F.col("_i") % len(weights) == iw[0], F.lit(float(iw[1]))).otherwise(rest), enumerate(weights), F.lit(None).cast("double"))
    ranked = per.withColumn("_i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("_w", w)
    ranked = ranked.withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "_i").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("_total", F.lit(float(share)) * F.sum("source_size").over(every)).withColumn("_all_w", F.sum("_w").over(every))
    # the level if all sources before this one are capped and this and the rest are not
    ranked = ranked.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.col("_all_w") - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    fits = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "_i", "_level"))).over(every)
    ranked = ranked.withColumn("_fit", fits)
    return ranked.select("source", "source_size", F.when(F.col("_fit").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_fit")["_level"] * F.col("_w"))).alias("target"))


def thresholds(base: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """_g (source), source_size, target, base, _edge, _part from base (source, size, h): base whole copies, then documents with
    hashes below _edge once more, and the part _part of those at it."""
    goal = targets(base, weights, share, most)
    goal = goal.withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = staged(goal.withColumn("_left", F.greatest(F.lit(0.0), F.col("target") - F.col("base") * F.col("source_size"))), "targets")
    cells = goal.select(F.col("source").alias("_s"), "source_size", "target", "base", "_left", F.lit(0).cast("long").alias("_prefix"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        hist = base.select("source", "size", F.shiftright("h", shift + BITS).alias("_p"), F.shiftright("h", shift).alias("_b"))
        inside = cells.select("_s", "_prefix", "_left", "source_size", "target", "base")
        hist = hist.join(inside, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_p") == F.col("_prefix")))
        hist = hist.groupBy("_s", "source_size", "target", "base", "_left", "_b").agg(F.sum("size").alias("_n"))
        run = Window.partitionBy("_s").orderBy("_b")
        hist = hist.withColumn("_upto", F.sum("_n").over(run))
        # the first bucket at which the running sum passes what is left; after the last bucket, none
        edge = F.min(F.when(F.col("_upto") > F.col("_left"), F.struct("_b", "_upto", "_n")))
        cells = hist.groupBy("_s", "source_size", "target", "base", "_left").agg(edge.alias("_e"))
        # a source without an edge has no words at all, and leaves
        cells = cells.where(F.col("_e").isNotNull())
        cells = cells.select("_s", "source_size", "target", "base", (F.col("_left") - (F.col("_e")["_upto"] - F.col("_e")["_n"])).alias("_left"), F.col("_e")["_b"].alias("_prefix"), F.col("_e")["_n"].alias("_n"))
    cut = cells.select(F.col("_s").alias("_s2"), F.col("_prefix").alias("_edge"), (F.col("_left") / F.col("_n")).alias("_part"))
    final = staged(goal.drop("_left").join(cut, F.col("source").eqNullSafe(F.col("_s2")), "left").withColumnRenamed("source", "_g"), "thresholds")
    return final


def _with(docs: DataFrame, final: DataFrame) -> DataFrame:
    few = final.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES  # beyond it, by a shuffle that splits hot sources
    return docs.join(F.broadcast(final) if few else final, F.col("source").eqNullSafe(F.col("_g")))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, base, taken.

    base whole copies of every document of a source are taken (0, 1 or 2: target // source_size); of what is left of the
    target, documents below the hash threshold give one more copy each. In the last boundary cell, of 2**-24 of a
    source's hashes, documents give the same part of a copy, so that a source meets its target but for rounding even
    if it is one document or many equal rows. Reruns agree: the hash is of doc_id alone.

    Nulls: a null text has size 0 and takes 0; a null source is a source of its own; a null doc_id hashes as an empty
    string. Empty tables give empty results. Other columns are not read. Repeated rows are documents of their own.
    """
    base = staged(sized(docs.select("doc_id", "source", "text")).drop("text"), "sizes")
    out = _with(base, thresholds(base, weights, share, most))
    more = F.when(F.col("h") < F.col("_edge"), F.col("size")).when(F.col("h") == F.col("_edge"), F.round(F.col("size") * F.col("_part")).cast("long")).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", "base", (F.col("base") * F.col("size") + F.coalesce(more, F.lit(0))).cast("long").alias("taken"))


def mixture(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of docs that the mix takes, as often as it takes them, with the columns of docs: documents in a boundary cell come
    once more if their part is a half or more. Rows without words are not taken. Otherwise as mix; the documents are
    not shuffled, as the thresholds come to them."""
    base = staged(sized(docs.select("doc_id", "source", "text")).drop("text"), "sizes")
    final = thresholds(base, weights, share, most)
    renamed = docs.select(*(F.col(c).alias(f"_in_{c}") for c in docs.columns))
    own = renamed.withColumns({"doc_id": F.col("_in_doc_id"), "source": F.col("_in_source"), "text": F.col("_in_text")})
    out = _with(sized(own), final)
    copies = F.col("base") + F.when((F.col("h") < F.col("_edge")) | ((F.col("h") == F.col("_edge")) & (F.col("_part") >= 0.5)), 1).otherwise(0)
    out = out.withColumn("_copies", F.when(F.col("size") > 0, copies).otherwise(0).cast("int")).where("_copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*(F.col(f"_in_{c}").alias(c) for c in docs.columns))
