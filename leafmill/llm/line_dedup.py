"""Site-relative line dedup: lines that stand on too large a part of a site's pages go (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import staged

BLANK = r"^[\x20\x09-\x0D]*$"


def boilerplate_lines(docs: DataFrame, site: Column, max_ratio: float, copies_once: bool) -> DataFrame:
    """_site, _line (md5), pages, site_pages, ratio of the lines to drop. A line counts once a page. With copies_once, pages with
    equal texts on one site count as one."""
    pages = docs.select(site.alias("_site"), F.coalesce("text", F.lit("")).alias("_text"))
    # lines travel as hashes, and are counted before the shuffle
    hashed = F.array_distinct(F.transform(F.filter(F.split("_text", "\n"), lambda x: ~x.rlike(BLANK)), lambda x: F.md5(F.trim(x))))
    key = [F.unhex(F.md5("_text")).alias("_key")] if copies_once else []
    lines = pages.select("_site", *key, F.explode(hashed).alias("_l")).select("_site", F.unhex("_l").alias("_line"), *(["_key"] if copies_once else []))
    number = F.count_distinct("_key") if copies_once else F.count("*")
    per_line = lines.groupBy("_site", "_line").agg(number.alias("pages")).where("pages >= 2")
    totals = pages.select(F.col("_site").alias("_site2"), *key).groupBy("_site2").agg(number.alias("site_pages"))
    found = per_line.join(totals, F.col("_site").eqNullSafe(F.col("_site2"))).withColumn("ratio", F.col("pages") / F.col("site_pages"))
    return found.where(F.col("ratio") > max_ratio).drop("_site2")


#: The per-site lists of dropped lines are broadcast up to this many bytes; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 8 << 20


def line_dedup(docs: DataFrame, site: Column | None = None, max_ratio: float = 0.1, copies_once: bool = False) -> DataFrame:
    """All columns of docs, with text (and n_chars, where there is one) without the lines that stand on more than max_ratio of
    their site's pages, and n_lines and n_dropped (lines before, lines dropped). A line on a single page is no boilerplate,
    however few pages the site has. With copies_once, pages with equal texts count as one, on both sides of the ratio, so that
    a large group of copies does not make its own lines boilerplate.

    site: by default the column source. A list of a site's dropped lines has at most lines-a-page / max_ratio entries, so
    it is collected per site; whole sites never are. Blank lines stay. Lines are compared without the spaces around them.

    Nulls: a null text stays null with 0 lines, and its page counts as an empty one; a null site is a site of its own.
    Empty and one-line texts, repeated rows and extra columns pass; columns named n_lines or n_dropped are replaced.
    """
    site = F.col("source") if site is None else site
    drop = boilerplate_lines(docs, site, max_ratio, copies_once)
    drop = staged(drop.groupBy("_site").agg(F.collect_set(F.hex("_line")).alias("_drop")), "boilerplate")
    size = drop.agg(F.coalesce(F.sum(F.size("_drop") * 64 + 64), F.lit(0))).first()[0]
    drop = F.broadcast(drop) if size <= BROADCAST_BYTES else drop
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # the row travels as one column, so that no name of its own meets one of those here
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), site.alias("_own_site")).join(drop, F.col("_own_site").eqNullSafe(F.col("_site")), "left")
    own_text = F.col("_row").getField("text")
    df = df.withColumn("_all", F.split(F.coalesce(own_text, F.lit("")), "\n"))
    kept = F.filter("_all", lambda x: x.rlike(BLANK) | ~F.array_contains(F.col("_drop"), F.upper(F.md5(F.trim(x)))))
    df = df.withColumn("_left", F.when(F.col("_drop").isNull(), F.col("_all")).otherwise(kept))
    text = F.when(own_text.isNotNull(), F.array_join("_left", "\n"))
    changed = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    n_lines = F.when(own_text.isNull(), 0).otherwise(F.size("_all")).cast("long").alias("n_lines")
    n_dropped = (F.size("_all") - F.size("_left")).cast("long").alias("n_dropped")
    return df.select(*((changed[c] if c in changed else F.col("_row").getField(c)).alias(c) for c in names), n_lines, n_dropped)
