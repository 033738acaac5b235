"""Scalar functions on texts: tokens, shingles, chunks, samples, distances, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Syllable marks, and the marks and spaces at which queries are split.
SYLLABLE_MARKS = "་།"
QUERY_MARKS = "་༌༔"
BLANK = r"^\s*$"


def syllables(text: Column) -> Column:
    """Tokens between syllable marks; blank parts are dropped."""
    return F.filter(F.split(text, f"[{SYLLABLE_MARKS}]+"), lambda x: ~x.rlike(BLANK))


def words(text: Column) -> Column:
    """Tokens between white space and syllable marks, for texts in any script."""
    return F.filter(F.split(text, rf"[{SYLLABLE_MARKS}\s]+"), lambda x: x != "")


def query_tokens(text: Column) -> Column:
    return F.filter(F.split(text, rf"[{QUERY_MARKS}\s]+"), lambda x: x != "")


def shingles(tokens: Column, size: int) -> Column:
    """Distinct token n-grams joined by "_"; fewer tokens than size make one shingle, none make none. tokens must be a column
    of the input, not an expression, or it is evaluated for each position."""
    if size <= 0:
        raise ValueError("a shingle has one token at least")
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size(tokens) - size, F.lit(0))), lambda i: F.array_join(F.slice(tokens, i + 1, F.lit(size)), "_"))
    return F.when(F.size(tokens) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def jaccard(common: Column, left: Column, right: Column) -> Column:
    """Jaccard similarity from sizes; 0 if either set is empty."""
    return F.when((left == 0) | (right == 0), F.lit(0.0)).otherwise(common / (left + right - common))


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 for empty vectors or ones of unequal length."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.lit(0.0))


def l2_normalised(v: Column) -> Column:
    """v over its length; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def chunk_bounds(length: Column, chunks: int) -> Column:
    """array<struct<i, lo, hi>> of min(chunks, length) equal parts of a token list; halves round to even."""
    k = F.least(F.lit(chunks), length)
    at = lambda i: F.bround(i * length / k).cast("int")
    bounds = F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), lambda i: F.struct(i.cast("int").alias("i"), at(i).alias("lo"), at(i + 1).alias("hi")))
    return F.when(length > 0, bounds).otherwise(F.array().cast("array<struct<i:int,lo:int,hi:int>>"))


def stripped(text: Column) -> Column:
    """text without white space at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def samples(text: Column, size: int = 200) -> Column:
    """struct<beginning, middle, end> of the stripped text: short texts are all beginning, and a middle needs twice the size."""

    def cuts(t: Column) -> Column:
        n = F.length(t)
        cut = lambda start: F.substring(t, start + 1, F.lit(size))
        return F.struct(
            F.when(n > 0, F.substring(t, 1, size)).alias("beginning"),
            F.when(n > 2 * size, cut(F.floor((n - size) / 2).cast("int"))).alias("middle"),
            F.when(n > size, cut(n - size)).alias("end"),
        )

    # bound to a lambda's variable, so that the text is made and stripped once
    return F.get(F.transform(F.transform(F.array(text), stripped), cuts), F.lit(0))


def span(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] in code points."""
    return F.when(end > start, F.substring(text, start + 1, end - start)).otherwise(F.lit(""))


def edit_similarity(a: Column, b: Column) -> Column:
    """struct<distance, similarity, length_ratio, char_jaccard>: Levenshtein distance, 1 - distance / mean length, and the Jaccard
    similarity of the sets of characters."""
    mean = (F.length(a) + F.length(b)) / 2
    distance = F.levenshtein(a, b)
    chars = lambda t: F.array_distinct(F.filter(F.split(t, ""), lambda c: c != ""))
    both, either = F.size(F.array_intersect(chars(a), chars(b))), F.size(F.array_union(chars(a), chars(b)))
    return F.struct(
        distance.alias("distance"),
        F.when(mean > 0, 1 - distance / mean).otherwise(1.0).alias("similarity"),
        F.when(F.greatest(F.length(a), F.length(b)) > 0, F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))).otherwise(1.0).alias("length_ratio"),
        F.when(either > 0, both / either).otherwise(0.0).alias("char_jaccard"),
    )


def without_affixes(text: Column, prefixes: list[str], suffixes: list[str]) -> Column:
    """text without one honorific prefix and one suffix, the longest that fits, and without spaces at its ends."""
    literal = lambda s: "".join(f"\\{c}" if not c.isalnum() and not c.isspace() else c for c in s)
    alternatives = lambda xs: "|".join(map(literal, sorted(xs, key=lambda x: (-len(x), x))))
    if prefixes:
        text = F.regexp_replace(text, f"^(?:{alternatives(prefixes)})", "")
    if suffixes:
        text = F.regexp_replace(text, f"(?:{alternatives(suffixes)})$", "")
    return F.trim(text)


def hash_prefix(key: Column, digits: int = 2) -> Column:
    """The first digits of a key's MD5, under which its folder stands."""
    return F.substring(F.md5(key.cast("binary")), 1, digits)


def without_surrogates(text: Column) -> Column:
    return F.regexp_replace(text, r"[\ud800-\udfff]", "")


def local_name(uri: Column) -> Column:
    """What follows the last / or # of a URI."""
    return F.regexp_extract(uri, r"([^/#]*)$", 1)


def record_type(record_id: Column) -> Column:
    return F.when(record_id.startswith("W"), "work").when(record_id.startswith("P"), "person").otherwise("unknown")


def coordinate(text: Column) -> Column:
    """struct<volume int, milestone string> of "1#D1"; null where there is no number or no mark."""
    parts = F.split(F.trim(text), "#", 2)
    number = F.get(parts, F.lit(0)).try_cast("int")
    return F.when(number.isNotNull() & (F.size(parts) == 2) & (F.get(parts, F.lit(1)) != ""), F.struct(number.alias("volume"), F.trim(F.get(parts, F.lit(1))).alias("milestone")))


def compared(text: Column) -> Column:
    """text for comparison: without byte-order mark, runs of spaces and of line ends made one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "﻿", ""), r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def volume_id(rep: Column, vol: Column, version: Column, source: Column) -> Column:
    return F.concat_ws("_", rep, vol, version, source)


def ocr_key(rep: Column, vol: Column, version: Column, source: Column) -> Column:
    """The object key of a volume's OCR file, by the three conventions of its source."""
    folder = F.concat_ws("/", rep, vol, version)
    books = F.concat(F.lit("google_books/"), folder, F.lit("/"), F.concat_ws("_", rep, vol, version, F.lit("gb.parquet")))
    vision = F.concat(F.lit("gv/"), folder, F.lit("/"), F.concat_ws("-", rep, vol, version, F.lit("gv.parquet")))
    short = F.when(source == "ocrv1-ws-ldv1", "ocrv1").otherwise(source)
    other = F.concat(source, F.lit("/"), folder, F.lit("/"), F.concat_ws("-", rep, vol, version), F.lit("_"), short, F.lit(".parquet"))
    return F.when(source == "google_books", books).when(source == "google_vision", vision).otherwise(other)


def image_folder(rep: Column, group: Column) -> Column:
    """The folder of a volume's images; I and four digits lose the I."""
    suffix = F.when(group.rlike(r"^I\d{4}$"), F.substring(group, 2, 4)).otherwise(group)
    return F.concat(F.lit("Works/"), hash_prefix(rep), F.lit("/"), rep, F.lit("/images/"), rep, F.lit("-"), suffix, F.lit("/"))


def etag_prefix(etag: Column) -> Column:
    return F.substring(F.lower(F.hex(etag)), 1, 6)
