"""Quality rules: counts over whole texts and Jensen-Shannon distance from language references (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import WORD_SPLIT, staged, words_of

# The commonest function words of each language, lower case.
COMMON_WORDS = {
    "en": "the of and to a in is it that was for on are with as be at by this from or an not".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur".split(),
}
#: Character classes, in the order in which they are taken out of a text: name and pattern. What is left is "other".
CLASSES = (("lower", "[a-z]+"), ("space", WORD_SPLIT), ("symbol", "[#*$%&|<>]+"), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("point", "[.,;:!?'\"()-]+"))
#: Bits of a window's place in its sort key; the other 39 are of its hash.
INDEX_BITS = 24


def _repeated(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words to rows with words and n_words: words in 3-word windows found twice or more, first included.

    Each window becomes a long of 39 hash bits and its place; sorting these finds the windows whose hash bits another one has.
    Those alone are then sorted by their three words, so that equal ones are neighbours whatever their hashes. Texts with more
    windows than places have bits for are sorted by words at once."""
    pick = lambda i: F.get(F.col("words"), i)
    none = F.array().cast("array<int>")
    windows = F.col("n_words") - 2
    few = windows <= (1 << INDEX_BITS)
    key = lambda i: F.shiftleft(F.xxhash64(pick(i), pick(i + 1), pick(i + 2)).bitwiseAND((1 << (63 - INDEX_BITS)) - 1), INDEX_BITS).bitwiseOR(i.cast("long"))
    every = F.sequence(F.lit(0), F.greatest(windows.cast("int") - 1, F.lit(0)))
    df = df.withColumn("_keys", F.sort_array(F.when((windows >= 1) & few, F.transform(every, key)).otherwise(F.array().cast("array<bigint>"))))
    at = lambda j: F.get(F.col("_keys"), j)
    place = lambda j: at(j).bitwiseAND((1 << INDEX_BITS) - 1).cast("int")
    after = lambda name: F.sequence(F.lit(1), F.greatest(F.size(name) - 1, F.lit(1)))
    pairs = F.when(F.size("_keys") > 1, F.filter(after("_keys"), lambda j: F.shiftright(at(j), INDEX_BITS) == F.shiftright(at(j - 1), INDEX_BITS))).otherwise(none)
    df = df.withColumn("_pairs", pairs)
    alike = F.array_distinct(F.concat(F.transform("_pairs", place), F.transform("_pairs", lambda j: place(j - 1))))
    alike = F.when(~few, every).when(F.size("_pairs") > 0, alike).otherwise(none)
    df = df.withColumn("_texts", F.sort_array(F.transform(alike, lambda i: F.struct(pick(i).alias("a"), pick(i + 1).alias("b"), pick(i + 2).alias("c"), i.alias("p")))))
    text = lambda j: F.get(F.col("_texts"), j)
    same = lambda j: (text(j)["a"] == text(j - 1)["a"]) & (text(j)["b"] == text(j - 1)["b"]) & (text(j)["c"] == text(j - 1)["c"])
    df = df.withColumn("_equal", F.when(F.size("_texts") > 1, F.filter(after("_texts"), same)).otherwise(none))
    starts = F.sort_array(F.array_distinct(F.concat(F.transform("_equal", lambda j: text(j)["p"]), F.transform("_equal", lambda j: text(j - 1)["p"]))))
    df = df.withColumn("_starts", F.when(F.size("_equal") > 0, starts).otherwise(none))
    covered = F.aggregate("_starts", F.struct(F.lit(-3).alias("p"), F.lit(0).cast("long").alias("n")), lambda acc, p: F.struct(p.alias("p"), (acc["n"] + F.least(F.lit(3), p - acc["p"])).cast("long").alias("n")), lambda acc: acc["n"])
    return df.withColumn("n_repeat_words", covered).drop("_keys", "_pairs", "_texts", "_equal", "_starts")


def counts(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, lang and the counts that the rules need; the texts are read once."""
    df = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("_t0"))
    left = []
    for k, (_, pattern) in enumerate(CLASSES):
        df = df.withColumn(f"_t{k + 1}", F.regexp_replace(f"_t{k}", pattern, ""))
        left.append((F.length(f"_t{k}") - F.length(f"_t{k + 1}")).cast("long"))
    chars = [c.alias(f"c_{name}") for c, (name, _) in zip(left, CLASSES)] + [F.length(f"_t{len(CLASSES)}").cast("long").alias("c_other")]
    lines = F.filter(F.split("_t0", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select("doc_id", "lang", words_of(F.col("_t0")).alias("words"), lines.alias("_lines"), *chars)
    df = df.withColumn("n_words", F.size("words").cast("long")).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    df = _repeated(df.drop("_lines"))
    known = F.filter(F.transform("words", F.lower), lambda w: w.isin(sorted(set(sum(COMMON_WORDS.values(), [])))))
    df = df.withColumn("_known", known)
    tally = F.lit(None).cast("array<bigint>")
    for lang, words in COMMON_WORDS.items():
        tally = F.when(F.col("lang") == lang, F.transform(F.array(*map(F.lit, words)), lambda w: F.size(F.filter("_known", lambda k: k == w)).cast("long"))).otherwise(tally)
    return df.withColumn("w_hits", tally).drop("words", "_known")


def references(tallied: DataFrame) -> DataFrame:
    """lang, ref_chars, ref_words: character-class and common-word histograms summed over all documents of a language."""
    size = max(map(len, COMMON_WORDS.values()))
    chars = [F.sum(f"c_{n}").alias(f"c_{n}") for n in CLASS_NAMES]
    sums = tallied.groupBy("lang").agg(*chars, *(F.sum(F.get("w_hits", F.lit(i))).alias(f"w_{i}") for i in range(size)), F.sum("n_words").alias("_n"))
    hits = F.array(*(F.coalesce(f"w_{i}", F.lit(0)).cast("double") for i in range(size)))
    return sums.select(F.col("lang").alias("_lang"), F.array(*(F.col(f"c_{n}").cast("double") for n in CLASS_NAMES)).alias("ref_chars"), hits.alias("ref_words"))


CLASS_NAMES = tuple(n for n, _ in CLASSES) + ("other",)


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (the root of the divergence to base 2; 0 to 1) of two histograms of non-negative doubles; null if
    one of them is empty."""
    sp, sq = _total(p), _total(q)
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    cell = lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2
    return F.when((sp > 0) & (sq > 0), F.sqrt(F.greatest(F.lit(0.0), _total(F.zip_with(F.transform(p, lambda x: x / sp), F.transform(q, lambda x: x / sq), cell)))))


def quality_rules(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, guard_words: int = 100, max_char_distance: float = 0.3162, max_word_distance: float = 0.7071) -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance,
    word_distance, kept.

    base_failed: fewer than min_words words, or more than max_repeat_percent of the words in repeated 3-word windows.
    kept: base holds and, for documents of guard_words words or more, the Jensen-Shannon distance of the document's
    histograms from its language's is at most the given bounds. Shorter documents are judged by the base alone, as
    their histograms are noise. The references are the summed histograms of all rows of a language, so each scale with
    the input; a null lang is a language of its own. Languages without a list of common words have no word_distance. A
    document of guard_words words or more without any of its language's common words has a word_distance of 1, unless
    no document of the language has one.

    Null texts count as empty: 0 words, base_failed. Rows with equal doc_id are judged one by one. Columns besides
    doc_id, text and lang are not read. Empty tables give empty results.
    """
    tallied = staged(counts(docs), "quality-counts")
    df = tallied.join(references(tallied), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    double = lambda c: F.transform(c, lambda x: x.cast("double"))
    df = df.withColumn("char_distance", jensen_shannon(double(F.array(*(F.col(f"c_{n}") for n in CLASS_NAMES))), F.col("ref_chars")))
    pad = F.concat(double(F.col("w_hits")), F.array_repeat(F.lit(0.0), F.size("ref_words") - F.size("w_hits")))
    strange = (F.col("n_words") >= guard_words) & (_total(pad) == 0) & (_total(F.col("ref_words")) > 0)
    df = df.withColumn("word_distance", F.when(F.col("w_hits").isNotNull(), F.when(strange, F.lit(1.0)).otherwise(jensen_shannon(pad, F.col("ref_words")))))
    df = df.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    far = (F.col("n_words") >= guard_words) & ((F.coalesce("char_distance", F.lit(0.0)) > max_char_distance) | (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance))
    word_chars = sum((F.col(f"c_{n}") for n in CLASS_NAMES if n != "space"), F.lit(0).cast("long"))
    return df.select("doc_id", "n_words", word_chars.alias("word_chars"), F.col("c_symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words", "base_failed", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"), (~F.col("base_failed") & ~far).alias("kept"))
