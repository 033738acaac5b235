"""Secret scans: fixed patterns, and values in credential contexts whose guess cost is high.

The guess cost of a value is the least sum, over all ways to cut it into words, dates, repeats, keyboard walks and
brute-force spans, of the decimal logarithms of the guesses each piece takes; a dynamic programme over end positions finds
it. Values that people might guess (dictionary words, dates, walks) come out cheap and are not reported.

The dictionary has the words that guessers try first, and then the commonest words of the corpus by their rank. Values in credential
contexts are not counted as words, so a secret does not make itself a word.
"""

from __future__ import annotations

import hashlib
import re
from math import log10

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import dropped, map_columns, staged

#: The kinds of spans, in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "guess")

# The patterns of the base scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: A credential context: a key that names one, a separator, and a value of printable ASCII without quotes.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|auth(?:orization)?|bearer)["']?\x20*(?::=|=>|[:=])\x20*["']?(?:(?:bearer|basic)\x20+)?([!#-&(-+\--~]{6,})""", re.ASCII | re.IGNORECASE)
#: The same for Java's regular expressions.
CONTEXT_SQL = "(?i)" + CONTEXT.pattern
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "credential", "key", "auth", "bearer")

# Words that guessers try first, commonest first.
GUESS_WORDS = "password qwerty admin welcome login letmein dragon monkey football baseball master sunshine shadow princess superman iloveyou trustno access hello secret token pass test user guest root changeme default example sample demo summer winter spring autumn monday friday january march april june july august october the and you that was for are with his they this have from one had word but not what all were when your can said there use each which she how their will other about out many then them these some her would make like him into time has look two more write see number way could people than first water been call who its now find long down day did get come made may part".split()
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans({"@": "a", "4": "a", "3": "e", "0": "o", "1": "l", "!": "i", "$": "s", "5": "s", "7": "t"})

#: The dictionary's words have so many letters; so many of the commonest words of the corpus are in it at most.
SHORTEST, LONGEST, CORPUS_WORDS = 3, 20, 50_000
#: A word of the corpus: a run of small letters, no shorter than four, that is no part of a longer run of letters, digits or "_".
CORPUS_WORD = rf"(?<![\p{{L}}\p{{N}}_])[a-z]{{4,{LONGEST}}}(?![\p{{L}}\p{{N}}_])"

RANK = {w: i + 1 for i, w in reversed(list(enumerate(GUESS_WORDS)))}
#: Years, and dates with one separator or none, wherever they start.
DATES = [re.compile(f"(?=({p}))") for p in (r"(?:19|20)\d\d", r"(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d")]
NEXT_KEYS = {(a, b) for row in KEY_ROWS for x, y in zip(row, row[1:]) for a, b in ((x, y), (y, x))} | {(a, b) for r, s in zip(KEY_ROWS, KEY_ROWS[1:]) for k in range(min(len(r), len(s))) for a, b in ((r[k], s[k]), (s[k], r[k]))}
#: What each further piece adds, for the guesser must also find where the pieces meet.
JOIN = log10(2)


def _brute(c: str) -> float:
    return log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33)


def guess_cost(value: str, ranks: dict[str, int] = RANK) -> float:
    """log10 of the guesses that the cheapest segmentation of value takes; 0 for an empty one. ranks numbers the words, from 1.

    Linear in the value's length: words and dates are bounded, and of a repeat or walk only starts within its run's first LONGEST
    places are tried. A later start is never cheaper, as the piece before it would lie in the run and could be taken in."""
    n, low = len(value), value.lower()
    if len(low) != n:  # a letter outside ASCII whose small form has two characters
        low = value
    plain = low.translate(LEET)
    back = plain[::-1]
    best = [0.0] + [float("inf")] * n
    dates: dict[int, list[int]] = {}
    for pattern in DATES:
        for m in pattern.finditer(value):
            dates.setdefault(m.start() + len(m[1]), []).append(m.start())
    same = walk = 1  # lengths of the repeat and the walk that end here
    for j in range(1, n + 1):
        c = best[j - 1] + _brute(value[j - 1])
        if j > 1:
            same = same + 1 if low[j - 1] == low[j - 2] else 1
            walk = walk + 1 if (low[j - 2], low[j - 1]) in NEXT_KEYS else 1
        for run, guesses in ((same, 40), (walk, 47 * 4)):
            for i in range(j - run, min(j - run + LONGEST, j - 3) + 1):
                c = min(c, best[i] + log10(guesses * (j - i)) + JOIN)
        for i in dates.get(j, ()):
            c = min(c, best[i] + log10(366 * 100) + JOIN)
        for k in range(SHORTEST, min(LONGEST, j) + 1):
            forth, reverse = ranks.get(plain[j - k : j]), ranks.get(back[n - j : n - j + k])
            if forth or reverse:
                raw = value[j - k : j]
                guesses = log10(min(x for x in (forth and forth + 1, reverse and 2 * (reverse + 1)) if x))
                changed = (raw != raw.lower()) + sum(a != b for a, b in zip(low[j - k : j], plain[j - k : j]))
                c = min(c, best[j - k] + guesses + changed * log10(2) + JOIN)
        best[j] = c
    return best[n]


def scan(text: str, min_cost: float, ranks: dict[str, int] = RANK) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, cost) of all spans by start, then kind; the cost of an assign span is that of its value."""
    low = text.lower()
    found: list[tuple[int, int, int, float]] = []
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end(), guess_cost(m[2], ranks)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), guess_cost(m[0], ranks)) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end(), guess_cost(m[0], ranks)) for m in HEX.finditer(text)]
    if (":" in text or "=" in text) and any(h in low for h in CONTEXT_HINTS):
        base, at = sorted((s, e) for s, _, e, _ in found), 0
        reach = -1  # where the base spans that start before the value's end go
        for m in CONTEXT.finditer(text):
            s, e = m.span(1)
            while at < len(base) and base[at][0] < e:
                reach, at = max(reach, base[at][1]), at + 1
            if reach <= s and (cost := guess_cost(m[1], ranks)) >= min_cost:
                found.append((s, 3, e, cost))
    return sorted(found)


def corpus_ranks(docs: DataFrame, most: int = CORPUS_WORDS) -> dict[str, int]:
    """The ranks of GUESS_WORDS and, after them, of the commonest words of all texts, ties by code point. Words inside values of
    credential contexts do not count. Counts fall into sixteenths of octaves, and the words of the highest ones are taken, as long as
    they number `most` at most: the driver gets no more than these, whatever the vocabulary, and no task sorts it."""
    text = F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), CONTEXT_SQL, " "))
    words = docs.select(F.explode(F.regexp_extract_all(text, F.lit(CORPUS_WORD), F.lit(0))).alias("word"))
    counts = staged(words.groupBy("word").agg(F.count("*").alias("n")).withColumn("step", F.floor(F.log2("n") * 16).cast("int")), "words")
    taken, last = 0, None
    for step, n in sorted(counts.groupBy("step").count().collect(), reverse=True):  # 1,024 rows at most
        if taken + n > most:
            break
        taken, last = taken + n, step
    ranks = dict(RANK)
    if last is not None:
        for word, _ in sorted(counts.where(F.col("step") >= last).select("word", "n").collect(), key=lambda r: (-r[1], r[0])):
            ranks.setdefault(word, len(ranks) + 1)
    dropped(counts)
    return ranks


def secret_scan(docs: DataFrame, min_cost: float = 10.0, corpus_words: int = CORPUS_WORDS) -> DataFrame:
    """Per row of docs: doc_id, spans array<struct<kind, start, end, cost>> by start, then kind (code points, end exclusive).

    Base kinds: assign, access, hex. The method adds kind guess: values in a credential context that overlap no base
    span and whose guess cost, as log10, is min_cost or more; base spans stay at any cost. Words are those of corpus_ranks, counted
    over all of docs. Whole texts are read. A null text is an empty one and has
    no spans; repeated rows are scanned one by one; other columns are not read; empty tables give empty results.
    """

    ranks = corpus_ranks(docs, corpus_words)

    def run(ids, texts):
        return ids, [[{"kind": KINDS[k], "start": s, "end": e, "cost": c} for s, k, e, c in scan(t or "", min_cost, ranks)] for t in texts]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_columns(docs.select("doc_id", "text"), run, f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint, cost: double>>")


def joined(spans: list[dict]) -> str:
    return ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
