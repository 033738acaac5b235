"""Analyzers that turn texts into graphs of tokens, and phrases found as paths in them.

An edge of a text's graph is a row: node and next (where the edge starts and ends), token, pos (number of the word it starts at),
begin and end (code points of the text that it stands for). Words follow each other from node to node. A synonym of several words
is a path of its own between the nodes around the words it stands for, so its edges have lengths of their own, and a phrase is
found where some path spells it. Stop words are edges too, with an empty token: a phrase may have any of them there, but no gap.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from leafmill.functions import tibetan
from leafmill.staging import COMPACT, at_most, small, staged

#: The token of a stop word.
HOLE = ""
EDGE = "node int, next int, pos int, token string, begin int, end int"

Rule = Sequence[Sequence[str]]


@dataclass(frozen=True)
class Analyzer:
    """How texts become tokens: words are the longest runs that `word` matches; fold gives a word's token; stop words are tokens that leave
    a hole. synonyms: groups of sequences of tokens that stand for each other."""

    word: str
    fold: Callable[[str], str] = str
    stops: frozenset[str] = frozenset()
    synonyms: tuple[Rule, ...] = ()

    def with_synonyms(self, *groups: Rule) -> Analyzer:
        return Analyzer(self.word, self.fold, self.stops, (*self.synonyms, *(tuple(tuple(s) for s in g) for g in groups)))


# Words of texts in any script, and syllables, with and without the marks that end a phrase.
_WORD, _SYLLABLE, _EXACT = r"[^་།\s]+", r"[^་༌།༎༏༑༔\s]+", r"[^་༌།༎༏༑༔\s]+|[།༎༏༑༔]"
_STOPS = frozenset(("འི", "འིས", "ཡིས"))

#: name -> analyzer; further ones may be added.
ANALYZERS: dict[str, Analyzer] = {
    "words": Analyzer(_WORD, str.lower),
    "exact": Analyzer(_EXACT),
    "lenient": Analyzer(_SYLLABLE, tibetan.lenient, _STOPS),
    "phonetic": Analyzer(_SYLLABLE, tibetan.phonetic),
}


class Graphs:
    """Makes graphs of texts for one analyzer."""

    def __init__(self, analyzer: Analyzer):
        self.analyzer, self.token = analyzer, _Tokens(analyzer)
        self.find, self.all = re.compile(analyzer.word).finditer, re.compile(analyzer.word).findall
        self.groups: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
        for group in analyzer.synonyms:
            for own in group:
                others = self.groups.setdefault(tuple(own), [])
                others += [tuple(o) for o in group if tuple(o) != tuple(own) and tuple(o) not in others]
        self.longest: dict[str, int] = {}
        for own in self.groups:
            if not own or not all(map(all, self.groups[own])) or not all(self.groups[own]):
                raise ValueError("a synonym has one token at least, and no empty ones")
            self.longest[own[0]] = max(len(own), self.longest.get(own[0], 0))

    def tokens(self, text: str) -> list[str]:
        return list(map(self.token.__getitem__, self.all(text)))

    def words(self, text: str) -> tuple[list[str], np.ndarray]:
        """The token of each word, and the words' begins and ends."""
        spans = np.array([m.span() for m in self.find(text)], dtype=np.int32).reshape(-1, 2)
        return self.tokens(text), spans

    def synonyms(self, tokens: list[str]) -> list[tuple[int, int, list[tuple[str, ...]]]]:
        """(first word, words, what stands for them), from left to right: at each word the longest sequence that has synonyms is taken, and
        the next is looked for behind it."""
        out, free = [], 0
        for i in [] if self.longest.keys().isdisjoint(tokens) else [i for i, t in enumerate(tokens) if t in self.longest]:
            for n in range(self.longest[tokens[i]], 0, -1) if i >= free else ():
                others = self.groups.get(tuple(tokens[i : i + n]))
                if others is not None:
                    out.append((i, n, others))
                    free = i + n
                    break
        return out

    def columns(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
        """The graph of a text as columns node, next, pos, token, begin, end: the words' edges, then those of synonyms."""
        tokens, spans = self.words(text)
        found, pos = self.synonyms(tokens), np.arange(len(tokens), dtype=np.int32)
        # the inner nodes of synonyms come between those of the words that they stand for and the node behind these
        more = np.zeros(len(tokens) + 1, dtype=np.int32)
        for i, n, others in found:
            more[i + n] = sum(len(o) - 1 for o in others)
        node = pos + np.cumsum(more, dtype=np.int32)[:-1]
        after = node + 1 + more[1:]
        extra = []
        for i, n, others in found:
            inner = int(node[i]) + n
            for other in others:
                stops = [int(node[i]), *range(inner, inner + len(other) - 1), int(after[i + n - 1])]
                inner += len(other) - 1
                extra += [(a, b, i + min(k, n - 1), token, int(spans[i, 0]), int(spans[i + n - 1, 1])) for k, (token, a, b) in enumerate(zip(other, stops, stops[1:]))]
        if not extra:
            return node, after, pos, tokens, spans[:, 0], spans[:, 1]
        rest = list(zip(*extra))
        whole = lambda x, k: np.concatenate([x, np.array(rest[k], dtype=np.int32)])
        return whole(node, 0), whole(after, 1), whole(pos, 2), tokens + list(rest[3]), whole(spans[:, 0], 4), whole(spans[:, 1], 5)

    def edges(self, text: str) -> list[tuple[int, int, int, str, int, int]]:
        """The graph of a text as rows."""
        return sorted(zip(*(c if isinstance(c, list) else c.tolist() for c in self.columns(text))))


class _Tokens(dict):
    """word -> token, remembered."""

    MOST = 100_000

    def __init__(self, analyzer: Analyzer):
        self.analyzer = analyzer

    def __missing__(self, word: str) -> str:
        token = self.analyzer.fold(word)
        token = HOLE if token in self.analyzer.stops else token
        if len(self) >= self.MOST:
            self.clear()
        if len(word) < 100:
            self[word] = token
        return token


def graph_postings(df: DataFrame, keys: list[str], text: str, analyzer: Analyzer | str = "words") -> DataFrame:
    """keys and the edges (node, next, pos, token, begin, end) of the graph of each row's text; none for null texts. Rows are read batch
    by batch and nothing is shuffled."""
    analyzer = ANALYZERS[analyzer] if isinstance(analyzer, str) else analyzer
    kinds = {c: df.schema[c].dataType for c in keys}

    def run(batches):
        import pyarrow as pa

        graphs = Graphs(analyzer)
        for batch in batches:
            step = max(1, batch.num_rows * (1 << 20) // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                found = [graphs.columns(t or "") for t in part.column(len(keys)).to_pylist()]
                where = pa.array(np.repeat(np.arange(len(found), dtype=np.int32), [len(c[0]) for c in found]))
                node, after, pos, begin, end = (np.concatenate([c[k] for c in found]) for k in (0, 1, 2, 4, 5))
                tokens = pa.array(itertools.chain.from_iterable(c[3] for c in found), pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(where) for k in range(len(keys))), *map(pa.array, (node, after, pos)), tokens, pa.array(begin), pa.array(end)], names=[*keys, "node", "next", "pos", "token", "begin", "end"])

    schema = ", ".join(f"`{c}` {k.simpleString()}" for c, k in kinds.items())
    return df.select(*keys, text).mapInArrow(run, f"{schema}, {EDGE}")


def graph_phrases(phrases: DataFrame, text: str = "phrase", analyzer: Analyzer | str = "words") -> DataFrame:
    """phrases with a row for each token: qpos, token, n; other columns stay. A phrase is the plain path of its words, as texts hold the
    synonyms; stop words at its ends are left out."""
    from dataclasses import replace

    analyzer = ANALYZERS[analyzer] if isinstance(analyzer, str) else analyzer
    keep = [c for c in phrases.columns if c != text]
    edges = graph_postings(phrases, keep, text, replace(analyzer, synonyms=()))
    toks = edges.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_t"))
    full = F.transform(F.filter(F.col("_t"), lambda x: x["token"] != HOLE), lambda x: x["pos"])
    inner = F.transform(F.filter(F.col("_t"), lambda x: x["pos"].between(F.array_min(full), F.array_max(full))), lambda x: x["token"])
    return toks.select(*keep, inner.alias("_w")).where("size(_w) > 0").select(*keep, F.size("_w").alias("n"), F.posexplode("_w").alias("qpos", "token"))


def paths(hits: list[tuple[int, int, int, int, int, int]], n: int) -> list[tuple[int, int]]:
    """(begin, end) of all paths that spell a phrase of n tokens. hits: (qpos, node, next, pos, begin, end) of edges with its tokens."""
    by: list[dict[int, list]] = [{} for _ in range(n)]
    for q, node, after, _, begin, end in hits:
        by[q].setdefault(node, []).append((after, begin, end))
    # at each node, where paths that reach it begin, and where their last edge ends
    states = {(after, begin, end) for edges in by[0].values() for after, begin, end in edges}
    for q in range(1, n):
        states = {(after, min(first, begin), max(last, end)) for node, first, last in states for after, begin, end in by[q].get(node, ())}
    return sorted({(first, last) for _, first, last in states})


def near(hits: list[tuple[int, int, int, int, int, int]], n: int, tokens: list[str], slop: int) -> list[tuple[int, int]]:
    """(begin, end) of all places where the tokens of a phrase stand at their places or up to slop words from them, each at a word of
    its own; the shortest of those that share a place."""
    by: list[list] = [[] for _ in range(n)]
    for q, _, _, pos, begin, end in hits:
        by[q].append((pos, begin, end))
    rows = [sorted(set(x)) for x in by]
    out = set()
    for start in sorted({pos - q for q in range(n) for pos, _, _ in rows[q]}):
        taken: set[tuple[str, int]] = set()
        found = []
        for q in range(n):
            at = next((x for x in rows[q] if start + q <= x[0] <= start + q + slop and (tokens[q], x[0]) not in taken), None)
            if at is None:
                break
            taken.add((tokens[q], at[0]))
            found.append(at)
        else:
            out.add((min(x[1] for x in found), max(x[2] for x in found)))
    return [s for s in sorted(out) if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in out)]


#: Phrases and candidates are broadcast up to so many rows, and else joined by a shuffle.
BROADCAST_ROWS = 500_000


def graph_presence(df: DataFrame, keys: list[str], text: str, analyzer: Analyzer | str, asked: DataFrame) -> DataFrame:
    """keys and token, once each: which of the asked tokens (column token) some edge of a text's graph has. Up to BROADCAST_ROWS of them
    go to the tasks, which then hand on nothing else; more are joined."""
    analyzer = ANALYZERS[analyzer] if isinstance(analyzer, str) else analyzer
    asked = asked.select("token").distinct()
    few = at_most(asked, BROADCAST_ROWS)
    sent = df.sparkSession.sparkContext.broadcast({r["token"] for r in asked.collect()} if few else None)

    def run(batches):
        import pyarrow as pa

        graphs, wanted = Graphs(analyzer), sent.value
        for batch in batches:
            rows, found = [], []
            for i, value in enumerate(batch.column(len(keys))):
                tokens = graphs.tokens(value.as_py() or "")
                own = set(tokens).union(t for _, _, others in graphs.synonyms(tokens) for o in others for t in o)
                own = own if wanted is None else own & wanted
                rows.append(len(own))
                found += own
            where = pa.array(np.repeat(np.arange(len(rows), dtype=np.int32), rows))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(where) for k in range(len(keys))), pa.array(found, pa.string())], names=[*keys, "token"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)
    out = df.select(*keys, text).mapInArrow(run, f"{schema}, token string")
    return out if few else out.join(asked, "token", "left_semi")


def _candidates(held: DataFrame, phrases: DataFrame, by: list[str]) -> DataFrame:
    """by, _key of texts that have the token of a phrase that the fewest rows of held (_key, token) have, staged."""
    asked = small(phrases.select("token").distinct(), BROADCAST_ROWS)
    counts = held.join(asked, "token", "left_semi").groupBy("token").agg(F.count("*").alias("_c"))
    ranked = phrases.where(F.col("token") != HOLE).join(counts, "token", "left")
    rare = ranked.groupBy(*by).agg(F.min(F.struct(F.coalesce("_c", F.lit(0)).alias("c"), "token")).alias("_r")).select(*by, F.col("_r")["token"].alias("token"))
    rare = staged(rare, "rarest-tokens")
    return staged(held.join(small(rare, BROADCAST_ROWS), "token").select(*by, "_key").distinct(), "candidates")


def graph_hits(posts: DataFrame, phrases: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """by, keys, n, spans (array<struct<begin, end>>) of each phrase (rows of one value of by: slop, n, qpos, token) found in a text
    (rows of one value of keys). posts: stored postings, which are read three times; see text_hits for texts without.

    A phrase is looked up by the token of it that the fewest edges have; only texts with that one are asked for its other tokens,
    so a common word alone joins with nothing. What is found of one phrase in one text is then walked as a whole."""
    # keys with nulls are keys too: structs of them are equal where they are alike
    posts = posts.withColumn("_key", F.struct(*keys)).drop(*keys)
    return _walked(posts, _candidates(posts.select("_key", "token"), phrases, by), phrases, by)


def text_hits(df: DataFrame, keys: list[str], text: str, analyzer: Analyzer | str, phrases: DataFrame, by: list[str], presence: DataFrame | None = None) -> DataFrame:
    """As graph_hits, of texts without stored postings: which of the phrases' tokens each text has is found first (presence, of
    graph_presence, if it is at hand), and graphs are made of the candidates only."""
    held = (staged(graph_presence(df, keys, text, analyzer, phrases), "presence", **COMPACT) if presence is None else presence).select(F.struct(*keys).alias("_key"), "token")
    found = _candidates(held, phrases, by)
    texts = df.withColumn("_key", F.struct(*keys)).join(small(found.select("_key").distinct(), BROADCAST_ROWS), "_key", "left_semi")
    return _walked(graph_postings(texts, ["_key"], text, analyzer), found, phrases, by)


def _walked(posts: DataFrame, found: DataFrame, phrases: DataFrame, by: list[str]) -> DataFrame:
    """The hits of phrases in the candidates found (by, _key), from postings by _key."""
    keys = posts.schema["_key"].dataType.fieldNames()
    asked = small(phrases.select("token").distinct(), BROADCAST_ROWS)
    edges = posts.join(asked, "token", "left_semi").join(small(found, BROADCAST_ROWS), "_key")
    edges = edges.join(small(phrases, BROADCAST_ROWS), [*by, "token"])
    hit = F.struct("qpos", "node", "next", "pos", "begin", "end", "token")
    whole = edges.groupBy(*by, "_key", "slop", "n").agg(F.count_distinct("qpos").alias("_f"), F.collect_list(hit).alias("_hits")).where("_f = n")
    whole = whole.select(*by, "_key.*", "slop", "n", "_hits")
    keep = [*by, *keys, "n"]
    kinds = {c: whole.schema[c].dataType.simpleString() for c in keep}
    span = StructType([StructField("begin", IntegerType()), StructField("end", IntegerType())])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kind = pa.list_(to_arrow_type(span))
        for batch in batches:
            spans = []
            for n, slop, hits in zip(batch.column("n").to_pylist(), batch.column("slop").to_pylist(), batch.column("_hits")):
                rows = [tuple(h.values())[:6] for h in hits.as_py()]
                if slop:
                    tokens = {h["qpos"]: h["token"] for h in hits.as_py()}
                    places = near(rows, n, [tokens[q] for q in range(n)], slop)
                else:
                    places = paths(rows, n)
                spans.append([{"begin": b, "end": e} for b, e in places])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(spans, kind)], names=[*keep, "spans"])

    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items())
    return whole.mapInArrow(run, f"{schema}, spans array<struct<begin:int,end:int>>").where("size(spans) > 0")


def marked(text: str, spans: list[tuple[int, int]], size: int | None = None, before: str = "<em>", after: str = "</em>") -> str:
    """text with its spans marked, overlapping ones as one; with a size, only its best fragment: of the windows of so many code points
    that start at a mark (or of the mark's length, if it is longer), the one with the most marked code points, the first of them,
    in the middle of as much text as there is room for."""
    joined: list[list[int]] = []
    for b, e in sorted(spans):
        if joined and b <= joined[-1][1]:
            joined[-1][1] = max(e, joined[-1][1])
        else:
            joined.append([b, e])
    low, high = 0, len(text)
    if size is not None and joined:
        windows = []
        for i, (b, e) in enumerate(joined):
            inside = [s for s in joined[i:] if s[1] <= max(b + size, e)]
            windows.append((-sum(y - x for x, y in inside), b, inside))
        _, b, inside = min(windows)
        room = max(size, inside[-1][1] - b)
        low = max(0, min(b - (room - (inside[-1][1] - b)) // 2, len(text) - room))
        high = min(len(text), low + room)
        joined = [s for s in joined if low <= s[0] and s[1] <= high]
    out, at = [], low
    for b, e in joined:
        out += [text[at:b], before, text[b:e], after]
        at = e
    return "".join([*out, text[at:high]])


def highlights(hits: DataFrame, texts: DataFrame, keys: list[str], text: str, by: list[str], size: int | None = None, before: str = "<em>", after: str = "</em>") -> DataFrame:
    """by, keys, highlight: the text of each hit with what all phrases of one value of by found in it marked by its offsets, so synonyms
    and words between tokens are marked too. size: code points of the best fragment; all of the text if None."""
    spans = hits.groupBy(*by, F.struct(*keys).alias("_key")).agg(F.flatten(F.collect_list("spans")).alias("_spans"))
    found = spans.join(texts.select(F.struct(*keys).alias("_key"), F.col(text).alias("_text")), "_key")

    @F.arrow_udf(StringType())
    def mark(values, places):
        import pyarrow as pa

        rows = zip(values.to_pylist(), places.to_pylist())
        return pa.array([None if t is None else marked(t, [(p["begin"], p["end"]) for p in s], size, before, after) for t, s in rows], pa.string())

    return found.select(*by, "_key.*", mark("_text", "_spans").alias("highlight"))
