"""Substring dedup: words inside a window of W words that also starts in a document with a smaller doc_id go.

Matching statistics against suffix automata of reference shards find the windows. The reference is the corpus itself, so
shards are cut by content: each window has an anchor, the least hash of its M-word pieces, and consecutive windows with one
anchor are one fragment. Equal windows have equal anchors, so each shard holds all fragments of its anchors, builds an
automaton that knows the least doc_id of each state, and streams the same fragments through it. Only anchors of several
documents are followed up, and fragments that are equal word for word travel once, with their least doc_id. An automaton
of the whole reference has no size bound to broadcast it under; that is why shards go to tasks by anchor.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import dropped, staged
from leafmill.llm.hashing import WordIds, ngrams
from leafmill.llm.ngram_join import _batches

#: Words of an anchor's piece.
PIECE = 25
#: Anchors with more distinct fragments than HOT are cut into single windows, each an anchor of its own.
HOT = 2000
#: An automaton is built for groups of fragments of so many words together.
SHARD_WORDS = 50_000


def words_in(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def fragments(ids: np.ndarray, window: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchor, first window and number of windows of a document's fragments; none if it has no window."""
    starts = len(ids) - window + 1
    if starts < 1:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    hashes = ngrams(ids, piece)
    view = np.lib.stride_tricks.sliding_window_view(hashes, window - piece + 1)
    at = np.arange(starts) + np.concatenate([view[i : i + 4096].argmin(axis=1) for i in range(0, starts, 4096)])
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return hashes[at[first]], first, np.diff(np.append(first, starts))


class Automaton:
    """Suffix automaton of several word sequences; low[s] is the least label of the sequences in which state s occurs."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.low = [-1], [0], [float("inf")]

    def _state(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges), self.link.append(link), self.length.append(length), self.low.append(float("inf"))
        return len(self.link) - 1

    def _split(self, p: int, c, q: int) -> int:
        """The state of the string of p followed by c, which q holds among longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        own = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = own
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = own
            p = self.link[p]
        return own

    def add(self, words, label) -> None:
        last = 0
        for c in words:
            if c in self.next[last]:
                last = self._split(last, c, self.next[last][c])
            else:
                new, p = self._state(self.length[last] + 1, {}, 0), last
                while p != -1 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p != -1:
                    self.link[new] = self._split(p, c, self.next[p][c])
                last = new
            if label < self.low[last]:
                self.low[last] = label

    def close(self) -> None:
        """Hands the labels of longer strings down to their suffixes."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            if self.low[s] < self.low[up]:
                self.low[up] = self.low[s]

    def least(self, words, window: int):
        """For each window of words in turn, the least label of the sequences that hold it; infinity if none does."""
        s = have = 0
        for i, c in enumerate(words):
            while s and c not in self.next[s]:
                s = self.link[s]
                have = self.length[s]
            if c in self.next[s]:
                s, have = self.next[s][c], have + 1
            have = min(have, window)
            while s and self.length[self.link[s]] >= have:
                s = self.link[s]
            if i + 1 >= window:
                yield self.low[s] if have >= window else float("inf")


def _spans(flags) -> list[tuple[int, int]]:
    """Runs of true flags as [start, end)."""
    padded = np.concatenate([[0], np.asarray(flags, dtype=np.int8), [0]])
    edge = np.flatnonzero(np.diff(padded))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _smaller(window: int):
    """Over rows sorted by key: for each fragment, the runs of its windows that a smaller document has, by shards of keys."""

    def run(batches):
        import pyarrow as pa

        fields = ("anchor", "frag", "a", "b")

        def solve(groups):
            automaton, out = Automaton(), []
            split = [[(text.split(b" "), origins) for text, origins in rows.items()] for rows in groups]
            for rows in split:
                for words, origins in rows:
                    automaton.add(words, min(low for *_, low in origins))
            automaton.close()
            for rows in split:
                for words, origins in rows:
                    least = list(automaton.least(words, window))
                    for anchor, frag, off, low in origins:
                        out += [(anchor, frag, off + a, off + b) for a, b in _spans([x < low for x in least])]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 4, names=fields)

        groups, held, key, rows = [], 0, None, {}

        def close(rows):
            """Keeps a key's rows if one of them can be in another with a smaller label; returns their words."""
            if len({low for origins in rows.values() for *_, low in origins}) < 2:
                return 0
            groups.append(rows)
            return sum(text.count(b" ") + 1 for text in rows)

        for batch in batches:
            for k, anchor, frag, off, low, text in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    held += close(rows)
                    rows = {}
                    if held >= SHARD_WORDS:
                        yield solve(groups)
                        groups, held = [], 0
                key = k
                rows.setdefault(text, set()).add((anchor, frag, off, low))
        close(rows)
        if groups:
            yield solve(groups)

    return run


def substring_dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, text (the kept words joined by one space).

    A word goes if a window of `window` consecutive words that covers it also starts in a document with a smaller doc_id;
    windows are judged on the input. Words are runs of characters other than the six ASCII white-space characters,
    unchanged. Null and short texts lose nothing (a null text has no words). A row with a null doc_id loses nothing and
    takes nothing from others. Repeated rows are equal and have no smaller doc_id among them. Other columns are not
    read; empty tables give empty results.
    """
    piece = min(PIECE, window)
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")

    def find():
        ids = WordIds()

        def f(doc_ids, ths, texts):
            out = ([], [], [])
            for d, h, t in zip(doc_ids, ths, texts):
                anchors = np.unique(fragments(ids.of(words_in(t)), window, piece)[0])  # once, however often its words repeat
                for column, values in zip(out, (np.full(len(anchors), d), np.full(len(anchors), h), anchors.view(np.int64))):
                    column.append(values.astype(np.int64))
            return [np.concatenate(c) if c else [] for c in out]

        return f

    named = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    seen = staged(_batches(named, find, "doc_id long, th long, anchor long"), "anchors")
    # aggregated before the shuffle, and a join can split the rows of a hot anchor; a window could do neither
    several_docs = seen.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    shared = seen.join(several_docs, "anchor", "left_semi").groupBy("doc_id", "th").agg(F.collect_set("anchor").alias("anchors"))
    shared = staged(shared, "shared").withColumnsRenamed({"doc_id": "_d", "th": "_h"})
    dropped(seen)
    followed = named.join(shared, (F.col("doc_id") == F.col("_d")) & (F.col("th") == F.col("_h"))).select("doc_id", "th", "text", "anchors")

    def cut():
        ids = WordIds()

        def f(doc_ids, ths, texts, shared):
            out, sent = ([], [], [], [], [], [], []), set()
            for d, h, t, wanted in zip(doc_ids, ths, texts, shared):
                words, wanted = words_in(t), set(wanted)
                anchors, first, n_windows = fragments(ids.of(words), window, piece)
                for anchor, at, n in zip(anchors.view(np.int64).tolist(), first.tolist(), n_windows.tolist()):
                    if anchor in wanted:
                        text = b" ".join(words[at : at + n + window - 1])
                        frag = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big", signed=True)
                        key = (anchor, frag)
                        for column, x in zip(out, (d, h, anchor, frag, at, n, None if key in sent else text)):
                            column.append(x)
                        sent.add(key)
            return out

        return f

    found = staged(_batches(followed, cut, "doc_id long, th long, anchor long, frag long, first long, n long, words binary"), "fragments")
    mins = staged(found.groupBy("anchor", "frag").agg(F.min("doc_id").alias("low")), "least")
    several = mins.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    several = staged(mins.join(several, "anchor"), "several")
    texts = found.where(F.col("words").isNotNull()).select("anchor", "frag", "words").join(several, ["anchor", "frag"]).select("anchor", "frag", "low", "kinds", "words")

    def dealt():
        def f(anchors, frags, lows, kinds, texts):
            out = ([], [], [], [], [], [])
            for a, g, low, k, text in zip(anchors, frags, lows, kinds, texts):
                if k <= HOT:
                    one = [(a, a, g, 0, low, text)]
                else:
                    words = text.split(b" ")
                    pieces = [b" ".join(words[i : i + window]) for i in range(len(words) - window + 1)]
                    one = [(int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "big", signed=True), a, g, i, low, x) for i, x in enumerate(pieces)]
                for row in one:
                    for column, x in zip(out, row):
                        column.append(x)
            return out

        return f

    shards = _batches(texts, dealt, "key long, anchor long, frag long, off long, low long, words binary")
    within = shards.repartition("key").sortWithinPartitions("key").mapInArrow(_smaller(window), "anchor long, frag long, a long, b long")
    inner = staged(within, "inner").withColumnsRenamed({"anchor": "_a", "frag": "_f"})
    of = found.select("doc_id", "th", "anchor", "frag", "first", "n").join(mins.select("anchor", "frag", "low"), ["anchor", "frag"])
    whole = of.where("doc_id > low").select("doc_id", "th", F.col("first").alias("a"), (F.col("first") + F.col("n")).alias("b"))
    part = of.where("doc_id = low").join(inner, (F.col("anchor") == F.col("_a")) & (F.col("frag") == F.col("_f"))).select("doc_id", "th", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))
    gone = whole.union(part).groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "b")).alias("gone"))
    gone = staged(gone.select(F.col("doc_id").alias("_d"), F.col("th").alias("_h"), F.col("gone")["a"].alias("a"), F.col("gone")["b"].alias("b")), "gone")
    judged = rows.join(gone, (F.col("doc_id") == F.col("_d")) & (F.col("th") == F.col("_h")), "left").select("doc_id", "text", "a", "b")

    def keep():
        def f(doc_ids, texts, starts, ends):
            out = ([], [], [], [])
            for d, t, a, b in zip(doc_ids, texts, starts, ends):
                words = words_in(t)
                kept = words
                if a:
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(change, a, 1)
                    np.add.at(change, np.array(b) + window - 1, -1)
                    kept = [w for w, c in zip(words, np.cumsum(change)) if not c]
                for column, x in zip(out, (d, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass"))):
                    column.append(x)
            return out

        return f

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _batches(judged, keep, f"doc_id {kind}, n_words long, n_removed long, text string")
