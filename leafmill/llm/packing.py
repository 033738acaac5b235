"""Best-fit packing of documents into sequences of bounded length, after the dominance reduction of Martello and Toth.

Pieces of one length are interchangeable, so the packing is decided on the histogram of lengths, which has `capacity` entries
at most, however many documents there are. A set of pieces that fits a sequence dominates another one if the other's pieces can
be put, as groups, into the places of single pieces of the first; some optimal packing then has the first. For the longest
piece left, sets of up to three pieces are searched that dominate every set with it; they are fixed and leave the instance.
The rest is packed best-fit, longest first. Both steps treat all pieces of a length at once: what is fixed or fitted once
is so again until a length runs out. Plans are patterns, sets of lengths with the number of sequences that follow them.

Every piece finds its place from its number among the pieces of its length: numbers are given in the tasks that cut the pieces,
and running sums over the tasks' counts make them unique, so no pieces are sorted or shuffled.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import bounded_batches, small, staged

#: First numbers by task and length are broadcast up to so many rows; beyond, they come by a shuffle.
BROADCAST_STARTS = 500_000

Pattern = tuple[tuple[int, int], ...]


class Sizes:
    """A multiset of lengths in ascending order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {w: n for w, n in counts.items() if n}
        self.order = sorted(self.count)

    def take(self, w: int, n: int) -> None:
        self.count[w] -= n
        if not self.count[w]:
            del self.count[w], self.order[bisect_left(self.order, w)]

    def at_most(self, w: int, without: tuple[int, ...] = ()) -> int:
        """The greatest length up to w of which there is one besides those in `without`; 0 if there is none."""
        for i in range(bisect_right(self.order, w) - 1, -1, -1):
            if self.count[self.order[i]] > without.count(self.order[i]):
                return self.order[i]
        return 0

    def least(self, n: int, without: int) -> list[int]:
        """The n smallest pieces besides one of length `without`."""
        out: list[int] = []
        for w in self.order:
            out += [w] * min(n - len(out), self.count[w] - (w == without))
            if len(out) == n:
                break
        return out


def dominating(sizes: Sizes, w: int, capacity: int) -> tuple[int, ...] | None:
    """Lengths besides w of a set with the longest piece w that dominates all sets with it; None if none of up to three is found.

    With room r = capacity - w: alone if nothing fits; the longest single fit b if it fills r, or if no two pieces fit, as every
    set then has one piece of b at most besides w. If two fit and no three do: b also where no pair sums to more than b, as a
    pair then takes b's place as a group. Else b with the longest c that fits beside it, where no two pieces longer than c
    fit together: every single and every pair has then a piece up to b and, if there is another one, up to c.
    """
    room, least = capacity - w, sizes.least(3, w)
    if not least or least[0] > room:
        return ()
    b = sizes.at_most(room, (w,))
    if b == room or len(least) < 2 or least[0] + least[1] > room:
        return (b,)
    if len(least) == 3 and sum(least) <= room:
        return None
    if best_pair(sizes, w, room) <= b:
        return (b,)
    c = sizes.at_most(room - b, (w, b))
    if c:
        longer = [x for x in sizes.order[bisect_right(sizes.order, c) :] for _ in range(min(2, sizes.count[x] - (x == w)))][:2]
        if len(longer) < 2 or sum(longer) > room:
            return (b, c)
    return None


def best_pair(sizes: Sizes, w: int, room: int) -> int:
    """The greatest sum up to room of two pieces besides one of length w; 0 if there is none."""
    best = 0
    for x in sizes.order:
        if 2 * x > room:
            break
        if sizes.count[x] - (x == w) > 0:
            y = sizes.at_most(room - x, (w, x))
            best = max(best, x + y if y else 0)
    return best


def reduced(sizes: Sizes, capacity: int) -> Counter[Pattern]:
    """Takes out of sizes all that dominance fixes, and returns it as patterns with their numbers. Lengths without a dominating set
    stay; fixing others can make one of theirs dominate, so they are asked again until nothing changes."""
    fixed: Counter[Pattern] = Counter()
    changed = True
    while changed:
        changed = False
        for w in sizes.order[::-1]:
            while w in sizes.count and (others := dominating(sizes, w, capacity)) is not None:
                need = Counter((w, *others))
                times = min(sizes.count[x] // n for x, n in need.items())
                for x, n in need.items():
                    sizes.take(x, n * times)
                fixed[tuple(sorted(need.items(), reverse=True))] += times
                changed = True
    return fixed


def best_fit(sizes: Sizes, capacity: int) -> Counter[Pattern]:
    """Best-fit of the lengths, longest first: each piece goes into the fullest open sequence that has room for it."""
    rooms: list[int] = []
    held: dict[int, Counter[Pattern]] = {}

    def put(room, pattern, n):
        if n:
            if room not in held:
                insort(rooms, room)
            held.setdefault(room, Counter())[pattern] += n

    for w in sizes.order[::-1]:
        left, moved = sizes.count[w], []
        i = bisect_left(rooms, w)
        while left:
            if i < len(rooms):
                room = rooms[i]
                pattern, n = held[room].popitem()
                if not held[room]:
                    del held[room], rooms[i]
            else:
                room, pattern, n = capacity, (), left
            # a sequence that has taken one piece is the fullest that fits the next, until it has no room for another
            each = room // w
            full, part = divmod(min(left, n * each), each)
            opened = n if pattern else full + bool(part)
            moved += [(room - each * w, (*pattern, (w, each)), full), (room - part * w, (*pattern, (w, part)), int(part > 0)), (room, pattern, opened - full - bool(part))]
            left -= full * each + part
        for change in moved:
            put(*change)
    out: Counter[Pattern] = Counter()
    for some in held.values():
        out.update(some)
    return out


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """A packing of all pieces as patterns ((length, copies), ...) with the numbers of sequences that follow them."""
    sizes = Sizes(histogram)
    plan = reduced(sizes, capacity)
    plan.update(best_fit(sizes, capacity))
    return sorted(plan.items(), reverse=True)


def places(plan: list[tuple[Pattern, int]], capacity: int) -> dict[str, np.ndarray]:
    """The places of all pieces as runs, in order of length: slot (number of the run's first piece among all pieces), first sequence,
    pieces of the length a sequence, offset of the first of them; and begin, the slot of each length's first piece."""
    runs, seen, base = [], Counter(), 0
    for pattern, n in plan:
        at = 0
        for w, copies in pattern:
            runs.append((w, seen[w], base, copies, at))
            seen[w] += n * copies
            at += w * copies
        base += n
    begin = np.concatenate([[0], np.cumsum([seen[w] for w in range(capacity + 1)])])[:-1].astype(np.int64)
    length, first, sequence, copies, offset = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5).T
    return {"begin": begin, "slot": begin[length] + first, "sequence": sequence, "copies": copies, "offset": offset}


# Fixed value: how a byte-level pre-tokenizer cuts texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space on which that pattern is not tried, as it looks at each of them again and again.
_LONG_BLANK = re.compile(r"\s{5000}").search


def byte_ranks(definition: str) -> dict[bytes, int] | None:
    """Tokens as bytes with their ids, if the tokenizer that `definition` defines is a byte-level BPE whose ids grow with its merges
    and each of whose tokens is what its own bytes are merged to; else None.

    Such a vocabulary says all that its merges say: where two parts side by side make up a token, everything of lower rank
    between its ends is merged already, as it would be in the token alone, so the two are the ones that its merge joins."""
    spec = json.loads(definition)
    model, cutter = spec["model"], spec["pre_tokenizer"] or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if model.get("type", "BPE") != "BPE" or not plain or spec.get("normalizer") or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
        return None
    # a byte-level vocabulary writes bytes that are no visible Latin characters as the characters from 256 on, in order
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    added = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(map(names.__getitem__, token)): i for token, i in model["vocab"].items() if token not in added}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    merged = [tuple(bytes(map(names.__getitem__, half)) for half in pair) for pair in pairs]
    order = [ranks.get(a + b) for a, b in merged]
    if None in order or any(x >= y for x, y in zip(order, order[1:])) or any(bytes([b]) not in ranks for b in range(256)):
        return None
    if len(ranks) != 256 + len(merged) or max(ranks[bytes([b])] for b in range(256)) > min(order, default=1 << 40):
        return None
    return ranks if all(last_pair(a + b, ranks) == (a, b) for a, b in merged) else None


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, ...]:
    """The parts of a token after all merges but the one that makes it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        i = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 40))
        if parts[i] + parts[i + 1] not in ranks:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return tuple(parts)


class Encoder:
    """Ids of whole texts by the tokenizer that `definition` defines. With byte_ranks, tiktoken carries out the same merges, three times
    as fast; texts that hold an added token's string or a very long run of white space are the tokenizer's own in any case."""

    def __init__(self, definition: str, ranks: dict[bytes, int] | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.merges = tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added)).search if added else lambda _: None

    def ids(self, text: str) -> np.ndarray:
        if self.merges is None or self.special(text) or _LONG_BLANK(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.merges.encode_ordinary(text), dtype="<u4")


def pieces_of(docs: DataFrame, definition: str, capacity: int, end: int) -> DataFrame:
    """task, doc_id, piece, start, length, ids_crc32, number (of the piece among those of its length and task): the pieces of
    every document, whose ids are those of the tokenizer that `definition` (the content of its file) defines, and `end`. Only documents longer than capacity are cut; the first of their
    pieces takes what is left over."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast((definition, byte_ranks(definition)))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, encoder, numbered = TaskContext.get().partitionId(), Encoder(*sent.value), Counter()
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for i, text in enumerate(batch.column("text")):
                ids = np.append(encoder.ids(text.as_py() or ""), np.array([end], dtype="<u4"))
                n = len(ids)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for column, value in zip(rows, (i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), numbered[b - a])):
                        column.append(value)
                    numbered[b - a] += 1
            ids_of = batch.column("doc_id").take(pa.array(rows[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([task] * len(rows[0]), pa.int32()), ids_of, *(pa.array(c, t) for c, t in zip(rows[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True))], names=["task", "doc_id", "piece", "start", "length", "ids_crc32", "number"])

    return docs.select("doc_id", "text").mapInArrow(run, f"task int, doc_id {kind}, piece int, start long, length long, ids_crc32 long, number long")


def placed(numbered: DataFrame, where: dict[str, np.ndarray]) -> DataFrame:
    """numbered (number: unique among the pieces of a length, from 0) with sequence_id and offset in place of number."""
    sent = numbered.sparkSession.sparkContext.broadcast(where)
    names = [c for c in numbered.columns if c != "number"]

    def run(batches):
        import pyarrow as pa

        runs = sent.value
        for batch in batches:
            w, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            slot = runs["begin"][w] + number
            at = np.searchsorted(runs["slot"], slot, side="right") - 1
            copies, rest = runs["copies"][at], slot - runs["slot"][at]
            sequence, offset = runs["sequence"][at] + rest // copies, runs["offset"][at] + rest % copies * w
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name != "number")
    return numbered.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """Per piece of every document: doc_id, piece (from 0), start (the document's ids before it), length, ids_crc32 (of its ids as
    little-endian unsigned 32-bit integers), sequence_id and offset (its place in the sequence). Pieces of a sequence follow
    each other without gaps, and hold capacity ids at most.

    docs: doc_id and text; other columns are not read. tokenizer: file of the `tokenizers` library; its ids are those of
    encode(text, add_special_tokens=False), to which the id `end` is added. A null text is an empty one, which is one piece of
    length 1. Rows with one doc_id, or a null one, are documents of their own. Long texts are encoded whole. Empty tables give
    empty results. Which of two pieces of one length takes which place depends on the tasks' partitions.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    cut = staged(pieces_of(docs, Path(tokenizer).read_text(), capacity, end), "pieces")
    counts = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").count().withColumnRenamed("count", "n").collect()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col("length").alias("_length"), F.col("task").alias("_task"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    numbered = cut.join(small(first, BROADCAST_STARTS), (F.col("length") == F.col("_length")) & (F.col("task") == F.col("_task")))
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("_first")).alias("number"))
    return placed(numbered, places(patterns(histogram, capacity), capacity))
