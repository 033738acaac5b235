"""Byte-level BPE encoding and decoding.

The pre-tokeniser's pieces are counted over the whole corpus; the distinct pieces that occur most often are encoded once each by a
fold of Spark's higher-order functions over their bytes, which looks adjacent pairs up in a literal rank map and merges the
leftmost pair of least rank until none has a rank. Documents are then written as ids by these pieces, from a broadcast
dictionary of bounded size. Pieces beyond it are merged in the worker by the same rule, those of many texts side by side
in arrays: inside the fold, each costs many times as much, and a few per cent of all occurrences are such. Decoding concatenates the ids' bytes.
"""

from __future__ import annotations

import base64
import heapq
import io
import json
import re
import uuid
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import give_back, staged, trimmed

#: Distinct pieces in the broadcast dictionary, at most.
DICTIONARY = 1 << 18
#: Counts of pieces are told apart up to this one when the dictionary's least count is looked for.
MOST_COUNT = 10_000
#: A worker hands its counts on when it holds so many distinct pieces.
COUNTED = 100_000
#: A worker remembers so many space-separated words; beyond them, only those of its last texts.
REMEMBERED = 50_000
#: The fold takes time with the square of a piece's bytes; longer pieces are merged with a heap.
LONG = 256
#: Slots of the literal rank map: a list of small maps, as Spark looks through a map entry by entry.
SLOTS = 1 << 14


def load_ranks(path: str) -> dict[bytes, int]:
    """Bytes to rank from a file with a base64 token and a rank on each line; read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as one literal: an array of maps from hexadecimal token to rank; a token's map is at its CRC-32 modulo SLOTS."""
    slots: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    for token, rank in ranks.items():
        key = token.hex()
        slots[zlib.crc32(key.encode()) % SLOTS][key] = rank
    return F.from_json(F.lit(json.dumps(slots)), "array<map<string,int>>")


def folded(piece: Column, maps: Column) -> Column:
    """array<int>: the ids of a binary piece. The literal stands in the plan once, bound to a lambda's variable."""
    return F.get(F.transform(F.array(maps), lambda bound: _folded(piece, bound)), F.lit(0))


def _folded(piece: Column, maps: Column) -> Column:
    last = F.lit(2**31 - 1)
    rank = lambda key: F.get(maps, (F.crc32(key.cast("binary")) % SLOTS).cast("int")).getItem(key)
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    size = F.octet_length(piece)
    single = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(F.lower(F.hex(piece)), 2 * i - 1, F.lit(2)))

    def merged(parts, ranks):
        at = F.array_position(ranks, F.array_min(ranks)).cast("int")
        joined = F.concat(F.slice(parts, 1, at - 1), F.array(F.concat(F.get(parts, at - 1), F.get(parts, at))), F.slice(parts, at + 2, F.size(parts)))
        return F.when(F.array_min(ranks) == last, F.struct(parts.alias("parts"), F.lit(True).alias("done"))).otherwise(F.struct(joined.alias("parts"), F.lit(False).alias("done")))

    def step(state, _):
        parts = state["parts"]
        pairs = F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda i: F.coalesce(rank(F.concat(F.get(parts, i), F.get(parts, i + 1))), last))
        return F.when(state["done"] | (F.size(parts) < 2), state).otherwise(let(pairs, lambda ranks: merged(parts, ranks)))

    start = F.struct(single.alias("parts"), F.lit(False).alias("done"))
    ids = F.aggregate(F.sequence(F.lit(1), size), start, step, lambda state: F.transform(state["parts"], rank))
    return F.when(size > 0, ids).otherwise(F.array().cast("array<int>"))


def merged_by_heap(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one long piece, in time n log n."""
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    after, before = list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
    heap: list[tuple[int, int, bytes, bytes]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(parts) and (r := ranks.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (r, i, parts[i], parts[j]))

    for i in range(len(parts)):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= len(parts) or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, None
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[x] for x in parts if x is not None]


def merged_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one short piece, as Merges.merged gives them for many: the leftmost pair of least rank is merged until none has a rank."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [ranks.get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
    while pairs and (least := min(pairs)) != _NONE:
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
    return [ranks[x] for x in parts]


class Merges:
    """The merges of a rank map as arrays: which two neighbours (ids, or numbers beyond the ranks for bytes without one) make which id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks_end = max(ranks.values(), default=-1) + 1
        ids = {bytes([b]): self.ranks_end + b for b in range(256)} | ranks
        self.bytes = np.array([ids[bytes([b])] for b in range(256)], dtype=np.int64)
        made = {(ids[t[:k]] << 32) | ids[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids}
        # the last key is no pair's
        self.keys = np.array([*sorted(made), 2**63 - 1], dtype=np.int64)
        self.made = np.array([*(made[k] for k in self.keys[:-1].tolist()), _NONE], dtype=np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], _NONE)

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of short pieces as little-endian 32-bit integers: in every round each piece's leftmost pair of least rank is merged;
        pieces without a pair that has a rank are done."""
        ids = self.bytes[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        own = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        pair = np.full(len(ids), _NONE)  # of each id with the next one of its piece
        inside = np.flatnonzero(own[1:] == own[:-1])
        pair[inside] = self._ranks(ids[inside], ids[inside + 1])
        done = []
        while len(ids):
            new = np.ones(len(own), dtype=bool)
            new[1:] = own[1:] != own[:-1]
            starts = np.flatnonzero(new)
            sizes = np.diff(starts, append=len(own))
            least = np.repeat(np.minimum.reduceat(pair, starts), sizes)
            live = least != _NONE
            if not live.all():
                done.append((own[~live], ids[~live]))
                ids, own, pair, least = ids[live], own[live], pair[live], least[live]
                if not len(ids):
                    break
            hit = np.flatnonzero(pair == least)
            hit = hit[np.concatenate([[True], own[hit[1:]] != own[hit[:-1]]])]
            ids[hit] = pair[hit]
            keep = np.ones(len(ids), dtype=bool)
            keep[hit + 1] = False
            ids, own, pair = ids[keep], own[keep], pair[keep]
            hit = hit - np.arange(len(hit))  # one id was taken out for each piece before
            for left in (hit, hit[hit > 0] - 1):
                ends = (left + 1 >= len(own)) | (own[np.minimum(left + 1, len(own) - 1)] != own[left])
                pair[left[ends]] = _NONE
                left = left[~ends]
                pair[left] = self._ranks(ids[left], ids[left + 1])
        own, ids = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, dtype=np.int64) for k in (0, 1))
        if len(ids) and ids.max() >= self.ranks_end:
            raise KeyError(bytes([int(ids.max()) - self.ranks_end]))
        raw = ids[np.argsort(own, kind="stable")].astype("<i4").tobytes()
        ends = np.concatenate([[0], 4 * np.cumsum(np.bincount(own, minlength=len(pieces)))]).tolist()
        return [raw[x:y] for x, y in zip(ends, ends[1:])]


_NONE = 1 << 40


class Splitter:
    """Splits texts at single spaces between other characters, where no piece of the pattern can go on, into words with the space
    before them, and words into pieces."""

    def __init__(self, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall

    def words(self, text: str) -> tuple[str, list[str]]:
        """The first word and the others, which have a space before them, each to be cut into pieces by itself. The whole text is the
        first word if it has white space at an end or side by side."""
        if text[:1].isspace() or text[-1:].isspace() or _TOUCHING(text):
            return text, []
        first, *others = text.split(" ")
        return first, others

    def pieces(self, word: str) -> list[str]:
        body = word[1:] if word[:1] == " " else word
        if body.isalpha():  # letters only, with or without a space, are one piece
            return [word]
        if body[-1:] in _MARKS and body[:-1].isalpha():
            return [word[:-1], word[-1]]
        return self.find(word)


_TOUCHING = re.compile(r"\s\s").search
# Marks that end a piece of letters and are a piece by themselves at a word's end.
_MARKS = tuple(".,;:!?")


def piece_counts(docs: DataFrame, pattern: str) -> DataFrame:
    """piece, n over all texts; workers add up what they have before they hand it on."""

    def run(batches):
        import pyarrow as pa

        split, counts, firsts = Splitter(pattern), Counter(), Counter()

        def flush():
            pieces: dict[str, int] = {}
            for space, words in ((" ", counts), ("", firsts)):
                for word, n in words.items():
                    for piece in split.pieces(space + word):
                        pieces[piece] = pieces.get(piece, 0) + n
                words.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.string()), pa.array(list(pieces.values()), pa.int64())], names=["piece", "n"])

        for batch in batches:
            for text in batch.column(0):
                first, others = split.words(text.as_py() or "")
                firsts[first] += 1
                counts.update(others)
                if len(counts) + len(firsts) >= COUNTED:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(trimmed(run), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, pattern: str, maps: Column, most: int) -> DataFrame:
    """piece, ids of the pieces that occur most often, up to `most` of them and up to LONG bytes, staged."""
    counted = staged(piece_counts(docs, pattern).where(F.octet_length("piece").between(1, LONG)), "pieces")
    tally = counted.groupBy(F.least("n", F.lit(MOST_COUNT)).alias("n")).agg(F.count("*").alias("kinds")).orderBy(F.desc("n")).collect()
    least, held = MOST_COUNT + 1, 0
    for row in tally:
        held += row["kinds"]
        if held > most:
            break
        least = row["n"]
    often = counted.where(F.col("n") >= least)
    if least > MOST_COUNT:  # more than `most` pieces have the largest count that is told apart
        often = counted.where(F.col("n") >= MOST_COUNT).orderBy(F.desc("n"), "piece").limit(most)
    often = often.select(F.col("piece").cast("binary").alias("piece")).repartition("piece")
    return staged(often.select("piece", folded(F.col("piece"), maps).alias("ids")), "dictionary")


#: The dictionary that a worker has read.
_KNOWN: dict[str, dict] = {}


def encoder(docs: DataFrame, ranks: dict[bytes, int], pattern: str, most: int = DICTIONARY):
    """Makes the dictionary of docs and returns the function from batches (doc_id, text) to batches (doc_id, ids)."""
    import pyarrow as pa

    maps = rank_map(ranks)
    known = dictionary(docs, pattern, maps, most).toArrow()
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, known.schema) as out:
        out.write_table(known)
    del known
    spark = docs.sparkSession
    sent, name = spark.sparkContext.broadcast(sink.getvalue()), uuid.uuid4().hex
    del sink
    merges, every = spark.sparkContext.broadcast(Merges(ranks)), spark.sparkContext.broadcast(ranks)

    def run(batches):
        from leafmill.llm.byte_bpe import _KNOWN  # the worker's own, kept between tasks

        if name not in _KNOWN:
            _KNOWN.clear()
            table = pa.ipc.open_stream(sent.value).read_all()
            lists = table["ids"].combine_chunks()
            lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
            raw = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes()
            _KNOWN[name] = {p.as_py().decode(): raw[4 * a : 4 * b] for p, a, b in zip(table["piece"], ends, ends[1:])}
            del table, lists, ends, raw
            give_back()
        known, split = _KNOWN[name], Splitter(pattern)

        def coded(words):
            """The ids of each word as bytes; pieces that the dictionary has not are merged all at once."""
            cut = [split.pieces(word) for word in words]
            rare = {piece: piece.encode() for own in cut for piece in own if piece not in known}
            short = [piece for piece, own in rare.items() if len(own) <= LONG]
            code = dict(zip(short, merges.value.merged([rare[piece] for piece in short]))) if short else {}
            for piece, own in rare.items():
                if len(own) > LONG:
                    code[piece] = np.array(merged_by_heap(own, every.value), dtype="<i4").tobytes()
            return [b"".join([known[piece] if piece in known else code[piece] for piece in own]) for own in cut]

        codes_of: dict[str, bytes] = {}  # of words with a space before them
        for batch in batches:
            step = max(1, batch.num_rows * (2 << 20) // max(1, batch.nbytes))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                cut = [split.words(t.as_py() or "") for t in part.column("text")]
                used = set().union(*(others for _, others in cut))
                fresh = [word for word in used if word not in codes_of]
                codes_of.update(zip(fresh, coded([" " + word for word in fresh])))
                code_of = codes_of.__getitem__
                codes = [first + b"".join(map(code_of, others)) for first, (_, others) in zip(coded([first for first, _ in cut]), cut)]
                if len(codes_of) > REMEMBERED:
                    codes_of = {word: code_of(word) for word in used}
                sizes = np.concatenate([[0], np.cumsum([len(c) // 4 for c in codes])]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(codes), dtype="<i4"), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(sizes), values)], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, most: int = DICTIONARY) -> DataFrame:
    """Per row of docs: doc_id, ids array<int>: the ids of the whole text, as the merges by rank give them for each match of
    pattern by itself, without special tokens.

    A null or empty text has no ids. Repeated rows are encoded one by one; other columns are not read; empty tables give
    empty results. The dictionary has at most `most` pieces and is broadcast; it decides the work, not the result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(trimmed(encoder(docs, ranks, pattern, most)), f"doc_id {kind}, ids array<int>")


def decoder(spark: SparkSession, ranks: dict[bytes, int]):
    """The function from batches (doc_id, ids) to batches (doc_id, ids, decoded)."""
    import pyarrow as pa

    size = np.full(max(ranks.values(), default=-1) + 1, -1, dtype=np.int32)
    start = np.zeros(len(size), dtype=np.int32)
    tokens = sorted(ranks, key=ranks.__getitem__)
    at = np.array([ranks[t] for t in tokens], dtype=np.int64)
    size[at] = [len(t) for t in tokens]
    start[at] = np.cumsum([0, *(len(t) for t in tokens)])[:-1]
    sent = spark.sparkContext.broadcast((size, start, np.frombuffer(b"".join(tokens), dtype=np.uint8)))

    def run(batches):
        size, start, raw = sent.value
        for batch in batches:
            ids = batch.column("ids")
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            if len(flat) and (flat.min() < 0 or flat.max() >= len(size) or size[flat].min() < 0):
                raise KeyError("an id without a token")
            ends = np.concatenate([[0], np.cumsum(size[flat], dtype=np.int64)])
            # each byte's place in raw: its token's start and its place in the token
            out = raw[np.repeat(start[flat] - ends[:-1], size[flat]) + np.arange(ends[-1])].tobytes()
            rows = ends[np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])].tolist()
            decoded = pa.array([out[x:y] for x, y in zip(rows, rows[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, decoded], names=["doc_id", "ids", "decoded"])

    return run


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Per row of encoded (doc_id, ids): doc_id, ids, decoded: the concatenated bytes of the ids; null ids decode as none."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(trimmed(decoder(encoded.sparkSession, ranks)), f"doc_id {kind}, ids array<int>, decoded binary")


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs. The batches go through encoder and decoder in one
    worker, as each step of its own would have workers of its own, with their memory."""
    import hashlib

    import pyarrow as pa

    encoding, decoding = encoder(docs, ranks, pattern), decoder(docs.sparkSession, ranks)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in decoding(encoding(batches)):
            ids = [x.values.to_numpy().astype("<u4").tobytes() if x.is_valid and len(x.values) else b"" for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in batch.column("decoded")], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
