"""N-gram Jaccard join with token-combination prefixes, and the components of its links.

Tokens are hashes of word n-grams, in one order: rare ones by hash, then those that are frequent within batches, by hash. The
first token that two similar sets have in common is in the prefixes of both, so sets are indexed by the rare tokens of their
prefixes. A set that has a frequent token there, or whose token turns out to have a long list, gets a longer prefix and is
indexed by combinations of K tokens. For small sets these are all K-subsets; larger ones take runs of K tokens that follow
each other in the order: two similar sets differ in so few tokens that K common ones follow each other in both, and the first
such run is in both longer prefixes (see extended_length). Sets that merely hold one passage hardly ever share one.

A short list yields its pairs of nodes (distinct sets) whose sizes allow a link. Each node has a parity bitmap as wide as half
its set, which bounds the overlap from above, so that few pairs besides the links are left to be verified on the sets
themselves. In other lists of combinations, nodes meet a leader for a few rounds, which joins groups of near copies at the
cost of a pair a node. Where lists are then still of several components, each node goes with its token set to its longest
list, its home, where blocks are compared exactly within tasks, which return no more links than join their components. Last,
pairs without a common home are compared in the same way in all lists that are left.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import ceil

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import driver_gives_back, dropped, small, staged, trimmed
from leafmill.llm.hashing import mixed, ngrams, word_hashes

#: Tokens in this share of a batch's documents are frequent; the list has the commonest FREQUENT_MOST of them. Which tokens are
#: frequent decides the order of tokens, and so the work, but not the result.
FREQUENT_SHARE, FREQUENT_MOST = 1 / 1000, 50_000
#: Lists with more nodes are long: of frequent tokens, whose sets are indexed by combinations of K tokens instead.
LONG_LIST, K = 16, 3
#: Lists of combinations with up to so many nodes yield their pairs at once.
PAIR_LIST = 4
#: Sets of this size have a run (see run_size); smaller ones, and those that they can be similar to, take K-subsets.
RUN_SIZE = 24
#: Rounds in which nodes meet a leader, and then nodes of one home; nodes in a block of a long list, and tokens in a home's.
LEADER_ROUNDS, HOME_ROUNDS, BLOCK, BLOCK_TOKENS = 1, 2, 4096, 2 << 20
#: Cells a token of the bitmaps by which nodes of one list are compared: few pairs but links pass them.
WIDE = 2
#: Pairs that a task remembers not to be similar; then its memory starts afresh.
MISSES = 1 << 16
#: Nodes whose sets are fetched are broadcast up to this many, and else joined by a shuffle.
BROADCAST_NODES = 500_000
#: Rows of a task that writes labels, edges or hooks: small tables are not left in as many files as there are shuffle partitions.
TASK_ROWS = 50_000


def in_few(df: DataFrame, rows: int) -> DataFrame:
    """df, of about so many rows, in one partition for each TASK_ROWS of them, if it has more."""
    return df.coalesce(max(1, ceil(rows / TASK_ROWS)))


def token_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles, A-Z lowered; of the whole sequence, if it has fewer words."""
    ids, at = word_hashes(texts)
    windows, out = ngrams(ids, n), []
    for a, b in zip(at.tolist(), at[1:].tolist()):
        own = np.sort(windows[a : b - n + 1] if b - a >= n else ngrams(ids[a:b], max(1, b - a)))
        new = np.ones(len(own), dtype=bool)
        new[1:] = own[1:] != own[:-1]
        out.append(own[new])
    return out


def prefix_length(size: int, num: int, den: int) -> int:
    return size - ceil(size * num / den) + 1


def number_of(key: bytes) -> int:
    return int.from_bytes(key[:8], "big") >> 1


def node_of(tokens: np.ndarray, clashes: dict[bytes, int] | None = None) -> tuple[int, bytes]:
    """The number and the 128-bit key of a set. Numbers are 63 bits of the key, but for keys that would clash."""
    import hashlib

    key = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return (clashes or {}).get(key, number_of(key)), key


def bitmap(tokens: np.ndarray, scale: float = 0.5) -> bytes:
    """Parities of the set's tokens over scale times as many cells as tokens, rounded up to a power of two. Cells in which two
    bitmaps differ number no more than the tokens that are in one set only; a bitmap folded in halves is one of fewer cells."""
    cells = max(128, 1 << (int(len(tokens) * scale) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """In how many cells two bitmaps differ, the wider one folded to the narrower."""
    if len(x) < len(y):
        x, y = y, x
    a, width = int.from_bytes(x, "little"), 8 * len(x)
    while width > 8 * len(y):
        width //= 2
        a = (a >> width) ^ (a & ((1 << width) - 1))
    return (a ^ int.from_bytes(y, "little")).bit_count()


def ordered(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """tokens, which are sorted, with the frequent ones last, and the number of the others."""
    if not len(frequent):
        return tokens, len(tokens)
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    often = frequent[at] == tokens
    return np.concatenate([tokens[~often], tokens[often]]), int(len(tokens) - often.sum())


def extended_length(size: int, num: int, den: int) -> int:
    """How far the first run of K common tokens can be. Up to its end, at most K - 1 common tokens stand between two that only
    one set has; so in a set with d of its own, and e of the other's, its end is at (K - 1)(d + e) + K + d at most.
    That is linear in the other's size between the sizes at which it is decided here."""
    most = 0
    for other in (ceil(size * num / den), size * den // num):
        common = ceil(num * (size + other) / (num + den))
        d, e = size - min(size, common), other - min(other, common)
        most = max(most, (K - 1) * (d + e) + K + d)
    return most + K


def run_size(num: int, den: int) -> int | None:
    """From which size on two similar sets have a run of K common tokens; None at similarities of under 0.7, where single tokens
    stay. Without a run, c common and x other tokens would fit c <= (K - 1)(x + 1); both grow with the sizes' sum."""
    if 10 * num < 7 * den:
        return None
    least = K / ((2 * K - 1) * num / (num + den) - (K - 1))
    return max(RUN_SIZE, ceil(least / (1 + num / den)) + 1)


@cache
def _subsets(length: int) -> np.ndarray:
    return np.array(list(combinations(range(length), K)), dtype=np.int64).reshape(-1, K)


def combination_keys(tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes of the combinations by which a set is indexed, its tokens given in their order. Similar sets share
    ceil(size * num / den) tokens at least, so the first K common ones are among the first size - that + K of both."""
    size, runs = len(tokens), run_size(num, den)
    least, keys = ceil(size * num / den), []
    if runs is None or least < K:
        keys.append(mixed(tokens[: prefix_length(size, num, den)]))
    if runs is not None and size >= runs:
        keys.append(ngrams(tokens[: extended_length(size, num, den)], K))
    if runs is not None and least < runs:
        keys.append(ngrams(tokens[_subsets(min(size, size - least + K))].T, K).ravel())
    return np.unique(np.concatenate(keys))


def _batches(docs: DataFrame, make, schema: str) -> DataFrame:
    """Rows that make() -> f(batch columns) yields as lists or numpy arrays; batches are of about 4 MB."""
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out, f = to_arrow_schema(kind), make()
        for batch in batches:
            step = max(1, batch.num_rows * (4 << 20) // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                columns = f(*(c.to_pylist() for c in batch.slice(at, step).columns))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, out.types, strict=True)], schema=out)

    return docs.mapInArrow(trimmed(run), kind)


def nodes(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_key (MD5 of the text), node (null for empty sets), key, size, bits of every row; rows with equal sets have one
    node. Besides, with size null: tok, count of the tokens that are common within a batch of documents."""
    from hashlib import md5

    def make():
        def f(doc_ids, texts):
            sets = token_sets(texts, n)
            named = [node_of(s) if len(s) else (None, None) for s in sets]
            tokens, counts = np.unique(np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64), return_counts=True)
            keep = counts >= max(4, FREQUENT_SHARE * len(sets))
            tokens, counts = tokens[keep].view(np.int64).tolist(), counts[keep].tolist()
            pad, more = [None] * len(sets), [None] * len(tokens)
            keys = [md5((t or "").encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for t in texts]
            return doc_ids + more, keys + more, [x for x, _ in named] + more, [k for _, k in named] + more, [len(s) for s in sets] + more, [bitmap(s) if len(s) else None for s in sets] + more, pad + tokens, pad + counts

        return f

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _batches(docs.select("doc_id", "text"), make, f"doc_id {kind}, text_key binary, node long, key binary, size long, bits binary, tok long, count long")


def frequent_tokens(found: DataFrame) -> np.ndarray:
    """Sorted hashes of the commonest tokens that nodes() has counted; at most FREQUENT_MOST."""
    sums = found.where(F.col("tok").isNotNull()).groupBy("tok").agg(F.sum("count").alias("n"))
    rows = sums.orderBy(F.desc("n"), "tok").limit(FREQUENT_MOST).select("tok").collect()
    return np.sort(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64))


class Sets:
    """A table's rows (doc_id, text_key, node, size) with their nodes, one row a node (info: node, doc_id, size, bits), and what the
    passes over the texts need: the n of n-grams, the similarity num / den, frequent tokens and numbers of clashing keys."""

    def __init__(self, docs: DataFrame, n: int, num: int, den: int):
        self.docs, self.n, self.num, self.den, self.clashes = docs, n, num, den, {}
        found = staged(nodes(docs, n), "nodes")
        self.frequent = frequent_tokens(found)
        self.rows = found.where(F.col("size").isNotNull()).drop("tok", "count")
        self.info = self._nodes("node")
        clash = self.info.where("_k1 <> _k2").select(F.col("node").alias("_n"))
        if not clash.isEmpty():  # of 1e11 sets, some 500 are expected to
            keys = [bytes(r[0]) for r in self.rows.join(F.broadcast(clash), F.col("node") == F.col("_n")).select("key").distinct().collect()]
            self.clashes = {k: -1 - i for i, k in enumerate(sorted(keys))}
            named = docs.sparkSession.createDataFrame([(bytearray(k), v) for k, v in self.clashes.items()], "key binary, _n long")
            self.rows = self.rows.join(F.broadcast(named), "key", "left").withColumn("node", F.coalesce("_n", "node")).drop("_n")
            self.info = self._nodes("node")

    def _nodes(self, by: str) -> DataFrame:
        named = self.rows.where(F.col("node").isNotNull()).groupBy(by)
        return staged(named.agg(F.min("doc_id").alias("doc_id"), F.min("size").alias("size"), F.min("key").alias("_k1"), F.max("key").alias("_k2"), F.min("bits").alias("bits")), "node-info")

    def index(self) -> DataFrame:
        """tok, node, size: all sets by the rare tokens of their prefixes; size is -1 in a row of a set that also has a
        frequent one there. Rows of one task with equal sets are indexed once."""
        n, num, den, frequent, clashes = self.n, self.num, self.den, self.frequent, self.clashes

        def make():
            seen: set[int] = set()

            def f(texts):
                toks, owners, sizes = [], [], []
                for s in token_sets(texts, n):
                    if len(s) and (node := node_of(s, clashes)[0]) not in seen:
                        seen.add(node)
                        in_order, rare = ordered(s, frequent)
                        length = prefix_length(len(s), num, den)
                        keys = in_order[: min(length, rare)]
                        if length > rare:
                            keys = np.append(keys, mixed(np.array([node], dtype=np.int64).view(np.uint64)))
                        size = np.full(len(keys), len(s), dtype=np.int64)
                        size[min(length, rare) :] = -1
                        toks.append(keys.view(np.int64))
                        owners.append(np.full(len(keys), node, dtype=np.int64))
                        sizes.append(size)
                return [np.concatenate(c) if c else [] for c in (toks, owners, sizes)]

            return f

        return _batches(self.docs.select("text"), make, "tok long, node long, size long")

    def _texts(self, wanted: DataFrame) -> DataFrame:
        """node, text of the wanted (node, doc_id). A doc_id may have several texts: the caller looks at the node again."""
        want = small(wanted.select("node", F.col("doc_id").alias("_d")), BROADCAST_NODES)
        return self.docs.select("doc_id", "text").join(want, F.col("doc_id").eqNullSafe(F.col("_d"))).select("node", "text")

    def combinations(self, wanted: DataFrame) -> DataFrame:
        """tok, node, size: the wanted (node, doc_id) by combinations of K tokens."""
        n, num, den, frequent, clashes = self.n, self.num, self.den, self.frequent, self.clashes

        def make():
            seen: set[int] = set()

            def f(owners, texts):
                toks, nodes, sizes = [], [], []
                for node, s in zip(owners, token_sets(texts, n)):
                    if len(s) and node not in seen and node_of(s, clashes)[0] == node:
                        seen.add(node)
                        keys = combination_keys(ordered(s, frequent)[0], num, den)
                        toks.append(keys.view(np.int64))
                        nodes.append(np.full(len(keys), node, dtype=np.int64))
                        sizes.append(np.full(len(keys), len(s), dtype=np.int64))
                return [np.concatenate(c) if c else [] for c in (toks, nodes, sizes)]

            return f

        return _batches(self._texts(wanted), make, "tok long, node long, size long")

    def tokens(self, wanted: DataFrame) -> DataFrame:
        """node, tokens of the wanted (node, doc_id)."""
        n, clashes = self.n, self.clashes

        def make():
            def f(owners, texts):
                sets = token_sets(texts, n)
                right = [i for i, s in enumerate(sets) if len(s) and node_of(s, clashes)[0] == owners[i]]
                return [owners[i] for i in right], [sets[i].view(np.int64) for i in right]

            return f

        return _batches(self._texts(wanted), make, "node long, tokens array<long>").dropDuplicates(["node"])

    def bitmaps(self, wanted: DataFrame, scale: float) -> DataFrame:
        """node, size, bits of the wanted (node, doc_id): bitmaps of scale cells a token."""
        n, clashes = self.n, self.clashes

        def make():
            seen: set[int] = set()

            def f(owners, texts):
                found = [(o, s) for o, s in zip(owners, token_sets(texts, n)) if o not in seen]
                found = [(o, s) for o, s in found if len(s) and node_of(s, clashes)[0] == o]
                seen.update(o for o, _ in found)
                return [o for o, _ in found], [len(s) for _, s in found], [bitmap(s, scale) for _, s in found]

            return f

        rows = _batches(self._texts(wanted), make, "node long, size long, bits binary")
        return rows.groupBy("node").agg(F.min("size").alias("size"), F.min("bits").alias("bits"))

    def near(self, pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b, ...) whose sizes and bitmaps allow a link, with both sizes (na, nb) and doc_ids (da, db)."""
        num, den = self.num, self.den
        side = lambda x: self.info.select(F.col("node").alias(x), F.col("size").alias(f"n{x}"), F.col("doc_id").alias(f"d{x}"), F.col("bits").alias(f"m{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        both = both.where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
        kept = [c for c in both.columns if c not in ("ma", "mb")]

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                na, nb, ma, mb = (batch.column(c).to_pylist() for c in ("na", "nb", "ma", "mb"))
                # similar sets have at least num * (na + nb) / (num + den) tokens in common
                may = [(num + den) * (x + y - apart(p, q)) >= 2 * num * (x + y) for x, y, p, q in zip(na, nb, ma, mb)]
                yield batch.select(kept).filter(pa.array(may, pa.bool_()))

        return both.mapInArrow(trimmed(run), both.select(kept).schema)

    def linked(self, near: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """Those pairs of near() that are similar enough, written; their token sets are fetched unless given."""
        if sets is None:
            near = staged(near, "candidates")
            fetched = sets = self.sets_of(near)
        else:
            fetched = None
        own = lambda x: sets.select(F.col("node").alias(x), F.col("tokens").alias(f"t{x}"))
        both = near.join(own("a"), "a").join(own("b"), "b").withColumn("inter", F.size(F.array_intersect("ta", "tb")).cast("long"))
        links = staged(both.where(F.col("inter") * self.den >= self.num * (F.col("na") + F.col("nb") - F.col("inter"))).select("a", "b"), "links")
        if fetched is not None:
            dropped(near, fetched)
        return links

    def sets_of(self, near: DataFrame) -> DataFrame:
        wanted = near.select(F.col("a").alias("node"), F.col("da").alias("doc_id")).union(near.select("b", "db")).distinct()
        return staged(self.tokens(wanted), "sets")

    def lists(self) -> tuple[DataFrame, DataFrame]:
        """Candidates (a < b, star, na, nb, da, db) of the short lists, as near() keeps them; and tok, node of the long lists of
        combinations. Each two similar nodes are a candidate or in one long list. star: one of the two leads a list."""
        single = staged(list_pairs(self.index(), self.num, self.den, LONG_LIST), "pairs")
        flagged = single.where(F.col("b").isNull()).select(F.col("a").alias("node")).distinct()
        wanted = staged(flagged.join(self.info.select("node", "doc_id"), "node"), "long-lists")
        more = staged(list_pairs(self.combinations(wanted), self.num, self.den, PAIR_LIST), "pairs")
        pairs = single.select("a", "b", "star").union(more.select("a", "b", "star")).where(F.col("b").isNotNull())
        near = staged(self.near(pairs.groupBy("a", "b").agg(F.max("star").alias("star"))), "candidates")
        long = staged(more.where(F.col("b").isNull()).select("tok", F.col("a").alias("node")).distinct(), "lists")
        dropped(single, wanted, more)
        return near, long


def list_pairs(rows: DataFrame, num: int, den: int, most: int) -> DataFrame:
    """From lists (tok, node, size): a < b, star, the pairs of lists of up to `most` nodes whose sizes allow a link, where
    star says that a is the list's first node; and, with b null, a, tok of the other lists and of rows with a negative size.
    A list streams through its task; no more than `most` of its rows and a batch are held."""

    def run(batches):
        import pyarrow as pa

        def out(a, b, star, tok):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(star, pa.bool_()), pa.array(tok, pa.int64())], names=["a", "b", "star", "tok"])

        def alone(tok, node):
            return out(node, [None] * len(node), [False] * len(node), tok)

        held, known = [np.zeros(0, dtype=np.int64)] * 3, None
        for batch in _with_end(batches):
            parts = held if batch is None else [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
            again = np.zeros(len(parts[0]), dtype=bool)
            again[1:] = (parts[0][1:] == parts[0][:-1]) & (parts[1][1:] == parts[1][:-1]) & (parts[2][1:] == parts[2][:-1])
            tok, node, size = (c[~again] for c in parts)
            tell = size < 0
            if known is not None:
                tell |= tok == known  # the rest of a list that is known to be long
            if tell.any():
                yield alone(tok[tell], node[tell])
                tok, node, size = tok[~tell], node[~tell], size[~tell]
            if not len(tok):
                held = [tok, node, size]
                continue
            starts = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
            lengths = np.diff(np.concatenate([starts, [len(tok)]]))
            if batch is not None:  # the last list may go on in the next batch
                if lengths[-1] > most:
                    known, held = tok[-1], [c[:0] for c in (tok, node, size)]
                else:
                    held = [c[starts[-1] :] for c in (tok, node, size)]
                    starts, lengths = starts[:-1], lengths[:-1]
            rows_of_long = np.repeat(lengths > most, lengths)
            at = np.flatnonzero(rows_of_long)
            if len(at):
                yield alone(tok[at], node[at])
            found = []
            for length in np.unique(lengths[(lengths > 1) & (lengths <= most)]).tolist():
                first = starts[lengths == length]
                i, j = np.triu_indices(length, 1)
                a, b = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
                may = np.minimum(size[a], size[b]) * den >= np.maximum(size[a], size[b]) * num
                found.append(np.stack([node[a], node[b], np.broadcast_to(i == 0, (len(first), len(i))).ravel()])[:, may])
            if found:
                a, b, star = np.unique(np.concatenate(found, axis=1), axis=1)
                yield out(a, b, star == 1, np.full(len(a), None))

    dealt = rows.repartition("tok").sortWithinPartitions("tok", "node")
    return dealt.mapInArrow(trimmed(run), "a long, b long, star boolean, tok long")


def contracted(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (node, comp) with the links (a, b) taken in: comp is the least node that links reach. Components hook to the
    least one they link with, chains are halved by jumping, and links are contracted until none is left."""
    if labels is not None and links.isEmpty():
        return labels
    old, most = labels, 2 * links.count() + (0 if labels is None else labels.count())
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    if labels is None:
        labels = ends.select("node", F.col("node").alias("comp"))
    else:
        labels = labels.join(ends, "node", "full").select("node", F.coalesce("comp", "node").alias("comp"))
    labels = staged(in_few(labels, most), "labels")
    if old is not None:
        dropped(old)
    on = lambda side: labels.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}"))
    edges = links.join(on("a"), "a").join(on("b"), "b").select(F.least("ca", "cb").alias("lo"), F.greatest("ca", "cb").alias("hi"))
    edges = staged(in_few(edges.where("lo < hi").distinct(), most), "edges")
    while left := edges.count():
        hook = staged(in_few(edges.groupBy("hi").agg(F.min("lo").alias("to")), left), "hooks")
        while True:
            up = hook.select(F.col("hi").alias("_h"), F.col("to").alias("_t"))
            jumped = staged(in_few(hook.join(up, F.col("to") == F.col("_h"), "left").select("hi", F.coalesce("_t", "to").alias("to"), F.col("_t").isNotNull().alias("moved")), left), "hooks")
            dropped(hook)
            hook = jumped
            if jumped.where("moved").isEmpty():
                break
        old, labels = labels, staged(in_few(labels.join(hook, F.col("comp") == F.col("hi"), "left").select("node", F.coalesce("to", "comp").alias("comp")), most), "labels")
        dropped(old)
        a, b = (hook.select(F.col("hi").alias(f"h{x}"), F.col("to").alias(f"t{x}")) for x in "ab")
        moved = edges.join(a, F.col("lo") == F.col("ha"), "left").join(b, F.col("hi") == F.col("hb"), "left").select(F.coalesce("ta", "lo").alias("x"), F.coalesce("tb", "hi").alias("y"))
        before, edges = edges, staged(in_few(moved.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).where("lo < hi").distinct(), left), "edges")
        dropped(before, hook)
    dropped(edges)
    driver_gives_back(links.sparkSession)
    return labels


def _classes(at: np.ndarray, size: np.ndarray, bits) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows by the width of their bitmaps, in the order of their sizes, and these bitmaps."""
    widths = np.array([len(bits[k]) // 8 for k in at], dtype=np.int64)
    out = []
    for width in np.unique(widths).tolist():
        rows = at[widths == width]
        rows = rows[np.argsort(size[rows], kind="stable")]
        out.append((rows, np.frombuffer(b"".join(bits[k] for k in rows), dtype="<u8").reshape(len(rows), width)))
    return out


def _folded(maps: np.ndarray, width: int) -> np.ndarray:
    while maps.shape[1] > width:
        maps = maps[:, : maps.shape[1] // 2] ^ maps[:, maps.shape[1] // 2 :]
    return maps


def _may_link(left: np.ndarray, right: np.ndarray, size: np.ndarray, bits, num: int, den: int):
    """Chunks of (i, j): rows of left and right that sizes and bitmaps allow to be similar."""
    others = _classes(right, size, bits)
    for rows_a, maps_a in _classes(left, size, bits):
        for rows_b, maps_b in others:
            width = min(maps_a.shape[1], maps_b.shape[1])
            a, b, sizes = _folded(maps_a, width), _folded(maps_b, width), size[rows_b]
            step = max(1, (1 << 20) // (width * len(rows_b)))
            for at in range(0, len(rows_a), step):
                i = rows_a[at : at + step]
                lo = np.searchsorted(sizes, -(-size[i[0]] * num // den), "left")
                hi = np.searchsorted(sizes, size[i[-1]] * den // num, "right")
                j = rows_b[lo:hi]
                if len(j):
                    differ = np.bitwise_count(a[at : at + step][:, None, :] ^ b[lo:hi][None, :, :]).sum(axis=2, dtype=np.int64)
                    na, nb = size[i][:, None], size[j][None, :]
                    x, y = np.nonzero((np.minimum(na, nb) * den >= np.maximum(na, nb) * num) & ((num + den) * (na + nb - differ) >= 2 * num * (na + nb)))
                    if len(x):
                        yield i[x], j[y]


def _groups(batches, keys: int, objects: tuple[int, ...]):
    """Lists of rows that agree in the first `keys` columns, batch after batch, as tuples of arrays; the columns numbered in
    objects hold Python values. Rows must come sorted by those keys."""
    held: list = []
    for batch in _with_end(batches):
        if batch is not None and batch.num_rows == 0:
            continue
        parts = list(held)
        if batch is not None:
            columns = []
            for k in range(batch.num_columns):
                if k in objects:
                    values = np.empty(batch.num_rows, dtype=object)
                    values[:] = [v.values.to_numpy() if hasattr(v, "values") else v.as_py() for v in batch.column(k)]
                    columns.append(values)
                else:
                    columns.append(batch.column(k).to_numpy())
            parts.append(tuple(columns))
        if not parts:
            continue
        rows = [np.concatenate(c) for c in zip(*parts)]
        new = np.zeros(len(rows[0]) - 1, dtype=bool)
        for key in rows[:keys]:
            new |= key[1:] != key[:-1]
        starts = np.concatenate([[0], np.flatnonzero(new) + 1]).tolist()
        ends = [*starts[1:], len(rows[0])]
        if batch is not None:  # the last group may go on in the next batch
            held = [tuple(c[starts[-1] :] for c in rows)]
            starts, ends = starts[:-1], ends[:-1]
        yield [tuple(c[s:e] for c in rows) for s, e in zip(starts, ends)]


def _spread(homes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The former homes of each row as a matrix, and where it has some."""
    spread = np.zeros((len(homes), max(map(len, homes), default=0)), dtype=np.int64)
    known = np.zeros(spread.shape, dtype=bool)
    for r, own in enumerate(homes):
        spread[r, : len(own)], known[r, : len(own)] = own, True
    return spread, known


def _pairs_batch(found: list) -> object:
    import pyarrow as pa

    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def _unmet(bi, bj, block, node, comp, size, homes, bits, num: int, den: int):
    """Chunks of (i, j): rows of blocks bi and bj of one list, of different components and without a common home, whose sizes and
    bitmaps allow them to be similar."""
    spread, known = _spread(homes)
    for i, j in _may_link(np.flatnonzero(block == bi[0]), np.flatnonzero(block == bj[0]), size, bits, num, den):
        met = (known[i] & known[j] & (spread[i] == spread[j])).any(axis=1)
        ok = (comp[i] != comp[j]) & ~met & ((node[i] < node[j]) | (bi[0] != bj[0]))
        if ok.any():
            yield i[ok], j[ok]


def close_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """a < b of rows (tok, bi, bj, block, node, comp, size, homes, bits), sorted by tok, bi, bj: the pairs that _unmet() finds. Their
    number grows with the square of a list's near misses."""

    def run(batches):
        found, held = [], 0
        for groups in _groups(batches, 3, (7, 8)):
            for _, bi, bj, block, node, comp, size, homes, bits in groups:
                for i, j in _unmet(bi, bj, block, node, comp, size, homes, bits, num, den):
                    x, y = node[i], node[j]
                    found.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
                    held += len(x)
            if held > 1 << 19:  # a pair is met in many lists
                found = [np.unique(np.concatenate(found, axis=1), axis=1)]
                held = found[0].shape[1]
            if held > 1 << 18:
                yield _pairs_batch(found)
                found, held = [], 0
        if found:
            yield _pairs_batch(found)

    return rows.select("tok", "bi", "bj", "block", "node", "comp", "size", "homes", "bits").mapInArrow(trimmed(run), "a long, b long")


def with_partner(rows: DataFrame, num: int, den: int) -> DataFrame:
    """tok, node of the rows that are in a pair of close_pairs(); no more than there are rows."""

    def run(batches):
        import pyarrow as pa

        for groups in _groups(batches, 3, (7, 8)):
            found = []
            for tok, bi, bj, block, node, comp, size, homes, bits in groups:
                some = np.zeros(len(node), dtype=bool)
                for i, j in _unmet(bi, bj, block, node, comp, size, homes, bits, num, den):
                    some[i] = some[j] = True
                found.append(np.stack([tok[some], node[some]]))
            if found:
                tok, node = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(tok), pa.array(node)], names=["tok", "node"])

    return rows.select("tok", "bi", "bj", "block", "node", "comp", "size", "homes", "bits").mapInArrow(trimmed(run), "tok long, node long")


class Joined:
    """Which components the links of a task have joined so far."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def of(self, comp: int) -> int:
        while (above := self.up.get(comp)) is not None:
            if (top := self.up.get(above)) is not None:
                self.up[comp] = top
            comp = above
        return comp

    def roots(self, comps: np.ndarray) -> np.ndarray:
        own, back = np.unique(comps, return_inverse=True)
        return np.array([self.of(c) for c in own.tolist()], dtype=np.int64)[back]


def joining_links(rows: DataFrame, num: int, den: int) -> DataFrame:
    """a < b of rows (tok, bi, bj, block, node, comp, homes, tokens), sorted by tok, bi, bj: links between blocks bi and bj of one
    list, so many that with those of the lists before in the task they join all components that its links join; so a task yields
    fewer than it has components. Sets are compared themselves, after bitmaps of 8 cells a token, but for pairs with a common home."""

    def run(batches):
        joined, misses = Joined(), set()  # a pair of near misses is met in many lists
        for groups in _groups(batches, 3, (6, 7)):
            found = []
            for tok, bi, bj, block, node, comp, homes, tokens in groups:
                root = joined.roots(comp)
                if (root == root[0]).all():
                    continue
                sets = [np.asarray(t).view(np.uint64) for t in tokens]
                size = np.array([len(t) for t in sets], dtype=np.int64)
                bits = [bitmap(t, 8) for t in sets]
                for i, j in _unmet(bi, bj, block, node, root, size, homes, bits, num, den):
                    for x, y in zip(i.tolist(), j.tolist()):
                        pair = (int(min(node[x], node[y])), int(max(node[x], node[y])))
                        if root[x] == root[y] or pair in misses:
                            continue
                        common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                        if common * den >= num * (size[x] + size[y] - common):
                            joined.up[int(root[y])] = int(root[x])
                            root[root == root[y]] = root[x]
                            found.append([[pair[0]], [pair[1]]])
                        else:
                            if len(misses) >= MISSES:
                                misses.clear()
                            misses.add(pair)
            if found:
                yield _pairs_batch(found)

    return rows.select("tok", "bi", "bj", "block", "node", "comp", "homes", "tokens").mapInArrow(trimmed(run), "a long, b long")


def _with_end(batches):
    yield from batches
    yield None


def _dealt(lists: DataFrame, blocks) -> DataFrame:
    """lists (tok, node, ...) with bi, bj, block, sorted by tok, bi, bj within partitions: a row for each pair of its list's blocks
    that has its own."""
    parts = lists.withColumn("_n", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
    parts = parts.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    parts = parts.withColumns({"bi": F.least("block", "_o"), "bj": F.greatest("block", "_o")}).drop("_o", "_n")
    return parts.repartition("tok", "bi", "bj").sortWithinPartitions("tok", "bi", "bj")


def _compared(lists: DataFrame, sets: Sets) -> DataFrame:
    """a < b: verified links between the nodes of one list (tok, node, comp, length, homes) that are of different components and
    have no common home."""
    wanted = staged(lists.select("node").distinct().join(sets.info.select("node", "doc_id"), "node"), "compared")
    bits = staged(sets.bitmaps(wanted, WIDE), "bitmaps")
    rows = _dealt(lists.join(bits, "node"), F.ceil(F.col("length") / BLOCK))
    links = sets.linked(sets.near(close_pairs(rows, sets.num, sets.den).distinct()))
    dropped(wanted, bits)
    return links


def _at_home(lists: DataFrame, sets: Sets) -> tuple[DataFrame, DataFrame]:
    """Links that join the components within each node's longest list (tok, node, comp, length, homes) but for its former homes,
    and node, home."""
    longest = F.max(F.struct("length", "tok"))
    home = lists.where(~F.array_contains("homes", F.col("tok"))).groupBy("node").agg(longest.alias("h"), F.min("comp").alias("comp"), F.min("homes").alias("homes")).select("node", "comp", "homes", F.col("h")["tok"].alias("tok"))
    home = staged(home.join(sets.info.select("node", "doc_id", "size"), "node"), "homes")
    return _joining(home, sets), home.select("node", F.col("tok").alias("home"))


def _left_over(lists: DataFrame, sets: Sets) -> DataFrame:
    """Links that join the components within all lists (tok, node, comp, length, homes), pairs with a common home apart. Token sets go
    only to the lists in which a node's bitmap leaves it a partner."""
    wanted = staged(lists.select("node").distinct().join(sets.info.select("node", "doc_id"), "node"), "compared")
    bits = staged(sets.bitmaps(wanted, WIDE), "bitmaps")
    rows = _dealt(lists.join(bits, "node"), F.ceil(F.col("length") / BLOCK))
    some = staged(with_partner(rows, sets.num, sets.den).distinct(), "partners")
    left = lists.select("tok", "node", "comp", "homes").join(some, ["tok", "node"]).join(sets.info.select("node", "doc_id", "size"), "node")
    links = _joining(left, sets)
    dropped(wanted, bits, some)
    return links


def _joining(lists: DataFrame, sets: Sets) -> DataFrame:
    """joining_links() of lists (tok, node, doc_id, size, comp, homes), to which token sets are fetched, written."""
    volumes = lists.groupBy("tok").agg(F.sum("size").alias("volume"), F.count("*").alias("members")).where("members > 1")
    # a set goes with every pair of blocks, but lists of under BLOCK_TOKENS have one
    own = lists.join(small(volumes, BROADCAST_NODES), "tok")
    wanted = staged(own.select("node", "doc_id").distinct(), "compared")
    tokens = staged(sets.tokens(wanted), "sets")
    rows = own.select("tok", "node", "comp", "homes", "volume", "members").join(tokens, "node")
    blocks = F.greatest(F.ceil(F.col("volume") / BLOCK_TOKENS), F.ceil(F.col("members") / BLOCK))
    links = staged(joining_links(_dealt(rows, blocks), sets.num, sets.den).distinct(), "links")
    dropped(wanted, tokens)
    return links


def _apart(near: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) whose nodes are of different components."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}"))
    both = near.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*near.columns)


def ngram_join(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Per row of docs: doc_id, n_shingles (set size), component_id (least doc_id that links reach, its own included).

    Two rows link when their sets of n-word shingles are not empty and den * intersection >= num * union. All links
    between different sets are found or implied by a component; rows with equal sets are one node throughout.

    Null or wordless texts have empty sets and are linked with nothing: component_id is their own doc_id. Rows of one
    doc_id with different texts are judged one by one. A null doc_id takes part; its component_id is the least other
    doc_id, or null. Columns besides doc_id and text are not read; empty tables give empty results.
    """
    return components(docs, n, num, den).select("doc_id", F.col("size").alias("n_shingles"), "component_id")


def one_of_each_group(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs without near duplicates: of each component of links, the row with the least doc_id (null last) and then the
    least hash of its text stays, and that once if it is repeated. Rows without words all stay. Decisions are by doc_id and
    text, so rows of one doc_id with different texts are judged one by one. Texts are not shuffled unless more than
    BROADCAST_NODES rows go."""
    found = components(docs, n, num, den).where("comp IS NOT NULL").select("comp", "doc_id", "text_key")
    found = staged(found.groupBy("comp", "doc_id", "text_key").agg(F.count("*").alias("n")), "groups")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    groups = found.groupBy("comp").agg(F.min(first).alias("first"), F.count("*").alias("members")).where("members > 1").select("comp", "first")
    other = ~(F.col("first")["doc_id"].eqNullSafe(F.col("doc_id")) & (F.col("first")["text_key"] == F.col("text_key")))
    groups = staged(groups, "group-firsts")
    gone = staged(found.join(small(groups, BROADCAST_NODES), "comp").where(other).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")), "gone")
    twice = staged(found.where("n > 1").select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")), "repeated")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_key"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k"))
    kept = keyed.join(small(gone, BROADCAST_NODES), same, "left_anti")
    if not twice.isEmpty():
        again = small(twice, BROADCAST_NODES)
        kept = kept.join(again, same, "left_anti").union(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text_key"]))
    return kept.select("row.*")


def components(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, text_key, size, comp, component_id of every row of docs; comp numbers the components, null for empty sets. See
    ngram_join."""
    sets = Sets(docs, n, num, den)
    near, long = sets.lists()
    fetched = sets.sets_of(near)
    labels = contracted(None, sets.linked(near.where("star"), fetched))
    labels = contracted(labels, sets.linked(_apart(near.where("not star"), labels), fetched))
    dropped(near, fetched)
    long = staged(long.select("tok", "node", F.array().cast("array<bigint>").alias("homes")), "lists")
    for turn in range(LEADER_ROUNDS + HOME_ROUNDS + 1):
        if long.isEmpty():
            break
        # lists of one component are done
        own = staged(long.select("tok", "node", "homes").join(labels, "node", "left").select("tok", "node", "homes", F.coalesce("comp", "node").alias("comp")), "lists")
        lead = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "comp")).alias("lead")
        live = own.groupBy("tok").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), lead, F.count("*").alias("length")).where("_lo < _hi").select("tok", "lead", "length")
        live = staged(live, "leaders")
        before, long = long, staged(own.join(small(live, BROADCAST_NODES), "tok"), "lists")
        dropped(before, own, live)
        if turn < LEADER_ROUNDS:
            led = long.where(F.col("comp") != F.col("lead")["comp"]).groupBy("node", F.col("lead")["node"].alias("leader")).agg(F.count("*").alias("n"))
            best = led.groupBy("node").agg(F.max(F.struct("n", "leader")).alias("best")).select(F.least("node", F.col("best")["leader"]).alias("a"), F.greatest("node", F.col("best")["leader"]).alias("b"))
            labels = contracted(labels, sets.linked(sets.near(best.distinct())))
        elif turn < LEADER_ROUNDS + HOME_ROUNDS:
            links, home = _at_home(long, sets)
            labels = contracted(labels, links)
            before, long = long, staged(long.join(home, "node", "left").withColumn("homes", F.when(F.col("home").isNull(), F.col("homes")).otherwise(F.array_append("homes", F.col("home")))), "lists")
            dropped(before)
        else:
            labels = contracted(labels, _left_over(long, sets))
    named = sets.info.select("node", "doc_id").join(labels, "node", "left").select("node", "doc_id", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    known = named.select("node", "comp").join(least, "comp").select("node", "comp", "component_id")
    out = sets.rows.select("doc_id", "text_key", "node", "size").join(known, "node", "left")
    return out.select("doc_id", "text_key", "size", "comp", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def ngram_links(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """Links and members. Links: a < b, every pair of different sets (nodes) with den * intersection >= num * union, verified.
    Members: doc_id, node of every row with a set; rows of one node have equal sets and are linked, too.

    Components of links are those of ngram_join, which finds them with fewer comparisons. Links inside a group of near
    copies are all found here, so their number, and the work, grow with the square of its different sets."""
    sets = Sets(docs, n, num, den)
    near, long = sets.lists()
    links = sets.linked(near.drop("star"))
    lengths = long.groupBy("tok").agg(F.count("*").alias("length"))
    lists = long.join(small(lengths, BROADCAST_NODES), "tok").select("tok", "node", F.col("node").alias("comp"), "length", F.array().cast("array<bigint>").alias("homes"))
    return links.union(_compared(lists, sets)).distinct(), sets.rows.where(F.col("node").isNotNull()).select("doc_id", "node")
