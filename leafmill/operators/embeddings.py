"""Subword embeddings by skip-gram with negative sampling, trained in blocks.

The corpus is counted into cells first: how often two words stand within a window of each other, nearer ones counting more, common
words less, so what training reads grows with the different pairs and not with repeats. Words are dealt by hash into blocks. An
epoch has as many steps as there are blocks; in each, every task holds the input vectors of one block, the output vectors of
another, and the cells between them, so no two tasks of a step change the same vector, and after all steps each pair of blocks has
met once. A word's input vector is the mean of its pieces (the word and its hashed character n-grams); at the end of an epoch the
change of each word goes back to its pieces, which are dealt by blocks too. No task holds a whole vocabulary, and all that a step
changes is a table in the shared folder, so a lost executor repeats its blocks of one step.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.staging import dropped, spread, staged


@dataclass(frozen=True)
class Settings:
    """dim: components; epochs; window: words to each side; min_count: least number of a word; minn, maxn: characters of its n-grams
    (maxn 0: none); buckets: of n-grams' hashes; negatives: sampled words a pair; rate: of the first steps (Adagrad lowers it);
    common: share of all words from which a word counts less; held_out: of so many cells one is only used to measure the loss;
    block_words, block_cells: words a block and cells a pair of blocks, about."""

    dim: int = 100
    epochs: int = 5
    window: int = 5
    min_count: int = 2
    minn: int = 2
    maxn: int = 4
    buckets: int = 2_000_000
    negatives: int = 5
    rate: float = 0.1
    common: float = 1e-3
    held_out: int = 20
    block_words: int = 50_000
    block_cells: int = 4_000_000
    batch: int = 512
    seed: int = 1


def vocabulary(corpus: DataFrame, settings: Settings) -> DataFrame:
    """key, word, n of the words that occur min_count times; corpus: words (array<string>)."""
    counts = corpus.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= settings.min_count).select(F.xxhash64("word").alias("key"), "word", "n")


def cells(corpus: DataFrame, words: DataFrame, settings: Settings) -> DataFrame:
    """a < b or a = b, weight: how often two words of the vocabulary stand within the window, in expectation: a distance of k counts
    (window - k + 1) / window, and each word by the share of its occurrences that are kept. Rare words keep their places."""
    keys = staged(corpus.select(F.transform("words", lambda w: F.xxhash64(w)).alias("h")), "keys")
    w = settings.window

    def apart(k: int) -> Column:
        share, cut = F.lit((w - k + 1) / w), F.greatest(F.size("h") - k, F.lit(0))
        return F.zip_with(F.slice("h", 1, cut), F.slice("h", k + 1, cut), lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), share.alias("weight")))

    pairs = None
    for k in range(1, w + 1):  # one array at a time, so a long text is never a row of all its pairs
        rows = keys.select(F.explode(apart(k)).alias("p")).select("p.*")
        pairs = rows if pairs is None else pairs.unionByName(rows)
    counted = pairs.groupBy("a", "b").agg(F.sum(F.col("weight").cast("decimal(18,4)")).cast("double").alias("weight"))
    total = words.agg(F.sum("n").alias("total")).first()["total"] or 1
    share = F.col("n") / F.lit(total)
    kept = words.select("key", F.least(F.lit(1.0), F.sqrt(F.lit(settings.common) / share) + F.lit(settings.common) / share).alias("kept"))
    for side in "ab":
        counted = counted.join(kept.select(F.col("key").alias(side), F.col("kept").alias(f"_{side}")), side)
    return counted.select("a", "b", (F.col("weight") * F.col("_a") * F.col("_b")).alias("weight"))


def pieces(word: str, key: int, settings: Settings) -> list[int]:
    """The word's own key, and the buckets of its n-grams with marks at both ends."""
    if not settings.maxn:
        return [key]
    marked, found = f"<{word}>", {}
    for n in range(settings.minn, settings.maxn + 1):
        for i in range(len(marked) - n + 1):
            gram = marked[i : i + n]
            if gram != marked:
                found[int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "little") % settings.buckets] = None
    return [key, *found]


def first_vector(piece: int, settings: Settings) -> np.ndarray:
    """Where a piece starts: by its id and the seed, wherever it is made."""
    return np.random.Generator(np.random.Philox(key=[piece & (2**64 - 1), settings.seed])).uniform(-1, 1, settings.dim).astype(np.float32) / settings.dim


def rows_of(array) -> np.ndarray:
    """A list column without nulls as a matrix."""
    return array.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1) if len(array) else np.zeros((0, 1), dtype=np.float32)


def lists_of(matrix: np.ndarray):
    import pyarrow as pa

    ends = np.arange(len(matrix) + 1, dtype=np.int32) * (matrix.shape[1] if matrix.ndim == 2 else 0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(matrix, dtype=np.float32).ravel()))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def trained(v: np.ndarray, u: np.ndarray, acc_v: np.ndarray, acc_u: np.ndarray, left: np.ndarray, right: np.ndarray, weight: np.ndarray, chance: np.ndarray, settings: Settings, seed: int) -> None:
    """Changes input vectors v and output vectors u by the cells (left, right, weight), in batches, each row by Adagrad. chance: of each
    row of u to be sampled. Negative samples of a cell weigh as it does."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(left))
    edges = np.cumsum(chance)
    for at in range(0, len(order), settings.batch):
        some = order[at : at + settings.batch]
        w, c, x = left[some], right[some], weight[some].astype(np.float32)
        none = np.minimum(np.searchsorted(edges, rng.random((len(some), settings.negatives)) * edges[-1]), len(u) - 1)
        seen = np.concatenate([c[:, None], none], axis=1)
        vectors = u[seen]
        score = np.einsum("md,mkd->mk", v[w], vectors)
        # a sample that is the context itself says nothing
        error = -sigmoid(score) * x[:, None]
        error[:, 0] += x
        error[:, 1:][none == c[:, None]] = 0
        grad_v, grad_u = np.einsum("mk,mkd->md", error, vectors), error[:, :, None] * v[w][:, None]
        for rows, grads, out, acc in ((w, grad_v, v, acc_v), (seen.ravel(), grad_u.reshape(-1, v.shape[1]), u, acc_u)):
            own, back = np.unique(rows, return_inverse=True)
            total = np.zeros((len(own), v.shape[1]), dtype=np.float32)
            np.add.at(total, back, grads)
            acc[own] += (total * total).mean(1)
            out[own] += settings.rate * total / np.sqrt(acc[own] + 1e-8)[:, None]


def loss_of(v: np.ndarray, u: np.ndarray, left: np.ndarray, right: np.ndarray, weight: np.ndarray, chance: np.ndarray, settings: Settings, seed: int) -> float:
    """The weighted loss of cells, with the same samples whenever it is asked for."""
    rng, total = np.random.default_rng(seed), 0.0
    edges = np.cumsum(chance)
    for at in range(0, len(left), 4096):
        w, c, x = (y[at : at + 4096] for y in (left, right, weight))
        none = np.minimum(np.searchsorted(edges, rng.random((len(w), settings.negatives)) * edges[-1]), len(u) - 1)
        good, bad = (v[w] * u[c]).sum(1), np.einsum("md,mkd->mk", v[w], u[none])
        total += float((x * (np.logaddexp(0, -good) + np.where(none == c[:, None], 0, np.logaddexp(0, bad)).sum(1))).sum())
    return total


_STATE = "side string, block int, key long, word string, n double, vec array<float>, start array<float>, acc double"


def _ordered(table, columns: list[str]):
    """A group's rows in an order of their own, so that results do not depend on how they came."""
    return table.sort_by([(c, "ascending") for c in columns])


def _step(blocks: int, turn: int, settings: Settings, epoch: int):
    """The function of one task of a step: rows of one input block, one output block and the cells between them -> the vectors after
    them, and their loss on the cells held out before the step (side loss)."""

    def run(key, table):
        import pyarrow as pa
        import pyarrow.compute as pc

        side = lambda name: _ordered(table.filter(pc.equal(table["side"], name)), ["key", "other"])
        rows = {s: side(s) for s in ("v", "u", "cell")}
        v, start, u = rows_of(rows["v"]["vec"]).copy(), rows_of(rows["v"]["start"]), rows_of(rows["u"]["vec"]).copy()
        acc_v, acc_u = (rows[s]["acc"].to_numpy().copy() for s in "vu")
        cell = rows["cell"]
        ids_v, ids_u = rows["v"]["key"].to_numpy(), rows["u"]["key"].to_numpy()
        loss, weight = 0.0, 0.0
        if cell.num_rows:
            left, right = np.searchsorted(ids_v, cell["key"].to_numpy()), np.searchsorted(ids_u, cell["other"].to_numpy())
            n, chance = cell["n"].to_numpy(), rows["u"]["n"].to_numpy() ** 0.75
            out = cell["acc"].to_numpy() > 0
            seed = settings.seed * 1_000_003 + epoch * 10_007 + turn * 101 + key[0].as_py()
            loss, weight = loss_of(v, u, left[out], right[out], n[out], chance, settings, settings.seed + turn * 101 + key[0].as_py()), float(n[out].sum())
            trained(v, u, acc_v, acc_u, left[~out], right[~out], n[~out], chance, settings, seed)
        k = key[0].as_py()
        none = pa.array([[]], pa.list_(pa.float32()))
        parts = [
            pa.table({"side": pa.array(["v"] * len(v)), "block": pa.array([k] * len(v), pa.int32()), "key": rows["v"]["key"], "word": rows["v"]["word"], "n": rows["v"]["n"], "vec": lists_of(v), "start": lists_of(start), "acc": pa.array(acc_v)}),
            pa.table({"side": pa.array(["u"] * len(u)), "block": pa.array([(k + turn) % blocks] * len(u), pa.int32()), "key": rows["u"]["key"], "word": rows["u"]["word"], "n": rows["u"]["n"], "vec": lists_of(u), "start": lists_of(np.zeros((len(u), 0))), "acc": pa.array(acc_u)}),
            pa.table({"side": pa.array(["loss"]), "block": pa.array([k], pa.int32()), "key": pa.array([0], pa.int64()), "word": pa.array([None], pa.string()), "n": pa.array([weight]), "vec": none, "start": none, "acc": pa.array([loss])}),
        ]
        return pa.concat_tables([p.cast(parts[0].schema) for p in parts])

    return run


def _inputs(settings: Settings):
    """One block's words and the pieces that they have -> the words' input vectors."""

    def run(key, words, found):
        import pyarrow as pa

        words, found = _ordered(words, ["key"]), _ordered(found, ["piece"])
        ids, vectors = found["piece"].to_numpy(), rows_of(found["vec"])
        out = np.zeros((words.num_rows, settings.dim), dtype=np.float32)
        for i, (word, k) in enumerate(zip(words["word"].to_pylist(), words["key"].to_pylist())):
            out[i] = vectors[np.searchsorted(ids, pieces(word, k, settings))].mean(0)
        return pa.table({"key": words["key"], "block": words["block"], "vec": lists_of(out)})

    return run


def _changes(settings: Settings):
    """One block's words after an epoch -> for each of their pieces the sum of the words' changes, and how many they are."""

    def run(key, table):
        import pyarrow as pa

        table = _ordered(table, ["key"])
        change = rows_of(table["vec"]) - rows_of(table["start"])
        owners = [pieces(w, k, settings) for w, k in zip(table["word"].to_pylist(), table["key"].to_pylist())]
        ids, back = np.unique(np.array([p for own in owners for p in own], dtype=np.int64), return_inverse=True)
        total = np.zeros((len(ids), settings.dim), dtype=np.float32)
        np.add.at(total, back, change[np.repeat(np.arange(len(owners)), [len(o) for o in owners])])
        return pa.table({"piece": pa.array(ids), "block": pa.array([key[0].as_py()] * len(ids), pa.int32()), "vec": lists_of(total), "n": pa.array(np.bincount(back, minlength=len(ids)).astype(np.int64))})

    return run


def _moved(settings: Settings):
    """Pieces of one block of pieces and their changes from all blocks of words -> the pieces after them."""

    def run(key, now, changes):
        import pyarrow as pa

        now, changes = _ordered(now, ["piece"]), _ordered(changes, ["piece", "block"])
        ids, out = now["piece"].to_numpy(), rows_of(now["vec"]).copy()
        total, n = np.zeros_like(out), np.zeros(len(ids))
        at = np.searchsorted(ids, changes["piece"].to_numpy())
        if len(at):
            np.add.at(total, at, rows_of(changes["vec"]))
            np.add.at(n, at, changes["n"].to_numpy())
        return pa.table({"piece": now["piece"], "vec": lists_of(out + total / np.maximum(n, 1)[:, None])})

    return run


@dataclass
class Model:
    """words: key, word, n, vec (input vectors), piece vectors: piece, vec; losses: the held-out loss before each epoch and after the
    last, a pair; settings."""

    words: DataFrame
    piece_vectors: DataFrame
    losses: list[float]
    settings: Settings


def _by(column: str, blocks: int) -> Column:
    return F.pmod(F.col(column), F.lit(blocks)).cast("int")


def train(corpus: DataFrame, settings: Settings = Settings()) -> Model:  # noqa: B008
    """Trains on corpus (words: array<string>). Equal settings and texts give equal vectors, on whatever number of tasks the blocks run.
    An empty corpus gives an empty model."""
    spark = corpus.sparkSession
    counted = staged(vocabulary(corpus, settings), "vocabulary")
    found = staged(cells(corpus, counted, settings), "cells")
    size, held = counted.count(), found.count()
    blocks = max(1, ceil(size / settings.block_words), ceil(sqrt(2 * held / settings.block_cells)))
    words = staged(counted.withColumn("block", _by("key", blocks)), "words")
    # each pair trains both its words
    both = found.select("a", "b", "weight").union(found.where("a <> b").select("b", "a", "weight"))
    out = F.pmod(F.xxhash64("a", "b", F.lit(settings.seed)), F.lit(settings.held_out)) == 0
    both = staged(both.select("a", "b", "weight", out.cast("double").alias("out"), _by("a", blocks).alias("block"), F.pmod(_by("b", blocks) - _by("a", blocks), F.lit(blocks)).alias("turn")).repartition("block", "turn"), "sides")

    def links(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(p, b) for w, k, b in zip(batch.column("word").to_pylist(), batch.column("key").to_pylist(), batch.column("block").to_pylist()) for p in pieces(w, k, settings)]
            a, b = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32())], names=["piece", "block"])

    linked = staged(words.select("word", "key", "block").mapInArrow(links, "piece long, block int").distinct(), "links")

    def start(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("piece").to_pylist()
            vectors = np.array([first_vector(p, settings) for p in ids], dtype=np.float32).reshape(len(ids), settings.dim)
            yield pa.RecordBatch.from_arrays([batch.column("piece"), lists_of(vectors)], names=["piece", "vec"])

    parts = staged(linked.select("piece").distinct().mapInArrow(start, "piece long, vec array<float>"), "pieces")
    zero = F.array_repeat(F.lit(0.0).cast("float"), settings.dim)
    state_u = words.select(F.lit("u").alias("side"), "block", "key", "word", F.col("n").cast("double").alias("n"), zero.alias("vec"), F.array().cast("array<float>").alias("start"), F.lit(0.0).alias("acc"))
    acc_v = words.select("key", F.lit(0.0).alias("acc"))

    def inputs(parts):
        met = linked.join(parts, "piece")
        return words.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(_inputs(settings), "key long, block int, vec array<float>")

    losses: list[float] = []
    state: DataFrame | None = None
    for epoch in range(settings.epochs):
        fresh = inputs(parts).join(words.select("key", "word", "n"), "key").join(acc_v, "key")
        state_v = fresh.select(F.lit("v").alias("side"), "block", "key", "word", F.col("n").cast("double").alias("n"), "vec", F.col("vec").alias("start"), "acc")
        state = staged(state_v.unionByName(state_u), "state")
        loss, weight = 0.0, 0.0
        for turn in range(blocks):
            task = F.when(F.col("side") == "v", F.col("block")).otherwise(F.pmod(F.col("block") - turn, F.lit(blocks)))
            rows = state.where("side <> 'loss'").withColumns({"task": task, "other": F.lit(0).cast("long")})
            own = both.where(F.col("turn") == turn).select(F.lit("cell").alias("side"), "block", F.col("a").alias("key"), F.lit(None).cast("string").alias("word"), F.col("weight").alias("n"), F.array().cast("array<float>").alias("vec"), F.array().cast("array<float>").alias("start"), F.col("out").alias("acc"), F.col("block").alias("task"), F.col("b").alias("other"))
            after = staged(rows.unionByName(own).groupBy("task").applyInArrow(_step(blocks, turn, settings, epoch), _STATE), "state")
            dropped(state)
            state = after
            told = after.where("side = 'loss'").agg(F.sum("acc").alias("loss"), F.sum("n").alias("weight")).first()
            loss, weight = loss + (told["loss"] or 0.0), weight + (told["weight"] or 0.0)
        losses.append(loss / max(weight, 1e-12))
        changes = state.where("side = 'v'").groupBy("block").applyInArrow(_changes(settings), "piece long, block int, vec array<float>, n long")
        now = parts.withColumn("own", _by("piece", blocks))
        moved = staged(now.groupBy("own").cogroup(changes.withColumn("own", _by("piece", blocks)).groupBy("own")).applyInArrow(_moved(settings), "piece long, vec array<float>"), "pieces")
        dropped(parts)
        parts = moved
        state_u = staged(state.where("side = 'u'"), "outputs")
        acc_v = staged(state.where("side = 'v'").select("key", "acc"), "rates")
    return Model(staged(inputs(parts).join(words.select("key", "word", "n"), "key").select("key", "word", "n", "vec"), "vectors"), parts, losses, settings)


def tokenised(docs: DataFrame, text: str = "text", analyzer: Column | None = None) -> DataFrame:
    """words of each text, in lower case and as far as there are some."""
    return spread(docs.select((T.words(F.lower(F.coalesce(text, F.lit("")))) if analyzer is None else analyzer).alias("words"))).where("size(words) > 0")


def encoded(docs: DataFrame, id: str, model: Model, text: str = "text", pooling: str = "mean") -> DataFrame:
    """id, vec: the L2-normalised mean or maximum of the vectors of a text's words; texts without known words have no row. Repeated words
    weigh as often as they occur in a mean. Words are counted a text before they meet their vectors."""
    words = spread(docs.select(id, T.words(F.lower(F.coalesce(text, F.lit("")))).alias("_w"))).select(id, F.explode("_w").alias("word"))
    counts = words.groupBy(id, "word").agg(F.count("*").alias("n"))
    met = counts.join(model.words.select("word", "vec"), "word").select(id, F.col("n").cast("double").alias("n"), F.posexplode("vec").alias("pos", "x"))
    pool = {"mean": F.sum(F.col("x").cast("double") * F.col("n")) / F.sum("n"), "max": F.max(F.col("x").cast("double"))}[pooling]
    rows = met.groupBy(id, "pos").agg(pool.alias("x")).groupBy(id).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))
    return rows.select(id, F.transform(T.l2_normalised(F.col("v")), lambda x: x.cast("float")).alias("vec"))
