"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown on the driver from a bounded sample of labelled rows, by histograms of binned features, and flattened into
three arrays; executors score all documents by stepping whole batches down all trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import map_columns, staged, trimmed

#: At most so many labelled rows are fitted, the first by the hash of their doc_id.
FIT_ROWS = 20_000
FEATURES = ("log_words", "log_chars", "chars_a_word", "distinct_words", "top_word", "distinct_pairs", "lines_a_word", "distinct_lines", "upper", "lower", "digit", "space", "stop", "comma", "quote", "exclaim", "symbol", "bar", "bracket", "beyond_ascii", "control", "upper_words", "one_char_words", "long_words", "symbol_ends", "entropy")
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\n\r\x0b\x0c", "stop": b".", "comma": b",;:", "quote": b"'\"`", "exclaim": b"!?", "symbol": b"#*$%&@^~+=_/\\", "bar": b"|", "bracket": b"()[]{}<>", "beyond_ascii": bytes(range(128, 256)), "control": bytes(range(9)) + bytes(range(14, 32)) + b"\x7f"}
_MATRIX = np.array([[float(b in set(chars)) for chars in _CLASSES.values()] for b in range(256)])


def document_statistics(text: str | None) -> list[float]:
    """FEATURES of a whole text; finite for empty ones, too."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, lines = raw.split(), raw.split(b"\n")
    n, nb = len(words), len(raw)
    hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) if nb else np.zeros(256, dtype=np.int64)
    shares = dict(zip(_CLASSES, (hist @ _MATRIX) / max(1, nb)))
    p = hist[hist > 0] / max(1, nb)
    distinct = set(words)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:])))
    filled = [x for x in lines if x and not x.isspace()]
    upper = sum(c for w, c in counts.items() if w.isupper())
    ends = sum(c for w, c in counts.items() if w[-1:] in b"#*$%&@|!~+=")
    own = {
        "log_words": np.log1p(n), "log_chars": np.log1p(nb), "chars_a_word": nb / max(1, n), "distinct_words": len(distinct) / max(1, n), "top_word": max(counts.values(), default=0) / max(1, n), "distinct_pairs": pairs / max(1, n - 1),
        "lines_a_word": len(filled) / max(1, n), "distinct_lines": len(set(filled)) / max(1, len(filled)), "upper_words": upper / max(1, n), "one_char_words": sum(c for w, c in counts.items() if len(w) == 1) / max(1, n),
        "long_words": sum(c for w, c in counts.items() if len(w) > 20) / max(1, n), "symbol_ends": ends / max(1, n), "entropy": float(-(p * np.log2(p)).sum()) if nb else 0.0,
    }
    own |= shares
    return [float(own[k]) for k in FEATURES]


@dataclass
class Forest:
    """Complete binary trees of one depth, flattened: node i of a tree has the children 2i + 1 and 2i + 2."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes
    leaf: np.ndarray  # trees x leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of x; all trees step down together."""
        trees, inner = self.feature.shape if self.feature.size else (0, 0)
        out = np.full(len(x), self.start)
        if trees and len(x):
            t, rows = np.arange(trees)[None, :], np.arange(len(x))[:, None]
            at = np.zeros((len(x), trees), dtype=np.int64)
            while at[0, 0] < inner:
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.cut[t, at])
            out = out + self.leaf[t, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 5.0, ridge: float = 1.0) -> Forest:
    """Newton boosting of logistic loss. Each level of a tree needs one histogram of gradients and curvatures by (node, bin)
    for each feature. With no rows, or one class, the forest is its start value: the smoothed share of label 1."""
    prior = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(prior / (1 - prior)))
    inner = 2**depth - 1
    if len(y) == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = [np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)]  # value <= edge[k] has bin <= k
    margin = np.full(len(y), start)
    features, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            width = 2**level
            first = width - 1
            best = np.zeros(width)
            total_g, total_h = np.bincount(node, g, width), np.bincount(node, h, width)
            for k, b in enumerate(binned):
                if not len(edges[k]):
                    continue
                left_g = np.bincount(node * bins + b, g, width * bins).reshape(width, bins).cumsum(1)[:, : len(edges[k])]
                left_h = np.bincount(node * bins + b, h, width * bins).reshape(width, bins).cumsum(1)[:, : len(edges[k])]
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - (total_g**2 / (total_h + ridge))[:, None]
                gain[(left_h < least / 4) | (right_h < least / 4)] = 0
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best + 1e-9
                best[better] = gain[np.arange(width), top][better]
                feature[first : first + width][better] = k
                cut[first : first + width][better] = edges[k][top[better]]
            node = 2 * node + (x[np.arange(len(y)), feature[first + node]] > cut[first + node])
        leaf = -rate * np.bincount(node, g, inner + 1) / (np.bincount(node, h, inner + 1) + ridge)
        margin = margin + leaf[node]
        features.append(feature), cuts.append(cut), leaves.append(leaf)
    return Forest(np.array(features), np.array(cuts), np.array(leaves), start)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the FEATURES of every row's whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_columns(docs.select("doc_id", "text"), lambda ids, texts: (ids, [document_statistics(t) for t in texts]), f"doc_id {kind}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Forest:
    """A forest from rows of labels whose crc32(doc_id as text) mod 4 is not 2; rows bounds the sample. Null labels are left
    out; a doc_id with several labels counts by their mean, 0.5 and more as 1. docs has doc_id and text, or x already."""
    use = labels.select("doc_id", F.col("quality").cast("double").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    use = use.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    order = F.md5(F.col("doc_id").cast("string"))
    use = F.broadcast(use.orderBy(order).limit(rows).withColumnRenamed("doc_id", "_d"))
    named = docs.join(use, F.col("doc_id") == F.col("_d"))
    if "x" not in docs.columns:
        named = map_columns(named.select("text", "y", "doc_id"), lambda texts, ys, ids: ([document_statistics(t) for t in texts], ys, ids), f"x array<double>, y double, doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    found = named.select("doc_id", "x", "y").orderBy(order, "x").limit(rows).collect()
    x = np.array([r["x"] for r in found], dtype=float).reshape(len(found), len(FEATURES))
    return fit_forest(x, np.array([r["y"] for r in found], dtype=float))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, that quality_classifier predicts 1 for; the documents are not shuffled."""
    forest, at = fit(docs.select("doc_id", "text"), labels, fit_rows), docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            step = max(1, batch.num_rows * (4 << 20) // max(1, batch.nbytes))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                x = np.array([document_statistics(t.as_py()) for t in part.column(at)], dtype=float).reshape(part.num_rows, len(FEATURES))
                yield part.filter(pa.array(forest.score(x) >= threshold))

    return docs.mapInArrow(trimmed(run), docs.schema)


def quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted (1 if score >= threshold).

    Scores use the whole text only, never doc_id, lang, source or labels. The fit reads at most fit_rows labelled rows, none
    of them held out (crc32(doc_id as text) mod 4 = 2); every document is scored. A null text scores as an empty one; a
    null doc_id is scored and not held out; without usable labels all scores are the smoothed prior of 0.5. Repeated
    rows get equal scores; other columns are not read; empty tables give empty results.
    """
    stats = staged(statistics(docs), "statistics")
    forest = fit(stats, labels, fit_rows)

    def run(ids, xs):
        s = forest.score(np.array(xs, dtype=float).reshape(len(xs), len(FEATURES)))
        return ids, s.tolist(), (s >= threshold).astype(int).tolist()

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = map_columns(stats, run, f"doc_id {kind}, score double, predicted int")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")
