"""Registry of near-duplicate methods: each makes fingerprints, scores pairs or ranks candidates, all as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from typing import ClassVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators import dedup as D

_METHODS: dict[str, type[Method]] = {}


class Method:
    """options: a method's settings over its DEFAULTS. docs: doc_id and text, or vec_id and embedding for vectors."""

    DEFAULTS: ClassVar[dict] = {}
    pairs = queries = False

    def __init__(self, **options):
        unknown = set(options) - set(self.DEFAULTS)
        if unknown:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        self.options = self.DEFAULTS | options

    def fingerprints(self, docs: DataFrame) -> DataFrame:
        raise NotImplementedError

    def pair_scores(self, docs: DataFrame) -> DataFrame:
        """a < b, score of pairs with a score above 0."""
        raise NotImplementedError

    def ranking(self, docs: DataFrame, scope: DataFrame | None = None, k: int = 20) -> DataFrame:
        """src, rank, dst, score; with scope (id), only its members are candidates."""
        raise NotImplementedError


def method(name: str) -> Callable[[type[Method]], type[Method]]:
    def add(kind: type[Method]) -> type[Method]:
        if name in _METHODS:
            raise ValueError(f"{name} is registered twice")
        _METHODS[name] = kind
        return kind

    return add


def create(name: str, **options) -> Method:
    if name not in _METHODS:
        raise KeyError(f"no method {name}; there are {', '.join(available())}")
    return _METHODS[name](**options)


def available() -> list[str]:
    return sorted(_METHODS)


def _shingles(docs: DataFrame, size: int) -> DataFrame:
    return D.shingle_table(D.tokens(docs), size)


@method("minhash_bands")
class Bands(Method):
    DEFAULTS: ClassVar[dict] = {"shingle": 3, "bands": 20}
    pairs = True

    def fingerprints(self, docs):
        return D.lsh_bands(D.minhash_signature(_shingles(docs, self.options["shingle"])), self.options["bands"])

    def pair_scores(self, docs):
        return D.set_scores(self.fingerprints(docs)).select("a", "b", "score")


@method("minhash_jaccard")
class SignatureSets(Method):
    DEFAULTS: ClassVar[dict] = {"shingle": 1, "num_perm": 512, "max_chars": 15_000}
    pairs = True

    def fingerprints(self, docs):
        cut = docs.withColumn("text", F.substring("text", 1, self.options["max_chars"]))
        signature = D.minhash_signature(_shingles(cut, self.options["shingle"]), self.options["num_perm"])
        return signature.select("id", F.explode(F.array_distinct("signature")).alias("item"))

    def pair_scores(self, docs):
        return D.set_scores(self.fingerprints(docs)).select("a", "b", "score")


class _Buckets(Method):
    queries = True
    stored: DataFrame | None = None

    def preload(self, items: DataFrame) -> None:
        """Takes fingerprints (id, item) that are kept in a table; those of documents it does not hold are still made."""
        self.stored = items.select("id", "item").distinct()

    def fingerprints(self, docs):
        if self.stored is None:
            return self._made(docs)
        ids = docs.select(F.col("doc_id").alias("id")).distinct()
        missing = docs.join(self.stored.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_anti")
        return self.stored.join(ids, "id", "left_semi").unionByName(self._made(missing))

    def _made(self, docs):
        return D.bucket_minhash(_shingles(docs, self.options["shingle"])).select("id", F.concat_ws(":", "bucket", "hash").alias("item"))

    def ranking(self, docs, scope=None, k=20):
        items, least = self.fingerprints(docs), D.minimum_should_match(self.options["msm_pct"])
        kept = items if scope is None else items.join(scope.select("id"), "id", "left_semi")
        return D.overlap_topk(kept, least, k)


@method("minhash_query")
class Query(_Buckets):
    DEFAULTS: ClassVar[dict] = {"shingle": 5, "msm_pct": 0.10}


@method("minhash_sidecar")
class Sidecar(_Buckets):
    DEFAULTS: ClassVar[dict] = {"shingle": 3, "msm_pct": 0.055}
    pairs = True

    def pair_scores(self, docs):
        return D.overlap_pairs(self.fingerprints(docs)).select("a", "b", F.col("common").cast("double").alias("score"))


@method("chunked_minhash")
class Chunked(Method):
    DEFAULTS: ClassVar[dict] = {"chunks": 10, "shingle": 3, "threshold": 0.6}
    pairs = True

    def fingerprints(self, docs):
        return D.chunk_items(docs, self.options["chunks"], self.options["shingle"])

    def pair_scores(self, docs):
        return D.chunked_scores(self.fingerprints(docs), self.options["threshold"])


@method("embedding")
class Vectors(Method):
    DEFAULTS: ClassVar[dict] = {"vector": "embedding", "id": "vec_id"}
    pairs = queries = True

    def pair_scores(self, docs):
        return D.vector_pairs(docs, self.options["id"], self.options["vector"])

    def ranking(self, docs, scope=None, k=20):
        asked = docs if scope is None else docs.join(scope.select(F.col("id").alias(self.options["id"])), self.options["id"], "left_semi")
        return D.knn(docs if scope is None else asked, asked, k, self.options["id"], self.options["vector"])


@method("chunked_embedding")
class ChunkedVectors(Method):
    """docs: one row a document, with the vectors of its chunks as an array."""

    DEFAULTS: ClassVar[dict] = {"vectors": "embeddings", "id": "doc_id", "threshold": 0.75}
    pairs = True

    def fingerprints(self, docs):
        return docs.select(F.col(self.options["id"]).alias("id"), F.posexplode(self.options["vectors"]).alias("chunk", "embedding"))

    def pair_scores(self, docs):
        return D.chunked_vector_scores(self.fingerprints(docs), self.options["threshold"])


#: The configurations that an evaluation compares by default.
MATRIX = [("minhash_bands", {"shingle": 1}), ("minhash_bands", {"shingle": 3}), ("minhash_jaccard", {"shingle": 1}), ("minhash_jaccard", {"shingle": 3}), ("minhash_sidecar", {"msm_pct": 0.055}), ("chunked_minhash", {"chunks": 10}), ("chunked_minhash", {"chunks": 20})]


def closed_evaluation(found: Method, docs: DataFrame, field: str, ks: list[int]) -> dict:
    """method figures over a closed set of documents whose groups a field names."""
    from leafmill.operators import metrics as M

    members = M.groups(docs, "doc_id", field)
    positives = M.positive_pairs(members)
    if found.pairs:
        scores = found.pair_scores(docs)
        both = scores.select(F.col("a").alias("src"), F.col("b").alias("dst"), "score").union(scores.select("b", "a", "score"))
        ranking = D.top_k(both, "src", F.col("score"), "dst", max(ks))
    else:
        ranking = found.ranking(docs, docs.select(F.col("doc_id").alias("id")), max(ks))
        scores = ranking.select(F.col("src").alias("a"), F.col("dst").alias("b"), "score")
    sweep = M.threshold_sweep(M.pair_scores(scores, positives, 0.0 if found.pairs else -1.0)).cache()
    best = M.best_f1(sweep).collect()
    recall = {r["k"]: r["recall"] for r in M.recall_at_k(ranking, positives, docs.select(F.col("doc_id").alias("id")), ks).collect()}
    out = {"docs": docs.count(), "groups": members.select("group").distinct().count(), "pr_auc": M.pr_auc(sweep).first()[0], "recall_at": recall}
    sweep.unpersist()
    return out | ({k: best[0][k] for k in ("f1", "precision", "recall", "threshold")} if best else {"f1": 0.0, "precision": 0.0, "recall": 0.0, "threshold": None})


def open_evaluation(found: Method, docs: DataFrame, corpus: DataFrame, field: str, ks: list[int]) -> dict:
    """open_recall_at of a method that can rank: documents of the closed set docs are looked up among all of corpus, so other texts
    take up ranks. corpus: as docs, which it holds."""
    from leafmill.operators import metrics as M

    if not found.queries:
        raise ValueError("the method ranks no candidates")
    ids = docs.select(F.col("doc_id").alias("id"))
    positives = M.positive_pairs(M.groups(docs, "doc_id", field))
    ranking = found.ranking(corpus, None, max(ks)).join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    return {"corpus": corpus.count(), "open_recall_at": {r["k"]: r["recall"] for r in M.recall_at_k(ranking, positives, ids, ks).collect()}}
