"""A versioned store of keyed rows on Parquet: base files and deltas by bucket of the key, merged when read.

Rows are dealt into buckets by a hash of their key, and sorted by it in each file, with Bloom filters, so a lookup opens the buckets
and row groups of its keys only. A change writes a delta into the buckets of its rows, and nothing else; a version is a manifest
that names all files. Manifests are numbered and never overwritten, so of two writers that start from one version the second
finds its number taken: a change that depends on what it has read fails then, any other is put on top of what came between.
Compaction merges a bucket's deltas into its base. Versions before stay readable until they are cleared away.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import catalog as C
from leafmill.staging import small, staged

#: Columns of deltas besides the row's own: whether the row is deleted.
GONE = "_gone"
#: Bytes of a row group, about: what a lookup reads for one key.
GROUP_BYTES = 4 << 20
#: Keys that are looked up by their values; more are joined.
KEYS_AS_VALUES = 2_000
BROADCAST_KEYS = 500_000


class VersionConflict(C.ConflictError):
    """The version that a change was made for is not the last one."""


class Store:
    """Rows of one schema with a key, in a folder that driver and executors share. Null keys are not stored."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, spark: SparkSession, folder: str, schema: str, key: str = "id", buckets: int = 64) -> Store:
        """An empty store. schema: as DDL."""
        store = cls(spark, folder)
        if store.versions():
            raise C.ConflictError(f"{folder} is a store already")
        store._commit({"version": 0, "key": key, "buckets": buckets, "schema": schema, "base": {}, "deltas": {}})
        return store

    # manifests

    def versions(self) -> list[int]:
        at = self._path(f"{self.folder}/versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known or version is not None and version not in known:
            raise C.NotFoundError(f"{self.folder}: version {version}")
        at = f"{self.folder}/versions/{known[-1] if version is None else version:012d}.json"
        stream = self._fs.open(self._path(at))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> bool:
        """Writes a manifest under its number; False if that is taken. The file is written beside and then given its name, so no reader
        sees half of it."""
        name, beside = f"{self.folder}/versions/{manifest['version']:012d}.json", f"{self.folder}/versions/.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(beside))
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri() if "://" in self.folder else self._fs.getUri())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(beside), self._path(name), none)
            return True
        except Exception as fault:
            self._fs.delete(self._path(beside), False)
            if "FileAlreadyExists" not in str(fault):
                raise
            return False

    def _change(self, make: Callable[[dict], dict], expect: int | None) -> int:
        """Commits make(last manifest) as the next version. With expect, only on top of that version."""
        while True:
            last = self.manifest()
            if expect is not None and last["version"] != expect:
                raise VersionConflict(f"{self.folder} is at version {last['version']}, not {expect}")
            new = make(last) | {"version": last["version"] + 1}
            if self._commit(new):
                return new["version"]
            if expect is not None:
                raise VersionConflict(f"{self.folder} has a version {new['version']} already")

    # files

    def _bucket(self, manifest: dict, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(manifest["buckets"])).cast("int")

    def _columns(self, manifest: dict) -> list[str]:
        return self.spark.createDataFrame([], manifest["schema"]).columns

    def _write(self, manifest: dict, rows: DataFrame) -> dict[str, str]:
        """Writes rows by bucket, sorted by key, and returns each bucket's folder."""
        key, folder = manifest["key"], f"{self.folder}/data/{uuid.uuid4().hex}"
        dealt = rows.where(F.col(key).isNotNull()).withColumn("bucket", self._bucket(manifest, F.col(key))).repartition("bucket").sortWithinPartitions("bucket", key)
        dealt.write.partitionBy("bucket").option("parquet.block.size", GROUP_BYTES).option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(folder)
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(folder))]
        return {n.removeprefix("bucket="): f"{folder.removeprefix(self.folder)}/{n}" for n in names if n.startswith("bucket=")}

    def _read(self, manifest: dict, folders: list[str], delta: bool = False) -> DataFrame:
        schema = manifest["schema"] + (f", {GONE} boolean" if delta else "")
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(self.folder + f for f in folders))

    def _merged(self, manifest: dict, buckets: set[str] | None, narrow: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Rows of some buckets (all if None) after their deltas. narrow: what is asked of base and deltas before they are merged."""
        key, columns = manifest["key"], self._columns(manifest)
        asked = lambda b: buckets is None or b in buckets
        late: dict[int, list[str]] = {}
        touched = {b for b, d in manifest["deltas"].items() if d and asked(b)}
        for b in sorted(touched):
            for version, folder in manifest["deltas"][b]:
                late.setdefault(version, []).append(folder)
        plain = narrow(self._read(manifest, [f for b, f in sorted(manifest["base"].items()) if asked(b) and b not in touched]))
        if not touched:
            return plain.select(*columns)
        deltas = None
        for version, folders in sorted(late.items()):
            some = narrow(self._read(manifest, folders, delta=True)).withColumn("_version", F.lit(version))
            deltas = some if deltas is None else deltas.unionByName(some)
        base = narrow(self._read(manifest, [f for b, f in sorted(manifest["base"].items()) if b in touched]))
        both = base.withColumns({GONE: F.lit(False), "_version": F.lit(-1)}).unionByName(deltas)
        last = both.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*columns, GONE), "_version").alias("_row"))
        return plain.select(*columns).unionByName(last.where(~F.col(f"_row.{GONE}")).select(*(F.col(f"_row.{c}").alias(c) for c in columns)))

    # reading

    def read(self, version: int | None = None) -> DataFrame:
        """All rows. Buckets without deltas are scanned as they are; only the others are shuffled."""
        return self._merged(self.manifest(version), None, lambda df: df)

    def multi_get(self, keys: list | DataFrame, version: int | None = None) -> DataFrame:
        """The rows of some keys (a list, or a table with the key's column); missing ones have none. Only the keys' buckets are opened, and
        of them the row groups that may hold one of up to KEYS_AS_VALUES keys; of more, the range of their values is pushed down."""
        manifest = self.manifest(version)
        key = manifest["key"]
        kind = self.spark.createDataFrame([], manifest["schema"]).schema[key].dataType.simpleString()
        table = keys if isinstance(keys, DataFrame) else self.spark.createDataFrame([(k,) for k in keys], f"{key} {kind}")
        table = staged(table.select(F.col(key).cast(kind).alias(key)).where(F.col(key).isNotNull()).distinct(), "keys")
        met = table.groupBy(self._bucket(manifest, F.col(key)).alias("bucket")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        if not met:
            return self._read(manifest, [])
        if sum(r["n"] for r in met) <= KEYS_AS_VALUES:
            values = [r[0] for r in table.collect()]
            return self._merged(manifest, {str(r["bucket"]) for r in met}, lambda df: df.where(F.col(key).isin(values)))
        low, high = min(r["low"] for r in met), max(r["high"] for r in met)
        held = small(table, BROADCAST_KEYS)
        return self._merged(manifest, {str(r["bucket"]) for r in met}, lambda df: df.where(F.col(key).between(low, high)).join(held, key, "left_semi"))

    def get(self, key) -> dict | None:
        found = self.multi_get([key]).collect()
        return found[0].asDict(recursive=True) if found else None

    # changes; each returns the new version

    def replace(self, rows: DataFrame, expect: int | None = None) -> int:
        """All rows by others; of rows with one key the greatest stays."""
        manifest = self.manifest()
        base = self._write(manifest, self._one_each(manifest, rows))
        return self._change(lambda m: m | {"base": base, "deltas": {}}, expect)

    def upsert(self, rows: DataFrame, expect: int | None = None) -> int:
        """Whole rows, new or in place of those of their keys; missing columns become null."""
        manifest = self.manifest()
        columns = self._columns(manifest)
        full = rows.select(*(c if c in rows.columns else F.lit(None).alias(c) for c in columns))
        return self._add(manifest, self._one_each(manifest, full).withColumn(GONE, F.lit(False)), expect)

    def delete(self, keys: DataFrame, expect: int | None = None) -> int:
        manifest = self.manifest()
        key = manifest["key"]
        none = self.spark.createDataFrame([], manifest["schema"]).schema
        rows = keys.select(key).distinct().select(*(F.col(key) if f.name == key else F.lit(None).cast(f.dataType).alias(f.name) for f in none), F.lit(True).alias(GONE))
        return self._add(manifest, rows, expect)

    def patch(self, patches: DataFrame, fields: list[str]) -> int:
        """Each patch's fields that its array `given` names, nulls included, in the row of its key; unknown keys change nothing. Fails if
        another writer was faster, as it depends on the rows before."""
        manifest = self.manifest()
        held = staged(patches, "patches")
        key = manifest["key"]
        rows = self.multi_get(held.select(key), manifest["version"]).withColumnRenamed(key, "id")
        changed = C.patched(rows, held.withColumnRenamed(key, "id"), fields)
        return self.upsert(changed.withColumnRenamed("id", key), manifest["version"])

    def _one_each(self, manifest: dict, rows: DataFrame) -> DataFrame:
        columns = self._columns(manifest)
        kinds = self.spark.createDataFrame([], manifest["schema"]).schema
        cast = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds))
        return cast.groupBy(F.col(manifest["key"]).alias("_key")).agg(F.max(F.struct(*columns)).alias("_row")).select("_row.*")

    def _add(self, manifest: dict, rows: DataFrame, expect: int | None) -> int:
        written = self._write(manifest, rows)
        if not written and expect is None:
            return manifest["version"]

        def make(m: dict) -> dict:
            number = m["version"] + 1
            return m | {"deltas": m["deltas"] | {b: [*m["deltas"].get(b, []), [number, f]] for b, f in written.items()}}

        return self._change(make, expect)

    def compact(self, least: int = 1) -> int:
        """Merges the deltas of buckets that have `least` or more into their base. Deltas that come meanwhile stay on top."""
        manifest = self.manifest()
        due = {b for b, d in manifest["deltas"].items() if len(d) >= least}
        if not due:
            return manifest["version"]
        base = self._write(manifest, self._merged(manifest, due, lambda df: df))

        def make(m: dict) -> dict:
            for b in due:
                if m["deltas"].get(b, [])[: len(manifest["deltas"][b])] != manifest["deltas"][b] or m["base"].get(b) != manifest["base"].get(b):
                    raise VersionConflict(f"bucket {b} was compacted or replaced meanwhile")
            later = {b: m["deltas"][b][len(manifest["deltas"][b]) :] for b in due}
            kept = {b: f for b, f in m["base"].items() if b not in due}
            return m | {"base": kept | {b: f for b, f in base.items() if b in due}, "deltas": {b: d for b, d in (m["deltas"] | later).items() if d}}

        return self._change(make, None)

    def clear(self, keep: int = 1) -> int:
        """Deletes all but the last `keep` versions, and the files that none of those names; returns how many folders went. Not for
        stores that are being written to."""
        known = self.versions()
        kept = [self.manifest(v) for v in known[-keep:]]
        used = {f.split("/")[2] for m in kept for f in [*m["base"].values(), *(f for d in m["deltas"].values() for _, f in d)]}
        for v in known[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/versions/{v:012d}.json"), False)
        at = self._path(f"{self.folder}/data")
        gone = [f.getPath() for f in (self._fs.listStatus(at) if self._fs.exists(at) else []) if f.getPath().getName() not in used]
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)


# columns that are derived from texts

BACKFILL = "id {id}, text_hash string, model string, {vector}"


def backfill_store(spark: SparkSession, folder: str, id: str = "string", vector: str = "vec array<float>", buckets: int = 64) -> Store:
    """A store of what a model has made of texts: id, text_hash, model, and the vector (null where it makes none)."""
    return Store.create(spark, folder, BACKFILL.format(id=id, vector=vector), "id", buckets)


def text_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def pending(texts: DataFrame, store: Store, model: str) -> DataFrame:
    """id, text_hash of texts (id, text) of which the store has nothing, or something of another text or model."""
    done = store.read().where(F.col("model") == model).select("id", "text_hash")
    return texts.select("id", text_hash(F.col("text")).alias("text_hash")).join(done, ["id", "text_hash"], "left_anti")


def backfill(texts: DataFrame, store: Store, encode: Callable[[DataFrame], DataFrame], model: str, batches: int = 8, stop_after: int | None = None) -> list[int]:
    """Brings the store up to date with texts (id, text), one row an id, batch by batch, and returns how many rows each batch has written.
    encode: from id, text to id and the vector column; what it leaves out is kept as null, so that it is not asked again.

    A batch is a share of the ids, by hash, and one version of the store, so a stop between batches loses none and the next run
    repeats none; nothing is written where nothing is pending. stop_after: end after so many batches that wrote."""
    due = staged(pending(texts, store, model), "pending")
    share = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("batch")), F.lit(batches)).cast("int")
    counts = {r["share"]: r["n"] for r in due.groupBy(share.alias("share")).agg(F.count("*").alias("n")).collect()}
    written = []
    for batch in sorted(counts)[:stop_after]:
        own = due.where(share == batch)
        asked = texts.where(share == batch).join(own, "id", "left_semi")
        made = encode(asked.select("id", "text"))
        store.upsert(own.join(made, "id", "left").withColumn("model", F.lit(model)))
        written.append(counts[batch])
    return written


def with_backfilled(texts: DataFrame, store: Store, model: str) -> DataFrame:
    """texts with the store's columns of their id, where these were made of the text as it is; else null."""
    held = store.read().where(F.col("model") == model).drop("model")
    return texts.withColumn("text_hash", text_hash(F.col("text"))).join(held, ["id", "text_hash"], "left").drop("text_hash")
