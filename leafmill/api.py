"""The service surface as functions: a catalog kept as versioned stores in one folder, with listing, lookup, changes, search and statistics.

Each change writes a delta of its table's store and appends an audit event. A change of a record is made for the version it has read,
so of two writers at a time one is told to read again. A catalog that is opened again has its tables.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill import schemas
from leafmill.operators import catalog as C
from leafmill.operators import matching as X
from leafmill.operators import search as S
from leafmill.sources.store import Store
from leafmill.sources.writers import append_audit
from leafmill.staging import staged

TABLES = {"works": schemas.WORKS, "persons": schemas.PERSONS, "volumes": schemas.VOLUMES}
PREFIX = {"works": ("WA1BC", 10, "work"), "persons": ("P1BC", 1, "person")}


class Catalog:
    """works, persons, volumes and audit under a folder; now gives the time of a change."""

    def __init__(self, spark: SparkSession, folder: str, now=lambda: datetime.now(UTC), buckets: int = 16):
        self.spark, self.folder, self.now, self.buckets = spark, folder.rstrip("/"), now, buckets

    def store(self, name: str, create: bool = False) -> Store | None:
        """A table's store; None as long as it has none, unless it is to be created."""
        found = Store(self.spark, f"{self.folder}/{name}")
        if found.versions():
            return found
        return Store.create(self.spark, f"{self.folder}/{name}", TABLES[name], "id", self.buckets) if create else None

    def table(self, name: str) -> DataFrame:
        store = self.store(name)
        return self.spark.createDataFrame([], TABLES[name]) if store is None else store.read()

    def save(self, name: str, rows: DataFrame) -> None:
        """Replaces a table."""
        self.store(name, create=True).replace(rows)

    def compact(self) -> None:
        """Merges the deltas of all tables, as should be done now and then."""
        for name in TABLES:
            store = self.store(name)
            if store:
                store.compact()

    def audit(self) -> DataFrame:
        return self.spark.read.schema(schemas.AUDIT).parquet(f"{self.folder}/audit")

    def _log(self, actor: str, kind: str, id: str, action: str, diff: str | None = None) -> None:
        row = self.spark.createDataFrame([(self.now(), actor, kind, id, action, None, diff)], schemas.AUDIT)
        append_audit(row, f"{self.folder}/audit")

    def history(self, id: str, size: int = 50) -> DataFrame:
        if not 1 <= size <= 200:
            raise ValueError("size is 1 to 200")
        return C.history(self.audit().where(F.col("id") == id), size)

    def list(self, name: str, offset: int = 0, limit: int = 50, status: str | None = None, author: str | None = None, label: str | None = None, origin: str | None = None, modified_by: str | None = None) -> DataFrame:
        rows = self._filtered(name, status, author, label, origin, modified_by)
        return C.page(rows, offset, limit, F.col("id"))

    def _filtered(self, name: str, status: str | None, author: str | None, label: str | None, origin: str | None, modified_by: str | None) -> DataFrame:
        rows = C.where_all(self.table(name), status, contains={"authors": author} if author else None, origin=origin)
        if modified_by:
            rows = rows.where(F.col("curation")["modified_by"] == modified_by)
        if label:
            posts = S.texts(rows, "id", ["pref_label_bo"])
            phrase = S.phrase_words(self.spark.createDataFrame([(0, 0, label)], "q int, slop int, phrase string"))
            rows = rows.join(S.phrase_hits(posts, phrase, ["q"]).select("id"), "id", "left_semi")
        return rows

    def get(self, name: str, id: str) -> dict:
        found = self.get_many(name, [id])
        if not found:
            raise C.NotFoundError(f"{name}: {id}")
        return found[id]

    def get_many(self, name: str, ids: list[str]) -> dict[str, dict]:
        """The records of some ids, read from their buckets; unknown ids have none."""
        store = self.store(name)
        return {r["id"]: r.asDict(recursive=True) for r in store.multi_get(ids).collect()} if store and ids else {}

    def create(self, name: str, data: dict, by: str) -> str:
        prefix, start, kind = PREFIX[name]
        at = self.store(name, create=True).manifest()["version"]
        id = f"{prefix}{C.next_number(self.store(name).read(at), prefix, start).first()[0]}"
        self._put(name, id, data | {"origin": "local", "record_status": "new"}, by, 1, at)
        self._log(by, kind, id, "create")
        return id

    def update(self, name: str, id: str, data: dict, by: str) -> None:
        """Sets the given fields, nulls included. Fails if another writer changed the table meanwhile."""
        at = self._version(name)
        old = self.get(name, id)
        version = ((old.get("curation") or {}).get("edit_version") or 0) + 1
        self._put(name, id, old | data, by, version, at)
        self._log(by, PREFIX[name][2], id, "edit")

    def _version(self, name: str) -> int | None:
        store = self.store(name)
        return store.manifest()["version"] if store else None

    def merge(self, name: str, id: str, into: str, by: str) -> None:
        if id == into:
            raise C.ConflictError("a record is not merged into itself")
        at = self._version(name)
        old, _ = self.get(name, id), self.get(name, into)
        if old["record_status"] == "duplicate":
            raise C.ConflictError(f"{id} is a duplicate already")
        version = ((old.get("curation") or {}).get("edit_version") or 0) + 1
        self._put(name, id, old | {"record_status": "duplicate", "canonical_id": into}, by, version, at)
        self._log(by, PREFIX[name][2], id, "merge", into)

    def delete(self, name: str, id: str, by: str) -> None:
        """Marks a local record that nothing refers to as deleted."""
        at = self._version(name)
        old = self.get(name, id)
        if not id.startswith(PREFIX[name][0]):
            raise C.ForbiddenError(f"{id} is not a local record")
        used = self.table("volumes").where(F.exists("segments", lambda s: s["wa_id"] == id)) if name == "works" else self.table("works").where(F.array_contains("authors", id))
        if not used.isEmpty():
            raise C.ConflictError(f"{id} is referred to")
        version = ((old.get("curation") or {}).get("edit_version") or 0) + 1
        self._put(name, id, old | {"record_status": "deleted"}, by, version, at)
        self._log(by, PREFIX[name][2], id, "delete")

    def _put(self, name: str, id: str, data: dict, by: str, version: int, expect: int | None = None) -> None:
        curation = {"modified": True, "modified_at": self.now(), "modified_by": by, "edit_version": version}
        row = self.spark.createDataFrame([data | {"id": id, "curation": curation}], TABLES[name])
        self.store(name, create=True).upsert(row, expect)

    def search_works(self, title: str | None = None, author_name: str | None = None, size: int = 20, **filters: str | None) -> DataFrame:
        """Works whose labels match title and author_name, as one text, best; with filters (status, author, label, origin, modified_by) among
        those only. One of all has to be given (ValueError)."""
        return self._asked("works", [title, author_name], size, filters)

    def search_persons(self, author_name: str | None = None, size: int = 20, **filters: str | None) -> DataFrame:
        """Persons whose labels match a name best; see search_works."""
        return self._asked("persons", [author_name], size, filters)

    def _asked(self, name: str, texts: list[str | None], size: int, filters: dict[str, str | None]) -> DataFrame:
        unknown = set(filters) - {"status", "author", "label", "origin", "modified_by"}
        if unknown:
            raise TypeError(f"no filter {', '.join(sorted(unknown))}")
        if not any([*texts, *filters.values()]):
            raise ValueError("give a text or a filter")
        rows = self._filtered(name, *(filters.get(k) for k in ("status", "author", "label", "origin", "modified_by")))
        return self._best(rows, " ".join(t for t in texts if t), size)

    def search(self, name: str, text: str, size: int = 20, status: str | None = None) -> DataFrame:
        """Records whose labels match a text best; all of them, in order of id, for an empty one."""
        return self._best(C.where_all(self.table(name), status), text, size)

    def _best(self, rows: DataFrame, text: str, size: int) -> DataFrame:
        tokens = text.split()
        clauses = [c for c in S.plan(text, tokens, " ") if c.scope == "top"]
        if not clauses:
            return rows.orderBy("id").limit(size)
        posts = S.texts(rows, "id", ["pref_label_bo", "alt_label_bo"])
        return S.search(self.spark, {"top": posts}, clauses, S.TOP_FIELDS, size).join(rows, "id")

    def find_work(self, text: str | None = None, volume_id: str | None = None, cstart: int | None = None, cend: int | None = None, size: int = 20) -> DataFrame:
        """Works that a text, or a span of a volume, is of: rank, wa_id, score, volumes, title, author_names. A span's own volume is left
        out. One of both is asked for: a text that is not blank, or a volume with its span."""
        span = (volume_id, cstart, cend)
        if (text is None) == any(v is None for v in span) or (text is not None and any(v is not None for v in span)):
            raise ValueError("give a text, or volume_id, cstart and cend")
        if text is not None and not text.strip():
            raise ValueError("the text is blank")
        volumes = self.table("volumes")
        if text is None:
            if cstart < 0 or cend <= cstart:
                raise ValueError(f"no span: {cstart} to {cend}")
            refs = self.spark.createDataFrame([("q", *span)], "query string, volume_id string, cstart int, cend int")
            fault = X.reference_texts(refs, volumes).first()["fault"]
            if fault:
                raise C.NotFoundError(f"volumes: {volume_id}: {fault}")
            found = X.find_by_reference(refs, volumes, size)
        else:
            asked = self.spark.createDataFrame([("q", text)], "query string, text string")
            chunks, titles = X.volume_postings(volumes)
            found = X.candidates(X.volume_scores(asked, "query", "text", chunks, titles), X.works_of(volumes), size)
        return X.resolved(found, self.table("works"), self.table("persons")).drop("query").orderBy("rank")

    def sync(self, name: str, parsed: DataFrame) -> DataFrame:
        """Brings released records (id, released, replacement, pref_label_bo) into a table and returns id, outcome: new and changed ones are
        upserted, and curated ones keep their labels; unreleased ones become duplicates or withdrawn, unknown ones are skipped."""
        rows = self.table(name)
        told = C.release_outcomes(parsed, rows).select("id", "outcome")
        new = parsed.join(told.where("outcome = 'upsert'").select("id"), "id").select("id", F.col("pref_label_bo").alias("_label"))
        ended = told.where("outcome IN ('duplicate', 'withdraw')").join(parsed.select("id", "replacement"), "id")
        kept = rows.join(new, "id", "full").join(ended.select("id", F.col("outcome").alias("_end"), "replacement"), "id", "left")
        curated = F.coalesce(F.col("curation")["modified"], F.lit(False))
        label = F.when(F.col("_label").isNotNull() & ~curated, F.col("_label")).otherwise(F.col("pref_label_bo"))
        status = F.when(F.col("_end") == "withdraw", "withdrawn").when(F.col("_end") == "duplicate", "duplicate").otherwise(F.coalesce("record_status", F.lit("active")))
        target = F.when(F.col("_end") == "duplicate", F.col("replacement")).otherwise(F.col("canonical_id"))
        self.save(name, kept.withColumns({"pref_label_bo": label, "record_status": status, "canonical_id": target, "origin": F.coalesce("origin", F.lit("imported"))}))
        return told

    def volume(self, rep: str, vol: str) -> dict:
        found = C.best_versions(self.table("volumes").where((F.col("rep_id") == rep) & (F.col("vol_id") == vol))).collect()
        if not found:
            raise C.NotFoundError(f"volumes: {rep} {vol}")
        return found[0].asDict(recursive=True)

    def set_volume_status(self, id: str, status: str) -> None:
        """Sets a status; reviewed volumes make their works and authors active."""
        if status not in schemas.VOLUME_STATUS:
            raise ValueError(f"no status {status}")
        at = self._version("volumes")
        self._put_volume(self.get("volumes", id) | {"status": status}, at)
        if status == "reviewed":
            self.propagate(id)

    def _put_volume(self, data: dict, expect: int | None) -> None:
        row = self.spark.createDataFrame([data], TABLES["volumes"])
        self.store("volumes").upsert(row, expect)

    def save_annotated_volume(self, id: str, base_text: str, segments: list[dict], status: str) -> None:
        """Saves a curator's segments and status of a volume. Refused (ValueError) are an unknown volume, segments of another parent than the
        volume's mw_id, a base_text that is not the volume's chunks one after another, and segments that do not begin at 0 or do
        not end where the volume does. title_bo and author_name_bo may be a string or a list; part_type is the segment's type.
        A reviewed volume makes its works and authors active."""
        if status not in schemas.VOLUME_STATUS:
            raise ValueError(f"no status {status}")
        at = self._version("volumes")
        old = self.get_many("volumes", [id]).get(id)
        if old is None:
            raise ValueError(f"no volume {id}")
        parent = old.get("mw_id")
        strangers = [s["mw_id"] for s in segments if parent and not (s.get("mw_id") or "").startswith(f"{parent}_")]
        if strangers:
            raise ValueError(f"segments of another work than {parent}: {', '.join(map(str, strangers))}")
        chunks = old.get("chunks") or []
        whole = "".join(c.get("text_bo") or "" for c in chunks)
        if chunks and base_text != whole:
            raise ValueError(f"base_text has {len(base_text)} characters and is not the volume's text of {len(whole)}")
        ordered = sorted(segments, key=lambda s: s["cstart"])
        if ordered and ordered[0]["cstart"] != 0:
            raise ValueError(f"the first segment starts at {ordered[0]['cstart']}")
        if ordered and old.get("cend") is not None and ordered[-1]["cend"] != old["cend"]:
            raise ValueError(f"the last segment ends at {ordered[-1]['cend']}, the volume at {old['cend']}")
        listed = lambda v: v if v is None or isinstance(v, list) else [v]
        names = ("title_bo", "author_name_bo", "title_orig_bo", "author_name_orig_bo")
        kept = [{k: s.get(k) for k in ("mw_id", "wa_id", "cstart", "cend")} | {"segment_type": s.get("part_type")} | {k: listed(s.get(k) or None) for k in names} for s in segments]
        self._put_volume(old | {"segments": kept, "status": status, "last_updated_at": self.now()}, at)
        if status == "reviewed":
            self.propagate(id)

    def import_ocr(self, volumes: DataFrame) -> DataFrame:
        """Brings assembled OCR volumes in (the columns of a volume but its curation) and returns id, outcome (created, updated). Volumes that
        are there already keep status, status_matching, segments, batch and the time of their first import."""
        kept = ("status", "status_matching", "segments", "batch_id", "first_imported_at")
        columns = [f.name for f in self.spark.createDataFrame([], TABLES["volumes"]).schema]
        new = staged(volumes.select(*(c if c in volumes.columns else F.lit(None).alias(c) for c in columns)), "import")
        store = self.store("volumes", create=True)
        at = store.manifest()["version"]
        old = store.multi_get(new.select("id"), at).select(F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in kept))
        both = new.join(old, F.col("id") == F.col("_id"), "left")
        known, now = F.col("_id").isNotNull(), F.lit(self.now())
        first = {"status": F.coalesce("status", F.lit("active")), "first_imported_at": F.coalesce("first_imported_at", now)}
        values = {c: F.when(known, F.col(f"_{c}")).otherwise(first.get(c, F.col(c))) for c in kept} | {"last_updated_at": now}
        rows = staged(both.select(*(values[c].alias(c) if c in values else F.col(c) for c in columns), F.when(known, "updated").otherwise("created").alias("outcome")), "imported")
        store.upsert(rows.drop("outcome"), at)
        return rows.select("id", "outcome")

    def propagate(self, id: str) -> None:
        segments = self.store("volumes").multi_get([id]).select(F.inline("segments"))
        live = staged(C.activated(segments, self.table("works"), self.table("persons")), "live")
        for name, kind in (("works", "work"), ("persons", "person")):
            ids = live.where(F.col("type") == kind).select("id")
            if not ids.isEmpty():
                store = self.store(name)
                at = store.manifest()["version"]
                store.upsert(store.multi_get(ids, at).withColumn("record_status", F.lit("active")), at)

    def stats(self) -> DataFrame:
        volumes = self.table("volumes").select("type", "status", "segments")
        others = [self.table(n).select(F.lit(k).alias("type"), F.col("record_status").alias("status"), F.lit(None).cast(volumes.schema["segments"].dataType).alias("segments")) for n, k in (("works", "work"), ("persons", "person"))]
        return C.catalog_stats(volumes.unionByName(others[0]).unionByName(others[1]))

    def batch_report(self, batches: int = 5000) -> DataFrame:
        return C.batch_report(self.table("volumes"), batches)
