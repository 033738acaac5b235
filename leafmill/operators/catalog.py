"""Catalog records: listing, reports, joins to authors, upserts that keep curation, releases, merges, deletes, propagation, audit.

State changes are functions from a snapshot and a table of commands to the next snapshot, or to (record, outcome) rows; a caller
writes the result. Nothing is collected; canonical() stores its steps in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.schemas import MOST_HALF
from leafmill.staging import dropped, staged


class NotFoundError(LookupError):
    """A record does not exist."""


class ConflictError(ValueError):
    """A record's state forbids a change."""


class ForbiddenError(PermissionError):
    """A record may not be changed this way."""


def where_all(rows: DataFrame, status: str | None = "active", status_column: str = "record_status", contains: dict[str, object] | None = None, **equal: object) -> DataFrame:
    """Rows whose columns equal the given values; None leaves a column out, and status is "active" unless one is given. contains:
    array columns that must hold a value."""
    for column, value in {status_column: status or "active", **equal}.items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    for column, value in (contains or {}).items():
        if value is not None:
            rows = rows.where(F.array_contains(column, value))
    return rows


def matching_status(c: Column) -> Column:
    """Missing and empty mean pending."""
    return F.when(c.isNull() | (c == ""), "pending").otherwise(c)


def page(rows: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    """A page of rows in order, with the number of all rows as total."""
    if offset < 0 or not 1 <= limit <= 200:
        raise ValueError("offset is 0 or more, limit 1 to 200")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def batch_report(volumes: DataFrame, batches: int = 5000, statuses: int = 32) -> DataFrame:
    """batch_id, status, n: volumes by batch and status; the first batches by name, up to 20,000, and each one's commonest statuses."""
    kept = volumes.where(F.col("batch_id").isNotNull() & (F.col("batch_id") != ""))
    counts = kept.groupBy("batch_id", matching_status(F.col("status_matching")).alias("status")).agg(F.count("*").alias("n"))
    names = counts.select("batch_id").distinct().orderBy("batch_id").limit(min(batches, 20_000))
    rank = F.row_number().over(Window.partitionBy("batch_id").orderBy(F.desc("n"), "status"))
    return counts.join(names, "batch_id", "left_semi").withColumn("_r", rank).where(F.col("_r") <= statuses).drop("_r")


def catalog_stats(catalog: DataFrame) -> DataFrame:
    """type, status, n, segments: rows by type and status, and their segments with a start; status null sums up a type."""
    with_start = F.size(F.filter("segments", lambda s: s["cstart"].isNotNull()))
    rows = catalog.select("type", F.coalesce("status", F.lit("none")).alias("status"), F.when(F.col("segments").isNotNull(), with_start).otherwise(0).alias("s"))
    return rows.groupingSets([["type", "status"], ["type"]], "type", "status").agg(F.count("*").alias("n"), F.sum("s").alias("segments"))


def best_versions(volumes: DataFrame) -> DataFrame:
    """One row for each (rep_id, vol_id): one with segments first, then the latest, then the least id."""
    has = F.coalesce(F.size("segments") > 0, F.lit(False))
    order = Window.partitionBy("rep_id", "vol_id").orderBy(has.desc(), F.desc_nulls_last("last_updated_at"), "id")
    return volumes.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def history(audit: DataFrame, size: int = 200, id: str = "id", at: str = "timestamp", tie: str = "action") -> DataFrame:
    """Each record's audit events, newest first, up to size, numbered from 1."""
    order = Window.partitionBy(id).orderBy(F.desc(at), tie)
    return audit.withColumn("n", F.row_number().over(order)).where(F.col("n") <= size)


def with_authors(works: DataFrame, persons: DataFrame, label: str = "pref_label_bo") -> DataFrame:
    """id, author_names: the names of a work's authors in their order; authors who are not persons are left out."""
    rows = works.select("id", F.posexplode_outer("authors").alias("_p", "_a")).join(persons.select(F.col("id").alias("_a"), F.col(label).alias("_n")), "_a", "left")
    found = F.collect_list(F.when(F.col("_n").isNotNull(), F.struct("_p", "_n")))
    return rows.groupBy("id").agg(F.transform(F.array_sort(found), lambda s: s["_n"]).alias("author_names"))


def next_number(records: DataFrame, prefix: str, start: int) -> DataFrame:
    """next: one more than the greatest number of a local record's id after prefix; start if there is none."""
    number = F.regexp_extract("id", rf"^{prefix}(\d+)$", 1).try_cast("long")
    return records.where("origin = 'local'").agg(F.greatest(F.coalesce(F.max(number) + 1, F.lit(start)), F.lit(start)).alias("next"))


def upserted(current: DataFrame, incoming: DataFrame, fields: list[str]) -> DataFrame:
    """current (id, fields, modified, edit_version, record_status, origin) after an import of incoming (id, fields).

    New ids are imported and active. Records that a curator has modified keep their fields. Otherwise incoming values win,
    but nulls never overwrite. outcome: created, updated, kept (curated), untouched (not in the import)."""
    new = incoming.select(F.col("id").alias("_id"), *(F.col(f).alias(f"_{f}") for f in fields), F.lit(True).alias("_in"))
    joined = current.withColumn("_had", F.lit(True)).join(new, F.col("id") == F.col("_id"), "full")
    curated = F.coalesce("modified", F.lit(False))
    merged = [F.when(curated, F.col(f)).otherwise(F.coalesce(f"_{f}", f)).alias(f) for f in fields]
    outcome = F.when(F.col("_had").isNull(), "created").when(F.col("_in").isNull(), "untouched").when(curated, "kept").otherwise("updated")
    return joined.select(F.coalesce("id", "_id").alias("id"), *merged, curated.alias("modified"), F.coalesce("edit_version", F.lit(1)).alias("edit_version"), F.coalesce("record_status", F.lit("active")).alias("record_status"), F.coalesce("origin", F.lit("imported")).alias("origin"), outcome.alias("outcome"))


def release_outcomes(parsed: DataFrame, current: DataFrame) -> DataFrame:
    """id, outcome of parsed (id, released, replacement): released records are upserted; of others, unknown ones are skipped, ones
    with a replacement become duplicates of it, and the rest are withdrawn."""
    known = current.select(F.col("id").alias("_k"))
    joined = parsed.join(known, F.col("id") == F.col("_k"), "left")
    outcome = F.when(F.col("released"), "upsert").when(F.col("_k").isNull(), "skip").when(F.col("replacement").isNotNull(), "duplicate").otherwise("withdraw")
    return joined.select("id", "replacement", outcome.alias("outcome"))


def merge_outcomes(commands: DataFrame, records: DataFrame) -> DataFrame:
    """id, canonical_id, outcome of commands (id, canonical_id): conflict for a merge into itself or of a duplicate, not_found for an
    unknown record or canonical one, conflict for another type, else merged."""
    own = records.select(F.col("id").alias("_o"), F.col("type").alias("_ot"), F.col("record_status").alias("_os"))
    other = records.select(F.col("id").alias("_c"), F.col("type").alias("_ct"))
    joined = commands.join(own, F.col("id") == F.col("_o"), "left").join(other, F.col("canonical_id") == F.col("_c"), "left")
    outcome = F.when(F.col("id") == F.col("canonical_id"), "conflict").when(F.col("_o").isNull() | F.col("_c").isNull(), "not_found").when(F.col("_os") == "duplicate", "conflict").when(F.col("_ot") != F.col("_ct"), "conflict").otherwise("merged")
    return joined.select("id", "canonical_id", outcome.alias("outcome"))


def delete_outcomes(ids: DataFrame, records: DataFrame, used: DataFrame, prefix: str) -> DataFrame:
    """id, outcome: only local records (by prefix) that nothing in used (id) refers to are deleted."""
    joined = ids.join(records.select(F.col("id").alias("_r")), F.col("id") == F.col("_r"), "left").join(used.select(F.col("id").alias("_u")).distinct(), F.col("id") == F.col("_u"), "left")
    outcome = F.when(F.col("_r").isNull(), "not_found").when(~F.col("id").startswith(prefix), "forbidden").when(F.col("_u").isNotNull(), "conflict").otherwise("deleted")
    return joined.select("id", outcome.alias("outcome"))


def canonical(records: DataFrame, steps: int = 16) -> DataFrame:
    """id, canonical: where the chain of canonical_id leads, by doubling; steps doublings reach 2**steps links. Ids in a cycle or
    beyond an unknown record stop where the walk does. Only records that lead elsewhere take part, and each doubling starts from the
    stored one before it."""
    hop = records.select("id", F.coalesce(F.when(F.col("record_status") == "duplicate", F.col("canonical_id")), F.col("id")).alias("to"))
    links = staged(hop.where(~F.col("to").eqNullSafe(F.col("id"))), "links")
    for _ in range(steps):
        up = links.select(F.col("id").alias("_i"), F.col("to").alias("_t"))
        step = staged(links.join(up, F.col("to") == F.col("_i"), "left").select("id", F.coalesce("_t", "to").alias("to"), (F.col("_t") != F.col("to")).alias("moved")), "links")
        done = step.where("moved").isEmpty()
        dropped(links)
        links = step
        if done:
            break
    return hop.where(F.col("to").eqNullSafe(F.col("id"))).unionByName(links.select("id", "to")).withColumnRenamed("to", "canonical")


def activated(segments: DataFrame, works: DataFrame, persons: DataFrame, keep_deleted: bool = False) -> DataFrame:
    """type, id: works that segments (wa_id) of reviewed volumes name, and their authors, that become active: all but duplicates and
    withdrawn ones; deleted ones too, unless they are to be kept so."""
    shut = ["duplicate", "withdrawn"] + (["deleted"] if keep_deleted else [])
    open_ = ~F.coalesce("record_status", F.lit("")).isin(shut) & (F.coalesce("record_status", F.lit("")) != "active")
    named = segments.where(F.col("wa_id").isNotNull()).select(F.col("wa_id").alias("id")).distinct()
    used = works.join(named, "id", "left_semi")
    live = used.where(~F.coalesce("record_status", F.lit("")).isin(shut))
    authors = live.select(F.explode("authors").alias("id")).distinct()
    return used.where(open_).select(F.lit("work").alias("type"), "id").unionByName(persons.join(authors, "id", "left_semi").where(open_).select(F.lit("person").alias("type"), "id"))


def batch_marks(rows: DataFrame, volumes: DataFrame, batch: str) -> DataFrame:
    """id, state of listed ids: missing, ok (in the batch already), conflict (in another) or update."""
    own = volumes.select(F.col("id").alias("_v"), F.col("batch_id").alias("_b"))
    state = F.when(F.col("_v").isNull(), "missing").when(F.col("_b") == batch, "ok").when(F.coalesce("_b", F.lit("")) != "", "conflict").otherwise("update")
    return rows.select("id").distinct().join(own, F.col("id") == F.col("_v"), "left").select("id", state.alias("state"))


def annotation_faults(volumes: DataFrame) -> DataFrame:
    """id, rule: what is wrong with a volume's annotation (id, mw_id, cend, base_length, segments)."""
    s = F.col("segments")
    n = F.coalesce(F.size(s), F.lit(0))
    ids = F.transform(s, lambda x: x["mw_id"])
    rules = {
        "no_segments": n < 1,
        "first_start": (n > 0) & (F.get(s, F.lit(0))["cstart"] != 0),
        "last_end": (n > 0) & (F.get(s, n - 1)["cend"] != F.col("cend")),
        "base_text": F.col("base_length") != F.col("cend"),
        "parent": F.exists(s, lambda x: ~x["mw_id"].startswith(F.col("mw_id"))),
        "mw_id": F.exists(s, lambda x: ~x["mw_id"].rlike(r"^MW[A-Z0-9_]+$")),
        "wa_id": F.exists(s, lambda x: (x["segment_type"] == "text") & (F.coalesce(x["wa_id"], F.lit("")) == "")),
        "unique": F.size(F.array_distinct(ids)) < F.size(ids),
    }
    faults = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items())), lambda x: x.isNotNull())
    return volumes.select("id", F.explode(faults).alias("rule"))


def capped_score(score: Column) -> Column:
    """Database scores fit half precision."""
    return F.least(score, F.lit(MOST_HALF)).cast("float")


def replaced(current: DataFrame, rows: DataFrame) -> DataFrame:
    """current with rows in place of those of the same id."""
    return current.join(rows.select("id"), "id", "left_anti").unionByName(rows, allowMissingColumns=True)


def patched(current: DataFrame, patches: DataFrame, fields: list[str]) -> DataFrame:
    """current with each patch's fields that its array `given` names; a given null overwrites."""
    new = patches.select(F.col("id").alias("_id"), F.col("given").alias("_given"), *(F.col(f).alias(f"_{f}") for f in fields))
    joined = current.join(new, F.col("id") == F.col("_id"), "left")
    return joined.select(*(F.when(F.coalesce(F.array_contains("_given", c), F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in current.columns))
