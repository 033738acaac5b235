"""Writers: snapshots with replaced, patched or upserted rows, audit log, CSV, JSON results, Markdown report, tokenised corpus."""

from __future__ import annotations

import hashlib
import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as T

log = logging.getLogger(__name__)

# The columns of the duplicates list.
DUPLICATE_COLUMNS = ("volume_id", "segment_id", "source_wa", "title", "match_wa", "match_volume", "score", "classification", "text_length")


def snapshot(rows: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Writes a snapshot; readers of the one before are not disturbed if path is a folder of its own."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def append_audit(events: DataFrame, path: str) -> bool:
    """Appends events; a failure is logged and does not stop the caller."""
    try:
        events.write.mode("append").parquet(path)
        return True
    except Exception:
        log.exception("audit events were not written to %s", path)
        return False


def csv(rows: DataFrame, path: str, columns: tuple[str, ...] = DUPLICATE_COLUMNS) -> None:
    rows.select(*columns).write.mode("overwrite").csv(path, header=True)


def matched_split(rows: DataFrame, value: str, matched: str, unmatched: str) -> None:
    """Rows with a value to one CSV, the others to another."""
    rows.where(F.col(value).isNotNull()).write.mode("overwrite").csv(matched, header=True)
    rows.where(F.col(value).isNull()).drop(value).write.mode("overwrite").csv(unmatched, header=True)


def parsed_option(text: str) -> bool | int | float | str:
    """true, false, whole and decimal numbers as such, else the text."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def options(values: list[str]) -> dict:
    """Options from name=value texts."""
    out = {}
    for value in values:
        name, equals, text = value.partition("=")
        if not equals:
            raise ValueError(f"not name=value: {value}")
        out[name] = parsed_option(text)
    return out


def options_hash(values: dict) -> str:
    return hashlib.sha1(json.dumps(values, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:10]


def result_name(method: str, field: str, values: dict) -> str:
    return f"{method}_{field}_{options_hash(values)}.json"


def save_result(spark: SparkSession, folder: str, method: str, field: str, values: dict, result: dict) -> str:
    """Writes the figures of one evaluation under a name that its options give, in place of those before; returns the path."""
    path = f"{folder.rstrip('/')}/{result_name(method, field, values)}"
    text = json.dumps({"method": method, "field": field, "options": values} | result, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def saved_results(spark: SparkSession, folder: str) -> list[dict]:
    """The saved figures of all evaluations in a folder; ranks are numbers again."""
    out = []
    for row in spark.read.text(f"{folder.rstrip('/')}/*.json").collect():
        found = json.loads(row["value"])
        ranks = {k: {int(n): v for n, v in found[k].items()} for k in ("recall_at", "open_recall_at") if k in found}
        out.append(found | ranks)
    return out


def report(results: list[dict]) -> str:
    """A Markdown table of results, by most documents, then best F1, then method; what was not measured shows as "-"."""
    columns = ("method", "docs", "groups", "f1", "precision", "recall", "pr_auc", "threshold", "R@20", "open R@50")
    ranks = lambda r: {"R@20": r.get("recall_at", {}).get(20), "open R@50": r.get("open_recall_at", {}).get(50)}
    show = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    rows = sorted(results, key=lambda r: (-r.get("docs", 0), -(r.get("f1") or 0.0), r.get("method", "")))
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(show((r | ranks(r)).get(c)) for c in columns) + " |" for r in rows]) + "\n"


def tokenised(docs: DataFrame, text: str, path: str) -> None:
    """One document a line, its tokens joined by spaces; the first of several text columns that is not empty may be given as text."""
    rows = docs.select(F.array_join(T.words(F.col(text)), " ").alias("value")).where("value <> ''")
    rows.write.mode("overwrite").text(path)


def first_text(*columns: str):
    return F.coalesce(*(F.when(F.trim(c) != "", F.col(c)) for c in columns))
