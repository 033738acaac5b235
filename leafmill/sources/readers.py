"""Readers: OCR Parquet, image lists, batch and outline CSVs, ground truth, N-Quads and Trig, TEI discovery, snapshots, relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators.ingest import ocr_text


def ocr_pages(spark: SparkSession, path: str) -> DataFrame:
    """name, text and other columns of OCR Parquet; its columns are pruned at the scan."""
    return ocr_text(spark.read.parquet(path)).withColumnRenamed("img_file_name", "name")


def bytes_at(spark: SparkSession, path: str) -> DataFrame:
    """path, content of one object, or of those a pattern names; none if there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.format("binaryFile").load(path).select("path", "content")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], "path string, content binary")


def image_list(spark: SparkSession, path: str) -> DataFrame:
    """file, name, pnum from (gzipped) JSON arrays of images: JSON files and images without a size do not count, and pages are
    numbered by what is left, in order."""
    schema = "filename string, width int, height int"
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.from_json("value", f"array<struct<{', '.join(x.replace(' ', ':') for x in schema.split(', '))}>>")).alias("_p", "_i"))
    kept = rows.where(~F.col("_i")["filename"].endswith(".json") & F.col("_i")["width"].isNotNull() & F.col("_i")["height"].isNotNull())
    order = Window.partitionBy("file").orderBy("_p")
    return kept.select("file", F.col("_i")["filename"].alias("name"), F.row_number().over(order).alias("pnum"))


def batch_list(spark: SparkSession, path: str) -> DataFrame:
    """w_id, i_id, i_version, etext_source of a CSV without header; trimmed, rows without a w_id left out."""
    rows = spark.read.csv(path, schema="w_id string, i_id string, i_version string, etext_source string")
    trimmed = rows.select(*(F.trim(c).alias(c) for c in rows.columns))
    return trimmed.where(F.coalesce("w_id", F.lit("")) != "")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, line of text files, in each file's order."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))


def _fields(rows: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """The named columns of CSV lines, by a file's header."""
    first = rows.where("pos = 0").select(F.col("file").alias("_f"), F.from_csv("line", ", ".join(f"c{k} string" for k in range(32))).alias("_h"))
    body = rows.where("pos > 0 AND trim(line) <> ''").select(*keys, F.from_csv("line", ", ".join(f"c{k} string" for k in range(32))).alias("_v"))
    joined = body.join(first, F.col("file") == F.col("_f"))
    cells = F.arrays_zip(F.array(*(F.trim(F.col("_h")[f"c{k}"]) for k in range(32))).alias("k"), F.array(*(F.trim(F.col("_v")[f"c{k}"]) for k in range(32))).alias("v"))
    at = lambda name: F.get(F.filter(cells, lambda c: c["k"] == name), F.lit(0))["v"]
    return joined.select(*keys, *(F.nullif(at(n), F.lit("")).alias(n) for n in names))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """mw_id, d_id, rkts_id, nlm_id of a CSV with header: stripped, empty means null, rows without mw_id or d_id go, and of one mw_id the
    last row counts."""
    names = ["mw_id", "d_id", "rkts_id", "nlm_id"]
    rows = _fields(numbered_lines(spark, path), names, ["file", "pos"]).where(F.col("mw_id").isNotNull() & F.col("d_id").isNotNull())
    last = Window.partitionBy("mw_id").orderBy(F.desc("file"), F.desc("pos"))
    return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").select(*names)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """id: the lines of a file without comments (#) and blank ones."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> '' AND NOT startswith(id, '#')").distinct()


def scoped(rows: DataFrame, allow: DataFrame | None = None, deny: DataFrame | None = None, subset: DataFrame | None = None, id: str = "mw_id") -> DataFrame:
    """rows whose id is in allow and subset, where given, and not in deny."""
    for ids, how in ((allow, "left_semi"), (subset, "left_semi"), (deny, "left_anti")):
        if ids is not None:
            rows = rows.join(ids.select(F.col("id").alias(id)), id, how)
    return rows


def outline_rows(spark: SparkSession, path: str) -> DataFrame:
    """file, line, type, label, volume, start, end of outline CSVs; the volume is that of the last V row with a number."""
    names = ["part type", "label", "img grp start", "etext start", "etext end"]
    rows = _fields_quoted(numbered_lines(spark, path), names)
    number = F.col("img grp start").try_cast("int")
    from leafmill.operators.ingest import inherited_volumes

    named = rows.select("file", F.col("pos").alias("line"), F.col("part type").alias("type"), "label", number.alias("volume"), T.coordinate(F.col("etext start")).alias("start"), T.coordinate(F.col("etext end")).alias("end"))
    return inherited_volumes(named)


def _fields_quoted(rows: DataFrame, names: list[str]) -> DataFrame:
    renamed = {n: n.replace(" ", "_") for n in names}
    header = rows.withColumn("line", F.when(F.col("pos") == 0, F.regexp_replace("line", " ", "_")).otherwise(F.col("line")))
    out = _fields(header, list(renamed.values()), ["file", "pos"])
    return out.withColumnsRenamed({v: k for k, v in renamed.items()})


def mapping_list(spark: SparkSession, path: str) -> DataFrame:
    """mw, w, i of a (gzipped) CSV; the header, short rows and rows with a blank go."""
    rows = spark.read.csv(path, schema="mw string, w string, i string")
    rows = rows.select(*(F.trim(c).alias(c) for c in rows.columns))
    return rows.where(" AND ".join(f"coalesce({c}, '') <> ''" for c in rows.columns)).where("lower(mw) <> 'mw'")


QUAD = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*(<[^>]*>)?\s*\.\s*$'


def nquads(spark: SparkSession, path: str) -> DataFrame:
    """g, s, p, o, lang of N-Quads or N-Triples: IRIs without brackets, literals without quotes."""
    rows = spark.read.text(path).where(F.col("value").rlike(QUAD))
    part = lambda k: F.regexp_extract("value", QUAD, k)
    bare = lambda c: F.regexp_replace(c, r"^<|>$", "")
    literal = part(3).startswith('"')
    text = F.regexp_replace(F.regexp_extract(part(3), r'^"((?:[^"\\]|\\.)*)"', 1), r'\\(["\\])', "$1")
    lang = F.nullif(F.regexp_extract(part(3), r"@([A-Za-z0-9-]+)$", 1), F.lit(""))
    return rows.select(bare(part(4)).alias("g"), bare(part(1)).alias("s"), bare(part(2)).alias("p"), F.when(literal, text).otherwise(bare(part(3))).alias("o"), F.when(literal, lang).alias("lang"))


def trig_quads(text: str) -> list[tuple[str, str, str, str, str | None]]:
    """(g, s, p, o, lang) of the part of Trig that catalog files use: prefixes, one level of graph blocks, ; and , lists, literals."""
    import re

    token = re.compile(r'\s+|#[^\n]*|(?P<lit>"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*")(?P<tag>@[A-Za-z][A-Za-z0-9-]*|\^\^(?:<[^>]*>|[\w-]*:[\w.-]*))?|(?P<iri><[^>]*>)|(?P<mark>[{}.;,])|(?P<word>@?[^\s{};,"<>]+?(?=[\s{};,]|\.(?:\s|$)|$))')
    prefixes: dict[str, str] = {}
    out: list[tuple[str, str, str, str, str | None]] = []
    items = [m for m in token.finditer(text) if m.lastgroup]

    def value(m) -> tuple[str, str | None]:
        if m["lit"] is not None:
            raw = m["lit"][3:-3] if m["lit"].startswith('"""') else m["lit"][1:-1]
            tag = m["tag"] or ""
            return re.sub(r'\\(.)', lambda x: {"n": "\n", "t": "\t", "r": "\r"}.get(x[1], x[1]), raw), tag[1:] if tag.startswith("@") else None
        if m["iri"] is not None:
            return m["iri"][1:-1], None
        word = m["word"]
        if word == "a":
            return "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", None
        head, colon, tail = word.partition(":")
        return (prefixes.get(head, head + ":") + tail if colon else word), None

    graph, triple, k = "", [], 0
    while k < len(items):
        m = items[k]
        if m["word"] and m["word"].lower() in ("@prefix", "prefix"):
            prefixes[items[k + 1]["word"].rstrip(":")] = items[k + 2]["iri"][1:-1]
            k += 4 if k + 3 < len(items) and items[k + 3]["mark"] == "." else 3
            continue
        if m["mark"] == "{":
            graph, triple = triple[0][0] if triple else "", []
        elif m["mark"] in (".", "}"):
            triple = []
            graph = "" if m["mark"] == "}" else graph
        elif m["mark"] == ";":
            triple = triple[:1]
        elif m["mark"] == ",":
            triple = triple[:2]
        elif not (m["word"] or "").lower() == "graph":
            triple.append(value(m))
            if len(triple) == 3:
                out.append((graph, triple[0][0], triple[1][0], triple[2][0], triple[2][1]))
        k += 1
    return out


def trig(spark: SparkSession, path: str) -> DataFrame:
    """file, g, s, p, o, lang of Trig or Turtle files, each parsed whole by one task."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(f, *q) for f, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for q in trig_quads(t)]
            names = ["file", "g", "s", "p", "o", "lang"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(6)], names=names)

    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.mapInArrow(run, "file string, g string, s string, p string, o string, lang string")


def preferred_label(quads: DataFrame, predicate: str) -> DataFrame:
    """id, label: each subject's label, in bo before bo-x-ewts, the last of a language."""
    rows = quads.where((F.col("p") == predicate) & F.col("lang").isin("bo", "bo-x-ewts"))
    pick = lambda lang: F.max(F.when(F.col("lang") == lang, F.col("o")))
    return rows.groupBy(T.local_name(F.col("s")).alias("id")).agg(F.coalesce(pick("bo"), pick("bo-x-ewts")).alias("label"))


def authors(quads: DataFrame, creator: str, agent: str, role: str, roles: list[str], primary: str) -> DataFrame:
    """id, authors: agents of a work's creator nodes in one of the roles; only those of the primary role where there are any."""
    nodes = quads.where(F.col("p") == creator).select(T.local_name(F.col("s")).alias("id"), F.col("o").alias("_n"))
    agents = quads.where(F.col("p") == agent).select(F.col("s").alias("_n"), T.local_name(F.col("o")).alias("_a"))
    held = quads.where(F.col("p") == role).select(F.col("s").alias("_n"), T.local_name(F.col("o")).alias("_r"))
    rows = nodes.join(agents, "_n").join(held, "_n").where(F.col("_r").isin(roles))
    pick = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("_a"))))
    both = rows.groupBy("id").agg(pick(F.col("_r") == primary).alias("_p"), pick(F.col("_r") != primary).alias("_o"))
    return both.select("id", F.when(F.size("_p") > 0, F.col("_p")).otherwise(F.col("_o")).alias("authors"))


def tei_files(spark: SparkSession, folder: str) -> DataFrame:
    """volume, path, content: the first XML file by name of each archive/VE* folder, with n, the folder's place in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(folder)
    named = files.select("path", "content", F.regexp_extract("path", r"/archive/(VE[^/]+)/[^/]+\.xml$", 1).alias("volume")).where("volume <> ''")
    first = named.withColumn("_r", F.row_number().over(Window.partitionBy("volume").orderBy("path"))).where("_r = 1").drop("_r")
    return first.withColumn("n", F.row_number().over(Window.orderBy("volume")))


def changed_files(before: DataFrame | None, after: DataFrame, force: bool = False) -> DataFrame:
    """path of files that are new or differ between two snapshots (path, hash); all if forced or without one before."""
    if force or before is None:
        return after.select("path")
    return after.join(before, ["path", "hash"], "left_anti").select("path")


def latest_versions(names: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """w, i, version: the greatest version among listed keys gv/{w}/{i}/{version}/...; those in cache stay as they are."""
    parts = names.select(F.regexp_extract("key", r"^gv/([^/]+)/([^/]+)/([^/]+)/", 1).alias("w"), F.regexp_extract("key", r"^gv/([^/]+)/([^/]+)/([^/]+)/", 2).alias("i"), F.regexp_extract("key", r"^gv/([^/]+)/([^/]+)/([^/]+)/", 3).alias("version")).where("version <> ''")
    found = parts.groupBy("w", "i").agg(F.max("version").alias("version"))
    return found if cache is None else cache.unionByName(found.join(cache, ["w", "i"], "left_anti"))


def relational(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A JDBC table; give partitionColumn, lowerBound, upperBound and numPartitions to read it in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


# Patterns of transcribed sources: page [1a], line [1a.1], milestone {D1}, variants {wrong,right} or (wrong,right).
PAGE_MARK, LINE_MARK, MILESTONE, VARIANT = r"\[(\d+[ab])\]", r"\[\d+[ab]\.\d+\]", r"\{(D\d+[a-z]?)\}", r"[{(]([^,{}()]*),([^{}()]*)[})]"


def source_text(rows: DataFrame, id: str, value: str) -> DataFrame:
    """id, text, pages, milestones of transcriptions: marks go, variants keep what was written first."""
    c = F.col(value)
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, LINE_MARK, ""), PAGE_MARK, ""), MILESTONE, ""), VARIANT, "$1")
    return rows.select(id, text.alias("text"), F.regexp_extract_all(c, F.lit(PAGE_MARK), 1).alias("pages"), F.regexp_extract_all(c, F.lit(MILESTONE), 1).alias("milestones"))
