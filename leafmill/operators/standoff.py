"""TEI to plain text with standoff annotations, by one walk of the tree and one pass of white-space rules; and its verification.

The walk writes the body's text and marks (pages, milestones, divisions, highlights) at their offsets. Then white space is made
regular, and every mark is carried along with the character it stands at.
"""

from __future__ import annotations

import json
import re
import unicodedata
import xml.etree.ElementTree as ET
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEI = "{http://www.tei-c.org/ns/1.0}"
XML = "{http://www.w3.org/XML/1998/namespace}"


class _Writer:
    def __init__(self, preserve: bool):
        self.parts: list[str] = []
        self.length = 0
        self.preserve = preserve
        self.pages: list[dict] = []
        self.stones: dict[str, int] = {}
        self.divs: list[list[int]] = []
        self.his: list[dict] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)

    def walk(self, node: ET.Element) -> None:
        self.write(node.text or "")
        for child in node:
            self.element(child)
            self.write(child.tail or "")

    def marked(self, rend: str, inside) -> None:
        mark = {"rend": rend, "cstart": self.length, "cend": 0}
        self.his.append(mark)
        inside()
        mark["cend"] = self.length

    def element(self, node: ET.Element) -> None:
        name = node.tag.removeprefix(TEI) if isinstance(node.tag, str) else "note"
        if name == "note":
            return
        if name == "gap":
            self.write("X")
        elif name == "lb":
            self.write("\ue000")
        elif name == "pb":
            self.pages.append({"at": self.length, "pname": node.get("n")})
            self.write("\ue001")
        elif name == "milestone":
            if id := node.get(f"{XML}id"):
                self.stones[id] = self.length
        elif name == "figure":
            self.write(" ".join(t for c in node.iter(f"{TEI}caption") for t in map(str.strip, c.itertext()) if t))
        elif name == "choice":
            better = next((x for n in ("corr", "reg") for x in node.iter(f"{TEI}{n}")), None)
            self.write("".join(better.itertext())) if better is not None else self.walk(node)
        elif name == "unclear":
            self.marked("unclear", lambda: self.write("".join(node.itertext())))
        elif name in ("head", "hi"):
            self.marked("head" if name == "head" else node.get("rend", ""), lambda: self.walk(node))
        elif name in ("div", "p"):
            gap = "" if self.preserve else "\n\n"
            self.write(gap)
            span = [self.length, 0]
            if name == "div" and not self.preserve:
                self.divs.append(span)
            self.walk(node)
            span[1] = self.length
            self.write(gap)
        else:
            self.walk(node)


# Line breaks and page breaks take the white space around them along; line ends lose the blanks beside them, and more than two
# in a row become two.
_RULES = ((re.compile("\\s*\ue001\\s*"), lambda m: "\n\n" if m.start() else ""), (re.compile("[\r\n\t ]*\ue000[\r\n\t ]*"), lambda m: "\n"), (re.compile("[\t \r]*\n[\t \r]*"), lambda m: "\n"), (re.compile("\n{3,}"), lambda m: "\n\n"), (re.compile(r"\A\s+|\s+\Z"), lambda m: ""), (re.compile("\ufeff"), lambda m: ""))


def _replaced(text: str, pattern: re.Pattern, new, marks: list[int]) -> tuple[str, list[int]]:
    """text with matches replaced, and marks moved: those inside a match go to the end of what replaces it, those at its start stay before."""
    out, last, starts, shifts = [], 0, [], []
    size = 0
    for m in pattern.finditer(text):
        value = new(m)
        out += [text[last : m.start()], value]
        size += m.start() - last + len(value)
        starts.append(m.start())
        shifts.append((m.end(), size, size - len(value)))
        last = m.end()
    out.append(text[last:])
    moved = []
    for at in marks:
        k = bisect_right(starts, at) - 1
        if k < 0:
            moved.append(at)
        elif at >= shifts[k][0]:
            moved.append(at - shifts[k][0] + shifts[k][1])
        else:
            moved.append(shifts[k][1] if at > starts[k] else shifts[k][2])
    return "".join(out), moved


def to_standoff(xml: str | bytes) -> dict | None:
    """text, pages, milestones, div_boundaries, hi, source_path of a TEI document; None if it is not XML or has no body.

    Notes go, gaps become X, corrections stand for what they correct, captions for their figures. Page ends are two characters
    before the next page; pages also give the milestones bop:n and eop:n."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return None
    body = root if root.tag == f"{TEI}body" else root.find(f".//{TEI}body")
    if body is None:
        return None
    w = _Writer(body.get(f"{XML}space") == "preserve")
    w.walk(body)
    text = "".join(w.parts)
    names = list(w.stones)
    marks = [p["at"] + 1 for p in w.pages] + [w.stones[n] for n in names] + [x for d in w.divs for x in d] + [h[k] for h in w.his for k in ("cstart", "cend")]
    for pattern, new in _RULES:
        text, marks = _replaced(text, pattern, new, marks)
    marks = [max(0, min(m, len(text))) for m in marks]
    take = iter(marks)
    pages = [{"cstart": next(take), "pnum": i + 1} | ({"pname": p["pname"]} if p["pname"] else {}) for i, p in enumerate(w.pages)]
    for page, after in zip(pages, [*pages[1:], None]):
        page["cend"] = len(text) if after is None else max(page["cstart"], after["cstart"] - 2)
    stones = {n: next(take) for n in names}
    skip = lambda at: at + len(text[at:]) - len(text[at:].lstrip("\n"))
    divs = [{"cstart": next(take), "cend": next(take)} for _ in w.divs]
    if divs and stones:
        stones = {n: skip(at) for n, at in stones.items()}
        divs = [d | {"cend": skip(d["cend"])} for d in divs]
    his = [{"rend": h["rend"], "cstart": next(take), "cend": next(take)} for h in w.his]
    for page in pages:
        stones |= {f"bop:{page['pnum']}": page["cstart"], f"eop:{page['pnum']}": page["cend"]}
    path = next((e.text for e in root.iter(f"{TEI}idno") if e.get("type") == "src_path"), None)
    return {"text": text, "pages": pages, "milestones": stones, "div_boundaries": divs, "hi": his, "source_path": path}


SCHEMA = "text string, pages array<struct<cstart:int,cend:int,pnum:int,pname:string>>, milestones map<string,int>, hi array<struct<rend:string,cstart:int,cend:int>>, source_path string"


def standoff(files: DataFrame, id: str, content: str) -> DataFrame:
    """id and the standoff form of each TEI document; a document that cannot be read has a null text."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    rest = _parse_datatype_string(SCHEMA)
    assert isinstance(rest, StructType)
    kind = StructType().add("id", files.schema[id].dataType)
    for field in rest.fields:
        kind = kind.add(field)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kind)
        for batch in batches:
            found = [to_standoff(x) or {} for x in batch.column(1).to_pylist()]
            cells = [batch.column(0).to_pylist(), *([f.get(c) for f in found] for c in ("text", "pages", "milestones", "hi", "source_path"))]
            cells[3] = [None if m is None else list(m.items()) for m in cells[3]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, schema.types)], schema=schema)

    return files.select(id, content).mapInArrow(run, kind)


def compared(text: str) -> str:
    """text for comparison: composed, without byte-order marks, with single spaces and line ends."""
    return re.sub(r"\s*\n\s*", "\n", re.sub(r"[ \t]+", " ", unicodedata.normalize("NFC", text.replace("\ufeff", "")))).strip()


def verification(converted: DataFrame, sources: DataFrame) -> DataFrame:
    """id, check, detail of conversions (id, text, pages, milestones) against transcriptions (id, text, pages, milestones): texts that
    differ, milestones or pages on one side only (a first page 1a may be missing), and offsets outside the text."""
    same = F.udf(lambda a, b: None if compared(a or "") == compared(b or "") else "texts differ", "string")
    src = sources.select("id", F.col("text").alias("_t"), F.col("pages").alias("_p"), F.col("milestones").alias("_m"))
    own = F.filter(F.map_keys("milestones"), lambda k: ~k.rlike("^[be]op:"))
    names = F.filter(F.transform("pages", lambda p: p["pname"]), lambda n: n.isNotNull())
    n = F.length("text")
    out = F.exists(F.map_values("milestones"), lambda v: (v < 0) | (v > n)) | F.exists("pages", lambda p: (p["cstart"] < 0) | (p["cend"] > n) | (p["cend"] < p["cstart"]))
    listed = lambda a: F.when(F.size(a) > 0, F.array_join(F.array_sort(a), ","))
    checks = {
        "text": same("text", "_t"),
        "milestones_missing": listed(F.array_except("_m", own)),
        "milestones_extra": listed(F.array_except(own, "_m")),
        "pages_missing": listed(F.filter(F.array_except("_p", names), lambda x: x != "1a")),
        "pages_extra": listed(F.filter(F.array_except(names, "_p"), lambda x: x != "1a")),
        "bounds": F.when(out, "outside the text"),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("check"), v.alias("detail")) for k, v in checks.items()))
    return converted.join(src, "id").select("id", F.inline(rows)).where(F.col("detail").isNotNull())


def as_json(found: dict) -> str:
    return json.dumps(found, ensure_ascii=False, sort_keys=True)
