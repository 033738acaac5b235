"""HTML extraction with wrappers inferred by union-free regular-expression inference.

A page is a stream of tokens: tags (with their class, id and role) and texts. Repeated neighbours of one shape fold into a
repeated group, so a page becomes a short expression. The expressions of a host are aligned one after the other: where they
match, texts that differ become slots; where they do not, the unmatched part becomes optional, or repeated if it is one
more of the group beside it. The result, without unions, is the host's wrapper. It says which region holds the text
that varies from page to page; pages are then read along it.

Wrappers are inferred from distinct expressions only, with counts: tasks fold the pages they read, and what is left for a host
is folded by host. Pages get their host's wrapper by a join, by broadcast where the wrappers' size allows.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import staged

MARKUP = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
TAG_PART = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

# Element roles in HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
NEVER = RAW | {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "input", "label", "svg", "math", "canvas", "audio", "video", "object", "menu", "dialog"}
MAIN = ("article", "main")
# Marks in class, id or role that name what is not the article. A mark is one whole name: words of WHERE, then one of
# WHAT, then words of WHAT or KIND_OF, or one of LOOSE, then words of KIND_OF; so no-sidebar, comments-open or tag-cookies say nothing.
# A mark of OWN says that an element is the article's, whatever else it is called. Headings are no parts of a page, and their ids are
# often made from their texts.
WHERE = "site|page|main|global|primary|secondary|top|bottom|left|right|fixed|sticky|mobile|desktop|floating|inline|post|article|entry|story|widget|user|reader|the|js"
WHAT = r"ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscri\w*|sidebar|nav|navbar|navigation|menus?|menubar|breadcrumbs?|header|masthead|footer|copyright|share|sharing|comments?|disqus|login|signup|widget|toolbar|pagination|pager|complementary|contentinfo"
LOOSE = r"notice|side|aside|foot|social|related|recommend\w*|replies|respond|search|tags?"
KIND_OF = r"ar(?:ea|ticles)|bar|block|box|buttons?|cloud|column|container|content|form|frame|icons?|inner|items?|left|links?|list|media|outer|pages|panel|posts|rail|read(?:ing|s)|right|row|section|slot|stories|thread|top|unit|wrap(?:per)?|\d+"
BESIDE = re.compile(rf"(?:^|\s)(?:(?:{WHERE})[_-])*(?:(?:{WHAT})(?:[_-]+(?:{WHAT}|{KIND_OF}))*|(?:{LOOSE})(?:[_-]+(?:{KIND_OF}))*)(?:$|\s)", re.IGNORECASE)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
OWN = re.compile(r"(?:^|\s)(?:(?:main|article|post|entry|story|page)[_-](?:content|body|text)|content|article|main)(?:$|\s)", re.IGNORECASE)
SPACE = re.compile(r"\s+")
RAW_ENDS = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW}
#: A wrapper describes elements that are nested so deep, at most; deeper ones are read all the same.
DEPTH = 120


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value): open/close with a tag's name and its class, id and role; text with its raw characters. Contents of
    raw elements end at their own closing tag only; comments, declarations and broken tags' rests give no token."""
    at, n = 0, len(page)
    lost: set[str] = set()  # quotes that have no other one behind them

    def tag_end(k: int) -> int:
        """The place of the > that ends the tag, quoted ones left out, or n. A quote that is never closed counts for nothing."""
        while (m := TAG_PART.search(page, k)) is not None:
            if m[0] == ">":
                return m.start()
            k = m.end()
            if m[0] not in lost:
                end = page.find(m[0], k)
                if end < 0:
                    lost.add(m[0])
                else:
                    k = end + 1
        return n

    while at < n:
        m = MARKUP.search(page, at)
        if m is None:
            yield "text", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        if not m[5]:
            mark = "-->" if m[1] else "]]>" if m[2] else ">"
            end = page.find(mark, m.end())
            at = n if end < 0 else end + len(mark)
            continue
        name, end = m[5].lower(), tag_end(m.end())
        inside, at = page[m.end() : end], min(n, end + 1)
        if m[4]:
            yield "close", name, ""
            continue
        marks = " ".join((a[1] or a[2] or a[3]) for a in ATTRIBUTE.findall(inside) if a[0].lower() in ("class", "id", "role")) if inside else ""
        yield "open", name, marks
        if name in RAW:
            end_tag = RAW_ENDS[name].search(page, at) if name not in lost else None
            if end_tag is None:
                lost.add(name)
            yield "text", "", page[at : end_tag.start() if end_tag else n]
            at = end_tag.end() if end_tag else n
            yield "close", name, ""
        elif name in VOID or inside.endswith("/") and name not in BLOCKS:
            yield "close", name, ""


class Node:
    """An element, or a text (name "")."""

    __slots__ = ("name", "marks", "children", "text")

    def __init__(self, name: str, marks: str = "", text: str = ""):
        self.name, self.marks, self.text, self.children = name, marks, text, []


def tree(page: str) -> Node:
    """The page's elements, however deep they are. Open elements end with their parent; a block ends an open p, and li, tr, td and the
    like end the one before."""
    root = Node("#")
    open_: list[Node] = [root]
    names: Counter[str] = Counter()  # of open elements, so that none is looked for in vain
    like = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
    bounds = {"ul", "ol", "dl", "table", "select", "#", "article", "section", "div", "body"}

    def end(k: int) -> None:
        names.subtract(node.name for node in open_[k:])
        del open_[k:]

    for kind, name, value in tokens(page):
        if kind == "text":
            open_[-1].children.append(Node("", text=value))
        elif kind == "open":
            ends = like.get(name, set()) | ({"p"} if name in CLOSES_P else set())
            for k in range(len(open_) - 1, 0, -1) if any(names[e] for e in ends) else ():
                if open_[k].name in ends:
                    end(k)
                    break
                if open_[k].name in bounds:
                    break
            node = Node(name, value)
            open_[-1].children.append(node)
            open_.append(node)
            names[name] += 1
        elif names[name]:
            k = len(open_) - 1
            while open_[k].name != name:
                k -= 1
            end(k)
    return root


# An expression is a list of items; an item is [kind, label, repeated, optional, inner, value]: kind "e" for an element, "t"
# for a text; value is a text that all pages share, or null for a slot.
KIND, LABEL, MANY, MAY, INNER, VALUE = range(6)
#: A shared text longer than this is kept as a digest.
SHOWN = 60


def label(node: Node) -> str:
    """Name and marks of an element; marks with digits are left out, as they number pages or parts of them."""
    marks = [m for m in SPACE.split(node.marks) if m and not any(map(str.isdigit, m))]
    return ".".join([node.name, *marks])


def expression(node: Node, depth: int = DEPTH) -> list:
    """The folded expression of a node's children; inline elements within text count as text."""
    items: list = []
    for child in node.children:
        if not child.name or child.name not in BLOCKS | NEVER:
            text = SPACE.sub(" ", entities.unescape(flat(child))).strip()
            if not text and not (child.name and child.children):
                continue
            if items and items[-1][KIND] == "t":
                items[-1][VALUE] = None
            elif text:
                items.append(["t", "", 0, 0, [], digest(text)])
        else:
            items.append(["e", label(child), 0, 0, [] if child.name in RAW or not depth else expression(child, depth - 1), None])
    return fold(items)


def flat(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        at = todo.pop()
        out.append(at.text)
        todo += reversed(at.children)
    return "".join(out)


def digest(text: str) -> str:
    import hashlib

    return text if len(text) <= SHOWN else "=" + hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def same(a: list, b: list) -> bool:
    return a[KIND] == b[KIND] and a[LABEL] == b[LABEL]


#: Repeats of up to so many items are folded, and so many cells are spent on an alignment before it goes greedily.
PERIOD, CELLS = 6, 1_000_000


def fold(items: list) -> list:
    """Neighbours of one label become one repeated item, and neighbouring equal runs of up to PERIOD labels one repeated group
    (label "*"); the inside is the alignment of all repeats."""
    out: list = []
    for item in items:
        if out and item[KIND] == "e" and item[LABEL] != "*" and same(out[-1], item):
            out[-1] = merged(out[-1], item)
            out[-1][MANY] = 1
            continue
        out.append(item)
        for k in range(2, PERIOD + 1):
            run = out[-k:]
            if len(out) > k and out[-k - 1][LABEL] == "*" and len(out[-k - 1][INNER]) == k and all(map(same, out[-k - 1][INNER], run)):
                out[-k - 1 :] = [["e", "*", 1, out[-k - 1][MAY], [merged(p, q) for p, q in zip(out[-k - 1][INNER], run)], None]]
                break
            if len(out) >= 2 * k and all(i[LABEL] != "*" for i in out[-2 * k :]) and all(map(same, out[-2 * k : -k], run)):
                out[-2 * k :] = [["e", "*", 1, 0, [merged(p, q) for p, q in zip(out[-2 * k : -k], run)], None]]
                break
    return out


def merged(a: list, b: list) -> list:
    """One item for two of the same label: texts that differ become a slot."""
    value = a[VALUE] if a[VALUE] == b[VALUE] else None
    return [a[KIND], a[LABEL], a[MANY] | b[MANY], a[MAY] | b[MAY], align(a[INNER], b[INNER]), value]


def align(a: list, b: list) -> list:
    """The least general expression without unions for both: a longest common subsequence of labels is matched, and what is
    left on either side becomes optional, or goes into the repeated group beside it. Common ends are matched first."""
    if a == b:
        return a
    start = 0
    while start < min(len(a), len(b)) and same(a[start], b[start]):
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and same(a[-1 - end], b[-1 - end]):
        end += 1
    x, y = a[start : len(a) - end], b[start : len(b) - end]
    out = [merged(p, q) for p, q in zip(a[:start], b[:start])]
    if len(x) * len(y) > CELLS:  # too unlike to spend the square of their lengths: both sides become optional
        out += [[*i[:MAY], 1, *i[INNER:]] for i in x + y]
        x, y = [], []
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if same(x[i], y[j]) else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and same(x[i], y[j]):
            out.append(merged(x[i], y[j]))
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and best[i + 1][j] >= best[i][j + 1]:
            out.append([*x[i][:MAY], 1, *x[i][INNER:]])
            i += 1
        else:
            out.append([*y[j][:MAY], 1, *y[j][INNER:]])
            j += 1
    return fold(out + [merged(p, q) for p, q in zip(a[len(a) - end :], b[len(b) - end :])])


def slots(items: list) -> int:
    """How much of an expression varies: its slots, and repeated groups twice."""
    return sum((i[VALUE] is None if i[KIND] == "t" else slots(i[INNER])) * (2 if i[MANY] else 1) for i in items)


def beside(name: str, marks: str) -> bool:
    return name in NEVER or bool(marks and name not in ("html", "body", *MAIN, *HEADINGS) and marked(marks))


@lru_cache(100_000)
def marked(marks: str) -> bool:
    """Whether an element's class, id or role says that it stands beside the article."""
    return bool(BESIDE.search(marks) and not OWN.search(marks))


def region(wrapper: list) -> list[str]:
    """The labels that lead from the root to the wrapper's main region: an article or main if there is one, else the deepest
    element that holds most of what varies beside menus, headers, footers and the like."""

    def find(items, path):
        for item in items:
            name, _, marks = item[LABEL].partition(".")
            if item[KIND] == "e" and name in MAIN and not item[MANY]:
                return [*path, item[LABEL]]
            if item[KIND] == "e" and not beside(name, marks.replace(".", " ")) and (found := find(item[INNER], [*path, item[LABEL]])):
                return found
        return None

    if path := find(wrapper, []):
        return path
    path, items = [], wrapper
    while True:
        inner = [i for i in items if i[KIND] == "e" and not beside(i[LABEL].partition(".")[0], i[LABEL].partition(".")[2].replace(".", " "))]
        total = sum(slots([i]) for i in items if i[KIND] == "t" or i in inner)
        top = max(inner, key=lambda i: slots(i[INNER]), default=None)
        if top is None or top[MANY] or slots(top[INNER]) <= total / 2 or top[LABEL].partition(".")[0] in ("p", "h1", "h2", "table", "ul", "ol"):
            return path
        path, items = [*path, top[LABEL]], top[INNER]


def fixed_texts(wrapper: list, path: list[str]) -> set[str]:
    """Digests of texts in the main region that have one value in the wrapper, where other texts of the region vary: what may be
    template text. They include texts that one page alone has; confirmed() counts pages. None for an article or main, which
    are all of the page's own."""
    if path and path[-1].partition(".")[0] in MAIN:
        return set()
    items = wrapper
    for name in path:
        items = next((i[INNER] for i in items if i[KIND] == "e" and i[LABEL] == name), [])
    found: set[str] = set()

    def walk(items):
        for i in items:
            if i[KIND] == "t" and i[VALUE] is not None:
                found.add(i[VALUE])
            walk(i[INNER])

    walk(items)
    return found if slots(items) else set()


def main_text(page: str | None, path: list[str], fixed: set[str]) -> str:
    """The page's blocks in the main region, joined by two line ends. fixed: digests of the template's texts, left out."""
    return "\n\n".join(b for b in main_blocks(page, path) if not (fixed and digest(b) in fixed))


def main_blocks(page: str | None, path: list[str]) -> list[str]:
    """The page's blocks in the main region. Without a wrapper's region on the page, an article or main of its own counts, else
    the whole body."""
    root = tree(page or "")

    def by_path(node, path):
        if not path:
            return node
        for child in node.children:
            if child.name and label(child) == path[0] and (found := by_path(child, path[1:])):
                return found
        return None

    def first_main(node):
        todo = [*reversed(node.children)]
        while todo:
            at = todo.pop()
            if at.name in MAIN and not marked(at.marks):
                return at
            todo += reversed(at.children)
        return None

    top = (by_path(root, path) if path else None) or first_main(root) or root
    if top.name not in MAIN:
        top = first_main(top) or top
    blocks: list[str] = []
    held: list[str] = []

    def close():
        text = SPACE.sub(" ", entities.unescape("".join(held))).strip()
        held.clear()
        if text:
            blocks.append(text)

    # what is left to be read, last first; None ends a block
    todo: list[Node | None] = [*reversed(top.children)]
    while todo:
        child = todo.pop()
        if child is None:
            close()
        elif not child.name:
            held.append(child.text)
        elif child.name == "br":
            held.append(" ")
        elif not beside(child.name, child.marks) and not (child.name in MAIN and marked(child.marks)):
            if child.name in BLOCKS:
                close()
                todo.append(None)
            todo += reversed(child.children)
    close()
    return blocks


HOST = r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
#: Hosts that a task folds before it hands its wrappers on, and wrappers of a host that are folded in one group first.
HELD, SPREAD = 2000, 64
#: Template texts are only told from chance by so many pages.
LEAST_PAGES = 5
#: A template text is on so many per cent of the host's different pages.
NEARLY_ALL = 90
BROADCAST_BYTES = 16 << 20


def wrappers(pages: DataFrame) -> DataFrame:
    """host, path, fixed: of each host's inferred wrapper, the main region's labels and the template texts in it, as JSON: texts on
    nearly all of the host's different pages.

    Every page of a host goes into its wrapper. Tasks fold theirs first; a host's partial wrappers are folded in SPREAD
    groups and then in one, so a group holds few wrappers, never pages."""
    named = pages.select(F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")).alias("host"), "html")
    kind = "host string, part int, pages long, wrapper string"

    def fold_pages(batches):
        import pyarrow as pa

        held: dict[str, tuple[int, list]] = {}

        def flush():
            rows = [(h, hash_part(h, w), n, json.dumps(w)) for h, (n, w) in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.string()))], names=["host", "part", "pages", "wrapper"])

        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
                found = expression(tree(page.as_py() or ""))
                n, had = held.get(host, (0, None))
                held[host] = n + 1, found if had is None else align(had, found)
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    def fold_partial(key, table):
        import pyarrow as pa

        texts = sorted(zip(table["wrapper"].to_pylist(), table["pages"].to_pylist()))
        out = json.loads(texts[0][0])
        for text, _ in texts[1:]:
            out = align(out, json.loads(text))
        return pa.table({"host": [key[0].as_py()], "part": pa.array([0], pa.int32()), "pages": pa.array([sum(n for _, n in texts)], pa.int64()), "wrapper": [json.dumps(out)]})

    def regions(hosts, counts, texts):
        rows = []
        for n, text in zip(counts, texts):
            wrapper = json.loads(text)
            path = region(wrapper) if wrapper else []
            rows.append((json.dumps(path), json.dumps(sorted(fixed_texts(wrapper, path)) if n >= LEAST_PAGES else [])))
        return hosts, [p for p, _ in rows], [f for _, f in rows]

    from leafmill.llm.common import map_columns

    partial = named.mapInArrow(fold_pages, kind)
    partial = partial.groupBy("host", "part").applyInArrow(fold_partial, kind).groupBy("host").applyInArrow(fold_partial, kind)
    return confirmed(named, staged(map_columns(partial.select("host", "pages", "wrapper"), regions, "host string, path string, fixed string"), "wrappers"))


def confirmed(named: DataFrame, found: DataFrame) -> DataFrame:
    """found (host, path, fixed) with only those texts in fixed that stand in the main region of nearly all of the host's pages
    (host, html). Pages of a host with equal main texts count once, so copies do not turn their own text into template text.
    Only pages of hosts with such texts are read for it."""
    from leafmill.llm.common import map_columns

    asked = found.where("fixed <> '[]'").withColumnRenamed("host", "_h")
    size = asked.agg(F.sum(F.octet_length("path") + F.octet_length("fixed") + F.octet_length("_h") + 64)).first()[0]
    if size is None:
        return found
    pages = named.join(F.broadcast(asked) if size <= BROADCAST_BYTES else asked, F.col("host") == F.col("_h")).select("host", "html", "path", "fixed")

    def hits(hosts, htmls, paths, fixed):
        import hashlib

        blocks = [main_blocks(h, json.loads(p)) for h, p in zip(htmls, paths)]
        keys = [hashlib.blake2b("\n\n".join(b).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() for b in blocks]
        return hosts, keys, [sorted(set(json.loads(f)) & set(map(digest, b))) for f, b in zip(fixed, blocks)]

    seen = staged(map_columns(pages, hits, "host string, page string, hits array<string>").distinct(), "template-texts")
    total = seen.groupBy("host").agg(F.count("*").alias("total")).where(F.col("total") >= LEAST_PAGES)
    per = seen.select("host", F.explode("hits").alias("hit")).groupBy("host", "hit").agg(F.count("*").alias("n")).join(total, "host")
    sure = per.where(F.col("n") * 100 >= F.col("total") * NEARLY_ALL).groupBy("host").agg(F.to_json(F.sort_array(F.collect_list("hit"))).alias("_sure"))
    sure = sure.withColumnRenamed("host", "_h")
    return staged(found.join(sure, F.col("host") == F.col("_h"), "left").select("host", "path", F.coalesce("_sure", F.lit("[]")).alias("fixed")), "confirmed")


def hash_part(host: str, wrapper: list) -> int:
    import zlib

    return zlib.crc32(repr((host, wrapper)).encode("utf-8", "surrogatepass")) % SPREAD


def html_extract(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text: the main text by the wrapper of the page's host.

    Blocks have their character references decoded and white space turned into single spaces; they are joined in page order by
    two line ends. A null or empty html has an empty text; pages with a null or odd url share the wrapper of host "". A
    page without its wrapper's region is read by its own article, main or body. Repeated rows pass as they are; other
    columns are not read; empty tables give empty results.
    """
    from leafmill.llm.common import map_columns

    found = wrappers(pages)
    size = found.agg(F.coalesce(F.sum(F.octet_length("path") + F.octet_length("fixed") + F.octet_length("host") + 64), F.lit(0))).first()[0]
    found = found.withColumnRenamed("host", "_h")
    own = pages.select("page_id", "url", "html", F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")).alias("_host"))
    joined = own.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, F.col("_host") == F.col("_h"), "left").select("page_id", "url", "html", "path", "fixed")

    def read(ids, urls, htmls, paths, fixed):
        return ids, urls, [main_text(h, json.loads(p or "[]"), set(json.loads(f or "[]"))) for h, p, f in zip(htmls, paths, fixed)]

    kind = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return map_columns(joined, read, f"page_id {kind['page_id']}, url {kind['url']}, text string")
