"""Operator 1: main text of web pages by nearest-URL page differencing over parsed lines.

A page is parsed into text lines, one per block, in page order. Elements that are never article text (menus, page headers
and footers, sidebars, notices, adverts, forms, scripts, styles, reader comments; by tag, role, or a class or id that says
nothing else) give no lines, and if the page declares an article or main element, lines outside it give none either. Every
page is then paired with the page of its host whose URL path is nearest: that which shares most leading path segments. The
lines of both are aligned by longest common subsequence and shared lines are deleted, but for those that a declared article
holds without any mark of boilerplate: copied articles and passages under nearby URLs are article text and stay. A class or
id that has a boilerplate word among others ("social-history") is such a mark, and differencing decides. A page whose lines
all equal its partner's tells nothing and loses none.

Differencing alone can't give right results on pages whose menus and footers vary from page to page while articles are
copied between neighbours. So the markup decides where it speaks, and differencing decides the rest.

Scale: one pass parses; one page per URL is ordered by host and path in range partitions and numbered, and neighbours meet
by their numbers, so a host with a third of all pages is no single task; only line hashes travel. Aligning takes memory in
proportion to the lines and time to their product over the machine's word.

Defined results: a null or empty page has empty text and 0 characters; a null URL pairs with nothing; repeated rows give
repeated results, and a page is never paired with its own URL; an empty table gives no rows; other columns are ignored;
very long pages are parsed whole. White space is what Unicode calls so, no-break spaces included: inside a block a run of
it becomes one space, and blocks are trimmed of it.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, partitions, table

#: Quotes count behind an equals sign only; a tag that the page's end cuts off is a tag.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROP = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "svg", "datalist"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
#: Words of class and id that name what isn't article text.
BOILER = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "masthead", "menu", "menus", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "pagination", "pager", "popup", "promo", "promoted", "promotion", "related", "replies", "respond", "share", "sharing", "sidebar", "sidebars", "signup", "social", "sponsor", "sponsored", "sponsors", "subscribe", "toolbar", "topbar", "widget", "widgets",
}
#: Words that say nothing beside a boilerplate word: "cookie-notice-box" is boilerplate, "social-history" may not be.
NEUTRAL = {"area", "bar", "block", "body", "bottom", "box", "container", "content", "desktop", "fixed", "global", "header", "holder", "inner", "item", "items", "left", "link", "links", "list", "main", "mobile", "outer", "page", "panel", "right", "section", "site", "slot", "sticky", "text", "top", "unit", "wrap", "wrapper"}
WORD = re.compile(r"[a-z]+")
HEADERS = {"header"}
DECLARED = {"article", "main"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SPLIT_URL = re.compile(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)")


SURE, NAMED, HINTED = 3, 2, 1


def boilerplate(tag: str, attributes: str, declared: int) -> int:
    """How surely an element is boilerplate: SURE by tag or role, NAMED by a class or id that says nothing else, HINTED by
    one that says more, or 0."""
    if tag in DROP or tag in HEADERS and not declared:
        return SURE
    if not attributes.strip(" /\n\t\r"):
        return 0
    found = 0
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id") and tag not in ("html", "body"):
            for one in value.split():
                words = WORD.findall(one)
                if not BOILER.isdisjoint(words):
                    found = max(found, NAMED if all(w in BOILER or w in NEUTRAL for w in words) else HINTED)
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return SURE
    return found


def lines_of(page: str) -> list[tuple[str, bool]]:
    """(line, stays) for every block with text that isn't boilerplate by its markup; a line that doesn't stay in any case is
    for differencing to judge."""
    out, named = parse(page, True)
    if not out and named:  # names that wrap a whole page are no boilerplate
        out, _ = parse(page, False)
    return out


def parse(page: str, names: bool) -> tuple[list[tuple[str, bool]], bool]:
    """The lines, and whether any element was dropped by its name."""
    out: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    stack: list[list] = []  # tag, how surely boilerplate, declares
    open_: Counter[str] = Counter()
    level = [0, 0, 0, 0]  # open elements by how surely they are boilerplate
    declared = at = 0
    here: list[tuple[bool, bool]] = []
    dropped = False

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                inside, hinted = here[0] if here else (False, False)
                out.append((text, inside, inside and not hinted))
        here.clear()

    def add(text: str) -> None:
        if text and not level[SURE] and not (names and level[NAMED]):
            parts.append(text)
            if not here and not text.isspace():
                here.append((bool(declared), bool(level[HINTED])))

    def pop() -> None:
        nonlocal declared
        tag, sure, declares = stack.pop()
        open_[tag] -= 1
        level[sure] -= 1
        declared -= declares

    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_[tag]:
                if tag not in INLINE:
                    flush()
                while True:
                    top = stack[-1][0]
                    pop()
                    if top == tag:
                        break
            elif tag not in INLINE:
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag not in INLINE:
            flush()
        if tag == "br":
            add(" ")
        if tag in VOID or m[3].endswith("/") and tag not in DROP | DECLARED:
            continue
        if tag in CLOSES_P and open_["p"]:  # an open p ends here, with whatever is open inside it
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] not in INLINE:
                    break
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            if stack and stack[-1][0] == tag:
                pop()
        sure = boilerplate(tag, m[3], declared)
        declares = tag in DECLARED or "articlebody" in m[3].lower()
        if declares and not declared and sure < SURE:  # what wraps an article is not boilerplate by its name
            sure = 0
            for one in stack:
                if one[1] in (NAMED, HINTED):
                    level[one[1]] -= 1
                    level[0] += 1
                    one[1] = 0
        dropped |= sure == NAMED
        stack.append([tag, sure, declares])
        open_[tag] += 1
        level[sure] += 1
        declared += declares
    flush()
    whole = any(inside for _, inside, _ in out)
    return [(t, stays) for t, inside, stays in out if inside or not whole], dropped


def shared(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence of a and b. Lines that the other lacks are set aside, and equal beginnings
    and ends are taken as they are, until neither is left."""
    there, here = set(b), set(a)
    at = [i for i, x in enumerate(a) if x in there]
    a, b = [a[i] for i in at], [x for x in b if x in here]
    head, most = 0, min(len(a), len(b))
    while head < most and a[head] == b[head]:
        head += 1
    foot = 0
    while foot < most - head and a[-1 - foot] == b[-1 - foot]:
        foot += 1
    inner, other = a[head : len(a) - foot], b[head : len(b) - foot]
    if inner and other:
        inner = shared(inner, other) if head or foot else longest(inner, other)
    else:
        inner = []
    return [at[i] for i in (*range(head), *(head + i for i in inner), *range(len(a) - foot, len(a)))]


def matched(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a and every beginning of b, by bits of b in one number."""
    where: dict[int, int] = defaultdict(int)
    for j, x in enumerate(b):
        where[x] |= 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        if u:
            v = (v + u | v - u) & full
    free = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(free == 0)])


def longest(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence, by halving a and splitting b where both halves match most."""
    out: list[int] = []
    left = [(0, len(a), 0, len(b))]
    while left:
        i0, i1, j0, j1 = left.pop()
        if i0 == i1 or j0 == j1:
            continue
        if i1 - i0 == 1:
            if a[i0] in b[j0:j1]:
                out.append(i0)
            continue
        mid = (i0 + i1) // 2
        fore, back = matched(a[i0:mid], b[j0:j1]), matched(a[mid:i1][::-1], b[j0:j1][::-1])[::-1]
        cut = j0 + int(np.argmax(fore + back))
        left += [(i0, mid, j0, cut), (mid, i1, cut, j1)]
    return sorted(out)


def place_of(url: str | None) -> tuple[str | None, str | None]:
    """Host, and path with its segments divided so that texts sort as paths do."""
    m = SPLIT_URL.match(url or "")
    return (m[1].lower(), m[2].strip("/").replace("/", "\x01")) if m else (None, None)


def parse_pages(pages: DataFrame) -> DataFrame:
    schema = "page_id long, url string, host string, path string, lines array<string>, stays array<boolean>, hashes array<long>"
    names = ["page_id", "url", "host", "path", "lines", "stays", "hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                lines = [lines_of(p.as_py() or "") for p in part.column(2)]
                places = [place_of(u) for u in part.column(1).to_pylist()]
                columns = [part.column(0), part.column(1), *(pa.array([p[k] for p in places], pa.string()) for k in range(2))]
                columns.append(pa.array([[t for t, _ in x] for x in lines], pa.list_(pa.string())))
                columns.append(pa.array([[s for _, s in x] for x in lines], pa.list_(pa.bool_())))
                columns.append(pa.array([[xxhash.xxh3_64_intdigest(t) - (1 << 63) for t, _ in x] for x in lines], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names)

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(run, schema)


def nearest(parsed: DataFrame) -> DataFrame:
    """(host, path, other): for each URL path, the line hashes of the path of its host that shares most segments with it.

    Among paths in order the nearest one is the one before or the one behind; of equals, the one before.
    """
    key = F.struct(F.coalesce("page_id", F.lit(-1).cast("long")), "url")
    urls = parsed.where("host is not null").groupBy("host", "path").agg(F.min_by("hashes", key).alias("hashes"))
    dealt = urls.repartitionByRange(partitions(parsed), "host", "path").sortWithinPartitions("host", "path")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            place = [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(at, at + batch.num_rows))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *place], [*batch.schema.names, "part", "at"])
            at += batch.num_rows

    placed = materialise(dealt.mapInArrow(number, "host string, path string, hashes array<long>, part int, at long"), "urls")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # a row per partition
    before = list(accumulate([0, *(r["n"] for r in sizes)]))
    first = parsed.sparkSession.createDataFrame([(r["part"], b) for r, b in zip(sizes, before, strict=False)], "part int, first long")
    rows = placed.join(F.broadcast(first), "part").select((F.col("first") + F.col("at")).alias("k"), "host", "path", "hashes")
    beside = lambda step, tag: rows.select((F.col("k") + step).alias("k"), *(F.col(c).alias(f"{c}_{tag}") for c in ("host", "path", "hashes")))
    both = rows.join(beside(1, "a"), "k", "left").join(beside(-1, "b"), "k", "left")
    parts = lambda c: F.split(F.col(c), "\x01")
    same = lambda tag: F.zip_with(parts("path"), parts(f"path_{tag}"), lambda x, y: x.eqNullSafe(y))
    depth = lambda tag: F.when(F.col("host") == F.col(f"host_{tag}"), F.array_position(same(tag), False))
    other = F.when(F.coalesce(depth("b"), F.lit(0)) > F.coalesce(depth("a"), F.lit(0)), F.col("hashes_b")).when(depth("a").isNotNull(), F.col("hashes_a"))
    return both.select("host", "path", other.alias("other"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages (page_id, url, html); see the module."""
    parsed = materialise(parse_pages(pages), "lines")
    judged = F.col("host").isNotNull() & ~F.forall("stays", lambda x: x)  # pages whose lines all stay need no partner
    pairs = parsed.where(judged).join(nearest(parsed), ["host", "path"], "left").select("page_id", "url", "lines", "stays", "hashes", "other")
    alone = parsed.where(~judged).select("page_id", "url", "lines", "stays", "hashes", F.lit(None).cast("array<long>").alias("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lines, stays, hashes, other in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                judged = other is not None and not all(stays) and hashes != other
                gone = {i for i in shared(hashes, other) if not stays[i]} if judged else ()
                out.append("\n\n".join(t for i, t in enumerate(lines) if i not in gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pairs.unionByName(alone).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
