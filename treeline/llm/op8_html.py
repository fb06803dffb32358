"""Main text of web pages by nearest-URL page differencing.

Pages are sorted by host and URL path (numbers in a path by value), and each is compared with the two pages before it and
the two after it on its host. Its text lines are aligned with those of each neighbour by a longest common subsequence. A
line that two neighbours have, or the only neighbour there is, is the site's furniture and is deleted. One neighbour of
several may quote it. A neighbour that has nearly all lines of the page (COPY of their characters) is a copy and says
nothing. A line is a block of text together with what it stands in, so that a menu entry never matches a sentence.

A check of the markup follows, for what no alignment can tell: furniture that differs from page to page, hosts with one
page, and text that many pages quote.

- Lines in menus, headers, footers, sidebars, forms, adverts, notices and reader comments, by element, role, class or id,
  go, shared or not.
- A marked article (<article>, <main>, articleBody) wins over forms, and over class names of what it stands in, unless
  these say comments, related pages or adverts. In it, only menus, footers, forms, comments, adverts and appeals go.
- Shared lines in a marked article stay.

The sort is a range partitioning, so a host that holds a third of all pages is spread over many tasks. Its bounds come from a
sample of the URLs (BOUNDS a partition), so pages are parsed once. Neighbours beyond the edge of a partition come from
what each partition writes along: its first four and its last four pages.

Defined results for odd input: null and empty html give an empty text; a null URL counts as an empty one; repeated rows
are pages of their own; unclosed elements end where HTML ends them; a ``<`` with a letter after it opens a tag, even where a
formula was meant; pages of any length are aligned in memory that grows with the root of the number of lines times their
number; pages of one URL lie in the order of page_id and content, and of several longest alignments one is taken, the same in
each run; an empty table gives no rows; other columns, also with names used here, are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from itertools import accumulate
from math import isqrt

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.sampling import thinned
from treeline.session import written

NAME = "op8_main_text"
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""(role|class|id|itemprop|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "select", "head", "canvas", "audio", "video", "xmp", "noframes"}
IN_HEAD = {"title", "meta", "link", "script", "style", "base", "noscript", "template"}
#: Raw text: nothing inside is markup until the end tag.
OPAQUE = {"script", "style", "textarea", "title", "iframe", "xmp", "noframes", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "br", "search",
}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "label", "search"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "menu", "menubar", "toolbar"}
#: Words that name furniture: in classes and ids of which every other word says no more than where or what kind of box.
NAMES = re.compile(r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|sidebar\w*|menu\w*|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|comments?|commentlist|discussion|replies|respond|disqus\w*|related|recommend\w*|share|sharing|social|widget|toolbar|pagination|pager|login")
#: In a marked article, only these elements and names are furniture.
WITHIN = {"nav", "footer", "form", "menu", "dialog", "button", "label", "search"}
NAMES_WITHIN = re.compile(r"ads?|advert\w*|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|popup|modal|newsletter|subscribe|signup|navbar|breadcrumbs?|comments?|commentlist|replies|respond|disqus\w*|share|sharing|social|pagination|pager")
#: Around a marked article, these make it no article.
NO_ARTICLE = re.compile(r"ads?|advert\w*|sponsor\w*|promo\w*|comments?|commentlist|discussion|replies|respond|disqus\w*|related|recommend\w*")
REPLIES = re.compile(r"comments?|reply|replies")
PLAIN = re.compile(r"site|page|global|main|top|bottom|left|right|upper|lower|inner|outer|wrap(?:per)?|container|holder|box|block|area|section|bar|strip|panel|pane|slot|unit|zone|list|items?|links?|buttons?|btn|icons?|group|row|col|column|primary|secondary|user|post|entry|article|content|mobile|desktop|sticky|fixed|js|ui|[a-z]|\d*")
#: What a new element closes if that is open: HTML's implied end tags.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


BOUNDS = 100
COPY = 0.9
AROUND = 2


def named(words: re.Pattern, names: tuple[str, ...]) -> bool:
    """Whether a class or an id names furniture: one of its words does, and none of the others has a meaning of its own."""
    for token in " ".join(names).split():
        parts = re.split(r"[-_:]+", token)
        if any(map(words.fullmatch, parts)) and all(words.fullmatch(p) or NAMES.fullmatch(p) or PLAIN.fullmatch(p) for p in parts):
            return True
    return False


def lines(page: str | None) -> list[tuple[str, str, bool, bool]]:
    """(text, where it stands, whether that is furniture, whether it is in a marked article) of each block with text."""
    out: list[tuple[str, str, bool, bool]] = []
    stack: list[tuple[str, int, int, int]] = []  # element, and around it: furniture that an article can overrule, other furniture, articles
    held: list[str] = []
    soft = hard = good = 0

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((text, ">".join(x[0] for x in stack[-3:]), soft + hard > 0, good > 0))

    def close_from(depth: int) -> None:
        nonlocal soft, hard, good
        soft, hard, good = stack[depth][1:]
        del stack[depth:]

    page, at = page or "", 0
    while at < len(page):
        m = TOKEN.search(page, at)
        upto = m.start() if m else len(page)
        if upto > at:
            if stack and stack[-1][0] == "head" and page[at:upto].strip():
                close_from(len(stack) - 1)
            held.append(page[at:upto])
        if not m:
            break
        at = m.end()
        close, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in BLOCKS or name in RAW:
            flush()
        if close:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None and name in BLOCKS | FURNITURE | RAW or depth == len(stack) - 1:
                close_from(depth)
            continue
        if name not in IN_HEAD:  # an open head ends with the first element that can't be in it
            depth = next((k for k, x in enumerate(stack) if x[0] == "head"), None)
            if depth is not None:
                close_from(depth)
        if name in VOID:
            continue
        if name in OPAQUE:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in BLOCKS and name != "br":  # a block ends an open paragraph, with the inline elements in it
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p" or stack[k][0] in BLOCKS - {"p"}), None)
            if depth is not None and stack[depth][0] == "p":
                close_from(depth)
        if name in CLOSES:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in CLOSES[name] or stack[k][0] in ("ul", "ol", "dl", "table")), None)
            if depth is not None and stack[depth][0] in CLOSES[name]:
                close_from(depth)
        if attributes.rstrip().endswith("/") and name not in BLOCKS:
            continue
        found = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(attributes)} if attributes else {}
        role, names = found.get("role", ""), (found.get("class", ""), found.get("id", ""))
        main = name in ("article", "main") or role in ("main", "article") or found.get("itemprop") == "articlebody"
        unseen = name in RAW or "hidden" in found or found.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", found.get("style", "")))
        stack.append((name, soft, hard, good))
        if main:
            off = unseen or named(REPLIES, names)
            hard += off
            if not hard:
                soft, good = 0, good + 1
        elif good:
            hard += unseen or name in WITHIN or role in ROLES or named(NAMES_WITHIN, names)
        elif name not in ("html", "body"):
            hard += unseen or name in FURNITURE - {"form"} or role in ROLES - {"form"} or named(NO_ARTICLE, names)
            soft += "form" in (name, role) or named(NAMES, names)
    flush()
    return out


def shared(a: list, b: list) -> set[int]:
    """Indices into a of one longest common subsequence of a and b.

    One bit vector a row of the table says where its lengths grow. Every k-th row is kept, k the root of their number,
    and the rows between are made again on the way back.
    """
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    both = set(a[first : len(a) - last]) & set(b[first : len(b) - last])  # no other line can be in it
    at = [i for i in range(first, len(a) - last) if a[i] in both]
    place: dict = {}
    n = 0
    for x in b[first : len(b) - last]:
        if x in both:
            place[x] = place.get(x, 0) | 1 << n
            n += 1
    full, step = (1 << n) - 1, isqrt(len(at)) + 1

    def row(v: int, i: int) -> int:
        u = v & place[a[i]]
        return ((v + u) | (v - u)) & full

    kept_rows, v = [full], full
    for k, i in enumerate(at):
        v = row(v, i)
        if (k + 1) % step == 0:
            kept_rows.append(v)
    kept, j = [], n
    for block in range(len(at) // step, -1, -1):
        rows = [kept_rows[block]]
        for i in at[block * step : (block + 1) * step]:
            rows.append(row(rows[-1], i))
        k = len(rows) - 1
        while k and j:
            if rows[k] >> (j - 1) & 1:
                j -= 1
            else:
                k -= 1
                if rows[k] >> (j - 1) & 1:
                    kept.append(at[block * step + k])
                    j -= 1
    return {*range(first), *kept, *range(len(a) - last, len(a))}


def main_text(page: list[tuple[str, str, bool, bool]], others: list[list]) -> str:
    """The text of a page's lines, given those of its neighbours."""
    keys, votes, told = [x[:2] for x in page], [0] * len(page), 0
    open_lines = [i for i, (_, _, bad, good) in enumerate(page) if not bad and not good]
    marked = any(good and not bad for _, _, bad, good in page)
    size = sum(len(page[i][0]) for i in open_lines)
    for other in others if open_lines else []:
        gone = shared(keys, [x[:2] for x in other])
        if not marked and sum(len(page[i][0]) for i in open_lines if i in gone) > COPY * size:
            continue
        told += 1
        for i in gone:
            votes[i] += 1
    return "\n".join(text for (text, _, bad, good), v in zip(page, votes, strict=True) if not bad and (good or v < min(2, max(1, told))))


def packed(page: list[tuple[str, str, bool, bool]]) -> bytes:
    return zstandard.compress(json.dumps(page, ensure_ascii=False).encode("utf-8", "surrogatepass"))


def unpacked(page: bytes) -> list[tuple[str, str, bool, bool]]:
    return [tuple(x) for x in json.loads(zstandard.decompress(page).decode("utf-8", "surrogatepass"))]


def parser(bounds: list[tuple]):
    """The html column becomes the page's lines, packed: less to shuffle; ``part`` is the page's place among the bounds."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            pages = pa.array([packed(lines(x)) for x in part.column("html").to_pylist()], pa.binary())
            keys = zip(*(part.column(c).to_pylist() for c in ("host", "path", "page_id")), strict=True)
            at = pa.array([bisect_right(bounds, sort_key(*k)) for k in keys], pa.int32())
            yield part.drop_columns(["html"]).append_column("page", pages).append_column("part", at)

    return run


def sort_key(host: str, path: str, page_id: int | None) -> tuple:
    """Orders as Spark does: strings by their bytes, null first."""
    return host.encode("utf-8", "surrogatepass"), path.encode("utf-8", "surrogatepass"), page_id is not None, page_id or 0


FIELDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
WRITTEN = pa.schema([("part", pa.int32()), ("place", pa.int32()), ("edge", pa.bool_()), ("host", pa.string()), ("page", pa.binary()), *FIELDS])
RESULT = "page_id long, url string, text string, n_chars long"


def neighbours(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with their texts, but for the first two and the last two.

    These (``edge``) and the two rows next to them come with their lines, numbered by ``place``.
    """
    at, n = TaskContext.get().partitionId(), 0
    head: list[tuple] = []  # (index, page_id, url, host, page) of the first four
    tail: deque[tuple] = deque(maxlen=2 * AROUND)
    near: deque[tuple] = deque(maxlen=2 * AROUND + 1)  # (page_id, url, host, lines)

    def batch(columns: dict[str, list]) -> pa.RecordBatch:
        size = len(columns["host"])
        return pa.RecordBatch.from_pydict({c: [None] * size for c in WRITTEN.names} | columns | {"part": [at] * size}, schema=WRITTEN)

    for part in parts:
        done: dict[str, list] = {c: [] for c in ("page_id", "url", "host", "text", "n_chars")}
        for page_id, url, host, page in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "host", "page")), strict=True):
            if n < 2 * AROUND:
                head.append((n, page_id, url, host, page))
            tail.append((n, page_id, url, host, page))
            near.append((page_id, url, host, unpacked(page)))
            n += 1
            if len(near) > 2 * AROUND:
                x = near[AROUND]
                text = main_text(x[3], [near[k][3] for k in (AROUND - 1, AROUND + 1, AROUND - 2, AROUND + 2) if near[k][2] == x[2]])
                for c, v in zip(done, (*x[:3], text, len(text)), strict=True):
                    done[c].append(v)
        if done["host"]:
            yield batch(done)
    rows = [*head, *(x for x in tail if x[0] >= 2 * AROUND)]
    if rows:
        index, ids, urls, hosts, pages = (list(c) for c in zip(*rows, strict=True))
        yield batch({"place": list(range(len(rows))), "edge": [k < AROUND or k >= n - AROUND for k in index], "page_id": ids, "url": urls, "host": hosts, "page": pages})


def straddling(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        out: dict[str, list] = {c: [] for c in FIELDS.names}
        for r in part.to_pylist():
            found = [unpacked(x["page"]) for x in sorted(r["others"], key=lambda x: (abs(x["d"]), x["d"])) if x["host"] == r["host"]]
            text = main_text(unpacked(r["page"]), found)
            for c, x in zip(FIELDS.names, (r["page_id"], r["url"], text, len(text)), strict=True):
                out[c].append(x)
        yield pa.RecordBatch.from_pydict(out, schema=FIELDS)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case, and the rest of the URL with numbers padded so that they sort by value."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*(.*)$", 1), r"(\d+)", "00000000000$1")
    return host, F.regexp_replace(path, r"0*(\d{12})(?!\d)", "$1")


def range_bounds(rows: DataFrame, parts: int) -> list[tuple]:
    """At most ``parts`` - 1 bounds for rows(host, path, page_id), from a sample of some BOUNDS * parts of them."""
    order = [F.col("host"), F.col("path"), F.col("page_id")]
    n = rows.count()
    if parts < 2 or not n:
        return []
    drawn = rows.where(thinned(BOUNDS * parts, n, *order)).orderBy(*order).limit(4 * BOUNDS * parts).toArrow()
    keys = [sort_key(*k) for k in zip(*(drawn.column(c).to_pylist() for c in ("host", "path", "page_id")), strict=True)]
    return sorted({keys[k * len(keys) // parts] for k in range(1, parts)}) if keys else []


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages -> page_id, url, text, n_chars."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    host, path = url_parts(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    bounds = range_bounds(rows.select("host", "path", "page_id"), n_parts)
    parsed = rows.mapInArrow(parser(bounds), "page_id long, url string, host string, path string, page binary, part int")
    order = [F.col("host"), F.col("path"), F.col("page_id"), F.md5("page")]
    ordered = parsed.repartitionById(n_parts, "part").sortWithinPartitions(*order).drop("path", "part")
    made = written(ordered.mapInArrow(neighbours, f"part int, place int, edge boolean, host string, page binary, {RESULT}"), "pages")
    counts = sorted((r[0], r[1]) for r in made.where("place IS NOT NULL").groupBy("part").agg(F.count("*")).collect())  # one row a partition
    offsets = list(zip((p for p, _ in counts), accumulate((n for _, n in counts), initial=0), strict=False))
    edges = made.where("place IS NOT NULL").join(F.broadcast(spark.createDataFrame(offsets, "part int, offset long")), "part").withColumn("seq", F.col("offset") + F.col("place"))
    around = [d for d in range(-AROUND, AROUND + 1) if d]
    asked = edges.where("edge").select("seq", F.explode(F.array(*map(F.lit, around))).alias("d")).withColumn("other", F.col("seq") + F.col("d"))
    others = asked.join(edges.select(F.col("seq").alias("other"), "host", "page"), "other").groupBy("seq").agg(F.collect_list(F.struct("d", "host", "page")).alias("others"))
    alone = F.array().cast("array<struct<d:int,host:string,page:binary>>")
    last = edges.where("edge").select("seq", "page_id", "url", "host", "page").join(others, "seq", "left").withColumn("others", F.coalesce("others", alone)).drop("seq")
    return made.where("place IS NULL").select(*FIELDS.names).unionByName(last.mapInArrow(straddling, RESULT))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
