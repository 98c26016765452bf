"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node is a path of tags with their classes, so pages made from one
template share nodes. Every node that holds text counts, inside articles too. Its content entropy is that of its text
over the host's different pages, its presentation entropy that of its sequences of child tags, both in units of the
largest entropy that many pages can have; presentation adds to content, the more the more children a node has. A
single block has the content 1 - log(pages that hold it there) / log(pages of the node).

Nodes and blocks of low importance are removed, inside articles below a lower bound. What a class or name means
(footer, advert, comment ...) and whether an article holds a node are priors: a name gives way to a large share of
the text times importance, and never removes html, body, main, article or what holds one of them; blocks outside the
articles stay where they are important, or, where the host has too few pages to tell, where they are as long.

The tree is counted in aggregations that combine before they shuffle, and goes to the pages of its host as one row.
Parsing follows the browsers' rules for raw text, void elements, implied ends and character references.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterable, Iterator, Mapping, Set

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldnote.llm.store import stored

MIN_PAGES = 5
"""Different pages of a host that must hold a node before its entropy decides."""
MIN_IMPORTANCE = 0.35
MIN_IMPORTANCE_INSIDE = 0.15
"""The same for nodes and blocks that an article holds."""
KEEP_IMPORTANCE = 0.7
"""From here a node outside the articles of a page is main text too."""
CONTENT_WEIGHT = 0.9
"""Weight of content against presentation, to the power of a node's number of children."""
NAMED_SHARE = 0.8
"""Share of the text, times importance, from which a node stays although a name marks it as no content."""

# What tags and names stand for.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
NO_CONTENT = {"nav", "footer", "aside", "head", "svg", "canvas", "object", "button", "select", "dialog", "menu", "audio", "video", "map"} | RAW
BY_WEIGHT = {"form"}
"""Tags that are weighed like names: a form may wrap a whole page."""
CORE = {"article", "main"}
STATES = {"has", "no", "with", "without", "is", "not"}
"""First parts of names that say how an element looks, not what it is."""
CLOSES_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul",
}
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs",
    "footer", "sidebar", "aside", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription",
    "signup", "login", "form", "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "social", "share", "sharing", "related", "recommended", "pagination", "pager", "widget",
    "toolbar", "contentinfo", "complementary", "search", "masthead", "topbar",
}
ONLY_OUTSIDE = {"header"}
"""Names and tags that are no content unless an article holds them."""

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
_END: dict[str, re.Pattern[str]] = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}


class Page:
    """The elements of a page in order, parents first, and its text blocks."""

    __slots__ = ("parent", "path", "tag", "words", "inside", "holds", "kids", "blocks", "scope")

    def __init__(self) -> None:
        self.parent, self.path, self.tag, self.words, self.inside, self.holds, self.kids, self.scope = [-1], [""], [""], [frozenset()], [False], [False], [[]], [0]
        self.blocks: list[tuple[int, list[tuple[int, str]]]] = []

    def add(self, parent: int, tag: str, kind: str, words: frozenset[str]) -> int:
        i, core = len(self.tag), tag in CORE
        self.parent.append(parent)
        self.path.append(f"{self.path[parent]}/{tag}{kind}")
        self.tag.append(tag)
        self.words.append(words)
        self.inside.append(self.inside[parent] or core)
        self.holds.append(core)
        self.kids.append([])
        self.scope.append(i if core and not self.inside[parent] else self.scope[parent])
        self.kids[parent].append(tag)
        while core and parent > 0 and not self.holds[parent]:
            self.holds[parent], parent = True, self.parent[parent]
        return i


class Block:
    """A text block: its node, its text, and whether an article holds it."""

    __slots__ = ("path", "text", "inside")

    def __init__(self, path: str, text: str, inside: bool) -> None:
        self.path, self.text, self.inside = path, text, inside


def _looks(tag: str, raw: str) -> tuple[str, bool, frozenset[str]]:
    """(class part of the path, never content, words of tag and names that speak against content)."""
    said = {tag} & (BY_WEIGHT | ONLY_OUTSIDE)
    if not raw.strip(" \t\r\n/"):
        return "", tag in NO_CONTENT, frozenset(said)
    hidden, kind = False, ""
    for m in _ATTRIBUTE.finditer(raw):
        key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if key in ("class", "id", "role"):
            for name in html_lib.unescape(value).split():
                parts = [x.lower() for x in _PART.findall(name)]
                if not parts or parts[0] not in STATES:
                    said |= (NAMES | ONLY_OUTSIDE).intersection(parts)
            if key == "class":
                kind = "." + ".".join(sorted(value.split()))
        elif key == "hidden" or key == "style" and "display:none" in value.replace(" ", "").lower():
            hidden = True
    return kind, tag in NO_CONTENT or hidden and tag not in CORE and tag not in ("html", "body"), frozenset(said)


def parsed(page: str) -> Page:
    """A page's elements and blocks, without what is never content (scripts, heads, navigation, hidden elements)."""
    out = Page()
    # open elements: tag, node, never content
    stack: list[tuple[str, int, bool]] = [("", 0, False)]
    held: list[tuple[int, str]] = []
    at = 0

    def flush() -> None:
        if held:
            if any(x.strip() for _, x in held):
                out.blocks.append((next(x[1] for x in reversed(stack) if x[0] not in INLINE), held.copy()))
            held.clear()

    def close(i: int) -> None:
        del stack[i:]

    def hold(text: str) -> None:
        if not stack[-1][2]:
            held.append((stack[-1][1], text))

    while True:
        m = _TAG.search(page, at)
        if m is None:
            if at < len(page):
                hold(page[at:])
            break
        if m.start() > at:
            hold(page[at : m.start()])
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            if tag == "br":
                hold(" ")
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    if tag not in INLINE:
                        flush()
                    close(i)
                    break
            else:
                if tag not in INLINE:
                    flush()
            continue
        if tag == "br":
            hold(" ")
            continue
        if tag in RAW:
            end = _END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag not in INLINE:
            flush()
            closes = {"p"} if tag in CLOSES_P else set()
            if tag in ("li", "option"):
                closes |= {tag, "p"}
            elif tag in ("dt", "dd"):
                closes |= {"dt", "dd", "p"}
            elif tag in ("tr", "td", "th", "tbody", "thead", "tfoot"):
                closes |= {"p"} | ({"td", "th"} if tag in ("td", "th") else {"td", "th", "tr"} if tag == "tr" else {"td", "th", "tr", "tbody", "thead", "tfoot"})
            elif tag == "body":
                closes |= {"head"}
            while closes:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in closes:
                        close(i)
                        break
                    if stack[i][0] not in INLINE and stack[i][0] not in ("dt", "dd", "p", "td", "th", "tr"):
                        i = 0
                        break
                else:
                    i = 0
                if not i:
                    break
        kind, gone, words = _looks(tag, m.group(3) or "")
        if tag in VOID or (m.group(3) or "").rstrip().endswith("/") and tag not in INLINE and tag not in CLOSES_P:
            continue
        _, node, above = stack[-1]
        gone = above or gone
        if gone:
            stack.append((tag, node, True))
        elif tag in INLINE and not kind and not words:
            out.kids[node].append(tag)
            stack.append((tag, node, False))
        else:
            stack.append((tag, out.add(node, tag, kind, words), False))
    flush()
    return out


def _text(held: Iterable[tuple[int, str]]) -> str:
    return " ".join(html_lib.unescape("".join(x for _, x in held)).split())


def _named(p: Page, importance: Mapping[int, float]) -> list[bool]:
    """Per element whether its names or those of an element above it remove it.

    Names are weighed against the share of the text that elements of that path have of their article, or else of the
    page, times their importance (1 where the host has too few pages to tell).
    """
    n = len(p.tag)
    size = [0] * n
    for _, held in p.blocks:
        for v, x in held:
            size[v] += len(x.strip())
    for v in range(n - 1, 0, -1):
        size[p.parent[v]] += size[v]
    core = sum(size[v] for v in range(1, n) if p.tag[v] in CORE and not p.inside[p.parent[v]])
    alike: dict[tuple[str, int], int] = {}
    outer: dict[tuple[str, int], int] = {}
    for v in range(1, n):
        if p.words[v]:
            key = (p.path[v], p.scope[v])
            # an element inside another one of its path is counted already
            if outer.get(key, -1) < 0 or not _below(p, v, outer[key]):
                alike[key] = alike.get(key, 0) + size[v]
                outer[key] = v
    gone, excused = [False] * n, [frozenset()] * n
    for v in range(1, n):
        above = p.parent[v]
        gone[v], excused[v] = gone[above], excused[above]
        words = p.words[v] - excused[v] - (ONLY_OUTSIDE if p.inside[v] else frozenset())
        if gone[v] or not words:
            continue
        if not (p.tag[v] in ("html", "body") or p.holds[v]):
            share = alike[p.path[v], p.scope[v]] / max(1, size[p.scope[v]])
            weight = share * importance.get(_hash(p.path[v]), 1.0)
            gone[v] = weight < NAMED_SHARE or core > 0 and not p.inside[v]
        excused[v] |= words
    return gone


def _below(p: Page, v: int, top: int) -> bool:
    while v > top:
        v = p.parent[v]
    return v == top


def _kept(page: str, importance: Mapping[int, float], repeated: Set[tuple[int, int]]) -> list[tuple[Block, float | None]]:
    """The blocks that names and tree leave, in order, with the importance of their node (None where unknown)."""
    p, out = parsed(page), []
    if not p.blocks:
        return out
    gone = _named(p, importance)
    for v, held in p.blocks:
        text = _text(x for x in held if not gone[x[0]])
        if gone[v] or not text:
            continue
        key, inside = _hash(p.path[v]), p.inside[v]
        worth = importance.get(key)
        if importance:
            if worth is not None and worth < (MIN_IMPORTANCE_INSIDE if inside else MIN_IMPORTANCE):
                continue
            whole = _hash(_text(held))
            if (key, whole, True) in repeated or not inside and (key, whole, False) in repeated:
                continue
        out.append((Block(p.path[v], text, inside), worth))
    return out


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, without what its own tags and names mark as no content."""
    return [b for b, _ in _kept(page, {}, frozenset())]


def main_text(page: str, importance: Mapping[int, float], repeated: Set[tuple]) -> str:
    """Blocks of articles, and those outside that are important or, where the tree cannot tell, at least as long."""
    kept = _kept(page, importance, repeated)
    inside = sum(len(b.text) for b, _ in kept if b.inside)
    outside = sum(len(b.text) for b, _ in kept) - inside
    return "\n".join(b.text for b, worth in kept if b.inside or outside >= inside or worth is not None and worth >= KEEP_IMPORTANCE)


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - 2**63


def _nodes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, node, kind, value, kids) as hashes: per node of a page all its text (0), its child tags (1), each of its own blocks (2)."""
    for b in it:
        for at in range(0, len(b), 500):
            own = b.slice(at, 500)
            rows: list[tuple] = []
            for host, page in zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True):
                if host is None:
                    continue
                p = parsed(page)
                said: dict[str, list[str]] = {}
                built: dict[str, list[str]] = {}
                blocks_of: set[tuple[str, str]] = set()
                for v, held in p.blocks:
                    text = _text(held)
                    blocks_of.add((p.path[v], text))
                    while v >= 0:
                        said.setdefault(p.path[v], []).append(text)
                        v = p.parent[v]
                for v in range(len(p.tag)):
                    if p.path[v] in said:
                        built.setdefault(p.path[v], []).append(" ".join(p.kids[v]))
                mark, key = _hash(page) if said else 0, {k: _hash(k) for k in said}
                rows += [(host, mark, key[k], 0, _hash("\n".join(v)), 0) for k, v in said.items()]
                rows += [(host, mark, key[k], 1, _hash("\n".join(v)), sum(len(x.split()) for x in v) // len(v)) for k, v in built.items()]
                rows += [(host, mark, key[k], 2, _hash(t), 0) for k, t in blocks_of]
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["host", "page", "node", "kind", "value", "kids"])


def _main(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, importance, repeated = None, {}, frozenset()
    for b in it:
        for at in range(0, len(b), 500):
            own = b.slice(at, 500)
            texts = []
            for i, (host, page) in enumerate(zip(own.column(2).to_pylist(), own.column(3).to_pylist(), strict=True)):
                if host is None:
                    texts.append(main_text(page, {}, frozenset()))
                    continue
                if host != last:
                    last = host
                    importance = {x["node"]: x["importance"] for x in own.column(4)[i].as_py() or []}
                    repeated = {(x["node"], x["value"], x["inside"]) for x in own.column(5)[i].as_py() or []}
                texts.append(main_text(page, importance, repeated))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])


def site_trees(pages: DataFrame) -> DataFrame:
    """(host, nodes, repeated): importance of its nodes on enough pages, and the blocks that its pages repeat; ``pages`` has host and html."""
    said = pages.select("host", "html").mapInArrow(_nodes, "host string, page long, node long, kind int, value long, kids int").distinct()
    counts = stored(said.groupBy("host", "node", "kind", "value").agg(F.count("*").alias("n"), F.max("kids").alias("kids")), "counts")

    def entropy(kind: int):
        n = F.when(F.col("kind") == kind, F.col("n"))
        return F.coalesce((F.log2(F.sum(n)) - F.sum(n * F.log2("n")) / F.sum(n)) / F.log2(F.sum(n)), F.lit(0.0))

    built = F.when(F.col("kind") == 1, F.col("n"))
    nodes = counts.filter("kind < 2").groupBy("host", "node").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("pages"), entropy(0).alias("content"), entropy(1).alias("presentation"), (F.sum(built * F.col("kids")) / F.sum(built)).alias("kids")
    )
    nodes = nodes.filter(F.col("pages") >= MIN_PAGES)
    built = (1 - F.pow(F.lit(CONTENT_WEIGHT), F.coalesce("kids", F.lit(0.0)))) * F.col("presentation")
    worth = lambda content: content + (1 - content) * F.col("built")
    nodes = stored(nodes.withColumn("built", built).select("host", "node", "pages", "built", worth(F.col("content")).alias("importance")), "nodes")
    worth = worth(1 - F.log2("n") / F.log2("pages"))
    often = counts.filter("kind = 2 and n > 1").join(nodes, ["host", "node"]).filter(worth < MIN_IMPORTANCE)
    often = often.groupBy("host").agg(F.collect_list(F.struct("node", "value", (worth < MIN_IMPORTANCE_INSIDE).alias("inside"))).alias("repeated"))
    return nodes.groupBy("host").agg(F.collect_list(F.struct("node", "importance")).alias("nodes")).join(often, "host", "left")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, ``text``, ``n_chars``.

    Blocks are joined by one line feed; white space inside a block is one space. Null or empty pages, and pages
    without main text, have an empty text. A null url has no host: names and articles alone decide. Repeated pages
    of a host count once in its tree.
    """
    d = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    d = d.withColumn("host", F.lower(F.nullif(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit(""))))
    trees = stored(site_trees(d), "trees")
    out = d.join(trees, "host", "left").select("id", "url", "host", "html", "nodes", "repeated").mapInArrow(_main, f"id {d.schema['id'].dataType.simpleString()}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
