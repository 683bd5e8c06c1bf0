"""Main text of web pages by wrapper induction over pages of the same host.

A page becomes a tree of its block elements; inline elements only add to the text of the block
they are in, and an element whose end tag is missing ends with its parent. Every host has one
reference page (the smallest by hash of all its pages), and each page is aligned with it by simple
tree matching. For every node of the reference, and for every path of labels from the root, it is
counted how many different pages of the host have it, and how many of these have it with each
text. Pages are different if their texts are; equal ones are reduced to one over the whole table.
All counts are summed by Spark, so no task holds the pages of a host together and the result does
not depend on how rows are divided. A text of a node is template if at least ``LEAST_PAGES``
different pages have the node and ``CONSTANT`` of them have it with that text; the other nodes
are slots for content.

What varies from page to page may still be a menu, an advert or a footer. Slots are dropped if
they are inside an element that says so by its name, class, id or role. If the page marks its
article (``article`` or ``main``), only slots inside it count.

Defined results: a null or empty html has empty text; character references are decoded, white
space inside a block becomes one space, and blocks are joined by one space; null and strange
urls share the empty host; repeated pages count once and are each extracted; elements may be
nested to any depth.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.llm import words
from cartloom.llm.urls import host_of
from cartloom.session import materialize

LEAST_PAGES = 4
CONSTANT = 0.9
_REFERENCES = 64
_BLOCK = 1 << 20

# Element names of HTML by role, and words that mark parts of a page.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
SILENT = frozenset(
    "audio button canvas datalist embed head iframe map math noscript object script select style svg template textarea "
    "title video".split()
)
IN_HEAD = frozenset("base link meta noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = frozenset("aside dialog footer form menu nav".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary consent contentinfo "
    "cookie cookies disqus footer gdpr menu modal nav navbar navigation newsletter notice notices popup promo promotion "
    "related replies search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
ENDS = {  # an open element that a new one ends
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"},
}
SCOPES = frozenset("article body div html main section table ul ol dl aside nav header footer form".split())


class Node:
    """A block element: its label, its children and pieces of text in page order."""

    __slots__ = ("chrome", "children", "inside", "label", "path", "pieces", "tag", "text")

    def __init__(self, tag: str, label: str, parent: Node | None, chrome: bool) -> None:
        self.tag, self.label, self.children = tag, label, []
        self.path = xxhash.xxh64_intdigest(f"{parent.path if parent else 0}/{label}") >> 1
        self.chrome = chrome or bool(parent and parent.chrome)
        self.inside = tag in ("article", "main") or bool(parent and parent.inside)
        self.pieces: list[str] = []
        self.text = ""
        if parent:
            parent.children.append(self)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", "html", None, False)
        self.open, self.silent, self.runs = [self.root], [], []
        self.current: list[str] = []

    def _flush(self) -> None:
        text = " ".join("".join(self.current).split())
        self.current = []
        if text:
            self.runs.append((self.open[-1], text))
            self.open[-1].pieces.append(text)

    def handle_starttag(self, tag, attrs):
        if self.silent == ["head"] and tag not in IN_HEAD:
            self.silent = []  # the head has no end tag
        if self.silent:
            if tag not in VOID:
                self.silent.append(tag)
            return
        if tag in SILENT:
            if tag not in VOID:
                self.silent.append(tag)
            return
        if tag not in BLOCKS:
            if tag == "br":
                self.current.append(" ")
            return
        if tag in ("html", "body") and any(n.tag == tag for n in self.open):
            return
        self._flush()
        if tag == "hr":
            return
        ended = ENDS.get(tag, set())
        while len(self.open) > 1 and (self.open[-1].tag in ended or self.open[-1].tag == "p"):
            self.open.pop()
        named = {k: (v or "").lower() for k, v in attrs if k in ("class", "id", "role")}
        tokens = {t for v in named.values() for t in re.split(r"[^a-z0-9]+", v)}
        marked = tag not in ("html", "body", "main") and bool(tokens & MARKS)
        outside = tag == "header" and not self.open[-1].inside
        self.open.append(Node(tag, f"{tag}.{named.get('class', '')}", self.open[-1], marked or outside or tag in CHROME))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or tag not in SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.silent:
            if tag in self.silent:
                while self.silent.pop() != tag:
                    pass
                return
            if tag not in BLOCKS or all(n.tag != tag for n in self.open):
                return
            self.silent = []  # what was to be left out ends with the block around it
        if tag not in BLOCKS:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                self._flush()
                del self.open[k:]
                return
            if self.open[k].tag in SCOPES and tag not in SCOPES:
                return
        self._flush()

    def handle_data(self, data):
        if not self.silent:
            self.current.append(data)


def parsed(html: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of a page, and its runs of text with the node of each, in page order."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    tree.silent = []
    tree._flush()
    stack = [tree.root]
    while stack:
        node = stack.pop()
        node.text = " ".join(node.pieces)
        stack += node.children
    return tree.root, tree.runs


def _matching(a: Node, b: Node):
    """Steps of :func:`_match`: yields the pairs of nodes whose matching it needs next."""
    if a.label != b.label:
        return 0, None
    n, m = len(a.children), len(b.children)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    inner: dict[tuple[int, int], tuple[int, tuple]] = {}
    for i, x in enumerate(a.children):
        row, above = best[i + 1], best[i]
        for j, y in enumerate(b.children):
            size = 0
            if x.label == y.label:
                if x.children and y.children:
                    inner[i, j] = yield x, y
                    size = inner[i, j][0]
                else:
                    size = 1
            row[j + 1] = max(row[j], above[j + 1], above[j] + size)
    below, i, j = [], n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            below.append(inner[i, j][1] if (i, j) in inner else (a.children[i], b.children[j], []))
    return 1 + best[n][m], (a, b, below)


def _match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Size and pairs of the largest common top-down matching of two trees that keeps order.

    Works with a stack of its own, so trees may be of any depth.
    """
    stack, value = [_matching(a, b)], None
    while stack:
        try:
            needed = stack[-1].send(value)
            stack.append(_matching(*needed))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    pairs, left = [], [value[1]] if value[1] else []
    while left:
        x, y, below = left.pop()
        pairs.append((x, y))
        left += below
    return value[0], pairs


def _text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def _numbered(root: Node) -> dict[int, int]:
    """A key for each node of a reference tree, by ``id`` of the node."""
    out, stack = {}, [root]
    while stack:
        node = stack.pop()
        out[id(node)] = xxhash.xxh64_intdigest(f"{len(out)}#{node.path}") >> 1
        stack += node.children
    return out


def page_keys(root: Node, reference: Node | None, numbers: dict[int, int]) -> list[tuple[int, int, int]]:
    """Distinct (key, path, text) of a page's nodes with text: under their path and under their place in the reference."""
    found, stack = set(), [root]
    while stack:
        node = stack.pop()
        if node.text:
            found.add((node.path, node.path, _text_hash(node.text)))
        stack += node.children
    if reference is not None:
        for known, own in _match(reference, root)[1]:
            if own.text:
                found.add((numbers[id(known)], own.path, _text_hash(own.text)))
    return sorted(found)


def _induce(batches):
    """(host, page, nodes) of every page with text; ``page`` is the hash of its texts."""
    references: dict[str, tuple[str, Node, dict[int, int]]] = {}
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("key", "path", "text")]))
    for batch in batches:
        pages = batch.column(1)
        for first, last in words.blocks(pages, _BLOCK):
            rows = []
            part = [batch.column(k).slice(first, last - first).to_pylist() for k in range(3)]
            for host, html, model in zip(*part, strict=True):
                root, runs = parsed(html or "")
                if not runs:
                    continue
                if model is not None and (host not in references or references[host][0] != model):
                    while len(references) >= _REFERENCES:
                        references.pop(next(iter(references)))
                    tree = parsed(model)[0]
                    references[host] = (model, tree, _numbered(tree))
                _, tree, numbers = references[host] if model is not None else (None, None, {})
                nodes = [dict(zip(("key", "path", "text"), x, strict=True)) for x in page_keys(root, tree, numbers)]
                rows.append((host, xxhash.xxh64_intdigest("\0".join(t for _, t in runs)) >> 1, nodes))
            if rows:
                hosts, hashes, nodes = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(nodes, kind)], ["host", "page", "nodes"]
                )


def templates(pages: DataFrame) -> DataFrame:
    """(template_host, constants): the nodes, as path and text, that are template on a host."""
    rows = pages.select(host_of(F.col("url")).alias("host"), "html")
    chosen = rows.where(F.length("html") > 0).groupBy(F.col("host").alias("reference_host")).agg(
        F.min(F.struct(F.xxhash64("html").alias("hash"), "html")).alias("least")
    )
    chosen = materialize(chosen.select("reference_host", F.col("least.html").alias("reference")), "html-references")
    seen = rows.join(chosen, F.col("host") == F.col("reference_host"), "left").select("host", "html", "reference").mapInArrow(
        _induce, "host string, page long, nodes array<struct<key: long, path: long, text: long>>"
    )
    # equal pages of the whole table count once
    different = materialize(seen.groupBy("host", "page").agg(F.min("nodes").alias("nodes")), "html-pages")
    # what follows from the two limits below is cut first, so texts of few pages are neither written nor joined
    node = materialize(different.select("host", F.explode("nodes").alias("x")).select("host", "x.*")
                       .groupBy("host", "key", "path", "text").agg(F.count("*").alias("times"))
                       .where(F.col("times") >= CONSTANT * LEAST_PAGES), "html-nodes")
    # a page has one text at a place of the reference and may have several on a path, so pages are counted beside
    by_node = different.select("host", F.explode(F.array_distinct("nodes.key")).alias("key")).groupBy("host", "key").agg(
        F.count("*").alias("n")
    ).where(F.col("n") >= LEAST_PAGES)
    constant = node.join(by_node, ["host", "key"]).where(F.col("times") >= CONSTANT * F.col("n"))
    return constant.groupBy(F.col("host").alias("template_host")).agg(
        F.collect_set(F.struct("path", "text")).alias("constants")
    )


def main_text(html: str | None, constants: set[tuple[int, int]] = frozenset()) -> str:
    """Text of the content slots of one page."""
    if not html:
        return ""
    _, runs = parsed(html)
    left = [
        (node, text) for node, text in runs
        if not node.chrome and not (constants and (node.path, xxhash.xxh64_intdigest(node.text) >> 1) in constants)
    ]
    marked = [text for node, text in left if node.inside]
    return " ".join(marked or [text for _, text in left])


def extracted(pages: DataFrame) -> DataFrame:
    """Columns ``row`` (all of ``pages``) and ``text``, the main text of each page."""
    found = materialize(templates(pages.select("url", "html")), "html-templates")

    @F.arrow_udf("string")
    def text_of(htmls: pa.Array, constants: pa.Array) -> pa.Array:
        out = []
        for html, known in zip(htmls.to_pylist(), constants.to_pylist(), strict=True):
            out.append(main_text(html, {(x["path"], x["text"]) for x in known} if known else frozenset()))
        return pa.array(out, pa.string())

    rows = pages.select(F.struct(*pages.columns).alias("row"), host_of(F.col("url")).alias("page_host"))
    joined = rows.join(found, F.col("page_host") == F.col("template_host"), "left")
    return joined.select("row", text_of(F.col("row.html"), F.col("constants")).alias("text"))
