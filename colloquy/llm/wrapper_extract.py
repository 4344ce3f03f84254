"""HTML main-text extraction by wrapper induction.

For each host, the PAGES different pages of the least hashes (the wrapper's documented sample) are parsed, those of one
article text count once, and their trees are aligned one after another by simple tree matching: the heaviest
order-keeping matching of two child lists, where a pair weighs the size of the matching of its subtrees. Nodes that hold
the same text in all of them become template, nodes whose texts vary become content slots. Every page of the host is
then aligned with the wrapper; its text is that of the slots, and of nodes the wrapper doesn't know, within the main
region. Elements, roles and whole class words that say so themselves (menus, headers, footers, sidebars, notices, adverts,
forms, comments) are hints: what they mark is left out, too. A page without any slot is a copy of a sampled one and stays.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, semi_join, without

PAGES = 8
SUPPORT = 3  # different pages that must agree before a text is template
WHOLE = 4_000_000  # cells of a matching's table; longer lists are matched by halves, with the same result
MEMO = 200_000  # sizes of matchings that a worker remembers
OUT = ["text", "n_chars"]

# HTML's own element classes, words that mark boilerplate, and words that say nothing beside them.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
DROPPED = {"nav", "footer", "aside", "form", "button", "select", "input", "dialog", "head", "title", "object", "embed", "canvas", "audio", "video", "menu"} | RAW
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form"}
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie",
    "cookies", "disclaimer", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "pagination", "pager", "popup", "promo", "promotion", "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "signup", "skip",
    "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}

NEUTRAL = {"area", "bar", "block", "body", "bottom", "box", "btn", "button", "col", "container", "content", "form", "global", "group", "head", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "page", "panel", "post", "posts", "primary", "right", "row", "secondary", "section", "site", "text", "title", "top", "wrap", "wrapper"}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.S)


class Node:
    """An element; kids are strings and nodes. digest: of all text below ('' if none); shape: of all elements below, with
    their classes and ids; size: how many they are."""

    __slots__ = ("key", "tag", "kids", "drop", "digest", "shape", "size", "n")

    def __init__(self, tag: str, mark: str = "", drop: bool = False):
        self.tag, self.key, self.drop, self.kids = tag, f"{tag} {mark}", drop, []
        self.digest, self.shape, self.size, self.n = "", 0, 1, 1

    @property
    def nodes(self) -> list:
        return [k for k in self.kids if not isinstance(k, str)]


def marked(word: str) -> bool:
    """A class or id that says boilerplate: one of MARKS, with no more than neutral words beside it (sidebar-left, not share-price)."""
    parts = [w for w in re.split(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])", word) if w and not w.isdigit()]
    return any(w in MARKS for w in parts) and all(w in MARKS or w in NEUTRAL for w in parts)


@lru_cache(maxsize=4096)
def boilerplate(tag: str, attrs: str) -> tuple[str, bool]:
    """The class and id of an element in one string, and whether it is marked as boilerplate."""
    found: dict[str, str] = {}
    for m in ATTR.finditer(attrs):
        found.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or "").lower())  # the first one counts
    mark = " ".join(found[k] for k in ("class", "id") if found.get(k))
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in re.sub(r"\s", "", found.get("style", ""))
    says = tag not in ("html", "body", "main") and any(map(marked, mark.split()))
    return mark, tag in DROPPED or says or hidden or not ROLES.isdisjoint(found.get("role", "").split())


def parse(source: str) -> Node:
    """A tolerant parse: implied ends of paragraphs, items and cells, unknown ends ignored, open elements closed at the end.
    A slash doesn't end an element that isn't void, as in HTML."""
    root = Node("#root")
    stack, made = [root], [root]
    at, n = 0, len(source)
    while at < n:
        m = TOKEN.search(source, at)
        if not m:
            stack[-1].kids.append(entities.unescape(source[at:]))
            break
        if m.start() > at:
            stack[-1].kids.append(entities.unescape(source[at : m.start()]))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        attrs = m[3] or m[6] or ""
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else n
            continue
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in LIMITS[tag]:
                    break
                if stack[k].tag in SIBLINGS[tag]:
                    del stack[k:]
                    break
        node = Node(tag, *boilerplate(tag, attrs))
        stack[-1].kids.append(node)
        made.append(node)
        if tag not in VOID:
            stack.append(node)
    for x in reversed(made):  # kids come after their parents
        own = [k if isinstance(k, str) else k.digest for k in x.kids]
        own = [" ".join(t.split()) for t in own if t and not t.isspace()]
        x.digest = xxhash.xxh3_64_hexdigest("\0".join(own)) if own else ""
        nodes = x.nodes
        x.shape = xxhash.xxh3_64_intdigest(" ".join([x.key, *(f"{k.shape:x}" for k in nodes)]))
        x.size = 1 + sum(k.size for k in nodes)
    return root


_SIZES: dict[tuple[int, int], int] = {}


def tree_match(a: Node, b: Node) -> int:
    """Nodes in the largest matching of two trees that keeps parents and order (simple tree matching)."""
    if a.key != b.key:
        return 0
    if a.shape == b.shape:
        return a.size
    pair = (a.shape, b.shape)
    if pair not in _SIZES:
        found = 1 + sum(tree_match(x, y) for x, y in match(a.nodes, b.nodes, False))
        if len(_SIZES) >= MEMO:
            _SIZES.clear()
        _SIZES[pair] = found
    return _SIZES[pair]


def match(a: list[Node], b: list[Node], texts: bool = True) -> list[tuple[Node, Node]]:
    """The heaviest order-keeping matching of two lists of siblings; a pair weighs the size of its subtrees' matching, and half
    a node more for equal texts (which can't differ where texts don't count)."""
    same = (lambda x, y: x.shape == y.shape and x.digest == y.digest) if texts else (lambda x, y: x.shape == y.shape)
    head, tail, least = 0, 0, min(len(a), len(b))
    while head < least and same(a[head], b[head]):
        head += 1
    while tail < least - head and same(a[-1 - tail], b[-1 - tail]):
        tail += 1
    pairs = [(a[k], b[k]) for k in range(head)] + [(a[len(a) - 1 - k], b[len(b) - 1 - k]) for k in range(tail)]
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return pairs
    if len(a) == len(b) == 1:
        return pairs + [(a[0], b[0])] * (a[0].key == b[0].key)
    first_a, first_b = {x.shape: x for x in a}, {x.shape: x for x in b}
    at_a, at_b = ({s: k for k, s in enumerate(f)} for f in (first_a, first_b))
    sizes = np.array([[tree_match(x, y) for y in first_b.values()] for x in first_a.values()], float)
    ia, ib = np.array([at_a[x.shape] for x in a]), np.array([at_b[x.shape] for x in b])
    seen: dict[str, int] = {}
    da, db = (np.array([seen.setdefault(x.digest, len(seen)) for x in side]) for side in (a, b))

    def weights(i: int, low: int, high: int) -> np.ndarray:
        w = sizes[ia[i], ib[low:high]]
        return w + 0.5 * ((da[i] == db[low:high]) & (w > 0)) if texts else w

    def step(row: np.ndarray, w: np.ndarray) -> np.ndarray:
        """From the best sums of a[i + 1:] with b[j:], for each j, to those of a[i:]."""
        out = np.maximum(row, 0)
        np.maximum(row[:-1], row[1:] + w, out=out[:-1])
        return np.maximum.accumulate(out[::-1])[::-1]

    def solve(i0: int, i1: int, j0: int, j1: int) -> list[tuple[int, int]]:
        if i0 == i1 or j0 == j1:
            return []
        if i1 - i0 == 1 or (i1 - i0) * (j1 - j0) <= WHOLE:
            w = [weights(i, j0, j1) for i in range(i0, i1)]
            best = [np.zeros(j1 - j0 + 1)]
            for own in reversed(w):
                best.append(step(best[-1], own))
            best.reverse()
            out, i, j = [], 0, 0
            while i < i1 - i0 and j < j1 - j0:
                if w[i][j] > 0 and best[i][j] == best[i + 1][j + 1] + w[i][j]:
                    out.append((i0 + i, j0 + j))
                    i, j = i + 1, j + 1
                elif best[i][j] == best[i + 1][j]:
                    i += 1
                else:
                    j += 1
            return out
        mid, after = (i0 + i1) // 2, np.zeros(j1 - j0 + 1)
        for i in range(i1 - 1, mid - 1, -1):
            after = step(after, weights(i, j0, j1))
        before = np.zeros(j1 - j0 + 1)  # of a[i0:i] with b[j0:j], by the same step on reversed lists
        for i in range(i0, mid):
            before = step(before, weights(i, j0, j1)[::-1])
        cut = j0 + int((before[::-1] + after).argmax())
        return solve(i0, mid, j0, cut) + solve(mid, i1, cut, j1)

    return pairs + [(a[i], b[j]) for i, j in solve(0, len(a), 0, len(b))]


def merge(w: Node, page: Node) -> None:
    """Align a page with the wrapper: n counts the pages that have a node, and a digest that varies becomes None."""
    todo = [(w, page)]
    while todo:
        a, b = todo.pop()
        a.n += 1
        if a.digest != b.digest:
            a.digest = None
        todo += match(a.nodes, b.nodes)


def induce(pages: list[str]) -> str | None:
    """The wrapper of a host's pages as JSON: a row for each node, with its parent's place. None if too few articles differ."""
    trees = {}
    for p in sorted(set(pages)):
        tree = parse(p)
        trees.setdefault(" ".join(b for x in regions(tree) for b in blocks(x, set(), x.tag in ("article", "main"))), tree)
    if len(trees) < SUPPORT:
        return None
    w, *rest = trees.values()
    for t in rest:
        merge(w, t)
    rows, todo = [], [(w, -1)]
    while todo:
        x, parent = todo.pop()
        rows.append([parent, x.key, x.digest, x.shape, x.size, x.n])
        todo += [(k, len(rows) - 1) for k in reversed(x.nodes)]
    return json.dumps({"pages": len(trees), "nodes": rows}, separators=(",", ":"))


@lru_cache(maxsize=256)
def loaded(text: str) -> tuple[int, Node]:
    found, nodes = json.loads(text), []
    for parent, key, digest, shape, size, n in found["nodes"]:
        x = Node(*key.split(" ", 1))
        x.digest, x.shape, x.size, x.n = digest, shape, size, n
        nodes.append(x)
        if parent >= 0:
            nodes[parent].kids.append(x)
    return found["pages"], nodes[0]


def template_nodes(w: str, page: Node) -> set[int]:
    """ids of the page's nodes whose whole text is template."""
    pages, root = loaded(w)
    out: set[int] = set()
    todo = [(root, page)]
    while todo:
        for c, y in match(*(x.nodes for x in todo.pop())):
            if c.digest and c.n >= SUPPORT and c.n == pages and c.digest == y.digest:
                out.add(id(y))
            else:
                todo.append((c, y))
    return out


def regions(root: Node) -> list[Node]:
    """The outermost article or main elements outside boilerplate; else the body; else all."""
    found, todo, body = [], [root], None
    while todo:
        x = todo.pop()
        if x.tag == "body" and body is None:
            body = x
        if x.tag in ("article", "main"):
            found.append(x)
        else:
            todo += [k for k in reversed(x.nodes) if not k.drop]
    mains = [x for x in found if x.tag == "main"]
    inner = [y for x in mains for y in _articles(x)]
    picked = [x for x in found if x.tag == "article"] + (inner or mains)
    return [x for x in found + inner if x in picked] or [body or root]


def _articles(node: Node) -> list[Node]:
    out, todo = [], list(reversed(node.nodes))
    while todo:
        x = todo.pop()
        if not x.drop:
            if x.tag == "article":
                out.append(x)
            else:
                todo += reversed(x.nodes)
    return out


def blocks(node: Node, skip: set[int], in_article: bool) -> list[str]:
    out, run = [], []

    def flush():
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    todo: list = list(reversed(node.kids))  # None ends a block
    while todo:
        k = todo.pop()
        if k is None:
            flush()
        elif isinstance(k, str):
            run.append(k)
        elif k.drop or id(k) in skip or (k.tag == "header" and not in_article):
            flush()
        elif k.tag in INLINE:
            todo += reversed(k.kids)
        else:
            flush()
            todo.append(None)
            todo += reversed(k.kids)
    flush()
    return out


def main_text(source: str, w: str | None) -> str:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))  # tree_match() goes as deep as the page
    root = parse(source)
    found = regions(root)
    inside = found[0].tag in ("article", "main")
    every = " ".join(b for x in found for b in blocks(x, set(), inside))
    if not w or not every:
        return every
    skip = template_nodes(w, root)
    return " ".join(b for x in found for b in ([] if id(x) in skip else blocks(x, skip, inside))) or every


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages with text, the main text ('' if none), and n_chars, its length.

    Null html counts as empty; null urls and urls without a host are one host, whose pages get no wrapper. Repeated
    rows are kept. Input columns named like an output are replaced; an empty table gives an empty table.
    """
    rows = without(pages, [*OUT, "_host", "_w"])
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    source = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = rows.withColumn("_host", host)
    keyed = rows.filter("_host <> ''").select(F.col("_host").alias("host"), F.xxhash64(source).alias("h"), source.alias("page"))
    least = F.row_number().over(Window.partitionBy("host").orderBy("h"))  # tasks send PAGES keys a host at most
    chosen = materialize(keyed.select("host", "h").distinct().withColumn("k", least).filter(F.col("k") <= PAGES).select("host", "h"), "chosen")
    sample = semi_join(keyed, chosen, ["host", "h"]).groupBy("host", "h").agg(F.first("page").alias("page"))

    def induced(pdf: pd.DataFrame) -> pd.DataFrame:  # PAGES rows at most
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))
        return pd.DataFrame({"_host": pdf["host"][:1], "_w": [induce(list(pdf["page"])) if len(pdf) >= SUPPORT else None]})

    wrappers = materialize(sample.groupBy("host").applyInPandas(induced, "_host string, _w string"), "wrappers")

    @F.pandas_udf("string")
    def text(pages: pd.Series, wrappers: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, w) for p, w in zip(pages, wrappers)], dtype=object)

    out = rows.join(wrappers, "_host", "left").withColumn("text", text(source, F.col("_w")))
    return out.withColumn("n_chars", F.length("text").cast("long")).drop("_host", "_w")
