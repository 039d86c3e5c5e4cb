"""Main text of web pages by site style trees.

Pages of one host share a template. Their DOMs are merged into the host's style tree: a node is a
path of element signatures (tag and class words, without numbers; ids are no part of it, so a
host has as many nodes as its templates have). For each node Spark gathers, over all pages of
the host and all of its text blocks, also those inside of ``article``,

* how its contents are spread: a content found on n of m pages has importance 1 - log(n) to the
  base m; a node's is the mean over its text;
* how its presentation varies: the entropy (to the base m) of its numbers of blocks per page;
* which share of its text is link text, lies in ``article`` or ``main``, or lies in an element
  whose class names a role that is no main text.

Importance is ``GAMMA`` of the first plus the rest of the second, shifted by what else is known of
the node: link text counts against nodes outside of articles; a node outside of articles counts
the less, the more of the host's text lies in articles (``OUTSIDE``: if all of its contents are a page's own and their
number varies it can stay); a role's name takes ``STRONG`` of it, or ``WEAK`` in an article for a word of many meanings.
So an entropy high enough keeps what such a word names in an article, and a low one removes a node of the
article. A host's threshold is learned: the middle of the widest gap between the importances of its nodes, within
``LOWEST`` and ``HIGHEST``. Branches below it are removed from every page of the host (after Yi, Liu and Li,
"Eliminating Noisy Information in Web Pages", KDD 2003). All logs are to the base m + ``SMOOTHING``: the fewer pages
a host has, the less they prove.

A node on one page only has the highest content importance and no spread of shapes, so the page can judge it by itself; only nodes
that pages share are sent to them, and a site that makes up a class for each page sends none of those.

Pages of a host that have their longest block in common are copies and count once. A role's name
says nothing if its element holds an article or nearly all of the page (``WHOLE``).

Without the tree go only element kinds that are never main text: menus (``nav``), headers outside
of articles, footers, sidebars (``aside``), scripts, styles, controls, and what is hidden.

Defined cases: a null page is empty; a page without text gives an empty text; pages without a
host form one site of their own each; unfinished tags at the end are markup; rows repeated count
once in the tree; an empty table gives an empty table; further columns are carried in ``key``. A page is never
cut, and its work is linear in its length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, pieces, written

GAMMA, SMOOTHING = 0.9, 4
#: Between which a host's threshold is looked for; the middle holds where nothing is known.
LOWEST, HIGHEST = 0.15, 0.35
LOW = (LOWEST + HIGHEST) / 2
#: What the name of a role takes from a node's importance, and how much of a page lies outside of articles at most takes.
STRONG, WEAK, OUTSIDE = 0.8, 0.5, 0.74
#: The share of a page from which on its element's name says nothing.
WHOLE = 0.9
PIECE_BYTES = 8 << 20

# Fixed values of HTML: elements by kind.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li",
    "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CLOSES_PARAGRAPH = BLOCK - {"br", "body", "html", "head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "legend"}
#: Elements that a start tag closes, by group: which tags belong to it, which ask for it, and where the search ends.
GROUPS = {
    "p": ({"p"}, CLOSES_PARAGRAPH, {"table", "button", "td", "th", "caption", "div", "article", "section", "li"}),
    "li": ({"li"}, {"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"tr"}, {"table"}),
    "td": ({"td", "th"}, {"td", "th", "tr"}, {"table"}),
    "option": ({"option"}, {"option"}, {"select"}),
}
# Elements, and values of the attribute role, that are never main text.
GONE = {"head", "nav", "footer", "aside", "script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "button", "select", "textarea", "dialog", "menu", "title", "datalist", "audio", "video", "map"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
# Class words that name a role which is no main text, and words that may stand beside them in a name.
ROLE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar sidenav footer "
    "masthead topbar toolbar cookie cookies consent gdpr notice notices popup modal overlay subscribe subscription newsletter signup login share sharing social related recommended "
    "comment comments commentlist disqus replies discussion opinions thread widget widgets pagination pager header siteheader pageheader".split()
)
#: Those of them that name a part of an article as well.
WEAK_WORDS = set("banner comment header notice notices promo promotion recommended related share sharing social widget widgets".split())
BESIDE_WORDS = set("area bar block bottom box button buttons container content field form holder inner item items label left link links list outer pane panel post right section side site slot text title top unit user wrap wrapper".split())

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<[/a-zA-Z][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:-][\w:.-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
NO_MARKS: frozenset[int] = frozenset()


def role_named(token: str) -> int:
    """Whether a class or id as a whole names a role: 2 if it does (``cookie-notice``), 1 if by a word of many meanings (``notice``), 0 if not (``share-price``)."""
    words = [w.lower() for w in WORD.findall(token)]
    named = ROLE_WORDS & {*words, "".join(words)}
    whole = "".join(words) in ROLE_WORDS or all(w in ROLE_WORDS or w in BESIDE_WORDS for w in words)
    return 0 if not named or not whole else 1 if named <= WEAK_WORDS else 2


@lru_cache(maxsize=50_000)
def look(tag: str, attributes: str) -> tuple[str, bool, int]:
    """(signature, whether it's never main text, how surely it names a role that is none) of a start tag."""
    words: set[str] = set()
    gone, role = tag in GONE, 2 if tag == "form" else 0
    if "=" in attributes or "hidden" in attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), html.unescape(value.strip("\"'"))
            if name in ("class", "id"):
                role = max([role, *map(role_named, value.split())])
                if name == "class":
                    words.update(w.lower() for w in WORD.findall(value))
            gone |= name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.lower() in ROLES) or (name == "style" and re.search(r"display\s*:\s*none", value) is not None)
    page = tag in ("article", "main", "body", "html")
    return f"{tag}.{'.'.join(sorted(words))}", gone, 0 if page else role


@lru_cache(maxsize=50_000)
def _below(path: int, signature: str) -> int:
    return xxhash.xxh64_intdigest(f"{path:x}/{signature}") >> 1


class Block:
    __slots__ = ("path", "core", "role", "text", "linked", "content")

    def __init__(self, path: int, core: bool, role):
        self.path, self.core, self.role, self.text, self.linked = path, core, role, [], 0


class Frame:
    """An open element: where its text belongs, and for each group of ``GROUPS`` the place of the element that it would close."""

    __slots__ = ("tag", "path", "gone", "core", "link", "role", "near")

    def __init__(self, tag, path, gone, core, link, role, near):
        self.tag, self.path, self.gone, self.core, self.link, self.role, self.near = tag, path, gone, core, link, role, near


def blocks(source: str | None) -> list[Block]:
    """The text blocks of a page in order, without parts that are never main text. The work is linear in the page."""
    source = source or ""
    out: list[Block] = []
    stack = [Frame("", 0, False, False, False, -1, {})]
    open_tags: dict[str, int] = {}
    # Elements that name a role: how surely, the one around each, and whether it holds an article.
    sure: list[int] = []
    parents: list[int] = []
    holds: list[bool] = []

    def pop_to(place: int) -> None:
        for frame in stack[place:]:
            open_tags[frame.tag] -= 1
        del stack[place:]

    open_block: Block | None = None
    at, end = 0, len(source)
    while at < end:
        found = MARKUP.search(source, at)
        text = source[at : found.start() if found else end]
        top = stack[-1]
        if text and not top.gone:
            if open_block is None:
                open_block = Block(top.path, top.core, top.role)
                out.append(open_block)
            text = html.unescape(text) if "&" in text else text
            open_block.text.append(text)
            open_block.linked += len(text) if top.link else 0
        if not found:
            break
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            open_block = None
        if found[1]:
            if open_tags.get(tag):
                place = len(stack) - 1
                while stack[place].tag != tag:
                    place -= 1
                pop_to(place)
            continue
        for group, (_, asks, _) in GROUPS.items():
            if tag in asks and (place := stack[-1].near.get(group)):
                pop_to(place)
        signature, gone, role = look(tag, found[3])
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
            at = close.end() if close else end
            continue
        if tag in VOID or found[3].endswith("/") and tag not in BLOCK:
            continue
        top = stack[-1]
        core, holder = top.core, top.role
        if tag in ("article", "main"):
            core = True
            if holder >= 0:
                holds[holder] = True
        if role:
            sure.append(role)
            parents.append(holder)
            holds.append(False)
            holder = len(parents) - 1
        near = top.near
        for group, (tags, _, scope) in GROUPS.items():
            if tag in tags:
                near = near | {group: len(stack)}
            elif tag in scope and group in near:
                near = {g: p for g, p in near.items() if g != group}
        open_tags[tag] = open_tags.get(tag, 0) + 1
        stack.append(Frame(tag, _below(top.path, signature) if tag in BLOCK else top.path, top.gone or gone or (tag == "header" and not core), core, top.link or tag == "a", holder, near))
    return _judged(out, sure, parents, holds)


def _judged(found: list[Block], sure: list[int], parents: list[int], holds: list[bool]) -> list[Block]:
    """The blocks that have text, joined and hashed; ``role`` is what the names of roles take from them, in thousandths."""
    out, sizes = [], [0] * len(parents)
    for b in found:
        b.text = " ".join("".join(b.text).split())
        if b.text:
            b.content = xxhash.xxh64_intdigest(b.text) >> 1
            b.linked = min(b.linked, len(b.text))
            out.append(b)
            if b.role >= 0:
                sizes[b.role] += len(b.text)
    total = sum(len(b.text) for b in out)
    for i in range(len(parents) - 1, -1, -1):
        if parents[i] >= 0:
            sizes[parents[i]] += sizes[i]
            holds[parents[i]] |= holds[i]
    named: list[int] = []
    for i, parent in enumerate(parents):
        own = sure[i] if not holds[i] and sizes[i] < WHOLE * total else 0
        named.append(max(own, named[parent] if parent >= 0 else 0))
    for b in out:
        by_name = named[b.role] if b.role >= 0 else 0
        b.role = round(1000 * (0 if not by_name else WEAK if by_name == 1 and b.core else STRONG))
    return out


def _evidence(b: Block) -> np.ndarray:
    """Letters of a block: all, links outside of articles, inside of articles, and what names take, in thousandths."""
    n = len(b.text)
    return np.array([n, 0 if b.core else b.linked, n if b.core else 0, n * b.role], np.int64)


def own_nodes(found: list[Block]) -> dict[int, np.ndarray]:
    """The evidence of each node of one page; a content counts once a node."""
    sums: dict[int, np.ndarray] = {}
    for b in {(b.path, b.content): b for b in found}.values():
        sums[b.path] = sums.get(b.path, 0) + _evidence(b)
    return sums


def known_weight(evidence: np.ndarray, article: float) -> float:
    """What is left of a node's importance by what is known besides the entropies."""
    n, linked, inner, named = (float(x) for x in evidence)
    return (1 - linked / n) * (1 - OUTSIDE * (1 - inner / n) * article) * (1 - named / (1000 * n))


def main_text(source: str | None, low: frozenset[int] = NO_MARKS, high: frozenset[int] = NO_MARKS, article: float | None = None, threshold: float = LOW) -> str:
    """The page's main text; ``low`` are nodes of its host's style tree that are removed, ``high`` those that stay.

    Nodes that no other page has are judged here, by the host's share of text in articles and its threshold. Without
    these the page is judged as the only one of its host.
    """
    found = blocks(source)
    nodes = own_nodes(found)
    if article is None:
        total = sum(nodes.values(), np.zeros(4, np.int64))
        article = float(total[2] / max(1, total[0]))
    own = {path for path, x in nodes.items() if path not in high and path not in low and GAMMA * known_weight(x, article) < threshold}
    return " ".join(b.text for b in found if b.path not in low and b.path not in own)


# -------------------------------------------------------------------- Spark

#: Kinds of tree rows: a content of a node, a number of blocks of a node, and a page (with path 0).
CONTENT, SHAPE, PAGE = 0, 1, 2
ROWS = "host string, path long, kind int, value long, page long, size long, linked long, inner long, named long"


@lean
def _tree_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each content and shape of a page's nodes; ``page`` is named by its longest block."""
    types = [pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 6]
    for batch in pieces(batches, 1, PIECE_BYTES):
        rows: dict[tuple, tuple] = {}
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = blocks(source)
            if not found:
                continue
            page = max(found, key=lambda b: len(b.text)).content
            shapes: dict[int, int] = {}
            for b in found:
                shapes[b.path] = shapes.get(b.path, 0) + 1
                rows[host, b.path, CONTENT, b.content, page] = tuple(_evidence(b).tolist())
            rows.update({(host, path, SHAPE, n, page): (0, 0, 0, 0) for path, n in shapes.items()})
            rows[host, 0, PAGE, page, page] = (0, 0, 0, 0)
        columns = list(zip(*(k + v for k, v in rows.items()), strict=True)) or [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in ROWS.split(", ")])


def _site(url_col: str, html_col: str):
    """The page's host in lower case, or a name of its own for a page that has none."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), HOST, 1))
    return F.when(host != "", host).otherwise(F.concat(F.lit("page:"), F.hex(F.xxhash64(F.col(html_col).cast("string")))))


def merged_trees(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, kind, value, pages, n, size, linked, inner, named): the style trees' contents and shapes.

    ``n`` is on how many pages one is; what is on one page alone is summed up to one row a node
    (value null, ``pages`` of them). The other numbers are summed over the pages.
    """
    rows = pages.select(_site(url_col, html_col).alias("host"), F.col(html_col).cast("string").alias("html")).mapInArrow(_tree_rows, ROWS)
    sums = ("size", "linked", "inner", "named")
    once = rows.groupBy("host", "path", "kind", "value", "page").agg(*(F.max(c).alias(c) for c in sums))
    spread = once.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in sums))
    shared = spread.withColumn("value", F.when(F.col("n") > 1, F.col("value")))
    return shared.groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("pages"), F.max("n").alias("n"), *(F.sum(c).alias(c) for c in sums))


def style_trees(merged: DataFrame) -> DataFrame:
    """(host, path, importance, m) of each node of the hosts' style trees; m is the host's number of pages."""
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value).otherwise(0))
    nodes = merged.groupBy("host", "path").agg(
        of(PAGE, F.col("pages")).alias("m"),
        *(F.sum(c).alias(c) for c in ("size", "linked", "inner", "named")),
        of(CONTENT, F.col("size") * F.ln("n")).alias("content"),
        of(SHAPE, F.col("pages")).alias("on_pages"),
        of(SHAPE, F.col("pages") * F.ln("n")).alias("shapes"),
    )
    nodes = nodes.withColumns({c: F.col(c).cast("double") for c in ("size", "linked", "inner", "named")})
    sites = nodes.groupBy("host").agg(F.sum("m").alias("m"), (F.sum("inner") / F.sum("size")).alias("article"))
    own = nodes.filter("size > 0").drop("m").join(sites, "host")
    base = F.ln(F.col("m") + SMOOTHING)
    content = 1 - F.col("content") / F.col("size") / base
    shapes = (F.ln("on_pages") - F.col("shapes") / F.col("on_pages")) / base
    share = lambda c: F.col(c) / F.col("size")
    known = (1 - share("linked")) * (1 - OUTSIDE * (1 - share("inner")) * F.col("article")) * (1 - share("named") / 1000)
    return own.select("host", "path", ((GAMMA * content + (1 - GAMMA) * shapes) * known).alias("importance"), "on_pages", "article", "m")


def thresholds(shared: DataFrame) -> DataFrame:
    """(host, threshold): the middle of the widest gap between the importances of a host's nodes, the lowest of several."""
    bounds = shared.select("host").distinct().select("host", F.explode(F.array(F.lit(LOWEST), F.lit(HIGHEST))).alias("at"))
    inside = shared.filter(F.col("importance").between(LOWEST, HIGHEST)).select("host", F.col("importance").alias("at"))
    after = F.lead("at").over(Window.partitionBy("host").orderBy("at"))
    gaps = bounds.unionByName(inside).withColumn("next", after).filter("next is not null")
    wide = F.struct((F.col("at") - F.col("next")).alias("minus"), ((F.col("at") + F.col("next")) / 2).alias("middle"))
    return gaps.groupBy("host").agg(F.min(wide)["middle"].alias("threshold"))


def removals(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(site, low, high, article, threshold) of each host: the nodes that several of its pages share, below its threshold and above."""
    trees = written(style_trees(merged_trees(pages, url_col, html_col)), "style-nodes")
    shared = trees.filter("on_pages > 1")
    judged = shared.join(thresholds(shared), "host").withColumn("goes", F.col("importance") < F.col("threshold"))
    sites = trees.groupBy("host").agg(F.first("article").alias("article"))
    lists = [F.collect_set(F.when(c, F.col("path"))).alias(name) for c, name in ((F.col("goes"), "low"), (~F.col("goes"), "high"))]
    marks = judged.groupBy("host").agg(*lists, F.first("threshold").alias("threshold"))
    return sites.join(marks, "host", "left").select(F.col("host").alias("site"), "low", "high", "article", F.coalesce("threshold", F.lit(LOW)).alias("threshold"))


@lean
def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1, PIECE_BYTES):
        rows = zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True)
        texts = [main_text(source, frozenset(low or ()), frozenset(high or ()), article, LOW if at is None else at) for source, low, high, article, at in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], ["key", "text", "n_chars"])


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(key, text, n_chars) of every page; ``key`` holds all columns but the source.

    What is known of the hosts is written first, so that Spark knows its size: it is sent to the pages where
    it's small and else joined by host.
    """
    gone = written(removals(pages, url_col, html_col), "style-removals")
    key = F.struct(*(F.col(f"`{c}`") for c in pages.columns if c != html_col))
    rows = pages.select(key.alias("key"), F.col(html_col).cast("string").alias("html"), _site(url_col, html_col).alias("host"))
    met = rows.join(gone, rows["host"] == gone["site"], "left").select("key", "html", "low", "high", "article", "threshold")
    kind = met.schema["key"].dataType.simpleString()
    return met.mapInArrow(_extract, f"key {kind}, text string, n_chars long")
