"""Main text of HTML pages by a tree-structured graphical model.

Each page becomes a tree of block elements.  Every node has a hidden label
(content or not).  Potentials connect a child's label with its parent's, by
the child's kind of element and its class/id/role words; evidence potentials
hold the length and link share of the node's text.  One upward and one
downward pass of sum-product messages give every node's exact content
marginal; text of nodes with a marginal of at least one half is the article.

The potentials are counted on labelled pages: those whose markup names the
article.  Each labelled page is also counted in variants that keep the labels
and rename the elements (an article as ``div``, a menu as ``div
class=menu``, reader comments inside the article, ...), so the model does not
lean on one site's tags.  At most ``max_pages`` pages train it (smallest
hashes of the id first); all pages are scored whole.

Text: character references are decoded, white space inside a block becomes
one space, blocks are trimmed and joined by one newline.

Defined results: null, empty and text-free pages give an empty text; broken
markup is closed like a browser does it (a parent's end tag closes its open
children); without a labelled page the model has its prior counts alone;
repeated pages are extracted alike; an empty table gives an empty result;
extra columns are kept.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrake.llm.common import python_ready

MAX_PAGES = 2_000

# fixed values: elements of HTML and the class words that name a part of a page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript template".split())
DROPPED = frozenset("head script style noscript template svg math iframe object canvas audio video map select button "
                    "textarea option datalist dialog".split())
BLOCK = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav footer header aside form "
                  "fieldset legend table thead tbody tfoot tr td th caption blockquote pre figure figcaption address "
                  "details summary hgroup menu center search".split())
KINDS = {"article": "article", "main": "main", "section": "section", "div": "div", "p": "text", "pre": "text",
         "blockquote": "text", "h1": "head", "h2": "head", "h3": "head", "h4": "head", "h5": "head", "h6": "head",
         "ul": "list", "ol": "list", "dl": "list", "li": "item", "dt": "item", "dd": "item", "nav": "nav", "menu": "nav",
         "search": "form", "footer": "footer", "header": "header", "aside": "aside", "form": "form", "fieldset": "form"}
NOT_CONTENT_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs footer foot header masthead sidebar aside complementary contentinfo widget related recommended "
    "share sharing social cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup "
    "login search form comment comments commentlist reply replies respond disqus discussion pagination pager toolbar "
    "copyright legal disclaimer skip hidden".split())
CONTENT_WORDS = frozenset("article content main post entry story maincontent articlebody".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table html body div article section nav aside main header footer form td th li".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|"
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def hint_of(attrs: str) -> str:
    """``neg``, ``pos`` or ``none``: what the class, id and role words say."""
    if not attrs:
        return "none"
    words = set()
    for _, a, b, c in _ATTR.findall(attrs):
        words.update(_WORD.findall(_CAMEL.sub(" ", a or b or c).lower()))
    if words & NOT_CONTENT_WORDS or _HIDDEN.search(attrs):
        return "neg"
    return "pos" if words & CONTENT_WORDS else "none"


class Tree:
    """Nodes of a page in page order, and its blocks as (node, text) pieces."""

    def __init__(self, page: str):
        self.tag, self.hint, self.parent, self.dropped = ["#"], ["none"], [-1], [False]
        self.chars, self.linked = [0], [0]
        self.blocks: list[list[tuple[int, str]]] = []
        self._run: list[tuple[int, str]] = []
        self._read(page)
        for i in range(len(self.tag) - 1, 0, -1):
            p = self.parent[i]
            self.chars[p] += self.chars[i]
            self.linked[p] += self.linked[i]

    def _flush(self) -> None:
        if self._run:
            self.blocks.append(self._run)
            self._run = []

    def _text(self, node: int, raw: str, in_link: bool) -> None:
        if raw:
            text = _html.unescape(raw)
            self._run.append((node, text))
            n = len(text.strip())
            self.chars[node] += n
            self.linked[node] += n if in_link else 0

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int]] = [("#", 0)]       # open elements that are nodes
        links, pos, search = 0, 0, _TOKEN.search
        while (m := search(page, pos)) is not None:
            if m.start() > pos:
                self._text(stack[-1][1], page[pos:m.start()], links > 0)
            pos = m.end()
            name = m.group(2) or m.group(5)
            if name is None:
                continue
            name, closing, attrs = name.lower(), m.group(1) or m.group(4), m.group(3) or m.group(6) or ""
            if closing:
                if name == "a":
                    links = max(0, links - 1)
                elif any(t == name for t, _ in stack):
                    while stack[-1][0] != name:
                        stack.pop()
                    stack.pop()
                    if name in BLOCK:
                        self._flush()
                        links = 0
                elif name in BLOCK:
                    self._flush()
                continue
            if name == "a":
                links = 1
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    self._run.append((stack[-1][1], " "))
                    if name == "hr":
                        self._flush()
                continue
            hint = hint_of(attrs) if name not in ("html", "body") else "none"
            block = name in BLOCK
            if not block and name not in DROPPED and hint != "neg":
                continue                                   # plain inline markup
            if block:
                self._flush()
                links = 0
                if name == "body" or name != "html" and stack[-1][0] == "head":
                    while any(t == "head" for t, _ in stack):
                        stack.pop()
                if any(t == "p" for t, _ in stack):        # a block ends an open paragraph
                    while stack.pop()[0] != "p":
                        pass
            for other in CLOSES.get(name, ()):
                depth = next((i for i in range(len(stack) - 1, 0, -1)
                              if stack[i][0] == other or stack[i][0] in SCOPES and stack[i][0] not in CLOSES), 0)
                if depth and stack[depth][0] == other:
                    del stack[depth:]
            node, up = len(self.tag), stack[-1][1]
            self.tag.append(name)
            self.hint.append(hint)
            self.parent.append(up)
            self.dropped.append(self.dropped[up] or name in DROPPED)
            self.chars.append(0)
            self.linked.append(0)
            if attrs.endswith("/"):
                continue
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, pos)
                pos = end.end() if end else len(page)
                continue
            stack.append((name, node))
        if pos < len(page):
            rest = page[pos:]
            cut = re.search(r"<[a-zA-Z/!]", rest)          # a tag that never ends
            self._text(stack[-1][1], rest[:cut.start()] if cut else rest, links > 0)
        self._flush()

    def evidence(self, i: int) -> tuple[int, int]:
        """(length bucket, link share bucket) of the node's text."""
        n = self.chars[i]
        size = 0 if n == 0 else 1 if n < 30 else 2 if n < 120 else 3 if n < 500 else 4
        share = self.linked[i] / n if n else 0.0
        return size, 0 if share < 0.1 else 1 if share < 0.5 else 2


def kind_of(tag: str) -> str:
    return KINDS.get(tag, "other")


Key = tuple[str, ...]


def _variants(kind: str, hint: str, label: int, parent_label: int) -> list[tuple[str, str, float]]:
    """Label-keeping renamings of a node that begins or ends the article."""
    same = [(kind, hint, 1.0)]
    if label and not parent_label:      # the article's own element
        return [(kind, hint, 0.4), ("article", "none", 0.1), ("main", "none", 0.1), ("div", "pos", 0.15),
                ("section", "pos", 0.05), ("main", "pos", 0.1), ("div", "none", 0.05), ("section", "none", 0.05)]
    if not label and kind in ("nav", "footer", "header", "aside", "form") or not label and hint == "neg":
        return [(kind, hint, 0.4), ("div", "neg", 0.2), ("section", "neg", 0.1), ("nav", "none", 0.05),
                ("header", "none", 0.05), ("aside", "none", 0.05), ("form", "none", 0.05), ("list", "neg", 0.05),
                ("footer", "none", 0.05)]
    return same


def labels_of(tree: Tree) -> list[int] | None:
    """Labels of a page whose markup names its article, else None."""
    if "article" not in tree.tag:
        return None
    out = [0] * len(tree.tag)
    for i in range(1, len(tree.tag)):
        apart = tree.dropped[i] or tree.hint[i] == "neg" or kind_of(tree.tag[i]) in (
            "nav", "footer", "header", "aside", "form")
        up = tree.parent[i]
        inside = out[up] == 1 or tree.tag[i] == "article" and not _below_apart(tree, up)
        out[i] = int(inside and not apart)
    return out


def _below_apart(tree: Tree, i: int) -> bool:
    while i > 0:
        if tree.hint[i] == "neg" or kind_of(tree.tag[i]) in ("nav", "footer", "header", "aside", "form"):
            return True
        i = tree.parent[i]
    return False


def count_page(page: str, counts: dict[Key, float]) -> None:
    """Add one page's label counts: child given parent, evidence given label."""
    tree = Tree(page)
    labels = labels_of(tree)
    if labels is None:
        return
    for i in range(1, len(labels)):
        if tree.dropped[i]:
            continue
        y, up = labels[i], labels[tree.parent[i]]
        kind = kind_of(tree.tag[i])
        for k, h, w in _variants(kind, tree.hint[i], y, up):
            counts["t", k, h, str(up), str(y)] += w
            if not y and (k, h) != (kind, tree.hint[i]):
                counts["t", k, h, "1", "0"] += w           # the same part inside the article
        size, links = tree.evidence(i)
        counts["s", kind, str(size), str(y)] += 1
        counts["l", kind, str(links), str(y)] += 1
        if y and kind in ("text", "item", "head"):          # the same prose as a reader's comment or in a sidebar
            counts["t", kind, tree.hint[i], "0", "0"] += 0.5
            counts["s", kind, str(size), "0"] += 0.5
            counts["l", kind, str(links), "0"] += 0.5


class Model:
    """Potentials of the tree: child label given parent label, kind and class
    words; evidence given label.  Prior counts (of ``strength``) say that a
    child has its parent's label unless its element or words say otherwise."""

    APART = frozenset(("nav", "footer", "header", "aside", "form"))

    def __init__(self, counts: dict[Key, float], strength: float = 20.0):
        self.edge: dict[tuple[str, str], tuple[float, float, float, float]] = {}
        kinds = {*KINDS.values(), "other"}
        for k in kinds:
            for h in ("neg", "pos", "none"):
                row = []
                for up in (0, 1):
                    prior = 0.02 if h == "neg" or k in self.APART else (
                        0.97 if up else 0.9 if k == "article" else 0.7 if k == "main" or h == "pos"
                        else 0.3 if k in ("div", "section") else 0.1)
                    n0, n1 = (counts.get(("t", k, h, str(up), str(y)), 0.0) for y in (0, 1))
                    if up == 0 and k in ("text", "head", "item", "list", "other") and h == "none":
                        n0 *= 0.5      # stray text outside every container is rarer than its containers
                    total = n0 + n1
                    # counts are worth at most ten times the prior: no potential becomes certain
                    scale = min(1.0, 10 * strength / total) if total else 0.0
                    p = (n1 * scale + prior * strength) / (total * scale + strength)
                    row += [1 - p, p]
                self.edge[k, h] = tuple(row)
        self.size = {k: self._evidence(counts, "s", k, 5) for k in kinds}
        self.link = {k: self._evidence(counts, "l", k, 3) for k in kinds}

    @staticmethod
    def _evidence(counts: dict[Key, float], name: str, kind: str, n: int) -> list[tuple[float, float]]:
        rows = [[counts.get((name, kind, str(b), str(y)), 0.0) + 5 for b in range(n)] for y in (0, 1)]
        if name == "s" and kind in ("div", "section", "main", "article", "other"):
            # prior counts of containers: little text is rarely the article, much text often is
            rows = [[r + w for r, w in zip(row, prior)] for row, prior in zip(rows, ((20, 20, 15, 10, 5), (1, 5, 10, 15, 20)))]
        # tempered: the texts of a node and of its ancestors overlap
        return [tuple((rows[y][b] / sum(rows[y])) ** 0.5 for y in (0, 1)) for b in range(n)]

    def marginals(self, tree: Tree) -> list[float]:
        """Content marginal of every node by sum-product, exact on the tree."""
        n, tag, hint, parent = len(tree.tag), tree.tag, tree.hint, tree.parent
        up0, up1 = [1.0] * n, [1.0] * n          # evidence times messages from the children
        msg: list[tuple[float, float]] = [(1.0, 1.0)] * n
        edges = [(1.0, 0.0, 1.0, 0.0)] * n
        for i in range(n - 1, 0, -1):             # upward
            if tree.dropped[i]:
                up0[i], up1[i] = 1.0, 0.0
                e = (1.0, 0.0, 1.0, 0.0)
            else:
                e = self.edge[kind_of(tag[i]), hint[i]]
                size, link = tree.evidence(i)
                kind = kind_of(tag[i])
                s, l = self.size[kind][size], self.link[kind][link]
                up0[i] *= s[0] * l[0]
                up1[i] *= s[1] * l[1]
            edges[i] = e
            m0, m1 = e[0] * up0[i] + e[1] * up1[i], e[2] * up0[i] + e[3] * up1[i]
            z = m0 + m1
            m0, m1 = m0 / z, m1 / z
            msg[i] = (m0, m1)
            p = parent[i]
            a, b = up0[p] * m0, up1[p] * m1
            z = a + b if a + b > 0 else 1.0
            up0[p], up1[p] = a / z, b / z
        out = [0.0] * n
        down: list[tuple[float, float]] = [(1.0, 0.0)] * n     # the page itself is not content
        belief = [(1.0, 0.0)] * n
        for i in range(1, n):                     # downward
            p, e = parent[i], edges[i]
            b0, b1 = belief[p]
            m0, m1 = msg[i]
            q0, q1 = b0 / m0 if m0 > 0 else 0.0, b1 / m1 if m1 > 0 else 0.0   # parent's belief without this child
            d0, d1 = q0 * e[0] + q1 * e[2], q0 * e[1] + q1 * e[3]
            x0, x1 = d0 * up0[i], d1 * up1[i]
            z = x0 + x1
            belief[i] = (x0 / z, x1 / z) if z > 0 else (1.0, 0.0)
            out[i] = belief[i][1]
        return out


def main_text(page: str | None, model: Model, threshold: float = 0.5) -> str:
    """The article of one page."""
    if not page:
        return ""
    tree = Tree(page)
    p = model.marginals(tree)
    blocks = []
    for block in tree.blocks:
        text = " ".join("".join(t for node, t in block if p[node] >= threshold and not tree.dropped[node]).split())
        if text:
            blocks.append(text)
    return "\n".join(blocks)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_pages: int = MAX_PAGES) -> Model:
    """Count the potentials on at most ``max_pages`` labelled pages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[Key, float] = defaultdict(float)
        for batch in batches:
            for page in batch.column(0):
                if (text := page.as_py()) is not None:
                    count_page(text, counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([list(k) for k in counts], pa.list_(pa.string())), pa.array(list(counts.values()), pa.float64())],
            ["key", "n"])

    html = F.col(html_col).cast("string")
    marked = pages.where(html.rlike("(?i)<article[\\s>]"))
    ids = marked.select(id_col).where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(max_pages)
    chosen = pages.select(html.alias("html"), id_col).join(F.broadcast(ids.distinct()), id_col, "left_semi")
    rows = python_ready(chosen.select("html")).mapInArrow(run, "key array<string>, n double") \
        .groupBy("key").agg(F.sum("n").alias("n"))             # at most a few hundred keys
    return Model({tuple(r.key): r.n for r in sorted(rows.collect(), key=lambda r: r.key)})


def extract(pages: DataFrame, model: Model, html_col: str = "html", threshold: float = 0.5) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (its code points)."""
    pages = python_ready(pages).drop("text", "n_chars")
    at = pages.columns.index(html_col)
    rest = [c for c in pages.columns if c != html_col]
    shared = pages.sparkSession.sparkContext.broadcast(model)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            texts = [main_text(x.as_py(), fitted, threshold) for x in batch.column(at).cast(pa.string())]
            cols = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], [*rest, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in rest)
    return pages.mapInArrow(run, f"{schema}, text string, n_chars bigint")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                      max_pages: int = MAX_PAGES) -> DataFrame:
    """Train on the labelled pages and extract the main text of every page."""
    return extract(pages, train(pages, id_col, html_col, max_pages), html_col)
