"""Parser-based HTML cleaning and HTML -> light markdown, one pass per page.

Runs as ``mapInPandas`` with the standard library's event parser: Spark
partitions the pages, each task streams Arrow batches (keep
``spark.sql.execution.arrow.maxRecordsPerBatch`` small, pages are large)
and returns both the cleaned HTML and its text in one pass.  The native
regular-expression variant in ``webrake.functions.html`` is the one the
SQL oracle checks; this one tolerates malformed markup (missing ends,
``</p>`` inside scripts) the way a browser-grade tokenizer does.

Cleaning drops every attribute (``keep`` spares the listed attributes of
the listed tags; the crawl's default spares nothing, its "keep" mode spares
all attributes of ``<meta>``), and removes script, style, noscript, svg,
img, iframe and code elements with their content.  Text and comments stay.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from webrake.session import ship_package

# Fixed values.
DROP_WITH_CONTENT = {"script", "style", "noscript", "svg", "img", "iframe", "code"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
        "param", "source", "track", "wbr"}
BLOCK = {"p", "div", "section", "article", "header", "footer", "nav", "ul", "ol", "table",
         "tr", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "li", "br", "hr",
         "title", "main", "aside", "form", "dl", "dt", "dd"}
KEEP_META = {"meta": None}  # None = every attribute


_INDENT = "\x00"         # one list level in the raw markdown, until lines are normalised


class _Cleaner(HTMLParser):
    """Keeps a stack of open elements: a parent's end tag closes its open
    children, and with them a dropped element that was never closed."""

    def __init__(self, keep: dict | None):
        super().__init__(convert_charrefs=True)
        self.keep = keep or {}
        self.out: list[str] = []
        self.md: list[str] = []
        self.open: list[str] = []
        self.drop_at: int | None = None      # depth of the open dropped element
        self.href: list[str | None] = []
        self.list_depth = 0
        self.cells = 0                        # cells of the open table row

    # -- markdown helpers
    def _md_break(self, n=2):
        self.md.append("\n" * n)

    def handle_decl(self, decl):
        if self.drop_at is None:
            self.out.append(f"<!{decl}>")

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.open.append(tag)
        if self.drop_at is not None:
            return
        if tag in DROP_WITH_CONTENT:
            if tag not in VOID:
                self.drop_at = len(self.open) - 1
            return
        kept = []
        if tag in self.keep:
            names = self.keep[tag]
            kept = [(k, v) for k, v in attrs if names is None or k in names]
        attr_s = "".join(f' {k}="{_html.escape(v or "", quote=True)}"' if v is not None else f" {k}"
                         for k, v in kept)
        self.out.append(f"<{tag}{attr_s}{'/' if tag in VOID else ''}>")
        # markdown
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._md_break()
            self.md.append("#" * int(tag[1]) + " ")
        elif tag == "li":
            self._md_break(1)
            self.md.append(_INDENT * max(self.list_depth - 1, 0) + "- ")
        elif tag in ("ul", "ol"):
            if not self.list_depth:
                self._md_break(1)
            self.list_depth += 1
        elif tag == "a":
            self.href.append(dict(attrs).get("href"))
            self.md.append("[")
        elif tag in ("td", "th"):
            self.md.append(" | " if self.cells else "")
            self.cells += 1
        elif tag == "br":
            self._md_break(1)
        elif tag in BLOCK:
            self.cells = 0 if tag == "tr" else self.cells
            self._md_break()

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        elif self.drop_at is None and tag not in DROP_WITH_CONTENT:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in VOID or tag not in self.open:
            return
        while self._close() != tag:
            pass

    def _close(self):
        """Close the innermost open element and return its tag."""
        tag = self.open.pop()
        if self.drop_at is not None:
            if len(self.open) <= self.drop_at:
                self.drop_at = None
            return tag
        self.out.append(f"</{tag}>")
        if tag == "a":
            href = self.href.pop() if self.href else None
            self.md.append(f"]({href})" if href else "]")
        elif tag in ("ul", "ol"):
            self.list_depth = max(self.list_depth - 1, 0)
            if not self.list_depth:
                self._md_break()
        elif tag in BLOCK:
            self._md_break()
        return tag

    def close(self):
        super().close()
        while self.open:
            self._close()

    def handle_data(self, data):
        if self.drop_at is not None:
            return
        self.out.append(_html.escape(data, quote=False))
        self.md.append(_SPACE.sub(" ", data.replace(_INDENT, "")))

    def handle_comment(self, data):
        if self.drop_at is None:
            self.out.append(f"<!--{data}-->")


_SPACE = re.compile(r"\s+")


def clean_and_convert(markup: str | None, keep: dict | None = None) -> tuple[str | None, str | None]:
    """(clean_html, markdown) of one page."""
    if markup is None:
        return None, None
    p = _Cleaner(keep)
    p.feed(markup)
    p.close()
    md = "".join(p.md)
    # normalise blank-line runs and spaces; list lines keep their indent
    lines = [re.sub(" +", " ", ln).strip().replace(_INDENT, "  ") for ln in md.split("\n")]
    out, blank = [], False
    for ln in lines:
        if ln:
            out.append(ln)
            blank = False
        elif not blank and out:
            out.append("")
            blank = True
    return "".join(p.out), "\n".join(out).strip("\n")


def clean_pages(pages: DataFrame, html_col: str = "html", keep: dict | None = None,
                passthrough: list[str] | None = None) -> DataFrame:
    """Add ``clean_html`` and ``markdown`` to each page (``html`` dropped).
    ``passthrough`` columns are carried through (default: all others).

    Pages are large: a session that runs this should set
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` to a few hundred."""
    cols = passthrough if passthrough is not None else [c for c in pages.columns if c != html_col]
    in_schema = {f.name: f for f in pages.schema.fields}
    schema = StructType([in_schema[c] for c in cols] + [
        StructField("clean_html", StringType()), StructField("markdown", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            res = [clean_and_convert(h, keep) for h in b[html_col]]
            out = b[cols].copy()
            out["clean_html"] = [r[0] for r in res]
            out["markdown"] = [r[1] for r in res]
            yield out

    ship_package(pages.sparkSession)
    return pages.select(*cols, html_col).mapInPandas(run, schema)
