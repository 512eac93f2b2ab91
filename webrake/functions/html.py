"""Native HTML expressions: field extraction by pattern, block and attribute
stripping, tag stripping.  They stay inside whole-stage codegen and use only
regular expressions of the JVM, so they double as the oracle-checked variant of the
parser-based cleaner in ``webrake.operators.htmlclean``.

Every page carries ``var t="</p>"`` inside ``<script>``, so script blocks are
removed before any tag-level work.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from webrake.functions.common import ColumnOrName, as_col, strip_ws

# Fixed value: elements removed together with their content.
DROP_BLOCKS = ["script", "style", "noscript", "svg", "img", "iframe", "code"]
VOID_DROPS = {"img"}


# Inside of a tag: quoted values may hold ``>``.  Possessive, so a page with
# unbalanced quotes costs no backtracking.
INNER = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""


def block_pattern(tag: str) -> str:
    if tag in VOID_DROPS:
        return rf"<{tag}\b{INNER}>(?:</{tag}\s*>)?"
    # an element closed in its own tag has no content to drop
    return rf"<{tag}\b{INNER}(?<=/)>|<{tag}\b{INNER}>.*?</{tag}\s*>"


def drop_blocks(html: ColumnOrName, tags: Sequence[str] = DROP_BLOCKS) -> Column:
    """Remove each element in ``tags`` with its content, in one pass."""
    return F.regexp_replace(as_col(html), "(?is)" + "|".join(block_pattern(t) for t in tags), "")


ATTR_RE = rf"<([A-Za-z][A-Za-z0-9]*)\s(?:{INNER}>|[^>]*+>)"


PROTECT = "\u0001"


def drop_attrs(html: ColumnOrName, keep_tags: Sequence[str] = ()) -> Column:
    """Drop every attribute: ``<p class=a>`` -> ``<p>``.  Tags in
    ``keep_tags`` keep theirs: they are shielded with a placeholder while the
    attributes of every other tag are removed (no look-around needed)."""
    out = as_col(html)
    for t in keep_tags:
        out = F.regexp_replace(out, rf"(?i)<({t})\b", "<" + PROTECT + "$1")
    out = F.regexp_replace(out, ATTR_RE, "<$1>")
    if keep_tags:
        out = F.replace(out, F.lit("<" + PROTECT), F.lit("<"))
    return out


def clean_html_native(html: ColumnOrName, keep_tags: Sequence[str] = ()) -> Column:
    return drop_attrs(drop_blocks(html), keep_tags)


def decode_entities(text: Column) -> Column:
    """The five basic entities and the no-break space decoded."""
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                    ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(ent), F.lit(ch))
    return text


def strip_tags(html: ColumnOrName) -> Column:
    """Text of an HTML fragment: comments and tags removed, the five basic
    entities decoded, whitespace runs collapsed."""
    t = F.regexp_replace(as_col(html), r"(?s)<!--.*?-->", " ")
    t = decode_entities(F.regexp_replace(t, rf"<(?:{INNER}>|[^>]*+>)", " "))
    t = F.regexp_replace(t, r"[ \t\n\r\f]+", " ")
    return strip_ws(t)


def html_text_native(html: ColumnOrName) -> Column:
    """Plain text of a page: drop blocks, then strip tags."""
    return strip_tags(drop_blocks(html))


def element_text(html: ColumnOrName, tag: str) -> Column:
    """Inner HTML of the first ``<tag ...>...</tag>`` ('' when absent)."""
    return F.regexp_extract(as_col(html), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)


def html_title(html: ColumnOrName) -> Column:
    return element_text(html, "title")


def first_paragraph(html: ColumnOrName) -> Column:
    """Text of the first paragraph (after scripts are dropped)."""
    return strip_tags(element_text(drop_blocks(html, ["script"]), "p"))


# An attribute's value in any quoting; the name stands after white space
# (``data-href`` is not ``href``).
VALUE = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""


def attr_pattern(attr: str) -> str:
    return rf"""(?:[^>"']|"[^"]*"|'[^']*')*?\s{re.escape(attr)}\s*=\s*{VALUE}"""


def unquote(value: Column) -> Column:
    """An attribute's value without its quotes, entities decoded."""
    return decode_entities(F.regexp_replace(value, r"""^["']|["']$""", ""))


HREF_RE = rf"(?is)<a(?=\s){attr_pattern('href')}"


def html_links(html: ColumnOrName) -> Column:
    """All ``href`` values of anchors, in document order."""
    return F.transform(F.regexp_extract_all(drop_blocks(html, ["script"]), F.lit(HREF_RE), 1), unquote)


def extract_by_class(html: ColumnOrName, tag: str, cls: str) -> Column:
    """Inner HTML of every ``<tag class="... cls ...">`` (document order),
    for field specs such as article titles and tags on profile pages."""
    return F.regexp_extract_all(drop_blocks(html, ["script"]), F.lit(block_pattern_of(tag, cls)), 1)


def extract_fields(html: ColumnOrName, spec: dict[str, tuple[str, str, bool]]) -> Column:
    """struct of fields from a spec ``{name: (tag, class, repeated)}``;
    scalar fields default to ''."""
    fields = []
    for name, (tag, cls, repeated) in spec.items():
        vals = F.transform(extract_by_class(html, tag, cls), lambda v: strip_tags(v))
        fields.append((vals if repeated else F.coalesce(F.get(vals, 0), F.lit(""))).alias(name))
    return F.struct(*fields)


ANCHOR_RE = rf"(?is)<a(?=\s){attr_pattern('href')}[^>]*>(.*?)</a\s*>"


def container_html(html: ColumnOrName, tag: str, cls: str | None = None) -> Column:
    """Inner HTML of the first ``<tag>`` (with class ``cls`` when given)."""
    if cls is None:
        return element_text(html, tag)
    return F.regexp_extract(as_col(html), block_pattern_of(tag, cls), 1)


def extract_anchors(html: ColumnOrName, tag: str, cls: str | None = None) -> Column:
    """array<struct<name, url>> of the links inside a container (e.g. a
    co-author list): anchor text (tags stripped) and ``href``, in order."""
    inner = container_html(drop_blocks(html, ["script"]), tag, cls)
    pairs = F.arrays_zip(F.regexp_extract_all(inner, F.lit(ANCHOR_RE), 2).alias("name"),
                         F.regexp_extract_all(inner, F.lit(ANCHOR_RE), 1).alias("url"))
    return F.transform(pairs, lambda p: F.struct(strip_tags(p["name"]).alias("name"),
                                                 unquote(p["url"]).alias("url")))


def block_pattern_of(tag: str, cls: str | None = None) -> str:
    if cls is None:
        return rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"
    # several classes (blank-separated): each must stand in the attribute
    words = [re.escape(c) for c in cls.split()]
    both = lambda quote: "".join(
        rf"""(?=(?:[^{quote}]*\s)?{w}(?:\s[^{quote}]*)?{quote})""" for w in words)
    names = [rf"""\"{both('"')}[^"]*\"""", rf"""'{both("'")}[^']*'"""]
    if len(words) == 1:
        names.append(rf"{words[0]}(?=[\s>])")
    return rf"(?is)<{tag}(?=\s)[^>]*?\sclass\s*=\s*(?:{'|'.join(names)})[^>]*>(.*?)</{tag}\s*>"


def field_pattern(tag: str, attr: str | None = None) -> str:
    """First ``<tag>``'s text (attr None) or the value of its ``attr``."""
    if attr is None:
        return rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"
    return rf"(?is)<{tag}(?=\s){attr_pattern(attr)}"


def extract_blocks(html: ColumnOrName, tag: str, cls: str | None,
                   fields: dict[str, tuple[str, str | None]]) -> Column:
    """array<struct<...>>: one struct per block element (``<tag
    class=cls>``), each field the text of the block's first ``<ftag>`` or
    its attribute (search results: title, link, snippet).  Missing fields
    are ''."""
    blocks = F.regexp_extract_all(drop_blocks(html, ["script"]), F.lit(block_pattern_of(tag, cls)), 1)

    def rec(b):
        out = []
        for name, (ftag, attr) in fields.items():
            v = F.regexp_extract(b, field_pattern(ftag, attr), 1)
            out.append((unquote(v) if attr else strip_tags(v)).alias(name))
        return F.struct(*out)

    return F.transform(blocks, rec)
