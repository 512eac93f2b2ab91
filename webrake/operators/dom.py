"""Pages as trees: a node table with interval numbers, and CSS selectors on it.

A page is cut into tokens natively (a tag and the text behind it).  Every
element gets ``pre``, the number of its start tag, and ``post``, that of the
token that ends it; an element lies inside another when its ``pre`` lies
between the other's ``pre`` and ``post``.  Nesting is found by running sums:

* Equal names nest: the start tags minus the end tags of one name give a
  level, and an element ends at the next end tag of its name and level.  End
  tags without a start are ignored.
* An element without an end tag ends with the closed element around it, a
  paragraph, list item or table cell also at the next one beside it.  Void
  elements (``<br>``) are empty.

"Has an ancestor that matches" is a running maximum of the matching elements'
``post`` over the page: no join and no pairs.  All windows and the final
aggregation cluster by the page's key, so pages are dealt over the cluster
once, before they are cut, and only tags (no text) are sorted.  Pages that
are stored in buckets by their key need no exchange at all (``dealt=True``).

The key columns name a page; rows that share a key count as one page's text in
no defined order, so keys must be unique.  A null or empty page has no elements.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webrake.functions import html as H
from webrake.functions.common import as_col
from webrake.session import text_tasks

# Elements without content, and those whose end tag may be left
# out before another of the kind.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
IMPLIED_END = ["p", "li", "dt", "dd", "tr", "td", "th", "option"]

#: HTML of the pages that one task nests (its node rows take some 40 times that).
TASK_BYTES = 4 << 20

_TAG = rf"(?:{H.INNER}>|[^>]*+>)"
_ROOT = "<page-root>"
_SKIPPED = "(?is)<!--.*?-->|<[!?][^>]*+>|" + "|".join(H.block_pattern(t) for t in ("script", "style"))


# ------------------------------------------------------------------ selectors
@dataclass(frozen=True)
class Step:
    """One compound selector: a tag, an id, classes and attributes."""
    tag: str | None = None
    id: str | None = None
    classes: tuple[str, ...] = ()
    attrs: tuple[tuple[str, str | None], ...] = field(default=())

    def matches(self, name: Column, start_tag: Column) -> Column:
        tests = [name == self.tag.lower()] if self.tag else []
        if self.id:
            tests.append(attribute(start_tag, "id") == self.id)
        if self.classes:
            words = F.split(attribute(start_tag, "class"), r"[ \t\n\r\f]+")
            tests += [F.array_contains(words, c) for c in self.classes]
        for attr, value in self.attrs:
            found = attribute(start_tag, attr)
            tests.append(found.isNotNull() if value is None else found == value)
        return reduce(and_, tests, ~F.startswith(start_tag, F.lit("</")))


_COMPOUND = re.compile(r"([A-Za-z][\w-]*|\*)?((?:[#.][\w-]+|\[[\w-]+(?:=[^\]]*)?\])*)")


def parse_selector(selector: str) -> list[Step]:
    """Steps of a descendant selector such as ``div#search div.g[jsaction]``."""
    steps = []
    for part in selector.split():
        m = _COMPOUND.fullmatch(part)
        if not m:
            raise ValueError(f"selector {part!r} is not supported")
        marks = re.findall(r"([#.])([\w-]+)|\[([\w-]+)(?:=([^\]]*))?\]", m[2])
        steps.append(Step(
            None if m[1] in (None, "", "*") else m[1], next((v for k, v, *_ in marks if k == "#"), None),
            tuple(v for k, v, *_ in marks if k == "."),
            tuple((a, v.strip("\"'") if f"[{a}=" in m[2] else None) for *_, a, v in marks if a)))
    if not steps:
        raise ValueError("an empty selector")
    return steps


def attribute(start_tag: Column, attr: str) -> Column:
    """Value of an attribute of a start tag: null without it, '' without value."""
    before = rf"""(?is)^<[^\s>/]++(?:[^>"']|"[^"]*"|'[^']*')*?[\s/]{re.escape(attr)}"""
    value = F.regexp_extract(start_tag, rf"{before}\s*=\s*{H.VALUE}", 1)
    return F.when(value != "", H.unquote(value)).when(F.rlike(start_tag, F.lit(rf"{before}(?=[\s/>=])")), F.lit(""))


# ---------------------------------------------------------------- node table
def tokens(html: Column, tags_only: bool = False) -> Column:
    """A page as an array of tags, each with the text behind it (or without);
    the first one stands for the page itself.  Comments, scripts and styles
    are left out."""
    plain = F.regexp_replace(F.coalesce(html, F.lit("")), _SKIPPED, "")
    plain = F.regexp_replace(plain, r"<(?!/?[A-Za-z])", "&lt;")
    return F.regexp_extract_all(F.concat(F.lit(_ROOT), plain), F.lit(rf"(?is)(</?[A-Za-z]{_TAG})[^<]*+"), int(tags_only))


def _deal(pages: DataFrame, keys: Sequence[str], html: str) -> DataFrame:
    """``pages`` dealt by their key, ``TASK_BYTES`` of HTML to a task.  The HTML
    is measured first: adaptive coalescing goes by compressed bytes, of which a
    task's node rows are a large multiple."""
    return pages.repartition(text_tasks(pages, html, TASK_BYTES), *keys)


def _cut(pages: DataFrame, keys: Sequence[str], html: str, dealt: bool) -> DataFrame:
    rows = pages.select(*keys, F.col(html).alias("__html"))
    rows = rows if dealt else _deal(rows, keys, "__html")
    cut = rows.select(*keys, tokens(F.col("__html"), tags_only=True).alias("__t"))
    cut = cut.select(*keys, F.size("__t").alias("__n"), F.posexplode("__t").alias("pre", "__tag"))
    return cut.withColumn("tag", F.lower(F.regexp_extract("__tag", r"^</?([A-Za-z][^\s/>]*)", 1)))


def _nest(cut: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Start tags of ``cut`` with ``post``; its other columns are kept."""
    ends = F.startswith("__tag", F.lit("</"))
    of = lambda *more: Window.partitionBy(*keys, *more).orderBy("pre")
    void = F.col("tag").isin(VOID)
    # level among equal names: a walk that stays at 0 for end tags without a start
    t = cut.withColumn("__end", ends).withColumn("__s", F.sum(F.when(void, 0).when(ends, -1).otherwise(1)).over(of("tag")))
    low = F.least(F.coalesce(F.min("__s").over(of("tag").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lit(0))
    t = t.withColumn("__level", F.when(void, -1).otherwise(F.col("__s") - low + F.col("__end").cast("int"))) \
        .where(~F.col("__end") | (F.col("__level") > 0))
    named = of("tag", "__level")
    t = t.withColumn("__own", F.when(~F.col("__end") & F.lead("__end").over(named) & ~void, F.lead("pre").over(named)))
    # depth among closed elements
    closed = F.col("__own").isNotNull()
    t = t.withColumn("__depth", F.sum(F.when(closed, 1).when(F.col("__end"), -1).otherwise(0)).over(of()))
    t = t.where(~F.col("__end")) \
        .withColumn("__around", F.last(F.when(closed, F.col("__own")), ignorenulls=True).over(of("__depth"))) \
        .withColumn("__outside", F.col("__depth") - F.when(closed, 1).otherwise(0))
    beside = F.when(F.col("tag").isin(IMPLIED_END), F.lead("pre").over(of("__outside", "tag")))
    around = F.when(F.col("__around") > F.col("pre"), F.col("__around")).otherwise(F.col("__n"))
    post = F.when(void, F.col("pre")).when(closed, F.col("__own")).otherwise(F.least(around, beside))
    return t.withColumn("post", post).drop("__end", "__s", "__level", "__own", "__depth", "__around", "__outside", "__n")


def nodes(pages: DataFrame, keys: Sequence[str], html: str = "html", dealt: bool = False) -> DataFrame:
    """One row per element: the key, ``pre``, ``post``, ``tag``,
    ``element_id``, ``classes`` and ``start_tag`` (with all attributes)."""
    t = _nest(_cut(pages, keys, html, dealt), keys).where(F.col("pre") > 0)
    classes = F.split(F.coalesce(attribute(F.col("__tag"), "class"), F.lit("")), r"[ \t\n\r\f]+")
    return t.select(*keys, "pre", "post", "tag", attribute(F.col("__tag"), "id").alias("element_id"),
                    F.array_remove(classes, "").alias("classes"), F.col("__tag").alias("start_tag"))


# -------------------------------------------------------------------- fields
@dataclass(frozen=True)
class Field:
    """What to take of a selector's elements: their text, or an attribute;
    of all of them or of the first ('' without one)."""
    selector: str
    attr: str | None = None
    many: bool = False


def _select(cut: DataFrame, keys: Sequence[str], fields: Mapping[str, Field], block: str | None) -> DataFrame:
    """Elements that a field selects, one row per element: ``pre``, ``post``,
    per field ``f<i>`` (selected) and ``v<i>`` (attribute), and ``__block``
    (the selected block around it, itself included)."""
    steps = {f"f{i}": parse_selector(f.selector) for i, f in enumerate(fields.values())}
    if block is not None:
        steps["__b"] = parse_selector(block)
    marks = [(s.matches(F.col("tag"), F.col("__tag")) & (F.col("pre") > 0)).alias(f"{n}_{k}") for n, ss in steps.items() for k, s in enumerate(ss)]
    values = [attribute(F.col("__tag"), f.attr).alias(f"v{i}") for i, f in enumerate(fields.values()) if f.attr]
    bare = F.regexp_extract("__tag", r"^</?[A-Za-z]", 0).alias("__tag")     # all that nesting needs of it
    t = _nest(cut.select(*keys, "__n", "pre", "tag", bare, *marks, *values), keys)
    before = Window.partitionBy(*keys).orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    inside = lambda mark: F.coalesce(F.max(F.when(F.col(mark), F.col("post"))).over(before) > F.col("pre"), F.lit(False))
    for n, ss in steps.items():
        for k in range(1, len(ss)):
            t = t.withColumn(f"{n}_{k}", F.col(f"{n}_{k}") & inside(f"{n}_{k - 1}"))
        t = t.withColumn(n, F.col(f"{n}_{len(ss) - 1}")).drop(*[f"{n}_{k}" for k in range(len(ss))])
    if block is not None:
        # a block inside another one is part of that
        t = t.withColumn("__b", F.col("__b") & ~inside("__b"))
        last = F.last(F.when(F.col("__b"), F.struct("pre", "post")), ignorenulls=True).over(before)
        t = t.withColumn("__around", last).withColumn("__block", F.when(F.col("__b"), F.col("pre"))
                                                      .when(F.col("__around.post") > F.col("pre"), F.col("__around.pre"))) \
            .where(F.col("__block").isNotNull()).drop("__around")
        # a field is looked for below its block
        for i in range(len(fields)):
            t = t.withColumn(f"f{i}", F.col(f"f{i}") & ~F.col("__b"))
    return t


def _value(i: int, f: Field, toks: Column) -> tuple[Column, Column]:
    """(aggregate, final value) of field ``i``; selected elements of a page or
    block are gathered in page order, then their tokens are read as text."""
    what = F.struct("pre", "post", *([F.col(f"v{i}").alias("v")] if f.attr else []))
    hit = F.when(F.col(f"f{i}"), what)
    got = F.col(f"a{i}")
    if f.attr:
        read = lambda e: F.coalesce(e["v"], F.lit(""))
    else:
        read = lambda e: H.strip_tags(F.array_join(F.slice(toks, e["pre"] + 1, e["post"] - e["pre"]), ""))
    if f.many:
        return F.sort_array(F.collect_list(hit)), F.coalesce(F.transform(got, read), F.array().cast("array<string>"))
    return F.min(hit), F.when(got.isNotNull(), read(got)).otherwise(F.lit(""))


def extract_fields(pages: DataFrame, keys: Sequence[str], fields: Mapping[str, Field | str], html: str = "html",
                   dealt: bool = False) -> DataFrame:
    """``pages`` with one column per field: a string, or an array with
    ``many``, in page order.  A plain string is a selector of many texts."""
    spec = {n: Field(f, many=True) if isinstance(f, str) else f for n, f in fields.items()}
    rows = pages if dealt else _deal(pages, keys, html)
    t = _select(_cut(rows, keys, html, True), keys, spec, None)
    parts = [_value(i, f, F.col("__toks")) for i, f in enumerate(spec.values())]
    any_hit = reduce(lambda a, b: a | b, [F.col(f"f{i}") for i in range(len(spec))])
    found = t.where(any_hit).groupBy(*keys).agg(*[a.alias(f"a{i}") for i, (a, _) in enumerate(parts)])
    joined = rows.join(found, list(keys), "left").withColumn("__toks", tokens(as_col(html)))
    return joined.select(*[F.col(c) for c in pages.columns if c not in spec],
                         *[v.alias(n) for n, (_, v) in zip(spec, parts)])


def extract_records(pages: DataFrame, keys: Sequence[str], block: str, fields: Mapping[str, Field], html: str = "html",
                    dealt: bool = False) -> DataFrame:
    """One row per element that ``block`` selects (outermost ones): the key,
    ``block_no`` in page order and the fields, looked for inside the block."""
    rows = pages if dealt else _deal(pages, keys, html)
    t = _select(_cut(rows, keys, html, True), keys, fields, block)
    parts = [_value(i, f, F.col("__toks")) for i, f in enumerate(fields.values())]
    aggs = [a.alias(f"a{i}") for i, (a, _) in enumerate(parts)]
    names = [f"a{i}" for i in range(len(parts))]
    found = t.groupBy(*keys, "__block").agg(*aggs)
    found = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__block", *names))).alias("__blocks"))
    joined = rows.select(*keys, as_col(html).alias("__html")).join(found, list(keys)) \
        .select(*keys, "__blocks", tokens(F.col("__html")).alias("__toks"))
    out = joined.select(*keys, "__toks", F.posexplode("__blocks").alias("block_no", "__r")) \
        .select(*keys, "block_no", "__toks", *[F.col(f"__r.{n}").alias(n) for n in names])
    return out.select(*keys, "block_no", *[v.alias(n) for n, (_, v) in zip(fields, parts)])
