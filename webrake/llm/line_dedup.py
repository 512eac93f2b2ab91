"""Site-relative boilerplate lines.

Per host, the pages containing a line are divided by the host's page total, and
lines whose share surely exceeds a ratio are dropped.  "Surely" is one rule at
every size: a line stands on two pages or more, and the lower bound of the
Wilson interval of its share (95 %) lies above the ratio, so a host of few
pages loses only lines that most of them hold.

Copies are one page, else a text copied often would make its own lines look
like boilerplate.  Exact copies are one by their text.  Near copies are found
among the pages that would lose more than half of their characters: those
that share a line at least as long as the third longest that they would lose
are one group.  Such a group is near copies, unless it is a *template*: five
pages or more, at least half as many as a page has common lines, of which (by
characters) four fifths stand on every page of the group.  Copies that were
edited each in a place of its own are not like that: with as many copies as
half the lines, at most three fifths of the lines are untouched in all of
them.  Near copies that all differ in the same line only cannot be told from
a template, and are taken for one.  Pages of a template count each for itself
(a menu that is longer than the article goes), near copies count as one page.

Lines are compared by a 64-bit hash of the trimmed line, so what is shuffled
is ``(host, line hash, page hash, size)``, de-duplicated map-side first.  The
drop list of a host is bounded: at most ``mean lines per page / ratio`` lines.
It is broadcast when its measured size is small and joined on the host
otherwise.

Defined results: a null text stays null, an empty text stays empty; blank
lines are never dropped; a null host is a host of its own; repeated rows are
one page for the counts and each keep their row; ties in length link by all
of the lines; a very long text is one page like any other; a text whose lines
are all boilerplate becomes empty; an empty table gives an empty result; extra
columns are kept, but for ``n_lines`` and ``n_dropped``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrake.llm.common import free_name, reliable
from webrake.llm.components import components

#: Drop lists of at most so many lines in all (8 bytes each) are broadcast.
BROADCAST_LINES = 1_000_000
#: Standard deviations of the Wilson interval.
Z = 1.96
#: A template has so many pages at least, and so great a part of its common text on all of them.
TEMPLATE_PAGES, TEMPLATE_SHARE = 5, 0.8
_BLANK = " \t\n\x0b\x0c\r"


def _line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line, F.lit(_BLANK)))


def _host_key(host: str) -> Column:
    return F.when(F.col(host).isNull(), F.lit("n")).otherwise(F.concat(F.lit("h"), F.col(host).cast("string")))


def often(n: Column, total: Column, ratio: float) -> Column:
    """Whether ``n`` of ``total`` pages are surely more than ``ratio`` of them."""
    n, total = n.cast("double"), total.cast("double")
    share, zz = n / total, Z * Z
    low = (share + zz / (2 * total) - Z * F.sqrt(share * (1 - share) / total + zz / (4 * total * total))) / (1 + zz / total)
    return (n >= 2) & (low > ratio)


def _near_copies(lines: DataFrame, listed: DataFrame) -> DataFrame:
    """``(host_key, page, root)`` of the pages that are near copies.

    ``lines``: (host_key, page, line_key, size); ``listed``: the common ones."""
    common = reliable(lines.join(listed, ["host_key", "line_key"], "left")
                      .groupBy("host_key", "page")
                      .agg(F.sum("size").alias("all"), F.sum(F.when(F.col("listed"), F.col("size"))).alias("lost"),
                           F.collect_list(F.when(F.col("listed"), F.struct("size", "line_key"))).alias("common"))
                      .where("2 * lost > all").select("host_key", "page", "common"))
    node = F.xxhash64("host_key", "page")
    by_size = F.sort_array("common.size", asc=False)
    third = F.element_at(by_size, F.least(F.size("common"), F.lit(3)))
    links = common.select("host_key", node.alias("a"), F.explode("common").alias("l"), third.alias("third")) \
        .where("l.size >= third").select("a", F.xxhash64("host_key", "l.line_key", F.lit("line")).alias("b"))
    groups = common.select("host_key", "page", "common", node.alias("node")).join(components(links), "node")
    held = groups.select("host_key", "root", "page", F.explode("common").alias("l"))
    per_line = held.groupBy("host_key", "root", "l.line_key").agg(F.first("l.size").alias("size"), F.count("*").alias("k"))
    pages = groups.groupBy("host_key", "root").agg(F.count("*").alias("m"))
    # a line stands on every page of its group or not
    shape = per_line.join(pages, ["host_key", "root"]).groupBy("host_key", "root").agg(
        F.first("m").alias("m"), F.sum("k").alias("common"), F.sum(F.col("size") * F.col("k")).alias("chars"),
        F.sum(F.when(F.col("k") == F.col("m"), F.col("size") * F.col("k")).otherwise(0)).alias("fixed"))
    template = (F.col("m") >= TEMPLATE_PAGES) & (2 * F.col("m") * F.col("m") >= F.col("common")) \
        & (F.col("fixed") >= TEMPLATE_SHARE * F.col("chars"))
    return reliable(groups.select("host_key", "page", "root")
                    .join(shape.where(~template).select("host_key", "root"), ["host_key", "root"], "left_semi"))


def boilerplate_lines(docs: DataFrame, ratio: float = 0.05, text_col: str = "text",
                      host_col: str = "source") -> DataFrame:
    """``(host_key, line_key, n_pages, host_pages)`` of the lines whose share
    of their host's pages surely exceeds ``ratio``, copies being one page."""
    page = docs.select(_host_key(host_col).alias("host_key"),
                       F.xxhash64(text_col).alias("page"), F.col(text_col).alias("_t"))
    totals = page.groupBy("host_key", "page").count().groupBy("host_key").agg(F.count("*").alias("host_pages"))
    lines = page.where(F.col("_t").isNotNull()) \
        .select("host_key", "page", F.explode(F.split("_t", "\n")).alias("line")) \
        .where(F.trim("line", F.lit(_BLANK)) != "") \
        .select("host_key", "page", _line_key(F.col("line")).alias("line_key"),
                F.length(F.trim("line", F.lit(_BLANK))).alias("size")).distinct()
    above = often(F.col("n_pages"), F.col("host_pages"), ratio)
    listed = reliable(lines.groupBy("host_key", "line_key").agg(F.count("*").alias("n_pages"))
                      .join(totals, "host_key").where(above).select("host_key", "line_key", F.lit(True).alias("listed")))
    copies = _near_copies(lines, listed)
    node = F.xxhash64("host_key", "page")
    fewer = copies.groupBy("host_key").agg((F.count("*") - F.countDistinct("root")).alias("fewer"))
    totals = totals.join(fewer, "host_key", "left") \
        .select("host_key", (F.col("host_pages") - F.coalesce("fewer", F.lit(0))).alias("host_pages"))
    counts = lines.join(listed, ["host_key", "line_key"]).join(copies, ["host_key", "page"], "left") \
        .select("host_key", "line_key", F.coalesce("root", node).alias("unit")).distinct() \
        .groupBy("host_key", "line_key").agg(F.count("*").alias("n_pages"))
    return counts.join(totals, "host_key").where(above)


def drop_boilerplate(docs: DataFrame, ratio: float = 0.05, text_col: str = "text",
                     host_col: str = "source") -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text_col`` and, added,
    ``n_lines`` and ``n_dropped``."""
    lines = reliable(boilerplate_lines(docs, ratio, text_col, host_col).select("host_key", "line_key"))
    n = lines.count()
    drops = lines.groupBy("host_key").agg(F.collect_list("line_key").alias("drops"))
    key, listed_as, kept_as = (free_name(docs, x) for x in ("_host_key", "_drops", "_kept"))
    out = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    drops = drops.select(F.col("host_key").alias(key), F.col("drops").alias(listed_as))
    joined = docs.withColumn(key, _host_key(host_col)) \
        .join(F.broadcast(drops) if n <= BROADCAST_LINES else drops, key, "left")
    text, listed = F.col(text_col), F.col(listed_as)
    parts = F.split(text, "\n")
    kept = F.filter(parts, lambda x: (F.trim(x, F.lit(_BLANK)) == "") | ~F.array_contains(listed, _line_key(x)))
    slim = joined.withColumn(kept_as, F.when(listed.isNull(), parts).otherwise(kept))
    return slim.select(
        *[F.array_join(kept_as, "\n").alias(c) if c == text_col else F.col(c) for c in out],
        F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long").alias("n_lines"),
        (F.coalesce(F.size(F.split(text, "\n")), F.lit(0))
         - F.coalesce(F.size(kept_as), F.lit(0))).cast("long").alias("n_dropped"))
