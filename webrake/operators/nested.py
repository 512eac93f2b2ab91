"""Nested lists and per-entity aggregates.

Two forms exist for list operators: a ``Column`` form for lists held inside
one record (bounded by the record) and a table form for child rows, which
is an aggregation with map-side partial combine.  Per-entity choices
("largest document", "longest list", "first of a category") are
``min(struct(...))`` aggregates rather than windows, so a hot entity is
combined before the shuffle instead of being sorted in one task.  Nothing
collects an unbounded group into an array: the only ``collect_list`` below
runs after a top-k cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webrake.functions.common import ColumnOrName, as_col, lines, strip_ws


# ---------------------------------------------------------------- A1
def explode_filter(df: DataFrame, arr: ColumnOrName, parent_cols: Sequence[str],
                   keep=None, pos_col: str = "pos", value_col: str = "value") -> DataFrame:
    """One row per list element with its parent columns; ``keep`` is a
    function of the element Column (inner filter)."""
    out = df.select(*parent_cols, F.posexplode(as_col(arr)).alias(pos_col, value_col))
    if keep is not None:
        out = out.where(keep(F.col(value_col)))
    return out


# ---------------------------------------------------------------- A2
def weighted_count(arr: ColumnOrName, flag_field: str, hit: int = 10, miss: int = 1) -> Column:
    """Sum over a list of structs: ``hit`` per flagged element, else ``miss``
    (null/absent flag counts as not flagged); null list counts as empty."""
    return F.aggregate(F.coalesce(as_col(arr), F.array()), F.lit(0).cast("bigint"),
                       lambda acc, x: acc + F.when(F.coalesce(x[flag_field], F.lit(False)), hit)
                       .otherwise(miss).cast("bigint"))


def weighted_count_rows(children: DataFrame, keys: Sequence[str], flag: Column,
                        hit: int = 10, miss: int = 1, out_col: str = "score") -> DataFrame:
    """Table form of :func:`weighted_count` over child rows."""
    w = F.when(F.coalesce(flag, F.lit(False)), F.lit(hit)).otherwise(F.lit(miss)).cast("bigint")
    return children.groupBy(*keys).agg(F.sum(w).alias(out_col))


# ---------------------------------------------------------------- A3 / A4
def pick_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
               payload: Sequence[str], prefix: str = "") -> DataFrame:
    """Per key, the payload of the row first in ``order`` (ascending);
    ``min(struct)`` with partial aggregation."""
    packed = F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)],
                      *[F.col(p) for p in payload])
    agg = df.groupBy(*keys).agg(F.min(packed).alias("__m"))
    return agg.select(*keys, *[F.col(f"__m.{p}").alias(prefix + p) for p in payload])


def largest_doc(docs: DataFrame, keys: Sequence[str], size: str, ord_col: str,
                payload: Sequence[str]) -> DataFrame:
    """Base document per entity: largest ``size``, ties by document order."""
    return pick_first(docs, keys, [-F.col(size), F.col(ord_col)], payload)


def longest_list(docs: DataFrame, keys: Sequence[str], size_col: str,
                 doc_order: Sequence[Column], payload: Sequence[str],
                 prefix: str = "") -> DataFrame:
    """Per entity, the document with the longest list (strictly longer
    replaces, so the first in document order wins ties).  Null sizes count
    as 0; when every list is empty the chosen payload is null."""
    size = F.coalesce(F.col(size_col), F.lit(0))
    d = docs.withColumn("__size", size)
    picked = pick_first(d, keys, [-F.col("__size"), *doc_order], ["__size", *payload], prefix)
    out = picked.withColumnRenamed(prefix + "__size", prefix + "size")
    for p in payload:
        out = out.withColumn(prefix + p, F.when(F.col(prefix + "size") > 0, F.col(prefix + p)))
    return out


def longest_lists(docs: DataFrame, keys: Sequence[str], lists: dict[str, str],
                  doc_order: Sequence[Column], payload: Sequence[str]) -> DataFrame:
    """:func:`longest_list` of several lists at once (``lists``: prefix ->
    size column), each chosen independently, in one aggregation."""
    sizes = {p: F.coalesce(F.col(c), F.lit(0)) for p, c in lists.items()}
    agg = docs.groupBy(*keys).agg(*[
        F.min(F.struct((-n).alias("less"), *[o.alias(f"o{i}") for i, o in enumerate(doc_order)],
                       n.alias("size"), *[F.col(c) for c in payload])).alias(p) for p, n in sizes.items()])
    return agg.select(*keys, *[c for p in lists for c in (
        F.col(p)["size"].alias(f"{p}size"),
        *[F.when(F.col(p)["size"] > 0, F.col(p)[x]).alias(f"{p}{x}") for x in payload])])


# ---------------------------------------------------------------- A5
def rollup_first_k(df: DataFrame, keys: Sequence[str], pos: str, value: str,
                   k: int = 3, sep: str = "\r\n", keep: Column | None = None,
                   out_col: str = "values") -> DataFrame:
    """First k values per key in original order, joined with ``sep``.
    The top-k cut (partial ``WindowGroupLimit``) runs before any collection,
    so each collected list has at most k elements."""
    from webrake.operators.rank import topk_per_key
    if keep is not None:
        df = df.where(keep)
    top = topk_per_key(df.select(*keys, pos, value), keys, [F.col(pos)], k)
    return top.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, value))),
                                 lambda s: s[value]), sep).alias(out_col))


# ---------------------------------------------------------------- A6
def first_per_category(df: DataFrame, key: str, pos: str, value: str,
                       words: Sequence[str]) -> DataFrame:
    """For each word in order, the first value (by ``pos``) containing it,
    where a value taken by an earlier word is not seen by later ones (an
    ``if / elif`` chain over the list with a "not yet found" guard).

    One pass: at most i positions are taken before word i, so its pick is
    among its first i + 1 positions.  Those are cut by a partial
    ``WindowGroupLimit`` per (key, word); the picks are then resolved on one
    short list per key.  Null keys are one group."""
    hits = F.filter(F.array(*[F.when(F.col(value).contains(w), F.lit(i)) for i, w in enumerate(words)]),
                    lambda i: i.isNotNull())
    # a row without any word keeps its key in the result
    long = df.select(F.col(key).alias("k"), F.col(pos).alias("p"), F.col(value).alias("v"),
                     F.explode_outer(hits).alias("w"))
    nth = Window.partitionBy("k", "w").orderBy(F.col("p").asc_nulls_first())
    cut = long.withColumn("r", F.dense_rank().over(nth)).where(F.col("r") <= len(words)) \
        .where(F.col("w").isNotNull() & (F.col("r") <= F.col("w") + 1) | (F.col("r") == 1))
    # rows that share a position: the smallest value stands for it
    short = cut.groupBy("k", "w", "p").agg(F.min("v").alias("v"))
    found = short.groupBy("k").agg(F.collect_list(F.struct("w", "p", "v")).alias("found"))
    for i in range(len(words)):
        mine = F.filter("found", lambda x: x["w"] == i)
        for j in range(i):      # positions that earlier words took are not seen
            mine = F.filter(mine, lambda x: ~F.coalesce(x["p"] == F.col(f"pick_{j}.p"), F.lit(False)))
        found = found.withColumn(f"pick_{i}", F.array_min(
            F.transform(mine, lambda x: F.struct(x["p"].alias("p"), x["v"].alias("v")))))
    return found.select(F.col("k").alias(key), *[F.col(f"pick_{i}.v").alias(f"first_{i}") for i in range(len(words))])


# ---------------------------------------------------------------- A7
def display_width(c: ColumnOrName, cap: int | None = None) -> Column:
    """Longest line of the stripped text (0 when blank), clamped to ``cap``.
    Null prints as ``None``."""
    s = strip_ws(F.coalesce(as_col(c).cast("string"), F.lit("None")))
    w = F.coalesce(F.array_max(F.transform(lines(s), lambda x: F.length(x))), F.lit(0))
    w = F.when(s == "", F.lit(0)).otherwise(w)
    return F.least(w, F.lit(cap)) if cap is not None else w


def column_widths(df: DataFrame, cap: int | None = None) -> DataFrame:
    """(column, width): per column the widest value, at least the header
    length, plus one.  Columns are stacked into (column, value) rows first,
    so one small width expression runs per value (codegen-sized) and the
    max is a partial aggregation over a handful of keys."""
    cols = df.columns
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        for c in cols])).alias("__kv")).select("__kv.column", "__kv.value")
    widths = stacked.groupBy("column").agg(F.max(display_width(F.col("value"), cap)).alias("w"))
    headers = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(len(c)))])
    return widths.select("column", (F.greatest(F.col("w"), headers[F.col("column")]) + 1)
                         .cast("bigint").alias("width"))


# ---------------------------------------------------------------- A8
def surrogate_id(*cols: ColumnOrName, deterministic: bool = True) -> Column:
    """Record id: SHA-256 of the key columns (tested form) or a random UUID."""
    if not deterministic:
        return F.expr("uuid()")
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(as_col(c).cast("string"), F.lit("")) for c in cols]), 256)
