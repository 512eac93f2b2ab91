"""Ordered dedupe, top-k, sort and slice.

DataFrames are unordered, so every operator here takes the ordinal columns
that stand for list order (``pos``, ``line_no``, ``doc_ord``) explicitly.

First-wins dedupe is an aggregation, not a window: ``min(struct(order...,
payload...))`` per key is computed partially on the map side, so a hot key
(one third of all rows) collapses to one row per input partition before the
shuffle.  Top-k per key uses ``row_number() <= k``, which Spark plans as a
partial ``WindowGroupLimit`` before the exchange and a final one after it,
so at most k rows per key and input partition are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webrake.functions.common import ColumnOrName, as_col
from webrake.session import checkpoint_dir

_KEY = "__k"
_BEST = "__best"


def _order_cols(order: Sequence[ColumnOrName]) -> list[Column]:
    return [as_col(o) for o in order]


def dedupe_first(df: DataFrame, keys: Sequence[ColumnOrName],
                 order: Sequence[ColumnOrName]) -> DataFrame:
    """Keep, per key, the row that comes first in ``order`` (ascending; use
    negated or struct columns for descending).  Keys may be expressions
    (e.g. ``lower(name)``); the output keeps the input's columns only."""
    cols = df.columns
    key_exprs = [as_col(k).alias(f"{_KEY}{i}") for i, k in enumerate(keys)]
    ords = [as_col(o).alias(f"__o{i}") for i, o in enumerate(order)]
    packed = F.struct(*ords, *[F.col(c) for c in cols])
    out = (df.groupBy(*key_exprs)
             .agg(F.min(packed).alias(_BEST))
             .select(*[F.col(f"{_BEST}.{c}").alias(c) for c in cols]))
    return out


def dedupe_first_ci(df: DataFrame, key: str, order: Sequence[ColumnOrName],
                    drop_blank: bool = True) -> DataFrame:
    """Case-insensitive first-wins dedupe of targets; null/empty keys are
    dropped first (they are not targets)."""
    if drop_blank:
        df = df.where(F.col(key).isNotNull() & (F.col(key) != ""))
    return dedupe_first(df, [F.lower(F.col(key))], order)


def dedupe_then_filter(df: DataFrame, keys: Sequence[ColumnOrName],
                       order: Sequence[ColumnOrName], predicate: Column) -> DataFrame:
    """Global first-wins dedupe *before* filtering: a key first seen in a
    rejected row hides later acceptable ones."""
    return dedupe_first(df, keys, order).where(predicate)


def topk_per_key(df: DataFrame, keys: Sequence[ColumnOrName],
                 order: Sequence[Column], k: int = 3,
                 rank_col: str | None = None) -> DataFrame:
    """Rows ranked 1..k per key by ``order`` (a stable ranking must end with
    a unique ordinal).  ``rank_col`` keeps the rank."""
    w = Window.partitionBy(*[as_col(x) for x in keys]).orderBy(*order)
    name = rank_col or "__rank"
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out if rank_col else out.drop(name)


def score_topk(df: DataFrame, keys: Sequence[ColumnOrName], score: ColumnOrName,
               pos: ColumnOrName, k: int = 3, keep: Column | None = None,
               rank_col: str | None = "rank") -> DataFrame:
    """Stable sort by score descending (ties by original position), then the
    ``keep`` filter, then top-k per key."""
    if keep is not None:
        df = df.where(keep)
    return topk_per_key(df, keys, [as_col(score).desc(), as_col(pos).asc()], k, rank_col)


def sort_nulls_last(df: DataFrame, col: ColumnOrName, ord_col: ColumnOrName) -> DataFrame:
    """Global sort ascending with nulls last, original order breaking ties
    (range-partitioned sort; never a single-partition window)."""
    return df.orderBy(as_col(col).asc_nulls_last(), as_col(ord_col).asc())


#: Ends up to this many rows are taken by a bounded top-k.
SMALL_SLICE = 10_000


def with_positions(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """``df`` in ``order`` with each row's position (from 0).

    A range-partitioned sort numbers the rows of every partition; the counts
    per partition (one row each) are summed up, and a row's position is its
    partition's start plus its own number.  No task holds more than a range.
    The sorted rows are checkpointed, since a second sort could cut the ranges
    or break ties otherwise."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    rows = df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()).checkpoint()
    part, own = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    counts = sorted(rows.groupBy(part.alias("p")).count().collect())       # one row per partition
    starts, so_far = [], 0
    for p, n in counts:
        starts.append((p, so_far))
        so_far += n
    table = spark.createDataFrame(starts, "__p long, __start long")
    placed = rows.join(F.broadcast(table), part == F.col("__p"))
    return placed.select(*df.columns, (F.col("__start") + own).alias(name))


def slice_rows(df: DataFrame, order: Sequence[Column], offset: int = 0,
               limit: int = 0) -> DataFrame:
    """Rows with ``offset <= i < limit`` in ``order``; ``limit`` is an
    absolute end and 0 means no end.

    A small end is a bounded top-k (at most ``SMALL_SLICE`` rows reach one
    task).  Otherwise rows get their positions in a range-partitioned sort
    (:func:`with_positions`): neither the rows skipped nor those taken meet
    in one task, and ties are cut where the sort put them."""
    if 0 < limit <= SMALL_SLICE:
        return df.orderBy(*order).limit(limit).offset(offset)
    if offset <= 0 and limit <= 0:
        return df.orderBy(*order)
    placed = with_positions(df, order, "__position")
    keep = F.col("__position") >= offset
    return placed.where(keep & (F.col("__position") < limit) if limit > 0 else keep).drop("__position")


def page_cap(df: DataFrame, page_no: ColumnOrName, page_limit: int = 3) -> DataFrame:
    """Keep results from the first ``page_limit`` result pages (0-based)."""
    return df.where(as_col(page_no) < page_limit)
