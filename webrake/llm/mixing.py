"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a uniform 60-bit hash.  Per source the words are summed
by the top bits of that hash; the bucket in which the budget ends is found
from the cumulative histogram, and only that boundary bucket is summed again
by the next bits, level by level (nested thresholds).  A document is taken
when its hash lies below its source's threshold: a filter, no sort.

All work is DataFrame functions.  What is joined back is one row per source.

Defined results: a null text has size 0; null sources are one source, last in
the order; repeated rows have equal hashes and so share one decision; an
empty table gives an empty result; extra columns are kept, but for those
named like an added one, which are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webrake.llm.common import free_name, reliable

#: Hash bits refined per level, and levels (5 x 12 = 60 bits).
BITS, LEVELS = 12, 5
#: A per-source table of at most so many rows (about 100 bytes each) is broadcast.
BROADCAST_SOURCES = 50_000


def word_count(text: str | Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Per source ``_k``: ``source_size`` and ``target``.

    Targets follow the weights, sum to ``share`` times all sizes, and stop at
    ``most`` times the source's size; what stops is shared again by weight.
    That is a water level: with sources ordered by ``most * size / weight``,
    source i is full when the level of the sources from i on reaches its own
    ratio.  ``sizes``: (_k, source, source_size), one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("_w", w).withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    t = t.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_ratio", "_k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    t = t.withColumn("_total", F.lit(float(share)) * F.sum("source_size").over(everything)) \
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
                    / F.sum("_w").over(after))
    # the first source whose ratio is above its level fixes the level of the rest
    t = t.withColumn("_free", F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_k", "_level")))
                     .over(everything))
    full = F.col("_free").isNull() | (F.struct("_ratio", "_k") < F.struct("_free._ratio", "_free._k"))
    return t.select("_k", "source_size", F.when(full, F.col("_cap"))
                    .otherwise(F.col("_w") * F.col("_free._level")).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5,
                most: float = 2.0, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source") -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and
    ``taken`` (words the mix takes, ``size * copies``).

    Whole copies of a source are taken ``floor(target / source_size)`` times;
    the rest of the target goes to the documents below the hash threshold."""
    key = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col)))
    h = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col)), 64 - BITS * LEVELS)
    out_cols = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    kn, hn = free_name(docs, "_k"), free_name(docs, "_h")
    sized = docs.select(*out_cols, key.alias(kn), h.alias(hn), word_count(text_col).alias("size"))
    narrow = reliable(sized.select(F.col(kn).alias("_k"), F.col(source_col).alias("source"), F.col(hn).alias("_h"),
                                   "size"))
    per = reliable(targets(
        narrow.groupBy("_k").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")),
        weights, share, most))
    n_sources = per.count()
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = per.select("_k", "source_size", "target", whole.cast("long").alias("_whole"),
                       (F.col("target") - whole * F.col("source_size")).alias("_rest"),
                       F.lit(0).cast("long").alias("_prefix"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = narrow.join(F.broadcast(state) if n_sources <= BROADCAST_SOURCES else state, "_k") \
            .where(F.shiftright("_h", shift + BITS) == F.col("_prefix"))
        hist = inside.groupBy("_k", F.shiftright("_h", shift).alias("_b")).agg(F.sum("size").alias("_s"))
        run = Window.partitionBy("_k").orderBy("_b")
        hist = hist.withColumn("_upto", F.sum("_s").over(run))
        # the boundary: the first bucket that goes beyond what is left of the budget
        cut = hist.join(F.broadcast(state.select("_k", "_rest")) if n_sources <= BROADCAST_SOURCES
                        else state.select("_k", "_rest"), "_k") \
            .groupBy("_k").agg(
                F.min(F.when(F.col("_upto") > F.col("_rest"), F.struct("_b", "_upto", "_s"))).alias("_cut"),
                F.max("_b").alias("_last"))
        state = state.join(cut, "_k", "left")
        left = F.col("_rest") - (F.col("_cut._upto") - F.col("_cut._s"))
        last_level = level == LEVELS
        # at the last level the bucket itself goes in when that ends nearer the target
        more = F.when(left * 2 >= F.col("_cut._s"), F.lit(1)).otherwise(F.lit(0)) if last_level else F.lit(0)
        state = state.select(
            "_k", "source_size", "target", "_whole",
            F.when(F.col("_cut").isNull(), F.col("_rest")).otherwise(left).alias("_rest"),
            F.coalesce(F.col("_cut._b") + more, F.col("_last") + 1,
                       F.shiftleft(F.col("_prefix"), BITS)).cast("long").alias("_prefix"))
        state = reliable(state.coalesce(1))
    table = state.select(F.col("_k").alias(kn), "source_size", "target",
                         F.struct("_whole", "_prefix").alias(free_name(docs, "_cut")))
    cut = F.col(table.columns[-1])
    done = sized.join(F.broadcast(table) if n_sources <= BROADCAST_SOURCES else table, kn)
    copies = cut["_whole"] + F.when(F.col(hn) < cut["_prefix"], F.lit(1)).otherwise(F.lit(0))
    return done.withColumn("copies", F.least(copies, F.lit(int(most))).cast("long")) \
        .select(*out_cols, "size", F.col("source_size").cast("long"), "target", "copies",
                (F.col("size") * F.col("copies")).alias("taken"))
