"""Screening by large word lists (T13, T15 beyond a ``CASE`` chain).

A list of 100,000 substrings cannot be tested one by one on every text.  Each
pattern is filed under its rarest q-gram (the one that fewest patterns hold);
a text meets a pattern only if it holds that q-gram, and only then is
``contains`` tested.  Patterns shorter than q are filed under themselves.

Texts are dealt by their key, as many tasks as their bytes ask for: cutting grams
takes far longer than reading them, and a scan may be one task.  The index is
broadcast when its measured size allows.  A larger one is joined by q-gram on (key, q-gram) pairs, and the
texts come back for the candidates alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrake.functions.common import as_col
from webrake.session import checkpoint_dir, text_tasks

#: Length of the grams (of 3 most texts hold nearly all, and each costs a search), and how many patterns (about 100 bytes each) are broadcast.
Q = 5
BROADCAST_PATTERNS = 200_000
#: Text of one task.
TASK_BYTES = 4 << 20


def grams(text: Column, size: int) -> Column:
    """All substrings of ``size`` characters, repeats included."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))"), 1) if size else F.array(F.lit(""))


def pattern_index(rules: DataFrame, word: str = "word", order: tuple[str, ...] = ("accept", "pos")) -> DataFrame:
    """``(gram, word, rank)``: each word once, with its first place in the
    list (``accept`` rules before the others), filed under its rarest gram."""
    flag, pos = order
    rank = F.struct((~F.col(flag)).alias("deny"), F.col(pos).alias("pos"), F.col(word).alias("word"))
    words = rules.where(F.col(word).isNotNull()).groupBy(F.col(word).alias("word")).agg(F.min(rank).alias("rank"))
    own = F.when(F.length("word") < Q, F.array("word")).otherwise(F.array_distinct(grams(F.col("word"), Q)))
    filed = words.select("word", "rank", F.explode(own).alias("gram"))
    held = filed.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = filed.join(held, "gram").groupBy("word").agg(F.min(F.struct("n", "gram")).alias("g"), F.first("rank").alias("rank"))
    return rarest.select(F.col("g.gram").alias("gram"), "word", "rank")


def screen_table(df: DataFrame, key: str, text: str, rules: DataFrame,
                 broadcast_patterns: int = BROADCAST_PATTERNS) -> DataFrame:
    """``key, accept, rule`` of every row of ``df``: what
    :func:`webrake.functions.text.screen` says, for rules in a table
    ``(word, accept, pos)``.  Accepting words go before the others, in the order
    of ``pos`` (ties by word).  ``key`` must name a row."""
    checkpoint_dir(df.sparkSession)
    index = pattern_index(rules).checkpoint()
    n, sizes = index.count(), [r[0] for r in index.select(F.length("gram")).distinct().collect()]   # Q + 1 at most
    body = F.coalesce(as_col(text), F.lit(""))
    if not n:
        return df.select(key, F.lit(True).alias("accept"), F.lit(None).cast("string").alias("rule"))
    # outer: of a plain explode Spark infers a filter, which would cut the grams before the texts are dealt
    every = F.array_distinct(F.concat(*[grams(F.col("__text"), k) for k in sizes]))
    texts = df.select(F.col(key).alias("__key"), body.alias("__text")) \
        .repartition(text_tasks(df, text, TASK_BYTES), "__key")
    if n <= broadcast_patterns:
        met = texts.select("__key", "__text", every.alias("__grams")) \
            .select("__key", "__text", F.explode_outer("__grams").alias("gram")).join(F.broadcast(index), "gram")
    else:
        met = texts.select("__key", F.explode_outer(every).alias("gram")).join(index, "gram").drop("gram")
        met = met.join(texts.withColumnRenamed("__key", "__id"), F.col("__key").eqNullSafe(F.col("__id")))
    first = met.where(F.contains(F.col("__text"), F.col("word"))).groupBy("__key").agg(F.min("rank").alias("__first"))
    out = df.select(key).join(first, F.col(key).eqNullSafe(F.col("__key")), "left")
    return out.select(key, (F.col("__first").isNull() | ~F.col("__first.deny")).alias("accept"),
                      F.col("__first.word").alias("rule"))
