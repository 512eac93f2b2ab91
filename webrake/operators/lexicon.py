"""Lexicon and vocabulary operators for lexicons held as tables.

Small lexicons given as Python lists are inlined as array literals
(``functions.text.any_token_in``), when the caller asks for that.  A lexicon
table is joined: distinct tokens are exploded and semi-joined against it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrake.functions.common import tokens

def any_token_in_table(df: DataFrame, id_col: str, text_col: str,
                       lexicon: DataFrame, word_col: str = "word",
                       out_col: str = "hit", last_only: bool = False) -> DataFrame:
    """Add ``out_col``: some (or, with ``last_only``, the last) lowercased
    whitespace token of ``text_col`` is a lexicon word (null and blank texts:
    false).

    The answer depends on the text alone, so each different text is looked up
    once, keyed by its SHA-256: its distinct tokens are exploded and
    semi-joined with the lexicon, and the texts that hit are joined back.
    Repeated or null ids (``id_col`` is not used as a key) are therefore
    safe, and the plan is the same at every size; broadcasts are left to
    adaptive execution."""
    words = lexicon.select(F.lower(F.col(word_col)).alias("__w")).where(F.col("__w").isNotNull()).distinct()
    keyed = df.withColumn("__t", F.sha2(F.col(text_col), 256))
    texts = df.select(F.sha2(F.col(text_col), 256).alias("__t"), F.lower(F.col(text_col)).alias("__x")) \
        .where(F.col("__x").isNotNull())
    if last_only:
        toks = texts.select("__t", F.try_element_at(tokens("__x"), F.lit(-1)).alias("__w")).distinct()
    else:
        toks = texts.select("__t", F.explode(F.array_distinct(tokens("__x"))).alias("__w")).distinct()
    hits = toks.join(words, "__w", "left_semi").select("__t").distinct().withColumn("__hit", F.lit(True))
    return keyed.join(hits, "__t", "left") \
        .withColumn(out_col, F.coalesce(F.col("__hit"), F.lit(False))).drop("__t", "__hit")


def vocab_violations(arr, vocab: list[str]):
    """Labels of ``arr`` outside the closed vocabulary (distinct)."""
    return F.array_except(arr, F.array(*[F.lit(v) for v in vocab]))
