"""Bad-record quarantine: parse answers into records and route what does
not parse into a quarantine table, without stopping the job.

Both outputs come from one parsed projection, so the answer text is parsed
once; callers that write both should persist it (``checkpoint``) or write
the parsed table once and read it back.  ``accepted + quarantined = input``
holds by construction (the split predicate and its negation, null-safe).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrake.functions import records as RC
from webrake.functions.common import strip_ws


def explode_jsonl_block(df: DataFrame, keys: Sequence[str], block: str, schema: str) -> DataFrame:
    """One row per record of a JSON-lines block with ``status = 'ok'`` and
    ``line_no``; a block with a bad line gives one ``'bad'`` row, an empty
    block one ``'empty'`` row (record fields null)."""
    recs = RC.parse_jsonl_block(F.col(block), schema)
    st = (F.when(strip_ws(block) == "", F.lit("empty"))
          .when(recs.isNull(), F.lit("bad")).otherwise(F.lit("ok")))
    parsed = df.select(*keys, st.alias("status"), recs.alias("__recs"))
    ex = parsed.select(*keys, "status",
                       F.posexplode_outer("__recs").alias("line_no", "__r"))
    fields = ex.schema["__r"].dataType.fieldNames()
    return ex.select(*keys, "status", "line_no", *[F.col("__r")[f].alias(f) for f in fields])


def parse_json_answers(df: DataFrame, answer: str, schema: str, fence: str,
                       observation=None) -> DataFrame:
    """Add ``rec`` (the first fenced block parsed strictly, null when it is
    not strict JSON) and ``status`` ('ok' / 'bad') in one pass.

    With a ``pyspark.sql.Observation`` the counts of accepted and
    quarantined answers are collected while the first action runs (no
    extra counting job): ``observation.get`` -> ``{"ok": n, "bad": m}``."""
    block = RC.fenced_first(F.col(answer), fence)
    parsed = df.withColumn("rec", RC.parse_json_record(block, schema))
    parsed = parsed.withColumn("status", F.when(F.col("rec").isNotNull(), F.lit("ok"))
                               .otherwise(F.lit("bad")))
    if observation is not None:
        parsed = parsed.observe(observation, F.count_if(F.col("status") == "ok").alias("ok"),
                                F.count_if(F.col("status") == "bad").alias("bad"))
    return parsed


def error_reason(answer: str, fence: str) -> Column:
    """Why an answer gives no record: there is no fenced block, the block is
    empty, or it is not strict JSON (also where it is not an object)."""
    block = RC.fenced_first(F.col(answer), fence)
    return F.when(block.isNull(), F.lit("no fenced block")).when(block == "", F.lit("empty block")) \
        .otherwise(F.lit("not one strict JSON object"))


def split_json_records(df: DataFrame, answer: str, schema: str, fence: str,
                       observation=None) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine): the first fenced block of ``answer`` parsed
    strictly as one JSON object into ``rec``; failures keep the answer and
    the reason (``error``).  When both outputs are written, write the parsed
    table once (or use ``parse_json_answers`` and split on ``status``)."""
    parsed = parse_json_answers(df, answer, schema, fence, observation)
    good = parsed.where(F.col("status") == "ok").drop("status")
    bad = parsed.where(F.col("status") == "bad").drop("rec", "status") \
        .withColumn("error", error_reason(answer, fence))
    return good, bad
