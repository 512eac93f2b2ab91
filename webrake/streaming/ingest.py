"""Incremental ingest: new records only, exactly once per key across runs.

A file-source stream with ``trigger(availableNow=True)`` picks up the files
that arrived since the last run (the checkpoint remembers which), and a
``foreachBatch`` sink

1. keeps the first record per key inside the batch (ordered first-wins
   dedupe, a partial aggregation), written once to a scratch table,
2. anti-joins what other runs and earlier batches wrote, on the key: the
   target lies in hash buckets of the key (:mod:`webrake.sources.keystore`), and
   only the buckets that the batch touches are read,
3. writes the survivors to ``target/run=R/batch_id=N/key_bucket=B`` with
   overwrite, where the run id R lies with the checkpoint.

Step 3 makes a replayed batch idempotent: a retry after a lost executor or
driver rewrites the same folder, and step 2 only reads folders of earlier
batches, so the replay sees exactly what the first attempt saw.

:func:`ingest_bounded` is the form with bounded state for keys that may be
forgotten after a delay (``dropDuplicatesWithinWatermark``); there "once per
key" holds within the delay, not across all runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webrake.operators.rank import dedupe_first
from webrake.session import delete_path
from webrake.sources import keystore as KS


def _run_of(spark: SparkSession, checkpoint: str) -> str:
    """The run id kept with the checkpoint; a new checkpoint is a new run, so
    its batch numbers never overwrite those of an earlier one."""
    note = KS.read_note(spark, f"{checkpoint}/ingest-run")
    if note is None:
        note = {"run": uuid.uuid4().hex}
        KS.write_note(spark, f"{checkpoint}/ingest-run", note)
    return note["run"]


def _target_before(spark: SparkSession, target: str, run: str, batch_id: int, rows: DataFrame) -> DataFrame:
    # the schema is given: a folder that a failed first batch left empty has none
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != KS.BUCKET],
                           T.StructField("run", T.StringType()), T.StructField("batch_id", T.LongType()),
                           T.StructField(KS.BUCKET, T.IntegerType())])
    return spark.read.schema(schema).parquet(target) \
        .where((F.col("run") != run) | (F.col("batch_id") < batch_id))


def new_rows(batch: DataFrame, batch_id: int, target: str, keys: Sequence[str], order: Sequence[str],
             run: str = "0", buckets: int = KS.BUCKETS) -> tuple[DataFrame, int, str]:
    """First record per key of the batch, minus stored keys; the target's
    bucket count; and the scratch table that the result reads."""
    spark = batch.sparkSession
    n = KS.bucket_count(spark, target, keys, buckets)
    staged, touched, few, path = KS.stage(dedupe_first(batch, list(keys), list(order)), keys, n)
    before = _target_before(spark, target, run, batch_id, staged)
    return KS.anti_keys(staged, KS.touched_keys(before, keys, touched, few), keys), n, path


def process_batch(batch: DataFrame, batch_id: int, target: str, keys: Sequence[str], order: Sequence[str],
                  run: str = "0", buckets: int = KS.BUCKETS) -> None:
    """One micro-batch: first record per key inside the batch, minus keys
    already written by other runs or *earlier* batches (a null key is a key),
    written to ``run=R/batch_id=N`` with overwrite (replaying the batch
    rewrites the same folder)."""
    rows, n, path = new_rows(batch, batch_id, target, keys, order, run, buckets)
    KS.write_keyed_rows(rows, f"{target}/run={run}/batch_id={batch_id}", n)
    delete_path(batch.sparkSession, path)


def ingest_new(spark: SparkSession, source: str, schema: str, target: str,
               checkpoint: str, keys: Sequence[str], order: Sequence[str],
               fmt: str = "parquet", max_files_per_trigger: int | None = None,
               every: str | None = None):
    """Incremental ingest of the files under ``source`` into ``target``.

    By default one pass over the files that arrived since the last run
    (``availableNow``) and returns when done.  With ``every`` (for example
    ``"5 minutes"``) it keeps running on a processing-time trigger and the
    streaming query is returned (stop it with ``.stop()``); both modes share
    the checkpoint, so they can be mixed across runs."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source)
    run = _run_of(spark, checkpoint)
    writer = (stream.writeStream
              .foreachBatch(lambda b, i: process_batch(b, i, target, keys, order, run))
              .option("checkpointLocation", checkpoint))
    if every:
        return writer.trigger(processingTime=every).start()
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    return None


def ingest_bounded(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str,
                   keys: Sequence[str], event_time: str, delay: str = "1 day", fmt: str = "parquet",
                   max_files_per_trigger: int | None = None, every: str | None = None):
    """Ingest with bounded state: a record is dropped when its key came within
    ``delay`` of event time before.  A key's state goes once the watermark (the
    latest event time less ``delay``) has passed it by ``delay``; from then on the
    key may come again.  So memory follows the keys of one delay, not of all time.

    ``event_time`` may be ``TIMESTAMP_NTZ`` (read in the session's time zone).
    Records without one have no place in event time and are left out, and so
    are late ones, older than the watermark.  The file sink commits each micro-batch once, and a restart goes
    on from the checkpoint's state."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source).withColumn("__at", F.col(event_time).cast("timestamp"))
    once = stream.where(F.col("__at").isNotNull()).withWatermark("__at", delay).dropDuplicatesWithinWatermark(list(keys)).drop("__at")
    writer = once.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target)
    if every:
        return writer.trigger(processingTime=every).start()
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    return None


def read_target(spark: SparkSession, target: str) -> DataFrame:
    """All records written so far, with their ``batch_id``."""
    return spark.read.parquet(target).drop("run", KS.HASH, KS.BUCKET)
