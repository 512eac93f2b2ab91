"""Keyed tables: rows stored in hash buckets of their key.

A keyed table has one folder per bucket (``key_bucket = pmod(xxhash64(key),
N)``); inside, rows lie sorted by ``key_hash`` and every file carries a Bloom
filter of it.  Whoever asks which of some rows are stored (resume, incremental
ingest, BFS with stored nodes) reads the key columns of the buckets that those
rows touch, and for a few rows only the row groups that may hold them: what is
read follows the rows asked for, not the table.

The bucket count is chosen once and kept in ``_keyed.json`` beside the rows.
Take it so that a bucket's keys fit a task (about 10 million rows a bucket).
"""

from __future__ import annotations

import functools
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webrake.session import scratch_path

HASH, BUCKET = "key_hash", "key_bucket"
BUCKETS = 64
#: For at most so many rows their hashes are pushed to the file reader.
PUSHED_KEYS = 128
_META = "_keyed.json"


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file(spark, path)
    return fs.exists(p)


def read_note(spark: SparkSession, path: str) -> dict | None:
    """A small JSON file on the cluster's file system (None when absent)."""
    fs, p = _file(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(stream.readUTF())
    finally:
        stream.close()


def write_note(spark: SparkSession, path: str, note: dict) -> None:
    fs, p = _file(spark, path)
    stream = fs.create(p)
    stream.writeUTF(json.dumps(note))
    stream.close()


def bucket_count(spark: SparkSession, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> int:
    """The table's bucket count; the first caller fixes it and the keys."""
    note = read_note(spark, f"{path}/{_META}")
    if note is None:
        write_note(spark, f"{path}/{_META}", {"keys": list(keys), "buckets": buckets})
        return buckets
    if note["keys"] != list(keys):
        raise ValueError(f"{path} is keyed by {note['keys']}, not by {list(keys)}")
    return note["buckets"]


def keyed(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """``df`` with its rows' ``key_hash`` and ``key_bucket`` (null keys too)."""
    return df.withColumn(HASH, F.xxhash64(*keys)).withColumn(BUCKET, F.pmod(HASH, F.lit(buckets)).cast("int"))


def write_keyed_rows(rows: DataFrame, folder: str, buckets: int, mode: str = "overwrite") -> None:
    """Rows of :func:`keyed` below ``folder``: dealt by bucket and a part of
    the hash, so a table of few buckets is still written by many tasks."""
    rows.repartition(BUCKET, F.pmod(F.shiftright(HASH, 32), F.lit(4))) \
        .sortWithinPartitions(BUCKET, HASH).write.mode(mode).partitionBy(BUCKET) \
        .option(f"parquet.bloom.filter.enabled#{HASH}", "true").parquet(folder)


def write_keyed(df: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """Append ``df`` to the keyed table at ``path``."""
    n = bucket_count(df.sparkSession, path, keys, buckets)
    write_keyed_rows(keyed(df, keys, n), path, n, mode="append")


def stage(df: DataFrame, keys: Sequence[str], buckets: int) -> tuple[DataFrame, list[int], Column | None, str]:
    """``df`` computed once and written to a scratch table, with what a look-up
    needs: the buckets it touches (at most ``buckets``, observed while it is
    written) and, for a few rows, a condition on the hash.  Also the path."""
    spark = df.sparkSession
    path = scratch_path(spark, "keyed")
    seen = Observation()
    rows = keyed(df, keys, buckets)
    rows.observe(seen, F.collect_set(BUCKET).alias("b"), F.count(F.lit(1)).alias("n")).write.parquet(path)
    staged = spark.read.schema(rows.schema).parquet(path)
    found = seen.get
    few = None
    if 0 < found["n"] <= PUSHED_KEYS:
        hashes = sorted({r[0] for r in staged.select(HASH).collect()})       # at most PUSHED_KEYS rows
        few = functools.reduce(lambda a, b: a | b, [F.col(HASH) == h for h in hashes])
    return staged, sorted(found["b"] or []), few, path


def touched_keys(table: DataFrame, keys: Sequence[str], touched: list[int], few: Column | None) -> DataFrame:
    """Keys of a keyed table that rows with this footprint can meet."""
    hit = table.where(F.col(BUCKET).isin(touched) if touched else F.lit(False))
    return (hit if few is None else hit.where(few)).select(HASH, *keys)


def anti_keys(rows: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key (null is a key) is not among ``stored`` keys; the hash
    is the join key, so nulls and several columns join like one number."""
    other = stored.select(F.col(HASH).alias("__h"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    same = [rows[HASH] == other["__h"]] + [rows[k].eqNullSafe(other[f"__k{i}"]) for i, k in enumerate(keys)]
    return rows.join(other, functools.reduce(lambda a, b: a & b, same), "left_anti")


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a keyed table."""
    return spark.read.parquet(path).drop(HASH, BUCKET)


def anti_stored(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """R5: rows of ``df`` whose key is not in the keyed table at ``path``.

    ``df`` is computed once, into a scratch table below the checkpoint folder
    that the result reads."""
    spark = df.sparkSession
    note = read_note(spark, f"{path}/{_META}")
    if note is None:
        return df
    n = bucket_count(spark, path, keys)
    staged, touched, few, _ = stage(df, keys, n)
    types = {f.name: f for f in df.schema.fields}
    schema = T.StructType([*[T.StructField(k, types[k].dataType) for k in keys], T.StructField(HASH, T.LongType()),
                           T.StructField(BUCKET, T.IntegerType())])
    table = spark.read.schema(schema).parquet(path)
    return anti_keys(staged, touched_keys(table, keys, touched, few), keys).drop(HASH, BUCKET)
