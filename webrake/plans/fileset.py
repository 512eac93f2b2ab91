"""P9 as a file-set job: clean a changing set of HTML files, each once.

Files are found by Spark's file index (in parallel over folders) with their
size and modification time; contents are not read for that.  A file that the
output's commit log knows with the same time and size is left alone, so a
second run over an unchanged set reads names only.  Outputs are rows named by
their input (``file_path`` and ``file_name``, with the new extension), committed
run by run; of a file that changed, the newest version counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from webrake.functions import html as H
from webrake.operators.joins import anti_processed
from webrake.session import delete_path, scratch_path
from webrake.sources import commits as C
from webrake.sources.readers import few_listings

_STAT = ["file_path", "modified", "file_size"]
#: Spark's setting of the bytes that opening a file is worth when files are dealt over tasks.
OPEN_COST, FILE_BYTES = "spark.sql.files.openCostInBytes", 1 << 18


@contextmanager
def _many_files(spark: SparkSession) -> Iterator[None]:
    """Scans run inside take up to 500 small files a task; Spark's default is 32, which
    takes longer to start than to read.  (Bytes limit a task all the same.)"""
    before = spark.conf.get(OPEN_COST)
    spark.conf.set(OPEN_COST, str(FILE_BYTES))
    try:
        yield
    finally:
        spark.conf.set(OPEN_COST, before)


def list_files(spark: SparkSession, src: str | Sequence[str], glob: str = "*.html") -> DataFrame:
    """``file_path, modified, file_size`` of the files below ``src``."""
    return _stored(spark, src, glob).select(*_STAT)


def _stored(spark: SparkSession, src: str | Sequence[str], glob: str) -> DataFrame:
    """The files with their ``content`` (not read where it is not selected), listed once."""
    with few_listings(spark):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob) \
            .load(src if isinstance(src, str) else list(src))
    return found \
        .select(F.col("path").alias("file_path"), F.col("modificationTime").alias("modified"),
                F.col("length").alias("file_size"), "content")


def clean_files(spark: SparkSession, src: str | Sequence[str], dst: str, glob: str = "*.html",
                convert: Callable[[Column], Column] = H.clean_html_native, suffix: str = ".html") -> int:
    """Convert the files that are new or changed since the last run into the
    committed table at ``dst``; returns their number (0: nothing was done)."""
    with _many_files(spark):
        done = C.read_committed(spark, dst)
        stored = _stored(spark, src, glob)
        files = stored.select(*_STAT)
        if done is not None:
            files = anti_processed(files, done, _STAT)
        # the work list, written once: the run's id follows from it, so a repeated run commits once
        todo, seen = scratch_path(spark, "todo"), Observation()
        name = F.concat_ws("|", *[F.col(c).cast("string") for c in _STAT])
        files.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(name)).alias("h")) \
            .write.parquet(todo)
        n = seen.get["n"]
        if n:
            txn = hashlib.sha256(f"{n}|{seen.get['h']}".encode()).hexdigest()[:24]
            raw = stored.select(*_STAT, F.make_valid_utf8("content").alias("__text"))
            stem = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.[^.]*$", "")
            out = raw.join(spark.read.parquet(todo), _STAT, "left_semi") \
                .select(*_STAT, F.concat(stem, F.lit(suffix)).alias("file_name"), convert(F.col("__text")).alias("content"))
            C.commit(out, dst, txn)
        delete_path(spark, todo)
        return n


def cleaned_files(spark: SparkSession, dst: str) -> DataFrame:
    """The newest cleaned version of every file: ``file_path, file_name, content``."""
    rows = C.read_committed(spark, dst)
    if rows is None:
        raise FileNotFoundError(f"nothing was cleaned to {dst}")
    newest = F.max(F.struct("modified", "file_size", "file_name", "content")).alias("v")
    return rows.groupBy("file_path").agg(newest).select("file_path", "v.file_name", "v.content")
