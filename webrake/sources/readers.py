"""Readers: JSON lines, one-JSON-document-per-file, globs, target tables,
one-value-per-line text and stored page blobs.

All readers take an explicit schema where the format allows it (no
inference pass over 100 TB) and return plain DataFrames; file metadata
comes from the hidden ``_metadata`` column, which is pruned away unless
selected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"
#: Spark's setting of how many tasks list the folders of a path at most, and how many a core may take of them.
LISTING, LISTINGS_PER_CORE = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 16


@contextmanager
def few_listings(spark: SparkSession) -> Iterator[None]:
    """Paths loaded inside are listed by tasks of many folders: Spark would start
    a task for each of the first 10,000, and a task unpacks its settings for
    longer than it lists a folder."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(before), LISTINGS_PER_CORE * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(LISTING, before)


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: str,
               mode: str = "FAILFAST") -> DataFrame:
    """One JSON object per line.  ``FAILFAST`` aborts on a bad line (the
    crawl's behaviour); ``PERMISSIVE`` keeps it in ``_corrupt_record`` for
    quarantine (see :func:`split_corrupt`)."""
    r = spark.read.schema(schema if mode != "PERMISSIVE" else f"{schema}, {CORRUPT} STRING") \
        .option("mode", mode)
    if mode == "PERMISSIVE":
        r = r.option("columnNameOfCorruptRecord", CORRUPT)
    return r.json(path if isinstance(path, str) else list(path))


def split_corrupt(df: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of a PERMISSIVE read.  The parsed rows are written
    once (to ``path``, default a fresh folder under the checkpoint
    directory) and split from there: Spark refuses raw-file queries that
    reference only the corrupt column, and the file is parsed once."""
    from webrake.session import scratch_path
    spark = df.sparkSession
    path = path or scratch_path(spark, "parsed")
    df.write.mode("overwrite").parquet(path)
    parsed = spark.read.parquet(path)
    good = parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = parsed.where(F.col(CORRUPT).isNotNull())
    return good, bad


def read_variant_jsonl(spark: SparkSession, path: str | Sequence[str], name: str = "record",
                       to: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine): JSON lines whose fields come in several types,
    each object one VARIANT in column ``name`` (no schema, nothing lost).
    Quarantine: the text of the lines that are no JSON (``reason`` 'syntax')
    or no object ('shape').  Lines are parsed once, by the reader, and written
    to ``to`` (default: below the checkpoint folder), from where both are read.
    Blank lines are skipped; text behind a line's first value is ignored, as
    by all of Spark's JSON readers."""
    from webrake.functions.variants import kind
    from webrake.session import scratch_path
    raw = spark.read.schema(f"{name} VARIANT, {CORRUPT} STRING").option("singleVariantColumn", name) \
        .option("columnNameOfCorruptRecord", CORRUPT).json(path if isinstance(path, str) else list(path))
    is_object = kind(name) == "object"
    rows = raw.select(F.when(is_object, F.col(name)).alias(name),
                      F.when(F.col(name).isNull(), "syntax").when(~is_object, "shape").alias("reason"),
                      F.when(F.col(name).isNull(), F.col(CORRUPT)).when(~is_object, F.to_json(name)).alias("line"))
    to = to or scratch_path(spark, "variants")
    rows.write.parquet(to)
    back = spark.read.schema(rows.schema).parquet(to)
    return back.where(F.col("reason").isNull()).select(name), back.where(F.col("reason").isNotNull()).select("reason", "line")


def read_json_docs(spark: SparkSession, path: str | Sequence[str], schema: str,
                   with_file: bool = True) -> DataFrame:
    """One JSON document per file (multi-line), with file path, name and
    size when ``with_file``."""
    with few_listings(spark):
        df = spark.read.schema(schema).option("multiLine", True) \
            .json(path if isinstance(path, str) else list(path))
    if with_file:
        df = df.select("*", F.col("_metadata.file_path").alias("file_path"),
                       F.col("_metadata.file_name").alias("file_name"),
                       F.col("_metadata.file_size").alias("file_size"))
    return df


#: Why a document is in quarantine.
DOC_REASONS = ("empty", "encoding", "syntax", "shape", "type")


def split_json_docs(spark: SparkSession, path: str | Sequence[str], schema: str,
                    to: str | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """One JSON document per file, the broken ones set aside with a reason.

    Returns ``good`` (the fields of ``schema``), ``bad`` (``reason`` and the
    ``content``), both with file path, name and size, and counts of ``files``,
    ``good`` and ``bad``.  A document is bad when it is blank, not UTF-8, no
    JSON, no object, or holds a field that is not of its type; a missing field
    is null.  Files without a byte are skipped, as by all of Spark's readers.  The bytes are read and parsed once: the rows go to ``to`` (default:
    below the checkpoint folder) and are counted while they are written."""
    from webrake.session import scratch_path
    with few_listings(spark):
        raw = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path))
    rows = raw.select(F.col("path").alias("file_path"), F.element_at(F.split("path", "/"), -1).alias("file_name"),
                      F.col("length").alias("file_size"), F.col("content").cast("string").alias("content"))
    rows = rows.withColumn("__v", F.try_parse_json("content"))
    is_object = F.startswith(F.schema_of_variant("__v"), F.lit("OBJECT"))
    rows = rows.withColumn("__doc", F.try_variant_get("__v", "$", f"struct<{_nested(schema)}>"))
    fine = [F.try_variant_get("__v", f"$.{n}", "variant").isNull() | F.is_variant_null(F.try_variant_get("__v", f"$.{n}", "variant"))
            | F.try_variant_get("__v", f"$.{n}", t).isNotNull() for n, t in _fields(schema)]
    typed = fine[0]
    for one in fine[1:]:
        typed = typed & one
    reason = F.when(F.trim("content", F.lit(" \t\r\n")) == "", "empty").when(~F.is_valid_utf8("content"), "encoding") \
        .when(F.col("__v").isNull(), "syntax").when(~F.coalesce(is_object, F.lit(False)), "shape").when(~typed, "type")
    rows = rows.withColumn("reason", reason)
    seen = Observation()
    to = to or scratch_path(spark, "documents")
    kept = rows.select("file_path", "file_name", "file_size", "reason",
                       F.when(F.col("reason").isNotNull(), F.make_valid_utf8("content")).alias("content"),
                       F.when(F.col("reason").isNull(), F.col("__doc")).alias("__doc"))
    kept.observe(seen, F.count(F.lit(1)).alias("files"), F.count("reason").alias("bad")).write.parquet(to)
    back = spark.read.schema(kept.schema).parquet(to)
    counts = {"files": seen.get["files"], "bad": seen.get["bad"], "good": seen.get["files"] - seen.get["bad"]}
    files = ["file_path", "file_name", "file_size"]
    return (back.where(F.col("reason").isNull()).select("__doc.*", *files),
            back.where(F.col("reason").isNotNull()).select(*files, "reason", "content"), counts)


def _fields(schema: str) -> list[tuple[str, str]]:
    from pyspark.sql.types import StructType
    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(schema).fields]


def _nested(schema: str) -> str:
    return ", ".join(f"`{n}`: {t}" for n, t in _fields(schema))


def expand_globs(spark: SparkSession, patterns: Sequence[str],
                 raise_invalid: bool = False) -> list[str]:
    """Expand ``*`` patterns with the cluster file system's glob (driver-side
    listing only), keep other paths as given, and drop repeated paths while
    keeping first-seen order.  With ``raise_invalid`` a pattern matching
    nothing raises ``FileNotFoundError``."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    out: dict[str, None] = {}
    for pat in patterns:
        if "*" in pat:
            p = jvm.org.apache.hadoop.fs.Path(pat)
            fs = p.getFileSystem(conf)
            st = fs.globStatus(p)
            found = sorted(s.getPath().toString() for s in st) if st is not None else []
        else:
            found = [pat]
        if raise_invalid and not found:
            raise FileNotFoundError(f"no file found for {pat}")
        for f in found:
            norm = f[len("file:"):] if f.startswith("file:") else f
            out[norm] = None
    return list(out)


def read_targets(spark: SparkSession, path: str, schema: str, fmt: str = "csv", multiline: bool = True) -> DataFrame:
    """Target table with a header row (CSV) or a parquet table.  A CSV
    file whose cells may hold line breaks is read by one task; say
    ``multiline=False`` where none does, and the file is split."""
    if fmt == "csv":
        return spark.read.options(**csv_options(multiline)).schema(schema).csv(path)
    return spark.read.schema(schema).format(fmt).load(path)


def read_lines(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """One value per line, surrounding whitespace removed."""
    from webrake.functions.common import strip_ws
    return spark.read.text(path).select(strip_ws("value").alias(name))


def read_page_blobs(spark: SparkSession, path: str) -> DataFrame:
    """Stored page files as ``(file_path, html)``, one row per file: those in
    ``path`` and in its folders ``name=value``.

    Spark's text reader sets up a job per file, which takes longer than reading
    it: it reads the compressed files only, and the others are read as bytes.
    The folders are listed without their values, which nothing asks for: Spark's
    driver compares them in a time that grows as their square."""
    file_path = F.col("_metadata.file_path")
    ending = f"({'|'.join(re.escape(x) for x in _packed_names(spark))})$"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri().getRawPath().rstrip("/")
    bare = F.regexp_replace(file_path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")       # without scheme and host
    inside = F.substr(bare, F.lit(len(root) + 2)).rlike("^([^/=]+=[^/]*/)*[^/]+$") | ~F.startswith(bare, F.lit(f"{root}/"))
    glob = any(c in path for c in "*?[{")           # the root of a pattern's folders is not known

    def load(fmt: str, **options: bool) -> DataFrame:
        with few_listings(spark):
            df = spark.read.format(fmt).options(**options).load(path) if glob else \
                spark.read.format(fmt).options(recursiveFileLookup=True, **options).load(path).where(inside)
        return df

    stored, packed = load("binaryFile"), file_path.rlike(ending)
    rows = stored.where(~packed).select(file_path.alias("file_path"), F.col("content").cast("string").alias("html"))
    if not stored.where(packed).select(file_path).head(1):      # reads no contents
        return rows
    texts = load("text", wholetext=True).where(packed)
    return rows.unionByName(texts.select(file_path.alias("file_path"), F.col("value").alias("html")))


def _packed_names(spark: SparkSession) -> list[str]:
    """Name endings of the files that the text reader unpacks."""
    hadoop = spark._jvm.org.apache.hadoop
    codecs = hadoop.io.compress.CompressionCodecFactory.getCodecClasses(spark._jsc.hadoopConfiguration())
    return sorted({hadoop.util.ReflectionUtils.newInstance(c, spark._jsc.hadoopConfiguration()).getDefaultExtension() for c in codecs})


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table as it lies (splits follow
    ``spark.sql.files.maxPartitionBytes``)."""
    return spark.read.parquet(path)


def csv_options(multiline: bool = True) -> dict[str, str | bool]:
    """CSV in which a cell may hold quotes and edge blanks, and with
    ``multiline`` line breaks (such a file is one task)."""
    return {"header": True, "quote": '"', "escape": '"', "lineSep": "\n", "multiLine": multiline,
            "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
