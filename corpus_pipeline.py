"""The corpus pipeline: documents to a training mix in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.

1. ``quality``: documents that the quality rules reject go.
2. ``line_dedup``: boilerplate lines of each source are cut from the texts.
3. ``near_dedup``: of each SimHash component the smallest id stays.
4. ``decontaminate``: documents holding a benchmark window go.
5. ``mix``: documents that the mix takes, with how often (``copies``).

Nulls, empty texts, repeated rows, empty tables and extra columns have the
results that the operators define; extra columns travel along until the mix.
Rows equal in id and text are repeats of one document, of which one stays;
documents without an id stay where no document with an id is near, one of each
fingerprint.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webrake.llm import decontaminate, line_dedup, mixing, quality, simhash
from webrake.llm.common import reliable
from webrake.session import checkpoint_dir

#: A set of at most so many ids (8 bytes each) is broadcast, a larger one joined.
BROADCAST_IDS = 1_000_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the base rules and the classifier keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_rules(docs.select(*COLUMNS), labels).where("kept").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut boilerplate lines, near copies being one page: which of them stays
    is the next stage's to say.  ``n_chars`` follows the text."""
    cut = line_dedup.drop_boilerplate(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the smallest id (and of rows that
    repeat it with its text, one)."""
    docs = docs.select(*COLUMNS)
    near = reliable(simhash.near_duplicates(docs, max_bits=2, shingle=3))
    named = docs.where(F.col("doc_id").isNotNull())
    ids = near.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("c"))
    apart = reliable(ids.select("doc_id", "n", (F.col("doc_id") == F.col("c")).alias("stays"))
                     .where("n > 1 or not stays"))
    hint = F.broadcast if apart.count() <= BROADCAST_IDS else (lambda df: df)
    side, once = apart.select("doc_id"), apart.where("stays").select("doc_id")
    single = named.join(hint(side), "doc_id", "left_anti")
    repeated = named.join(hint(once), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    # documents without an id stay where no id is near, one of each fingerprint
    nameless = simhash.fingerprints(docs.where(F.col("doc_id").isNull()), keep=tuple(COLUMNS))
    alone = near.where(F.col("component_id").isNull()).select("fp").distinct()
    nameless = nameless.join(alone, "fp", "left_semi").dropDuplicates(["fp"])
    return single.select(*COLUMNS).unionByName(repeated.select(*COLUMNS)).unionByName(nameless.select(*COLUMNS))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    found = decontaminate.contamination(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("hits") == 0).select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents taken at least once, with ``size``, ``target``,
    ``copies`` and ``taken``."""
    mixed = mixing.mix_sources(docs.select(*COLUMNS))
    return mixed.where("copies > 0").select(*COLUMNS, "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
]

#: SQL cannot express the classifier and the fingerprints: tests/llm compares
#: the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
