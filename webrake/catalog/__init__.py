"""Registered queries over the driver tables, each with its DuckDB oracle.

Every query reads the given parquet tables (or data Spark derives from
them) in full.  Each catalog module registers ``name -> (builder, sql)``
pairs with :func:`query`; ``sql`` is ``None`` where SQL cannot state the
operator (the check then falls back to a row count, and pytest compares the
query with a brute-force reference on a small fixture instead).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webrake.session import tasks_for

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


# Tables whose rows carry whole texts.  The given extracts are one file with
# one row group, so a scan is one task; a session that wants them dealt over
# more says so in ``webrake.text.partitions`` (the benchmark does).
TEXT_TABLES = {"pages", "documents", "events"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from webrake.sources.readers import read_table
    df = read_table(spark, f"{sf_dir}/{name}.parquet")
    n = spark.conf.get("webrake.text.partitions", None)
    return df.repartition(int(n)) if n and name in TEXT_TABLES else df


#: (supplier, part) rows of one task: each becomes a row of some 300 bytes with
#: the part's texts, all of which the first-wins dedupe sorts at once.
PAIRS_PER_TASK = 400_000


def supplied_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct ``l_suppkey, l_partkey`` of ``lineitem``, dealt by part for
    the join with ``part`` over as many tasks as the rows ask for."""
    pairs = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    n = tasks_for(pairs, PAIRS_PER_TASK)
    return pairs.repartition(n, "l_suppkey", "l_partkey").distinct().repartition(n, "l_partkey")


def load_all() -> dict[str, tuple[Builder, str | None]]:
    # import for the registration side effect
    from webrake.catalog import (  # noqa: F401
        q_urls, q_text, q_rank, q_joins, q_nested, q_records, q_html, q_graph,
        q_io, q_jobs,
    )
    return REGISTRY
