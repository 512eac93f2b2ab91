"""Page store in buckets of its key (S9).

Pages are rows of one bucketed table, ``buckets`` files sorted by the key, not
a file or a folder per entity.  The key is (entity, page), so an entity with a
third of all pages spreads over all buckets.  Whatever works per key (the resume
join, the first page per key, the node table of a page) finds the store's side
dealt and sorted: no exchange on it.

Bucketing is known to a catalog only, so the store keeps its own note
(``_store.json``) and is registered anew in each session.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from webrake.sources.keystore import read_note, write_note

KEYS = ("entity_key", "url_key")
BUCKETS = 64
_NOTE = "_store.json"


def _name(path: str) -> str:
    return "page_store_" + hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:16]


def write_store(pages: DataFrame, path: str, keys: Sequence[str] = KEYS, buckets: int = BUCKETS,
                append: bool = False) -> None:
    """Write (or ``append`` to) the store at ``path``: pages are dealt by the
    bucket hash, so each task writes one file of one bucket."""
    spark = pages.sparkSession
    note = read_note(spark, f"{path}/{_NOTE}") if append else None
    if note:
        keys, buckets = note["keys"], note["buckets"]
        open_store(spark, path)
        pages = pages.select(*note["columns"])
    w = pages.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys) \
        .option("path", path)
    w.mode("append" if note else "overwrite").saveAsTable(_name(path))
    if not note:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
        write_note(spark, f"{path}/{_NOTE}", {"keys": list(keys), "buckets": buckets, "columns": pages.columns,
                                              "schema": schema})


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The store as a bucketed table of this session."""
    note = read_note(spark, f"{path}/{_NOTE}")
    if note is None:
        raise FileNotFoundError(f"no page store at {path}")
    by = ", ".join(f"`{k}`" for k in note["keys"])
    if not spark.catalog.tableExists(_name(path)):
        spark.sql(f"CREATE TABLE {_name(path)} ({note['schema']}) USING parquet CLUSTERED BY ({by}) "
                  f"SORTED BY ({by}) INTO {note['buckets']} BUCKETS LOCATION '{path}'")
    return spark.table(_name(path))


def not_stored(plan: DataFrame, store: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Planned pages that the store does not hold: the plan is dealt to the
    store's buckets, the store is read as it lies (key columns only)."""
    return plan.join(store.select(*keys).hint("merge"), list(keys), "left_anti")
