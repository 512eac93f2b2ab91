"""Keyed tables, page store, bounded ingest and distributed positions."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from webrake.functions import urls as U
from webrake.operators import dom, graph
from webrake.operators import rank as R
from webrake.plans import fetch
from webrake.sources import keystore as KS
from webrake.sources import pagestore as PS
from webrake.streaming import ingest


def folder():
    return tempfile.mkdtemp(prefix="stores-test-")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# -- keyed tables ---------------------------------------------------------------------

@pytest.mark.parametrize("asked", [7, 900])
def test_anti_stored_brute_force(spark, asked):
    """A few rows (hashes pushed) and many, two key columns, null keys, a hot key."""
    rng = random.Random(asked)
    key = lambda: (rng.choice([None, "hot", *map(str, range(40))]), rng.choice([None, *range(30)]))
    stored, rows = {key() for _ in range(600)}, [(*key(), i) for i in range(asked)]
    path = f"{folder()}/t"
    halves = sorted(stored, key=str)
    for part in (halves[:300], halves[300:]):       # two appends
        KS.write_keyed(spark.createDataFrame(part, "a string, b long"), path, ["a", "b"], buckets=8)
    got = KS.anti_stored(spark.createDataFrame(rows, "a string, b long, i long"), path, ["a", "b"])
    assert got.columns == ["a", "b", "i"]
    assert sorted(r.i for r in got.collect()) == sorted(i for a, b, i in rows if (a, b) not in stored)
    assert KS.read_keyed(spark, path).count() == len(stored)


def test_lookups_read_touched_buckets_only(spark):
    path = f"{folder()}/t"
    KS.write_keyed(spark.range(20000).withColumnRenamed("id", "k"), path, ["k"], buckets=32)
    plan = plan_of(KS.anti_stored(spark.createDataFrame([(5,), (20001,)], "k long"), path, ["k"]))
    scans = [ln for ln in plan.splitlines() if "FileScan" in ln and KS.BUCKET in ln and "PartitionFilters: [key_bucket" in ln]
    assert len(scans) == 1 and "EqualTo(key_hash" in scans[0]
    # what is read does not grow with the table: two buckets, whatever was written since
    before = KS.touched_keys(spark.read.parquet(path), ["k"], [1, 2], None).inputFiles()
    assert 0 < len({f.split("key_bucket=")[1].split("/")[0] for f in before if "key_bucket=" in f}) <= 32
    hit = spark.read.parquet(path).where(F.col(KS.BUCKET).isin(1, 2)).select(F.input_file_name().alias("f")).distinct().count()
    every = spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().count()
    assert hit * 8 <= every


def test_no_table_and_other_keys(spark):
    df = spark.createDataFrame([(1,)], "k long")
    path = f"{folder()}/t"
    assert KS.anti_stored(df, path, ["k"]).count() == 1
    KS.write_keyed(df, path, ["k"])
    assert KS.anti_stored(df.limit(0), path, ["k"]).count() == 0 and KS.anti_stored(df, path, ["k"]).count() == 0
    with pytest.raises(ValueError):
        KS.write_keyed(df.withColumn("j", F.lit(1)), path, ["j"])


def test_bfs_resume_and_fetch_resume_by_path(spark):
    path = f"{folder()}/nodes"
    KS.write_keyed(spark.createDataFrame([(1,)], "node long"), path, ["node"])
    e = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "node long")
    assert {r.node: r.lvl for r in graph.bfs_levels(seeds, e, depth=2, stored=path).collect()} == {0: 0, 2: 2}
    pages = f"{folder()}/pages"
    KS.write_keyed(spark.createDataFrame([("e", "b")], "entity_key string, url_key string"), pages, ["entity_key", "url_key"])
    hits = spark.createDataFrame([("e", 0, "http://h/a", "t", "s"), ("e", 1, "http://h/b", "t", "s")],
                                 "entity_key string, pos long, url string, title string, snippet string")
    keys = hits.select("url", U.url_key("url").alias("url_key")).collect()
    KS.write_keyed(spark.createDataFrame([("e", keys[1].url_key)], "entity_key string, url_key string"), pages,
                   ["entity_key", "url_key"])
    assert [r.url for r in fetch.fetch_plan(hits, kind="cv", done=pages).collect()] == ["http://h/a"]


def test_ingest_batches_read_their_buckets(spark):
    target = f"{folder()}/t"
    schema = "id long, k string"
    many = spark.createDataFrame([(i, f"k{i}") for i in range(3000)], schema)
    ingest.process_batch(many, 0, target, ["k"], ["id"], buckets=16)
    rows, n, _ = ingest.new_rows(spark.createDataFrame([(9001, "k7"), (9002, "new")], schema), 1, target, ["k"], ["id"])
    assert n == 16 and [r.k for r in rows.collect()] == ["new"]
    scan = next(ln for ln in plan_of(rows).splitlines() if "FileScan" in ln and "batch_id" in ln)
    filters = scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "key_bucket" in filters and "batch_id" in filters and "Or(EqualTo(key_hash" in scan
    ingest.process_batch(spark.createDataFrame([], schema), 2, target, ["k"], ["id"])
    assert ingest.read_target(spark, target).count() == 3000


# -- page store -----------------------------------------------------------------------

def store_rows(n=600):
    return [("hot" if i % 3 else f"e{i % 50}", f"u{i}", f"<p>page {i}</p>" * (i % 4)) for i in range(n)]


def test_page_store_hot_entity(spark):
    """An entity with two thirds of all pages lies in all buckets; nothing per entity."""
    path = f"{folder()}/store"
    df = spark.createDataFrame(store_rows(), "entity_key string, url_key string, html string")
    PS.write_store(df.where("url_key < 'u3'"), path, buckets=8)
    PS.write_store(df.where("url_key >= 'u3'"), path, append=True)
    files = [f for f in os.listdir(path) if f.endswith(".parquet")]
    assert len(files) <= 16 and not [d for d in os.listdir(path) if "=" in d]
    store = PS.open_store(spark, path)
    assert sorted(map(tuple, store.collect())) == sorted(store_rows())
    per_file = store.where("entity_key = 'hot'").groupBy(F.input_file_name().alias("f")).count().collect()
    assert max(r["count"] for r in per_file) < 150
    spark.sql(f"DROP TABLE {PS._name(path)}")       # a new session knows only the note
    assert PS.open_store(spark, path).count() == 600


def test_store_side_has_no_exchange(spark):
    path = f"{folder()}/store"
    rows = spark.createDataFrame(store_rows(), "entity_key string, url_key string, html string")
    PS.write_store(rows, path, buckets=8)
    store = PS.open_store(spark, path)
    plan = spark.createDataFrame([("hot", "u1"), ("hot", "nope"), ("e0", "u0")], "entity_key string, url_key string")
    left = PS.not_stored(plan, store)
    text = plan_of(left)
    assert text.count("Exchange") == 1 and "html" not in text and "Bucketed: true" in text
    assert [r.url_key for r in left.collect()] == ["nope"]
    # first page per key, and the node table of every page: dealt already
    assert "Exchange" not in plan_of(store.groupBy("entity_key", "url_key").agg(F.min("html")))
    found = dom.extract_fields(store, ["entity_key", "url_key"], {"p": "p"}, dealt=True)
    assert "Exchange hashpartitioning" not in plan_of(found)
    assert {r.url_key: len(r.p) for r in found.collect()} == {u: i % 4 for i, (_, u, _) in enumerate(store_rows())}


# -- bounded ingest -------------------------------------------------------------------

def test_bounded_ingest_late_rows_and_restart(spark):
    """Duplicates within the delay go, late rows go, a key comes again after
    its state has expired; a restart keeps the state."""
    base = folder()
    src, target, ckpt = (f"{base}/{x}" for x in ("in", "out", "ckpt"))
    schema = "k string, id long, ts timestamp_ntz"
    at = lambda day, h=0: f"2024-01-{day:02d} {h:02d}:00:00"

    def arrive(name, rows):
        spark.createDataFrame(rows, "k string, id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz")) \
            .coalesce(1).write.parquet(f"{src}/{name}")
        ingest.ingest_bounded(spark, f"{src}/*", schema, target, ckpt, ["k"], "ts", delay="1 day")
        return sorted(r.id for r in spark.read.parquet(target).collect())

    assert arrive("a", [("a", 1, at(1)), ("b", 3, at(1)), ("n", 4, None)]) == [1, 3]
    assert arrive("b", [("a", 5, at(1, 20)), ("c", 6, at(1, 20))]) == [1, 3, 6]            # a duplicate across runs
    assert arrive("c", [("d", 7, at(9))]) == [1, 3, 6, 7]                       # the watermark moves to the 8th
    assert arrive("d", [("late", 9, at(2)), ("d", 10, at(9, 5))]) == [1, 3, 6, 7]      # late; a duplicate
    assert arrive("e", [("b", 11, at(9, 6))]) == [1, 3, 6, 7, 11]               # b's state expired on the 2nd


# -- positions ------------------------------------------------------------------------

def test_positions_brute_force(spark):
    rng = random.Random(13)
    rows = [(rng.choice([None, *range(20)]), i) for i in range(5000)]
    order = [F.col("a").desc_nulls_last(), F.col("i")]
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    df = spark.createDataFrame(rows, "a long, i long").repartition(7)
    placed = R.with_positions(df, order).collect()
    assert [(r.a, r.i) for r in sorted(placed, key=lambda r: r.position)] == want
    assert sorted(r.position for r in placed) == list(range(5000))
    for offset, limit in [(0, 20000), (1200, 0), (4999, 0), (6000, 0), (30, 15000)]:
        got = [(r.a, r.i) for r in R.slice_rows(df, order, offset, limit).collect()]
        assert got == want[offset:limit or None]
    assert R.with_positions(df.limit(0), order).count() == 0


def test_ties_and_repeated_rows(spark):
    df = spark.createDataFrame([(1,)] * 40 + [(2,)] * 2, "a long").repartition(5)
    assert sorted(r.a for r in R.slice_rows(df, [F.col("a")], 39, 0).collect()) == [1, 2, 2]
