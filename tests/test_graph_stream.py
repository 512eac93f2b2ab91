"""BFS edge tables and properties; incremental ingest exactly once."""

import os
import tempfile

from pyspark.sql import functions as F

from webrake.operators import graph as G


def _edges(spark, pairs, symmetric=True):
    df = spark.createDataFrame(pairs, "a long, b long")
    return G.build_edges(df, "a", "b", symmetric=symmetric)


def _levels(df):
    return {r.node: r.lvl for r in df.collect()}


def test_chain_depth1(spark):
    e = _edges(spark, [(0, 1), (1, 2), (2, 3)])
    seeds = spark.createDataFrame([(0,)], "node long")
    assert _levels(G.bfs_levels(seeds, e, depth=1)) == {0: 0, 1: 1}


def test_triangle_depth2(spark):
    e = _edges(spark, [(0, 1), (1, 2), (2, 0)])
    seeds = spark.createDataFrame([(0,)], "node long")
    assert _levels(G.bfs_levels(seeds, e, depth=2)) == {0: 0, 1: 1, 2: 1}


def test_resume_skips_stored_but_expands(spark):
    e = _edges(spark, [(0, 1), (1, 2)])
    seeds = spark.createDataFrame([(0,)], "node long")
    stored = spark.createDataFrame([(1,)], "node long")
    assert _levels(G.bfs_levels(seeds, e, depth=2, stored=stored)) == {0: 0, 2: 2}


def test_bfs_levels_property_on_data(spark):
    """Along any edge between two reached nodes levels differ by <= 1, and
    every non-seed node has a neighbour one level closer."""
    from webrake.catalog.q_graph import _edges as data_edges
    e = data_edges(spark, "/root/testdata/sf0.01")
    seeds = spark.createDataFrame([(0,)], "node long")
    lv = _levels(G.bfs_levels(seeds, e, depth=3))
    edges = [(r.src, r.dst) for r in e.collect()]
    for s, d in edges:
        if s in lv and d in lv:
            assert abs(lv[s] - lv[d]) <= 1
    for n, l in lv.items():
        if l > 0:
            assert any(lv.get(s) == l - 1 for s, d in edges if d == n)


def test_ingest_exactly_once(spark):
    from webrake.streaming.ingest import ingest_new, read_target
    base = tempfile.mkdtemp(prefix="ingest-test-")
    landing, target, ckpt = (os.path.join(base, n) for n in ("landing", "target", "ckpt"))
    schema = "id long, k string, v long"
    spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 3)], schema).write.parquet(f"{landing}/1")
    ingest_new(spark, f"{landing}/*", schema, target, ckpt, ["k"], ["id"])
    spark.createDataFrame([(4, "a", 4), (5, "c", 5)], schema).write.parquet(f"{landing}/2")
    ingest_new(spark, f"{landing}/*", schema, target, ckpt, ["k"], ["id"])
    # a third run with no new files changes nothing
    ingest_new(spark, f"{landing}/*", schema, target, ckpt, ["k"], ["id"])
    got = sorted((r.k, r.id) for r in read_target(spark, target).collect())
    assert got == [("a", 1), ("b", 3), ("c", 5)]


def test_ingest_batch_replay_is_idempotent(spark):
    """A batch replayed after later batches were written (a retry after a
    lost driver) rewrites exactly what its first attempt wrote."""
    from webrake.streaming.ingest import process_batch, read_target
    base = tempfile.mkdtemp(prefix="ingest-replay-")
    target = os.path.join(base, "target")
    schema = "id long, k string, v long"
    b0 = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], schema)
    b1 = spark.createDataFrame([(3, "a", 3), (4, "c", 4)], schema)
    process_batch(b0, 0, target, ["k"], ["id"])
    process_batch(b1, 1, target, ["k"], ["id"])
    before = sorted((r.k, r.id, r.batch_id) for r in read_target(spark, target).collect())
    process_batch(b0, 0, target, ["k"], ["id"])      # replay of batch 0
    after = sorted((r.k, r.id, r.batch_id) for r in read_target(spark, target).collect())
    assert before == after == [("a", 1, 0), ("b", 2, 0), ("c", 4, 1)]
