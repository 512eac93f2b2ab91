"""Depth-limited breadth-first expansion over a link graph.

The frontier loop runs on the driver, one iteration per level (depth is a
small parameter, 1 by default); every iteration is a distributed equi-join
``frontier x edges``, a ``distinct`` (partial aggregation) and an anti-join
against the visited set.  Recursive SQL is not used: Spark 4.1 only
accepts ``UNION ALL`` recursion, which would re-expand visited nodes.

Each level is written under the session's checkpoint folder and read back,
which cuts lineage: a lost executor recomputes at most one level.  The edge
table is written too, unless the caller says that it is a stored table.

A hub node (one third of all edges) makes the join skewed on ``src``; AQE's
skew-join split handles it, and ``distinct`` before the anti-join keeps the
next frontier at most one row per node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from webrake.session import delete_path, scratch_path
from webrake.sources.keystore import anti_stored


def build_edges(links: DataFrame, src: str, dst: str, symmetric: bool = False) -> DataFrame:
    """Distinct directed edges ``(src, dst)`` without self-loops; with
    ``symmetric`` each edge is also added reversed."""
    e = links.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    if symmetric:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return e.where(F.col("src").isNotNull() & F.col("dst").isNotNull()
                   & (F.col("src") != F.col("dst"))).distinct()


def store_edges(edges: DataFrame, path: str | None = None) -> DataFrame:
    """The edges written once as a table (default: below the checkpoint
    folder), for any number of expansions with ``stored_edges=True``."""
    path = path or scratch_path(edges.sparkSession, "edges")
    return _written(edges.select("src", "dst"), path)[0]


def _written(df: DataFrame, path: str) -> tuple[DataFrame, int]:
    """``df`` written to the shared checkpoint folder and read back (cuts the
    lineage: a lost executor recomputes nothing before this point), and its
    row count, observed while it is written."""
    rows = Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), rows.get["n"]


def bfs_levels(seeds: DataFrame, edges: DataFrame, depth: int = 1,
               node_col: str = "node", stored: DataFrame | str | None = None,
               stored_edges: bool = False) -> DataFrame:
    """Every node within ``depth`` hops of a seed, once, with its shortest
    distance ``lvl`` (seeds are level 0).

    ``stored`` (a ``node`` table) lists nodes processed in an earlier run:
    they are not emitted again but are still expanded (resume).  A path names
    a keyed table of them, of which only the buckets that were reached are read.

    Building the result runs one job per level (and one for the edges unless
    ``stored_edges``): each level is a table under the session's checkpoint
    folder (``spark.checkpoint.dir``; a shared folder on a cluster).  The
    result reads the levels; the edges written here are deleted once the last
    level stands, and :func:`drop_levels` deletes the levels."""
    spark = seeds.sparkSession
    base = scratch_path(spark, "bfs")
    e = edges.select("src", "dst")
    own = not stored_edges and depth > 1
    if own:      # one hop reads the edges once: no table needed
        e = _written(e, f"{base}-edges")[0]
    # level 0 is the seed list itself (small, cheap to recompute): not written
    visited = seeds.select(F.col(node_col).alias("node")).where(F.col("node").isNotNull()) \
        .distinct().withColumn("lvl", F.lit(0))
    frontier = visited.select("node")
    for lvl in range(1, depth + 1):
        nxt = (frontier.join(e, frontier.node == e.src)
               .select(F.col("dst").alias("node")).distinct()
               .join(visited.select("node"), "node", "left_anti"))
        nxt, n = _written(nxt.withColumn("lvl", F.lit(lvl)), f"{base}/level={lvl}")
        if not n:
            break
        visited = visited.unionByName(nxt)
        frontier = nxt.select("node")
    if own:
        delete_path(spark, f"{base}-edges")
    if isinstance(stored, str):
        visited = anti_stored(visited.withColumnRenamed("node", node_col), stored, [node_col]) \
            .withColumnRenamed(node_col, "node")
    elif stored is not None:
        visited = visited.join(stored.select(F.col(node_col).alias("node")), "node", "left_anti")
    return visited.withColumnRenamed("node", node_col)


def drop_levels(levels: DataFrame) -> None:
    """Delete the level tables that ``levels`` (a :func:`bfs_levels` result)
    reads; call it once the result has been written elsewhere."""
    folders = {f.rpartition("/")[0] for f in levels.inputFiles() if "/bfs-" in f and "/level=" in f}
    for folder in sorted(folders):
        delete_path(levels.sparkSession, folder)
