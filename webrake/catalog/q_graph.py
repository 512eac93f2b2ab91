"""Registered queries: edge build and depth-limited expansion (G1-G3).

Co-author stand-in: two suppliers are linked when they supply consecutive
lines of one order.  Each line item yields at most
one edge (an equi-join on ``(orderkey, linenumber + 1)``), so a large order
never turns into all pairs of its suppliers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from webrake.catalog import query, table
from webrake.operators import graph as G

SEED = 0

_EDGES_SQL = """
WITH e0 AS (
  SELECT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b
    ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
e AS (SELECT src, dst FROM e0 WHERE src <> dst UNION SELECT dst, src FROM e0 WHERE src <> dst)"""


def _edges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem") \
        .select("l_orderkey", "l_linenumber", "l_suppkey")
    a = li.alias("a")
    b = li.alias("b")
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey"))
                   & (F.col("b.l_linenumber") == F.col("a.l_linenumber") + 1))
    pairs = pairs.select(F.col("a.l_suppkey").alias("src"), F.col("b.l_suppkey").alias("dst"))
    return G.build_edges(pairs, "src", "dst", symmetric=True)


def _bfs_sql(depth, stored_sql=None):
    tail = f"WHERE node NOT IN ({stored_sql})" if stored_sql else ""
    return _EDGES_SQL.replace("WITH e0", "WITH RECURSIVE e0") + f""",
r(node, lvl) AS (SELECT CAST({SEED} AS BIGINT), 0
  UNION SELECT e.dst, r.lvl + 1 FROM r JOIN e ON e.src = r.node WHERE r.lvl < {depth})
SELECT node, CAST(min(lvl) AS INTEGER) AS lvl FROM r {tail} GROUP BY node"""


@query("edges", _EDGES_SQL + " SELECT src, dst FROM e")
def q_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


def _seeds(spark, sf_dir):
    return table(spark, sf_dir, "supplier").where(F.col("s_suppkey") == SEED) \
        .select(F.col("s_suppkey").alias("node"))


@query("bfs_depth1", _bfs_sql(1))
def q_bfs_depth1(spark, sf_dir):
    return G.bfs_levels(_seeds(spark, sf_dir), _edges(spark, sf_dir), depth=1)


@query("bfs_depth2", _bfs_sql(2))
def q_bfs_depth2(spark, sf_dir):
    return G.bfs_levels(_seeds(spark, sf_dir), _edges(spark, sf_dir), depth=2)


# stored profiles from an earlier run: suppliers with a negative balance
_STORED_SQL = "SELECT s_suppkey FROM supplier WHERE s_acctbal < 0"


@query("bfs_resume", _bfs_sql(3, _STORED_SQL))
def q_bfs_resume(spark, sf_dir):
    stored = table(spark, sf_dir, "supplier").where(F.col("s_acctbal") < 0) \
        .select(F.col("s_suppkey").alias("node"))
    return G.bfs_levels(_seeds(spark, sf_dir), _edges(spark, sf_dir), depth=3, stored=stored)
