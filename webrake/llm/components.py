"""Connected components of an edge table by alternating star contraction.

Large-star: every node's larger neighbours move to its smallest neighbour;
small-star: its smaller neighbours and itself do.  Both are one partial
aggregation (smallest neighbour) and one join, so a hub is split by adaptive
skew handling instead of landing in one task.  The edge table shrinks to
stars (node, smallest node of the component); nothing reaches the driver but
two counters per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrake.llm.common import reliable


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (columns ``a``, ``b``);
    ``root`` is the smallest node of its component.  Self-loops and repeated
    edges are harmless; an empty table gives an empty table."""
    e = reliable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .where("a != b").distinct())
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .unionByName(small.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        e = reliable(small)
        # stars: no node is both a leaf and a centre, and no leaf has two centres
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or state.n == 0:
            break
        seen = state
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")) \
        .unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
