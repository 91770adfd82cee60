"""Connected components of an edge list by rounds of joins, without any group gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Each node of ``edges`` with the smallest node of its component: columns ``node``, ``component``.

    Alternating star contraction: each round links every node to the smallest neighbour of its neighbourhood
    (large-star, then small-star), so the diameter halves or better a round and rows stay O(edges). Each round is written
    to the shared folder. Self-loops give a node its own component; rows with a null end are left out. No edges, no rows.
    Raises RuntimeError if ``max_rounds`` rounds do not settle it (a path of 2**60 nodes would).
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter(F.col("u").isNotNull() & F.col("v").isNotNull())
    # The input is evaluated once; edges, self-loops and nodes are read back from what was written.
    once = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = once.select(F.col("u").alias("node")).union(once.select("v")).distinct()
    cur = once.filter("u <> v")
    mark = _mark(cur)
    for _ in range(max_rounds):
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        cur, old = written(small.union(low2.select("u", F.col("m").alias("v"))).distinct()), mark
        mark = _mark(cur)
        # Settled when a round changes nothing: then every edge points from a node to its root.
        if mark == old:
            roots = cur.groupBy("u").agg(F.min("v").alias("component"))
            return nodes.join(roots.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def _mark(edges: DataFrame) -> tuple:
    """Number of edges with two checksums over them: equal for equal edge sets, and for others by chance of one in 2**64."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftrightunsigned(h, 32))).first())
