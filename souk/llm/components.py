"""Connected components of an edge table, without collecting nodes or edges.

Alternating large-star / small-star steps (Kiveris et al., "Connected Components
in MapReduce and Beyond", 2014): a large star links every greater neighbour of a
node to the node's least neighbour, a small star links the lesser neighbours and
the node itself to the least one. Both keep components and end when the edges
form stars around each component's least node, after O(log n) rounds in
practice. Neighbour minima are map-side combined aggregates, and the join that
follows shuffles both sides, so a hub with very many neighbours is summed
before the shuffle and split by the engine after it. Every round is staged in
the shared checkpoint folder (lineage is cut; a lost executor re-reads files);
only a count and a checksum per round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.sources.staging import drop_staged, stage


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the least neighbour of u (u itself included)."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    out = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _star(down)
    out = (starred.select(F.col("v").alias("u"), F.col("m").alias("v"))
           .unionAll(starred.select("u", F.col("m").alias("v"))))
    return out.filter("u != v").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): every node of an edge with the least node of its component.

    Nodes are compared by their own order (any orderable type). Self-loops and
    repeated edges are harmless; nodes without a real edge do not appear.
    """
    now = stage(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
                .filter("u != v").distinct(), "cc")
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        after = stage(_small_star(_large_star(now)), "cc")
        new = _mark(after)
        drop_staged(now)
        now = after
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct())
