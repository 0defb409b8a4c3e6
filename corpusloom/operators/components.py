"""Connected components by alternating large-star and small-star steps.

Each step is one aggregation and one join on the edge list, so a hub with a
large share of all edges is pre-aggregated before the shuffle and its join is
left to adaptive skew handling; the number of steps grows with the logarithm of
the component size, not with its diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.scratch import checkpoint, stored

#: Rounds after which stars are stored as files.
CHECKPOINTED = 5


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both_ways(edges)
    # checkpointed, so that the join has two plain shuffles and a hub's edges are split
    least = checkpoint(both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("root")))
    return (
        both.where("dst > src").join(least, "src")
        .where("dst <> root")
        .select(F.col("dst").alias("src"), F.col("root").alias("dst"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = checkpoint(down.groupBy("src").agg(F.min("dst").alias("root")))
    linked = down.join(least, "src").where("dst <> root").select(F.col("dst").alias("src"), F.col("root").alias("dst"))
    return linked.unionByName(least.select("src", F.col("root").alias("dst"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for each end of an edge; component is the smallest node reachable.

    Null ends and self loops are ignored apart from giving the node itself.
    """
    pairs = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
    nodes = pairs.select(F.col("src").alias("node")).union(pairs.select(F.col("dst").alias("node"))).distinct()
    # the first step makes the edges distinct; its input is read once
    stars = checkpoint(_small_star(pairs.where("src <> dst")))
    seen, rounds = None, 0
    while True:  # every round but the last lowers an end of an edge
        # the planner's estimate has four times the digits after each round; that of files is their size
        stars = _small_star(_large_star(stars))
        stars, rounds = (stored(stars, "stars") if rounds >= CHECKPOINTED else checkpoint(stars)), rounds + 1
        state = stars.agg(
            F.count("*").alias("n"),
            F.bit_xor(F.xxhash64("src", "dst")).alias("x"),
            F.sum(F.xxhash64("dst", "src").bitwiseAND(F.lit((1 << 31) - 1))).alias("s"),
        ).first()
        if state == seen:
            break
        seen = state
    roots = stars.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
