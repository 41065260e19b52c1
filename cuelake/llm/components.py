"""Connected components of an edge table by randomised contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import stage_table


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of one orderable type to one row (node, root) per node that has an edge.

    Each round every node moves onto the neighbour (or itself) with the least random hash, and the
    edges follow; that shrinks any graph by a constant share of its nodes, long chains and stars
    included, so the rounds grow with the logarithm of the largest component. The moves of a round
    are one grouped minimum and two joins. Rounds are written to the shared folder."""
    left = stage_table(edges.where("a <> b").select("a", "b"), "cc_edges")
    moves: list[DataFrame] = []
    while not left.isEmpty():
        step = F.lit(len(moves))
        ends = left.select("a", "b").union(left.select(F.col("b"), F.col("a"))).select(
            F.col("a").alias("node"), F.explode(F.array("a", "b")).alias("to")
        )
        nearest = ends.groupBy("node").agg(F.min(F.struct(F.xxhash64("to", step).alias("h"), "to")).alias("m"))
        moved = stage_table(nearest.select("node", F.col("m.to").alias("to")), "cc_moves")
        moves.append(moved)
        to_a = moved.select(F.col("node").alias("a"), F.col("to").alias("new_a"))
        to_b = moved.select(F.col("node").alias("b"), F.col("to").alias("new_b"))
        followed = left.join(to_a, "a").join(to_b, "b").where("new_a <> new_b")
        left = stage_table(
            followed.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct(), "cc_edges"
        )
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    named = [m.select(F.col("node").alias("root"), F.col("to").alias("next")) for m in moves[1:]]
    start = moves[0].select("node", F.col("to").alias("root"))
    return reduce(
        lambda found, m: found.join(m, "root", "left").select("node", F.coalesce("next", "root").alias("root")), named, start
    )
