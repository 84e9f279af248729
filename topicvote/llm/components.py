"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicvote.llm.common import join_groups
from topicvote.session import materialise


def connected(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b), both long and never null.

    In every round each node moves to the neighbour (or itself) with the smallest hash of the
    round, edges are rewritten and loops and repeats go. A node that is no local minimum
    disappears, so the number of rounds grows with the logarithm of the input. Every round is
    written to the shared folder. Hubs are handled by ``join_groups``."""
    maps = []
    edges = materialise(edges.filter("a != b").distinct(), "edges")
    while not edges.isEmpty():
        order = lambda c: F.xxhash64(c, F.lit(len(maps)))
        both = edges.union(edges.select("b", "a"))
        moves = materialise(
            both.groupBy(F.col("a").alias("node"))
            .agg(F.min(F.struct(order(F.col("b")).alias("h"), F.col("b").alias("to"))).alias("best"))
            .select(
                "node",
                F.when(order(F.col("node")) <= F.col("best.h"), F.col("node")).otherwise(F.col("best.to")).alias("to"),
            ),
            "moves",
        )
        maps.append(moves)
        left = join_groups(edges, moves.toDF("a", "to_a"), "a").select("to_a", "b")
        right = join_groups(materialise(left, "half"), moves.toDF("b", "to_b"), "b")
        edges = materialise(
            right.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
            .filter("a != b")
            .distinct(),
            "edges",
        )
    if not maps:
        return edges.selectExpr("a AS node", "b AS root")
    roots = maps.pop().toDF("node", "root")
    while maps:
        step = maps.pop().toDF("node", "to")
        roots = materialise(
            join_groups(step, roots.toDF("to", "root"), "to", "left").select(
                "node", F.coalesce("root", "to").alias("root")
            ),
            "roots",
        )
    return roots
