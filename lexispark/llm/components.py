"""Connected components of an undirected graph as joins, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import checkpointed


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b), of any orderable type, to (node, label): label is the least node of the component.

    Alternating large-star and small-star steps (each a minimum per node and an equi-join) until the edges are stars; the
    number of rounds grows with the logarithm of the largest component. Loops and repeated edges are harmless; a node with
    null is left out; no edges give no rows.
    """
    now = checkpointed(_canonical(edges.select("a", "b").where("a is not null and b is not null")), narrow=True)
    for _ in range(most_rounds):
        if _settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b")).distinct()
        now = checkpointed(_small_star(_large_star(now)), narrow=True)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: every node has one edge down at most, and none if an edge leads down to it."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("down")).union(edges.select("b", F.lit(0)))
    of = ends.groupBy("x").agg(F.sum("down").alias("down"), F.min("down").alias("low"))
    return of.where("down > 1 or (down > 0 and low = 0)").isEmpty()


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its least neighbour."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _canonical(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(edges.join(least, "a").select("a", F.col("m").alias("b"))))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return _canonical(edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))))
