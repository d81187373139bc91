"""Directed graphs as edges (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def roots(edges: DataFrame) -> DataFrame:
    """Vertices without an edge to them."""
    return edges.select(F.col("src").alias("v")).distinct().join(edges.select(F.col("dst").alias("v")).distinct(), "v", "left_anti")


def leaves(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("v")).distinct().join(edges.select(F.col("src").alias("v")).distinct(), "v", "left_anti")


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("v")).union(edges.select("dst")).distinct()


def added(edges: DataFrame, more: DataFrame) -> DataFrame:
    """The graph with more edges; an edge is there once."""
    return edges.select("src", "dst").union(more.select("src", "dst")).distinct()


def size(edges: DataFrame) -> int:
    """How many vertices there are."""
    return vertices(edges).count()


def has(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (src, dst) with `found`: whether the edge is there."""
    own = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d")).distinct()
    return wanted.join(own, (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")), "left").withColumn("found", F.col("_s").isNotNull()).drop("_s", "_d")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def closure(edges: DataFrame, start: DataFrame | None = None, most_rounds: int = 64) -> DataFrame:
    """(src, dst) for every dst that a path of one edge or more reaches from src (of start's column v, if given).

    Paths double each round where all sources are wanted, so a round covers twice the length; the lineage is cut each round.
    """
    edges = edges.select("src", "dst").distinct()
    found = _cut(edges if start is None else edges.join(start.select(F.col("v").alias("src")).distinct(), "src", "left_semi"))
    n = found.count()
    for _ in range(most_rounds):
        step = found.alias("f") if start is None else edges.alias("f")
        more = found.select("src", F.col("dst").alias("via")).join(step.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst")
        found = _cut(found.union(more).distinct())
        if (now := found.count()) == n:
            return found
        n = now
    raise RuntimeError(f"paths are longer than {most_rounds} rounds reach")


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """The start's vertices and all that they reach."""
    return start.select("v").union(closure(edges, start).select(F.col("dst").alias("v"))).distinct()


def unreachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    return vertices(edges).join(reachable(edges, start), "v", "left_anti")


def core(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """The edges that are left when vertices without an edge to or from them have gone, again and again: those on cycles, and on paths between cycles."""
    now = _cut(edges.select("src", "dst").distinct())
    n = now.count()
    for _ in range(most_rounds):
        begin, end = now.select(F.col("src").alias("v")).distinct(), now.select(F.col("dst").alias("v")).distinct()
        now = _cut(now.join(end, F.col("src") == end["v"], "left_semi").join(begin, F.col("dst") == begin["v"], "left_semi"))
        if (left := now.count()) == n or not left:
            return now
        n = left
    raise RuntimeError(f"not settled in {most_rounds} rounds")


def is_cyclic(edges: DataFrame) -> bool:
    """Whether there is a cycle anywhere: whether trimming leaves something."""
    return not core(edges).isEmpty()


def cycles(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(v, cycle): the vertices that reach themselves, and the greatest vertex of all that they reach and are reached by.

    Every vertex takes the greatest vertex that reaches it; those which, along edges between equals, lead back to that one make its component. They go, what is left is
    trimmed, and so on. A round moves along edges only, never over pairs of vertices.
    """
    left, out = core(edges), edges.select(F.col("src").alias("v"), F.col("src").alias("cycle")).limit(0)
    while not left.isEmpty():
        color = _cut(vertices(left).withColumn("c", F.col("v")))
        for _ in range(most_rounds):
            more = left.join(color.withColumnRenamed("v", "src"), "src").groupBy("dst").agg(F.max("c").alias("m"))
            color = _cut(color.select("v", "c").join(more, F.col("v") == F.col("dst"), "left").select("v", F.greatest("c", F.coalesce("m", "c")).alias("c"), (F.col("m") > F.col("c")).alias("moved")))
            if color.where("moved").isEmpty():
                break
        else:
            raise RuntimeError(f"not settled in {most_rounds} rounds")
        same = left.join(color.select(F.col("v").alias("src"), F.col("c").alias("_a")), "src").join(color.select(F.col("v").alias("dst"), F.col("c").alias("_b")), "dst").where("_a = _b").select("src", "dst")
        found = reachable(reversed_edges(same), color.where("v = c").select("v"))
        found = _cut(found.join(color.select("v", "c"), "v").select("v", F.col("c").alias("cycle")))
        # a vertex that is a component of its own is on a cycle only if an edge leads from it to itself
        sizes, loops = found.groupBy("cycle").agg(F.count("*").alias("_n")), left.where("src = dst").select(F.col("src").alias("_s")).distinct()
        out = out.union(found.join(sizes, "cycle").join(loops, F.col("v") == F.col("_s"), "left").where("_n > 1 or _s is not null").select("v", "cycle"))
        gone = found.select("v")
        left = core(left.join(gone, F.col("src") == gone["v"], "left_anti").join(gone, F.col("dst") == gone["v"], "left_anti"))
    return _cut(out)


def cyclic_vertices(edges: DataFrame) -> DataFrame:
    """Vertices on a cycle: those that reach themselves."""
    return cycles(edges).select("v")


def paths(edges: DataFrame, start: str, goal: str, longest: int = 1000) -> DataFrame:
    """(path): the shortest paths from start to goal, as arrays of vertices; none if there is no path.

    Step by step, only along edges to vertices that no shorter path has reached.
    """
    spark = edges.sparkSession
    now, seen = spark.createDataFrame([([start],)], "path array<string>"), spark.createDataFrame([(start,)], "v string")
    e = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).distinct()
    for _ in range(longest):
        if not (done := now.where(F.element_at("path", -1) == goal)).isEmpty() or now.isEmpty():
            return done
        ahead = now.withColumn("src", F.element_at("path", -1)).join(e, "src").join(seen, F.col("dst") == F.col("v"), "left_anti")
        now = _cut(ahead.select(F.concat("path", F.array("dst")).alias("path")))
        seen = _cut(seen.union(now.select(F.element_at("path", -1))).distinct())
    raise RuntimeError(f"no path within {longest} steps")


def path_or_cycle(edges: dict[str, list[str]], start: str, goal: str) -> list[str] | None:
    """Depth-first on the driver, for small graphs such as grammars: the path to the goal, or the first cycle that is met before it."""

    def visit(v: str, trail: list[str]) -> list[str] | None:
        if v in trail:
            return [*trail[trail.index(v) :], v]
        if v == goal:
            return [*trail, v]
        for w in edges.get(v, ()):
            if found := visit(w, [*trail, v]):
                return found
        return None

    return visit(start, [])


def _cut(df: DataFrame) -> DataFrame:
    from lexispark.session import checkpointed

    return checkpointed(df)


def components(links: DataFrame, nodes: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) of an undirected graph by its links (a, b): label is the component's least node; a node without links is its own.

    Every node links what it knows to the least node it knows, in turn its larger and its smaller neighbours, until all links are to least nodes; the
    number of rounds follows the logarithm of the largest component.
    """
    ordered = lambda e: e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = _cut(ordered(links.select("a", "b").where("a is not null and b is not null"))), None
    for _ in range(most_rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = ordered(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(now.join(least, "a").select("a", "m")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        now = _cut(ordered(large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))))
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == before:
            return nodes.select("node").distinct().join(now.select(F.col("a").alias("node"), "b"), "node", "left").select("node", F.coalesce("b", "node").alias("label"))
        before = sign
    raise RuntimeError(f"not settled in {most_rounds} rounds")
