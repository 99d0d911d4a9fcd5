"""Strong components of a directed graph by trimming and forward-backward colouring, and what is asked of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexus.components import components
from plexus.functions.ranks import running
from plexus.session import cut, drop, settled

#: Rounds of trimming before each colouring. Colouring alone is exact; trimming spares it what lies on no cycle.
TRIMS = 3


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have edges both in and out: only these can lie on a cycle."""
    for _ in range(TRIMS):
        n = edges.count()
        heads, tails = edges.select("src").distinct(), edges.select("dst").distinct()
        both = heads.join(tails, heads["src"] == tails["dst"], "left_semi").select(F.col("src").alias("id"))
        less = cut(edges.join(both.withColumnRenamed("id", "src"), "src", "left_semi").join(both.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"), "trimmed")
        drop(edges)
        edges = less
        if edges.count() == n:
            break
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """(id, colour): the smallest node from which each node can be reached, itself included.

    Only nodes whose colour has changed send it on; a round's new colours are merged in one aggregate.
    """
    colour = cut(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().withColumn("colour", F.col("id")), "colours")
    changed = colour
    while True:
        sent = edges.join(changed.select(F.col("id").alias("src"), F.col("colour").alias("sent")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("sent").alias("sent"))
        after = cut(colour.join(sent, "id", "left").select("id", F.least("colour", "sent").alias("colour"), F.coalesce(F.col("sent") < F.col("colour"), F.lit(False)).alias("new")), "colours")
        drop(colour)
        colour, changed = after.select("id", "colour"), after.where("new")
        if changed.isEmpty():
            return colour


def _backward(edges: DataFrame) -> DataFrame:
    """(id, colour): nodes that reach their colour's own node along edges (src, dst, colour) of one colour."""
    found = cut(edges.select(F.col("colour").alias("id"), "colour").distinct(), "reached")
    frontier, parts = found, [found]
    while not frontier.isEmpty():
        step = edges.join(frontier.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"), "colour").distinct()
        # A node has one colour, so its identifier alone tells whether it was met.
        frontier = cut(step.join(found, "id", "left_anti"), "reached")
        parts.append(frontier)
        found = cut(found.unionByName(frontier), "found")
    return found


def strong_components(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, component) of all nodes of ``ids`` and edges (src, dst); ``component`` is the smallest node of the strong component.

    Rounds of: trim what lies on no cycle, give each node the smallest node that reaches it as its colour, and
    take as a component what reaches that node within the colour. Every round settles a component of each colour. Loops, repeated
    edges and empty tables do no harm. Rounds grow with the longest shortest path, not with the number of nodes.
    """
    spark = edges.sparkSession

    def run() -> DataFrame:
        left = cut(edges.where("src <> dst").select("src", "dst").distinct(), "arcs")
        parts = []
        while True:
            left = _trimmed(left)
            if left.isEmpty():
                break
            colour = _coloured(left)
            s, d = colour.select(F.col("id").alias("src"), "colour"), colour.select(F.col("id").alias("dst"), F.col("colour").alias("other"))
            own = cut(left.join(s, "src").join(d, "dst").where("colour = other").select("src", "dst", "colour"), "own")
            found = _backward(own)
            parts.append(found)
            gone = found.select("id")
            # Edges between colours lie on no cycle.
            less = own.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
            less = cut(less.select("src", "dst"), "arcs")
            drop(left, own, colour)
            left = less
        every = ids.select("id").union(edges.select("src")).union(edges.select("dst")).where("id IS NOT NULL").distinct()
        if not parts:
            return every.withColumn("component", F.col("id"))
        named = parts[0]
        for p in parts[1:]:
            named = named.unionByName(p)
        return every.join(named, "id", "left").select("id", F.coalesce("colour", "id").alias("component"))

    return settled(spark, run, "strong")


def chained(edges: DataFrame, ids: DataFrame, only_if_split: bool = True) -> DataFrame:
    """Edges (src, dst) and more that join all strong components to a cycle: from the smallest node of each to that of the next.

    Where ``only_if_split`` is set a graph that is weakly connected stays as it is.
    """
    spark = edges.sparkSession

    def run() -> DataFrame:
        if only_if_split and conditions(edges, ids).first()["n_weak"] <= 1:
            return edges.select("src", "dst")
        placed = running(strong_components(edges, ids).select("component").distinct(), ["component"], {"at": 1})
        n = placed.count()
        if n <= 1:
            return edges.select("src", "dst")
        after = placed.select(F.col("component").alias("dst"), ((F.col("at") + (n - 1)) % n).alias("at"))
        return edges.select("src", "dst").unionByName(placed.select(F.col("component").alias("src"), "at").join(after, "at").select("src", "dst"))

    return settled(spark, run, "chained")


def conditions(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(n_nodes, n_without_loop, n_weak, holds) in one row: whether every node has a loop and the graph is weakly connected."""
    loops = edges.where("src = dst").select(F.col("src").alias("id")).distinct().withColumn("loop", F.lit(True))
    weak = components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))).withColumnRenamed("node", "id")
    every = ids.select("id").union(edges.select("src")).union(edges.select("dst")).distinct()
    per = every.join(loops, "id", "left").join(weak, "id", "left").withColumn("root", F.coalesce("component", "id"))
    roots = per.select("root").distinct().agg(F.count(F.lit(1)).alias("n_weak"))
    n = per.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("loop").isNull()).alias("n_without_loop"))
    both = n.crossJoin(F.broadcast(roots))  # one row each
    return both.withColumn("holds", (F.col("n_without_loop") == 0) & (F.col("n_weak") <= 1))
