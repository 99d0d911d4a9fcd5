"""Connected components of an undirected edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexus.session import cut, drop


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is joined to the smallest of u and its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are joined to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; ``component`` is its smallest reachable node.

    ``edges`` has two bigint columns, u and v. Self loops, nulls, repeated and reversed edges do no harm;
    an empty table gives an empty result. The number of rounds grows with the logarithm of the graph.
    """
    loops = edges.where("u = v").select("u").distinct()
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        after = cut(_small_star(_large_star(now).distinct()).distinct(), "edges")
        drop(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    named = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    alone = loops.select(F.col("u").alias("node")).withColumn("component", F.col("node"))
    found = named.unionAll(roots)
    return found.unionAll(alone.join(found, "node", "left_anti"))


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]
