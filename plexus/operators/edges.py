"""Set operations, filters and relabelling of edge tables (src, dst)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plexus.functions.keys import node_key
from plexus.functions.ranks import running
from plexus.session import cut


def union_distinct(*parts: DataFrame) -> DataFrame:
    """Distinct union; a single part is returned as it is, duplicates included."""
    return parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).distinct()


def flip(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


#: Rows that one task tells apart, about.
TASK_ROWS = 500_000


def distinct_pairs(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst), dealt first to as many tasks as their number asks for, so that a task's memory does not grow with the table."""
    parts = max(1, -(-edges.count() // TASK_ROWS))
    return edges.select("src", "dst").repartition(parts, "src", "dst").distinct()


def bidirect(edges: DataFrame) -> DataFrame:
    """Distinct edges both ways; repeats in ``edges`` don't matter, so they need not be taken out before.

    Unordered pairs are told apart, half as many as there are directions, and then written both ways.
    """
    pairs = distinct_pairs(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")))
    ways = F.when(F.col("src") == F.col("dst"), F.array(F.struct("src", "dst"))).otherwise(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return pairs.select(F.inline(ways))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges of ``a`` that ``b`` lacks; duplicates of ``a`` stay."""
    return a.join(b, ["src", "dst"], "left_anti")


def typed(real: DataFrame, walks: DataFrame, loops: DataFrame | None = None) -> DataFrame:
    """Tagged union: 0 for real edges and self loops, 1 for walks; duplicates across kinds stay."""
    tag = lambda e, t: e.select("src", "dst", F.lit(t).cast("bigint").alias("etype"))
    out = tag(real, 0).unionByName(tag(walks, 1))
    return out if loops is None else out.unionByName(tag(loops, 0))


def by_destination(edges: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Edges whose dst is in ``ids`` (id); None passes all, an empty table none."""
    return edges if ids is None else edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def window_slice(edges: DataFrame, start: int, end: int) -> DataFrame:
    """Both ends in [start, end), moved to 0."""
    inside = F.col("src").between(start, end - 1) & F.col("dst").between(start, end - 1)
    return edges.where(inside).select((F.col("src") - start).alias("src"), (F.col("dst") - start).alias("dst"))


def virtual_node(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """All ids move up by one; node 0 is joined to every node, both ways."""
    moved = edges.select((F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst"))
    up = ids.select((F.col("id") + 1).alias("src"), F.lit(0).cast("bigint").alias("dst"))
    return moved.unionByName(up).unionByName(flip(up))


def slot_shift(edges: DataFrame, width: int) -> DataFrame:
    """Room for one slot before each stretch of ``width`` ids; 0 stays. Exact in whole numbers."""
    move = lambda c: F.when(F.col(c) > 0, F.col(c) + F.expr(f"({c} - 1) div {width}")).otherwise(F.col(c)).alias(c)
    return edges.select(move("src"), move("dst"))


def induced(edges: DataFrame, batch: DataFrame) -> DataFrame:
    """Edges with both ends in batch (node, pos), renamed to positions."""
    s, d = batch.select(F.col("node").alias("src"), F.col("pos").alias("s")), batch.select(F.col("node").alias("dst"), F.col("pos").alias("d"))
    return edges.join(s, "src").join(d, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))


def sampled_nodes(ids: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(node, pos): n nodes by hash order, numbered in order of their ids.

    A global order: both windows run over the chosen ids only, of which there are n.
    """
    chosen = ids.select("id").orderBy(node_key(F.col("id"), seed), "id").limit(n)
    return chosen.select(F.col("id").alias("node"), (F.row_number().over(W.orderBy("id")) - 1).cast("bigint").alias("pos"))


def set_measures(a: DataFrame, b: DataFrame) -> DataFrame:
    """n_a, n_b, n_both of the distinct edges, Jaccard (1 for two empty sets) and the new-edge ratio of b against a."""
    rows = a.select("src", "dst").distinct().withColumn("s", F.lit(1)).unionByName(b.select("src", "dst").distinct().withColumn("s", F.lit(2)))
    per = rows.groupBy("src", "dst").agg(F.sum("s").alias("s"))
    c = per.agg(*[F.coalesce(F.sum(F.when(F.col("s").isin(w), 1)), F.lit(0)).cast("bigint").alias(k) for k, w in (("n_a", [1, 3]), ("n_b", [2, 3]), ("n_both", [3]))])
    either = F.col("n_a") + F.col("n_b") - F.col("n_both")
    jaccard = F.when(either == 0, F.lit(1.0)).otherwise(F.col("n_both") / F.greatest(either, F.lit(1)))
    new = F.col("n_b") - F.col("n_both")
    ratio = F.when((F.col("n_a") == 0) & (F.col("n_b") == 0), F.lit(0.0)).when(F.col("n_a") == 0, F.lit(1.0)).otherwise(new / F.greatest(F.col("n_a"), F.lit(1)))
    return c.withColumns({"jaccard": jaccard, "new_ratio": ratio})


#: Destinations of a band of pairs, at most.
SIDE = 32768


def edge_power(edges: DataFrame, p: int) -> DataFrame:
    """Pairs joined by a walk of exactly ``p`` edges."""
    from plexus.operators.slabs import composed

    if p <= 1:
        return distinct_pairs(edges)
    out = edges
    for _ in range(p - 1):
        out = composed(out, edges, SIDE)
    return out


def sparsity(edges: DataFrame, n: int) -> DataFrame:
    return edges.distinct().agg((1 - F.count(F.lit(1)) / (n * n)).alias("sparsity"))


def degrees(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree), 0 where a node has no edge."""
    i = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    o = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return ids.select("id").join(i, "id", "left").join(o, "id", "left").select("id", zero("in_degree"), zero("out_degree"))


def expander(ids: DataFrame, cycles: int, seed: int = 0) -> DataFrame:
    """Edges, both ways, of ``cycles`` cycles through all nodes in hash order; repeats are possible.

    The order is dealt to ranges; a node is joined to the one whose place follows its own.
    """
    out, n = [], max(1, ids.count())
    for c in range(cycles):
        placed = running(ids.select("id", node_key(F.col("id"), seed + c).alias("key")), ["key", "id"], {"at": 1})
        after = placed.select(F.col("id").alias("dst"), ((F.col("at") + (n - 1)) % n).alias("at"))
        e = placed.select(F.col("id").alias("src"), "at").join(after, "at").where("src <> dst").select("src", "dst")
        out += [e, flip(e)]
    return reduce(DataFrame.unionByName, out)


def row_normalised(nodes: DataFrame) -> DataFrame:
    """(id, x, ...) with each row of x divided by its sum; a row without a sum becomes zeros."""
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    return nodes.withColumn("x", F.transform("x", lambda v: F.when(total == 0, F.lit(0.0)).otherwise(v / F.nullif(total, F.lit(0.0)))))
