"""Ranges, padding, batches, head views and grouped walks over node and edge tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plexus.functions.keys import MODULUS, edge_key, node_key
from plexus.functions.ranks import placed_in, running
from plexus.operators.edges import expander, induced
from plexus.operators.sample import moves, seed_first

#: Rows of a group that one task numbers, at most: Spark limits groups before a shuffle up to this many.
TASK_CAP = 1000


def rank_range(rows: DataFrame, start: int, end: int, n: int) -> DataFrame:
    """Rows whose id is in [start, min(end, n)), moved to 0; a range beyond ``n`` is empty."""
    return rows.where((F.col("id") >= start) & (F.col("id") < min(end, n))).withColumn("id", F.col("id") - start)


def by_destination_each(edges: DataFrame, probes: DataFrame) -> DataFrame:
    """Edges whose dst is in ``probes`` (id), once for each time it stands there."""
    return edges.join(probes.select(F.col("id").alias("dst")), "dst").select("src", "dst")


def hop_bound(rows: DataFrame, most: int) -> DataFrame:
    """Rows with 0 <= hop <= most; 0 or less sets no upper bound. A null hop is dropped."""
    return rows.where((F.col("hop") >= 0) & (F.lit(most <= 0) | (F.col("hop") <= most)))


def pad(rows: DataFrame, n: int, to: int, fills: dict[str, Column]) -> DataFrame:
    """``rows`` (id 0 .. n - 1, ...) and rows n .. to - 1 that hold ``fills``, null in columns without one."""
    spark = rows.sparkSession
    types = {f.name: f.dataType for f in rows.schema.fields}
    more = spark.range(n, max(n, to)).select(*[(F.col("id") if c == "id" else fills.get(c, F.lit(None))).cast(types[c]).alias(c) for c in rows.columns])
    return rows.unionByName(more)


def prefix_cap(rows: DataFrame, group: str, order: list[str], cap: int, out: str = "pos") -> DataFrame:
    """The first ``cap`` rows of each group in ``order``, numbered from 0 in ``out``.

    Up to TASK_CAP rows a group are limited within partitions before the shuffle; for more, rows are numbered over ranges.
    """
    if cap > TASK_CAP:
        return placed_in(rows, [group], order, out).where(F.col(out) < cap)
    place = F.row_number().over(W.partitionBy(group).orderBy(*order)).cast("bigint")
    return rows.withColumn(out, place).where(F.col(out) <= cap).withColumn(out, F.col(out) - 1)


def lift(f: Callable[[DataFrame], DataFrame], edges: DataFrame | list[DataFrame]) -> DataFrame | list[DataFrame]:
    """``f`` of one edge table, or of each in a list."""
    return [f(e) for e in edges] if isinstance(edges, list) else f(edges)


def local_subgraph(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, pos, is_context) and the edges by those positions: seeds first, then the edges' other nodes, each by id."""
    met = running(seed_first(seeds, edges), ["is_context", "node"], {"pos": 1})
    return met, induced(edges, met)


def grouped_walks(edges: DataFrame, ids: DataFrame, per_start: int, length: int, groups: int, seed: int = 0) -> DataFrame:
    """(grp, src, dst): start to visited node, where step d belongs to group (d - 1) mod groups.

    Ids are 0 .. n - 1. Each node's walks are as many as ``per_start`` in every group, and all walks in order
    of (start, walk) are cut into ``groups`` equal stretches, one a group. A node is a destination at the first step
    that reaches it only; visits at that same step all stay.
    """
    n = ids.count()
    which = F.expr(f"(start * {per_start * groups} + walk) div {max(1, n * per_start)}")
    m = moves(edges, ids, per_start * groups, length, seed).withColumn("grp", which).where((F.col("step") - 1) % groups == F.col("grp"))
    first = m.groupBy("node").agg(F.min("step").alias("step"))
    return m.join(first, ["node", "step"]).select("grp", F.col("start").alias("src"), F.col("node").alias("dst"))


def group_nodes(edges: DataFrame, ids: DataFrame, per_start: int, length: int, groups: int, cap: int, seed: int = 0) -> DataFrame:
    """(grp, pos, node): seeds with id mod groups = grp, then the nodes their walks meet, by step, start and walk.

    A node stands where its first step is, as often as that step meets it. ``cap`` bounds a group's list.
    """
    m = moves(edges, ids, per_start, length, seed).withColumn("grp", F.col("start") % groups).where(F.col("node") % groups != F.col("grp"))
    first = m.groupBy("grp", "node").agg(F.min("step").alias("step"))
    zero = F.lit(0).cast("bigint")
    seeds = ids.select((F.col("id") % groups).alias("grp"), zero.alias("step"), F.col("id").alias("start"), zero.alias("walk"), F.col("id").alias("node"))
    met = m.join(first, ["grp", "node", "step"]).select("grp", "step", "start", "walk", "node")
    return prefix_cap(seeds.unionByName(met), "grp", ["step", "start", "walk"], cap).select("grp", "pos", "node")


def edge_drop(edges: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """Edges kept with probability 1 - ratio by their key; where none would be left, all are. Copies share their fate."""
    if ratio <= 0:
        return edges
    keep = edge_key(F.col("src"), F.col("dst"), seed) >= ratio * MODULUS
    some = edges.agg(F.coalesce(F.bool_or(keep), F.lit(False)).alias("some"))
    return edges.crossJoin(F.broadcast(some)).where(keep | ~F.col("some")).drop("some")  # one row


def grouped_heads(edges: DataFrame, heads: int, groups: int) -> DataFrame:
    """(head, src, dst): edges fall into groups by src, and neighbouring heads share a group."""
    g = min(max(1, groups), heads)
    per = -(-heads // g)
    of_head = F.least(F.expr(f"head div {per}"), F.lit(g - 1).cast("bigint"))
    every = edges.select("src", "dst", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(heads - 1).cast("bigint"))).alias("head"))
    return every.where(F.col("src") % g == of_head).select("head", "src", "dst")


def hop_heads(edges: DataFrame, heads: int, hops: list[int], groups: int, buckets: int) -> DataFrame:
    """(head, src, dst): each group of heads sees the edges (src, dst, bucket) of one of ``hops``, bucket 0 where there is none."""
    g = min(max(1, groups), heads)
    per = -(-heads // g)
    named = [(h, hops[min(h // per, g - 1) % len(hops)]) for h in range(heads)]
    wanted = F.array(*[F.struct(F.lit(h).cast("bigint").alias("head"), F.lit(b if b < buckets else 0).alias("b")) for h, b in named])
    return edges.select("src", "dst", "bucket", F.inline(wanted)).where("bucket = b").select("head", "src", "dst")


def expander_graph(edges: DataFrame, ids: DataFrame, cycles: int, seed: int = 0) -> DataFrame:
    """(src, dst, etype): all real edges and self loops as 0, the cycles' edges as 1."""
    tag = lambda e, t: e.select("src", "dst", F.lit(t).cast("bigint").alias("etype"))
    loops = ids.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    return tag(edges, 0).unionByName(tag(loops, 0)).unionByName(tag(expander(ids, cycles, seed), 1))


def batch_tables(edges: DataFrame, nodes: DataFrame, size: int, width: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Batches of ``size`` nodes (id, x, y) in hash order, each with a virtual node, the last one padded.

    Nodes: (batch, pos, id, x, y); pos 0 is the virtual node, with null id, zeros and label -100, as padding has.
    Edges: (batch, src, dst) between nodes of one batch by position, and both ways between pos 0 and every real node.
    """
    at = running(nodes.withColumn("key", node_key(F.col("id"), seed)), ["key", "id"], {"at": 1})
    real = at.select(F.expr(f"at div {size}").alias("batch"), (F.col("at") % size + 1).alias("pos"), "id", "x", "y")
    slots = real.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).select("batch", F.explode(F.expr(f"array_union(array(0L), IF(n < {size}, sequence(n + 1, {size}L), array()))")).alias("pos"))
    empty = slots.select("batch", "pos", F.lit(None).cast("bigint").alias("id"), F.array_repeat(F.lit(0.0), width).alias("x"), F.lit(-100).cast("bigint").alias("y"))
    s, d = (real.select(F.col("batch").alias(f"b{c}"), F.col("pos").alias(f"p{c}"), F.col("id").alias(c)) for c in ("src", "dst"))
    inside = edges.join(s, "src").join(d, "dst").where("bsrc = bdst").select(F.col("bsrc").alias("batch"), F.col("psrc").alias("src"), F.col("pdst").alias("dst"))
    zero = F.lit(0).cast("bigint")
    up, down = real.select("batch", F.col("pos").alias("src"), zero.alias("dst")), real.select("batch", zero.alias("src"), F.col("pos").alias("dst"))
    return real.unionByName(empty), inside.unionByName(up).unionByName(down)


def weighted_sample(rows: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Without replacement, k edges (src, dst, w) of each dst with chances by weight: least -ln(u) / w, to nine digits, u by the edge's key."""
    u = (edge_key(F.col("src"), F.col("dst"), seed) + 1) / (MODULUS + 1.0)
    order = W.partitionBy("dst").orderBy(F.round(-F.ln(u) / F.col("w"), 9), "src")
    return rows.where("w > 0").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
