"""Budgeted selection of edges: per-query top-K, random walks, fan-out, and their assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plexus.functions.keys import edge_key, walk_key
from plexus.functions.ranks import running
from plexus.operators.edges import typed, union_distinct
from plexus.session import cut, exists, scratch, shared_dir

#: Seeds of the two families are moved by these.
REAL_SEED, WALK_SEED = 17, 37


def topk(edges: DataFrame, k: int, seed: int, tie: tuple[str, ...] = ("src",)) -> DataFrame:
    """The k edges of least key into each dst; 0 or less returns all. Copies of an edge use up budget.

    Catalyst limits within partitions before the shuffle, so a popular dst sends k edges a partition.
    """
    if k <= 0:
        return edges
    order = W.partitionBy("dst").orderBy(edge_key(F.col("src"), F.col("dst"), seed), *tie)
    return edges.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def budgets(total: int, walks_per_node: int = 1) -> tuple[int, int]:
    """Real and walk budget of a total; all real without walks."""
    return (total, 0) if walks_per_node <= 0 else ((total + 1) // 2, total // 2)


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, pos, dst, deg): out-neighbours numbered by id; no task orders a hub's whole list.

    A node's first place in the whole order and its degree are met in one join.
    """
    placed = running(edges.select("src", "dst"), ["src", "dst"], {"at": 1})
    per = placed.groupBy("src").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("deg"))
    return placed.join(per, "src").select("src", (F.col("at") - F.col("first")).alias("pos"), "dst", "deg")


#: Neighbours that one row of a walk graph has, at most; hubs have several rows.
NEAR = 1024
#: Edges that a bucket of a walk graph has, about, and buckets at least and at most.
BUCKET_EDGES, FEWEST, MOST = 4_000_000, 8, 20_000


def walk_graph(edges: DataFrame) -> DataFrame:
    """(node, block, deg, near): out-neighbours in order of their ids, NEAR a row, stored in buckets by node.

    The table is named after the edges, by their number and two sums of hashes over all of them, and lies in the shared folder:
    whoever asks for the walk graph of the same edges again, in this session or another one, reads what is there.
    """
    spark = edges.sparkSession
    total = lambda *salt: F.sum(F.xxhash64(*salt, "src", "dst").cast("decimal(38,0)"))
    n, a, b = edges.agg(F.count(F.lit(1)), total(), total(F.lit(1))).first()
    name = f"walk_graph_{n}_{int(a or 0) % 2**64:016x}{int(b or 0) % 2**64:016x}"
    path, buckets = f"{shared_dir(spark)}/{name}", min(MOST, max(FEWEST, -(-n // BUCKET_EDGES)))
    stored = exists(spark, f"{path}/_SUCCESS")
    if not (stored and spark.catalog.tableExists(name)):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        if stored:
            spark.sql(f"CREATE TABLE {name} (node BIGINT, block BIGINT, deg BIGINT, near ARRAY<BIGINT>) USING parquet CLUSTERED BY (node) SORTED BY (node, block) INTO {buckets} BUCKETS LOCATION '{path}'")
        else:
            with scratch(spark):
                placed = adjacency(edges).select(F.col("src").alias("node"), F.expr(f"pos div {NEAR}").alias("block"), "pos", "dst", "deg")
                rows = placed.groupBy("node", "block").agg(F.max("deg").alias("deg"), F.array_sort(F.collect_list(F.struct("pos", "dst"))).getField("dst").alias("near"))
                rows.write.bucketBy(buckets, "node").sortBy("node", "block").option("path", path).mode("overwrite").saveAsTable(name)
    return spark.table(name)


def paths(edges: DataFrame, starts: DataFrame, per_start: int, length: int, seed: int = 0) -> DataFrame:
    """(start, walk, path) with the nodes of steps 0 .. length; a sink repeats itself.

    One equi join a step, with one row a node of the stored :func:`walk_graph`, and one more for walks that go beyond a hub's first
    row; lineage is cut every four steps.
    """
    graph = walk_graph(edges)
    first = graph.where("block = 0").select("node", "deg", "near")
    others = graph.where("block > 0").select("node", F.col("block").alias("_block"), F.col("near").alias("_more"))
    hubs = not others.isEmpty()
    now = starts.select(F.col("id").alias("start"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(per_start - 1).cast("bigint"))).alias("walk")).withColumn("node", F.col("start"))
    path = now.withColumn("path", F.array("start"))
    for step in range(1, length + 1):
        drawn = path.join(first, "node", "left").withColumn("_p", walk_key(F.col("start"), F.col("walk"), step, seed) % F.col("deg"))
        drawn = drawn.withColumn("_next", F.when(F.col("_p") < NEAR, F.get("near", F.col("_p").cast("int")))).drop("near", "deg")
        if hubs:
            drawn = drawn.withColumn("_block", F.expr(f"_p div {NEAR}")).join(others, ["node", "_block"], "left")
            drawn = drawn.withColumn("_next", F.coalesce("_next", F.get("_more", (F.col("_p") % NEAR).cast("int")))).drop("_more", "_block")
        path = drawn.withColumn("node", F.coalesce("_next", "node")).drop("_next", "_p")
        path = path.withColumn("path", F.concat("path", F.array("node")))
        if step % 4 == 0 and step < length:
            path = cut(path, "walks")
    return path.select("start", "walk", "path")


def walks(edges: DataFrame, starts: DataFrame, per_start: int, length: int, seed: int = 0) -> DataFrame:
    """(start, walk, step, node): one row a step of :func:`paths`."""
    steps = paths(edges, starts, per_start, length, seed).select("start", "walk", F.posexplode("path").alias("step", "node"))
    return steps.withColumn("step", F.col("step").cast("bigint"))


def visits(edges: DataFrame, starts: DataFrame, per_start: int, length: int, seed: int = 0) -> DataFrame:
    """(start, walk, step, node, prev) with step 1 .. length; the node before comes from the path itself, without a shuffle."""
    at = lambda d: F.struct(d.cast("bigint").alias("step"), F.get("path", d).alias("node"), F.get("path", d - 1).alias("prev"))
    steps = F.transform(F.sequence(F.lit(1), F.lit(length)), at)
    return paths(edges, starts, per_start, length, seed).select("start", "walk", F.inline(steps))


def moves(edges: DataFrame, starts: DataFrame, per_start: int, length: int, seed: int = 0) -> DataFrame:
    """The visits that count: the first step, and every later one that leaves its node."""
    return visits(edges, starts, per_start, length, seed).where("step = 1 OR node <> prev")


def walk_pool(edges: DataFrame, starts: DataFrame, per_start: int, length: int, min_hop: int = 1, seed: int = 0) -> DataFrame:
    """(src, dst, walk, hop): visited node to its start, at hops from min_hop on.

    A step that stays where it was counts at hop 1 only, so a sink gives one self edge a walk.
    """
    kept = moves(edges, starts, per_start, length, seed).where(F.col("step") >= min_hop)
    return kept.select(F.col("node").alias("src"), F.col("start").alias("dst"), "walk", F.col("step").alias("hop"))


def seed_subgraph(edges: DataFrame, seeds: DataFrame, per_start: int, length: int, seed: int = 0) -> DataFrame:
    """Distinct edges from each step's node to the node before it and to the walk's start."""
    s = visits(edges, seeds, per_start, length, seed)
    both = s.select(F.col("node").alias("src"), F.col("prev").alias("dst")).unionByName(s.select(F.col("node").alias("src"), F.col("start").alias("dst")))
    return both.distinct()


def seed_first(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, is_context): the seeds, then the other distinct nodes of the edges."""
    met = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    s = seeds.select(F.col("id").alias("node"))
    return s.withColumn("is_context", F.lit(False)).unionByName(met.join(s, "node", "left_anti").withColumn("is_context", F.lit(True)))


def fanout_pool(edges: DataFrame, queries: DataFrame, fanouts: tuple[int, ...], min_hop: int = 1, seed: int = 0) -> DataFrame:
    """(src, dst, hop): nodes reached from each query over at most f out-edges of each frontier node.

    The choice of a node's out-edges is shared by all queries; f < 0 takes all; self edges are left out.
    """
    now = queries.select(F.col("id").alias("dst"), F.col("id").alias("cur"))
    out = None
    for hop, f in enumerate(fanouts, 1):
        own = edges.join(now.select(F.col("cur").alias("src")).distinct(), "src", "left_semi")
        if f >= 0:
            order = W.partitionBy("src").orderBy(edge_key(F.col("dst"), F.col("src"), seed + hop), "dst")
            own = own.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= f).drop("_r")
        now = now.join(own.select(F.col("src").alias("cur"), F.col("dst").alias("nxt")), "cur").select("dst", F.col("nxt").alias("cur"))
        if hop >= min_hop:
            part = now.where("cur <> dst").select(F.col("cur").alias("src"), "dst", F.lit(hop).cast("bigint").alias("hop"))
            out = part if out is None else out.unionByName(part)
    return out


def families(edges: DataFrame, starts: DataFrame, real: int, rw: int, per_start: int, length: int, seed: int) -> tuple[DataFrame | None, DataFrame | None]:
    """The two selected families, None for one without budget."""
    edges = cut(edges.select("src", "dst"), "budgeted") if rw > 0 else edges  # read by both and by the walk graph
    chosen = topk(edges, real, seed + REAL_SEED) if real > 0 else None
    pool = None
    if rw > 0:
        pool = topk(walk_pool(edges, starts, per_start, length, 1, seed), rw, seed + WALK_SEED, ("src", "walk", "hop")).select("src", "dst")
    return chosen, pool


def merged(edges: DataFrame, starts: DataFrame, real: int, rw: int, per_start: int = 2, length: int = 2, seed: int = 0) -> DataFrame:
    """Budgeted edges of both families, distinct when both are there."""
    parts = [p for p in families(edges, starts, real, rw, per_start, length, seed) if p is not None]
    return union_distinct(*parts) if parts else edges.where(F.lit(False))


def merged_typed(edges: DataFrame, starts: DataFrame, real: int, rw: int, per_start: int = 2, length: int = 2, seed: int = 0) -> DataFrame:
    chosen, pool = families(edges, starts, real, rw, per_start, length, seed)
    loops = starts.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    none = edges.select("src", "dst").where(F.lit(False))
    return typed(chosen if chosen is not None else none, pool if pool is not None else none, loops)
