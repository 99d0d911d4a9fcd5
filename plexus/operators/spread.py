"""Frontier loops and propagation over edges; each loop has a small fixed bound."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plexus.functions.ranks import running
from plexus.operators.attend import vector_sum
from plexus.operators.edges import TASK_ROWS, bidirect
from plexus.operators.slabs import Slab, Slabs, met, slabs
from plexus.operators.standing import Standing, standing, with_sums
from plexus.operators.strips import Strips, summed, undirected_strips
from plexus.session import cut, drop, settled


def reception_cone(edges: DataFrame, probes: DataFrame, layers: int) -> DataFrame:
    """(id, depth): probes and in-neighbours up to layers - 1 hops, each at its first depth."""
    seen = probes.select("id").distinct().withColumn("depth", F.lit(0).cast("bigint"))
    edge = seen
    for depth in range(1, layers):
        reached = edges.join(edge.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
        edge = cut(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth).cast("bigint")), "cone")
        seen = seen.unionByName(edge)
    return seen


def spd_bins(edges: DataFrame, batch: DataFrame, most: int) -> DataFrame:
    """(src, dst, bin) of all pairs within each batch of (id, batch): undirected distance over nodes of the
    batch, ``most`` beyond it or unreachable.

    All pairs of a batch are the result itself, so batches are bounded sets; any number of them is taken at once.
    They are dealt to as many tasks as their number asks for.
    """
    ids = batch.select("id", "batch").distinct()
    # Few edges stay within a batch: the others go before repeats are taken out, and pass by the nodes of a task unsorted.
    side = lambda x: ids.select(F.col("id").alias(x), F.col("batch").alias(f"{x}_batch")).hint("shuffle_hash")
    inside = edges.where("src <> dst").join(side("src"), "src").join(side("dst"), "dst").where("src_batch = dst_batch").select("src", "dst")
    held = cut(inside, "inside")
    inside = cut(bidirect(held).select(F.col("src").alias("mid"), F.col("dst").alias("to")), "spd")
    drop(held)
    near = ids.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).cast("bigint").alias("d"))
    edge = near
    for d in range(1, most):
        reached = edge.join(inside, edge["dst"] == inside["mid"]).select(edge["src"], F.col("to").alias("dst")).distinct()
        edge = cut(reached.join(near, ["src", "dst"], "left_anti").withColumn("d", F.lit(d).cast("bigint")), "spd")
        near = near.unionByName(edge)
    n_pairs = ids.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    pairs = ids.select("batch", F.col("id").alias("src")).join(ids.select("batch", F.col("id").alias("dst")), "batch")
    pairs = pairs.repartition(max(1, -(-n_pairs // TASK_ROWS)), "src", "dst")
    return pairs.join(near, ["src", "dst"], "left").select("src", "dst", F.coalesce("d", F.lit(most)).cast("bigint").alias("bin"))


def one_hot_bins(bins: DataFrame, most: int) -> DataFrame:
    """(src, dst, hot): a 1 at the place of each pair's bin among 0 .. most; a null bin has none."""
    hot = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda b: F.coalesce((b == F.col("bin")).cast("int"), F.lit(0)))
    return bins.select("src", "dst", hot.alias("hot"))


def sym_norm(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(src, dst, w): D^-1/2 (A + I) D^-1/2 of the undirected distinct graph; degrees count the loop."""
    loops = ids.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    a = bidirect(edges).where("src <> dst").unionByName(loops)
    deg = a.groupBy("dst").agg(F.count(F.lit(1)).alias("deg"))
    s, d = deg.select(F.col("dst").alias("src"), F.col("deg").alias("ds")), deg.withColumnRenamed("deg", "dd")
    return a.join(s, "src").join(d, "dst").select("src", "dst", (1 / F.sqrt(F.col("ds").cast("double") * F.col("dd"))).alias("w"))


def row_norm_right(edges: DataFrame) -> DataFrame:
    """(src, dst, w): A times the inverse row sums from the right; rows without edges weigh 0."""
    sums = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).select(F.col("src").alias("dst"), "n")
    return edges.join(sums, "dst", "left").select("src", "dst", F.coalesce(1 / F.col("n"), F.lit(0.0)).alias("w"))


def propagate(weighted: DataFrame, features: DataFrame, hops: int, width: int) -> DataFrame:
    """(id, hop, x): features (id, x) and their weighted sums over in-edges, hop after hop."""
    now = features.select("id", "x")
    out = [now.withColumn("hop", F.lit(0).cast("bigint"))]
    for hop in range(1, hops + 1):
        msgs = weighted.join(now.withColumnRenamed("id", "src"), "src")
        now = cut(vector_sum(msgs, ["dst"], F.transform("x", lambda v: v * F.col("w")), "x").withColumnRenamed("dst", "id"), "propagate")
        out.append(now.withColumn("hop", F.lit(hop).cast("bigint")))
    return reduce(DataFrame.unionByName, out)


def scales(of: Strips, ids: DataFrame) -> DataFrame:
    """(id, f): deg ** -1/2 of the undirected graph of ``of``, degrees with a loop at every node."""
    met = summed(of, ids.select("id", F.array(F.lit(1.0)).alias("x")), 1)
    return ids.select("id").distinct().join(met, "id", "left").select("id", (1 / F.sqrt(1 + F.coalesce(F.get("x", F.lit(0)), F.lit(0.0)))).alias("f"))


def smoothed(of: Strips, now: DataFrame, width: int) -> DataFrame:
    """(id, f, x) after one step: D^-1/2 (A + I) D^-1/2 times the vectors of (id, f, x), f from :func:`scales`.

    A neighbour's vector is scaled before it is sent and the sum after it, so no edge has a weight of its own.
    """
    sent = now.select("id", F.transform("x", lambda v: v * F.col("f")).alias("x"))
    sums = summed(of, sent, width).withColumnRenamed("x", "s")
    own = F.transform("x", lambda v: v * F.col("f"))
    both = F.when(F.col("s").isNull(), own).otherwise(F.zip_with(own, "s", lambda a, b: a + b))
    return now.join(sums, "id", "left").select("id", "f", F.transform(both, lambda v: v * F.col("f")).alias("x"))


def propagate_smoothed(edges: DataFrame, features: DataFrame, hops: int, width: int) -> DataFrame:
    """(id, hop, x): :func:`propagate` along the weights of :func:`sym_norm`, which are never written for edges.

    All ends of ``edges`` are nodes of ``features`` (id, x).
    """
    of = undirected_strips(edges, features)
    now = cut(features.select("id", "x").join(scales(of, features), "id").select("id", "f", "x"), "propagate")
    out = [now.select("id", "x", F.lit(0).cast("bigint").alias("hop"))]
    for hop in range(1, hops + 1):
        now = cut(smoothed(of, now, width), "propagate")
        out.append(now.select("id", "x", F.lit(hop).cast("bigint").alias("hop")))
    drop(of.rows)
    return reduce(DataFrame.unionByName, out)


def ppr_push(edges: DataFrame, sources: DataFrame, c: float = 0.15, epsilon: float = 1e-6) -> DataFrame:
    """(source, node, p, r): personalised PageRank by forward push, and the residual that is left at each node.

    A walk from the source stops at each step with probability ``c`` and else follows an out-edge. All nodes whose
    residual is at least ``epsilon`` for each out-edge are pushed at once, round after round: the share c of the residual
    becomes rank, the rest goes to the out-neighbours. A push that sends anything settles c * epsilon of a source's mass of 1 an
    edge, so a source holds at most 1 / (c * epsilon) nodes however large the graph is. ``p`` falls short of the true rank by
    the source's remaining residuals at most, all of them together. Mass that reaches a node without out-edges ends there.
    """
    spark = edges.sparkSession

    def run() -> DataFrame:
        arcs = cut(edges.select("src", "dst").distinct(), "arcs")
        deg = arcs.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
        start = sources.select(F.col("id").alias("source")).distinct().withColumn("node", F.col("source"))
        state = cut(start.join(deg, "node", "left").select("source", "node", F.lit(0.0).alias("p"), F.lit(1.0).alias("r"), F.coalesce("deg", F.lit(0)).alias("deg")), "push")
        due = (F.col("r") > 0) & (F.col("r") >= F.col("deg") * epsilon)
        while not state.where(due).isEmpty():
            sent = state.where(due & (F.col("deg") > 0)).select("source", F.col("node").alias("src"), (F.col("r") * (1 - c) / F.col("deg")).alias("r"))
            got = sent.join(arcs, "src").groupBy("source", F.col("dst").alias("node")).agg(F.sum("r").alias("r"))
            kept = state.select("source", "node", (F.col("p") + F.when(due, F.col("r") * c).otherwise(0.0)).alias("p"), F.when(due, 0.0).otherwise(F.col("r")).alias("r"))
            both = kept.unionByName(got.withColumn("p", F.lit(0.0))).groupBy("source", "node").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
            after = cut(both.join(deg, "node", "left").select("source", "node", "p", "r", F.coalesce("deg", F.lit(0)).alias("deg")), "push")
            drop(state)
            state = after
        return state.select("source", "node", "p", "r")

    return settled(spark, run, "pushed")


def ppr_topk(edges: DataFrame, sources: DataFrame, k: int, c: float = 0.15, epsilon: float = 1e-6) -> DataFrame:
    """(src, dst, rank, held, residual): the k nodes of largest personalised PageRank of each source, itself left out.

    The ranks of :func:`ppr_push`, but only nodes that have been pushed are kept: a residual is what they have sent to a node, and the
    1 that a source begins with, less the node's rank over c, so it is summed anew each round where a band of nodes is at hand and never
    written. ``held`` is the number of nodes that the source reached with a rank or a residual, ``residual`` what their ranks may fall short by
    together. Scores that are equal to nine digits tie by identifier. Repeats in ``edges`` don't matter.
    """
    spark = edges.sparkSession

    def run() -> DataFrame:
        of, tops = slabs(edges), []
        starts = sources.select(F.col("id").alias("source")).distinct().join(of.degrees.withColumnRenamed("node", "source"), "source")
        state = cut(starts.where(F.col("deg") * epsilon <= 1).select("source", F.col("source").alias("node"), F.lit(c).alias("p")), "push")
        order = W.partitionBy("source").orderBy(F.round("p", 9).desc(), "node")
        while True:
            found = cut(_residuals(of, state, k, c, epsilon), "residuals")
            due = found.where("kind = 1")
            going = due.select("source").distinct()
            n = found.groupBy("source").agg(F.max((F.col("kind") == 1).cast("int")).alias("due")).agg(F.coalesce(F.sum("due"), F.lit(0)).alias("due"), F.count(F.lit(1)).alias("all")).first()
            if n["due"] < n["all"] or not n["due"]:
                per = found.where("kind = 0").join(going, "source", "left_anti").groupBy("source").agg((F.sum("held") + 1).alias("held"), F.sum("value").alias("residual"))
                ranks = state.unionByName(found.where("kind = 2").select("source", "node", F.col("value").alias("p"))).join(going, "source", "left_anti")
                best = ranks.where("source <> node").withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)
                tops.append(cut(best.join(per, "source").select(F.col("source").alias("src"), F.col("node").alias("dst"), "rank", "held", "residual"), "top"))
            if not n["due"]:
                return reduce(DataFrame.unionByName, tops)
            pushed = due.select("source", "node", (F.col("value") * c).alias("p"))
            after = cut(state.join(going, "source", "left_semi").unionByName(pushed).groupBy("source", "node").agg(F.sum("p").alias("p")), "push")
            drop(state, found)
            state = after

    return settled(spark, run, "ppr-top")


def _residuals(of: Slabs, state: DataFrame, k: int, c: float, epsilon: float) -> DataFrame:
    """(source, kind, node, value, held) of ranks (source, node, p) of nodes with out-edges: kind 0, for each slab, the sum of residuals and the number of nodes
    reached but for the source; kind 1 the residuals of nodes that are due; kind 2 the ranks, to nine digits, of the k best nodes without out-edges in a slab."""
    dealt = state.select(F.col("source").alias("grp"), of.band("node").alias("band"), of.place("node").alias("place"), "p")
    rows = dealt.groupBy("grp", "band").agg(F.collect_list(F.struct("place", "p")).alias("s")).select("grp", F.lit(0).cast("bigint").alias("member"), "band", F.col("s.place").alias("ends"), F.col("s.p").alias("mass"))
    width = of.width

    def fold(slab: Slab, by_source: Iterator) -> Iterator[pa.RecordBatch]:
        degrees = {band: slab.inside(band) for band in slab.bands}
        names = ["source", "kind", "node", "value", "held"]
        out, n = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*out, strict=True)], names=names)

        def add(source: int, kind: int, nodes: np.ndarray, values: np.ndarray, held: int = 0) -> int:
            out.append((np.full(len(nodes), source), np.full(len(nodes), kind), nodes, values, np.full(len(nodes), held)))
            return len(nodes)

        for source, ((_, nodes, p),) in by_source:
            at = slab.at(nodes)
            sent, held, residual, ends = p * (1 - c) / (c * slab.degree[at]), 0, 0.0, []
            for band, deg in degrees.items():
                got, first = slab.sums(band, at, sent), band * width
                own = (nodes >= first) & (nodes < first + width)
                left = got.copy()
                left[nodes[own] - first] -= p[own] / c
                held += np.count_nonzero(got)
                if first <= source < first + width:
                    left[source - first] += 1
                    held -= int(got[source - first] > 0)
                # Rank less what was sent is 0 but for rounding where a node has just been pushed.
                left = np.where(deg > 0, np.maximum(left, 0), 0)
                residual += left.sum()
                due = np.flatnonzero((left > 0) & (left >= deg * epsilon))
                n += add(source, 1, first + due, left[due])
                sinks = np.flatnonzero((got > 0) & (deg == 0))
                ends.append((first + sinks, np.floor(c * got[sinks] * 1e9 + 0.5) / 1e9))
            n += add(source, 0, np.array([source]), np.array([residual]), held)
            if ends:
                sinks, rank = (np.concatenate(v) for v in zip(*ends, strict=True))
                best = np.lexsort((sinks, -rank))[:k]
                n += add(source, 2, sinks[best], rank[best])
            if n >= 1 << 16 or len(out) >= 1 << 14:
                yield batch()
                out, n = [], 0
        if out:
            yield batch()

    return met(of, rows, fold, "source bigint, kind bigint, node bigint, value double, held bigint")


def laplacian_encoding(edges: DataFrame, ids: DataFrame, k: int, tolerance: float = 1e-6, most_rounds: int = 3000) -> DataFrame:
    """(id, pe): k vectors for the smallest nontrivial eigenvalues of the normalised Laplacian of the
    bidirected graph with self loops.

    Rayleigh-Ritz over a block of k + 6 vectors, the residuals and last steps of k + 2 of them, with the trivial vector taken
    out, until the first k residuals of D^-1/2 (A + I) D^-1/2 are at most ``tolerance`` long; raises where they
    are not after ``most_rounds``. Edges stand still (:mod:`~plexus.operators.standing`): a round is one job that sends the
    residuals, and only products of the block's columns come to the driver. Signs and, for equal
    eigenvalues, rotations are arbitrary; with fewer than k + 1 nodes there are fewer vectors. An end of an edge that ``ids`` lacks is a node too.
    """
    spark, of = edges.sparkSession, standing(edges, ids)
    n = of.n
    k, b = max(0, min(k, n - 1)), max(0, min(k + 6, n - 1))
    q = min(b, k + 2)

    def run() -> DataFrame:
        rows = spark.range(len(of.names)).select(F.col("id").cast("int").alias("at"))
        now, theta, held = _started(of, rows, b), None, None
        for _ in range(most_rounds):
            now = cut(with_sums(of, now, "v", _multiplied, _BLOCK), "pe-step")
            if held is not None:
                drop(held)
            held = now
            # Columns of s: the trivial vector, the block, its residuals, its last steps; ms is the matrix times s.
            parts = [np.frombuffer(r["g"]) for r in now.select("g").collect()]
            m = int(round((len(parts[0]) / 2) ** 0.5))
            g, h = sum(parts).reshape(2, m, m)
            if theta is not None and np.sqrt(np.maximum(np.diag(g)[1 + b : 1 + b + k], 0)).max() <= tolerance:
                return _vectors(of, now, k)
            # Unit columns without their share of the trivial vector, which the matrix leaves as it is.
            out = np.eye(m)[:, 1:]
            out[0] = -g[0, 1:] / g[0, 0]
            out /= np.sqrt(np.maximum(np.diag(out.T @ g @ out), 1e-300))
            value, vector = np.linalg.eigh(out.T @ g @ out)
            base = out @ (vector[:, value > 1e-10] / np.sqrt(value[value > 1e-10]))
            small = base.T @ h @ base
            value, vector = np.linalg.eigh((small + small.T) / 2)
            c = (base @ vector)[:, ::-1][:, :b]
            step = c[:, :q].copy()
            step[0] = 0
            if theta is not None:
                step[1 : 1 + b] = 0
            theta = value[::-1][:b]
            now = _combined(now, c, step, theta)
        raise RuntimeError("the eigenvectors did not settle")

    try:
        return settled(spark, run, "pe") if k else ids.select("id", F.array().cast("array<double>").alias("pe"))
    finally:
        of.drop()


#: One row a strip; columns of nodes one after the other. v is the residual over t, t the roots of degrees.
_STATE = "at int, v binary, t binary, x binary, mx binary, p binary, mp binary"
_BLOCK = f"{_STATE}, mr binary, g binary"


def _started(of: Standing, rows: DataFrame, b: int) -> DataFrame:
    """The first state of rows (at): roots of degrees, and ``b`` columns at random."""
    n, height = of.n, of.height

    def ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d in batches:
            at = d.column("at").to_pylist()
            yield pa.RecordBatch.from_arrays([d.column("at"), pa.array([np.ones(min(height, n - i * height), np.float32).tobytes() for i in at], pa.binary())], names=["at", "v"])

    def begun(at: int, _: dict, sums: np.ndarray) -> dict:
        t = np.sqrt(1 + sums[0])
        v = (np.random.default_rng([7, at]).random((b, len(t))) - 0.5) / t
        return {"at": at, "v": v.astype(np.float32).tobytes(), "t": t.tobytes()} | dict.fromkeys(("x", "mx", "p", "mp"), b"")

    return cut(with_sums(of, rows.mapInArrow(ones, "at int, v binary"), "v", begun, _STATE), "pe-step")


def _columns(row: dict, names: tuple[str, ...], tall: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(row[c]).reshape(-1, tall) for c in names])


def _residual(row: dict, t: np.ndarray) -> np.ndarray:
    return np.frombuffer(row["v"], np.float32).reshape(-1, len(t)).astype(float) * t


def _multiplied(at: int, row: dict, sums: np.ndarray) -> dict:
    """A strip's state with the matrix times its residuals, and its share of the products of all columns."""
    t = np.frombuffer(row["t"])
    mr = sums / t + np.frombuffer(row["v"], np.float32).reshape(sums.shape) / t
    r = _residual(row, t)
    s = np.concatenate([t[None], _columns(row, ("x",), len(t)), r, _columns(row, ("p",), len(t))])
    ms = np.concatenate([t[None], _columns(row, ("mx",), len(t)), mr, _columns(row, ("mp",), len(t))])
    return row | {"at": at, "mr": mr.tobytes(), "g": np.stack([s @ s.T, s @ ms.T]).tobytes()}


def _combined(now: DataFrame, c: np.ndarray, step: np.ndarray, theta: np.ndarray) -> DataFrame:
    """The next block, its matrix product, residual and step as combinations of the columns at hand."""
    q = step.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d in batches:
            for row in d.to_pylist():
                t = np.frombuffer(row["t"])
                s = np.concatenate([t[None], _columns(row, ("x",), len(t)), _residual(row, t), _columns(row, ("p",), len(t))])
                ms = np.concatenate([t[None], _columns(row, ("mx", "mr", "mp"), len(t))])
                x, mx = c.T @ s, c.T @ ms
                # Rounded, it is the new column all the same: the products are those of what was sent.
                v = ((mx[:q] - theta[:q, None] * x[:q]) / t).astype(np.float32)
                new = [row["at"], *(w.tobytes() for w in (v, t, x, mx, step.T @ s, step.T @ ms))]
                kinds = [pa.int32(), *[pa.binary()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array([w], kind) for w, kind in zip(new, kinds, strict=True)], names=["at", "v", "t", "x", "mx", "p", "mp"])

    return now.select("at", "v", "t", "x", "mx", "p", "mp", "mr").mapInArrow(run, _STATE)


def _vectors(of: Standing, now: DataFrame, k: int) -> DataFrame:
    """(id, pe) of the block's first ``k`` columns."""
    height, low = of.height, of.low if of.ids is None else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d in batches:
            for row in d.to_pylist():
                tall = len(row["t"]) // 8
                x = np.frombuffer(row["x"]).reshape(-1, tall)[:k].T
                for a in range(0, tall, 1 << 16):
                    part = x[a : a + (1 << 16)]
                    lists = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * k, np.ascontiguousarray(part).ravel())
                    yield pa.RecordBatch.from_arrays([pa.array(low + row["at"] * height + a + np.arange(len(part))), lists], names=["pos", "pe"])

    got = now.select("at", "t", "x").mapInArrow(run, "pos bigint, pe array<double>")
    return got.withColumnRenamed("pos", "id") if of.ids is None else of.ids.join(got, "pos").select("id", "pe")


def partition_relabel(edges: DataFrame, ids: DataFrame, rounds: int = 3) -> DataFrame:
    """(id, part, new_id): parts by label propagation (most frequent neighbour label, then the smallest),
    new ids contiguous by part, numbered over ranges of the node table."""
    near = cut(bidirect(edges).where("src <> dst"), "parts-edges")
    tasks = max(1, -(-near.count() // TASK_ROWS))
    label = ids.select("id", F.col("id").alias("part"))
    for _ in range(rounds):
        # Votes are dealt by their destination before they are counted, so that a task counts TASK_ROWS or so however many there are.
        cast = near.join(label.withColumnRenamed("id", "src"), "src").select("dst", "part").repartition(tasks, "dst")
        votes = cast.groupBy("dst", "part").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("dst").agg(F.max(F.struct("n", (-F.col("part")).alias("minus"))).alias("b"))
        label = label.join(best.withColumnRenamed("dst", "id"), "id", "left").select("id", F.coalesce(-F.col("b.minus"), F.col("part")).alias("part"))
        label = cut(label, "parts")
    return running(label, ["part", "id"], {"new_id": 1})
