"""A whole forward pass of a graph transformer, with its weights as a table.

Weights are rows (layer, row, col, value); col -1 holds biases. A layer's matrix, whose size does not depend on the graph, goes to every task if
it is small enough, and node vectors are multiplied where they are, without a shuffle; a larger one meets the
vectors by blocks of columns. Attention runs along edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexus.operators.attend import layer_norm, log_softmax, vector_sum
from plexus.session import cut, ship

#: Cells of a matrix that goes to every task, at most: 64 MB.
CELLS = 8_000_000
#: Columns of a block of a larger matrix.
BLOCK = 64


def dense(nodes: DataFrame, weights: DataFrame, layer: str, act: str | None = None, cells: int = CELLS) -> DataFrame:
    """(id, x) with x' = W x + b of one layer, then gelu or relu where ``act`` names it."""
    own = weights.where(F.col("layer") == layer)
    n, rows, cols = own.agg(F.count(F.lit(1)), F.max("row"), F.max("col")).first()
    if not n:
        raise ValueError(f"no weights of {layer}")
    rows, cols = rows + 1, cols + 1
    spark = nodes.sparkSession
    ship(spark)
    if rows * max(1, cols) > cells:
        return _activated(_by_blocks(nodes, own, rows), act)
    matrix, bias = np.zeros((rows, max(1, cols))), np.zeros(rows)
    for r in own.collect():  # ``cells`` at most
        if r["col"] < 0:
            bias[r["row"]] = r["value"]
        else:
            matrix[r["row"], r["col"]] = r["value"]
    held = spark.sparkContext.broadcast((matrix, bias))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, b = held.value
        for d in batches:
            if len(d):
                yield pd.DataFrame({"id": d["id"], "x": list(np.stack(d["x"].to_list()) @ w.T + b)})

    return _activated(nodes.select("id", "x").mapInPandas(run, "id bigint, x array<double>"), act)


def _by_blocks(nodes: DataFrame, own: DataFrame, rows: int) -> DataFrame:
    """The same product by a join: a node's slice of BLOCK columns meets the matrix's slices of as many rows and columns."""
    cell = F.struct((F.col("row") % BLOCK).cast("int").alias("r"), (F.col("col") % BLOCK).cast("int").alias("c"), "value")
    table = own.where("col >= 0").groupBy(F.expr(f"col div {BLOCK}").alias("b"), F.expr(f"row div {BLOCK}").alias("to")).agg(F.collect_list(cell).alias("cells"))
    parts = nodes.select("id", "x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(size(x) - 1) div {BLOCK}"))).alias("b"))
    parts = parts.select("id", "b", F.slice("x", (F.col("b") * BLOCK + 1).cast("int"), F.lit(BLOCK)).alias("x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out = []
            for x, cells in zip(d["x"], d["cells"], strict=True):
                v = np.zeros(BLOCK)
                for c in cells:
                    v[c["r"]] += c["value"] * x[c["c"]]
                out.append(v)
            yield pd.DataFrame({"id": d["id"], "to": d["to"], "x": out})

    made = parts.join(table, "b").select("id", "to", "x", "cells").mapInPandas(run, "id bigint, to bigint, x array<double>")
    sums = vector_sum(made, ["id", "to"], "x", "x")
    whole = sums.groupBy("id").agg(F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("to", "x"))), lambda s: s["x"])), 1, rows).alias("x"))
    bias = own.where("col < 0").agg(F.map_from_entries(F.collect_list(F.struct(F.col("row").cast("int"), "value"))).alias("bias"))  # a layer's rows
    return whole.crossJoin(F.broadcast(bias)).select("id", F.transform("x", lambda v, i: v + F.coalesce(F.try_element_at("bias", i), F.lit(0.0))).alias("x"))


def _activated(nodes: DataFrame, act: str | None) -> DataFrame:
    if act == "relu":
        return nodes.select("id", F.transform("x", lambda v: F.greatest(v, F.lit(0.0))).alias("x"))
    if act != "gelu":
        return nodes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gelu = np.vectorize(lambda v: 0.5 * v * (1 + erf(v / 2**0.5)), otypes=[float])
        for d in batches:
            if len(d):
                yield pd.DataFrame({"id": d["id"], "x": list(gelu(np.stack(d["x"].to_list())))})

    return nodes.mapInPandas(run, "id bigint, x array<double>")


def _normal(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", layer_norm("x").alias("x"))


def _added(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("x", "y"), "id").select("id", F.zip_with("x", "y", lambda p, q: p + q).alias("x"))


def attention(nodes: DataFrame, edges: DataFrame, weights: DataFrame, layer: str, heads: int) -> DataFrame:
    """(id, x): multi-head attention along edges, its projections ``layer``.q, .k, .v and .o; zeros before .o for a node without in-edges."""
    q, k, v = (dense(nodes, weights, f"{layer}.{p}") for p in "qkv")
    both = k.withColumnRenamed("x", "k").join(v.withColumnRenamed("x", "v"), "id").withColumnRenamed("id", "src")
    e = edges.join(both, "src").join(q.select(F.col("id").alias("dst"), F.col("x").alias("q")), "dst")
    dim = F.expr(f"size(q) div {heads}").cast("int")
    each = F.sequence(F.lit(0), F.lit(heads - 1))
    part = lambda c, h: F.slice(c, h * dim + 1, dim)
    dot = lambda h: F.aggregate(F.zip_with(part("k", h), part("q", h), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    w = F.transform(each, lambda h: F.exp(F.greatest(F.least(dot(h) / F.sqrt(dim), F.lit(5.0)), F.lit(-5.0))))
    scored = e.select("dst", "v", w.alias("w"), dim.alias("dim"))
    sent = F.concat(F.transform("v", lambda x, i: x * F.get("w", F.floor(i / F.col("dim")).cast("int"))), "w")
    sums = vector_sum(scored, ["dst"], sent, "s").withColumnRenamed("dst", "id")
    n = F.size("s") - heads
    out = F.transform(F.slice("s", F.lit(1), n), lambda x, i: x / (F.get("s", n + F.floor(i / (n / heads)).cast("int")) + 1e-6))
    full = nodes.join(sums, "id", "left").join(F.broadcast(v.select(F.size("x").alias("width")).limit(1)))  # one row
    return dense(full.select("id", F.coalesce(out, F.array_repeat(F.lit(0.0), F.col("width"))).alias("x")), weights, f"{layer}.o")


def forward(nodes: DataFrame, edges: DataFrame, weights: DataFrame, layers: int, heads: int) -> DataFrame:
    """(id, logp) of nodes (id, x): encoder, ``layers`` blocks of attention and feed-forward with residuals, and log softmax of the output.

    Layers are named in, 0.q, 0.k, 0.v, 0.o, 0.up, 0.down, 1.q and so on, and out. Norms come before each part, and before the output.
    """
    weights, edges = cut(weights, "weights"), cut(edges.select("src", "dst"), "along")
    h = dense(nodes, weights, "in")
    for i in range(layers):
        h = cut(_added(h, attention(_normal(h), edges, weights, f"{i}", heads)), "forward")
        h = cut(_added(h, dense(dense(_normal(h), weights, f"{i}.up", "gelu"), weights, f"{i}.down")), "forward")
    return dense(_normal(h), weights, "out").select("id", log_softmax("x").alias("logp"))
