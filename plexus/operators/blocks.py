"""Matrices as tables of square blocks, multiplied by a join on the inner block and sums of partial products.

A block is a row (i, j, data): ``size`` by ``size`` doubles, row by row, absent where all are zero. Work on one pair of blocks
is a small product in one task, however large the matrices are; partial products of a result block are added up in
bounded groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexus.session import cut, drop, ship

#: Rows and columns of a block.
SIZE = 128
#: Partial products of a result block that are added up at a time.
PARTS = 16


def blocked(entries: DataFrame, size: int = SIZE) -> DataFrame:
    """(i, j, data) of entries (row, col, value) with numbers from 0; values of one place add up."""
    dealt = entries.select(F.expr(f"row div {size}").alias("i"), F.expr(f"col div {size}").alias("j"), (F.col("row") % size * size + F.col("col") % size).alias("place"), "value")
    cells = dealt.groupBy("i", "j", "place").agg(F.sum("value").alias("value")).where("value <> 0")
    ship(entries.sparkSession)

    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        data = np.zeros(size * size)
        data[d["place"].to_numpy()] = d["value"].to_numpy()
        return pd.DataFrame({"i": [key[0]], "j": [key[1]], "data": [data.tobytes()]})

    return cells.groupBy("i", "j").applyInPandas(run, "i bigint, j bigint, data binary")  # size * size cells a group


def entries(blocks: DataFrame, size: int = SIZE) -> DataFrame:
    """(row, col, value) of all places that are not zero."""
    ship(blocks.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for i, j, data in zip(d["i"], d["j"], d["data"], strict=True):
                m = np.frombuffer(data).reshape(size, size)
                r, c = np.nonzero(m)
                yield pd.DataFrame({"row": i * size + r, "col": j * size + c, "value": m[r, c]})

    return blocks.mapInPandas(run, "row bigint, col bigint, value double")


def summed(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """Blocks (i, j, data) of parts (i, j, part, data), added up PARTS at a time until one is left of each place."""

    def add(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size * size)
        for data in d["data"]:
            total += np.frombuffer(data)
        return pd.DataFrame({"i": [key[0]], "j": [key[1]], "part": [key[2]], "data": [total.tobytes()]})

    most = parts.agg(F.max("part")).first()[0] or 0
    while True:
        parts = parts.withColumn("part", F.expr(f"part div {PARTS}")).groupBy("i", "j", "part").applyInPandas(add, "i bigint, j bigint, part bigint, data binary")
        if most < PARTS:
            return parts.drop("part")
        most //= PARTS


def multiplied(a: DataFrame, b: DataFrame, size: int = SIZE) -> DataFrame:
    """Blocks of the product of two blocked matrices."""
    ship(a.sparkSession)
    left, right = a.select("i", F.col("j").alias("k"), F.col("data").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("data").alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            made = [(np.frombuffer(x).reshape(size, size) @ np.frombuffer(y).reshape(size, size)).tobytes() for x, y in zip(d["x"], d["y"], strict=True)]
            yield pd.DataFrame({"i": d["i"], "j": d["j"], "part": d["k"], "data": made})

    products = left.join(right, "k").select("i", "j", "k", "x", "y").mapInPandas(run, "i bigint, j bigint, part bigint, data binary")
    held = cut(products, "products")
    made = cut(summed(held, size), "product")
    drop(held)
    return made


def grouped_powers(weighted: DataFrame, groups: DataFrame, most: int = 6, size: int = SIZE) -> DataFrame:
    """(seq_id, row, col, bias) between the nodes of each group: ``bias`` has the entries of A, A^2 .. A^most at the two nodes.

    weighted (src, dst, w) is A, over nodes 0 .. n - 1; groups (seq_id, pos, node_id) are disjoint, and row and col are positions. Powers are
    those of the whole matrix; only entries within a group are kept of each. Places without any entry are absent.
    """
    a = cut(blocked(weighted.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("w").alias("value")), size), "power")
    r = groups.select(F.col("node_id").alias("row"), F.col("seq_id").alias("seq"), F.col("pos").alias("p"))
    c = groups.select(F.col("node_id").alias("col"), F.col("seq_id").alias("other"), F.col("pos").alias("q"))
    now, parts = a, None
    for m in range(1, most + 1):
        if m > 1:
            now = multiplied(now, a, size)
        own = entries(now, size).join(r, "row").join(c, "col").where("seq = other").select(F.col("seq").alias("seq_id"), F.col("p").alias("row"), F.col("q").alias("col"), F.lit(m).alias("m"), "value")
        parts = own if parts is None else parts.unionByName(own)
    bias = F.array(*[F.coalesce(F.max(F.when(F.col("m") == m, F.col("value"))), F.lit(0.0)) for m in range(1, most + 1)])
    return parts.groupBy("seq_id", "row", "col").agg(bias.alias("bias"))
