"""Attention in two phases: scores are taken and stored by destination, then aggregated, as often as wanted, without a shuffle.

The first phase writes a table of edges bucketed and sorted by their destination, with the values that the second one
sums up beside the score. The second phase reads whole buckets, so its sums for a destination need no exchange.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexus.operators.attend import vector_sum, weights
from plexus.session import cut, drop, new_path

#: Rows of scored edges that a bucket has, about, and buckets at least and at most.
BUCKET_ROWS, FEWEST, MOST = 2_000_000, 8, 20_000


def score_phase(edges: DataFrame, nodes: DataFrame, width: int, variant: str = "base", name: str | None = None) -> str:
    """Scores edges (src, dst) and stores (dst, w, v) in a table bucketed by dst; the table's name.

    Scores use keys and queries only. The number of buckets follows the number of edges.
    """
    spark = edges.sparkSession
    name, edges = name or f"scores_{uuid.uuid4().hex}", cut(edges.select("src", "dst"), "scored")
    scored = weights(edges, nodes, width, variant).select("dst", "w", F.col("k").alias("v"))
    buckets = min(MOST, max(FEWEST, -(-edges.count() // BUCKET_ROWS)))
    scored.write.bucketBy(buckets, "dst").sortBy("dst").option("path", new_path(spark, name)).mode("overwrite").saveAsTable(name)
    drop(edges)
    return name


def aggregate_phase(spark: SparkSession, name: str) -> DataFrame:
    """(id, z, out) of the destinations in a stored table: sum of weights, and weighted mean of values."""
    sums = vector_sum(spark.table(name), ["dst"], F.transform("v", lambda x: x * F.col("w")), "s", {"z": F.col("w")})
    return sums.select(F.col("dst").alias("id"), "z", F.transform("s", lambda x: x / (F.col("z") + 1e-6)).alias("out"))


def two_phase(edges: DataFrame, nodes: DataFrame, width: int, variant: str = "base") -> DataFrame:
    """(id, z, out) of all nodes; zeros for a node without in-edges. The stored scores stay until :func:`forget` is called."""
    spark = edges.sparkSession
    sums = aggregate_phase(spark, score_phase(edges, nodes, width, variant))
    z = F.coalesce("z", F.lit(0.0))
    return nodes.select("id").join(sums, "id", "left").select("id", z.alias("z"), F.coalesce("out", F.array_repeat(F.lit(0.0), width)).alias("out"))


def forget(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
