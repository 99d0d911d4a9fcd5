"""Sharding by rendezvous hashing.

Every record key draws a score for each shard from a hash of key and shard, -ln(u) / weight, and goes
to the shard of the least one. A new shard only takes the records for which its own score is least;
all other records stay where they are.

Defined results: a null text has 8 bytes and checksum 0; a null key is one key. Equal scores go to the
lower shard. Rows that repeat a key go to the same shard and get slots of their own; rows alike in all
columns are counted first and numbered by arithmetic, so that no task orders all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plexus.functions.ranks import numbered
from plexus.session import cut, spare_name, table

#: Rows that one numbering task takes, about.
SLOT_ROWS = 4000


def score(key: Column, shard: Column, weight: Column) -> Column:
    u = (F.pmod(F.xxhash64(key, shard), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    return -F.ln(u) / weight


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Index of the shard that ``key`` belongs to, one for each weight above 0."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    drawn = F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), lambda s: F.struct(score(key, s, F.element_at(w, s + 1)).alias("score"), s.alias("shard")))
    return F.array_min(drawn)["shard"]


def slots(rows: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """Adds ``slot``: row numbers from 0 without gaps in each value of ``by`` (null is no value: such rows go).

    Numbers within parts of about SLOT_ROWS different rows are moved by the sizes of the parts before, so
    that no task numbers a whole shard. Columns must be such as can be grouped by.
    """
    n, part, first, before = (spare_name(x, rows) for x in ("n", "part", "first", "before"))
    alike = cut(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias(n)), "shard-rows")
    largest = alike.groupBy(by).agg(F.count(F.lit(1)).alias("count")).agg(F.max("count")).first()[0] or 0
    split = alike.withColumn(part, F.pmod(F.xxhash64(*order), F.lit(max(1, -(-largest // SLOT_ROWS)))))
    sizes = split.groupBy(by, part).agg(F.sum(n).alias(before))
    earlier = W.partitionBy(by).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(by, part, F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    inside = W.partitionBy(by, part).orderBy(*order, *[c for c in rows.columns if c not in order]).rowsBetween(W.unboundedPreceding, -1)
    placed = split.withColumn(first, F.coalesce(F.sum(n).over(inside), F.lit(0))).join(offsets, [by, part])
    return numbered(placed, n, "slot").withColumn("slot", F.col("slot") + F.col(first) + F.col(before)).select(*rows.columns, "slot")


def op6_sharding(spark: SparkSession, sf_dir: str, shards: int = 24) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    placed = docs.select(
        "doc_id",
        (F.octet_length(data) + 8).cast("bigint").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), [1.0] * shards).alias("shard"),
        shard_of(F.col("doc_id"), [1.0] * (shards + 1)).alias("grown_shard"),
    )
    return slots(placed, "shard", ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
