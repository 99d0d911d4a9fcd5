"""Graphs, features and splits derived from the star-schema tables, and file formats of splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexus.functions.keys import node_key
from plexus.operators.edges import distinct_pairs
from plexus.session import exists, table
from plexus.sources.arrays import read_array

PARTS = {"tr": "train", "va": "valid", "te": "test", "train": "train", "val": "valid", "valid": "valid", "test": "test"}


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y) of the item graph."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("bigint").alias("y"))


def n_nodes(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "embeddings").count()


def item_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the item graph as often as the table has them, for what takes repeats out itself."""
    n = n_nodes(spark, sf_dir)
    e = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % n).alias("src"), (F.col("l_partkey") % n).alias("dst"))
    return e.where("src <> dst")


def item_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_pairs(item_pairs(spark, sf_dir))


def purchase_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to parts; parts follow the customers in the numbering and are sinks."""
    c = table(spark, sf_dir, "customer").count()
    bought = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    made = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return made.join(bought, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_partkey") + c).alias("dst")).distinct()


def part_of(node: Column) -> Column:
    b = node_key(node) % 10
    return F.when(b < 6, "train").when(b < 8, "valid").otherwise("test")


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("id", part_of(F.col("id")).alias("part"))


#: Identifiers that one JSON object of a written split has, at most.
ROLE_IDS = 100_000


def read_role_json(spark: SparkSession, path: str) -> DataFrame:
    """(part, id) of JSON objects of lists: one in a file, or a folder of lines; short and long part names are accepted."""
    raw = spark.read.json(path, multiLine=not exists(spark, f"{path}/_SUCCESS"))
    known = [c for c in raw.columns if c in PARTS]
    if not known:
        raise ValueError("no split part in the file")
    parts = [raw.select(F.lit(PARTS[c]).alias("part"), F.explode(F.col(c).cast("array<bigint>")).alias("id")) for c in known]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_role_json(splits_df: DataFrame, path: str) -> None:
    """A folder of JSON lines, each an object with some identifiers of one part: no row has a whole part."""
    names = F.create_map(*[F.lit(x) for kv in (("train", "tr"), ("valid", "va"), ("test", "te")) for x in kv])
    n = splits_df.count()
    dealt = splits_df.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // ROLE_IDS)))))
    lists = dealt.groupBy(names[F.col("part")].alias("k"), "_b").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    lists.select(*[F.when(F.col("k") == k, F.col("ids")).alias(k) for k in ("tr", "va", "te")]).write.mode("overwrite").json(path)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(row, values) of a ``.npy`` file with one or two dimensions, split by ranges of rows."""
    return read_array(spark, path, "npy").select("row", "values")
