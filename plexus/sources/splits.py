"""The split of a data set's folder, and what a prepared data set is written to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from plexus.functions.keys import argmax0, node_key
from plexus.functions.ranks import running
from plexus.session import exists
from plexus.sources.graphs import PARTS, read_npy, read_role_json

NAMES = ("train", "valid", "test")
# The stems of files that may hold a split, in the order in which they are looked for.
LISTS = ("split_idx_all", "official_splits", "fixed_splits", "snap-patents-splits")
TABLES = ("split_idx", "split")
INDICES = (("train_idx", "valid_idx", "test_idx"), ("train_idx", "val_idx", "test_idx"), ("split/train", "split/valid", "split/test"), ("split/train_idx", "split/valid_idx", "split/test_idx"))
MASKS = (("train_mask", "valid_mask", "test_mask"), ("train_mask", "val_mask", "test_mask"), ("split/train_mask", "split/valid_mask", "split/test_mask"))


def _parts(df: DataFrame) -> DataFrame | None:
    """(part, id) by full names; None unless all three parts have rows."""
    names = F.create_map(*[F.lit(v) for kv in PARTS.items() for v in kv])
    out = df.where(F.col("part").isin(*PARTS)).select(names[F.col("part")].alias("part"), F.col("id").cast("bigint").alias("id"))
    return out if out.select("part").distinct().count() == len(NAMES) else None


def _file(spark: SparkSession, folder: str, stem: str) -> DataFrame | None:
    """(id, values) of ``stem``.npy, or the table ``stem``.parquet; None if neither is there."""
    if exists(spark, f"{folder}/{stem}.parquet"):
        return spark.read.parquet(f"{folder}/{stem}.parquet")
    if exists(spark, f"{folder}/{stem}.npy"):
        return read_npy(spark, f"{folder}/{stem}.npy").select(F.col("row").alias("id"), "values")
    return None


def _indexed(df: DataFrame) -> DataFrame:
    return df.select(F.get("values", F.lit(0)).cast("bigint").alias("id")) if "values" in df.columns else df.select(F.col("id").cast("bigint").alias("id"))


def _masked(df: DataFrame, split_id: int) -> DataFrame:
    """Ids whose mask is set; of several masks a row, the one of ``split_id``."""
    name = "values" if "values" in df.columns else "mask"
    if not isinstance(df.schema[name].dataType, ArrayType):
        return df.where(F.col(name)).select("id")
    width = df.agg(F.max(F.size(name))).first()[0] or 0
    if width == 1 and name == "values":
        split_id = 0
    if not 0 <= split_id < max(1, width):
        raise ValueError(f"split {split_id} of {width} masks")
    return df.where(F.get(name, F.lit(split_id)).cast("boolean")).select("id")


def resolve_split(spark: SparkSession, folder: str, split_id: int = 0) -> DataFrame | None:
    """(part, id) of the first layout that ``folder`` holds, None without any.

    Looked for in this order: tables of several splits (split_id, part, id), tables of one (part, id), three
    files of ids, three files of masks, ``role.json``. Tables are Parquet, ids and masks Parquet or ``.npy``. A table in which
    a part has no rows is passed over; ``split_id`` outside a table's or a mask's splits is an error.
    """
    for stem in LISTS + TABLES:
        if exists(spark, f"{folder}/{stem}.parquet"):
            df = spark.read.parquet(f"{folder}/{stem}.parquet")
            if "split_id" in df.columns:
                n = df.agg(F.max("split_id")).first()[0]
                if n is None:
                    continue
                if not 0 <= split_id <= n:
                    raise ValueError(f"split {split_id} of {n + 1} in {stem}")
                df = df.where(F.col("split_id") == split_id)
            found = _parts(df)
            if found is not None:
                return found
    for stems, ids in [(s, _indexed) for s in INDICES] + [(s, lambda d: _masked(d, split_id)) for s in MASKS]:
        files = [_file(spark, folder, s) for s in stems]
        if all(f is not None for f in files):
            return reduce(DataFrame.unionByName, [ids(f).select(F.lit(n).alias("part"), "id") for n, f in zip(NAMES, files, strict=True)])
    return _parts(read_role_json(spark, f"{folder}/role.json")) if exists(spark, f"{folder}/role.json") else None


def labels_of_one_hot(rows: DataFrame) -> DataFrame:
    """(id, y) of (row, values): the place of the largest value, the first on ties."""
    return rows.select(F.col("row").alias("id"), argmax0("values").alias("y"))


def write_graph(nodes: DataFrame, edges: DataFrame, splits: DataFrame, folder: str) -> None:
    """A prepared data set: x, y, edge_index and its split; all splits too where ``splits`` has a split_id."""
    nodes.select("id", "x").write.mode("overwrite").parquet(f"{folder}/x.parquet")
    nodes.select("id", "y").write.mode("overwrite").parquet(f"{folder}/y.parquet")
    edges.select("src", "dst").write.mode("overwrite").parquet(f"{folder}/edge_index.parquet")
    if "split_id" in splits.columns:
        splits.select("split_id", "part", "id").write.mode("overwrite").parquet(f"{folder}/split_idx_all.parquet")
        splits = splits.where("split_id = 0")
    splits.select("part", "id").write.mode("overwrite").parquet(f"{folder}/split_idx.parquet")


def write_stats(stats: DataFrame, folder: str, model: str, dataset: str, tag: str, epoch: int) -> None:
    """An epoch's rows as JSON under its own name, and as the latest."""
    for name in (f"epoch_{epoch:04d}", "latest"):
        stats.write.mode("overwrite").json(f"{folder}/{model}/{dataset}/{tag}/{name}.json")


def random_groups(ids: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """(seq_id, pos, node_id): all nodes once, in hash order, in groups of ``size``, the last one shorter."""
    keyed = ids.select("id", node_key(F.col("id"), seed).alias("key"))
    at = running(keyed, ["key", "id"], {"at": 1})
    return at.select(F.expr(f"at div {size}").alias("seq_id"), (F.col("at") % size).alias("pos"), F.col("id").alias("node_id"))


def write_batches(batches: DataFrame, folder: str, name: str) -> None:
    """(seq_id, pos, node_id) of dense batches, each in one file's stretch of rows."""
    batches.select("seq_id", "pos", "node_id").repartition("seq_id").sortWithinPartitions("seq_id", "pos").write.mode("overwrite").parquet(f"{folder}/data_{name}.parquet")
