"""A corpus pipeline of five stages; each works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plexus.llm import bpe, dedup, mixing, near, toxicity
from plexus.session import drop, settled, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("exact_dedup", dedup.stage),
    ("near_dedup", near.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]
#: Several stages learn, stream or draw at random: no SQL expresses them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after all stages; of the tables made on the way only the result stays."""
    docs, made = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = settled(spark, lambda s=stage, d=docs: s(spark, d, sf_dir), f"pipeline-{name}")
        if made is not None:
            drop(made)
        made = docs
    return docs
