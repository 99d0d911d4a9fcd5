"""An edge stream kept as a top-K table: each batch renews only the destinations it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plexus.operators.sample import topk
from plexus.session import delete, exists


def keep_topk(stream: DataFrame, path: str, checkpoint: str, k: int, seed: int, whole_every: int = 20) -> StreamingQuery:
    """Writes to ``path`` one folder a batch with the top-K of every touched dst over old and new edges.

    The row of the largest batch number of a dst is its present state; see :func:`latest`. Every
    ``whole_every`` batches a folder holds the whole table, and what stands before the one before it is
    deleted. A batch reads only folders of smaller numbers, so a repeated one writes the same rows again.
    """

    def renew(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        pool = batch.select("src", "dst").distinct()
        whole = number % whole_every == 0
        since = max(0, (number - 1) // whole_every * whole_every)
        if number:
            old = latest(spark.read.parquet(path).where(F.col("batch").between(since, number - 1)))
            if not whole:
                old = old.join(pool.select("dst").distinct(), "dst", "left_semi")
            pool = pool.unionByName(old.select("src", "dst")).distinct()
        topk(pool, k, seed).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if whole:
            for gone in range(max(0, since - whole_every), since):
                if exists(spark, f"{path}/batch={gone}"):
                    delete(spark, f"{path}/batch={gone}")

    return stream.writeStream.foreachBatch(renew).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(table: DataFrame) -> DataFrame:
    newest = table.groupBy("dst").agg(F.max("batch").alias("batch"))
    return table.join(newest, ["dst", "batch"], "left_semi").select("src", "dst")
