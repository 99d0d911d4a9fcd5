"""Exact deduplication by keyed streaming state.

A feed of (digest, identifier, length, locator) rows streams into an aggregation whose state, kept on
disk by RocksDB without watermark or expiry, holds for each digest the number of texts, the stable
identifier of the one that stays, and its content locator: the file and the number of the row in it. The
final state is read as a table. Every hit, a row whose digest another one shares, is then compared in
full with the content that the state's locator points at; texts that only share a digest are dealt out
again under a new digest until none is left.

Defined results: a null text equals the empty text. Of equal texts the one with most code points, then
the smallest identifier (a null one last), then the first locator stays: one row, also of rows that
repeat both identifier and text. Further columns have no influence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexus.session import cut, delete, drop, new_path, table

SPACE = " \t\n\x0b\x0c\r"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_PARTS = "spark.sql.streaming.internal.stateStore.partitions"
STATE_ROWS = 1_000_000
LOCATOR = ["file", "row"]


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256(text: Column, generation: int) -> Column:
    """The digest of a normalised text; later generations hash another input."""
    return F.unhex(F.sha2(text if generation == 0 else F.concat(F.lit(f"{generation}\x00"), text), 256))


def absorb(spark: SparkSession, feed: str, checkpoint: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream the feed's new files into the state under ``checkpoint``; the state as a table.

    (digest, group_size, none, keep, file, row): ``none`` marks a null identifier. A later call with more
    files in ``feed`` goes on from the state that is there, with the number of state partitions chosen at
    first: one for STATE_ROWS rows, 4 at least. Each keeps a RocksDB of its own.
    """
    parts = max(4, -(-spark.read.parquet(feed).count() // STATE_ROWS))
    held = {k: spark.conf.get(k, None) for k in (STORE, STATE_PARTS)}
    spark.conf.set(STORE, ROCKS)
    spark.conf.set(STATE_PARTS, str(parts))
    try:
        read = spark.readStream.schema("digest binary, none boolean, id bigint, n_points bigint, file string, row bigint")
        if files_per_trigger:
            read = read.option("maxFilesPerTrigger", files_per_trigger)
        # The least by (-length, none, id, file, row); a struct of these needs no number turned round.
        best = F.min(F.struct((-F.col("n_points")).alias("minus"), "none", "id", "file", "row"))
        keyed = read.parquet(feed).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), best.alias("best"))
        query = keyed.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.digest", F.col("value.count").alias("group_size"), "value.min.none", F.col("value.min.id").alias("keep"), "value.min.file", "value.min.row")


def located(docs: DataFrame) -> DataFrame:
    """(doc, file, row): the row as a struct, and where it is stored. ``docs`` must read Parquet files directly."""
    place = docs.metadataColumn("_metadata")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), place["file_path"].alias("file"), place["row_index"].alias("row"))


def scanned(docs: DataFrame) -> bool:
    """Whether ``docs`` is Parquet files read by nothing but projections and filters that give the same rows each time.

    Only then does each row have a place of its own: joins, unions and generators repeat the rows of a file.
    """
    node = docs._jdf.queryExecution().analyzed()
    if not node.deterministic():
        return False
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    try:
        return node.children().isEmpty() and bool(located(docs).columns)
    except AnalysisException:  # no files, or none with numbered rows
        return False


def stored(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` as a table with locators, and whether it had to be written for that."""
    return (located(docs), False) if scanned(docs) else (located(cut(docs, "dedup-store")), True)


def decide(rows: DataFrame, digest: Callable[[Column, int], Column] = sha256) -> DataFrame:
    """(file, row, digest, group_size, none, id, keep_none, keep, kept) of every row of :func:`located`.

    ``kept`` marks the one row that stays of each group of equal texts, ``keep`` is its identifier;
    ``none`` and ``keep_none`` mark null identifiers.
    """
    spark = rows.sparkSession
    text = F.coalesce("doc.text", F.lit(""))
    contents = rows.select("file", "row", text.alias("text"))
    plain = normalised(F.col("text"))
    todo = rows.select("file", "row", F.col("doc.doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    todo = todo.select("file", "row", F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text")
    done: list[DataFrame] = []
    generation = 0
    while True:
        feed, checkpoint = new_path(spark, "dedup-feed"), new_path(spark, "dedup-state")
        todo.select(digest(plain, generation).cast("binary").alias("digest"), "none", "id", F.length("text").cast("bigint").alias("n_points"), "file", "row").write.parquet(feed)
        state = cut(absorb(spark, feed, checkpoint), "dedup-groups")
        fed = spark.read.parquet(feed).drop("n_points")
        keeps = state.select("digest", "group_size", F.col("none").alias("keep_none"), "keep", F.col("file").alias("keep_file"), F.col("row").alias("keep_row"))
        # A merge join, so that the rows of a digest that many share are dealt to several tasks.
        same = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
        found = fed.join(keeps.hint("merge"), "digest").withColumn("kept", same).drop("keep_file", "keep_row")
        found = cut(found, "dedup-found")

        # Hits: full contents side by side, each read where its locator points.
        hits = found.where("not kept").select("file", "row", "digest")
        kept = state.where("group_size > 1").select("file", "row", "digest")
        mine = contents.join(hits, LOCATOR).select("file", "row", "digest", plain.alias("plain"))
        theirs = contents.join(kept, LOCATOR).select("digest", plain.alias("kept_plain"))
        differ = cut(mine.join(theirs.hint("merge"), "digest").where("plain <> kept_plain").select("file", "row"), "dedup-differ")
        delete(spark, feed)
        delete(spark, checkpoint)
        drop(state)
        if differ.isEmpty():
            drop(differ)
            done.append(found)
            break
        # A digest that stands for several texts: the others are dealt out anew under the next one.
        own = found.join(differ, LOCATOR, "left_anti")
        sizes = own.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        done.append(cut(own.drop("group_size").join(sizes, "digest").select(*found.columns), "dedup-done"))
        again = found.select("file", "row", "none", "id").join(differ, LOCATOR)
        todo = cut(contents.join(again, LOCATOR).select("file", "row", "none", "id", "text"), "dedup-again")
        drop(found, differ)
        generation += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decide(stored(table(spark, sf_dir, "documents"))[0])
    return found.select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"),
        F.when(~F.col("keep_none"), F.col("keep")).alias("keep_id"),
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]', '', 'g')) AS h FROM documents),
k AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept, count(*) OVER (PARTITION BY h) AS group_size FROM t WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, kept, h AS text_sha256 FROM k
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    rows, _ = stored(docs)
    gone = decide(rows).where("not kept").select("file", "row")
    return rows.join(gone, LOCATOR, "left_anti").select("doc.*")
