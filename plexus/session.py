"""What every operator needs of a session: shared storage, lineage cuts and shipped code."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Arrow batches end at this size as well as at Spark's number of rows: 10,000 long texts would fill a worker's memory.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only where the setting is absent on a single machine (tests) a local folder is chosen and set; on a
    cluster its absence is an error, since no folder of the driver's is seen by the executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{os.path.realpath(tempfile.gettempdir())}/plexus-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Folders named since each open :func:`scratch` began.
_scopes: list[list[str]] = []


def new_path(spark: SparkSession, what: str) -> str:
    """A folder of the shared one that nothing has been written to."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Every folder that is named inside is deleted at the end: write a result elsewhere before it."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for path in made:
            delete(spark, path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], what: str) -> DataFrame:
    """The rows that ``make`` returns, written and read back; all tables made on the way are deleted."""
    path = new_path(spark, what)
    with scratch(spark):
        made = make()
        made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later plans start from the files.

    The table outlives any executor, so a lost one costs no recomputation of what stands before.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spare_name(base: str, df: DataFrame) -> str:
    """``base``, with as many underscores before it as make it none of ``df``'s columns."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`new_path` named."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`cut` that nothing reads any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            delete(df.sparkSession, folder)


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once for each Spark application.

    Also bounds the bytes of a batch that goes to Python, unless the session has a bound of its own.
    """
    context = spark.sparkContext
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(4 << 20))
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = os.path.realpath(tempfile.mkdtemp(prefix="plexus-"))
    target = os.path.join(folder, "plexus.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
