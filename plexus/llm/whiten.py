"""Whitening of embeddings from an exact integer scatter.

Entries become whole numbers on a fixed grid. Tasks subtract the shift and sum up entries and cross-products
without any rounding: a block's products are taken limb by limb, so small that double-precision products of
integer matrices are exact, and are put together as Python's integers of any length. Spark adds the cells up,
again limb by limb. Only n times the cross-products less the products of the sums, exact to the last digit,
becomes a float, and is taken apart by ``eigh``. The fit list is never held anywhere: what comes to the driver
has the size of one matrix of dimensions by dimensions.

Defined results: rows go whose vector is null or has null or non-finite entries, or entries that are too large
for the grid (64 times the entry does not fit a long). Vectors of another length than most rows have (of
equally frequent ones, the longest) have no covariance with the others and go too. Components without
variance (fewer rows than dimensions, constant or dependent columns) can't be scaled to 1 and are left out,
so one row, equal rows or an empty table give an empty result. Repeated rows count as often as they stand;
equal eigenvalues are ordered as ``eigh`` returns them. Identifiers, null ones too, are passed on; further
columns have no influence. ``deviation`` is null where it does not fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexus.session import ship, table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Bits of a limb, and rows of a block: products of two limbs, summed over a block, stay below 2^53.
LIMB, BLOCK = 20, 4096
#: Bits of the limbs that Spark adds up, and how many of them a cell has: enough for 2^30 rows of longs a task.
WORD, WORDS = 40, 4


def usable(vector: Column) -> Column:
    """Whether a vector has entries, all of them finite and small enough for the grid."""
    bound = float(1 << 62) / SCALE
    return vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < bound))


def on_grid(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, y): remaining rows, with entries floor(SCALE * c), which is x without the shift."""
    kept = embeddings.where(F.coalesce(usable(F.col(vector)), F.lit(False))).select("vec_id", F.col(vector).alias("v"))
    lengths = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    kept = kept.where(F.size("v") == (lengths["d"] if lengths else 0))
    return kept.select("vec_id", F.transform("v", lambda c: F.floor(c.cast("double") * SCALE)).alias("y"))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            part = batch.iloc[at : at + BLOCK]
            yield part, np.stack(part["y"].to_list()).astype(np.int64)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Floats whose sum, each times 2^(LIMB * place), is y; the last one has the sign."""
    out = []
    while y.size and max(abs(int(y.max())), abs(int(y.min()))) >= 1 << LIMB:
        out.append((y & ((1 << LIMB) - 1)).astype(float))
        y = y >> LIMB
    return [*out, y.astype(float)]


def scatter(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of a block's columns, as Python's integers."""
    parts = limbs(y)
    whole = lambda a: np.array([int(v) for v in a.ravel()], object).reshape(a.shape)
    sums = sum(whole(p.sum(0)) * (1 << LIMB * i) for i, p in enumerate(parts))
    cross = sum(whole(p.T @ q) * (1 << LIMB * (i + j)) for i, p in enumerate(parts) for j, q in enumerate(parts))
    return sums, cross


def _words(v: int) -> list[int]:
    """Limbs for Spark to add up; the last one has the sign."""
    return [(v >> WORD * i) & ((1 << WORD) - 1) if i < WORDS - 1 else v >> WORD * i for i in range(WORDS)]


def moments(grid: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """n, the sums and the cross-products of all rows of :func:`on_grid`, exact."""
    columns = [f"w{i}" for i in range(WORDS)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, cross = 0, 0, 0
        for _, y in _blocks(batches):
            s, c = scatter(y)
            n, sums, cross = n + len(y), sums + s, cross + c
        if n:
            d = len(sums)
            cells = [(-1, -1, n)] + [(i, -1, sums[i]) for i in range(d)] + [(i, j, cross[i, j]) for i in range(d) for j in range(i, d)]
            yield pd.DataFrame([(i, j, *_words(v)) for i, j, v in cells], columns=["i", "j", *columns])

    cells = grid.select("y").mapInPandas(run, "i int, j int, " + ", ".join(f"{c} bigint" for c in columns))
    found = cells.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in columns]).collect()  # one cell a pair of dimensions
    value = {(r["i"], r["j"]): sum(r[c] << WORD * k for k, c in enumerate(columns)) for r in found}
    n, d = value.get((-1, -1), 0), sum(j == -1 for _, j in value) - 1
    cross = np.zeros((max(d, 0), max(d, 0)), object)
    for i in range(d):
        for j in range(i, d):
            cross[i, j] = cross[j, i] = value[i, j]
    return n, [value[i, -1] for i in range(d)], cross


def exact_scatter(n: int, sums: list[int], cross: np.ndarray) -> np.ndarray:
    """n X'X - S S', as Python's integers; the same for x and for x without its shift."""
    s = np.array(sums, object)
    return n * cross - s[:, None] * s[None, :]


def components(n: int, scattered: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues by falling size, their vectors as columns and their shares of the trace; none without variance."""
    d = len(scattered)
    v = np.array([[int(scattered[i, j]) / (n * n) for j in range(d)] for i in range(d)]).reshape(d, d)
    value, vector = np.linalg.eigh(v)
    value, vector = value[::-1], vector[:, ::-1]
    keep = (value > d * np.finfo(float).eps * value[:1].max(initial=0))[:most].sum()
    value, vector = value[:keep], vector[:, :keep]
    largest = vector[np.abs(vector).argmax(0), np.arange(keep)] if keep else np.zeros(0)
    return value, vector * np.where(largest < 0, -1.0, 1.0), value / (np.trace(v) or 1.0)


def _centred(y: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: longs where they suffice, else Python's integers."""
    most = max([abs(int(y.max())), abs(int(y.min()))]) if y.size else 0
    if n * most + max(map(abs, sums), default=0) < 1 << 62:
        return n * y - np.array(sums, np.int64)
    return n * y.astype(object) - np.array(sums, object)


def _deviations(centred: np.ndarray) -> list[int | None]:
    """Sums of squares, exact; null beyond a long."""
    if centred.dtype != object and centred.size and int(np.abs(centred).max()) ** 2 * centred.shape[1] < 1 << 62:
        return (centred * centred).sum(1).tolist()
    found = [sum(int(v) ** 2 for v in row) for row in centred]
    return [v if v < 1 << 63 else None for v in found]


def whiten(embeddings: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each remaining row and component."""
    spark = embeddings.sparkSession
    ship(spark)
    grid = on_grid(embeddings, vector)
    n, sums, cross = moments(grid)
    value, vectors, share = components(n, exact_scatter(n, sums, cross), most) if n else (np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    k = len(value)
    names = "vec_id {}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    schema = names.format(dict(embeddings.dtypes)["vec_id"])
    if not k:
        return spark.createDataFrame([], schema)
    scaled = vectors / np.sqrt(value)  # dimensions by components

    def white(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centred = _centred(y, n, sums)
        return centred, (centred / n).astype(float) @ scaled

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, cross = np.zeros(k), np.zeros((k, k))
        for _, y in _blocks(batches):
            w = white(y)[1]
            total, cross = total + w.sum(0), cross + w.T @ w
        i, j = np.triu_indices(k)
        yield pd.DataFrame({"i": np.r_[np.arange(k), i], "j": np.r_[np.full(k, -1), j], "v": np.r_[total, cross[i, j]]})

    # The covariance of what is returned, of values that were centred exactly; their mean is rounding only.
    found = {(r["i"], r["j"]): r["v"] / n for r in grid.select("y").mapInPandas(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    error = max(abs(found[i, j] - found[i, -1] * found[j, -1] - (i == j)) for i, j in found if j >= 0)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, y in _blocks(batches):
            centred, w = white(y)
            at = np.repeat(np.arange(len(y)), k)
            deviation = pd.array(_deviations(centred), dtype="Int64")
            yield pd.DataFrame({"vec_id": part["vec_id"].iloc[at].to_numpy(), "component": np.tile(np.arange(1, k + 1), len(y)), "n": n, "deviation": deviation[at], "whitened": w.ravel(), "explained": np.tile(share, len(y)), "identity_error": error})

    return grid.mapInPandas(rows, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
