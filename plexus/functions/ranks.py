"""Positions in a whole table's order, and numbered repeats, without a task that sees all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plexus.session import cut, drop, spare_name

#: Rows that one task orders, about; up to so many are ordered in one.
TASK_ROWS = 250_000
#: Ranges of an order, at most: what is known of each is a row of a table that goes to every task.
MOST_RANGES = 10_000
#: Repeats that one row is spread to in place; more are dealt to other tasks in blocks of so many.
BLOCK = 1024


def running(df: DataFrame, order: list[str | Column], sums: dict[str, str | Column | int], task_rows: int = TASK_ROWS) -> DataFrame:
    """Adds for each of ``sums`` what a column (1: the number of rows) adds up to in the rows before.

    ``order`` must tell any two rows apart where it matters which comes first. ``df`` is evaluated once. Its rows are
    dealt to ranges of the order, rows that tie to any number of them; sums within a range are moved by those
    of the ranges before, one row a range. The result reads one table of its own, which ``drop`` deletes.
    """
    own = {n: spare_name(f"own_{n}", df) for n, c in sums.items() if not isinstance(c, int)}
    held = cut(df.withColumns({k: F.coalesce(F.col(sums[n]) if isinstance(sums[n], str) else sums[n], F.lit(0)) for n, k in own.items()}), "rows")
    n_rows = held.count()
    counted = [n for n in sums if n not in own]
    if n_rows <= task_rows:
        whole = W.partitionBy(F.lit(0)).orderBy(*order)
        before = whole.rowsBetween(W.unboundedPreceding, -1)
        added = {n: (F.row_number().over(whole) - 1).cast("bigint") if n in counted else F.coalesce(F.sum(own[n]).over(before), F.lit(0)) for n in sums}
        return held.withColumns(added).select(*df.columns, *sums)
    part, tie, at = spare_name("part", df), spare_name("tie", df), spare_name("at", df)
    parts = min(MOST_RANGES, -(-n_rows // task_rows))
    place = held.metadataColumn("_metadata")
    rows = held.select("*", F.xxhash64(place["file_path"], place["row_index"]).alias(tie))
    dealt = cut(rows.repartitionByRange(parts, *order, tie).sortWithinPartitions(*order, tie).withColumn(part, F.spark_partition_id()), "ranges")
    drop(held)
    # A range is one sorted file, so a row's number in its file is the number of rows of its range before it.
    totals = dealt.groupBy(part).agg(F.count(F.lit(1)).alias(at), *[F.sum(k).alias(k) for k in own.values()])
    earlier = W.partitionBy(F.lit(0)).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    moved = totals.select(part, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in (at, *own.values())])
    inside = dealt.withColumn(at, dealt.metadataColumn("_metadata")["row_index"])
    if own:
        before = W.partitionBy(part).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
        inside = inside.withColumns({n: F.coalesce(F.sum(k).over(before), F.lit(0)) for n, k in own.items()})
    placed = inside.join(F.broadcast(moved), part)  # MOST_RANGES rows
    return placed.withColumns({n: F.col(n) + F.col(f"{own[n]}_before") if n in own else F.col(at) + F.col(f"{at}_before") for n in sums}).select(*df.columns, *sums)


def placed_in(df: DataFrame, groups: list[str], order: list[str | Column], out: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Adds in ``out`` each row's position, from 0, in its group's order; no task holds a large group.

    Null is a group of its own. The result reads one table of its own, which ``drop`` deletes.
    """
    placed = running(df, [*groups, *order], {out: 1}, task_rows)
    first, names = spare_name("first", placed), {g: spare_name(f"of_{g}", placed) for g in groups}
    per = placed.groupBy(*[F.col(g).alias(names[g]) for g in groups]).agg(F.min(out).alias(first))
    same = reduce(lambda a, b: a & b, [placed[g].eqNullSafe(per[names[g]]) for g in groups])
    return placed.join(per, same).withColumn(out, F.col(out) - F.col(first)).select(*placed.columns)


def numbered(groups: DataFrame, n: str, out: str, block: int = BLOCK) -> DataFrame:
    """Every row of ``groups`` as often as its column ``n`` says, numbered from 0 in ``out``.

    However often one row repeats, no task makes more than ``block`` of its repeats at a time.
    """
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), c))
    count, at = F.col(n).cast("bigint"), spare_name("block", groups)
    few = groups.where(count.between(1, block)).withColumn(out, upto(count - 1))
    many = groups.where(count > block).withColumn(at, upto(F.expr(f"(`{n}` - 1) div {block}")))
    many = many.repartition(F.xxhash64(*groups.columns, at))
    last = F.least(F.lit(block), count - F.col(at) * block) - 1
    many = many.withColumn(out, upto(last)).withColumn(out, F.col(out) + F.col(at) * block)
    return few.unionByName(many.drop(at))
