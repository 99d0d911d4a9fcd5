"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source wants target / source size copies: whole ones, and a fraction. Fractions
are paired; mass, counted in words, moves at random from one document of a pair to the other until one
of the two is 0 or 1, so a source's expected words never change and its taken words end within one
document of its target. Chunks of about FAN documents each leave one residual, residuals meet in
chunks again, level by level, until one is left for a source, which is rounded by itself.

Defined results: a null text has size 0; documents of size 0 take no words. A null source is one
source, last in order. Without any word every target is 0. The random numbers are hashes of seed,
all columns and, for rows alike in all of them, a number, so reruns agree and repeated rows are documents
of their own, spread over all chunks. Rows alike in all columns are interchangeable; others are not, and
are told apart by 128 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexus.functions.ranks import numbered, running
from plexus.session import cut, table

FAN = 64
WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: tuple[float, ...], percent: int, cap: int) -> DataFrame:
    """Adds ``target`` to (source, source_size, n_docs): shares by weight, none above cap * size.

    Sources fill up in order of cap * size / weight; those that fill pass the rest on by weight. Any number
    of sources is ranked and summed up in ranges.
    """
    ranked = running(sources, [F.col("source").asc_nulls_last()], {"rank": 1})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    own = ranked.withColumns({"weight": weight, "most": (F.col("source_size") * cap).cast("double")}).withColumn("full_at", F.col("most") / F.col("weight"))
    own = running(own, ["full_at", "rank"], {"filled": "most", "passed": "weight"})
    own = cut(own, "mix-sources")
    all_ = own.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total, heavy = float(all_["size"] or 0) * percent / 100, float(all_["weight"] or 0)
    own = own.withColumn("level", (F.lit(total) - F.col("filled")) / (F.lit(heavy) - F.col("passed")))
    # Water level: that of the first source which does not fill; without one, all of them do.
    line = own.where("full_at > level").agg(F.min(F.struct("full_at", "rank", "level"))["level"].alias("level")).first()["level"]
    out = F.col("most") if line is None else F.least(F.col("weight") * line, F.col("most"))
    return own.select("source", "source_size", "n_docs", out.alias("target"))


#: One pair of the fold: acc.cur and the next item, both with a fraction x and a weight in words.
_STEP = """(acc, it) -> transform(array(named_struct(
    'a', least(1 - acc.cur.x, it.x * it.size / acc.cur.size),
    'b', least(acc.cur.x, (1 - it.x) * it.size / acc.cur.size),
    'u', pmod(xxhash64(acc.cur.h, it.h, acc.cur.k, it.k, {seed}L), 9007199254740992L) / 9007199254740992D)),
  p -> CASE
    WHEN p.u * (p.a + p.b) < p.b OR p.a + p.b = 0 THEN
      CASE WHEN 1 - acc.cur.x <= it.x * it.size / acc.cur.size
        THEN {out_cur_1} ELSE {out_it_0} END
    ELSE
      CASE WHEN acc.cur.x <= (1 - it.x) * it.size / acc.cur.size
        THEN {out_cur_0} ELSE {out_it_1} END
  END)[0]"""


def _fold(seed: int) -> str:
    def keep(name: str, x: str, other: str, bump: int) -> str:
        stays = f"named_struct('r', {name}.r, 'doc_id', {name}.doc_id, 'h', {name}.h, 'k', {name}.k, 'size', {name}.size, 'x', CAST(greatest(0D, least(1D, {x})) AS DOUBLE))"
        gone = f"named_struct('doc_id', {other}.doc_id, 'h', {other}.h, 'k', {other}.k, 'size', {other}.size, 'bump', {bump})"
        return f"named_struct('cur', {stays}, 'out', concat(acc.out, array({gone})))"

    return _STEP.format(
        seed=seed,
        out_cur_1=keep("it", "it.x - (1 - acc.cur.x) * acc.cur.size / it.size", "acc.cur", 1),
        out_it_0=keep("acc.cur", "acc.cur.x + it.x * it.size / acc.cur.size", "it", 0),
        out_cur_0=keep("it", "it.x + acc.cur.x * acc.cur.size / it.size", "acc.cur", 0),
        out_it_1=keep("acc.cur", "acc.cur.x - (1 - it.x) * it.size / acc.cur.size", "it", 1),
    )


def _level(items: DataFrame, seed: int) -> DataFrame:
    """(source, bucket, cur, out) of items (source, bucket, doc_id, h, k, size, x): one residual a bucket."""
    item = F.struct(F.xxhash64("h", "k", F.lit(seed)).alias("r"), "doc_id", "h", "k", "size", "x")
    chunks = items.groupBy("source", "bucket").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = dict(items.dtypes)["doc_id"]
    none = f"CAST(array() AS ARRAY<STRUCT<doc_id: {kind}, h: STRUCT<a: BIGINT, b: BIGINT>, k: BIGINT, size: BIGINT, bump: INT>>)"
    folded = F.expr(f"aggregate(slice(items, 2, size(items)), named_struct('cur', items[0], 'out', {none}), {_fold(seed)})")
    return chunks.select("source", "bucket", folded.alias("f")).select("source", "bucket", "f.cur", "f.out")


def row_hash(docs: DataFrame) -> Column:
    """A hash of 128 bits of all columns, as two of 64: rows that share it are taken for alike."""
    own = [F.col(f"`{c}`") for c in sorted(docs.columns)]
    return F.struct(F.xxhash64(*own).alias("a"), F.xxhash64(F.lit(0x9E3779B9), *own).alias("b"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), percent: int = 150, cap: int = 2, seed: int = 11) -> DataFrame:
    """(doc_id, h, source, size, source_size, target, copies) of every row of docs (doc_id, text, source, ...).

    ``h`` is :func:`row_hash`; ``copies`` is how often the mix takes the document.
    """
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row_hash(docs).alias("h"))
    rows = cut(rows.groupBy("doc_id", "source", "size", "h").agg(F.count(F.lit(1)).alias("n")), "mix-rows")
    per = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    aim = cut(targets(cut(per, "mix-sizes"), weights, percent, cap), "mix-targets")
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    aims = aim.withColumns({"whole": F.floor(want).cast("int"), "x": want - F.floor(want), "buckets": F.ceil(F.col("n_docs") / FAN).cast("bigint")})
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    each = numbered(rows, "n", "k").drop("n")
    full = each.join(aims, same(each, aims)).select(each["*"], "x", "buckets")
    partly = (F.col("x") > 0) & (F.col("size") > 0)
    items = full.where(partly).select("source", F.pmod(F.xxhash64("h", "k", F.lit(seed)), F.col("buckets")).alias("bucket"), "doc_id", "h", "k", "size", "x")
    draw = F.pmod(F.xxhash64("h", "k", F.lit(seed + 1)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    done = full.where(~partly).select("source", "doc_id", "h", "size", (draw < F.col("x")).cast("int").alias("bump"))
    most = aims.agg(F.max("buckets")).first()[0] or 0
    level = 0
    while most:
        made = cut(_level(items, seed + 2 + level), "mix-level")
        done = done.unionByName(made.select("source", F.explode("out").alias("o")).select("source", "o.doc_id", "o.h", "o.size", "o.bump"))
        items = made.select("source", F.expr(f"bucket div {FAN}").alias("bucket"), "cur.doc_id", "cur.h", "cur.k", "cur.size", "cur.x")
        if most == 1:
            break
        most, level = -(-most // FAN), level + 1
    done = done.unionByName(items.select("source", "doc_id", "h", "size", (draw < F.col("x")).cast("int").alias("bump")))
    return done.join(aims, same(done, aims)).select("doc_id", "h", done["source"], "size", "source_size", "target", (F.col("whole") + F.col("bump")).alias("copies"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows alike in all columns take their copies together."""
    copies = mix(docs).groupBy("h").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")).where("copies > 0")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row_hash(docs).alias("h"))
    taken = keyed.join(cut(copies, "mix-copies"), "h")
    again = taken.where("n > 1").groupBy("h").agg(F.first("doc").alias("doc"), F.first("copies").alias("copies"))
    return numbered(taken.where("n = 1").select("doc", "copies", "h").unionByName(again.select("doc", "copies", "h")), "copies", "k").select("doc.*")
