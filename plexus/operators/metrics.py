"""Labels, losses and reports as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plexus.functions.ranks import running
from plexus.session import drop


def quantile_labels(values: DataFrame, n: int) -> DataFrame:
    """(id, y): bin of v between linearly interpolated quantiles, [lo, hi), the last one closed; -1 for null or NaN.

    Distributed selection on values and their counts: however often a value repeats, it is one row that
    stands for a stretch of ranks.
    """
    good = values.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    ranked = running(good, ["v"], {"before": "n"})
    last = (ranked.agg(F.sum("n")).first()[0] or 0) - 1
    places = [last * k / n for k in range(1, n)]
    wanted = sorted({i for p in places for i in (int(p), min(int(p) + 1, last))}) if last >= 0 else []
    held = F.array(*[F.lit(i) for i in wanted]).cast("array<bigint>")
    mine = ranked.select("v", F.filter(held, lambda i: (i >= F.col("before")) & (i < F.col("before") + F.col("n"))).alias("at"))
    v = {r["at"]: r["v"] for r in mine.select("v", F.explode("at").alias("at")).collect()}  # two rows a bin at most
    drop(ranked)
    cuts = [v[int(p)] + (v[min(int(p) + 1, last)] - v[int(p)]) * (p - int(p)) for p in places] if v else []
    q = F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>")
    y = F.when(F.col("v").isNull() | F.isnan("v"), F.lit(-1)).otherwise(F.size(F.filter(q, lambda t: t <= F.col("v"))))
    return values.select("id", y.cast("bigint").alias("y"))


def accuracy(rows: DataFrame) -> DataFrame:
    """(part, accuracy, n) of (part, pred, y); unlabelled rows (null, below 0) do not count."""
    seen = rows.withColumn("known", F.col("y").isNotNull() & (F.col("y") >= 0))
    n = F.coalesce(F.sum(F.col("known").cast("bigint")), F.lit(0))
    hit = F.coalesce(F.sum((F.col("known") & (F.col("pred") == F.col("y"))).cast("bigint")), F.lit(0))
    return seen.groupBy("part").agg((hit / F.greatest(n, F.lit(1))).alias("accuracy"), n.alias("n"))


def auc(rows: DataFrame) -> DataFrame:
    """(auc) of (score, y in 0, 1) by mid-ranks over counts of equal scores."""
    per = rows.groupBy("score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    wins = running(per, ["score"], {"below": "n"}).withColumn("w", F.col("p") * (F.col("below") + F.col("n") / 2))
    return wins.agg((F.sum("w") / (F.sum("p") * F.sum("n"))).alias("auc"))


def nll(rows: DataFrame) -> DataFrame:
    """(part, loss, n) of (part, logp, y); y = -100 is ignored."""
    return rows.where("y >= 0").groupBy("part").agg(F.avg(-F.get("logp", F.col("y").cast("int"))).alias("loss"), F.count(F.lit(1)).alias("n"))


def hop_mass(attention: DataFrame, hops: DataFrame, mass: float) -> DataFrame:
    """(dst, hop, share): attention (src, dst, w) by hop distance (src, dst, bin), cut where the running
    mass before a hop reaches ``mass`` of the whole, and normalised by what is left."""
    per = attention.join(hops, ["src", "dst"]).groupBy("dst", F.col("bin").alias("hop")).agg(F.sum("w").alias("m"))
    by = W.partitionBy("dst")
    before = F.coalesce(F.sum("m").over(by.orderBy("hop").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    kept = per.withColumns({"before": before, "total": F.sum("m").over(by)}).where(F.col("before") < F.col("total") * mass - 1e-12)
    return kept.select("dst", "hop", (F.col("m") / F.sum("m").over(by)).alias("share"))


def hop_report(shares: DataFrame) -> DataFrame:
    """(hop, ratio, graph_ratio): mean share by hop over all queries; graph_ratio leaves out hop 0."""
    n = shares.agg(F.count_distinct("dst").alias("n"))
    mean = shares.groupBy("hop").agg(F.sum("share").alias("s")).join(F.broadcast(n)).select("hop", (F.col("s") / F.col("n")).alias("ratio"))
    whole = mean.where("hop > 0").agg(F.sum("ratio").alias("t"))
    return mean.join(F.broadcast(whole)).select("hop", "ratio", F.when(F.col("hop") > 0, F.col("ratio") / F.col("t")).otherwise(F.lit(0.0)).alias("graph_ratio"))


def ema(rows: DataFrame, keep: float = 0.9) -> DataFrame:
    """(run, ema): fold of (run, epoch, loss) in order of epochs; the first loss starts it.

    Written out as a weighted sum over places in one order of all runs, so that no task holds a whole run.
    """
    placed = running(rows.select("run", "epoch", "loss"), ["run", "epoch"], {"at": 1})
    ends = placed.groupBy("run").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    weighted = placed.join(ends, "run")
    share = F.pow(F.lit(float(keep)), F.col("last") - F.col("at")) * F.when(F.col("at") == F.col("first"), F.lit(1.0)).otherwise(F.lit(1.0 - keep))
    return weighted.groupBy("run").agg(F.sum(share * F.col("loss")).alias("ema"))


def best_by_validation(rows: DataFrame) -> DataFrame:
    """(run, epoch, test) of the largest valid; the first epoch wins ties."""
    return rows.groupBy("run").agg(F.max_by(F.struct("epoch", "test"), F.struct("valid", -F.col("epoch"))).alias("b")).select("run", "b.epoch", "b.test")


def profile_rollup(rows: DataFrame) -> DataFrame:
    """(name, n, total, mean, slowest_rank_total) of timed events (name, rank, ms)."""
    per = rows.groupBy("name", "rank").agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("t"))
    return per.groupBy("name").agg(F.sum("n").alias("n"), F.sum("t").alias("total"), (F.sum("t") / F.sum("n")).alias("mean"), F.max("t").alias("slowest_rank_total"))


def learning_rate(step: Column, peak: float, warmup: int, total: int, end: float = 0.0, power: float | None = None) -> Column:
    """Linear warm-up, then cosine decay, or polynomial where ``power`` is given."""
    p = (step - warmup) / float(max(1, total - warmup))
    late = F.lit(end) + (peak - end) * (0.5 * (1 + F.cos(F.pi() * p)) if power is None else F.pow(1 - p, F.lit(power)))
    return F.when(step < warmup, step * peak / float(max(1, warmup))).when(step >= total, F.lit(end)).otherwise(late)


def needed_hops(shares: DataFrame) -> DataFrame:
    """(mean_hop, max_hop, n): the last hop that the cut of :func:`hop_mass` leaves to each dst."""
    return shares.groupBy("dst").agg(F.max("hop").alias("h")).agg(F.avg("h").alias("mean_hop"), F.max("h").alias("max_hop"), F.count(F.lit(1)).alias("n"))


def edge_hop_mass(weighted: DataFrame, mass: float) -> DataFrame:
    """(hop, share, needed) of edges (hop, p): each hop's part of all weights, and the first hop at which the
    running sum reaches ``mass`` (null if never). Hops are few: one row each."""
    per = weighted.where("hop >= 0").groupBy("hop").agg(F.sum("p").alias("m"))
    whole = W.partitionBy(F.lit(0))
    share = F.col("m") / F.sum("m").over(whole)
    cum = F.sum("share").over(whole.orderBy("hop").rowsBetween(W.unboundedPreceding, 0))
    run = per.withColumn("share", share).withColumn("cum", cum)
    return run.select("hop", "share", F.min(F.when(F.col("cum") >= mass - 1e-12, F.col("hop"))).over(whole).alias("needed"))


def hop_relative(shares: DataFrame, hops: DataFrame) -> DataFrame:
    """(hop, n_eff, relative): a node's share at a hop against an even spread over all nodes in reach.

    ``hops`` has one row (dst, src, hop) a node in reach; n_eff is their number a query.
    """
    n = shares.agg(F.count_distinct("dst").alias("queries"))
    total = hops.agg(F.count(F.lit(1)).alias("reach"))
    per = shares.groupBy("hop").agg(F.sum("share").alias("s")).join(hops.groupBy("hop").agg(F.count(F.lit(1)).alias("n")), "hop")
    eff = F.col("reach") / F.col("queries")
    return per.join(F.broadcast(n)).join(F.broadcast(total)).select("hop", eff.alias("n_eff"), (F.col("s") / F.col("n") * eff).alias("relative"))  # one row each


def throughput(rows: DataFrame, n_nodes: int) -> DataFrame:
    """(run, wall, prep_share, nodes_per_s) of (run, epoch, wall, prep, eval) in seconds, without epoch 1; null without others."""
    late = rows.where("epoch > 1").groupBy("run").agg(F.avg("wall").alias("wall"), F.sum("prep").alias("p"), F.sum("wall").alias("w"), F.avg("eval").alias("e"))
    share = F.when(F.col("w") > 0, F.col("p") / F.col("w")).otherwise(0.0)
    speed = F.when(F.col("e") > 0, n_nodes / F.col("e")).otherwise(0.0)
    return rows.select("run").distinct().join(late, "run", "left").select("run", "wall", F.when(F.col("w").isNotNull(), share).alias("prep_share"), F.when(F.col("w").isNotNull(), speed).alias("nodes_per_s"))
