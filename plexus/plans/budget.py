"""Control queries: budget candidates and moves, the tier planner, and the working-set model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK, START = 2, (2, 2)


def candidates(real: int, rw: int, ceiling: int, walk_cap: int) -> list[tuple[str, int, int]]:
    """Moves from a budget: growth below the ceiling, shifts between families at it."""
    rw_most = min(ceiling, walk_cap)
    if real + rw < ceiling:
        out = [("real_up", real + BLOCK, rw), ("rw_up", real, min(rw + BLOCK, rw_most))]
    else:
        out = [("shift_to_real", real + BLOCK, rw - BLOCK), ("shift_to_rw", real - BLOCK, min(rw + BLOCK, rw_most))]
    return [(k, a, b) for k, a, b in out if a >= 0 and b >= 0 and a + b <= ceiling and (a, b) != (real, rw)]


@dataclass
class Controller:
    """Commits a move after enough wins in a row; freezes after ``patience`` rounds without gain at the ceiling."""

    ceiling: int
    walk_cap: int
    patience: int = 3
    real: int = START[0]
    rw: int = START[1]
    moves: int = 0
    frozen: bool = False
    idle: int = 0
    run: tuple[str, int] = field(default=("", 0))

    def update(self, gains: dict[str, float]) -> bool:
        """One round of probe gains by kind; True if a move was committed."""
        options = {k: (a, b) for k, a, b in candidates(self.real, self.rw, self.ceiling, self.walk_cap)}
        known = {k: g for k, g in gains.items() if k in options}
        if self.frozen or not known:
            return False
        kind = max(known, key=lambda k: (known[k], k))
        growing = self.real + self.rw < self.ceiling
        if not growing and known[kind] <= 0:
            self.idle, self.run = self.idle + 1, ("", 0)
            self.frozen = self.idle >= max(3, self.patience)
            return False
        self.run = (kind, self.run[1] + 1 if self.run[0] == kind else 1)
        if self.run[1] < min(self.moves + 1, 3):
            return False
        (self.real, self.rw), self.moves, self.run, self.idle = options[kind], self.moves + 1, ("", 0), 0
        return True


# The first budgets (real, walk) to try, in blocks.
ANCHORS = ((1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (4, 0), (4, 2))


def initial_grid(spark: SparkSession, ceiling: int, block: int = BLOCK) -> DataFrame:
    """(place, real, rw): the anchors within the ceiling by total and walk budget; if none, one of real edges only."""
    fit = sorted({(a * block, b * block) for a, b in ANCHORS if (a + b) * block <= ceiling}, key=lambda p: (sum(p), p[1]))
    fit = (fit or [(min(ceiling, block), 0)]) if ceiling > 0 else []
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(fit)], "place bigint, real bigint, rw bigint")


def probe_choice(probes: DataFrame, digits: int | None = None) -> DataFrame:
    """(round, kind, gain): best paired loss gain of each round of (round, kind, base, cand).

    With ``digits`` gains are rounded before they are compared, and those equal then tie. Ties go to the later kind.
    """
    gain = (F.col("base") - F.col("cand")) / F.greatest(F.col("base"), F.lit(1e-6))
    gain = gain if digits is None else F.round(gain, digits)
    return probes.withColumn("gain", gain).groupBy("round").agg(F.max_by(F.struct("kind", "gain"), F.struct("gain", "kind")).alias("b")).select("round", "b.kind", "b.gain")


def arbitrated_choice(probes: DataFrame, band: float = 0.01) -> DataFrame:
    """(round, kind, gain) of (round, kind, base, cand, acc, ceiling): the best loss gain, but the best accuracy in
    a round at the ceiling in which every gain is within ``band`` of 0. Ties go to the later kind."""
    gain = (F.col("base") - F.col("cand")) / F.greatest(F.col("base"), F.lit(1e-6))
    near = F.bool_and(F.abs("gain") < band) & F.bool_and("ceiling")
    best = lambda c: F.max_by(F.struct("kind", "gain"), F.struct(c, "kind"))
    per = probes.withColumn("gain", gain).groupBy("round").agg(near.alias("near"), best("acc").alias("a"), best("gain").alias("g"))
    return per.select("round", F.when(F.col("near"), F.col("a")).otherwise(F.col("g")).alias("b")).select("round", "b.kind", "b.gain")


def peak_gate(peaks: DataFrame, targets: DataFrame, limit: float, margin: float) -> DataFrame:
    """(run, target, predicted, fits) of observed (run, budget, peak) and wanted (run, target) budgets.

    Beyond the largest budget seen, the peak grows by the steepest slope between neighbouring ones; with fewer
    than two budgets nothing is predicted and everything fits. A budget's largest peak counts.
    """
    seen = peaks.groupBy("run", "budget").agg(F.max("peak").alias("peak"))
    by = W.partitionBy("run").orderBy("budget")
    step = (F.col("peak") - F.lag("peak").over(by)) / (F.col("budget") - F.lag("budget").over(by))
    per = seen.withColumn("slope", step).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.max_by("peak", "budget").alias("p"), F.max("budget").alias("b"), F.greatest(F.max("slope"), F.lit(0.0)).alias("slope"))
    grown = F.col("p") + F.col("slope") * F.greatest(F.col("target") - F.col("b"), F.lit(0))
    joined = targets.join(per, "run", "left").withColumn("predicted", F.when(F.col("n") >= 2, grown))
    return joined.select("run", "target", "predicted", F.coalesce(F.col("predicted") <= limit * (1 - margin), F.lit(True)).alias("fits"))


# Names of edge policies and tiers in a plan's text.
POLICIES = ("gpu_persist", "gpu_ephemeral", "cpu_broadcast_prefetch", "cpu_rank_local_prefetch")


def parse_plan(spec: Column, layers: int) -> Column:
    """Struct (policy, tier, n) of ``policy:recompute``, ``policy:keep_mha=N`` or ``policy:retain=N``; null for anything else."""
    form = r"^\s*(\w+)\s*:\s*(recompute|(?:keep_mha|retain)=(\d{1,9}))\s*$"
    policy, tier = F.regexp_extract(spec, form, 1), F.regexp_extract(spec, form, 2)
    n = F.coalesce(F.nullif(F.regexp_extract(spec, form, 3), F.lit("")).cast("bigint"), F.lit(0).cast("bigint"))
    return F.when(policy.isin(*POLICIES) & (n <= layers), F.struct(policy.alias("policy"), F.split_part(tier, F.lit("="), F.lit(1)).alias("tier"), n.alias("n")))


def working_set(e: Column, n: Column, w: Column, length: Column) -> Column:
    """Bytes of a walk build: edges, row pointers, walk tensor and masks."""
    return 48 * e + 8 * n + 8 * (n + 1) + 8 * n * w * (length + 1) + 33 * n * w + 16 * n * w * length
