"""Attention along edges, and over the pairs of a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexus.functions.keys import dot
from plexus.operators.strips import head_sums, strips


#: Dimensions that one row of a vector sum has; wider vectors are several rows, so generated code does not grow with the width.
BLOCK = 32


def vector_sum(rows: DataFrame, keys: list[str], vector: Column | str, out: str, more: dict[str, Column] | None = None) -> DataFrame:
    """(keys, out, more): vectors of equal length added up for each key, and further aggregates beside them.

    Vectors are dealt to blocks of BLOCK dimensions, summed before and after one shuffle, and put together again.
    """
    v, more = F.col(vector) if isinstance(vector, str) else vector, more or {}
    names = [f"_d{i}" for i in range(BLOCK)]
    blocks = rows.withColumn("_v", v).withColumn("_b", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(size(_v) - 1) div {BLOCK}").cast("int")))))
    at = lambda i: F.get("_v", F.col("_b") * BLOCK + i)
    own = {k: F.when(F.col("_b") == 0, c) for k, c in more.items()}
    wide = blocks.select(*keys, "_b", F.size("_v").alias("_n"), *[at(i).alias(n) for i, n in enumerate(names)], *[c.alias(k) for k, c in own.items()])
    per = wide.groupBy(*keys, "_b").agg(F.max("_n").alias("_n"), *[F.sum(n).alias(n) for n in names], *[F.sum(k).alias(k) for k in more])
    whole = per.groupBy(*keys).agg(F.max("_n").alias("_n"), F.array_sort(F.collect_list(F.struct("_b", F.array(*names).alias("x")))).alias("_x"), *[F.sum(k).alias(k) for k in more])
    return whole.select(*keys, F.slice(F.flatten("_x.x"), F.lit(1), F.col("_n")).alias(out), *more)


def edge_scores(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each edge with its key and value k = v = x(src), and the query q = x(dst)."""
    s, d = nodes.select(F.col("id").alias("src"), F.col("x").alias("k")), nodes.select(F.col("id").alias("dst"), F.col("x").alias("q"))
    return edges.join(s, "src").join(d, "dst")


def _clamped(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(5.0)), F.lit(-5.0))


def weights(edges: DataFrame, nodes: DataFrame, width: int, variant: str = "base", etype: dict[int, float] | None = None, bias: Column | None = None) -> DataFrame:
    """Adds w to the edges. base: clamp(k.q / sqrt(d)); list: clamp(k.q) / sqrt(d); typed: each score times
    the edge type's factor before the clamp. A bias is added after the clamp; no maximum is subtracted."""
    e = edge_scores(edges, nodes)
    raw, root = dot("k", "q"), float(width) ** 0.5
    if etype is not None:
        factor = F.coalesce(*[F.when(F.col("etype") == t, F.lit(float(v))) for t, v in etype.items()])
        raw = raw * factor
    score = _clamped(raw) / root if variant == "list" else _clamped(raw / root)
    return e.withColumn("w", F.exp(score if bias is None else score + bias))


def softmax(weighted: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(id, z, out): sum of weights and weighted mean of values; exactly 0 for a node without in-edges."""
    sums = vector_sum(weighted, ["dst"], F.transform("k", lambda v: v * F.col("w")), "s", {"z": F.col("w")})
    full = nodes.select("id").join(sums.withColumnRenamed("dst", "id"), "id", "left")
    z = F.coalesce("z", F.lit(0.0))
    return full.select("id", z.alias("z"), F.transform(F.coalesce("s", F.array_repeat(F.lit(0.0), width)), lambda v: v / (z + 1e-6)).alias("out"))


def head_mass(weighted: DataFrame) -> DataFrame:
    """(head, mass): mean share of a head's edges in the weights into their destination, over destinations; weighted has (head, dst, w).

    Where every edge serves every head all heads have the same mass; heads with edges of their own differ. Destinations without edges don't count.
    """
    per = weighted.groupBy("dst", "head").agg(F.sum("w").alias("m"))
    whole = per.groupBy("dst").agg(F.sum("m").alias("t"))
    n = whole.agg(F.count(F.lit(1)).alias("n"))
    shares = per.join(whole, "dst").groupBy("head").agg(F.sum(F.col("m") / F.col("t")).alias("s"))
    return shares.crossJoin(F.broadcast(n)).select("head", (F.col("s") / F.col("n")).alias("mass"))  # one row


def grouped_head_mass(edges: DataFrame, n_edges: int, nodes: DataFrame, width: int, heads: int) -> DataFrame:
    """(head, mass): :func:`head_mass` of :func:`weights` where an edge (src, dst) serves head src mod ``heads``; both ends of every edge are nodes.

    Scores are taken by strips, so no edge is a row with its vectors. A head without edges has mass 0, and there are no rows without any edges.
    """
    of = strips(edges, n_edges, nodes.count())
    sums = head_sums(of, nodes, width, heads).groupBy("head").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return sums.select("head", (F.col("s") / F.col("n")).alias("mass"))


def normalised_weights(weighted: DataFrame) -> DataFrame:
    """(src, dst, p): each weight by its group's sum, before anything is dropped."""
    z = weighted.groupBy("dst").agg(F.sum("w").alias("z"))
    return weighted.join(z, "dst").select("src", "dst", (F.col("w") / (F.col("z") + 1e-6)).alias("p"))


def dense(nodes: DataFrame, batch: Column, width: int, multiply: bool = True) -> DataFrame:
    """(id, out) of full attention among the nodes of each batch. The scale sqrt(d) multiplies the query
    where ``multiply`` is set, else it divides. Scores have their row's maximum subtracted."""
    b = nodes.withColumn("batch", batch)
    root = float(width) ** 0.5
    other = b.select("batch", F.col("id").alias("other"), F.col("x").alias("k"))
    pairs = b.select("batch", "id", F.col("x").alias("q")).join(other, "batch")
    s = pairs.withColumn("s", dot("q", "k") * root if multiply else dot("q", "k") / root)
    top = s.groupBy("id").agg(F.max("s").alias("m"))
    w = s.join(top, "id").withColumn("w", F.exp(F.col("s") - F.col("m")))
    sums = vector_sum(w, ["id"], F.transform("k", lambda v: v * F.col("w")), "s", {"z": F.col("w")})
    return sums.select("id", F.transform("s", lambda v: v / F.col("z")).alias("out"))


def favor(nodes: DataFrame, features: list[list[float]], width: int) -> DataFrame:
    """(id, out) of linear attention with fixed random features; the sums over all nodes are one row."""
    m = len(features)
    scaled = F.transform("x", lambda v: v / float(width) ** 0.25)
    half = F.aggregate(F.transform("x", lambda v: v * v), F.lit(0.0), lambda s, v: s + v) / (2 * float(width) ** 0.5)
    proj = [F.aggregate(F.zip_with(F.col("xs"), F.array(*[F.lit(w) for w in f]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for f in features]
    n = nodes.withColumns({"xs": scaled, "h": half}).select("id", "x", "h", F.array(*proj).alias("u"))
    most = n.agg(F.max(F.array_max("u")).alias("top"))
    k = n.crossJoin(F.broadcast(most))  # one row
    phi_k = lambda i: F.exp(F.get("u", F.lit(i)) - F.col("h") - F.col("top")) + 1e-4
    phi_q = lambda i: F.exp(F.get("u", F.lit(i)) - F.col("h") - F.array_max("u")) + 1e-4
    sums = k.agg(*[F.sum(phi_k(i)).alias(f"k{i}") for i in range(m)], *[F.sum(phi_k(i) * F.get("x", F.lit(j))).alias(f"c{i}_{j}") for i in range(m) for j in range(width)])
    ctx = sums.select(F.array(*[f"k{i}" for i in range(m)]).alias("ks"), F.array(*[F.array(*[f"c{i}_{j}" for j in range(width)]) for i in range(m)]).alias("cs"))
    q = n.crossJoin(F.broadcast(ctx)).withColumn("p", F.array(*[phi_q(i) for i in range(m)]))
    den = dot("p", "ks")
    num = F.aggregate(F.zip_with("p", "cs", lambda a, row: F.transform(row, lambda v: a * v)), F.array_repeat(F.lit(0.0), width), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return q.withColumns({"den": den, "num": num}).select("id", F.transform("num", lambda v: v / F.col("den")).alias("out"))


def hop_readout(hops: DataFrame, self_weight: float = 0.5, hop_weight: float = 1.0) -> DataFrame:
    """(id, out): softmax over hops >= 1 of a linear score of a node's own and hop features, added to its own.

    hops has (id, hop, x); the score sums self_weight * x0 + hop_weight * xk over the width.
    """
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    own = hops.where("hop = 0").select("id", F.col("x").alias("x0"))
    s = hops.where("hop > 0").join(own, "id").withColumn("w", F.exp(total(F.col("x0")) * self_weight + total(F.col("x")) * hop_weight))
    pairs = s.groupBy("id").agg(F.sum("w").alias("z"), F.first("x0").alias("x0"), F.array_sort(F.collect_list(F.struct("hop", "w", "x"))).alias("h"))
    mixed = F.aggregate("h", F.col("x0"), lambda acc, e: F.zip_with(acc, e["x"], lambda a, v: a + v * e["w"] / F.col("z")))
    return pairs.select("id", mixed.alias("out"))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row: what stands inside a lambda is computed for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def log_softmax(logits: Column | str) -> Column:
    lse = lambda top: top + F.ln(F.aggregate(F.transform(logits, lambda v: F.exp(v - top)), F.lit(0.0), lambda s, v: s + v))
    return _once(F.array_max(logits), lambda top: _once(lse(top), lambda t: F.transform(logits, lambda v: v - t)))


def linear(x: Column | str, weight: list[list[float]], bias: list[float] | None = None) -> Column:
    rows = [dot(x, F.array(*[F.lit(float(v)) for v in r])) + (bias[i] if bias else 0.0) for i, r in enumerate(weight)]
    return F.array(*rows)


def layer_norm(x: Column | str, eps: float = 1e-5) -> Column:
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
    var = lambda m: F.aggregate(F.transform(x, lambda v: (v - m) * (v - m)), F.lit(0.0), lambda s, v: s + v) / n
    return _once(mean, lambda m: _once(F.sqrt(var(m) + eps), lambda d: F.transform(x, lambda v: (v - m) / d)))


def relu(x: Column | str) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def with_bias(edges: DataFrame, bias: DataFrame) -> DataFrame:
    """Edges with ``bias`` looked up by (src, dst) in a table of distinct pairs; 0 for a pair it lacks."""
    return edges.join(bias.select("src", "dst", "bias"), ["src", "dst"], "left").withColumn("bias", F.coalesce("bias", F.lit(0.0)))


def by_type(edges: DataFrame, nodes: DataFrame, width: int, types: dict[int, list[float]]) -> DataFrame:
    """Adds w to typed edges: every dimension's product is scaled by the type's vector, then summed and clamped."""
    e = edge_scores(edges, nodes)
    factors = F.coalesce(*[F.when(F.col("etype") == t, F.array(*[F.lit(float(x)) for x in v])) for t, v in types.items()])
    return e.withColumn("w", F.exp(_clamped(dot(F.zip_with("k", "q", lambda a, b: a * b / float(width) ** 0.5), factors))))


def project(x: Column | str, weight: list[list[float]]) -> Column:
    """A matrix times a vector; the matrix is one folded literal, so the expression does not grow with it."""
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in weight])
    return F.transform(rows, lambda r: dot(x, r))


def multi_head(edges: DataFrame, nodes: DataFrame, heads: int, wq: list[list[float]], wk: list[list[float]], wv: list[list[float]]) -> DataFrame:
    """(id, head, out): attention along edges of each head's slice of projected queries, keys and values.

    Edges (src, dst) serve all heads; with a column ``head`` each serves its own. Zeros without in-edges.
    """
    dim = len(wq) // heads
    root = float(dim) ** 0.5
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(heads - 1).cast("bigint"))
    cut_ = lambda c: F.slice(c, (F.col("head") * dim + 1).cast("int"), F.lit(dim))
    p = nodes.select("id", project("x", wq).alias("q"), project("x", wk).alias("k"), project("x", wv).alias("v")).withColumn("head", F.explode(every))
    p = p.select("id", "head", cut_("q").alias("q"), cut_("k").alias("k"), cut_("v").alias("v"))
    e = edges if "head" in edges.columns else edges.select("src", "dst", F.explode(every).alias("head"))
    joined = e.join(p.select(F.col("id").alias("src"), "head", "k", "v"), ["src", "head"]).join(p.select(F.col("id").alias("dst"), "head", "q"), ["dst", "head"])
    w = joined.withColumn("w", F.exp(_clamped(dot("k", "q") / root)))
    sums = vector_sum(w.withColumn("id", F.col("dst")), ["id", "head"], F.transform("v", lambda v: v * F.col("w")), "s", {"z": F.col("w")})
    full = p.select("id", "head").join(sums, ["id", "head"], "left")
    z = F.coalesce("z", F.lit(0.0)) + 1e-6
    return full.select("id", "head", F.transform(F.coalesce("s", F.array_repeat(F.lit(0.0), dim)), lambda v: v / z).alias("out"))


def batch_norm(nodes: DataFrame, width: int, eps: float = 1e-5) -> DataFrame:
    """(id, x) with every dimension moved to mean 0 and biased variance 1 over all rows."""
    stats = nodes.agg(*[f(F.get("x", F.lit(i))).alias(f"{n}{i}") for i in range(width) for n, f in (("m", F.avg), ("v", F.var_pop))])
    one = stats.select(F.array(*[f"m{i}" for i in range(width)]).alias("m"), F.array(*[f"v{i}" for i in range(width)]).alias("v"))
    moved = F.zip_with("x", "m", lambda a, m: a - m)
    return nodes.join(F.broadcast(one)).select("id", F.zip_with(moved, "v", lambda a, v: a / F.sqrt(v + eps)).alias("x"))  # one row
