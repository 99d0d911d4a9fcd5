"""The registered queries, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexus.functions.keys import argmax0, node_key
from plexus.functions.ranks import placed_in, running
from plexus.operators import attend as A
from plexus.operators import batches as H
from plexus.operators import edges as E
from plexus.operators import metrics as M
from plexus.operators import sample as S
from plexus.operators import spread as P
from plexus.plans import budget as B
from plexus import strong
from plexus.components import components
from plexus.operators import slabs
from plexus.operators import partition as T
from plexus.operators.forward import forward
from plexus.operators.phases import two_phase
from plexus.sources import graphs as G
from plexus.sources import splits
from plexus.session import new_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WIDTH = 64

# Common tables of the SQL side.
_N = "n AS (SELECT count(*) AS c FROM embeddings)"
_ITEM = f"{_N}, item AS (SELECT DISTINCT l_orderkey % c AS src, l_partkey % c AS dst FROM lineitem, n WHERE l_orderkey % c <> l_partkey % c)"
_NODES = "nodes AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label::BIGINT AS y FROM embeddings)"
_BUY = "nc AS (SELECT count(*) AS c FROM customer), buy AS (SELECT DISTINCT o_custkey AS src, c + l_partkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey, nc)"
_BOTH = "both_ AS (SELECT src, dst FROM item UNION SELECT dst, src FROM item)"


def _h(src: str, dst: str, seed: int) -> str:
    return f"(({src} * 1103515245 + {dst} * 214013 + {seed}::BIGINT * 2654435761 + 12345) % 2147483648)"


def _hn(node: str, seed: int = 0) -> str:
    return f"(({node} * 1103515245 + {seed}::BIGINT * 2654435761 + 12345) % 2147483648)"


def _top(edges: str, k: int, seed: int, tie: str = "src") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY {_h('src', 'dst', seed)}, {tie}) AS _r FROM {edges}) WHERE _r <= {k})"


def _walk(edges: str, starts: str, per: int, length: int, seed: int = 0) -> str:
    ctes = [f"adj AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS pos, count(*) OVER (PARTITION BY src) AS deg FROM {edges})", "deg AS (SELECT src, deg FROM adj WHERE pos = 0)", f"w0 AS (SELECT id AS start, walk, id AS node FROM {starts}, range({per}) r(walk))"]
    for t in range(1, length + 1):
        key = f"((start * 1103515245 + walk * 214013 + {t} * 69069 + {seed}::BIGINT * 2654435761 + 12345) % 2147483648)"
        ctes.append(f"w{t} AS (SELECT start, walk, coalesce(adj.dst, w.node) AS node FROM w{t - 1} w LEFT JOIN deg ON deg.src = w.node LEFT JOIN adj ON adj.src = w.node AND adj.pos = {key} % deg.deg)")
    ctes.append("steps AS (" + " UNION ALL ".join(f"SELECT start, walk, {t}::BIGINT AS step, node FROM w{t}" for t in range(length + 1)) + ")")
    ctes.append("lagged AS (SELECT *, lag(node) OVER (PARTITION BY start, walk ORDER BY step) AS prev FROM steps)")
    return ", ".join(c.replace(" AS (", " AS MATERIALIZED (", 1) if c[0] == "w" or c[:3] in ("adj", "deg") else c for c in ctes)


def _pool(min_hop: int) -> str:
    return f"pool AS (SELECT node AS src, start AS dst, walk, step AS hop FROM lagged WHERE step >= {max(1, min_hop)} AND (step = 1 OR node <> prev))"


_STARTS = "starts AS (SELECT vec_id AS id FROM embeddings)"
_MERGED = f"WITH {_ITEM}, {_STARTS}, {_walk('item', 'starts', 2, 2)}, {_pool(1)}, realk AS (SELECT src, dst FROM {_top('item', 4, 17)}), rw AS (SELECT src, dst FROM {_top('pool', 4, 37, 'src, walk, hop')}), merged AS (SELECT src, dst FROM realk UNION SELECT src, dst FROM rw)"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def _dot(a: str, b: str) -> str:
    return _DOT.format(a=a, b=b)


def _long(values: str, extra: str) -> str:
    """One row a dimension of a list column."""
    return f"SELECT {extra}, unnest(range({WIDTH}))::BIGINT AS dim, unnest({values}) AS v"


def _explode(df: DataFrame, col: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode(col).alias("dim", "v")).select(*keep, F.col("dim").cast("bigint").alias("dim"), (F.round("v", 6) + 0.0).alias("v"))


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _pooled(spark: SparkSession, sf: str, min_hop: int = 1) -> DataFrame:
    return S.walk_pool(G.item_edges(spark, sf), G.nodes(spark, sf).select("id"), 2, 2, min_hop)


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    return S.merged(G.item_edges(spark, sf), G.nodes(spark, sf).select("id"), 4, 4)


def _split(spark: SparkSession, sf: str, part: str) -> DataFrame:
    """The nodes of one part of the split."""
    return G.splits(spark, sf).where(F.col("part") == part).select("id")


def _some(spark: SparkSession, sf: str, cond: str) -> DataFrame:
    return G.nodes(spark, sf).where(cond).select("id")


_TRAIN, _TEST = f"{_hn('vec_id')} % 10 < 6", f"{_hn('vec_id')} % 10 >= 8"

# --- sources, filters and set operations


@query("scan_nodes", f"WITH {_NODES} SELECT id, y, round({_dot('x', 'x')}, 6) AS norm2 FROM nodes")
def _(spark, sf):
    return G.nodes(spark, sf).select("id", "y", F.round(A.dot("x", "x"), 6).alias("norm2"))


@query("item_graph", f"WITH {_ITEM} SELECT src, dst FROM item")
def _(spark, sf):
    return G.item_edges(spark, sf)


@query("purchase_graph", f"WITH {_BUY} SELECT src, dst FROM buy")
def _(spark, sf):
    return G.purchase_edges(spark, sf)


@query("split_table", f"SELECT vec_id AS id, CASE WHEN {_hn('vec_id')} % 10 < 6 THEN 'train' WHEN {_hn('vec_id')} % 10 < 8 THEN 'valid' ELSE 'test' END AS part FROM embeddings")
def _(spark, sf):
    return G.splits(spark, sf)


@query("role_json", f"SELECT vec_id AS id, CASE WHEN {_hn('vec_id')} % 10 < 6 THEN 'train' WHEN {_hn('vec_id')} % 10 < 8 THEN 'valid' ELSE 'test' END AS part FROM embeddings")
def _(spark, sf):
    path = new_path(spark, "role") + ".json"
    G.write_role_json(G.splits(spark, sf), path)
    return G.read_role_json(spark, path).select("id", "part")


@query("row_l1_norm", f"WITH {_NODES}, t AS (SELECT id, list_sum(x) AS t, list_sum(list_transform(x, lambda v: abs(v))) AS size FROM nodes) SELECT id, round(CASE WHEN t = 0 THEN 0 ELSE ln(size / abs(t)) END, 6) AS log_total FROM t")
def _(spark, sf):
    # Compared by logarithm, since a sum near 0 makes the normalised entries large.
    n = E.row_normalised(G.nodes(spark, sf))
    size = F.aggregate("x", F.lit(0.0), lambda s, v: s + F.abs(v))
    return n.select("id", F.round(F.when(size > 0, F.ln(size)).otherwise(0.0), 6).alias("log_total"))


@query("dst_semi_filter", f"WITH {_ITEM} SELECT src, dst FROM item WHERE dst IN (SELECT vec_id FROM embeddings WHERE label = 3)")
def _(spark, sf):
    return E.by_destination(G.item_edges(spark, sf), _some(spark, sf, "y = 3"))


@query("edge_slice", f"WITH {_ITEM} SELECT r, src - r * c // 4 AS src, dst - r * c // 4 AS dst FROM item, n, range(4) t(r) WHERE src >= r * c // 4 AND src < (r + 1) * c // 4 AND dst >= r * c // 4 AND dst < (r + 1) * c // 4")
def _(spark, sf):
    e, c = G.item_edges(spark, sf), G.n_nodes(spark, sf)
    ranks = [E.window_slice(e, r * c // 4, (r + 1) * c // 4).select(F.lit(r).cast("bigint").alias("r"), "src", "dst") for r in range(4)]
    return ranks[0].unionByName(ranks[1]).unionByName(ranks[2]).unionByName(ranks[3])


@query("virtual_node_edges", f"WITH {_ITEM} SELECT src + 1 AS src, dst + 1 AS dst FROM item UNION ALL SELECT vec_id + 1, 0 FROM embeddings UNION ALL SELECT 0, vec_id + 1 FROM embeddings")
def _(spark, sf):
    return E.virtual_node(G.item_edges(spark, sf), G.nodes(spark, sf))


@query("slot_shift", f"WITH {_ITEM} SELECT CASE WHEN src > 0 THEN src + (src - 1) // 64 ELSE src END AS src, CASE WHEN dst > 0 THEN dst + (dst - 1) // 64 ELSE dst END AS dst FROM item")
def _(spark, sf):
    return E.slot_shift(G.item_edges(spark, sf), 64)


@query("bidirect", f"WITH {_ITEM}, {_BOTH} SELECT src, dst FROM both_")
def _(spark, sf):
    return E.bidirect(G.item_pairs(spark, sf))


@query("edge_subtract", f"WITH {_ITEM} SELECT i.src, i.dst FROM item i ANTI JOIN (SELECT src, dst FROM {_top('item', 4, 17)}) t ON i.src = t.src AND i.dst = t.dst")
def _(spark, sf):
    e = G.item_edges(spark, sf)
    return E.subtract(e, S.topk(e, 4, 17))


_SETS = f"WITH {_ITEM}, a AS (SELECT src, dst FROM {_top('item', 4, 17)}), b AS (SELECT src, dst FROM {_top('item', 6, 18)}), c AS (SELECT (SELECT count(*) FROM a)::BIGINT AS n_a, (SELECT count(*) FROM b)::BIGINT AS n_b, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b))::BIGINT AS n_both)"


@query("edge_jaccard", _SETS + " SELECT n_a, n_b, n_both, n_both / (n_a + n_b - n_both) AS jaccard, (n_b - n_both) / n_a AS new_ratio FROM c")
def _(spark, sf):
    e = G.item_edges(spark, sf)
    return E.set_measures(S.topk(e, 4, 17), S.topk(e, 6, 18))


@query("induced_subgraph", f"WITH {_ITEM}, b AS (SELECT vec_id AS node, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings WHERE {_TRAIN}) SELECT s.pos AS src, d.pos AS dst FROM item JOIN b s ON s.node = src JOIN b d ON d.node = dst")
def _(spark, sf):
    batch = running(_split(spark, sf, "train"), ["id"], {"pos": 1}).select(F.col("id").alias("node"), F.col("pos").cast("bigint").alias("pos"))
    return E.induced(G.item_edges(spark, sf), batch)


@query("sampled_subgraph", f"WITH {_ITEM}, s AS (SELECT vec_id FROM embeddings ORDER BY {_hn('vec_id', 3)}, vec_id LIMIT 100), b AS (SELECT vec_id AS node, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM s) SELECT s.pos AS src, d.pos AS dst FROM item JOIN b s ON s.node = src JOIN b d ON d.node = dst")
def _(spark, sf):
    return E.induced(G.item_edges(spark, sf), E.sampled_nodes(G.nodes(spark, sf), 100, 3))


@query("edge_power2", f"WITH {_ITEM} SELECT DISTINCT a.src, b.dst FROM item a JOIN item b ON a.dst = b.src")
def _(spark, sf):
    return E.edge_power(G.item_pairs(spark, sf), 2)


@query("sparsity", f"WITH {_ITEM} SELECT 1 - count(*) / (max(c) * max(c)) AS sparsity FROM item, n")
def _(spark, sf):
    return E.sparsity(G.item_edges(spark, sf), G.n_nodes(spark, sf))


@query("degree_stats", f"WITH {_ITEM} SELECT vec_id AS id, (SELECT count(*) FROM item WHERE dst = vec_id) AS in_degree, (SELECT count(*) FROM item WHERE src = vec_id) AS out_degree FROM embeddings")
def _(spark, sf):
    return E.degrees(G.item_edges(spark, sf), G.nodes(spark, sf))


def _cycle(seed: int) -> str:
    return f"(SELECT id AS src, coalesce(lead(id) OVER (ORDER BY {_hn('id', seed)}, id), first_value(id) OVER (ORDER BY {_hn('id', seed)}, id)) AS dst FROM starts)"


@query("expander_edges", f"WITH {_STARTS}, c AS (SELECT * FROM {_cycle(0)} UNION ALL SELECT * FROM {_cycle(1)}) SELECT src, dst FROM c UNION ALL SELECT dst, src FROM c")
def _(spark, sf):
    return E.expander(G.nodes(spark, sf), 2)


# --- sampling and walks


@query("topk_real", f"WITH {_ITEM} SELECT src, dst FROM {_top('item', 4, 17)}")
def _(spark, sf):
    return S.topk(G.item_edges(spark, sf), 4, 17).select("src", "dst")


@query("topk_budget_split", _MERGED + " SELECT 'real' AS family, dst, count(*) AS n FROM realk GROUP BY dst UNION ALL SELECT 'walk', dst, count(*) FROM rw GROUP BY dst")
def _(spark, sf):
    real, rw = S.budgets(8)
    a, b = S.families(G.item_edges(spark, sf), G.nodes(spark, sf).select("id"), real, rw, 2, 2, 0)
    n = lambda d, k: d.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("family"), "dst", "n")
    return n(a, "real").unionByName(n(b, "walk"))


@query("walk_steps", f"WITH {_BUY}, starts AS (SELECT DISTINCT src AS id FROM buy UNION SELECT DISTINCT dst FROM buy), {_walk('buy', 'starts', 2, 3)} SELECT start, walk, step, node FROM steps")
def _(spark, sf):
    e = G.purchase_edges(spark, sf)
    starts = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return S.walks(e, starts, 2, 3)


@query("walk_pool", f"WITH {_ITEM}, {_STARTS}, {_walk('item', 'starts', 2, 2)}, {_pool(1)} SELECT src, dst, walk, hop FROM pool")
def _(spark, sf):
    return _pooled(spark, sf)


@query("walk_pool_min_hop2", f"WITH {_ITEM}, {_STARTS}, {_walk('item', 'starts', 2, 2)}, {_pool(2)} SELECT src, dst, walk, hop FROM pool")
def _(spark, sf):
    return _pooled(spark, sf, 2)


@query("seed_subgraph", f"WITH {_ITEM}, starts AS (SELECT vec_id AS id FROM embeddings WHERE label = 1), {_walk('item', 'starts', 3, 3)} SELECT node AS src, prev AS dst FROM lagged WHERE step > 0 UNION SELECT node, start FROM lagged WHERE step > 0")
def _(spark, sf):
    return S.seed_subgraph(G.item_edges(spark, sf), _some(spark, sf, "y = 1"), 3, 3)


@query("seed_first_nodes", f"WITH {_ITEM}, s AS (SELECT vec_id AS node FROM embeddings WHERE {_TRAIN}), t AS (SELECT src, dst FROM {_top('item', 4, 17)} WHERE dst IN (SELECT node FROM s)) SELECT node, false AS is_context FROM s UNION ALL SELECT node, true FROM (SELECT src AS node FROM t UNION SELECT dst FROM t) ANTI JOIN s USING (node)")
def _(spark, sf):
    seeds = _split(spark, sf, "train")
    return S.seed_first(seeds, E.by_destination(S.topk(G.item_edges(spark, sf), 4, 17), seeds))


_FAN = f"WITH {_ITEM}, f1 AS (SELECT * FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY {_h('dst', 'src', 1)}, dst) AS r FROM item) WHERE r <= 3), f2 AS (SELECT * FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY {_h('dst', 'src', 2)}, dst) AS r FROM item) WHERE r <= 2), q AS (SELECT vec_id AS id FROM embeddings), a AS (SELECT q.id AS dst, f1.dst AS cur FROM q JOIN f1 ON f1.src = q.id), b AS (SELECT a.dst, f2.dst AS cur FROM a JOIN f2 ON f2.src = a.cur)"


@query("fanout_pool", _FAN + " SELECT cur AS src, dst, 1::BIGINT AS hop FROM a WHERE cur <> dst UNION ALL SELECT cur, dst, 2 FROM b WHERE cur <> dst")
def _(spark, sf):
    return S.fanout_pool(G.item_edges(spark, sf), G.nodes(spark, sf).select("id"), (3, 2))


@query("merged_edges", _MERGED + " SELECT src, dst FROM merged")
def _(spark, sf):
    return _merged(spark, sf)


_TYPED = _MERGED + ", typed AS (SELECT src, dst, 0::BIGINT AS etype FROM realk UNION ALL SELECT src, dst, 1 FROM rw UNION ALL SELECT id, id, 0 FROM starts)"


@query("typed_edges", _TYPED + " SELECT src, dst, etype FROM typed")
def _(spark, sf):
    return S.merged_typed(G.item_edges(spark, sf), G.nodes(spark, sf).select("id"), 4, 4)


@query("probe_pools", _MERGED + f", d0 AS (SELECT vec_id AS id FROM embeddings WHERE {_TEST}), cone AS (SELECT id FROM d0 UNION SELECT src FROM item WHERE dst IN (SELECT id FROM d0)), r AS (SELECT src, dst FROM item WHERE dst IN (SELECT id FROM cone)), p AS (SELECT src, dst FROM pool WHERE dst IN (SELECT id FROM cone)) SELECT p.src, p.dst FROM p ANTI JOIN r ON p.src = r.src AND p.dst = r.dst")
def _(spark, sf):
    e = G.item_edges(spark, sf)
    cone = P.reception_cone(e, _split(spark, sf, "test"), 2)
    return E.subtract(E.by_destination(_pooled(spark, sf), cone), E.by_destination(e, cone))


# --- spreading


_CONE = f"WITH {_ITEM}, d0 AS (SELECT vec_id AS id FROM embeddings WHERE {_TEST}), d1 AS (SELECT DISTINCT src AS id FROM item WHERE dst IN (SELECT id FROM d0) EXCEPT SELECT id FROM d0), d2 AS (SELECT DISTINCT src AS id FROM item WHERE dst IN (SELECT id FROM d1) EXCEPT (SELECT id FROM d0 UNION SELECT id FROM d1))"


@query("reception_cone", _CONE + " SELECT id, 0::BIGINT AS depth FROM d0 UNION ALL SELECT id, 1 FROM d1 UNION ALL SELECT id, 2 FROM d2")
def _(spark, sf):
    return P.reception_cone(G.item_edges(spark, sf), _split(spark, sf, "test"), 3)


_SPD = f"WITH {_ITEM}, {_BOTH}, b AS (SELECT vec_id AS id, vec_id // 50 AS batch FROM embeddings), u AS (SELECT DISTINCT src, dst FROM both_ JOIN b p ON p.id = src JOIN b q ON q.id = dst AND q.batch = p.batch WHERE src <> dst), d2 AS (SELECT DISTINCT a.src, c.dst FROM u a JOIN u c ON a.dst = c.src), spd AS (SELECT x.id AS src, y.id AS dst, CASE WHEN x.id = y.id THEN 0 WHEN u.src IS NOT NULL THEN 1 WHEN d2.src IS NOT NULL THEN 2 ELSE 3 END::BIGINT AS bin FROM b x JOIN b y ON x.batch = y.batch LEFT JOIN u ON u.src = x.id AND u.dst = y.id LEFT JOIN d2 ON d2.src = x.id AND d2.dst = y.id)"


def _spd(spark, sf):
    return P.spd_bins(G.item_pairs(spark, sf), G.nodes(spark, sf).select("id", F.expr("id div 50").alias("batch")), 3)


@query("spd_bins", _SPD + " SELECT src, dst, bin FROM spd")
def _(spark, sf):
    return _spd(spark, sf)


@query("spd_one_hot", _SPD + " SELECT dst, sum((bin = 0)::INT)::BIGINT AS h0, sum((bin = 1)::INT)::BIGINT AS h1, sum((bin = 2)::INT)::BIGINT AS h2, sum((bin = 3)::INT)::BIGINT AS h3 FROM spd GROUP BY dst")
def _(spark, sf):
    hot = P.one_hot_bins(_spd(spark, sf), 3)
    return hot.groupBy("dst").agg(*[F.sum(F.get("hot", F.lit(b))).alias(f"h{b}") for b in range(4)])


_NORM = f"WITH {_ITEM}, {_BOTH}, a AS (SELECT src, dst FROM both_ UNION ALL SELECT vec_id, vec_id FROM embeddings), deg AS (SELECT dst AS id, count(*)::DOUBLE AS d FROM a GROUP BY dst), w AS (SELECT a.src, a.dst, 1 / sqrt(p.d * q.d) AS w FROM a JOIN deg p ON p.id = a.src JOIN deg q ON q.id = a.dst)"


@query("sym_norm", _NORM + " SELECT src, dst, round(w, 9) AS w FROM w")
def _(spark, sf):
    return P.sym_norm(G.item_pairs(spark, sf), G.nodes(spark, sf)).withColumn("w", F.round("w", 9))


@query("row_norm_right", f"WITH {_ITEM}, s AS (SELECT src, count(*) AS n FROM item GROUP BY src) SELECT item.src, item.dst, round(coalesce(1 / s.n, 0), 9) AS w FROM item LEFT JOIN s ON s.src = item.dst")
def _(spark, sf):
    return P.row_norm_right(G.item_edges(spark, sf)).withColumn("w", F.round("w", 9))


_PROP = _NORM + f", {_NODES}, h0 AS ({_long('x', 'id')} FROM nodes), h1 AS (SELECT w.dst AS id, dim, sum(w * v) AS v FROM w JOIN h0 ON h0.id = w.src GROUP BY ALL), h2 AS (SELECT w.dst AS id, dim, sum(w * v) AS v FROM w JOIN h1 ON h1.id = w.src GROUP BY ALL)"


def _propagated(spark, sf):
    n = G.nodes(spark, sf)
    return P.propagate_smoothed(G.item_pairs(spark, sf), n, 2, WIDTH)


@query("propagate_hops", _PROP + " SELECT id, 0::BIGINT AS hop, dim, round(v, 6) + 0.0 AS v FROM h0 UNION ALL SELECT id, 1, dim, round(v, 6) + 0.0 FROM h1 UNION ALL SELECT id, 2, dim, round(v, 6) + 0.0 FROM h2")
def _(spark, sf):
    return _explode(_propagated(spark, sf), "x", "id", "hop")


@query("propagate_mean", _PROP + " SELECT h0.id, h0.dim, round((h0.v + h1.v + h2.v) / 3, 6) + 0.0 AS v FROM h0 JOIN h1 USING (id, dim) JOIN h2 USING (id, dim)")
def _(spark, sf):
    h = _propagated(spark, sf)
    m = h.groupBy("id").agg(*[(F.sum(F.get("x", F.lit(i))) / 3).alias(f"c{i}") for i in range(WIDTH)])
    return _explode(m.select("id", F.array(*[f"c{i}" for i in range(WIDTH)]).alias("x")), "x", "id")


@query("ppr_topk")
def _(spark, sf):
    return P.ppr_topk(G.item_pairs(spark, sf), _split(spark, sf, "test"), 5)


@query("components")
def _(spark, sf):
    return components(G.purchase_edges(spark, sf).select(F.col("src").alias("u"), F.col("dst").alias("v")))


@query("laplacian_pe")
def _(spark, sf):
    return P.laplacian_encoding(G.item_pairs(spark, sf), G.nodes(spark, sf), 2)


@query("partition_relabel")
def _(spark, sf):
    return P.partition_relabel(G.item_pairs(spark, sf), G.nodes(spark, sf))


@query("balanced_parts")
def _(spark, sf):
    return T.relabelled(T.balanced_parts(G.item_pairs(spark, sf), G.nodes(spark, sf).select("id"), 4))


@query("strong_components", f"WITH RECURSIVE {_ITEM}, reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT a, dst FROM reach JOIN item ON src = b) SELECT p.a AS id, min(p.b) AS component FROM reach p JOIN reach q ON p.a = q.b AND p.b = q.a GROUP BY p.a")
def _(spark, sf):
    return strong.strong_components(G.item_edges(spark, sf), G.nodes(spark, sf).select("id"))


@query("graph_conditions", f"WITH RECURSIVE {_ITEM}, {_BOTH}, reach AS (SELECT min(vec_id) AS b FROM embeddings UNION SELECT dst FROM reach JOIN both_ ON src = b), k AS (SELECT count(*) AS n_nodes, count(*) FILTER (WHERE vec_id % 7 <> 0) AS n_without_loop FROM embeddings), r AS (SELECT count(*) AS met FROM reach) SELECT n_nodes, n_without_loop, met = n_nodes AS connected FROM k, r")
def _(spark, sf):
    nodes = G.nodes(spark, sf).select("id")
    loops = nodes.where("id % 7 = 0").select(F.col("id").alias("src"), F.col("id").alias("dst"))
    found = strong.conditions(G.item_edges(spark, sf).unionByName(loops), nodes)
    return found.select("n_nodes", "n_without_loop", (F.col("n_weak") == 1).alias("connected"))


@query("weighted_sample", f"WITH {_ITEM}, r AS (SELECT src, dst, row_number() OVER (PARTITION BY dst ORDER BY round(-ln(({_h('src', 'dst', 9)} + 1) / 2147483649.0::DOUBLE) / (1 + (src + dst) % 3), 9), src) AS k FROM item) SELECT src, dst FROM r WHERE k <= 5")
def _(spark, sf):
    w = G.item_edges(spark, sf).withColumn("w", (1 + (F.col("src") + F.col("dst")) % 3).cast("double"))
    return H.weighted_sample(w, 5, 9).select("src", "dst")


_POWERS = _NORM + ", r AS (SELECT vec_id AS id, row_number() OVER (ORDER BY " + _hn("vec_id", 5) + ", vec_id) - 1 AS place FROM embeddings), g AS (SELECT id, place // 64 AS seq, place % 64 AS pos FROM r), p1 AS MATERIALIZED (SELECT src, dst, w FROM w), " + ", ".join(f"p{m} AS MATERIALIZED (SELECT p{m - 1}.src, w.dst, sum(p{m - 1}.w * w.w) AS w FROM p{m - 1} JOIN w ON w.src = p{m - 1}.dst GROUP BY ALL)" for m in (2, 3)) + ", al AS (SELECT 1 AS m, * FROM p1 UNION ALL SELECT 2, * FROM p2 UNION ALL SELECT 3, * FROM p3)"


@query("group_powers", _POWERS + " SELECT a.seq AS seq_id, a.pos AS row, b.pos AS col, m, round(w, 9) + 0.0 AS value FROM al JOIN g a ON a.id = al.src JOIN g b ON b.id = al.dst AND a.seq = b.seq WHERE round(w, 9) <> 0")
def _(spark, sf):
    nodes, path = G.nodes(spark, sf), new_path(spark, "batches")
    splits.write_batches(splits.random_groups(nodes.select("id"), 64, 5), path, "s64")
    each = slabs.powers_in_groups(G.item_pairs(spark, sf), nodes, spark.read.parquet(f"{path}/data_s64.parquet"), 3)
    return each.select("seq_id", "row", "col", F.col("m").cast("int").alias("m"), (F.round("value", 9) + 0.0).alias("value")).where("value <> 0")


def _weights(spark, sf, hidden: int = 16, classes: int = 10) -> DataFrame:
    """Weights of a small model, read off the embeddings: a stretch of cells for each layer, the same at every size of the table."""
    shapes = {"in": (hidden, WIDTH), "out": (classes, hidden)}
    for i in range(2):
        shapes |= {f"{i}.{p}": (hidden, hidden) for p in "qkvo"} | {f"{i}.up": (2 * hidden, hidden), f"{i}.down": (hidden, 2 * hidden)}
    cells = G.nodes(spark, sf).select("id", F.posexplode("x").alias("p", "v")).select((F.col("id") * WIDTH + F.col("p")).alias("at"), "v")
    out, start = None, 0
    for name, (r, c) in shapes.items():
        own = cells.where(F.col("at").between(start, start + r * c - 1)).withColumn("k", F.col("at") - start)
        own = own.select(F.lit(name).alias("layer"), F.expr(f"k div {c}").alias("row"), (F.col("k") % c).alias("col"), (F.col("v") / float(c) ** 0.5).alias("value"))
        out, start = own if out is None else out.unionByName(own), start + r * c
    return out


@query("forward_pass")
def _(spark, sf):
    got = forward(G.nodes(spark, sf).select("id", "x"), _merged(spark, sf), _weights(spark, sf), 2, 4)
    return got.select("id", argmax0("logp").alias("pred"), F.transform("logp", lambda v: F.round(v, 6)).alias("logp"))


# --- attention


def _w(table_: str, score: str, extra: str = "") -> str:
    return f"sc AS (SELECT e.src, e.dst, k.x AS k, exp({score}{extra}) AS w FROM {table_} e JOIN nodes k ON k.id = e.src JOIN nodes q ON q.id = e.dst)"


_KQ = _dot("k.x", "q.x")
_SUMS = f"zs AS (SELECT dst, sum(w) AS z FROM sc GROUP BY dst), vs AS (SELECT dst, dim, sum(w * v) AS s FROM (SELECT dst, w, unnest(range({WIDTH}))::BIGINT AS dim, unnest(k) AS v FROM sc) GROUP BY dst, dim)"
_OUT = f"SELECT id, dim, round(coalesce(s, 0) / (coalesce(z, 0) + 1e-6), 6) + 0.0 AS v FROM (SELECT id, unnest(range({WIDTH}))::BIGINT AS dim FROM nodes) LEFT JOIN zs ON zs.dst = id LEFT JOIN vs USING (dst, dim)"
_OUT = _OUT.replace("LEFT JOIN vs USING (dst, dim)", "LEFT JOIN vs ON vs.dst = id AND vs.dim = dim_").replace("unnest(range(64))::BIGINT AS dim FROM nodes", "unnest(range(64))::BIGINT AS dim_ FROM nodes").replace("SELECT id, dim, round", "SELECT id, dim_ AS dim, round", 1)


@query("edge_softmax", _MERGED + f", {_NODES}, {_w('merged', f'greatest(least({_KQ} / 8, 5), -5)')} SELECT dst AS id, round(sum(w), 6) AS z FROM sc GROUP BY dst")
def _(spark, sf):
    n = G.nodes(spark, sf)
    return A.weights(_merged(spark, sf), n, WIDTH).groupBy(F.col("dst").alias("id")).agg(F.round(F.sum("w"), 6).alias("z"))


@query("merged_edge_attention", _MERGED + f", {_NODES}, {_w('merged', f'greatest(least({_KQ} / 8, 5), -5)')}, {_SUMS} {_OUT}")
def _(spark, sf):
    n = G.nodes(spark, sf)
    return _explode(A.softmax(A.weights(_merged(spark, sf), n, WIDTH), n, WIDTH), "out", "id")


@query("two_phase_attention", ORACLES["merged_edge_attention"])
def _(spark, sf):
    return _explode(two_phase(_merged(spark, sf), G.nodes(spark, sf), WIDTH), "out", "id")


@query("head_mass", f"WITH {_ITEM}, {_NODES}, e AS (SELECT head, src, dst FROM item, range(4) t(head) WHERE src % 4 = head), sc AS (SELECT e.head, e.dst, exp(greatest(least({_KQ} / 8, 5), -5)) AS w FROM e JOIN nodes k ON k.id = e.src JOIN nodes q ON q.id = e.dst), t AS (SELECT dst, sum(w) AS t FROM sc GROUP BY dst), p AS (SELECT dst, head, sum(w) AS m FROM sc GROUP BY ALL) SELECT head, round(sum(m / t) / (SELECT count(*) FROM t), 9) AS mass FROM p JOIN t USING (dst) GROUP BY head")
def _(spark, sf):
    pairs = G.item_pairs(spark, sf)
    return A.grouped_head_mass(E.distinct_pairs(pairs), pairs.count(), G.nodes(spark, sf), WIDTH, 4).where("mass > 0").withColumn("mass", F.round("mass", 9))


@query("edge_softmax_list", _MERGED + f", {_NODES}, {_w('merged', f'greatest(least({_KQ}, 5), -5) / 8')} SELECT dst AS id, round(sum(w), 6) AS z FROM sc GROUP BY dst")
def _(spark, sf):
    n = G.nodes(spark, sf)
    return A.weights(_merged(spark, sf), n, WIDTH, "list").groupBy(F.col("dst").alias("id")).agg(F.round(F.sum("w"), 6).alias("z"))


@query("edge_softmax_typed", _TYPED + f", {_NODES}, {_w('typed', f'greatest(least({_KQ} * CASE etype WHEN 0 THEN 1.0 ELSE 0.5 END / 8, 5), -5)')} SELECT dst AS id, round(sum(w), 6) AS z FROM sc GROUP BY dst")
def _(spark, sf):
    n = G.nodes(spark, sf)
    e = S.merged_typed(G.item_edges(spark, sf), n.select("id"), 4, 4)
    return A.weights(e, n, WIDTH, etype={0: 1.0, 1: 0.5}).groupBy(F.col("dst").alias("id")).agg(F.round(F.sum("w"), 6).alias("z"))


@query("edge_softmax_bias", _MERGED + f", {_NODES}, {_w('merged', f'greatest(least({_KQ} / 8, 5), -5)', ' + ((e.src + e.dst) % 3) * 0.25')} SELECT dst AS id, round(sum(w), 6) AS z FROM sc GROUP BY dst")
def _(spark, sf):
    n = G.nodes(spark, sf)
    bias = ((F.col("src") + F.col("dst")) % 3) * 0.25
    return A.weights(_merged(spark, sf), n, WIDTH, bias=bias).groupBy(F.col("dst").alias("id")).agg(F.round(F.sum("w"), 6).alias("z"))


@query("edge_softmax_normalised", _MERGED + f", {_NODES}, {_w('merged', f'greatest(least({_KQ} / 8, 5), -5)')}, zs AS (SELECT dst, sum(w) AS z FROM sc GROUP BY dst) SELECT src, sc.dst, round(w / (z + 1e-6), 6) AS p FROM sc JOIN zs USING (dst)")
def _(spark, sf):
    return A.normalised_weights(A.weights(_merged(spark, sf), G.nodes(spark, sf), WIDTH)).withColumn("p", F.round("p", 6))


_DENSE = f"WITH {_NODES}, s AS (SELECT a.id, b.x AS k, {_dot('a.x', 'b.x')} / 8 AS s FROM nodes a JOIN nodes b ON a.id // 50 = b.id // 50), m AS (SELECT id, max(s) AS m FROM s GROUP BY id), sc AS (SELECT s.id AS dst, k, exp(s - m) AS w FROM s JOIN m USING (id)), {_SUMS} SELECT dst AS id, dim, round(s / z, 6) + 0.0 AS v FROM vs JOIN zs USING (dst)"


@query("dense_attention", _DENSE)
def _(spark, sf):
    return _explode(A.dense(G.nodes(spark, sf), F.expr("id div 50"), WIDTH, multiply=False), "out", "id")


@query("favor_attention")
def _(spark, sf):
    import math

    fixed = [[math.sin(1.0 + 7.0 * i + 3.0 * j) for j in range(WIDTH)] for i in range(8)]
    return _explode(A.favor(G.nodes(spark, sf), fixed, WIDTH), "out", "id")


@query("hop_attention", _PROP + ", own AS (SELECT id, sum(v) AS t FROM h0 GROUP BY id), hh AS (SELECT id, 1 AS hop, dim, v FROM h1 UNION ALL SELECT id, 2, dim, v FROM h2), ws AS (SELECT hh.id, hop, exp(any_value(own.t) * 0.5 + sum(v)) AS w FROM hh JOIN own USING (id) GROUP BY hh.id, hop), zs AS (SELECT id, sum(w) AS z FROM ws GROUP BY id), mx AS (SELECT hh.id, dim, sum(v * w / z) AS v FROM hh JOIN ws USING (id, hop) JOIN zs USING (id) GROUP BY hh.id, dim) SELECT h0.id, h0.dim, round(h0.v + mx.v, 6) + 0.0 AS v FROM h0 JOIN mx USING (id, dim)")
def _(spark, sf):
    return _explode(A.hop_readout(_propagated(spark, sf)), "out", "id")


_LOGITS = "list_transform(range(10), lambda j: x[j + 1] * 2 + x[j + 11])"
_LSE = f"l AS (SELECT id, y, {_LOGITS} AS z FROM nodes), p AS (SELECT id, y, z, ln(list_sum(list_transform(z, lambda v: exp(v - list_max(z))))) + list_max(z) AS lse FROM l)"


def _logits(spark, sf):
    n = G.nodes(spark, sf)
    z = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda j: F.get("x", j) * 2 + F.get("x", j + 10))
    return n.select("id", "y", A.log_softmax(z).alias("logp"))


@query("log_softmax_argmax", f"WITH {_NODES}, {_LSE} SELECT id, list_position(z, list_max(z))::BIGINT - 1 AS pred, round(list_max(z) - lse, 6) AS best FROM p")
def _(spark, sf):
    return _logits(spark, sf).select("id", argmax0("logp").alias("pred"), F.round(F.array_max("logp"), 6).alias("best"))


@query("dense_layers", f"WITH {_NODES}, s AS (SELECT id, x, list_sum(x) / 64 AS m FROM nodes), t AS (SELECT id, x, m, list_sum(list_transform(x, lambda v: (v - m) * (v - m))) / 64 AS s2 FROM s) SELECT id, round(list_sum(list_transform(x, lambda v: greatest((v - m) / sqrt(s2 + 1e-5), 0))), 6) AS total FROM t")
def _(spark, sf):
    r = A.relu(A.layer_norm(F.col("x")))
    return G.nodes(spark, sf).select("id", F.round(F.aggregate(r, F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


# --- metrics


_PART = f"CASE WHEN {_hn('id')} % 10 < 6 THEN 'train' WHEN {_hn('id')} % 10 < 8 THEN 'valid' ELSE 'test' END"


def _parted(spark, sf) -> DataFrame:
    return _logits(spark, sf).select("id", "y", "logp", argmax0("logp").alias("pred"), G.part_of(F.col("id")).alias("part"))


@query("accuracy_by_split", f"WITH {_NODES}, {_LSE} SELECT {_PART} AS part, sum((list_position(z, list_max(z)) - 1 = y)::BIGINT)::BIGINT / count(*) AS accuracy, count(*) AS n FROM p GROUP BY ALL")
def _(spark, sf):
    return M.accuracy(_parted(spark, sf))


@query("auc", f"WITH {_NODES}, s AS (SELECT floor(x[1] * 50) AS score, (y % 2)::BIGINT AS y FROM nodes), r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS k FROM s) SELECT round((sum(k) FILTER (WHERE y = 1) - sum(y)::DOUBLE * (sum(y) + 1) / 2) / (sum(y)::DOUBLE * sum(1 - y)), 9) AS auc FROM r")
def _(spark, sf):
    s = G.nodes(spark, sf).select(F.floor(F.get("x", F.lit(0)) * 50).alias("score"), (F.col("y") % 2).alias("y"))
    return M.auc(s).select(F.round("auc", 9).alias("auc"))


@query("nll", f"WITH {_NODES}, {_LSE} SELECT {_PART} AS part, round(avg(lse - z[y + 1]), 6) AS loss, count(*) AS n FROM p GROUP BY ALL")
def _(spark, sf):
    return M.nll(_parted(spark, sf)).withColumn("loss", F.round("loss", 6))


_QUANT = "SELECT p_partkey AS id, (SELECT count(*) FROM unnest(q) t(c) WHERE c <= p_retailprice)::BIGINT AS y FROM part, (SELECT quantile_cont(p_retailprice, [0.2, 0.4, 0.6, 0.8]) AS q FROM part)"


def _quantiles(spark, sf):
    return M.quantile_labels(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("v")), 5)


@query("quantile_labels", _QUANT)
def _(spark, sf):
    return _quantiles(spark, sf)


@query("label_histogram", f"SELECT y, count(*) AS n FROM ({_QUANT}) GROUP BY y")
def _(spark, sf):
    return _quantiles(spark, sf).groupBy("y").agg(F.count(F.lit(1)).alias("n"))


_MASS = _SPD + ", per AS (SELECT dst, bin AS hop, sum(1 + (src * 7 + dst * 3) % 5)::DOUBLE AS m FROM spd GROUP BY dst, bin), c AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY dst ORDER BY hop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(m) OVER (PARTITION BY dst) AS t FROM per), share AS (SELECT dst, hop, m / sum(m) OVER (PARTITION BY dst) AS share FROM c WHERE b < t * 0.9 - 1e-12)"


def _shares(spark, sf):
    spd = _spd(spark, sf)
    att = spd.select("src", "dst", (1 + (F.col("src") * 7 + F.col("dst") * 3) % 5).cast("double").alias("w"))
    return M.hop_mass(att, spd, 0.9)


@query("hop_mass", _MASS + " SELECT dst, hop, round(share, 9) AS share FROM share")
def _(spark, sf):
    return _shares(spark, sf).withColumn("share", F.round("share", 9))


@query("hop_report", _MASS + ", r AS (SELECT hop, sum(share) / (SELECT count(DISTINCT dst) FROM share) AS ratio FROM share GROUP BY hop) SELECT hop, round(ratio, 9) AS ratio, round(CASE WHEN hop > 0 THEN ratio / (SELECT sum(ratio) FROM r WHERE hop > 0) ELSE 0 END, 9) AS graph_ratio FROM r")
def _(spark, sf):
    return M.hop_report(_shares(spark, sf)).select("hop", F.round("ratio", 9).alias("ratio"), F.round("graph_ratio", 9).alias("graph_ratio"))


_RUNS = "runs AS (SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS epoch, value::DOUBLE AS loss FROM events)"


def _runs(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("run"), F.col("value").cast("double").alias("loss"), "event_id")
    return placed_in(e, ["run"], ["event_id"], "epoch").select("run", (F.col("epoch") + 1).alias("epoch"), "loss")


def _best(runs: DataFrame) -> DataFrame:
    return M.best_by_validation(runs.select("run", "epoch", F.floor(F.col("loss") / 20).alias("valid"), F.col("loss").alias("test")))


@query("ema_loss")
def _(spark, sf):
    return M.ema(_runs(spark, sf))


@query("best_by_val", f"WITH {_RUNS} SELECT run, epoch, test FROM (SELECT run, epoch, loss AS test, row_number() OVER (PARTITION BY run ORDER BY floor(loss / 20) DESC, epoch) AS k FROM runs) WHERE k = 1")
def _(spark, sf):
    return _best(_runs(spark, sf))


@query("profile_rollup", "WITH r AS (SELECT event_type AS name, user_id % 4 AS k, count(*) AS n, sum(round(value)::BIGINT) AS t FROM events GROUP BY ALL) SELECT name, sum(n)::BIGINT AS n, sum(t)::BIGINT AS total, round(sum(t) / sum(n), 6) AS mean, max(t)::BIGINT AS slowest_rank_total FROM r GROUP BY name")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("name"), (F.col("user_id") % 4).alias("rank"), F.round("value").cast("bigint").alias("ms"))
    return M.profile_rollup(e).withColumn("mean", F.round("mean", 6))


# --- planning


@query("working_set", f"WITH {_ITEM}, e AS (SELECT count(*) AS e FROM item) SELECT w, l, 48 * e + 8 * c + 8 * (c + 1) + 8 * c * w * (l + 1) + 33 * c * w + 16 * c * w * l AS bytes FROM e, n, range(1, 5) a(w), range(1, 5) b(l)")
def _(spark, sf):
    e = G.item_edges(spark, sf).agg(F.count(F.lit(1)).alias("e"))
    grid = spark.range(1, 5).select(F.col("id").alias("w")).crossJoin(spark.range(1, 5).select(F.col("id").alias("l"))).crossJoin(F.broadcast(e))
    return grid.select("w", "l", B.working_set(F.col("e"), F.lit(G.n_nodes(spark, sf)), F.col("w"), F.col("l")).alias("bytes"))


_PROBES = "p AS (SELECT event_id // 10 AS round, CASE event_id % 2 WHEN 0 THEN 'real_up' ELSE 'rw_up' END AS kind, avg(value) + 1 AS base, max(value) AS cand FROM events GROUP BY ALL)"


@query("probe_gain", f"WITH {_PROBES}, g AS (SELECT round, kind, round((base - cand) / greatest(base, 1e-6), 6) AS gain FROM p) SELECT round, kind, gain FROM (SELECT *, row_number() OVER (PARTITION BY round ORDER BY gain DESC, kind DESC) AS k FROM g) WHERE k = 1")
def _(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_id") % 2 == 0, "real_up").otherwise("rw_up")
    p = e.groupBy(F.expr("event_id div 10").alias("round"), kind.alias("kind")).agg((F.avg("value") + 1).alias("base"), F.max("value").alias("cand"))
    return B.probe_choice(p, 6)


@query("random_batches", f"SELECT vec_id AS id, (row_number() OVER (ORDER BY {_hn('vec_id', 5)}, vec_id) - 1) // 64 AS batch FROM embeddings")
def _(spark, sf):
    nodes = G.nodes(spark, sf).select("id", node_key(F.col("id"), 5).alias("key"))
    return running(nodes, ["key", "id"], {"at": 1}).select("id", F.floor(F.col("at") / 64).cast("bigint").alias("batch"))


# --- ranges, batches and head views


@query("rank_range", f"WITH {_N}, r AS (SELECT r, r * ((c + 2) // 3) AS lo, (r + 1) * ((c + 2) // 3) AS hi FROM n, range(3) t(r)) SELECT r, vec_id - lo AS id, label::BIGINT AS y FROM embeddings, r WHERE vec_id >= lo AND vec_id < hi")
def _(spark, sf):
    nodes, n = G.nodes(spark, sf).select("id", "y"), G.n_nodes(spark, sf)
    width = (n + 2) // 3
    parts = [H.rank_range(nodes, r * width, (r + 1) * width, n).select(F.lit(r).cast("bigint").alias("r"), "id", "y") for r in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("dst_filter_each", f"WITH {_ITEM} SELECT src, dst, count(*) AS n FROM item JOIN lineitem ON l_suppkey = dst GROUP BY ALL")
def _(spark, sf):
    probes = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"))
    return H.by_destination_each(G.item_edges(spark, sf), probes).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("hop_bound", f"WITH {_ITEM}, {_STARTS}, {_walk('item', 'starts', 2, 3)}, {_pool(1)} SELECT src, dst, walk, hop FROM pool WHERE hop <= 2")
def _(spark, sf):
    return H.hop_bound(S.walk_pool(G.item_edges(spark, sf), G.nodes(spark, sf).select("id"), 2, 3), 2)


@query("padded_nodes", f"WITH {_N} SELECT vec_id AS id, label::BIGINT AS y, round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total FROM embeddings UNION ALL SELECT i, -100, 0.0 FROM n, range(c, c + 37) t(i)")
def _(spark, sf):
    n = G.n_nodes(spark, sf)
    p = H.pad(G.nodes(spark, sf), n, n + 37, {"x": F.array_repeat(F.lit(0.0), WIDTH), "y": F.lit(-100)})
    return p.select("id", "y", (F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 6) + 0.0).alias("total"))


@query("local_subgraph", f"WITH {_ITEM}, s AS (SELECT vec_id AS node FROM embeddings WHERE {_TRAIN}), t AS (SELECT src, dst FROM {_top('item', 4, 17)} WHERE dst IN (SELECT node FROM s)), m AS (SELECT node, false AS c FROM s UNION ALL SELECT node, true FROM (SELECT src AS node FROM t UNION SELECT dst FROM t) ANTI JOIN s USING (node)), p AS (SELECT node, row_number() OVER (ORDER BY c, node) - 1 AS pos FROM m) SELECT a.pos AS src, b.pos AS dst FROM t JOIN p a ON a.node = src JOIN p b ON b.node = dst")
def _(spark, sf):
    seeds = _split(spark, sf, "train")
    return H.local_subgraph(E.by_destination(S.topk(G.item_edges(spark, sf), 4, 17), seeds), seeds)[1]


_VISITS = "WITH " + _ITEM + ", " + _STARTS + ", {walk}, m AS (SELECT * FROM lagged WHERE step >= 1 AND (step = 1 OR node <> prev))"


@query("grouped_walks", _VISITS.format(walk=_walk("item", "starts", 6, 3)) + ", g AS (SELECT *, (start * 6 + walk) // (c * 2) AS grp FROM m, n), k AS (SELECT * FROM g WHERE (step - 1) % 3 = grp), f AS (SELECT node, min(step) AS step FROM k GROUP BY node) SELECT grp, start AS src, node AS dst FROM k JOIN f USING (node, step)")
def _(spark, sf):
    return H.grouped_walks(G.item_edges(spark, sf), G.nodes(spark, sf).select("id"), 2, 3, 3)


@query("group_nodes", _VISITS.format(walk=_walk("item", "starts", 2, 2)) + ", g AS (SELECT start % 4 AS grp, step, start, walk, node FROM m WHERE node % 4 <> start % 4), f AS (SELECT grp, node, min(step) AS step FROM g GROUP BY ALL), a AS (SELECT id % 4 AS grp, 0 AS step, id AS start, 0 AS walk, id AS node FROM starts UNION ALL SELECT grp, step, start, walk, node FROM g JOIN f USING (grp, node, step)) SELECT grp, pos, node FROM (SELECT grp, node, row_number() OVER (PARTITION BY grp ORDER BY step, start, walk) - 1 AS pos FROM a) WHERE pos < 300")
def _(spark, sf):
    return H.group_nodes(G.item_edges(spark, sf), G.nodes(spark, sf).select("id"), 2, 2, 4, 300)


@query("edge_drop", f"WITH {_ITEM} SELECT src, dst FROM item WHERE {_h('src', 'dst', 5)} >= 0.25::DOUBLE * 2147483648")
def _(spark, sf):
    return H.edge_drop(G.item_edges(spark, sf), 0.25, 5)


@query("grouped_heads", f"WITH {_ITEM} SELECT head, src, dst FROM item, range(8) t(head) WHERE src % 3 = least(head // 3, 2)")
def _(spark, sf):
    return H.grouped_heads(G.item_edges(spark, sf), 8, 3)


@query("hop_heads", f"WITH {_ITEM}, {_STARTS}, {_walk('item', 'starts', 2, 2)}, {_pool(1)} SELECT head, src, dst FROM pool, range(4) t(head) WHERE hop - 1 = CASE head // 2 WHEN 0 THEN 1 ELSE 0 END")
def _(spark, sf):
    pool = _pooled(spark, sf).withColumn("bucket", F.col("hop") - 1)
    return H.hop_heads(pool, 4, [1, 5], 2, 2)


@query("expander_graph", f"WITH {_ITEM}, {_STARTS}, c AS (SELECT * FROM {_cycle(0)} UNION ALL SELECT * FROM {_cycle(1)}) SELECT src, dst, 0::BIGINT AS etype FROM item UNION ALL SELECT id, id, 0 FROM starts UNION ALL SELECT src, dst, 1 FROM c UNION ALL SELECT dst, src, 1 FROM c")
def _(spark, sf):
    return H.expander_graph(G.item_edges(spark, sf), G.nodes(spark, sf), 2)


_BATCH = f"WITH {_ITEM}, r AS (SELECT *, row_number() OVER (ORDER BY {_hn('vec_id', 5)}, vec_id) - 1 AS place FROM embeddings), p AS (SELECT place // 64 AS batch, place % 64 + 1 AS pos, vec_id AS id, label::BIGINT AS y FROM r), k AS (SELECT batch, count(*) AS n FROM p GROUP BY batch)"


@query("batch_nodes", _BATCH + " SELECT batch, pos, id, y FROM p UNION ALL SELECT batch, 0, -1, -100 FROM k UNION ALL SELECT batch, i, -1, -100 FROM k, range(1, 65) t(i) WHERE i > n")
def _(spark, sf):
    return H.batch_tables(G.item_edges(spark, sf), G.nodes(spark, sf), 64, WIDTH, 5)[0].select("batch", "pos", F.coalesce("id", F.lit(-1)).alias("id"), "y")


@query("batch_edges", _BATCH + " SELECT a.batch, a.pos AS src, b.pos AS dst FROM item JOIN p a ON a.id = src JOIN p b ON b.id = dst AND a.batch = b.batch UNION ALL SELECT batch, pos, 0 FROM p UNION ALL SELECT batch, 0, pos FROM p")
def _(spark, sf):
    return H.batch_tables(G.item_edges(spark, sf), G.nodes(spark, sf), 64, WIDTH, 5)[1]


@query("edge_bias_table", _SPD + f", {_NODES}, {_w('spd', f'greatest(least({_KQ} / 8, 5), -5)', ' + e.bin * 0.25')} SELECT dst AS id, round(sum(w), 6) AS z FROM sc GROUP BY dst")
def _(spark, sf):
    spd = _spd(spark, sf)
    e = A.with_bias(spd.select("src", "dst"), spd.where("bin > 0").select("src", "dst", (F.col("bin") * 0.25).alias("bias")))
    return A.weights(e, G.nodes(spark, sf), WIDTH, bias=F.col("bias")).groupBy(F.col("dst").alias("id")).agg(F.round(F.sum("w"), 6).alias("z"))


@query("edge_softmax_type_vectors", _TYPED + f", {_NODES}, sc AS (SELECT e.dst, exp(greatest(least(list_sum(list_transform(range(64), lambda i: k.x[i + 1] * q.x[i + 1] / 8 * (1 + ((etype + 1) * i % 5) * 0.25))), 5), -5)) AS w FROM typed e JOIN nodes k ON k.id = e.src JOIN nodes q ON q.id = e.dst) SELECT dst AS id, round(sum(w), 6) AS z FROM sc GROUP BY dst")
def _(spark, sf):
    n = G.nodes(spark, sf)
    types = {t: [1 + ((t + 1) * i % 5) * 0.25 for i in range(WIDTH)] for t in (0, 1)}
    e = A.by_type(S.merged_typed(G.item_edges(spark, sf), n.select("id"), 4, 4), n, WIDTH, types)
    return e.groupBy(F.col("dst").alias("id")).agg(F.round(F.sum("w"), 6).alias("z"))


def _matrix(a: int) -> str:
    return f"list_transform(range(32), lambda i: list_sum(list_transform(range(64), lambda j: x[j + 1] * (((i * {a} + j * 7) % 11) - 5) * 0.125)))"


@query("multi_head_attention", _MERGED + f", {_NODES}, pr AS (SELECT id, {_matrix(3)} AS q, {_matrix(5)} AS k, {_matrix(9)} AS v FROM nodes), hd AS (SELECT id, h, q[h * 8 + 1 : h * 8 + 8] AS q, k[h * 8 + 1 : h * 8 + 8] AS k, v[h * 8 + 1 : h * 8 + 8] AS v FROM pr, range(4) t(h)), sc AS (SELECT e.dst, s.h, s.v, exp(greatest(least({_dot('s.k', 'd.q')} / sqrt(8), 5), -5)) AS w FROM merged e JOIN hd s ON s.id = e.src JOIN hd d ON d.id = e.dst AND d.h = s.h), zs AS (SELECT dst, h, sum(w) AS z FROM sc GROUP BY ALL), vs AS (SELECT dst, h, dim, sum(w * v) AS s FROM (SELECT dst, h, w, unnest(range(8))::BIGINT AS dim, unnest(v) AS v FROM sc) GROUP BY ALL) SELECT id, f.h AS head, f.dim, round(coalesce(s, 0) / (coalesce(z, 0) + 1e-6), 6) + 0.0 AS v FROM (SELECT id, h, unnest(range(8))::BIGINT AS dim FROM hd) f LEFT JOIN zs ON zs.dst = id AND zs.h = f.h LEFT JOIN vs ON vs.dst = id AND vs.h = f.h AND vs.dim = f.dim")
def _(spark, sf):
    w = [[[(((i * a + j * 7) % 11) - 5) * 0.125 for j in range(WIDTH)] for i in range(32)] for a in (3, 5, 9)]
    out = A.multi_head(_merged(spark, sf), G.nodes(spark, sf), 4, *w)
    return _explode(out, "out", "id", "head")


@query("batch_norm", f"WITH {_NODES}, l AS (SELECT id, unnest(range(64))::BIGINT AS dim, unnest(x) AS v FROM nodes), s AS (SELECT dim, avg(v) AS m, var_pop(v) AS s2 FROM l GROUP BY dim) SELECT id, dim, round((v - m) / sqrt(s2 + 1e-5), 6) + 0.0 AS v FROM l JOIN s USING (dim)")
def _(spark, sf):
    return _explode(A.batch_norm(G.nodes(spark, sf), WIDTH), "x", "id")


@query("needed_hops", _MASS + " SELECT avg(h) AS mean_hop, max(h) AS max_hop, count(*) AS n FROM (SELECT dst, max(hop) AS h FROM share GROUP BY dst)")
def _(spark, sf):
    return M.needed_hops(_shares(spark, sf))


@query("hop_relative", _MASS + ", q AS (SELECT count(DISTINCT dst) AS q FROM share), t AS (SELECT count(*) AS t FROM spd), c2 AS (SELECT bin AS hop, count(*) AS n FROM spd GROUP BY bin), s AS (SELECT hop, sum(share) AS s FROM share GROUP BY hop) SELECT hop, round(t / q, 9) AS n_eff, round(s / n * (t / q), 9) AS relative FROM s JOIN c2 USING (hop), q, t")
def _(spark, sf):
    r = M.hop_relative(_shares(spark, sf), _spd(spark, sf).withColumnRenamed("bin", "hop"))
    return r.select("hop", F.round("n_eff", 9).alias("n_eff"), F.round("relative", 9).alias("relative"))


@query("edge_hop_mass", f"WITH {_ITEM}, {_STARTS}, {_walk('item', 'starts', 2, 3)}, {_pool(1)}, p AS (SELECT hop, sum(1 + (src + dst) % 3)::DOUBLE AS m FROM pool GROUP BY hop), s AS (SELECT hop, m / sum(m) OVER () AS share FROM p), u AS (SELECT *, sum(share) OVER (ORDER BY hop) AS cum FROM s) SELECT hop, round(share, 9) AS share, min(hop) FILTER (WHERE cum >= 0.6 - 1e-12) OVER () AS needed FROM u")
def _(spark, sf):
    pool = S.walk_pool(G.item_edges(spark, sf), G.nodes(spark, sf).select("id"), 2, 3)
    return M.edge_hop_mass(pool.withColumn("p", (1 + (F.col("src") + F.col("dst")) % 3).cast("double")), 0.6).withColumn("share", F.round("share", 9))


@query("throughput", "WITH r AS (SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS epoch, value::DOUBLE AS v FROM events) SELECT run, round(avg(v), 6) AS wall, round(sum(v / 4) / sum(v), 6) AS prep_share, round(1000 / avg(v / 2), 6) AS nodes_per_s FROM r WHERE epoch > 1 GROUP BY run")
def _(spark, sf):
    r = _runs(spark, sf).select("run", "epoch", F.col("loss").alias("wall"), (F.col("loss") / 4).alias("prep"), (F.col("loss") / 2).alias("eval"))
    return M.throughput(r, 1000).select("run", *[F.round(c, 6).alias(c) for c in ("wall", "prep_share", "nodes_per_s")])


_GATE = "WITH p AS (SELECT user_id AS run, event_id % 4 AS budget, max(value)::DOUBLE AS peak FROM events GROUP BY ALL), s AS (SELECT *, (peak - lag(peak) OVER w) / (budget - lag(budget) OVER w) AS slope FROM p WINDOW w AS (PARTITION BY run ORDER BY budget)), a AS (SELECT run, count(*) AS n, max_by(peak, budget) AS p, max(budget) AS b, greatest(coalesce(max(slope), 0), 0) AS slope FROM s GROUP BY run), x AS (SELECT run, 6::BIGINT AS target, CASE WHEN n >= 2 THEN p + slope * (6 - b) END AS predicted FROM a)"


@query("peak_gate", _GATE + " SELECT run, target, round(predicted, 6) AS predicted, coalesce(predicted <= 270.0, true) AS fits FROM x")
def _(spark, sf):
    seen = table(spark, sf, "events").select(F.col("user_id").alias("run"), (F.col("event_id") % 4).alias("budget"), F.col("value").cast("double").alias("peak"))
    wanted = seen.select("run").distinct().withColumn("target", F.lit(6).cast("bigint"))
    return B.peak_gate(seen, wanted, 300.0, 0.1).withColumn("predicted", F.round("predicted", 6))


@query("plan_text", "WITH s AS (SELECT p_partkey AS id, ['gpu_persist', 'gpu_ephemeral', 'elsewhere'][p_partkey % 3 + 1] AS policy, ['recompute', 'keep_mha', 'retain', 'drop'][p_partkey % 4 + 1] AS tier, p_size % 16 AS k FROM part) SELECT id, policy, tier, CASE WHEN tier = 'recompute' THEN 0 ELSE k END::BIGINT AS n FROM s WHERE policy <> 'elsewhere' AND tier <> 'drop' AND (tier = 'recompute' OR k <= 12)")
def _(spark, sf):
    at = lambda names, m: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % m + 1).cast("int"))
    tier = at(["recompute", "keep_mha", "retain", "drop"], 4)
    spec = F.concat(at(["gpu_persist", "gpu_ephemeral", "elsewhere"], 3), F.lit(": "), tier, F.when(tier == "recompute", "").otherwise(F.concat(F.lit("="), F.col("p_size") % 16)))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), B.parse_plan(spec, 12).alias("p")).where("p IS NOT NULL").select("id", "p.*")
