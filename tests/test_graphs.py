"""Partitions, strong components and page rank by push against brute force."""

import itertools
import random

import numpy as np

from plexus import strong
from plexus.operators import partition, spread


def got(df):
    return sorted(map(tuple, df.collect()))


def arcs(spark, pairs):
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


def tarjan(n, pairs):
    """Smallest node of each node's strong component, by Kosaraju's two searches."""
    out, back = {i: [] for i in range(n)}, {i: [] for i in range(n)}
    for i, j in pairs:
        out[i].append(j)
        back[j].append(i)
    order, seen = [], set()
    for s in range(n):
        stack = [(s, iter(out[s]))] if s not in seen else []
        seen.add(s)
        while stack:
            v, rest = stack[-1]
            w = next((x for x in rest if x not in seen), None)
            if w is None:
                order.append(v)
                stack.pop()
            else:
                seen.add(w)
                stack.append((w, iter(out[w])))
    root = {}
    for s in reversed(order):
        if s not in root:
            group, todo = {s}, [s]
            while todo:
                for w in back[todo.pop()]:
                    if w not in root and w not in group:
                        group.add(w)
                        todo.append(w)
            root.update(dict.fromkeys(group, min(group)))
    return root


def test_strong_components_of_a_random_graph(spark):
    n, m, rng = 24, 36, random.Random(1)
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    want = tarjan(n, pairs)
    assert dict(got(strong.strong_components(arcs(spark, pairs), spark.range(n)))) == want and 1 < len(set(want.values())) < n
    more = got(strong.chained(arcs(spark, pairs), spark.range(n), only_if_split=False))
    assert set(tarjan(n, more).values()) == {0} and len(more) == len(pairs) + len(set(want.values()))


def test_strong_components_of_paths_and_empty_tables(spark):
    path = [(i, i + 1) for i in range(4)]
    assert got(strong.strong_components(arcs(spark, path), spark.range(0))) == [(i, i) for i in range(5)]
    assert {c for _, c in got(strong.strong_components(arcs(spark, [*path, (4, 0)]), spark.range(0)))} == {0}
    assert got(strong.strong_components(arcs(spark, []), spark.range(2))) == [(0, 0), (1, 1)]
    assert got(strong.chained(arcs(spark, path), spark.range(5))) == path  # weakly connected: as it is
    assert got(strong.chained(arcs(spark, [(0, 1), (1, 0), (5, 6)]), spark.range(0))) == [(0, 1), (0, 5), (1, 0), (5, 6), (5, 6), (6, 0)]


def test_conditions_of_a_graph(spark):
    loops = [(i, i) for i in range(4)]
    row = lambda pairs, n: tuple(strong.conditions(arcs(spark, pairs), spark.range(n)).first())
    assert row([*loops, (0, 1), (2, 1), (2, 3)], 4) == (4, 0, 1, True)
    assert row([*loops, (0, 1), (2, 3)], 4) == (4, 0, 2, False)
    assert row([(0, 0), (0, 1), (1, 2), (2, 3)], 5) == (5, 4, 2, False)
    assert row([], 0) == (0, 0, 0, True)


def undirected_cut(pairs, part):
    return sum(part[i] != part[j] for i, j in {(min(p), max(p)) for p in pairs if p[0] != p[1]})


def test_best_cut_of_a_small_graph(spark):
    rng = random.Random(3)
    pairs = [(i, j) for b in (0, 6) for i, j in itertools.combinations(range(b, b + 6), 2) if rng.random() < 0.8] + [(0, 7), (3, 11), (5, 6)]
    part = dict(got(partition.balanced_parts(arcs(spark, pairs), spark.range(12), 2)))
    best = min(undirected_cut(pairs, {i: int(i in half) for i in range(12)}) for half in itertools.combinations(range(12), 6))
    assert sorted(np.bincount(list(part.values()))) == [6, 6] and undirected_cut(pairs, part) == best


def test_matchings_are_pairs_within_the_limit(spark):
    rng = random.Random(5)
    star = [(0, i) for i in range(1, 40)] + [(rng.randrange(40, 80), rng.randrange(40, 80)) for _ in range(60)]
    near = partition.undirected(arcs(spark, star))
    nodes = spark.range(90).selectExpr("id", "1 + id % 3 AS w")
    names = got(partition.matching(near, nodes, 4.0))
    assert [i for i, _ in names] == list(range(90))
    groups = {}
    for i, c in names:
        groups.setdefault(c, []).append(i)
    assert all(len(g) <= 2 and c == min(g) and (len(g) == 1 or sum(1 + i % 3 for i in g) <= 4) for c, g in groups.items())
    assert len(groups) < 65
    less, own = partition.coarser(near, nodes, spark.createDataFrame(names, "id bigint, coarse bigint"))
    name = dict(names)
    want = {}
    for i, j in {(i, j) for p in star for i, j in (p, p[::-1]) if i != j}:
        if name[i] != name[j]:
            want[name[i], name[j]] = want.get((name[i], name[j]), 0) + 1
    assert {(u, v): w for u, v, w in got(less)} == want
    assert dict(got(own)) == {c: sum(1 + i % 3 for i in g) for c, g in groups.items()}


def test_parts_are_balanced_through_levels(spark, monkeypatch):
    monkeypatch.setattr(partition, "FEWEST", 40)
    monkeypatch.setattr(partition, "PER_PART", 4)
    rng = random.Random(7)
    side = 9  # a grid, a hub and nodes without edges
    pairs = [(x * side + y, x * side + y + 1) for x in range(side) for y in range(side - 1)] + [(x * side + y, x * side + side + y) for x in range(side - 1) for y in range(side)]
    pairs += [(81, rng.randrange(81)) for _ in range(30)]
    part = dict(got(partition.balanced_parts(arcs(spark, pairs), spark.range(100), 4)))
    sizes = np.bincount(list(part.values()), minlength=4)
    assert len(part) == 100 and sizes.min() >= 24 and sizes.max() <= 26
    assert undirected_cut(pairs, part) < 0.6 * undirected_cut(pairs, {i: i * 2654435761 % 2**32 % 4 for i in part})
    new = got(partition.relabelled(spark.createDataFrame(sorted(part.items()), "id bigint, part bigint")))
    assert sorted(r[2] for r in new) == list(range(100)) and [r[1] for r in sorted(new, key=lambda r: r[2])] == sorted(part.values())


def test_push_holds_few_nodes_and_bounds_its_error(spark):
    rng = np.random.default_rng(4)
    n, c = 60, 0.15
    pairs = sorted({(int(i), int(j)) for i, j in rng.integers(0, n, (200, 2)) if i != j and i > 4})  # 0 to 4 may be sinks
    step = np.zeros((n, n))
    for i, j in pairs:
        step[i, j] = 1
    step /= np.maximum(step.sum(1, keepdims=True), 1)
    true = c * np.linalg.inv(np.eye(n) - (1 - c) * step)
    for epsilon in (3e-2, 5e-3):
        p, r, held = np.zeros((n, n)), np.zeros((n, n)), 0
        for row in spread.ppr_push(arcs(spark, pairs), spark.range(n), c, epsilon).collect():
            p[row["source"], row["node"]], r[row["source"], row["node"]] = row["p"], row["r"]
            held += 1
        assert np.allclose(true, p + r @ true / c * c, atol=1e-9)  # what is missing is the residuals' own rank
        assert (true - p <= r.sum(1, keepdims=True) + 1e-12).all() and (p <= true + 1e-12).all()
        assert held < n * min(n, 1 / (c * epsilon))
    top = spread.ppr_topk(arcs(spark, pairs), spark.range(0, n, 7), 3, c, 5e-3).collect()
    for row in top:
        order = np.sort(np.delete(true[row["src"]], row["src"]))[::-1]
        assert true[row["src"], row["dst"]] >= order[row["rank"] - 1] - row["residual"] - 1e-9


def test_memory_of_a_task_does_not_follow_the_number_of_edges(spark, monkeypatch):
    from plexus.operators import edges as E

    monkeypatch.setattr(E, "TASK_ROWS", 100)
    pairs = [(i % 37, i * 7 % 41) for i in range(1000)] + [(5, 5), (5, 5)]
    raw = spark.createDataFrame(pairs, "src bigint, dst bigint")
    once, both = E.distinct_pairs(raw), E.bidirect(raw)
    # As many tasks as rows ask for, and no distinct over both directions.
    assert once.rdd.getNumPartitions() == 11 and both.rdd.getNumPartitions() == 11
    assert sorted(map(tuple, once.collect())) == sorted(set(pairs))
    assert sorted(map(tuple, both.collect())) == sorted({p for a, b in pairs for p in ((a, b), (b, a))})


def test_walks_of_two_edges_are_not_rows(spark, monkeypatch):
    from plexus.operators import edges as E

    monkeypatch.setattr(E, "SIDE", 16)
    pairs = {(i * 5 % 61, i * 11 % 67) for i in range(400)} | {(70, 3), (100, 70)}
    want = {(a, d) for a, b in pairs for c, d in pairs if b == c}
    got = E.edge_power(spark.createDataFrame(sorted(pairs) * 2, "src bigint, dst bigint"), 2)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    third = {(a, d) for a, b in want for c, d in pairs if b == c}
    assert sorted(map(tuple, E.edge_power(spark.createDataFrame(sorted(pairs), "src bigint, dst bigint"), 3).collect())) == sorted(third)
    assert "MapInArrow" in got._jdf.queryExecution().toString() and "SortMergeJoin" not in got._jdf.queryExecution().toString()


def test_votes_of_labels_are_dealt_by_their_number(spark, monkeypatch):
    plans, cut = [], spread.cut
    monkeypatch.setattr(spread, "TASK_ROWS", 100)
    monkeypatch.setattr(spread, "cut", lambda df, what: plans.append((what, df._jdf.queryExecution().toString())) or cut(df, what))
    pairs = [(i % 37, i * 7 % 41) for i in range(400)]
    near = {(a, b) for p in pairs for a, b in (p, p[::-1]) if a != b}
    part = {i: i for i in range(41)}
    for r in spread.partition_relabel(arcs(spark, pairs), spark.range(41), 1).collect():
        votes = [part[a] for a, b in near if b == r["id"]]
        assert r["part"] == min(votes, key=lambda v: (-votes.count(v), v))
    dealt = [p for what, p in plans if what == "parts"]
    assert dealt and all("hashpartitioning(dst#" in p and f", {-(-len(near) // 100)}), REPARTITION_BY_NUM" in p for p in dealt)


def test_matching_and_moves_sort_no_edges_and_agree_on_few_and_many_rows(spark, monkeypatch):
    plans, write = {}, partition.cut

    def seen(df, what):
        plans.setdefault(what, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, what)

    rng = random.Random(11)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(200)]
    near, nodes = partition.undirected(arcs(spark, pairs)), spark.range(60).selectExpr("id", "1L AS w")
    monkeypatch.setattr(partition, "cut", seen)
    names = got(partition.matching(near, nodes, 4.0))
    assert len(names) == 60 and "Sort" not in plans["asked"][0]  # neither for joins nor to aggregate
    parts = spark.range(60).selectExpr("id", "id % 4 AS part")
    few = got(partition.refined(near, nodes, parts, 4, 13, 17))
    assert "rows" not in plans and sum("parts" == w for w in plans) == 1
    monkeypatch.setattr(partition, "TASK_ROWS", 0)
    monkeypatch.setattr(partition, "MANY", 0)
    assert got(partition.refined(near, nodes, parts, 4, 13, 17)) == few and few != got(parts)
    assert got(partition.matching(near, nodes, 4.0)) == names
    assert "ShuffledHashJoin" in plans["pulls"][-1] and "SortMergeJoin" not in plans["pulls"][-1]
