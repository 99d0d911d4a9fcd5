"""Queries and operators that must read all of their input, against brute force."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexus import catalog
from plexus.operators import edges, spread
from plexus.session import table
from plexus.sources import graphs as G


def test_laplacian_vectors_span_the_true_ones(spark):
    rng = np.random.default_rng(2)
    pairs = sorted({(int(i), int(j)) for i, j in rng.integers(0, 60, (150, 2)) if i != j} | {(i, i + 1) for i in range(59)})
    out = {r["id"]: r["pe"] for r in spread.laplacian_encoding(spark.createDataFrame(pairs, "src bigint, dst bigint"), spark.range(60), 2).collect()}
    a = np.eye(60)
    for i, j in pairs:
        a[i, j] = a[j, i] = 1
    d = a.sum(0)
    _, vectors = np.linalg.eigh(np.eye(60) - a / np.sqrt(np.outer(d, d)))
    got = np.linalg.qr(np.array([out[i] for i in range(60)]))[0]
    assert np.linalg.svd(got.T @ vectors[:, 1:3])[1].min() > 1 - 1e-6


SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@tables
def test_parts_come_from_the_whole_item_graph(spark):
    near = {}
    for i, j in G.item_edges(spark, SF).collect():
        near.setdefault(i, set()).add(j)
        near.setdefault(j, set()).add(i)
    part = {r["id"]: r["id"] for r in G.nodes(spark, SF).collect()}
    for _ in range(3):
        votes = {i: Counter(part[j] for j in near.get(i, ())) for i in part}
        part = {i: min(v, key=lambda p: (-v[p], p)) if v else part[i] for i, v in votes.items()}
    assert {r["id"]: r["part"] for r in catalog.QUERIES["partition_relabel"](spark, SF).collect()} == part


@tables
def test_components_of_all_purchases(spark):
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for i, j in G.purchase_edges(spark, SF).collect():
        p, q = find(i), find(j)
        root[max(p, q)] = min(p, q)
    assert dict(map(tuple, catalog.QUERIES["components"](spark, SF).collect())) == {v: find(v) for v in root}


@tables
def test_runs_are_folded_and_searched_to_their_end(spark):
    runs = {}
    for r in sorted(table(spark, SF, "events").collect(), key=lambda r: r["event_id"]):
        runs.setdefault(r["event_type"], []).append(float(r["value"]))
    assert min(map(len, runs.values())) > 20
    ema = dict(map(tuple, catalog.QUERIES["ema_loss"](spark, SF).collect()))
    best = {r["run"]: (r["epoch"], r["test"]) for r in catalog.QUERIES["best_by_val"](spark, SF).collect()}
    for run, losses in runs.items():
        e = losses[0]
        for v in losses[1:]:
            e = e * 0.9 + v * 0.1
        i = max(range(len(losses)), key=lambda i: (losses[i] // 20, -i))
        assert ema[run] == pytest.approx(e, rel=1e-9) and best[run] == (i + 1, losses[i])
    assert ema.keys() == best.keys() == runs.keys()


@tables
def test_every_row_is_normalised(spark):
    rows = {r["id"]: r["x"] for r in G.nodes(spark, SF).collect()}
    got = dict(map(tuple, catalog.QUERIES["row_l1_norm"](spark, SF).collect()))
    assert got.keys() == rows.keys() and all(got[i] == pytest.approx(np.log(sum(map(abs, x)) / abs(sum(x))), abs=1e-5) for i, x in rows.items())
    zero = spark.createDataFrame([(1, [1.0, -1.0]), (2, [1.0, 3.0])], "id bigint, x array<double>")
    assert {r["id"]: r["x"] for r in edges.row_normalised(zero).collect()} == {1: [0.0, 0.0], 2: [0.25, 0.75]}


def test_page_rank_settles(spark):
    rng = np.random.default_rng(3)
    n = 40
    pairs = sorted({(int(i), int(j)) for i, j in rng.integers(0, n, (160, 2)) if i != j} | {(i, (i + 1) % n) for i in range(n)})
    rows = spread.ppr_topk(spark.createDataFrame(pairs, "src bigint, dst bigint"), spark.range(0, n, 5), 4, epsilon=2e-4).collect()
    got, short = {(r["src"], r["rank"]): r["dst"] for r in rows}, {r["src"]: r["residual"] for r in rows}
    step = np.zeros((n, n))
    for i, j in pairs:
        step[i, j] = 1
    step /= step.sum(1, keepdims=True)
    for s in range(0, n, 5):
        r = np.linalg.solve(np.eye(n) - 0.85 * step.T, 0.15 * np.eye(n)[s])
        r[s] = -1
        order = np.argsort(-r, kind="stable")
        assert short[s] < 0.04
        for k in range(4):
            # What is found at a rank falls short of the true one by the residual at most.
            assert r[got[s, k + 1]] >= r[order[k]] - short[s] - 1e-8
            if k and r[order[k - 1]] - r[order[k]] > short[s] + 1e-8:
                assert {got[s, i + 1] for i in range(k)} == set(order[:k].tolist())


def favor(x, fixed):
    """Linear attention of x to itself by positive random features, both sides scaled by width ** -1/4."""
    width = x.shape[1]
    u = x / width**0.25 @ fixed.T
    h = (x**2).sum(1, keepdims=True) / (2 * width**0.5)
    q, k = np.exp(u - h - u.max(1, keepdims=True)) + 1e-4, np.exp(u - h - u.max()) + 1e-4
    return (q @ (k.T @ x)) / (q @ k.sum(0))[:, None]


@tables
def test_random_features_give_the_attention_of_their_formula(spark):
    rows = G.nodes(spark, SF).collect()
    x = np.array([r["x"] for r in rows])
    fixed = np.sin(1.0 + 7.0 * np.arange(8)[:, None] + 3.0 * np.arange(64)[None, :])
    want = favor(x, fixed)
    got = {(r["id"], r["dim"]): r["v"] for r in catalog.QUERIES["favor_attention"](spark, SF).collect()}
    assert len(got) == x.size and all(got[r["id"], d] == pytest.approx(want[i, d], abs=2e-5) for i, r in enumerate(rows) for d in range(64))


def test_pairs_of_batches_are_dealt_by_their_number_and_edges_pass_unsorted(spark, monkeypatch):
    plans, write, bound = {}, spread.cut, "spark.sql.autoBroadcastJoinThreshold"

    def seen(df, what):
        plans[what] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, what)

    monkeypatch.setattr(spread, "cut", seen)
    monkeypatch.setattr(spread, "TASK_ROWS", 100)
    pairs = [(i, (7 * i + j) % 90) for i in range(90) for j in range(1, 4)]
    spark.conf.set(bound, "-1")
    try:
        bins = spread.spd_bins(spark.createDataFrame(pairs, "src bigint, dst bigint"), spark.range(90).selectExpr("id", "id div 30 AS batch"), 3)
        rows = bins.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset(bound)
    step = np.zeros((90, 90), dtype=int)
    for a, b in pairs:
        if a != b and a // 30 == b // 30:
            step[a, b] = step[b, a] = 1
    want = np.where(np.eye(90), 0, np.where(step, 1, np.where(step @ step, 2, 3)))
    assert {(r["src"], r["dst"]): r["bin"] for r in rows} == {(a, b): want[a, b] for a in range(90) for b in range(90) if a // 30 == b // 30}
    assert max(Counter(r["task"] for r in rows).values()) < 250  # of 2,700 pairs
    assert "SortMergeJoin" not in plans["inside"]
