"""Splits of folders in every layout, and prepared data sets written and read back."""

import numpy as np
import pytest

from plexus.operators import attend, batches
from plexus.plans.budget import arbitrated_choice
from plexus.sources import splits as P


def got(df):
    return sorted(map(tuple, df.collect()))


def test_layouts_are_taken_in_their_order(spark, tmp_path):
    d, want = str(tmp_path), [("test", 2), ("train", 0), ("train", 3), ("valid", 1)]
    assert P.resolve_split(spark, d) is None
    (tmp_path / "role.json").write_text('{"tr": [5], "va": [6], "test": [7]}')
    assert got(P.resolve_split(spark, d)) == [("test", 7), ("train", 5), ("valid", 6)]
    for name, mask in (("train", [1, 0, 0, 1]), ("val", [0, 1, 0, 0]), ("test", [0, 0, 1, 0])):
        np.save(tmp_path / f"{name}_mask.npy", np.stack([np.zeros(4, bool), np.array(mask, bool)], 1))
    assert got(P.resolve_split(spark, d, 1)) == want and got(P.resolve_split(spark, d, 0)) == []
    with pytest.raises(ValueError):
        P.resolve_split(spark, d, 2)
    for name, ids in (("train", [8]), ("valid", [9, 10]), ("test", [11])):
        np.save(tmp_path / f"{name}_idx.npy", np.array(ids))
    assert got(P.resolve_split(spark, d)) == [("test", 11), ("train", 8), ("valid", 9), ("valid", 10)]
    spark.createDataFrame([("train", 1)], "part string, id bigint").write.parquet(f"{d}/split_idx.parquet")
    assert len(got(P.resolve_split(spark, d))) == 4  # a table without all parts is passed over
    many = spark.createDataFrame([(0, "train", 0), (1, "train", 0), (1, "train", 3), (1, "val", 1), (1, "test", 2)], "split_id int, part string, id bigint")
    nodes, edges = spark.range(4).selectExpr("id", "array(1.0D) AS x", "id AS y"), spark.createDataFrame([(0, 1)], "src bigint, dst bigint")
    P.write_graph(nodes, edges, many, d)
    assert got(P.resolve_split(spark, d, 1)) == want
    with pytest.raises(ValueError):
        P.resolve_split(spark, d, 2)


def test_sinks_and_labels(spark, tmp_path):
    P.write_stats(spark.createDataFrame([(1, 0.5)], "hop int, ratio double"), str(tmp_path), "m", "d", "t", 7)
    assert got(spark.read.json(f"{tmp_path}/m/d/t/latest.json")) == got(spark.read.json(f"{tmp_path}/m/d/t/epoch_0007.json")) == [(1, 0.5)]
    b = spark.createDataFrame([(0, 0, 5), (0, 1, 6)], "seq_id bigint, pos bigint, node_id bigint")
    P.write_batches(b, str(tmp_path), "s0")
    assert got(spark.read.parquet(f"{tmp_path}/data_s0.parquet")) == got(b)
    assert got(P.labels_of_one_hot(spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 1.0])], "row bigint, values array<double>"))) == [(0, 1), (1, 0)]


def test_edges_are_never_all_dropped(spark):
    e = spark.createDataFrame([(0, 1), (0, 1), (2, 3)], "src bigint, dst bigint")
    assert got(batches.edge_drop(e, 1.0)) == got(e) and got(batches.edge_drop(e.where("src > 9"), 0.5)) == []


def test_accuracy_decides_near_ties_at_the_ceiling(spark):
    rows = [(1, "a", 1.0, 0.995, 0.1, True), (1, "b", 1.0, 0.999, 0.9, True), (2, "a", 1.0, 0.5, 0.1, True), (2, "b", 1.0, 0.999, 0.9, True), (3, "a", 1.0, 0.995, 0.1, False), (3, "b", 1.0, 0.999, 0.9, False)]
    p = spark.createDataFrame(rows, "round int, kind string, base double, cand double, acc double, ceiling boolean")
    assert [r[:2] for r in got(arbitrated_choice(p))] == [(1, "b"), (2, "a"), (3, "a")]


def test_heads_with_edges_of_their_own(spark):
    n = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "id bigint, x array<double>")
    e = spark.createDataFrame([(0, 0, 1)], "head bigint, src bigint, dst bigint")
    eye = [[1.0, 0.0], [0.0, 1.0]]
    out = {(r["id"], r["head"]): r["out"][0] for r in attend.multi_head(e, n, 2, eye, eye, eye).collect()}
    assert out[1, 0] == pytest.approx(1, abs=1e-5) and out[1, 1] == out[0, 0] == out[0, 1] == 0


def test_an_operator_of_one_edge_table_takes_lists(spark):
    one, two = (spark.createDataFrame([p], "src bigint, dst bigint") for p in ((0, 1), (2, 3)))
    flipped = batches.lift(lambda e: e.selectExpr("dst AS src", "src AS dst"), [one, two])
    assert [got(e) for e in flipped] == [[(1, 0)], [(3, 2)]]
    assert got(batches.lift(lambda e: e.where("src > 0"), one)) == []
