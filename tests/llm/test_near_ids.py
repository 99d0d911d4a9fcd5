"""Near-duplicates where identifiers are null or repeat."""

import random

from plexus.llm import near


def texts(n):
    rng = random.Random(6)
    return [" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(n)]


def altered(t):
    return t.rsplit(" ", 1)[0] + " other"


def test_rows_of_null_and_repeated_ids_are_texts_of_their_own(spark, tmp_path):
    a, b, c, d, e = texts(5)
    rows = [(3, b), (50, c), (None, a), (None, altered(b)), (None, altered(c)), (7, d), (7, e), (None, a), (None, a.upper()), (8, altered(e)), (None, None), (None, " "), (9, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, source string")
    left = [(r["doc_id"], r["text"]) for r in near.stage(spark, docs, "").collect()]
    want = [(3, b), (50, c), (7, d), (7, e), (None, None), (None, " "), (9, "")]
    none = [r for r in left if r[0] is None and r[1] and r[1].lower() == a]
    assert len(none) == 1
    left.remove(none[0])
    assert sorted(left, key=str) == sorted(want, key=str)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = near.op8_near_dedup(spark, f"file://{tmp_path}").collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == 8
    per = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got if r["n_shingles"])
    assert per == sorted([("3", "3", True), ("50", "50", True), ("None", "None", True), ("None", "3", False), ("None", "50", False), ("7", "7", True), ("7", "7", True), ("None", "None", False), ("None", "None", False), ("8", "7", False)])


def test_extreme_ids_are_told_apart_from_null(spark, tmp_path):
    a, b = texts(2)
    low, high = -(2**63), 2**63 - 1
    rows = [(low, a), (high, altered(a)), (high, b), (None, altered(b)), (None, None), (0, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near.op8_near_dedup(spark, f"file://{tmp_path}").collect()}
    assert got == {(low, low, True), (high, low, False), (high, high, True), (None, high, False), (None, None, True), (0, 0, True)}
