"""Rows made by queries, clashing names, empty tables, and blocks of decoded samples."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plexus.llm import bpe, catalog, chat, dedup, flac, mixing, wordpiece


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('made')}/d.parquet"
    spark.createDataFrame([(1, "a b"), (2, "c"), (3, "ab")], "doc_id bigint, text string").write.parquet(path)
    return spark.read.parquet(path)


def test_dedup_of_rows_made_by_queries(spark, written):
    kept = lambda d: sorted((r["doc_id"], r["text"]) for r in dedup.stage(spark, d, "").collect())
    two = written.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2))))
    keys = spark.createDataFrame([(1,), (1,), (2,)], "doc_id bigint")
    want = [(1, "a b"), (2, "c")]
    assert kept(written) == kept(two) == kept(written.unionByName(written)) == kept(written.join(keys, "doc_id")) == want
    assert kept(written.where("doc_id > 1").select("text", "doc_id")) == [(2, "c"), (3, "ab")]
    assert dedup.scanned(written) and dedup.scanned(written.where("doc_id > 1").select("doc_id", F.upper("text").alias("text")))
    assert not any(map(dedup.scanned, (two, written.unionByName(written), written.join(keys, "doc_id"), written.where(F.rand() < 2), keys)))


def test_equal_hashes_of_one_kind_do_not_join_rows(spark, monkeypatch):
    # One of the two hashes alone is the same for all rows; the other still tells them apart.
    both = lambda d: F.struct(F.lit(1).cast("bigint").alias("a"), F.xxhash64("doc_id").alias("b"))
    monkeypatch.setattr(mixing, "row_hash", both)
    d = spark.createDataFrame([(i, "one two three", "s", 1) for i in range(40)], "doc_id bigint, text string, source string, n bigint")
    copies = mixing.mix(d, (1.0,), 150).collect()
    assert len(copies) == 40 and sum(r["copies"] for r in copies) in (59, 60, 61)
    taken = mixing.stage(spark, d, "").collect()
    assert len(taken) in (59, 60, 61) and {r["doc_id"] for r in taken} == set(range(40))


def test_names_that_clash(spark, written):
    d = written.selectExpr("*", "1 AS media", "2 AS n_bytes", "3 AS d", "4 AS ids", "5 AS c", "6 AS n_words", "7 AS decoded")
    assert {r["doc_id"]: r["n_bytes"] for r in flac.summarised(flac.store(d)).collect()} == {1: 3, 2: 1, 3: 2}
    assert {r["doc_id"]: r["n_tokens"] > 0 for r in bpe.digests(d).collect()} == {1: True, 2: True, 3: True}
    assert {r["doc_id"]: r["n_words"] for r in wordpiece.token_counts(d).collect()} == {1: 2, 2: 1, 3: 1}


def test_blocks_of_samples(spark):
    texts = ["x" * 10_000, "", None, "abc"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    blocks = {}
    for r in flac.pcm_blocks(flac.store(d)).collect():
        blocks.setdefault(r["doc_id"], []).append((r["block"], r["sample_offset"], bytes(r["pcm"])))
    for i, t in enumerate(texts):
        own = sorted(blocks[i])
        assert [b for b, _, _ in own] == list(range(len(own)))
        assert [o for _, o, _ in own] == [sum(len(p) for _, _, p in own[:k]) for k in range(len(own))]
        assert flac._flip(b"".join(p for _, _, p in own)) == flac.payload((t or "").encode())
    assert len(blocks[0]) > 1


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('empty')}"
    for name, kind in {
        "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
        "labels": "doc_id bigint, quality int, toxic int",
        "benchmark": "item_id bigint, text string",
        "conversations": "conv_id bigint, turn bigint, role string, text string",
        "embeddings": "vec_id bigint, embedding array<float>, label int",
    }.items():
        spark.createDataFrame([], kind).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", ["op6_sharding", "op11_decontamination", "op12_alignment", "op13_whitening"])
def test_queries_over_empty_tables(spark, empty, name):
    assert catalog.QUERIES[name](spark, empty).count() == 0


def test_chat_and_pipeline_over_empty_tables(spark, empty):
    assert [r["conv_id"] for r in chat.op3_chat(spark, empty).collect()] == [-1]
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_a_conversation_of_the_table_numbered_like_the_added_one(spark, tmp_path):
    spark.createDataFrame([(-1, 0, "user", "hi"), (2, 0, "user", "ho")], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    rows = chat.op3_chat(spark, f"file://{tmp_path}").collect()
    # The table's own one stays apart: two rows bear the number.
    assert sorted((r["conv_id"], r["n_turns"]) for r in rows) == [(-1, 1), (-1, 2), (2, 1)]
    assert {r["turns_sha256"] for r in rows if r["n_turns"] == 1} == {hashlib.sha256(f"user\n{t}\n".encode()).hexdigest() for t in ("hi", "ho")}
