"""Repeated rows, extreme identifiers and clashing column names; whole queries by brute force."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plexus.llm import bpe, dedup, mixing, near, sharding, toxicity, wordpiece

LOW, HIGH = -(2**63), 2**63 - 1


def save(spark, folder, rows, columns="doc_id bigint, text string, lang string, source string"):
    spark.createDataFrame(rows, columns).write.parquet(f"file://{folder}/documents.parquet")
    return f"file://{folder}"


def squeeze(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_dedup_query_by_brute_force(spark, tmp_path):
    rows = [(LOW, "a b"), (HIGH, "ab"), (None, "a  b"), (None, None), (5, None), (5, ""), (7, "x"), (7, "y"), (8, "é é"), (9, "éé "), (HIGH, "z"), (None, "z"), (3, "w"), (3, "w"), (3, "w")]
    folder = save(spark, tmp_path, [(i, t, "en", "s") for i, t in rows])
    got = dedup.op2_exact_dedup(spark, folder).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(squeeze(t), []).append((-len(t or ""), i is None, i or 0))
    want = Counter()
    for key, g in groups.items():
        best = min(g)
        for n, (_, none, i) in enumerate(sorted(g)):
            want[None if none else i, None if best[1] else best[2], len(g), n == 0, hashlib.sha256(key.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want
    left = dedup.stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()
    assert sorted(squeeze(r["text"]) for r in left) == sorted(groups)


def test_the_state_goes_on_and_points_at_contents(spark, tmp_path):
    feed, kept = f"file://{tmp_path}/feed", f"file://{tmp_path}/state"
    part = lambda rows: spark.createDataFrame(rows, "digest binary, none boolean, id bigint, n_points bigint, file string, row bigint").write.mode("append").parquet(feed)
    part([(b"a", False, 9, 1, "f", 0), (b"b", False, 4, 1, "f", 1)])
    assert {bytes(r["digest"]): r["keep"] for r in dedup.absorb(spark, feed, kept).collect()} == {b"a": 9, b"b": 4}
    part([(b"a", False, 3, 1, "g", 0), (b"b", True, 0, 5, "g", 7)])
    got = {bytes(r["digest"]): (r["group_size"], r["none"], r["keep"], r["file"], r["row"]) for r in dedup.absorb(spark, feed, kept, 1).collect()}
    assert got == {b"a": (2, False, 3, "g", 0), b"b": (2, True, 0, "g", 7)}


def clashing(spark):
    rows = [(i, t, "en", f"s{i % 2}", 100 + i, 200 + i, 300, 400, 500, 600) for i, t in enumerate(("one two three four five six", "one two three four five six ", "seven", None, ""))]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, _id bigint, _n bigint, _k bigint, _c bigint, h bigint, copies bigint")


@pytest.mark.parametrize("stage", [dedup.stage, near.stage, mixing.stage])
def test_stages_keep_columns_of_any_name(spark, stage):
    d = clashing(spark)
    whole = {r["doc_id"]: r for r in d.collect()}
    left = stage(spark, d, "")
    assert left.columns == d.columns
    found = left.collect()
    assert found and all(r == whole[r["doc_id"]] for r in found)


def test_toxicity_stage_keeps_columns(spark, tmp_path):
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    d = clashing(spark).withColumn("score", F.lit(7)).withColumn("_score", F.lit(8))
    assert sorted(toxicity.stage(spark, d, f"file://{tmp_path}").collect(), key=str) == sorted(d.collect(), key=str)


def test_mixing_query_by_brute_force(spark, tmp_path):
    texts = ["w " * (1 + i * 7 % 40) for i in range(500)] + [None, "", "one"]
    rows = [(i, t, "en", [None, "b", "a", "c"][i % 4]) for i, t in enumerate(texts)] + [(1000, "rep " * 9, "en", "a")] * 700 + [(1001, "rep " * 3, "en", s) for s in ("a", "b")]
    folder = save(spark, tmp_path, rows)
    got = mixing.op5_mixing(spark, folder).collect()
    words = lambda t: len((t or "").split())
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, words(t)) for i, t, _, _ in rows)
    size = Counter()
    for _, t, _, s in rows:
        size[s] += words(t)
    left, open_, aim = sum(size.values()) * 1.5, ["a", "b", "c", None], {}
    weight = dict(zip(open_, (3, 1, 2, 3)))
    while open_:
        per = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if per * weight[s] > 2 * size[s]]
        for s in full or open_:
            aim[s] = 2 * size[s] if full else per * weight[s]
        left -= sum(aim[s] for s in full)
        open_ = [s for s in open_ if s not in full] if full else []
    for s in size:
        own = [r for r in got if r["source_size"] == size[s] and abs(r["target"] - aim[s]) < 1e-6]
        assert abs(sum(r["taken"] for r in own) - aim[s]) <= 40, s
    # Pivotal rounding: every document is taken floor or ceiling of its due, in whole copies.
    for r in got:
        if r["size"]:
            due = r["target"] / r["source_size"]
            assert r["taken"] % r["size"] == 0 and int(due) <= r["taken"] // r["size"] <= int(due) + (due % 1 > 0)
    again = mixing.op5_mixing(spark, folder).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    whole, due = spark.read.parquet(f"{folder}/documents.parquet"), Counter()
    for r in mixing.mix(whole).collect():
        due[r["doc_id"], r["source"]] += r["copies"]
    assert Counter((r["doc_id"], r["source"]) for r in mixing.stage(spark, whole, folder).collect()) == +due


def test_mixing_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr("plexus.functions.ranks.running.__defaults__", (50,))
    names = [f"h{i:04d}" for i in range(400)]
    d = spark.createDataFrame([(i, "w " * (1 + i % 9), s) for i, s in enumerate(names)], "doc_id bigint, text string, source string")
    got = {r["source"]: (r["source_size"], r["target"]) for r in mixing.mix(d).collect()}
    total = sum(n for n, _ in got.values()) * 1.5
    assert abs(sum(t for _, t in got.values()) - total) < 1e-6
    low = [t / (3, 1, 2)[k % 3] for k, s in enumerate(names) for n, t in [got[s]] if t < 2 * n]
    assert max(low) - min(low) < 1e-9 and all(t <= 2 * n for n, t in got.values())


def test_sharding_query_by_brute_force(spark, tmp_path):
    rows = [(i, t, "en", "s") for i, t in enumerate(["", None, "é", "long " * 5000, *[f"t{i}" for i in range(300)]])] + [(77, "again", "en", "s")] * 3000 + [(None, "x", "en", "s")] * 4
    folder = save(spark, tmp_path, rows)
    got = sharding.op6_sharding(spark, folder).collect()
    data = lambda t: (t or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(data(t)) + 8, zlib.crc32(data(t))) for i, t, _, _ in rows)
    assert {r["law"] for r in got} == {"key"} and all(r["grown_shard"] in (r["shard"], 24) for r in got)
    assert all(len({(r["shard"], r["grown_shard"]) for r in got if r["doc_id"] == i}) == 1 for i in (77, None))
    for s in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_token_counts_query_by_brute_force(spark, tmp_path):
    texts = [None, "", " ", "the cat", "unbelievable unbelievable", "Ünïcode \u4e2d\u6587 words", "x" * 3000, "a\tb\nc"]
    folder = save(spark, tmp_path, [(i, t, "en", "s") for i, t in enumerate(texts)])
    first, more = wordpiece.read_vocabulary(wordpiece.default_vocabulary())
    first, more, letters = set(first), set(more), bpe.byte_alphabet()
    want = {}
    for i, t in enumerate(texts):
        n = unknown = 0
        words = (t or "").encode().split()
        for w in words:
            s, at, k = "".join(letters[b] for b in w), 0, 0
            while at < len(s):
                j = next((j for j in range(min(len(s), at + 150), at, -1) if s[at:j] in (more if at else first)), 0)
                if not j:
                    k = 0
                    break
                at, k = j, k + 1
            n, unknown = n + max(k, 1), unknown + (k == 0)
        want[i] = (len(words), n, unknown)
    assert {r["doc_id"]: (r["n_words"], r["n_tokens"], r["n_unknown"]) for r in wordpiece.op4_token_counts(spark, folder).collect()} == want
