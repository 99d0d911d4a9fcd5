"""Edge cases and brute force for the operators of the llm package."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexus.llm import bpe, chat, dedup, flac, langid, mixing, near, sharding, toxicity, wordpiece

TEXTS = [None, "", " \n\t", "a", "a b c", "a  b\nc", "word " * 3000, "Éa ñ <|endoftext|> ok", "same text here now", "same text here now"]


def docs(spark, texts=TEXTS):
    rows = [(i, t, None if i % 4 == 0 else f"s{i % 3}", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string")


def none(spark):
    return docs(spark).where(F.lit(False))


def plain(t):
    return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")


def dedup_result(rows, *how):
    return {r["id"]: (r["keep"], r["group_size"]) for r in dedup.decide(dedup.stored(rows)[0], *how).collect()}


def test_exact_dedup_by_brute_force(spark):
    groups = {}
    for i, t in enumerate(TEXTS):
        groups.setdefault(plain(t), []).append((-len(t or ""), i))
    assert dedup_result(docs(spark)) == {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}


def test_exact_dedup_with_colliding_digests(spark):
    texts = [f"t{i % 5}" for i in range(15)]
    weak = lambda t, g: F.lit("one") if g == 0 else F.concat(F.lit(str(g)), F.substring(t, 2, 1))
    assert dedup_result(docs(spark, texts), weak) == {i: (i % 5, 3) for i in range(15)}


def test_near_dedup_by_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(n)] for n in (3, 12, 60, 300, 1500)]
    texts = [None, "", "one two"]
    for words in base:
        for cut in range(6):
            w = list(words)
            for _ in range(cut * len(w) // 60):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert near_result(spark, docs(spark, texts)) == {i: (len(s), comp[i]) for i, s in enumerate(sets)}


def near_result(spark, rows):
    """{doc_id: (n_shingles, component)} of shingles of four words."""
    found = near.classes(rows, 4).select(near.number("id").alias("id"), "n_shingles", near.number("component").alias("c"))
    return {r["id"]: (r["n_shingles"], r["c"]) for r in found.collect()}


def components_by_force(sets):
    comp = list(range(len(sets)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = root(i), root(j)
                comp[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("kind", ["template", "pool"])
def test_near_groups_around_the_threshold(spark, kind, monkeypatch):
    """Hundreds of texts that share bands and are partly linked; none of their links is lost."""
    rng = random.Random(9)
    monkeypatch.setattr(near, "BLOCK", 50)
    texts = []
    for i in range(240):
        if kind == "template":  # one part in common, own parts of different lengths, some copied from another text
            own = [f"u{i}x{j}" for j in range(rng.choice((10, 20, 26, 30)))]
            other = texts[rng.randrange(len(texts))].split()[180:] if texts and rng.random() < 0.3 else []
            texts.append(" ".join([f"t{k}" for k in range(180)] + own + other[:25]))
        else:  # shares of one pool, so that rare members are held by many
            texts.append(" ".join(f"p{k} q{k} r{k} s{k}" for k in range(60) if rng.random() < 0.93))
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)})
    want = components_by_force(sets)
    assert 1 < len(set(want)) < len(want)
    assert near_result(spark, docs(spark, texts)) == {i: (len(s), want[i]) for i, s in enumerate(sets)}


def test_near_blocks_give_exact_intersections():
    rng = np.random.default_rng(0)
    a, b = ([np.unique(rng.integers(0, 60, n)) for n in rng.integers(1, 40, 12)] for _ in range(2))
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert near.common(a, b, width=7).tolist() == want


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_vocabulary())
    want = {}
    for i, t in enumerate(TEXTS):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in bpe.digests(docs(spark)).collect()} == want


def test_bpe_cuts_join_again():
    enc = bpe.Encoder()
    assert all("".join(enc.cut(w)) == w for w in ("abc", "Ã©x", "zzzÃ©" * 9))


def test_flac_round_trip_seek_and_damage():
    rng = random.Random(1)
    for p in (bytes(64), b"a" * 5000, bytes(rng.randrange(256) for _ in range(9000)), b"abc" * 4000):
        s = flac.encode([p])[0]
        blocks = flac.decode([s])[0]
        assert flac._flip(b"".join(b for _, b in blocks)) == p
        assert flac._flip(flac.seek(s, len(p) - 64, 64)) == p[-64:]
        bad = bytearray(s)
        bad[-1] ^= 1
        with pytest.raises(flac.Damaged):
            flac.decode([bytes(bad)])


def test_flac_rows(spark):
    got = {r["doc_id"]: r for r in flac.summarised(flac.store(docs(spark))).collect()}
    for i, t in enumerate(TEXTS):
        p = flac.payload((t or "").encode())
        assert (got[i]["payload_sha256"], got[i]["payload_bytes"], got[i]["tail_crc32"]) == (hashlib.sha256(p).hexdigest(), len(p), zlib.crc32(p[-64:]))
    assert got[8]["media_sha256"] == got[9]["media_sha256"]


def test_automaton_equals_greedy_search():
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abc") for _ in range(rng.randrange(1, n)))
    for _ in range(300):
        first, more = {word(5) for _ in range(6)}, {word(5) for _ in range(6)}
        machine = wordpiece.Automaton(first, more)
        for _ in range(10):
            w, i, n = word(12), 0, 0
            while i < len(w):
                j = next((j for j in range(len(w), i, -1) if w[i:j] in (first if i == 0 else more)), 0)
                if not j:
                    n = 0
                    break
                i, n = j, n + 1
            assert machine.count(w) == n


def test_mixing_keeps_to_targets(spark):
    texts = ["w " * (1 + i % 40) for i in range(600)] + [None, ""]
    got = mixing.mix(docs(spark, texts)).collect()
    assert len(got) == len(texts)
    for s in {r["source"] for r in got}:
        rows = [r for r in got if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in rows) - rows[0]["target"]) <= max(r["size"] for r in rows) + 1e-6
        assert all(0 <= r["copies"] <= 2 for r in rows)
    again = {(r["doc_id"], r["copies"]) for r in mixing.mix(docs(spark, texts)).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in got}


def test_sharding_moves_only_into_the_new_shard(spark):
    d = spark.range(5000).select(F.col("id").alias("doc_id"), sharding.shard_of(F.col("id"), [1.0, 2.0, 1.0]).alias("a"), sharding.shard_of(F.col("id"), [1.0, 2.0, 1.0, 1.0]).alias("b"))
    rows = d.collect()
    assert all(r["a"] == r["b"] or r["b"] == 3 for r in rows)
    assert 2200 < sum(r["a"] == 1 for r in rows) < 2800
    numbered = sharding.slots(d, "a", ["doc_id"]).collect()
    for s in range(3):
        own = sorted(r["slot"] for r in numbered if r["a"] == s)
        assert own == list(range(len(own)))


def test_chat_layouts_and_escapes(spark):
    rows = ['{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}', '{"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}', '{"prompt": "hi", "completion": "yo"}', '{"instruction": "hi", "output": "yo"}', '{"what": 1}', "{", None]
    got = [r["turns"] for r in chat.canonical_turns(spark.createDataFrame([(r,) for r in rows], "record string")).collect()]
    assert [[tuple(t) for t in g] if g else None for g in got] == [[("user", "hi"), ("assistant", "yo")]] * 4 + [None] * 3
    texts = ["", "\\", "<|im_end|>\n", "\\<|", "<|im_start|>assistant\nx", None, "a\\|b" * 50]
    turns = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user\n", t) for i, t in enumerate(texts)], "conv_id bigint, turn bigint, role string, text string")
    back = chat.read_back(chat.formatted(turns)).first()
    assert [t["text"] for t in back["turns"]] == [t or "" for t in texts]
    assert back["turns"][0]["role"] == "user\n"
    assert back["learned"] == [t or "" for t in texts[1::2]]


def test_models_on_small_tables(spark):
    assert toxicity.fit([]) is None and langid.fit([]) is None
    rng = random.Random(3)
    words = [["the", "and", "of", "thing"], ["der", "und", "die", "nicht"]]
    rows = [(" ".join(rng.choice(words[k]) for _ in range(40)), "en de".split()[k]) for k in (0, 1) for _ in range(20)]
    tag = langid.Tagger(langid.fit(rows))
    assert tag.texts(["the thing of and", "und nicht die", None, "12 !", ""])[0] == ["en", "de", "und", "und", "und"]


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(5)
    e, moves, start = rng.random((1, 4, 3)) + 0.1, rng.random((3, 3)) + 0.1, rng.random(3) + 0.1
    p, _, _ = langid.forward_backward(e, np.ones((1, 4), bool), moves, start)
    want = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        w = start[path[0]] * np.prod([e[0, i, k] for i, k in enumerate(path)]) * np.prod([moves[a, b] for a, b in zip(path, path[1:])])
        for i, k in enumerate(path):
            want[i, k] += w
    assert np.allclose(p[0], want / want.sum(1, keepdims=True))


def test_empty_tables(spark):
    d = none(spark)
    assert dedup.decide(dedup.stored(d)[0]).count() == 0
    assert near.classes(d).count() == 0
    assert bpe.digests(d).count() == 0
    assert wordpiece.token_counts(d).count() == 0
    assert mixing.mix(d).count() == 0
    assert flac.summarised(flac.store(d)).count() == 0
