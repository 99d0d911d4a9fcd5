"""Decontamination, token alignment and whitening against brute force."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from plexus.llm import align, decontam, whiten
from plexus.session import table

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def hits(docs, items, window=10):
    """(n_words, hit words, items) of each text by comparing every window at every place."""
    pats = [(str(i) if i is not None else None, tuple(w[a : a + min(window, len(w))])) for i, t in items for w in [lowered(t)] for a in range(max(1, len(w) - window + 1)) if w]
    out = []
    for text in docs:
        w, hit, found = lowered(text), set(), set()
        places = {}
        for n in {len(p) for _, p in pats}:
            for a in range(len(w) - n + 1):
                places.setdefault(tuple(w[a : a + n]), []).append(a)
        for item, p in pats:
            for a in places.get(p, ()):
                hit.update(range(a, a + len(p)))
                if item is not None:
                    found.add(item)
        out.append((len(w), hit, sorted(found)))
    return out


def search_fixture():
    rng = random.Random(4)
    vocab = ["a", "B", "the", "Of", "é9", "x2", "zz", "q"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice((" ", ", ", "\n", "--", "  ")) for _ in range(n))
    items = [(i, text(rng.choice((3, 9, 10, 11, 25, 40)))) for i in range(30)] + [(7, text(12)), (None, text(14)), (90, ""), (91, None), (92, "..."), (93, "q")]
    docs = [None, "", " .,", "q"]
    for i in range(60):
        t = text(rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            t += rng.choice([x for _, x in items if x]).upper() + " " + text(rng.randrange(5))
        docs.append(t)
    return docs + docs[4:8], items


def got_hits(rows):
    return [(r["n_words"], {p for s in r["spans"] for p in range(s["first"], s["last"] + 1)}, r["items"]) for r in rows]


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 300])
def test_search_finds_every_occurrence(spark, block_bytes):
    docs, items = search_fixture()
    d = spark.createDataFrame([(i if i % 9 else None, t, i, "x") for i, t in enumerate(docs)], "doc_id bigint, text string, items int, spans string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    d = d.withColumnRenamed("items", "row").drop("spans")
    rows = sorted(decontam.search(d, b, block_bytes=block_bytes).collect(), key=lambda r: r["row"])
    assert got_hits(rows) == hits(docs, items) and [r["doc_id"] for r in rows] == [i if i % 9 else None for i in range(len(docs))]
    assert all(a["last"] + 1 < b["first"] for r in rows for a, b in zip(r["spans"], r["spans"][1:]))


def test_long_texts_and_items_are_read_in_overlapping_runs(monkeypatch):
    docs, items = search_fixture()
    monkeypatch.setattr(decontam, "CHUNK", 40)
    whole = [(str(i), t.encode()) for i, t in items if t and i is not None]
    cut = [(i, b" ".join(held)) for i, t in whole for _, held in decontam.runs(t, 50, 9) if held]
    p = decontam.Patterns(cut, 10)
    for text, (n, hit, found) in zip(docs, hits(docs, [(i, t) for i, t in items if i is not None])):
        got = p.find(text.encode() if text is not None else None)
        assert (got[0], {x for a, b in got[1] for x in range(a, b + 1)}, got[2]) == (n, hit, found)


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    r = decontam.search(docs, none).first()
    assert (r["n_words"], r["spans"], r["items"]) == (3, [], [])
    assert decontam.search(docs.where("doc_id > 1"), none).count() == 0


# --- alignment


def aligned(texts, a_file=None):
    """The seven columns of every text by whole-text encoding and comparison of all byte ranges."""
    own = align.aligner(None)
    docs, counts = [], Counter()
    for t in texts:
        a = own.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = own.b.encode(t) if t else []
        same = all(b"".join(x[i] for i in ids) == (" " + t).encode() for x, ids in ((own.a_bytes, a), (own.b_bytes, b))) if t else False
        if not same:
            docs.append(None)
            continue
        ends = [np.cumsum([len(x[i]) for i in ids]).tolist() for x, ids in ((own.a_bytes, a), (own.b_bytes, b))]
        begins = [[0, *e[:-1]] for e in ends]
        links = [(i, j) for i in range(len(a)) for j in range(len(b)) if begins[0][i] < ends[1][j] and begins[1][j] < ends[0][i]]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        docs.append((a, b, ends, cuts, links))
        counts.update((a[i], b[j]) for i, j in links)
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, ends, cuts, links = d
        groups = []
        for lo, hi in zip([0, *cuts], cuts):
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, es) if lo < e <= hi) for ids, es in ((a, ends[0]), (b, ends[1]))))
        n = [counts[a[i], b[j]] for i, j in links]
        out.append((len(a), len(b), len(cuts), len(links), sum(counts[a[i], b[j]] == best[b[j]] for i, j in links), sum(n), ";".join(groups)))
    return out


def align_fixture():
    rng = random.Random(6)
    bits = ["the ", "Antidisestablishment", "ing", " ", "  ", "\n", "\t", "é", "ﬁ", "日本語", "🙂", "́", "<|endoftext|>", "<s>", "<0x41>", "'s", "'S ", "123456", "x", "\x1c", "\x85", " ", " ", "\x00", "don't", "...", "$$", "\r\n", "_"]
    texts = [None, "", " ", "  ", "\n", "a ", "a  ", " a", "a \n b", "▁", "a ▁b", "x" * 3000]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(250)]
    return texts + texts[20:30]


@pytest.mark.parametrize("most", [align.PAIRS, 40, 0])
def test_alignment_of_all_texts(spark, most):
    texts = align_fixture()
    docs = spark.createDataFrame([(i, None if i % 5 == 0 else i, t) for i, t in enumerate(texts)], "pair bigint, doc_id bigint, text string").repartition(3)
    counts = align.pair_counts(docs)
    want = aligned(texts)
    rows = sorted(align.align(docs, counts, most=most).collect(), key=lambda r: r["pair"])
    assert [tuple(r[c] for c in (*align.STATS, "groups")) for r in rows] == want
    assert [r["doc_id"] for r in rows] == [None if i % 5 == 0 else i for i in range(len(texts))]
    short = sorted(align.align(docs, counts, most=most, whole=False).collect(), key=lambda r: r["pair"])
    assert [r["groups"] for r in short] == [hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "" for w in want]


def test_long_texts_come_in_runs_and_the_memo_starts_anew(monkeypatch):
    texts = [t for t in align_fixture() if t]
    long = [" ".join(texts[i::7]).replace("▁", "") for i in range(7)] + [" ".join(texts)]  # the last one is not given back
    texts = texts[:60] + long
    monkeypatch.setattr(align, "CHUNK", 300)
    monkeypatch.setattr(align, "MEMO", 50)
    own = align.aligner(None)
    own.clear()
    c = align.Counts(own)
    frames = [*c.texts(texts[:30]), *c.texts(texts[30:]), c.flush()]
    sums = Counter()
    for f in frames:
        for p, n in zip(f["pair"], f["n"]):
            sums[p] += int(n)
    pairs = np.array(sorted(sums))
    best = Counter()
    for p, n in sums.items():
        best[p & 0xFFFFFFFF] = max(best[p & 0xFFFFFFFF], n)
    s = align.Scores(own, pairs, np.array([sums[p] for p in pairs.tolist()]), np.array([int(sums[p] == best[p & 0xFFFFFFFF]) for p in pairs.tolist()]))
    got = s.texts(texts, True)
    own.clear()
    assert [tuple(r) for r in got[[*align.STATS, "groups"]].itertuples(index=False)] == aligned(texts)


def test_alignment_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert align.align(none, align.pair_counts(none)).count() == 0
    blank = spark.createDataFrame([(None, None), (1, "")], "doc_id bigint, text string")
    assert [tuple(r)[1:] for r in align.align(blank, align.pair_counts(blank)).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


# --- whitening


def white(rows, most=32):
    """Exact moments by fractions; the projections in floats."""
    good = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in good]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    v = [[Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3) for j in range(d)] for i in range(d)]
    value, vector = np.linalg.eigh(np.array([[float(c) for c in r] for r in v]))
    value, vector = value[::-1], vector[:, ::-1]
    dev = [sum((n * c - t) ** 2 for c, t in zip(r, s)) for r in x]
    w = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(r, s)] for r in x]) @ (vector / np.sqrt(value))
    return [i for i, _ in good], n, dev, w[:, :most], (value / value.sum())[:most]


def check_white(got, rows, most=32):
    ids, n, dev, w, share = white(rows, most)
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == len(ids) * min(most, w.shape[1]) and {r["n"] for r in got} == {n}
    for k in range(w.shape[1]):
        mine = np.array([by[i, k + 1]["whitened"] for i in ids])
        assert np.abs(mine - np.sign(mine @ w[:, k]) * w[:, k]).max() < 1e-7
        assert by[ids[0], k + 1]["explained"] == pytest.approx(share[k], rel=1e-9)
    assert [by[i, 1]["deviation"] for i in ids] == dev
    assert 0 <= got[0]["identity_error"] < 1e-9 and len({r["identity_error"] for r in got}) == 1


def test_whitening_of_a_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    check_white(whiten.op13_whitening(spark, SF).collect(), rows)


def test_whitening_of_rows_with_holes_and_other_lengths(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(0, 3, 4)]) for i in range(40)]
    bad = [(50, None), (51, [1.0, None, 2.0, 3.0]), (52, [float("nan")] * 4), (53, [float("inf"), 0.0, 0.0, 0.0]), (54, [1.0, 2.0]), (55, []), (56, [1e30, 0.0, 0.0, 0.0])]
    e = spark.createDataFrame([(i, v, "x") for i, v in rows + bad], "vec_id bigint, embedding array<float>, y string").repartition(3)
    check_white(whiten.whiten(e).collect(), rows)
    assert {r["component"] for r in whiten.whiten(e, most=2).collect()} == {1, 2}


def test_whitening_without_variance(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, [])], [(1, None)]):
        assert whiten.whiten(frame(rows)).count() == 0
    line = whiten.whiten(frame([(i, [float(i), 2.0 * i, 5.0]) for i in range(5)] + [(None, [1.0, 2.0, 5.0])])).collect()
    assert {r["component"] for r in line} == {1} and len(line) == 6 and line[0]["explained"] == pytest.approx(1)


def test_exact_sums_of_large_entries():
    rng = np.random.default_rng(2)
    for bits in (10, 30, 61):
        y = rng.integers(-(1 << bits), 1 << bits, (50, 3))
        sums, cross = whiten.scatter(y)
        assert sums.tolist() == [sum(map(int, y[:, j])) for j in range(3)]
        assert all(cross[i, j] == sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for i in range(3) for j in range(3))
        assert all(sum(w << whiten.WORD * k for k, w in enumerate(whiten._words(int(v)))) == v for v in cross.ravel())
        n, s = 50, [int(v) for v in sums]
        c = whiten._centred(y, n, s)
        dev = [sum((n * int(a) - t) ** 2 for a, t in zip(r, s)) for r in y]
        assert whiten._deviations(c) == [v if v < 1 << 63 else None for v in dev]
