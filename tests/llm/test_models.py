"""The two learned operators: whole texts, edge cases, held-out rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexus.llm import langid, toxicity

BAD = ["zqworxk", "qhujak", "vikkzot", "xuqqem"]
PLAIN = ["the", "river", "stone", "garden", "letter", "window", "bridge", "summer", "orange", "market", "silver", "people"]


def labelled(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(PLAIN) + rng.choice(("", "s", "ed", "ing")) for _ in range(rng.choice((20, 60)))]
        if i % 4 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((" ".join(words), int(i % 4 == 0)))
    return rows


@pytest.fixture(scope="module")
def scorer():
    return toxicity.Scorer(toxicity.fit(labelled(400), 0.25))


def test_toxicity_on_other_rows(scorer):
    rows = labelled(200, 2)
    found = scorer([t for t, _ in rows]) >= 0.5
    assert np.mean(found == np.array([y == 1 for _, y in rows])) > 0.97


@pytest.mark.parametrize("place", ["start", "middle", "end"])
@pytest.mark.parametrize("gap", [" ", ""])
def test_toxic_evidence_counts_wherever_it_stands(scorer, place, gap):
    filler = gap.join(PLAIN * 120)
    bad = gap.join(BAD)
    text = {"start": bad + gap + filler, "middle": filler + gap + bad + gap + filler, "end": filler + gap + bad}[place]
    assert scorer([text])[0] >= 0.5 > scorer([filler + gap + filler])[0]


def test_windows_cover_every_letter():
    for run in ("a", "ab" * 12, "".join(chr(97 + i % 26) for i in range(500))):
        w = list(toxicity.windows(f"1 {run}!"))
        whole, at = f"^{run}$", 0
        for x in w:
            place = whole.index(x, max(0, at - len(x)))
            assert place <= at
            at = max(at, place + len(x))
        assert at == len(whole)


def test_toxicity_edges(spark, tmp_path, scorer):
    assert scorer([None, "", "12 !"]).tolist() == [scorer([""])[0]] * 3
    rows = [(i, t, "en", "s", y) for i, (t, y) in enumerate(labelled(300))] + [(i, t, None, None, None) for i, t in ((900, None), (901, ""), (902, "river " * 40_000), (None, BAD[0]), (903, "same"), (903, "same"), (904, "same"))]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string, toxic int")
    d.drop("toxic").write.parquet(f"file://{tmp_path}/documents.parquet")
    d.where("toxic is not null").selectExpr("doc_id", "1 AS quality", "toxic").unionAll(spark.createDataFrame([(None, 1, 1), (903, 1, None)], "doc_id bigint, quality int, toxic int")).write.parquet(f"file://{tmp_path}/labels.parquet")
    got = toxicity.op1_toxicity(spark, f"file://{tmp_path}").collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (903, 904)}) == 1 and len({r["score"] for r in got if r["doc_id"] in (900, 901)}) == 1
    truth = {r[0]: r[4] for r in rows if r[4] is not None}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert held and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    none = d.where(F.lit(False)).drop("toxic")
    assert toxicity.score(none, toxicity.learn(none, d.select("doc_id", "toxic"))).count() == 0
    assert toxicity.learn(d, d.where("toxic = 0").select("doc_id", "toxic")) is None
    assert {r[0] for r in toxicity.score(d, None, out="x").select("x").collect()} == {0.0}


def test_toxicity_with_hardly_any_rows():
    model = toxicity.fit([("bad qqq", 1), ("good words here", 0)])
    assert 0 <= toxicity.Scorer(model)(["bad qqq"])[0] <= 1
    assert toxicity.fit([("bad", 1)]) is None and toxicity.fit([("good", 0)]) is None
    assert toxicity.fit([("", 1), (None, 0)]) is not None


LANGS = {"en": ["the", "and", "of", "thing", "water", "other"], "de": ["der", "und", "die", "nicht", "schlacht", "zwischen"]}


def spoken(lang, n, rng):
    return " ".join(rng.choice(LANGS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def tagger():
    rng = random.Random(3)
    return langid.Tagger(langid.fit([(spoken(x, 60, rng), x) for x in LANGS for _ in range(40)]))


def test_words_of_code_switched_texts(tagger):
    rng = random.Random(4)
    a, b = spoken("en", 12, rng), spoken("de", 12, rng)
    (found,) = tagger.spans([f"{a}. {b}!"])
    assert [(s["lang"], s["start"], s["length"]) for s in found] == [("en", 0, len(a)), ("de", len(a) + 2, len(b))]
    assert tagger.spans([None, "12", ""]) == [[], [], []]


def test_every_letter_of_a_run_counts(tagger):
    rng = random.Random(5)
    a, b = ("".join(spoken(x, 40, rng).split()) for x in LANGS)
    assert tagger.texts([a, b])[0] == ["en", "de"]
    for x, y, z in ((a, b, b), (b, a, b), (b, b, a)):
        (found,) = tagger.spans([x + y + z])
        at = (0 if x is a else len(x)) + (0 if a in (x, y) else len(y)) if a is not x else 0
        middle = at + len(a) // 2
        assert [s["lang"] for s in found if s["start"] <= middle < s["start"] + s["length"]] == ["en"]
    w = "abcdefghijklmnopqrstuvwxyzabcdefgh"
    assert "".join(p[:langid.PIECE - langid.LAP] for p in langid.pieces(w)[:-1]) + langid.pieces(w)[-1] == f"<{w}>"
    assert set(langid.features("<abcdefghijklm>", frozenset())) != set(langid.features("<abcdefXhijklm>", frozenset()))


def test_marginals_with_padding_equal_those_without():
    rng = np.random.default_rng(6)
    moves, start = rng.random((3, 3)) + 0.1, rng.random(3) + 0.1
    a, b = rng.random((1, 6, 3)) + 0.1, rng.random((1, 4, 3)) + 0.1
    both = np.concatenate([a, np.concatenate([b, np.ones((1, 2, 3))], 1)])
    mask = np.array([[True] * 6, [True] * 4 + [False] * 2])
    p, _, _ = langid.forward_backward(both, mask, moves, start)
    assert np.allclose(p[0], langid.forward_backward(a, mask[:1], moves, start)[0][0])
    assert np.allclose(p[1, :4], langid.forward_backward(b, mask[1:, :4], moves, start)[0][0])


def test_splicing_uses_every_word_once():
    rng = np.random.default_rng(1)
    texts = [[[f"{k}-{i}-{j}" for j in range(n)] for i, n in enumerate((5, 16, 100))] for k in range(3)]
    seqs = list(langid._spliced(texts, 48, rng))
    assert sorted(w for ws, _ in seqs for w in ws) == sorted(w for own in texts for ws in own for w in ws)
    assert all(int(w[0]) == t for ws, tags in seqs for w, t in zip(ws, tags, strict=True))


def test_language_edges(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, spoken(x, rng.choice((3, 50)), rng), x, "s") for i, x in enumerate(["en", "de"] * 60)]
    rows += [(900, None, "en", "s"), (901, "", "de", "s"), (902, "12 -", None, "s"), (None, "the water", "en", "s"), (903, "der " * 30_000, None, "s"), (903, "the thing", "de", None), (904, "\u00b2\u00b2", "en", "s")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string")
    d.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = langid.op10_language(spark, f"file://{tmp_path}").collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (900, 901, 902, 904)) and by[None]["lang_pred"] == "en"
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 120]
    assert held and all(r["lang_pred"] == ("en", "de")[r["doc_id"] % 2] for r in held)
    none = d.where(F.lit(False))
    assert langid.learn(none) is None and langid.identify(none, None).count() == 0
    assert {r["lang_pred"] for r in langid.identify(d, None).collect()} == {"und"}
    assert [len(r["spans"]) for r in langid.spans(d, langid.learn(d)).where("doc_id in (900, 901)").collect()] == [0, 0]


def test_toxic_beginnings_of_runs():
    """The only sign is how some words begin; the same letters stand inside ordinary words."""
    rng = np.random.default_rng(3)
    parts = ["lo", "mir", "ta", "ven", "su", "kel", "ra", "dob"]
    word = lambda: "".join(rng.choice(parts, 3))

    def text(toxic: bool) -> str:
        words = [word() if rng.random() < 0.8 else word()[:3] + "grunzak" + word()[:2] for _ in range(60)]
        return " ".join([*words, *["grunzak" + word() for _ in range(8 * toxic)]])

    rows = [(text(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    score = toxicity.Scorer(toxicity.fit(rows))
    assert (score([text(True) for _ in range(50)]) >= 0.5).mean() >= 0.9
    assert (score([text(False) for _ in range(50)]) >= 0.5).mean() <= 0.1
    plain, marked = toxicity._bytes("agrunzak"), toxicity._bytes("^grunzak$")
    assert b"Agrun" in marked and b"Agrun" not in plain
