"""The whole pipeline against a brute-force version of each of its stages, on a small fixture."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
import numpy as np

from plexus.llm import bpe
from plexus.session import table

WEIGHTS, PERCENT, CAP = (3, 1, 2), 150, 2


def fixture(spark, folder):
    """(rows, toxic ids): ordinary and toxic texts, exact copies, near copies, nulls and blanks."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 9)))
    plain, bad = [word() for _ in range(300)], ["zq" + word() + "xk" for _ in range(12)]
    texts, toxic = [None, "", " \n"], set()
    for i in range(300):
        harmful = i % 4 == 0
        if harmful:
            toxic.add(len(texts))
        texts.append(" ".join(rng.choice(bad if harmful and rng.random() < 0.5 else plain) for _ in range(rng.choice((40, 60, 90)))))
    ordinary = [i for i in range(3, len(texts)) if i not in toxic]
    for i in ordinary[:25]:  # exact copies but for white space
        texts.append(texts[i].replace(" ", " \n", 1))
    for i in ordinary[25:60]:  # one word differs: linked from 60 words on
        w = texts[i].split()
        w[len(w) // 2] = rng.choice(plain) + "y"
        texts.append(" ".join(w))
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(3, len(texts))], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, toxic


def exact(rows):
    best = {}
    for r in rows:
        key = "".join((r[1] or "").translate(dict.fromkeys((32, *range(9, 14)))))
        best[key] = min(best.get(key, r), r, key=lambda x: (-len(x[1] or ""), x[0]))
    return sorted(best.values())


def near(rows):
    sets = []
    for r in rows:
        w = (r[1] or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = [r[0] for r in rows]
    for _ in range(4):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    return [r for r, c in zip(rows, comp) if r[0] == c]


def aims(rows):
    """Target of each source, by giving out what is left in rounds."""
    size = Counter()
    for r in rows:
        size[r[3]] += len((r[1] or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    out, left, open_ = {}, sum(size.values()) * PERCENT / 100, set(order)
    while open_:
        per = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if per * weight[s] > CAP * size[s]}
        if not full:
            return out | {s: per * weight[s] for s in open_}
        for s in full:
            out[s] = CAP * size[s]
            left -= out[s]
        open_ -= full
    return out


def tupled(df):
    return sorted(tuple(r) for r in df.collect())


def test_pipeline_by_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    folder = f"file://{tmp_path}"
    rows, toxic = fixture(spark, folder)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    docs, steps = table(spark, folder, "documents"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/step{k}")
        docs = spark.read.parquet(f"{folder}/step{k}")
        assert k == 4 or docs.columns == columns
        steps.append(tupled(docs))

    want = [r for r in rows if r[0] not in toxic]
    assert steps[0] == want
    want = exact(want)
    assert steps[1] == want
    before = len(want)
    want = near(want)
    assert steps[2] == want and len(want) < before

    taken, size, longest, source = Counter(), Counter(), Counter(), {r[0]: r for r in want}
    copies = Counter(r[0] for r in steps[3])
    assert all(r == source[r[0]] for r in steps[3]) and max(copies.values()) <= CAP
    for r in want:
        n = len((r[1] or "").split())
        taken[r[3]] += n * copies[r[0]]
        size[r[3]] += n
        longest[r[3]] = max(longest[r[3]], n)
    for s, target in aims(want).items():
        assert abs(taken[s] - target) <= longest[s], s

    lib = Tokenizer.from_file(bpe.default_vocabulary())
    told = []
    for r in steps[3]:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        told.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert steps[4] == sorted(told)
    assert tupled(corpus_pipeline.run(spark, folder)) == steps[4]
