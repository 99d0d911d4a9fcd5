"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. Since toxic texts are
mostly ordinary prose, the second holds the first one's content as well. Texts are read whole, as
windows: each run of letters, long runs as overlapping pieces that together cover them, written as
overlapping character groups so that lengths in bytes resolve fine differences. The first groups of a
run are written again with marks of their places, since how a run begins tells more than what occurs
somewhere in it. What a window gains, its length with the ordinary dictionary less that with the toxic one, is standardised by window size and
turned into log odds calibrated on labelled rows that no dictionary was trained on.

Not all windows of a toxic text are toxic, and no list of words says which. Beginnings of windows are counted in both
classes; windows with a beginning that toxic rows have far more often train the toxic dictionary, the others of
ordinary rows the ordinary one. Scores come from compressed lengths alone, of beginnings seen or not. A text's strongest windows, and by how much
it has more strong ones than ordinary text of its length, give its score.

Defined results: a null or empty text, or one without letters, has no window and gets the score of a
text of no evidence. Without any toxic or any ordinary labelled row nothing can be learned: every score
is 0. A class of one row is trained and calibrated on the same row. Where windows are too few or too much alike to train a
dictionary on, their distinct ones, the last ones if they are more than its size, are the dictionary as they stand. Ties,
repeated rows and further columns have no influence: a score depends on text alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import add

import numpy as np
import pandas as pd
import zstandard as zs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexus.session import ship, spare_name, table

#: Labelled rows of each class that the model is fitted on, at most; the only bound of the fit.
FIT_ROWS = 1500
GRAM, LEVEL = 4, 12
ORDINARY_BYTES = 110_000
#: Bytes of the toxic dictionary, and segment and matched lengths of its training.
TOXIC_BYTES, SEGMENT, MATCHED = 24_576, 200, 8
#: Letters of a beginning, the mark of the start among them; how many times as often as due, and by how many deviations, toxic rows must have it.
HEADS, TIMES, SURE = (4, 5, 6, 7, 8), 3.0, 4.5
#: Marks of places in a run. Letters are lowered, so no other group looks like a marked one.
PLACES = [b"A", b"B", b"C", b"D", b"E", b"F", b"G", b"H"]
#: Of the rows of a class, one in so many calibrates; the others train.
LOOK_EVERY = 3
#: Runs of up to LONGEST letters are one window; longer ones are pieces of PIECE, one every STEP letters.
LONGEST, PIECE, STEP = 24, 14, 4
#: Windows whose odds a worker remembers before it starts anew. They are short, so this bounds bytes; results don't depend on it.
MEMO = 600_000
#: Log odds above which windows are counted.
LEVELS = np.array([0.5, 1.0, 2.0, 4.0])
#: Sizes of windows in bytes are told apart below this; a window of LONGEST letters and its marks has four bytes a letter at most.
SIZES = 4 * LONGEST + 4
EDGES = np.arange(-3, 16.01, 0.25)
WORD, GAP = re.compile(r"[^\W\d_]+"), re.compile(r"[\W\d_]")
#: Letters of a text whose runs are held at a time.
CHUNK = 1_000_000
GRAMS = [slice(i, i + GRAM) for i in range(4 * LONGEST + 4)]


def windows(text: str | None) -> Iterator[str]:
    """All windows of a whole text, one after another; runs are looked for in some CHUNK letters at a time."""
    lowered, at = (text or "").lower(), 0
    while at < len(lowered):
        gap = GAP.search(lowered, at + CHUNK) if len(lowered) - at > CHUNK else None
        end = gap.start() if gap else len(lowered)
        for run in WORD.findall(lowered, at, end):
            if len(run) <= LONGEST:
                yield f"^{run}$"
                continue
            run = f"^{run}$"
            for i in range(0, len(run) - PIECE, STEP):
                yield run[i : i + PIECE]
            yield run[-PIECE:]
        at = end


def _bytes(window: str) -> bytes:
    w = window.encode("utf-8", "replace")
    if len(w) <= GRAM:
        groups = [w, PLACES[0] + w[1:]] if w.startswith(b"^") else [w]
    else:
        groups = list(map(w.__getitem__, GRAMS[: len(w) - GRAM + 1]))
        if w.startswith(b"^"):
            groups += map(add, PLACES, groups[1:])
    return b" ".join(groups) + b" "


def _size(window: str) -> int:
    return min(SIZES - 1, len(window.encode("utf-8", "replace")))


def _compressor(content: bytes) -> zs.ZstdCompressor:
    made = zs.ZstdCompressionDict(content)
    p = zs.ZstdCompressionParameters.from_level(LEVEL, source_size=256, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0)
    made.precompute_compress(compression_params=p)
    return zs.ZstdCompressor(dict_data=made, compression_params=p)


def _train(size: int, samples: list[bytes], **how: int) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train on."""
    try:
        return zs.train_dictionary(size, samples, **how).as_bytes()
    except zs.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


class Gains:
    """What windows gain by the toxic dictionary, in bytes. Nothing is kept of a window once asked for."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = _compressor(ordinary), _compressor(ordinary + toxic + ordinary[-64:])

    def __call__(self, window: str) -> int:
        b = _bytes(window)
        return len(self.ordinary.compress(b)) - len(self.toxic.compress(b))


def _scale(gains: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of ordinary windows' gains for each size; sizes seldom seen lean on a line through all."""
    a = np.vstack([np.ones(len(sizes)), sizes]).T
    line = np.linalg.lstsq(a, gains, rcond=None)[0] if len(gains) else np.zeros(2)
    var = float(((gains - a @ line) ** 2).mean()) + 0.25 if len(gains) else 1.0
    mean, dev = np.zeros(SIZES), np.ones(SIZES)
    for b in range(SIZES):
        own = gains[sizes == b]
        mean[b] = (own.sum() + 20 * (line[0] + line[1] * b)) / (len(own) + 20)
        dev[b] = np.sqrt((((own - mean[b]) ** 2).sum() + 20 * var) / (len(own) + 20))
    return mean, dev


def _rising(share: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The closest rising sequence, by pooling neighbours that fall."""
    blocks: list[list[float]] = []
    for y, w in zip(share, weight, strict=True):
        blocks.append([y, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            y2, w2, n2 = blocks.pop()
            y1, w1, n1 = blocks.pop()
            blocks.append([(y1 * w1 + y2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([[y] * int(n) for y, _, n in blocks])


def _features(values: np.ndarray, rates: np.ndarray) -> tuple[float, ...]:
    """The strongest windows, and by how much more windows are strong than of as many ordinary ones (``rates``: shares of these)."""
    n = len(values)
    if not n:
        return (0.0,) * (4 + len(LEVELS))
    top = np.sort(np.maximum(values, 0.0) if n <= 4 else np.maximum(np.partition(values, n - 4)[n - 4 :], 0.0))[::-1]
    due = rates * n
    over = ((values[:, None] > LEVELS).sum(0) - due) / np.sqrt(due + 1)
    # What the strongest of n ordinary windows shows grows with log n.
    return (float(top[0]), float(top[1]) if n > 1 else 0.0, float(top.sum()), float(np.log1p(n)), *np.log1p(np.maximum(over, 0.0)).tolist())


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights by Newton steps on standardised columns; mean and scale are returned with them."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    a = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w, penal = np.zeros(a.shape[1]), ridge * np.eye(a.shape[1])
    penal[0, 0] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penal, a.T @ (y - p) - penal @ w)
    return w, mean, scale


def _parts(texts: list[str | None]) -> tuple[list[list[str]], list[list[str]]]:
    """Distinct windows of the rows to train on, and of those to calibrate on."""
    rows = [list(dict.fromkeys(windows(t))) for t in texts]
    return ([r for i, r in enumerate(rows) if i % LOOK_EVERY], rows[0::LOOK_EVERY]) if len(rows) > 1 else (rows, rows)


def _heads(window: str) -> set[str]:
    return {window[:n] for n in HEADS if len(window) >= n}


def _begins(window: str, signs: set[str]) -> bool:
    return not signs.isdisjoint(_heads(window))


def _telling(toxic: list[str], ordinary: list[str]) -> set[str]:
    """Beginnings that windows of toxic rows have far more often than those of ordinary rows, beyond what chance explains.

    Deviations are those of a count if both classes began their windows alike, so rare beginnings need more.
    """
    n1, n0 = (Counter(h for w in ws for h in _heads(w)) for ws in (toxic, ordinary))
    part = len(toxic) / max(1, len(toxic) + len(ordinary))
    due = {h: (n + n0[h]) * part for h, n in n1.items()}
    return {h for h, n in n1.items() if n * (1 - part) >= TIMES * n0[h] * part and n - due[h] >= SURE * np.sqrt(due[h] * (1 - part) + 1e-9)}


def fit(rows: list[tuple[str, int]], toxic_share: float | None = None) -> dict | None:
    """rows: text and label. toxic_share: of all labelled rows, where ``rows`` were not chosen in proportion.

    None: nothing to learn.
    """
    texts = {y: [t for t, label in rows if label == y] for y in (0, 1)}
    if not texts[0] or not texts[1]:
        return None
    (train0, look0), (train1, look1) = _parts(texts[0]), _parts(texts[1])
    every, prose = [w for ws in train1 for w in ws], [w for ws in train0 for w in ws]
    signs = _telling(every, prose)
    ordinary = _train(ORDINARY_BYTES, [_bytes(w) for w in prose if not _begins(w, signs)])
    toxic = _train(TOXIC_BYTES, [_bytes(w) for w in every if _begins(w, signs)] or [_bytes(w) for w in every], k=SEGMENT, d=MATCHED)
    gain = Gains(ordinary, toxic)
    plain = list(dict.fromkeys(w for ws in look0 for w in ws))
    mean, dev = _scale(np.array([gain(w) for w in plain], float), np.array([_size(w) for w in plain], int))
    model = {"ordinary": ordinary, "toxic": toxic, "mean": mean, "dev": dev}
    # Odds: over all sizes by standardised gain, rising; then each size's own gains, leaning on those.
    known = {w: gain(w) for ws in (*look0, *look1) for w in ws}
    seen = {(y, _size(w), known[w]): 0 for y in (0, 1) for w in known}
    for y, part in ((0, look0), (1, look1)):
        for ws in part:
            for w in ws:
                seen[y, _size(w), known[w]] += 1
    cells = sorted({(s, g) for _, s, g in seen})
    bins = {(s, g): int(np.digitize((g - mean[s]) / dev[s], EDGES)) for s, g in cells}
    count = np.zeros((2, len(EDGES) + 1))
    for (s, g), b in bins.items():
        for y in (0, 1):
            count[y, b] += seen[y, s, g]
    rate = count.sum(1) / max(1.0, count.sum()) + 1e-9
    total = count.sum(0)
    share = _rising((count[1] + rate[1]) / (total + 1), total + 1)
    model["odds"] = np.log(share / (1 - share)) - np.log(rate[1] / rate[0])
    own = {}
    for (s, g), b in bins.items():
        n0, n1 = seen[0, s, g], seen[1, s, g]
        p = (n1 + 10 * share[b]) / (n0 + n1 + 10)
        own[s, g] = float(np.log(p / (1 - p)) - np.log(rate[1] / rate[0]))
    model["own"] = own
    odds = Odds(model)
    usual = np.array([odds[w] for ws in look0 for w in ws])
    rates = (usual[:, None] > LEVELS).mean(0) if len(usual) else np.zeros(len(LEVELS))
    x = np.array([_features(np.array([odds[w] for w in ws]), rates) for ws in (*look1, *look0)])
    y = np.repeat([1.0, 0.0], [len(look1), len(look0)])
    w, centre, scale = _logistic(x, y)
    if toxic_share is not None:
        w[0] += np.log(toxic_share / (1 - toxic_share)) - np.log(len(look1) / len(look0))
    return model | {"weights": (w, centre, scale), "rates": rates}


class Odds(dict):
    """Calibrated log odds of windows, remembered."""

    def __init__(self, model: dict):
        super().__init__()
        self.gain = Gains(model["ordinary"], model["toxic"])
        self.mean, self.dev, self.odds, self.own = model["mean"], model["dev"], model["odds"], model["own"]

    def __missing__(self, window: str) -> float:
        if len(self) >= MEMO:
            self.clear()
        s, g = _size(window), self.gain(window)
        found = self.own.get((s, g))
        if found is None:
            found = float(self.odds[np.digitize((g - self.mean[s]) / self.dev[s], EDGES)])
        self[window] = found
        return found


class Scorer:
    def __init__(self, model: dict):
        self.odds = Odds(model)
        self.w, self.mean, self.scale = model["weights"]
        self.rates = model["rates"]

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.mean)))
        for i, t in enumerate(texts):
            x[i] = _features(np.fromiter(map(self.odds.__getitem__, windows(t)), float), self.rates)
        z = ((x - self.mean) / self.scale * self.w[1:]).sum(1) + self.w[0]  # row by row, so that equal texts score alike in any batch
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


_scorers: dict[int, Scorer] = {}


def _scorer(model: dict) -> Scorer:
    """One scorer for each worker process and model; its memo is kept from task to task."""
    key = hash((model["toxic"], model["ordinary"], model["weights"][0].tobytes()))
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the identifier as text, modulo ``n``; null for a null identifier."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, held_out_fold: int = 0) -> dict | None:
    """Fit on at most ``rows`` labelled texts of each class, outside the held-out fold, chosen by hash."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("_toxic")).where(F.col("_toxic").isin(0, 1) & (fold(F.col("doc_id"), 5) != held_out_fold))
    n = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}  # two rows
    if len(n) < 2:
        return None
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("_toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 * rows ids
    found = texts.orderBy(F.xxhash64("doc_id"), "doc_id", "text", "_toxic").limit(2 * rows).collect()
    return fit([(r["text"], r["_toxic"]) for r in found], n[1] / (n[0] + n[1]))


def score(docs: DataFrame, model: dict | None, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score of each whole text; everything else of ``docs`` is passed on."""
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # two dictionaries and a table: under 1 MB

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(_scorer(shared.value)([t if isinstance(t, str) else None for t in texts]))

    return docs.withColumn(out, scored(F.col(text)))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; a document without evidence stays."""
    name = spare_name("score", docs)
    return score(docs, learn(docs, table(spark, sf_dir, "labels")), out=name).where(F.col(name) < 0.5).drop(name)
