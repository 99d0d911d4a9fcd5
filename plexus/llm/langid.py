"""Language of words and texts by a linear-chain conditional random field.

A word's features are its beginnings and ends, its character n-grams and whether a lexicon of frequent
words holds it, each hashed to one weight per language. Runs of letters too long for a word, as in scripts
without spaces, are read as pieces that overlap, so that every n-gram counts. Weights and the transitions
between languages are learned together by gradient steps on the log likelihood of sequences spliced from
texts of several languages, so that changes of language inside a text occur while learning.
Forward-backward gives every word's marginals: :func:`spans` labels the words of code-switched texts,
:func:`identify` gives a text the language of the largest mean marginal.

Defined results: a null text or one without a letter is ``und`` with score 0. Without learned rows
every text is ``und`` and has no spans. Languages tie to the one that comes first in code point order. Repeated rows
and further columns have no influence; identifiers serve only to choose the learned rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plexus.llm.toxicity import fold
from plexus.session import ship, table

#: Labelled rows of each language that are learned from, whole, at most.
FIT_ROWS, SALTS = 120, 24
SLOTS = 1 << 16
#: Words of the lexicon, the most frequent ones of each language's learned rows; all other words are known by their letters.
LEXICON = 400
#: Runs up to LONGEST letters are words; longer ones are read in pieces of PIECE that overlap by LAP.
LONGEST, PIECE, LAP = 24, 18, 4
#: Words, which are short, that a worker remembers before it starts anew; it bounds memory, not results.
MEMO = 200_000
WORD = re.compile(r"[^\W\d_]+")


class _Slots(dict):
    """Slot of each feature string. Shared stems make few of them; beyond MEMO they are hashed anew."""

    def __missing__(self, feature: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        out = self[feature] = zlib.crc32(feature.encode("utf-8", "replace")) & (SLOTS - 1)
        return out


_slots = _Slots()


def pieces(run: str) -> list[str]:
    """A run of letters as one marked word, or as overlapping pieces of which the ends alone are marked."""
    w = f"<{run}>"
    if len(run) <= LONGEST:
        return [w]
    return [w[at : at + PIECE] for at in range(0, len(w) - LAP, PIECE - LAP)]


def features(piece: str, lexicon: frozenset[str]) -> list[int]:
    """Slots of a piece's features: beginning, ends and lexicon where it has them, and all its trigrams."""
    found = []
    if piece[0] == "<":
        found.append("p" + piece[1:4].rstrip(">"))
    if piece[-1] == ">":
        x = piece[:-1].lstrip("<")
        found += ["s" + x[-1:], "s" + x[-2:], "s" + x[-4:]]
    if piece in lexicon:
        found.append("=" + piece)
    found += [piece[i : i + 3] for i in range(len(piece) - 2)]
    return list(map(_slots.__getitem__, found))


class Model:
    def __init__(self, langs: list[str], lexicon: frozenset[str], weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.langs, self.lexicon, self.weights, self.moves, self.start = langs, lexicon, weights, moves, start


def forward_backward(e: np.ndarray, mask: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals and forward, backward variables of sequences [n, t, k] of emission potentials; mask [n, t].

    Sequences are packed to the left: mask rows are runs of True followed by False.
    """
    n, t, k = e.shape
    alpha, beta = np.empty_like(e), np.ones_like(e)
    a = start * e[:, 0]
    alpha[:, 0] = a / a.sum(1, keepdims=True)
    for i in range(1, t):
        live = int(mask[:, i].sum())  # rows are ordered by length, longest first
        a = (alpha[:live, i - 1] @ moves) * e[:live, i]
        alpha[:live, i] = a / a.sum(1, keepdims=True)
    for i in range(t - 2, -1, -1):
        live = int(mask[:, i + 1].sum())
        if live:
            b = (beta[:live, i + 1] * e[:live, i + 1]) @ moves.T
            beta[:live, i] = b / b.sum(1, keepdims=True)
    alpha[~mask] = 0
    p = alpha * beta
    p /= np.maximum(p.sum(2, keepdims=True), 1e-30)
    return p, alpha, beta


def _spliced(texts: list[list[list[str]]], length: int, rng: np.random.Generator) -> Iterator[tuple[list[str], list[int]]]:
    """Sequences of ``length`` words and their languages that use up every word of every text once.

    Most often the same language goes on, at times another one follows.
    """
    step = length // 3
    left = [[ws[a : a + step] for ws in own for a in range(0, len(ws), step)] for own in texts]
    for own in left:
        rng.shuffle(own)
    words: list[str] = []
    tags: list[int] = []
    lang = -1
    while any(left):
        if lang < 0 or not left[lang] or rng.random() > 0.75:
            n = np.array([len(own) for own in left], float)
            lang = int(rng.choice(len(left), p=n / n.sum()))
        add = left[lang].pop()
        words += add
        tags += [lang] * len(add)
        while len(words) >= length:
            yield words[:length], tags[:length]
            words, tags = words[length:], tags[length:]
    if words:
        yield words, tags


def fit(rows: list[tuple[str, str]], epochs: int = 3, length: int = 48, seed: int = 5) -> Model | None:
    langs = sorted({lang for _, lang in rows})
    texts = [[w for w in (tokens(t) for t, x in rows if x == lang) if w] for lang in langs]
    if not any(texts):
        return None
    counts = [Counter(w for ws in own for w in ws) for own in texts]
    lexicon = frozenset(w for c in counts for w, _ in c.most_common(LEXICON))
    rng = np.random.default_rng(seed)
    k = len(langs)
    seqs = sorted(_spliced(texts, length, rng), key=lambda s: -len(s[0]))  # all of one length but the last
    slots = {w: np.array(features(w, lexicon)) for w in {w for ws, _ in seqs for w in ws}}
    weights, moves, start = np.zeros((SLOTS, k)), np.zeros((k, k)), np.zeros(k)
    power = np.full(weights.shape, 1e-8)
    size = 128
    for _ in range(epochs):
        order = rng.permutation(len(seqs))
        for at in range(0, len(order), size):
            batch = [seqs[i] for i in sorted(order[at : at + size])]  # longest first
            mask = np.arange(length)[None, :] < np.array([len(ws) for ws, _ in batch])[:, None]
            own = [slots[w] for ws, _ in batch for w in ws]
            sizes = np.array([len(x) for x in own])
            flat = np.concatenate(own)
            z = np.zeros((*mask.shape, k))
            z[mask] = np.add.reduceat(weights[flat], np.cumsum(sizes) - sizes, axis=0)
            e = np.exp(z - z.max(2, keepdims=True))
            mv, st = np.exp(moves), np.exp(start)
            p, alpha, beta = forward_backward(e, mask, mv, st)
            gold = np.zeros_like(z)
            gold[mask] = np.eye(k)[np.concatenate([tags for _, tags in batch])]
            g = gold - p
            each = np.repeat(g[mask], sizes, 0)
            grad = np.stack([np.bincount(flat, each[:, j], SLOTS) for j in range(k)], 1)
            power += grad**2
            weights += 0.3 * grad / np.sqrt(power) - 1e-5 * weights
            pair = alpha[:, :-1, :, None] * mv[None, None] * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
            pair /= np.maximum(pair.sum((2, 3), keepdims=True), 1e-30)
            both = mask[:, 1:, None, None]
            seen = np.einsum("ntk,ntl->kl", gold[:, :-1], gold[:, 1:])
            moves += 0.5 * (seen - (pair * both).sum((0, 1))) / mask.sum()
            start += 0.5 * g[:, 0].mean(0)
    return Model(langs, lexicon, weights.astype(np.float32), np.exp(moves).astype(np.float32), np.exp(start).astype(np.float32))


class _Index(dict):
    """Numbers words as they come and keeps those whose row is still to be filled."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        self.new.append(word)
        return i


class Tagger:
    def __init__(self, model: Model):
        self.m = model
        self.rows = _Index()
        self.table = np.zeros((1024, len(model.langs)), np.float32)

    def _fill(self) -> None:
        """Emission potentials of the words numbered since the last call."""
        words = self.rows.new
        if not words:
            return
        first = len(self.rows) - len(words)
        while len(self.rows) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        slots = [features(w, self.m.lexicon) for w in words]
        ends = np.cumsum([len(x) for x in slots])
        z = np.add.reduceat(self.m.weights[np.fromiter(chain.from_iterable(slots), np.int64, int(ends[-1]))], np.concatenate(([0], ends[:-1])), axis=0)
        self.table[first : len(self.rows)] = np.exp(z - z.max(1, keepdims=True)) + np.float32(1e-12)
        self.rows.new = []

    def marginals(self, seqs: list[list[str]]) -> list[np.ndarray]:
        """For each sequence of words the [words, languages] marginals."""
        if len(self.rows) > MEMO:
            self.rows = _Index()
        order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
        order = [i for i in order if seqs[i]]
        out: list[np.ndarray] = [np.zeros((0, len(self.m.langs)), np.float32)] * len(seqs)
        at = 0
        while at < len(order):  # blocks of similar lengths, so that little is padded
            longest = len(seqs[order[at]])
            block = order[at : at + max(1, 400_000 // longest)]
            at += len(block)
            lengths = np.array([len(seqs[i]) for i in block])
            mask = np.arange(longest)[None, :] < lengths[:, None]
            index = np.zeros(mask.shape, np.int64)
            index[mask] = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(seqs[i] for i in block)), np.int64, int(lengths.sum()))
            self._fill()
            p, _, _ = forward_backward(self.table[index], mask, self.m.moves, self.m.start)
            for r, i in enumerate(block):
                out[i] = p[r, : len(seqs[i])]
        return out

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for p in self.marginals([tokens(t) for t in texts]):
            if not len(p):
                langs.append("und")
                scores.append(0.0)
            else:
                mean = p.mean(0, dtype=np.float64)
                j = int(mean.argmax())
                langs.append(self.m.langs[j])
                scores.append(float(min(1.0, mean[j])))
        return langs, scores

    def spans(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text its stretches of one language: start and length in code points, lang, mean marginal.

        A stretch begins with its first word and ends with its last one.
        """
        found = [[x for m in WORD.finditer(t or "") if m[0].isalpha() for x in placed(m[0].lower(), m.start(), m.end())] for t in texts]
        out = []
        for words, p in zip(found, self.marginals([[w for _, _, w in ws] for ws in found]), strict=True):
            own: list[dict] = []
            for (start, end, _), row in zip(words, p, strict=True):
                j = int(row.argmax())
                if own and own[-1]["lang"] == self.m.langs[j]:
                    last = own[-1]
                    last["length"], last["sum"], last["n"] = max(end, last["start"] + last["length"]) - last["start"], last["sum"] + float(row[j]), last["n"] + 1
                else:
                    own.append({"start": start, "length": end - start, "lang": self.m.langs[j], "sum": float(row[j]), "n": 1})
            out.append([{"start": s["start"], "length": s["length"], "lang": s["lang"], "score": s["sum"] / s["n"]} for s in own])
        return out


def placed(run: str, start: int, end: int) -> Iterator[tuple[int, int, str]]:
    """The pieces of a run that stands at ``start`` to ``end``, each with its own place."""
    found = pieces(run)
    for i, piece in enumerate(found):
        at = start + i * (PIECE - LAP) - 1  # the mark before the run counts as one
        yield max(start, at), end if i == len(found) - 1 else min(end, at + PIECE), piece


def tokens(text: str | None) -> list[str]:
    """All words of a text, long ones in pieces; a letter beyond the word pattern's own notion makes a word too."""
    runs = WORD.findall(text.lower()) if text else []
    if runs and not "".join(runs).isalpha():
        runs = [r for r in runs if r.isalpha()]
    if not runs and text and any(map(str.isalpha, text)):
        runs = ["".join(filter(str.isalpha, text))]
    if runs and max(map(len, runs)) > LONGEST:
        return [p for r in runs for p in pieces(r)]
    return [f"<{r}>" for r in runs]


_taggers: dict[int, Tagger] = {}


def _tagger(model: Model) -> Tagger:
    key = hash((tuple(model.langs), model.weights.tobytes()))
    if key not in _taggers:
        _taggers.clear()
        _taggers[key] = Tagger(model)
    return _taggers[key]


def learn(docs: DataFrame, rows: int = FIT_ROWS, held_out_fold: int = 2) -> Model | None:
    """Fit on at most ``rows`` whole texts of each language, chosen by hash outside the held-out fold.

    Each of SALTS parts of a language, dealt by another hash, gives its share, so that no task ranks a language.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 4) != held_out_fold))
    salt = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS))
    most = max(1, rows // SALTS)
    part = W.partitionBy("lang", salt)
    chosen = known.select("doc_id", "lang").withColumn("_r", F.row_number().over(part.orderBy(F.xxhash64("doc_id"), "doc_id")))
    chosen = chosen.where(F.col("_r") <= most).select("doc_id", "lang").distinct()
    texts = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])  # ``rows`` ids a language
    # Identifiers that repeat are ranked once more, by their texts.
    last = texts.withColumn("_r", F.row_number().over(part.orderBy(F.xxhash64("doc_id"), "doc_id", "text"))).where(F.col("_r") <= most)
    found = last.orderBy("lang", "doc_id", "text").select("text", "lang").collect()
    return fit([(r["text"], r["lang"]) for r in found])


def spans(docs: DataFrame, model: Model | None, text: str = "text", out: str = "spans") -> DataFrame:
    """Adds the stretches of one language of each whole text: array of (start, length, lang, score)."""
    kind = "array<struct<start:int,length:int,lang:string,score:double>>"
    if model is None:
        return docs.withColumn(out, F.expr(f"CAST(array() AS {kind})"))
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS weights for each language

    @F.pandas_udf(kind)
    def labelled(texts: pd.Series) -> pd.Series:
        return pd.Series(_tagger(shared.value).spans([t if isinstance(t, str) else None for t in texts]), dtype=object)

    return docs.withColumn(out, labelled(F.col(text)))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds lang_pred and score of each whole text to (doc_id, text)."""
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # SLOTS weights for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = _tagger(shared.value)
        for batch in batches:
            langs, scores = tag.texts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, learn(docs))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
