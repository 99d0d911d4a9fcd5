"""Alignment of two tokenizers' tokens by byte-owner arrays.

Both tokenizers write the same bytes, a space and the text. ``np.repeat`` lays the index of each token over
its bytes, once for A and once for B: every new pair of owners is a link between overlapping tokens, and
where both owners change at once the tokens are cut into groups.

Neither tokenizer joins anything across a space that follows no white space (A splits there before it
merges, and no piece of B holds a space after another character, which is looked up), so texts are taken
apart at such spaces and a worker remembers the alignment of each part. Corpus-wide counts of linked id
pairs are summed by Spark. The most frequent pairs, a number that PAIRS bounds, go to every worker as a
sorted array; links of all other pairs are joined with the rest of the table by shuffle. Both ways give the
same sums, so the bound decides on speed alone.

Defined results: a text that is null or empty, or whose bytes one of the tokenizers does not give back
(one with U+2581, which stands for a space in B), has no tokens: counts of 0, no groups, and its links
count nowhere. Repeated rows count as often as they stand; ties for a B id's highest count are all best.
Identifiers are passed on as they are, null ones too; further columns have no influence; an empty table
gives an empty result. A run of one part, a text without spaces, is held in memory as a whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexus.llm.bpe import byte_alphabet
from plexus.session import cut, drop, ship, table

#: Pairs whose counts go to every worker, at most: 17 bytes each.
PAIRS = 2_000_000
#: Parts a worker remembers before it starts anew, and the letters that all of them may have; results don't depend on it.
MEMO, MEMO_LETTERS = 500_000, 12_000_000
#: New parts that are encoded as one text.
JOINED = 100
#: Letters of text that are taken apart and looked up at a time.
CHUNK = 500_000
BOUNDARY, AFTER_SPACE = re.compile(r"(?<=\S) "), re.compile(r"\s ")
#: Below this code point both of A's libraries split texts alike; others go to the one that its file is written for.
PLAIN = re.compile("[\x00-\u024f]*")
MARK = "▁"
STATS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def chunks(text: str) -> Iterator[list[str]]:
    """The parts of a space and the text, each without the space it starts with, some CHUNK letters at a time."""
    s, at = " " + text, 0
    while len(s) - at > CHUNK and (found := BOUNDARY.search(s, at + CHUNK)):
        yield _parts(s[at : found.start()])
        at = found.start()
    yield _parts(s[at:])


def _parts(s: str) -> list[str]:
    """s starts with a space, and so does each part; that space is left out."""
    if not AFTER_SPACE.search(s):
        return s[1:].split(" ")
    first, *rest = BOUNDARY.split(s)
    return [first[1:], *rest]


def owners(lengths: np.ndarray) -> np.ndarray:
    """For each byte the index of the token that it belongs to."""
    return np.repeat(np.arange(len(lengths)), lengths)


def links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of all links, and which of them start a group, of two owner arrays over the same bytes."""
    da, db = a[1:] != a[:-1], b[1:] != b[:-1]
    starts = np.concatenate(([0], np.flatnonzero(da | db) + 1)) if len(a) else np.zeros(0, np.int64)
    new = np.concatenate(([True], (da & db)[starts[1:] - 1])) if len(a) else np.zeros(0, bool)
    return starts, new


class Aligner:
    """Aligns parts of texts; remembers what it has aligned."""

    def __init__(self, a_file: str, b_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_file=b_file)
        byte_of = {c: i for i, c in enumerate(byte_alphabet())}
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (1 + max(vocab.values()))
        for t, i in vocab.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of B holds a space after another character; texts can't be taken apart at spaces")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(t) for t in x]) for x in (self.a_bytes, self.b_bytes))
        said = lambda marks, n: [np.array([b"%c%d" % (m, i) for i in range(n)], object) for m in marks]
        # Ids as they are written in groups, with the sign before them.
        self.a_said, self.b_said = said(b";,", len(self.a_bytes)), said(b"|,", len(self.b_bytes))
        self.blank = [self.b.piece_to_id(MARK)]
        self.ranked = self._ranked(a_file)
        self.clear()

    def _ranked(self, a_file: str):
        """A faster library for A's vocabulary, where ids stand in the order of merges and words are split by the usual pattern; else None."""
        with open(a_file, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
        vocab, split = spec["model"]["vocab"], spec["pre_tokenizer"]
        usual = spec["normalizer"] is None and split["type"] == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        if not usual or any(vocab[m.replace(" ", "")] != 256 + i for i, m in enumerate(merges)):
            return None
        try:
            import tiktoken
            from public_tokenizers import PATTERN
        except ImportError:
            return None
        special = {t["content"] for t in spec["added_tokens"]}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={self.a_bytes[i]: i for t, i in vocab.items() if t not in special}, special_tokens={})

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.letters = 0
        self.groups: list[bytes] = []
        self.bad: set[int] = set()  # parts that are not given back
        self.stats = np.zeros((1024, 4), np.int64)
        self.codes: list[np.ndarray] = []  # pairs of all parts, in order; stats[:, 3] of each

    def full(self) -> bool:
        return len(self.index) >= MEMO or self.letters >= MEMO_LETTERS

    def _a_ids(self, texts: list[str]) -> list[list[int]]:
        if self.ranked and all(map(PLAIN.fullmatch, texts)):
            return list(map(self.ranked.encode_ordinary, texts))
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, parts: list[str], joined: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts one after another; the first ``joined`` parts are encoded as texts of several."""
        texts = [" ".join(parts[i : min(i + JOINED, joined)]) for i in range(0, joined, JOINED)] + parts[joined:]
        a = self._a_ids([" " + t for t in texts])
        b = [x if t else self.blank for t, x in zip(texts, self.b.encode(texts, num_threads=1), strict=True)]
        return tuple(np.fromiter(chain.from_iterable(x), np.int64, sum(map(len, x))) for x in (a, b))

    def _given_back(self, whole: bytes, ends: np.ndarray, fa: np.ndarray, fb: np.ndarray) -> bool:
        """Whether the ids have these bytes, and tokens end where parts do."""
        if not whole == b"".join(map(self.a_bytes.__getitem__, fa.tolist())) == b"".join(map(self.b_bytes.__getitem__, fb.tolist())):
            return False
        stops = (np.cumsum(self.a_len[fa]), np.cumsum(self.b_len[fb]))
        return all((s[np.searchsorted(s, ends)] == ends).all() for s in stops)

    def add(self, parts: list[str]) -> None:
        """Align new parts, all at once."""
        if not parts:
            return
        # Parts that end in white space stand alone, since the next one's space would not be a place to cut.
        alone = [p for p in parts if not p or p[-1].isspace()]
        if alone:
            parts = [p for p in parts if p and not p[-1].isspace()] + alone
        whole = (" " + " ".join(parts)).encode()
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        if len(whole) != sizes.sum():
            sizes = np.fromiter((len(p.encode()) for p in parts), np.int64, len(parts)) + 1
        ends, first = np.cumsum(sizes), len(self.index)
        fa, fb = self._encoded(parts, len(parts) - len(alone))
        if not self._given_back(whole, ends, fa, fb):
            each = [self._encoded([p], 0) for p in parts]
            for i, (a, b) in enumerate(each):
                if not self._given_back(whole[ends[i] - sizes[i] : ends[i]], sizes[i : i + 1], a, b):
                    self.bad.add(first + i)
                    each[i], sizes[i] = (a[:0], b[:0]), 0
            fa, fb = (np.concatenate(x) for x in zip(*each, strict=True))
            ends = np.cumsum(sizes)
        na, nb = self.a_len[fa], self.b_len[fb]
        starts, new = links(oa := owners(na), ob := owners(nb))
        la, lb, group = oa[starts], ob[starts], np.cumsum(new) - 1
        upto = lambda places: np.diff(np.searchsorted(places, ends), prepend=0)
        # Tokens in the order in which groups name them, each with its sign: a new group, B's side, or one more.
        ga, gb = np.zeros(len(fa), np.int64), np.zeros(len(fb), np.int64)
        ga[la], gb[lb] = group, group
        more = lambda g: np.concatenate(([False], g[1:] == g[:-1]))[: len(g)]
        said = np.concatenate((np.where(more(ga), self.a_said[1][fa], self.a_said[0][fa]), np.where(more(gb), self.b_said[1][fb], self.b_said[0][fb])))
        said = said[np.argsort(np.concatenate((2 * ga, 2 * gb + 1)), kind="stable")].tolist()
        at, text = 0, b"".join(said)
        a_counts, b_counts = upto(np.cumsum(na) - na), upto(np.cumsum(nb) - nb)
        letters = np.concatenate(([0], np.cumsum(np.fromiter(map(len, said), np.int64, len(said)))))
        stops = letters[np.cumsum(a_counts + b_counts)].tolist()
        for stop in stops:
            self.groups.append(text[at + 1 : stop])
            at = stop
        self.index.update(zip(parts, range(first, first + len(parts)), strict=True))
        self.letters += sum(map(len, parts))
        while first + len(parts) > len(self.stats):
            self.stats = np.concatenate((self.stats, np.zeros_like(self.stats)))
        self.stats[first : first + len(parts)] = np.stack([a_counts, b_counts, upto(starts[new]), upto(starts)], axis=1)
        self.codes.append(fa[la] << 32 | fb[lb])

    def pairs(self) -> np.ndarray:
        """Codes of the linked pairs of all parts."""
        if len(self.codes) != 1:
            self.codes = [np.concatenate([np.zeros(0, np.int64), *self.codes])]
        return self.codes[0]

    def runs(self, texts: list[str | None]) -> Iterator[list[tuple[int, np.ndarray]]]:
        """(number of the text, numbers of its parts), some CHUNK letters at a time; a long text comes in several."""
        held: list[tuple[int, list[str]]] = []
        size = 0

        def known() -> list[tuple[int, np.ndarray]]:
            if self.full():
                self.clear()
            found = [np.fromiter(map(self.index.get, p, repeat(-1)), np.int64, len(p)) for _, p in held]
            missing = [np.flatnonzero(at < 0).tolist() for at in found]
            self.add(list({p[i] for (_, p), places in zip(held, missing, strict=True) for i in places}))
            for (_, p), at, places in zip(held, found, missing, strict=True):
                at[places] = [self.index[p[i]] for i in places]
            return [(i, at) for (i, _), at in zip(held, found, strict=True)]

        for i, text in enumerate(texts):
            if not text or MARK in text:
                continue
            for parts in chunks(text):
                held.append((i, parts))
                size += min(len(text), CHUNK)
                if size >= CHUNK:
                    yield known()
                    held, size = [], 0
        if held:
            yield known()

    def sound(self, at: np.ndarray) -> bool:
        """Whether all these parts are given back."""
        return not self.bad or self.bad.isdisjoint(at.tolist())


class Counts:
    """Sums of linked pairs over texts."""

    def __init__(self, aligner: Aligner):
        self.aligner, self.times = aligner, np.zeros(0, np.int64)

    def grow(self) -> int:
        n = len(self.aligner.index)
        if n > len(self.times):
            self.times = np.concatenate((self.times, np.zeros(2 * n - len(self.times), np.int64)))
        return n

    def texts(self, texts: list[str | None]) -> Iterator[pd.DataFrame]:
        gone: set[int] = set()
        if long := [i for i, t in enumerate(texts) if t and len(t) >= CHUNK]:
            # A text of several runs counts only if all of them are given back, which is seen first.
            yield self.flush()
            gone = {i for i in long if not all(self.aligner.sound(at) for run in self.aligner.runs([texts[i]]) for _, at in run)}
        for run in self.aligner.runs(texts):
            n = self.grow()
            counted = [at for i, at in run if i not in gone and self.aligner.sound(at)]
            self.times[:n] += np.bincount(np.concatenate([np.zeros(0, np.int64), *counted]), minlength=n)
            if self.aligner.full():
                yield self.flush()

    def flush(self) -> pd.DataFrame:
        """(pair, n) so far, and starts anew."""
        n = self.grow()
        codes, weight = self.aligner.pairs(), np.repeat(self.times[:n], self.aligner.stats[:n, 3])
        order = np.argsort(codes[weight > 0], kind="stable")
        codes, weight = codes[weight > 0][order], weight[weight > 0][order]
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
        self.times[:] = 0
        if self.aligner.full():
            self.aligner.clear()
        return pd.DataFrame({"pair": codes[first], "n": np.add.reduceat(weight, first) if len(codes) else weight})


class Scores:
    """Alignments of texts with the corpus-wide counts of their links."""

    def __init__(self, aligner: Aligner, pairs: np.ndarray, counts: np.ndarray, best: np.ndarray):
        self.aligner, self.table = aligner, (pairs, counts, best)
        self.index: dict | None = None
        self.start()

    def start(self) -> None:
        self.index, self.done, self.at = self.aligner.index, 0, 0
        self.sums = np.zeros((1024, 3), np.int64)  # best links, counts, links of other pairs

    def learn(self) -> None:
        """Look up the pairs of parts that are new since the last call."""
        if self.index is not self.aligner.index:
            self.start()
        n = len(self.index)
        if n == self.done:
            return
        while n > len(self.sums):
            self.sums = np.concatenate((self.sums, np.zeros_like(self.sums)))
        codes = self.aligner.pairs()
        pairs, counts, best = self.table
        part = np.repeat(np.arange(self.done, n), self.aligner.stats[self.done : n, 3])
        new = codes[self.at :]
        place = np.minimum(np.searchsorted(pairs, new), max(0, len(pairs) - 1))
        hit = pairs[place] == new if len(pairs) else np.zeros(len(new), bool)
        np.add.at(self.sums, (part[hit], 0), best[place[hit]])
        np.add.at(self.sums, (part[hit], 1), counts[place[hit]])
        np.add.at(self.sums, (part[~hit], 2), 1)
        self.done, self.at = n, len(codes)

    def others(self, at: np.ndarray) -> np.ndarray:
        """Pairs of these parts' links that the table lacks."""
        at = at[self.sums[at, 2] > 0]
        if not len(at):
            return np.zeros(0, np.int64)
        ends = np.cumsum(self.aligner.stats[: len(self.index), 3])
        codes = np.concatenate([self.aligner.pairs()[ends[i] - self.aligner.stats[i, 3] : ends[i]] for i in at])
        pairs = self.table[0]
        return codes[pairs[np.minimum(np.searchsorted(pairs, codes), len(pairs) - 1)] != codes] if len(pairs) else codes

    def texts(self, texts: list[str | None], whole: bool) -> pd.DataFrame:
        """One row a text: STATS, the groups or their digest, and pairs that are still to be looked up."""
        out = np.zeros((len(texts), 6), np.int64)
        rest: list[list[np.ndarray]] = [[] for _ in texts]
        written: list = [None] * len(texts)
        for run in self.aligner.runs(texts):
            self.learn()
            for i, at in run:
                if not self.aligner.sound(at):
                    out[i, 0] = -1
                if out[i, 0] < 0:
                    continue
                out[i] += np.concatenate((self.aligner.stats[at].sum(0), self.sums[at, :2].sum(0)))
                if (more := self.others(at)).size:
                    rest[i].append(more)
                said = b";".join(map(self.aligner.groups.__getitem__, at.tolist()))
                if written[i] is None:
                    written[i] = [said] if whole else hashlib.sha256(said)
                elif whole:
                    written[i].append(said)
                else:
                    written[i].update(b";" + said)
        for i in np.flatnonzero(out[:, 0] < 0):
            out[i], rest[i], written[i] = 0, [], None
        frame = pd.DataFrame(out, columns=STATS)
        frame["groups"] = ["" if w is None else b";".join(w).decode() if whole else w.hexdigest() for w in written]
        frame["rest"] = [np.concatenate(r) if r else None for r in rest]
        return frame


_aligners: dict[tuple, Aligner] = {}
_scores: dict[str, Scores] = {}


def aligner(files: tuple[str, str] | None) -> Aligner:
    """One for each worker process and pair of files."""
    files = files or default_files()
    if files not in _aligners:
        _aligners[files] = Aligner(*files)
    return _aligners[files]


def pair_counts(docs: DataFrame, text: str = "text", files: tuple[str, str] | None = None) -> DataFrame:
    """(pair, n, best): how many links of all texts hold an A and a B id linked, and whether that is the B id's highest.

    ``pair`` is the A id times 2^32 plus the B id.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counts(aligner(files))
        for batch in batches:
            yield from counts.texts(batch["text"].tolist())
        yield counts.flush()

    sums = cut(docs.select(F.col(text).alias("text")).mapInPandas(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")), "pair-sums")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = sums.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))  # a row for each id of B's vocabulary at most
    named = cut(sums.join(F.broadcast(most), b_id == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")
    drop(sums)
    return named


def align(docs: DataFrame, counts: DataFrame, text: str = "text", files: tuple[str, str] | None = None, most: int = PAIRS, whole: bool = True) -> DataFrame:
    """``docs`` without its texts, with STATS and ``groups`` (``a1,a2|b1;a3|b2,b3``), or the groups' digest where not ``whole``.

    ``counts`` is the table of :func:`pair_counts` for the corpus that links are weighed by; ``most`` bounds
    the pairs that go to every worker.
    """
    spark = docs.sparkSession
    ship(spark)
    level = F.floor(F.log2("n")).cast("int")
    sizes = {r["level"]: r["count"] for r in counts.groupBy(level.alias("level")).count().collect()}  # 63 rows at most
    least, total = max(sizes, default=0) + 1, 0
    while least - 1 >= 0 and total + sizes.get(least - 1, 0) <= most:
        least -= 1
        total += sizes.get(least, 0)
    frequent = counts.where(level >= least).toArrow()  # ``most`` rows
    pairs = frequent["pair"].to_numpy()
    order = np.argsort(pairs)
    held = spark.sparkContext.broadcast((pairs[order], frequent["n"].to_numpy()[order], frequent["best"].to_numpy().astype(np.int64)[order]))

    key = uuid.uuid4().hex

    @F.pandas_udf(", ".join(f"{c} bigint" for c in STATS) + ", groups string, rest array<bigint>")
    def scored(texts: pd.Series) -> pd.DataFrame:
        own = aligner(files)
        if key not in _scores:
            _scores.clear()
            _scores[key] = Scores(own, *held.value)
        return _scores[key].texts(texts.tolist(), whole)

    keep = [c for c in docs.columns if c != text]
    made = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), scored(F.col(text)).alias("made"))
    if least > 0:
        made = cut(made.withColumn("at", F.monotonically_increasing_id()), "aligned")
        other = made.select("at", F.explode("made.rest").alias("pair")).groupBy("at", "pair").agg(F.count(F.lit(1)).alias("times"))
        found = other.join(counts.where(level < least), "pair").groupBy("at").agg(F.sum(F.col("n") * F.col("times")).alias("more"), F.sum(F.col("best").cast("bigint") * F.col("times")).alias("more_best"))
        add = lambda c, more: (F.col(f"made.{c}") + F.coalesce(more, F.lit(0))).alias(c)
        return made.join(found, "at", "left").select("doc.*", *[f"made.{c}" for c in STATS[:4]], add("n_best", "more_best"), add("count_sum", "more"), "made.groups")
    return made.select("doc.*", *[f"made.{c}" for c in STATS], "made.groups")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align(docs, pair_counts(docs), whole=False).withColumnRenamed("groups", "groups_sha256")
