"""Byte-pair encoding by forced boundaries, and decoding.

A merge joins two neighbouring pieces into a vocabulary token, so it can only cross a place in a word
whose two bytes stand next to each other inside some token. Pairs of bytes that do so in no token are
forced boundaries: each word is cut there, the fragments are encoded independently, and their ids are
put one after another. Texts are normalised, and split into words, as the tokenizer's file says.

Defined results: a null or empty text has no ids and decodes to the empty text. The special tokens'
own strings in a text become their ids, as in the tokenizers library. Repeated rows, ties and further
columns have no influence.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from operator import add

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexus.session import ship, table

#: Words a worker remembers before it starts anew, none above MEMO_CHARS; this bounds memory, not results.
MEMO, MEMO_CHARS = 100_000, 64
#: Below this code point, but for U+0130, every character is its own NFC form and has one lower-case character.
PLAIN = 0x180


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, k = [""] * 256, 0
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + k)
            k += 1
    return out


class _Memo(dict):
    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        out = self.make(key)
        if len(key if isinstance(key, str) else key[0]) <= MEMO_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[key] = out
        return out


class Encoder:
    def __init__(self, file: str | None = None):
        from tokenizers import Tokenizer, models

        file = file or default_vocabulary()
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout"):
            raise ValueError("a plain BPE vocabulary is needed")
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        # The merges inside a fragment: with the end of a word, and without.
        self.last = models.BPE(vocab=self.vocab, merges=merges, cache_capacity=0, **({"end_of_word_suffix": self.end} if self.end else {}))
        self.inner = models.BPE(vocab=self.vocab, merges=merges, cache_capacity=0)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        # The library's own normaliser and splitter serve texts beyond the plain characters.
        lib = Tokenizer.from_file(file)
        self.normalise = lib.normalizer.normalize_str
        self.split = lib.pre_tokenizer.pre_tokenize_str
        self.letters = byte_alphabet()
        self.joined = self._joined_pairs()
        self.words = _Memo(self._word, MEMO)
        self.fragments = _Memo(self._fragment, MEMO)
        self.by_specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.plain = re.compile(f"[\\x00-\u012f\u0131-{chr(PLAIN - 1)}]*")
        kinds = {k: "".join(re.escape(chr(c)) for c in range(PLAIN) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
        space = r"\t-\r \x85\xa0"
        self.plain_words = re.compile(f"[{kinds['L']}]+|'s|'t|'re|'ve|'m|'ll|'d|[{kinds['N']}]|[^{space}{kinds['L']}{kinds['N']}]+")

    def _joined_pairs(self) -> set[str]:
        """Pairs of neighbouring byte letters that stand inside at least one token."""
        found = set()
        for t in self.vocab:
            t = t.removesuffix(self.end) if self.end else t
            found.update(t[i : i + 2] for i in range(len(t) - 1))
        return found

    def cut(self, word: str) -> list[str]:
        """A word of byte letters, cut at its forced boundaries."""
        if self.joined.issuperset(map(add, word, word[1:])):
            return [word]
        out, start = [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.joined:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def _fragment(self, key: tuple[str, bool]) -> list[int]:
        """The merges of one fragment; key[1]: it ends its word."""
        return [t.id for t in (self.last if key[1] else self.inner).tokenize(key[0])]

    def _ids(self, word: str) -> bytes:
        """Ids of a word of byte letters, little-endian unsigned 32-bit."""
        pieces = self.cut(word)
        if len(pieces) == 1:
            return array("I", self._fragment((word, True))).tobytes()
        out: list[int] = []
        for k, p in enumerate(pieces):
            out.extend(self.fragments[p, k == len(pieces) - 1])
        return array("I", out).tobytes()

    def _word(self, word: str) -> bytes:
        return self._ids("".join([self.letters[b] for b in word.encode("utf-8")]))

    def encode(self, text: str | None) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.by_specials and "<|" in text:
            return b"".join([array("I", [self.special[s]]).tobytes() if s in self.special else self._plain_text(s) for s in self.by_specials.split(text) if s])
        return self._plain_text(text)

    def _plain_text(self, text: str) -> bytes:
        if self.plain.fullmatch(text):
            return b"".join(map(self.words.__getitem__, self.plain_words.findall(text.lower())))
        return b"".join([self._ids(w) for w, _ in self.split(self.normalise(text))])

    def decode(self, ids: bytes) -> str:
        """Tokens of the ids, one blank between them, as this vocabulary without a decoder gives them."""
        return " ".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


_encoders: dict[str, Encoder] = {}


def encoder(file: str | None) -> Encoder:
    """One for each worker process and file."""
    key = file or ""
    if key not in _encoders:
        _encoders[key] = Encoder(file)
    return _encoders[key]


def encode(docs: DataFrame, text: str = "text", out: str = "ids", file: str | None = None) -> DataFrame:
    """Adds the ids of each whole text, packed as little-endian unsigned 32-bit integers."""
    ship(docs.sparkSession)

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        enc = encoder(file)
        return pd.Series([enc.encode(t) for t in texts], dtype=object)

    return docs.withColumn(out, packed(F.col(text)))


def decode(rows: DataFrame, ids: str = "ids", out: str = "decoded", file: str | None = None) -> DataFrame:
    ship(rows.sparkSession)

    @F.pandas_udf("string")
    def unpacked(packs: pd.Series) -> pd.Series:
        enc = encoder(file)
        return pd.Series([enc.decode(bytes(p or b"")) for p in packs], dtype=object)

    return rows.withColumn(out, unpacked(F.col(ids)))


def digests(docs: DataFrame, text: str = "text", file: str | None = None) -> DataFrame:
    """Encodes and decodes each whole text and keeps counts and digests only; no token leaves the worker."""
    ship(docs.sparkSession)

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digested(texts: pd.Series) -> pd.DataFrame:
        enc = encoder(file)
        rows = []
        for t in texts:
            ids = enc.encode(t)
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(enc.decode(ids).encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id"), digested(F.col(text)).alias("d")).select("doc_id", "d.*")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: each row's token count and digests instead of its text."""
    return digests(docs.select("doc_id", "text"))
