"""Word-piece token counts by a linear longest-match automaton.

A trie over the vocabulary holds initial pieces and, under a second root, continuing pieces. Each node
has a failure link, to where reading goes on once the longest match below it is taken, and the number
of tokens popped on the way. A word is read once, character by character; its count is the sum of the
pops, and no piece is ever built. Words that no sequence of longest matches covers count one unknown.

Defined results: a null or blank text has no words and no tokens. Repeated rows, ties and further
columns have no influence.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexus.session import ship, table

#: Words a worker remembers before it starts anew, none above MEMO_BYTES; this bounds memory, not results.
MEMO, MEMO_BYTES = 400_000, 64


class Automaton:
    """``initial`` pieces start a word, ``continuing`` ones (without a mark) go on."""

    def __init__(self, initial: Iterable[str], continuing: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]  # 0: the start of a word, 1: between pieces
        whole = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                if not piece:
                    continue
                node = root
                for c in piece:
                    node = self.next[node].setdefault(c, len(self.next))
                    if node == len(self.next):
                        self.next.append({})
                        whole.append(False)
                whole[node] = True
        self.fail = [-1] * len(self.next)
        self.pops = [0] * len(self.next)
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                if whole[v]:
                    self.fail[v], self.pops[v] = 1, 1
                else:
                    z, n = self.fail[u], self.pops[u]
                    while z >= 0 and c not in self.next[z]:
                        n += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.next[z][c], n
                queue.append(v)

    def count(self, word: str) -> int:
        """Tokens of a word by greedy longest match; 0: no such match covers it."""
        node, n = 0, 0
        nxt, fail, pops = self.next, self.fail, self.pops
        for c in word:
            while c not in nxt[node]:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = nxt[node][c]
        while node != 1:
            n += pops[node]
            node = fail[node]
            if node < 0:
                return 0
        return n


def read_vocabulary(file: str) -> tuple[list[str], list[str]]:
    """Initial and continuing pieces of a byte-level vocabulary, as the byte letters it is written in.

    A token with a leading blank starts a word; the others go on.
    """
    with open(file, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    blank = "Ġ"  # the letter of byte 32
    first = [t[1:] for t in vocab if t.startswith(blank) and blank not in t[1:]]
    more = [t for t in vocab if blank not in t]
    return first, more


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Counter:
    def __init__(self, file: str):
        self.automaton = Automaton(*read_vocabulary(file))
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the bytes that are their own letter
        rest = iter(range(256, 512))
        self.letters = [chr(b) if b in own else chr(next(rest)) for b in range(256)]
        self.memo: dict[bytes, int] = {}

    def word(self, word: bytes) -> int:
        n = self.memo.get(word)
        if n is None:
            n = self.automaton.count("".join([self.letters[b] for b in word]))
            if len(word) <= MEMO_BYTES:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[word] = n
        return n

    def text(self, text: str | None) -> tuple[int, int, int]:
        """Words, tokens (an unknown word is one) and unknown words."""
        words = text.encode("utf-8", "replace").split() if text else []
        counts = list(map(self.word, words))
        unknown = counts.count(0)
        return len(words), sum(counts) + unknown, unknown


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, text: str = "text", file: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of each whole text."""
    ship(docs.sparkSession)

    @F.pandas_udf("n_words bigint, n_tokens bigint, n_unknown bigint")
    def counted(texts: pd.Series) -> pd.DataFrame:
        name = file or default_vocabulary()
        if name not in _counters:
            _counters[name] = Counter(name)
        rows = [_counters[name].text(t) for t in texts]
        return pd.DataFrame(rows, columns=["n_words", "n_tokens", "n_unknown"])

    return docs.select("doc_id", counted(F.col(text)).alias("c")).select("doc_id", "c.*")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
