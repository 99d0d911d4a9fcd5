"""Benchmark decontamination by Wu-Manber multi-pattern search.

The symbols are words. A benchmark item's windows are its runs of WINDOW words (a shorter item is one
window); windows of one length share a pair of tables. The shift table says for a block of two words how far
the next window end that could hold this block is away, so most positions of a text are never looked at. Where
the shift is 0, the suffix-hash bucket of the block holds the windows that end in it, and the text's words are
compared with them directly.

Benchmark items are dealt to blocks of BLOCK_BYTES, items of any length in overlapping pieces; tables of one
block at a time go to the workers, and each block is searched in all texts. A usual benchmark is one block, and
the texts are read once, without a shuffle. Texts are read whole, in runs of CHUNK bytes that overlap by a window.

Defined results: only A-Z are lowered. A null or empty text, or one without words, has no words and is not
contaminated; an item without words has no windows. Items that repeat an identifier are one item with the
windows of all of them; one without identifier marks words but names no item. Rows that repeat a document's
identifier are documents of their own. Further columns have no influence; with an empty benchmark nothing is hit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexus.functions.ranks import running
from plexus.session import cut, ship, spare_name, table

WINDOW = 10
#: Bytes of benchmark text that are searched at a time, and of a piece of an item.
BLOCK_BYTES, PIECE_BYTES = 1 << 21, 1 << 18
#: Bytes of a text whose words are held at a time.
CHUNK = 1 << 20
#: A-Z become a-z, other bytes below 128 but digits and letters become blanks; bytes above are parts of words.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def runs(text: bytes, size: int, keep: int) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first word, words) of pieces of a text; each starts with ``keep`` words of the one before."""
    if len(text) <= size:
        yield 0, words(text)
        return
    text, at, first, held = text.translate(_LOWER), 0, 0, []
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        held = held + text[at:end].split()
        yield first, held
        first += max(0, len(held) - keep)
        held = held[-keep:] if keep else []
        at = end


class Table:
    """Shifts and buckets of the windows of one length."""

    def __init__(self, length: int):
        self.length, self.width = length, min(2, length)
        self.most = length - self.width + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, dict[bytes, tuple[str, ...]]] = {}

    def add(self, window: list[bytes], item: str | None) -> None:
        for end in range(self.width, self.length + 1):
            block = b" ".join(window[end - self.width : end])
            self.shift[block] = min(self.shift.get(block, self.most), self.length - end)
        own = self.bucket.setdefault(block, {})
        text = b" ".join(window)
        known = own.get(text, ())
        if item is None or item not in known:
            own[text] = known if item is None else (*known, item)

    def search(self, text: list[bytes]) -> Iterator[tuple[int, tuple[str, ...]]]:
        """(last word, items) of every occurrence of a window, by rising place."""
        at, n, length, most = self.length - 1, len(text), self.length, self.most
        shift, pair = self.shift.get, self.width == 2
        while at < n:
            block = text[at - 1] + b" " + text[at] if pair else text[at]
            step = shift(block, most)
            if step:
                at += step
                continue
            items = self.bucket[block].get(b" ".join(text[at + 1 - length : at + 1]))
            if items is not None:
                yield at, items
            at += 1


class Patterns:
    """Tables of a block's pieces: (item, text, whether the piece is a whole item)."""

    def __init__(self, pieces: list[tuple[str | None, bytes]], window: int):
        self.window = window
        self.tables: dict[int, Table] = {}
        for item, text in dict.fromkeys(pieces):
            w = words(text)
            length = min(window, len(w))
            if length:
                table_ = self.tables.setdefault(length, Table(length))
                for at in range(len(w) - length + 1):
                    table_.add(w[at : at + length], item)

    def find(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, merged spans of hit words (first and last), and the items found, sorted."""
        n, spans, items = 0, [], set()
        for first, held in runs(text or b"", CHUNK, self.window - 1):
            n = first + len(held)
            for t in self.tables.values():
                open_ = None
                for at, found in t.search(held):
                    items.update(found)
                    lo, hi = first + at + 1 - t.length, first + at
                    if open_ is not None and lo <= open_[1] + 1:
                        open_[1] = hi
                    else:
                        open_ = [lo, hi]
                        spans.append(open_)
        return n, merged(spans), sorted(items)


def merged(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(map(tuple, spans)):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(s) for s in out]


def pieces(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, size: int = PIECE_BYTES) -> DataFrame:
    """(item, piece, n_bytes): texts of items with words, long ones as pieces that overlap by all but one word of a window."""
    ship(items.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, content in zip(batch["item"], batch["content"], strict=True):
                for _, held in runs(bytes(content), size, window - 1):
                    if held:
                        yield pd.DataFrame({"item": [item], "piece": [b" ".join(held)]})

    rows = items.where(F.col(text).isNotNull()).select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("binary").alias("content"))
    return rows.mapInPandas(run, "item string, piece binary").distinct().withColumn("n_bytes", F.octet_length("piece").cast("bigint"))


#: Of the search that a worker is at.
_patterns: dict[str, Patterns] = {}


def _search(text: Column, held, window: int) -> Column:
    key = uuid.uuid4().hex

    @F.pandas_udf("n_words bigint, spans array<struct<first: bigint, last: bigint>>, items array<string>")
    def found(texts: pd.Series) -> pd.DataFrame:
        if key not in _patterns:
            _patterns.clear()
            _patterns[key] = Patterns(held.value, window)
        rows = [_patterns[key].find(t) for t in texts]
        return pd.DataFrame({"n_words": [r[0] for r in rows], "spans": [[{"first": a, "last": b} for a, b in r[1]] for r in rows], "items": [r[2] for r in rows]})

    return found(text.cast("binary"))


def search(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without their texts, with ``n_words``, ``spans`` (first and last word, from 0, merged) and ``items`` (sorted) found."""
    spark = docs.sparkSession
    ship(spark)
    dealt = cut(running(pieces(items, item_id, window=window, size=min(PIECE_BYTES, block_bytes)), ["piece", "item"], {"before": "n_bytes"}).withColumn("block", F.expr(f"before div {block_bytes}")), "benchmark")
    blocks = [r["block"] for r in dealt.select("block").distinct().orderBy("block").toLocalIterator()] or [0]

    def block(k: int):
        own = dealt.where(F.col("block") == k).select("item", "piece").collect()  # block_bytes and a piece
        return spark.sparkContext.broadcast([(r["item"], bytes(r["piece"])) for r in own])

    keep = [F.col(f"`{c}`") for c in docs.columns if c != text]
    if len(blocks) == 1:
        return docs.select(*keep, _search(F.col(text), block(blocks[0]), window).alias("found")).select(*keep, "found.*")
    # Every block is searched in all texts; what was found in a text is put together by the number of its row.
    row = spare_name("row", docs)
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()), "searched")
    hits = None
    for k in blocks:
        made = cut(rows.select(row, _search(F.col(text), block(k), window).alias("found")).select(row, "found.*"), "found")
        hits = made if hits is None else hits.unionByName(made)
    span = "struct<first: bigint, last: bigint>"
    joined = F.expr(f"""aggregate(spans, CAST(array() AS array<{span}>), (a, s) -> IF(size(a) > 0 AND s.first <= a[size(a) - 1].last + 1,
        concat(slice(a, 1, size(a) - 1), array(named_struct('first', a[size(a) - 1].first, 'last', greatest(a[size(a) - 1].last, s.last)))), concat(a, array(s))))""")
    per = hits.groupBy(row).agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return rows.join(per.withColumn("spans", joined), row).select(*keep, "n_words", "spans", "items")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)
    return search(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
p AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda a: list_slice(w, a, a + 9))) AS g FROM i WHERE len(w) > 0),
l AS (SELECT DISTINCT k FROM p),
t AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
n AS MATERIALIZED (SELECT r, pos, list(word) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS g FROM t),
o AS MATERIALIZED (SELECT n.r, n.pos, p.k, p.item_id FROM n, l JOIN p ON p.k = l.k AND p.g = n.g[1:l.k]),
h AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(pos, pos + k)) AS place FROM (SELECT DISTINCT r, pos, k FROM o)) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM o WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN m USING (r)
"""
