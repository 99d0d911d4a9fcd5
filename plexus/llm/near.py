"""Near-duplicate documents by HyperMinHash.

Every distinct word shingle falls into one of ``REGISTERS`` buckets by its hash; a bucket keeps, of its
smallest hash, the number of leading zeros and ten bits that follow. Equal bands of registers propose
pairs; the collision-corrected share of equal registers screens them; the full sets confirm.

No pairs are formed within bands. Each band elects as leader the document that shares most bands with
others, every other member is tried against it, and the links found so far name components. What is left
are documents of different components that share a band. Two sets this similar share one of their rarest
members, of which few are held in common by texts that merely follow one template; so only those pairs
of a band's group that do are tried (an exact bound: no link is lost). Rare members that many texts hold
nevertheless gather these texts in groups that are compared block by block: pairs that share no band are
passed over, the estimate screens the rest, products of incidence matrices give the exact intersections,
and only links that join components come back. So every pair of different texts that shares a band is
confirmed, refuted, or already in one component.

Defined results: a null or blank text has no shingles, is linked with nothing and stays. A text of fewer
words than a shingle is one shingle. Texts are what is linked: rows of a null or a repeated identifier
have nothing to do with each other unless their texts are alike. A null identifier comes after every
number where the smallest one is sought. Further columns have no influence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexus.components import components
from plexus.session import cut, drop, ship, table

#: 48 bands of 6: of pairs with a similarity of 0.8 one in two million shares none.
BANDS, ROWS = 48, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Rare members give their pairs one by one up to this many; the texts of the others are compared block by block.
PAIRS = 4096
#: Texts of a block, and set members of a block, about.
BLOCK, BLOCK_MEMBERS = 512, 2_000_000
#: Words a worker remembers before it starts anew, none above MEMO_BYTES; this bounds memory, not results.
MEMO, MEMO_BYTES = 100_000, 64
U = np.uint64
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=U)


_SALTS = np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        out = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[word] = out
        return out


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words."""
    n = len(words)
    if not n:
        return np.zeros(0, U)
    h = np.fromiter(map(_hashes.__getitem__, words), U, n)
    k = min(n, width)
    s = np.zeros(n - k + 1, U) + U(n if n < width else 0)
    for j in range(k):
        s = _mix(s * _MULT[0] + h[j : n - k + 1 + j])
    return np.unique(s)


def copies_of(n: int) -> int:
    """How many differently salted hashes each of n shingles gets, so that small sets fill their buckets too."""
    for least, t in ((1200, 1), (300, 4), (75, 16), (19, 64)):
        if n >= least:
            return t
    return 256


def all_copies(n: int) -> list[int]:
    """The set's own number and, where a linked set of four fifths of its size has another one, that too."""
    return sorted({copies_of(n), copies_of(-(-4 * n // 5))})


def registers(s: np.ndarray, copies: int) -> np.ndarray:
    """Compressed registers of a set of hashes; 0 marks an empty bucket.

    Salting every member gives a set of ``copies`` times the size and the same similarities.
    """
    x = _mix((s[None, :] + _SALTS[:copies, None]) * _MULT[1]).reshape(-1)
    bucket = (((x >> U(48)) * U(REGISTERS)) >> U(16)).astype(np.int64)
    low = np.full(REGISTERS, (1 << 48) - 1, U)
    np.minimum.at(low, bucket, x & U((1 << 48) - 1))
    used = np.zeros(REGISTERS, bool)
    used[bucket] = True
    bits = np.frexp(low.astype(np.float64))[1].astype(U)
    zeros = np.minimum(U(48) - bits, U(62))
    mantissa = ((low << (U(48) - bits)) >> U(47 - MANTISSA)) & U((1 << MANTISSA) - 1)
    return np.where(used, ((zeros + U(1)) << U(MANTISSA)) | mantissa, U(0)).astype(np.uint16)


def bands(regs: np.ndarray, copies: int) -> np.ndarray:
    """One 64-bit key for each band; 0 for an empty one."""
    r = regs.reshape(BANDS, ROWS).astype(U)
    key = (np.arange(1, BANDS + 1, dtype=U) + U(1000 * copies)) * _MULT[5]
    for j in range(ROWS):
        key = _mix(key + r[:, j] * _MULT[j])
    return np.where(r.any(axis=1), key, U(0)).view(np.int64)


def band_keys(s: np.ndarray) -> np.ndarray:
    if not len(s):
        return np.zeros(0, np.int64)
    keys = np.concatenate([bands(registers(s, t), t) for t in all_copies(len(s))])
    return keys[keys != 0]


def _words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []  # bytes: only A-Z are lowered, only ASCII space splits


def _lists(arrays: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.zeros(0), kind))


def _slices(batches: Iterator[pa.RecordBatch], most: int = 8_000_000) -> Iterator[tuple[pa.Array, list]]:
    """Identifiers and texts of a batch, about ``most`` bytes of text at a time."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        start, size = 0, 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
        for i, n in enumerate(lengths):
            size += n
            if size >= most or i == len(lengths) - 1:
                yield ids.slice(start, i + 1 - start), texts.slice(start, i + 1 - start).to_pylist()
                start, size = i + 1, 0


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """(id, raw, n_shingles, digest, keys): set size, digest of the word sequence, band keys."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _slices(batches):
            n, raw, digest, keys = [], [], [], []
            for t in texts:
                w = _words(t)
                s = shingles(w, width)
                n.append(len(s))
                raw.append(hashlib.sha256(t or b"").digest())
                digest.append(hashlib.blake2b(b" ".join(w), digest_size=16).digest())
                keys.append(band_keys(s))
            yield pa.RecordBatch.from_arrays([ids, pa.array(raw, pa.binary()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), _lists(keys, pa.int64())], ["id", "raw", "n_shingles", "digest", "keys"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"id {kind}, raw binary, n_shingles bigint, digest binary, keys array<bigint>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, copies, registers, keys, members): registers, band keys and the whole set of shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _slices(batches):
            sets = [shingles(_words(t), width) for t in texts]
            regs = [registers(s, copies_of(len(s))).astype(np.int32) for s in sets]
            kinds = pa.array([copies_of(len(s)) for s in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([ids, kinds, _lists(regs, pa.int32()), _lists([band_keys(s) for s in sets], pa.int64()), _lists([s.view(np.int64) for s in sets], pa.int64())], ["id", "copies", "registers", "keys", "members"])

    return docs.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "id bigint, copies int, registers array<int>, keys array<bigint>, members array<bigint>")


def estimate(a: Column, b: Column, n_a: Column, n_b: Column) -> tuple[Column, Column]:
    """Collision-corrected Jaccard estimate of two register arrays, and the registers it rests on."""
    both = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), F.lit(0)).when(x == y, F.lit(1001)).otherwise(F.lit(1)))
    total = F.aggregate(both, F.lit(0), lambda s, x: s + x)
    equal, used = F.floor(total / 1000), F.greatest(total % 1000, F.lit(1))
    ratio = F.greatest(n_a, n_b) / F.greatest(F.least(n_a, n_b), F.lit(1))
    chance = 0.169919487159739 * 4 * ratio / ((1 + ratio) * (1 + ratio)) / (1 << MANTISSA)
    return (equal / used - chance) / (1 - chance), used


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, by_band: bool = False) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union, screened by estimate first.

    by_band: pairs that share no band are passed over too.
    """
    side = lambda x: sets.select(F.col("id").alias(x), F.col("copies").alias(f"k_{x}"), F.col("registers").alias(f"r_{x}"), F.col("members").alias(f"m_{x}"), *[F.col("keys").alias(f"b_{x}")] * by_band)
    n = lambda x: F.size(f"m_{x}")
    guess, used = estimate(F.col("r_a"), F.col("r_b"), n("a"), n("b"))
    share = percent / 100
    likely = guess >= share - 6 * F.sqrt(share * (1 - share) / used)  # six standard deviations below
    likely |= F.col("k_a") != F.col("k_b")  # registers of two kinds do not compare
    if by_band:
        likely &= F.arrays_overlap("b_a", "b_b")
    sized = 100 * F.least(n("a"), n("b")) >= percent * F.greatest(n("a"), n("b"))
    common = F.size(F.array_intersect("m_a", "m_b"))
    linked = 100 * common >= percent * (n("a") + n("b") - common)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(sized & likely & linked).select("a", "b").distinct()


def rare_members(held: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(grp, token, cls, label, n, own) of (cls, label, grp): the members by which a set finds its like.

    With all members ordered from rare to common, a set of n and one of at most n linked with it share
    one of the first n - ceil(p n) + 1 members of the larger and, marked ``own``, the first
    n - ceil(2 p n / (1 + p)) + 1 of the smaller, p being the least similarity. Members that no other
    set holds come first and are left out.
    """
    each = held.join(sets.select(F.col("id").alias("cls"), "members"), "cls").select("grp", "cls", "label", F.size("members").alias("n"), F.explode("members").alias("token"))
    each = cut(each, "near-each")
    often = cut(each.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "near-often")
    listed = each.join(often, "token").groupBy("cls").agg(F.first("grp").alias("grp"), F.first("label").alias("label"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("often", "token"))).alias("l"))
    alone = F.col("n") - F.size("l")
    probe = F.expr(f"n - ({percent} * n + 99) div 100 + 1") - alone
    own = F.expr(f"n - ({2 * percent} * n + {99 + percent}) div {100 + percent} + 1") - alone
    listed = listed.withColumns({"probe": probe, "first_own": own}).where("probe > 0")
    found = listed.select("grp", "cls", "label", "n", "first_own", F.posexplode(F.expr("slice(l, 1, CAST(probe AS INT))")).alias("at", "t"))
    found = cut(found.select("grp", "t.token", "cls", "label", "n", (F.col("at") < F.col("first_own")).alias("own")), "near-rare")
    drop(each, often)
    return found


def by_rare_members(held: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between texts (cls, label, grp) of one group that share a band and differ in label."""
    found = rare_members(held, sets, percent)
    size = F.count(F.lit(1)) * F.count_if("own")
    postings = found.groupBy("grp", "token").agg(size.alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("cls").alias("first")).where("lo <> hi and size > 0")
    postings = cut(postings.select("grp", "token", "size", "first"), "near-postings")
    few = found.join(postings.where(F.col("size") <= PAIRS).select("grp", "token"), ["grp", "token"])
    x = few.select("grp", "token", F.col("cls").alias("x"), F.col("label").alias("lx"), F.col("n").alias("nx"))
    y = few.where("own").select("grp", "token", F.col("cls").alias("y"), F.col("label").alias("ly"), F.col("n").alias("ny"))
    pairs = x.join(y, ["grp", "token"]).where(f"lx <> ly and ny <= nx and 100 * ny >= {percent} * nx")
    pairs = cut(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "near-pairs")
    links = confirm(pairs, sets, percent, by_band=True)
    many = found.join(postings.where(F.col("size") > PAIRS).select("grp", "token", "first"), ["grp", "token"]).select("cls", "label", "n", "first").distinct()
    many = cut(many, "near-many")
    if many.isEmpty():
        out = cut(links, "near-links")
        drop(found, postings, pairs, many)
        return out
    group = components(many.select(F.col("cls").alias("u"), F.col("first").alias("v"))).select(F.col("node").alias("cls"), F.col("component").alias("grp"))
    rest = cut(many.select("cls", "label", "n").distinct().join(group, "cls"), "near-rest")
    sizes = rest.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_MEMBERS)).cast("int").alias("blocks"))
    out = cut(links.unionAll(_blocked(rest.join(sizes, "grp"), sets, percent)), "near-links")
    drop(found, postings, pairs, many, rest)
    return out


def common(left: list[np.ndarray], right: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, by products of incidence matrices."""
    sizes = [len(x) for x in (*left, *right)]
    row = np.repeat(np.arange(len(sizes)), sizes)
    value, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    n = len(left)
    both = (np.bincount(column[row < n], minlength=len(value)) > 0) & (np.bincount(column[row >= n], minlength=len(value)) > 0)
    number = np.cumsum(both) - 1
    keep = both[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, len(right)), np.float64)
    for at in range(0, int(both.sum()), width):
        lo, hi = np.searchsorted(column, (at, at + width))
        m = np.zeros((len(sizes), width), np.float32)
        m[row[lo:hi], column[lo:hi] - at] = 1
        out += m[:n] @ m[n:].T
    return out.astype(np.int64)


def _spanning(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Of links a-b between components x and y, those that join what is not joined yet."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.get(v, v) != v:
            root[v] = v = root.get(root[v], root[v])
        return v

    found = []
    _, first = np.unique(np.stack([x, y]), axis=1, return_index=True)
    for i in first:
        p, q = find(int(x[i])), find(int(y[i]))
        if p != q:
            root[max(p, q)] = min(p, q)
            found.append((min(int(a[i]), int(b[i])), max(int(a[i]), int(b[i]))))
    return found


def _block_links(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links of different components between two blocks of (cls, label, copies, registers, keys, members)."""
    sets = [[np.asarray(m).view(U) for m in side["members"]] for side in (left, right)]
    open_ = common(list(left["keys"]), list(right["keys"])) > 0
    label = [side["label"].to_numpy() for side in (left, right)]
    open_ &= label[0][:, None] != label[1][None, :]
    n = [np.array([len(s) for s in side]) for side in sets]
    open_ &= 100 * np.minimum.outer(n[0], n[1]) >= percent * np.maximum.outer(n[0], n[1])
    p, q = np.nonzero(open_)
    if not len(p):
        return []
    # Screening by the collision-corrected estimate, where both have registers of one kind.
    kind = [side["copies"].to_numpy() for side in (left, right)]
    regs = [np.stack(list(side["registers"])) for side in (left, right)]
    share, likely = percent / 100, np.zeros(len(p), bool)
    chance = 0.169919487159739 / (1 << MANTISSA)  # the largest collision share
    for at in range(0, len(p), 20_000):
        i, j = p[at : at + 20_000], q[at : at + 20_000]
        x, y = regs[0][i], regs[1][j]
        used = np.maximum(((x != 0) | (y != 0)).sum(1), 1)
        guess = (((x == y) & (x != 0)).sum(1) / used - chance) / (1 - chance)
        likely[at : at + 20_000] = (guess >= share - 6 * np.sqrt(share * (1 - share) / used)) | (kind[0][i] != kind[1][j])
    p, q = p[likely], q[likely]
    if not len(p):
        return []
    rows, cols = np.unique(p), np.unique(q)
    both = common([sets[0][i] for i in rows], [sets[1][j] for j in cols])[np.searchsorted(rows, p), np.searchsorted(cols, q)]
    linked = 100 * both >= percent * (n[0][p] + n[1][q] - both)
    p, q = p[linked], q[linked]
    if not len(p):
        return []
    return _spanning(left["cls"].to_numpy()[p], right["cls"].to_numpy()[q], label[0][p], label[1][q])


def _blocked(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within groups of (grp, cls, label, blocks) of any size, block against block."""
    rows = members.withColumn("_b", F.pmod(F.xxhash64("cls"), "blocks").cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("grp", "cls", "label", "_b", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j")).join(sets.withColumnRenamed("id", "cls"), "cls")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["_b"] == pdf["_i"].iat[0]], pdf[pdf["_b"] == pdf["_j"].iat[0]]
        found = _block_links(left, right, percent) if len(left) and len(right) else []
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.groupBy("grp", "_i", "_j").applyInPandas(compare, "a bigint, b bigint")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with id, which orders null last, and raw, the hash of the text as it stands."""
    ident = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("value"))
    return docs.withColumns({"id": ident, "raw": F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))})


def classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(id, raw, n_shingles, component, kept) of every row of ``docs`` (doc_id, text).

    ``component`` is the smallest identifier reachable over links of at least ``percent`` similarity, ``kept``
    marks the one row that stays of a component. Nodes are texts, whatever identifiers their rows have.
    ``id`` and ``component`` are (none, value), so that any number and null are told apart; see :func:`number`.
    """
    docs = _keyed(docs).select("id", "raw", "text")
    rows = cut(sketch(docs, width).withColumn("row", F.monotonically_increasing_id()), "near-rows")
    least = rows.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct("id", "raw", "row")).alias("best"))
    # Numbers of the texts hold from here on, since they are read from the files.
    same = cut(least.withColumn("cls", F.monotonically_increasing_id()), "near-texts")
    named = cut(rows.select("id", "raw", "row", "n_shingles", "digest").join(same.select("digest", "cls"), "digest", "left").drop("digest"), "near-classes")

    # Bands in which more than one text meets; each text is there once.
    once = rows.select("row", "keys").join(same.select("cls", F.col("best.row").alias("row")), "row")
    spread = once.select(F.explode("keys").alias("key"), "cls")
    shared = spread.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("key")
    members = cut(spread.join(shared, "key").distinct(), "near-members")

    # Leaders, and every member against its leader.
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    weight = members.join(sizes, "key").groupBy("cls").agg(F.sum("size").alias("weight"))
    leaders = members.join(weight, "cls").groupBy("key").agg(F.max(F.struct("weight", (-F.col("cls")).alias("minus"))).alias("best")).select("key", (-F.col("best.minus")).alias("leader"))
    tried = cut(members.join(leaders, "key").where("cls <> leader").select(F.least("cls", "leader").alias("a"), F.greatest("cls", "leader").alias("b")).distinct(), "near-tried")
    wanted = members.select("cls").distinct().join(same, "cls").select("cls", "best.id", "best.raw")
    # Rows that repeat both identifier and text give their text once.
    texts = docs.join(wanted, ["id", "raw"]).groupBy("cls").agg(F.first("text").alias("text"))
    sets = cut(full_sets(texts.select(F.col("cls").alias("id"), "text"), width), "near-sets")
    links = cut(confirm(tried, sets, percent), "near-links")

    # Members of different components that still share a band.
    label = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    at = members.join(label, members["cls"] == label["node"], "left").select("key", "cls", F.coalesce("component", "cls").alias("label"))
    at = cut(at, "near-labels")
    # Bands of two are tried already; what larger ones hold together is compared as one group.
    open_ = at.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("cls").alias("first")).where("lo <> hi and size > 2").select("key", "first")
    rest = at.join(open_, "key").select("cls", "label", "first").distinct()
    rest = cut(rest, "near-rest")
    group = components(rest.select(F.col("cls").alias("u"), F.col("first").alias("v"))).select(F.col("node").alias("cls"), F.col("component").alias("grp"))
    held = cut(rest.select("cls", "label").distinct().join(group, "cls"), "near-groups")
    links2 = by_rare_members(held, sets, percent)
    final = components(links.unionAll(links2).select(F.col("a").alias("u"), F.col("b").alias("v")))
    at_last = same.join(final, same["cls"] == final["node"], "left").select("cls", "best", F.coalesce("component", "cls").alias("grp"))
    at_last = cut(at_last, "near-last")
    stays = at_last.groupBy("grp").agg(F.min("best").alias("first"))
    place = at_last.join(stays, "grp").select("cls", "first")
    out = named.join(place, "cls", "left").select("id", "raw", "n_shingles", F.coalesce("first.id", "id").alias("component"), F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"))
    out = cut(out, "near-out")
    drop(rows, same, named, members, tried, sets, links, at, rest, held, links2, at_last)
    return out


def number(ident: str) -> Column:
    """The number of an identifier (none, value); null where it is none."""
    return F.when(~F.col(f"{ident}.none"), F.col(f"{ident}.value"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"), width=4)
    return found.select(number("id").alias("doc_id"), "n_shingles", number("component").alias("component_id"), "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: of the smallest identifier and, where several texts have it, the least hash."""
    found = classes(docs, width=5)
    stays = found.groupBy("id", "raw").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("size")).where("kept")
    stays = cut(stays.select("id", "raw", F.expr("n > 1 and size > 0").alias("again")), "near-stays")
    held = _keyed(docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text"))
    alone = held.join(stays.where("not again"), ["id", "raw"], "left_semi").select("doc")
    # Rows alike in identifier and text: the one whose other columns come first.
    again = held.join(stays.where("again"), ["id", "raw"], "left_semi").groupBy("id", "raw").agg(F.min_by("doc", F.to_json("doc")).alias("doc")).select("doc")
    return alone.unionAll(again).select("doc.*")
