"""FLAC media columns: 8-bit mono streams written and read in whole batches.

All frames of a batch are decoded in lockstep: one step reads the next Rice code of every frame, with
the frames ordered by length so that those still running are a prefix. Residuals then go through the
fixed or linear predictors. Header and frame checksums, and the stream's MD5, are verified; a damaged
stream raises :class:`Damaged`. A seek table names the byte and sample offset of every frame, and
decoded PCM comes as blocks with their sample offsets.

Defined results: a null text equals the empty one; a payload is the text's UTF-8 bytes and zero bytes
up to a positive multiple of 64. Repeated rows give equal streams. Further columns have no influence.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexus.session import ship, table

BLOCK, RATE, UNIT = 4096, 8000, 64
#: Bytes of payload worked on at a time (a longer stream is one piece).
PIECE = 8_000_000
SHIFT, PRECISION = 6, 9


class Damaged(ValueError):
    """A stream that breaks the format or fails a checksum."""


def _crc_table(poly: int, bits: int) -> list[int]:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly) & mask if c & top else (c << 1) & mask
        out.append(c)
    return out


_CRC8 = _crc_table(0x07, 8)
_ONE = np.array(_crc_table(0x8005, 16), np.uint16)
_all = np.arange(65536, dtype=np.uint32)
_first = _ONE[_all >> 8].astype(np.uint32)
_TWO = (((_first << 8) & 0xFF00) ^ _ONE[((_first >> 8) ^ (_all & 0xFF)) & 0xFF]).astype(np.int64)
_CLZ = (16 - np.frexp(np.arange(65536, dtype=np.float64))[1]).astype(np.int64)


def _crc8(head: bytes) -> int:
    c = 0
    for b in head:
        c = _CRC8[c ^ b]
    return c


def crc16(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of many stretches at once, two bytes a step, all ending together."""
    order = np.argsort(-length, kind="stable")
    s, n = start[order].astype(np.int64), length[order].astype(np.int64)
    crc = np.zeros(len(s), np.int64)
    odd = (n & 1) == 1
    crc[odd] = _ONE[buf[s[odd]]]
    at, pairs = s + (n & 1), n >> 1
    words = np.ndarray((len(buf) - 1,), ">u2", buf, strides=(1,))
    most = int(pairs[0]) if len(pairs) else 0
    live = np.searchsorted(-pairs, -np.arange(most, 0, -1), side="right")
    for t in range(most):
        k = live[t]
        crc[:k] = _TWO[crc[:k] ^ words[at[:k]]]
        at[:k] += 2
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _utf8_number(v: int) -> bytes:
    if v < 0x80:
        return bytes([v])
    n = next(k for k in range(2, 8) if v < 1 << (5 * k + 1))
    lead = (0xFF << (8 - n)) & 0xFF if n < 7 else 0xFE
    return bytes([lead | (v >> (6 * (n - 1)))] + [0x80 | ((v >> (6 * k)) & 0x3F) for k in range(n - 2, -1, -1)])


def _frame_head(number: int, n: int) -> bytes:
    own = n != BLOCK
    head = bytes([0xFF, 0xF8, 0x70 if own else 0xC0, 0x02]) + _utf8_number(number) + (struct.pack(">H", n - 1) if own else b"")
    return head + bytes([_crc8(head)])


def _candidates(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Residuals of each frame [f, n] by fixed order 0, 1, 2 and by a second-order linear predictor."""
    f = x.astype(np.float64)
    r0, r1, r2 = (f * f).mean(1), (f[:, 1:] * f[:, :-1]).mean(1), (f[:, 2:] * f[:, :-2]).mean(1)
    det = r0 * r0 - r1 * r1
    safe = np.where(det > 1e-9, det, 1)
    a1, a2 = np.where(det > 1e-9, (r0 * r1 - r1 * r2) / safe, 0), np.where(det > 1e-9, (r0 * r2 - r1 * r1) / safe, 0)
    most = (1 << (PRECISION - 1)) - 1
    coefs = np.clip(np.rint(np.stack([a1, a2], 1) * (1 << SHIFT)), -most, most).astype(np.int32)
    d1 = x[:, 1:] - x[:, :-1]
    lpc = x[:, 2:] - ((coefs[:, :1] * x[:, 1:-1] + coefs[:, 1:] * x[:, :-2]) >> SHIFT)
    return [x, d1, d1[:, 1:] - d1[:, :-1], lpc], coefs


def _subframes(x: np.ndarray) -> list[bytes]:
    """The subframe of each of the frames [f, n] (int32), padded to whole bytes."""
    f, n = x.shape
    out: list[bytes] = [b""] * f
    same = (x == x[:, :1]).all(1)
    for i in np.flatnonzero(same):
        out[i] = bytes([0x00, int(x[i, 0]) & 0xFF])
    rest = np.flatnonzero(~same)
    if not len(rest):
        return out
    if n < 16:
        for i in rest:
            out[i] = b"\x02" + x[i].astype(np.int8).tobytes()
        return out
    residuals, coefs = _candidates(x[rest])
    choice = np.stack([np.abs(r).sum(1) for r in residuals], 1).argmin(1)
    for kind in range(4):
        rows = np.flatnonzero(choice == kind)
        if len(rows):
            order = min(kind, 2)
            made = _coded(x[rest[rows]], residuals[kind][rows], order, coefs[rows] if kind == 3 else None)
            for i, b in zip(rest[rows], made, strict=True):
                out[i] = b if len(b) < n + 1 else b"\x02" + x[i].astype(np.int8).tobytes()
    return out


def _coded(x: np.ndarray, r: np.ndarray, order: int, coefs: np.ndarray | None) -> list[bytes]:
    f, n = x.shape
    parts = next(p for p in (3, 2, 1, 0) if n % (1 << p) == 0 and (n >> p) > order)
    size = n >> parts
    u = np.where(r < 0, -2 * r - 1, 2 * r)
    part = np.arange(order, n) // size
    starts = np.concatenate(([0], np.arange(size, n, size) - order))
    mean = np.add.reduceat(u, starts, axis=1) / np.diff(np.append(starts, n - order))
    k = np.clip(np.floor(np.log2(mean * 0.7 + 1e-9)), 0, 14).astype(np.int32)
    ks = k[:, part]
    q = u >> ks
    length = q + 1 + ks
    fixed = 8 + 8 * order + (9 + 2 * PRECISION if coefs is not None else 0) + 6
    pos = fixed + np.cumsum(length, axis=1) - length + 4 * (part + 1)
    total = pos[:, -1] + length[:, -1]
    width = int(total.max()) // 32 + 2  # 32-bit words a frame
    fields = np.zeros((f, 64), np.uint8)

    def put(values: np.ndarray, at: int, count: int) -> None:
        for b in range(count):
            fields[:, at + b] = (values >> (count - 1 - b)) & 1

    put(np.full(f, (0x40 | (order - 1) << 1) if coefs is not None else (0x10 | order << 1)), 0, 8)
    for j in range(order):
        put(x[:, j], 8 + 8 * j, 8)
    at = 8 + 8 * order
    if coefs is not None:
        put(np.full(f, PRECISION - 1), at, 4)
        put(np.full(f, SHIFT), at + 4, 5)
        for j in range(2):
            put(coefs[:, j], at + 9 + j * PRECISION, PRECISION)
        at += 9 + 2 * PRECISION
    put(np.full(f, parts), at, 6)  # coding method 00 and the partition order
    # Stop bit and low bits of each residual, and each partition's parameter: sums of disjoint bits.
    unit = np.int64(1)
    low = (unit << ks) | (u & ((unit << ks) - 1))
    base = (np.arange(f, dtype=np.int64) * (32 * width))[:, None]
    starts_of = np.concatenate([(pos + q + base).reshape(-1), (pos[:, starts] - 4 + base).reshape(-1)])
    values = np.concatenate([low.reshape(-1), k.reshape(-1).astype(np.int64)])
    count = np.concatenate([(ks + 1).reshape(-1), np.full(k.size, 4)])
    values <<= 64 - 2 - count - (starts_of & 31)  # two bits less: the sign bit stays free
    where = starts_of >> 5
    size_of = f * width
    high, rest = values >> 30, values & ((unit << 30) - 1)
    words = np.bincount(where, high, size_of) + np.bincount(where + 1, rest << 2, size_of)
    head = np.packbits(fields, axis=1).view(">u4")
    words = words.astype(np.uint32).reshape(f, width)
    words[:, :2] |= head.astype(np.uint32)
    packed = words.astype(">u4").view(np.uint8).reshape(f, 4 * width)
    return [packed[i, : (int(total[i]) + 7) // 8].tobytes() for i in range(f)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """One FLAC stream of signed 8-bit samples (byte - 128) for each payload."""
    cuts = [(d, a, min(BLOCK, len(p) - a)) for d, p in enumerate(payloads) for a in range(0, len(p), BLOCK)]
    by_size: dict[int, list[int]] = {}
    for i, (_, _, n) in enumerate(cuts):
        by_size.setdefault(n, []).append(i)
    subs: list[bytes] = [b""] * len(cuts)
    for n, members in by_size.items():
        for at in range(0, len(members), max(1, 2_000_000 // n)):
            some = members[at : at + max(1, 2_000_000 // n)]
            x = np.frombuffer(b"".join([payloads[cuts[i][0]][cuts[i][1] : cuts[i][1] + n] for i in some]), np.uint8).reshape(len(some), n).astype(np.int32) - 128
            for i, b in zip(some, _subframes(x), strict=True):
                subs[i] = b
    frames = [_frame_head(a // BLOCK, n) + s for (_, a, n), s in zip(cuts, subs, strict=True)]
    lengths = np.array([len(b) for b in frames], np.int64)
    joined = np.frombuffer(b"".join(frames) + b"\0\0", np.uint8)
    crcs = crc16(joined, np.cumsum(lengths) - lengths, lengths)
    frames = [b + struct.pack(">H", int(c)) for b, c in zip(frames, crcs, strict=True)]
    out, at = [], 0
    for p in payloads:
        count = (len(p) + BLOCK - 1) // BLOCK
        own = frames[at : at + count]
        sizes = [min(BLOCK, len(p) - BLOCK * j) for j in range(count)]
        at += count
        md5 = hashlib.md5((np.frombuffer(p, np.uint8) ^ 0x80).tobytes()).digest()
        lens = [len(b) for b in own] or [0]
        info = struct.pack(">HH", BLOCK, BLOCK) + min(lens).to_bytes(3, "big") + max(lens).to_bytes(3, "big") + ((RATE << 44) | (7 << 36) | len(p)).to_bytes(8, "big") + md5
        offset, seek = 0, []
        for j, b in enumerate(own):
            seek.append(struct.pack(">QQH", j * BLOCK, offset, sizes[j]))
            offset += len(b)
        points = b"".join(seek)
        out.append(b"fLaC" + b"\x00" + (34).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + b"".join(own))
    return out


def _metadata(stream: bytes) -> tuple[int, int, bytes, list[tuple[int, int]]]:
    """Start of the frames, number of samples, MD5, and (sample, byte offset) of the seek points."""
    if stream[:4] != b"fLaC":
        raise Damaged("not a FLAC stream")
    at, total, md5, seek, last = 4, None, b"", [], False
    while not last:
        if at + 4 > len(stream):
            raise Damaged("the metadata end early")
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0 and len(body) == 34:
            v = int.from_bytes(body[10:18], "big")
            total, md5 = v & ((1 << 36) - 1), body[18:34]
            if (v >> 36) & 31 != 7 or (v >> 41) & 7:
                raise Damaged("8-bit mono is read here")
        elif kind == 3:
            seek = [(s, o) for s, o, _ in struct.iter_unpack(">QQH", body) if s != (1 << 64) - 1]
    if total is None:
        raise Damaged("no stream information")
    return at, total, md5, seek


_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608} | {c: 256 << (c - 8) for c in range(8, 16)}


def _open(buf: bytes, at: int) -> dict:
    """Reads a frame's header and its subframe up to the residuals."""
    if at + 6 > len(buf) or buf[at] != 0xFF or buf[at + 1] & 0xFE != 0xF8:
        raise Damaged("no frame where one should start")
    code, p = buf[at + 2] >> 4, at + 4
    if buf[at + 3] >> 4 or (buf[at + 3] >> 1) & 7 not in (0, 1):
        raise Damaged("8-bit mono is read here")
    lead = buf[p]
    more = 0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length()
    p += 1 + more
    if code in (6, 7):
        n = int.from_bytes(buf[p : p + code - 5], "big") + 1
        p += code - 5
    else:
        n = _SIZES.get(code, 0)
    p += {12: 1, 13: 2, 14: 2}.get(buf[at + 2] & 15, 0)
    if not n or p + 2 > len(buf) or _crc8(buf[at:p]) != buf[p]:
        raise Damaged("a frame header's checksum is wrong")
    p += 1
    kind = buf[p]
    if kind & 0x81:
        raise Damaged("reserved or wasted bits")
    kind, p = kind >> 1, p + 1
    f = {"at": at, "n": n, "kind": "rice", "order": 0, "warm": (), "coefs": None, "shift": 0}
    if kind == 0:
        return f | {"kind": "constant", "data": p, "end": 8 * (p + 1)}
    if kind == 1:
        return f | {"kind": "verbatim", "data": p, "end": 8 * (p + n)}
    order = kind & 7 if 8 <= kind <= 12 else (kind & 31) + 1 if kind >= 32 else -1
    if order < 0:
        raise Damaged("a reserved kind of subframe")
    warm = [b - 256 if b > 127 else b for b in buf[p : p + order]]
    bit = 8 * (p + order)

    def take(count: int) -> int:
        nonlocal bit
        first = bit >> 3
        v = int.from_bytes(buf[first : first + (count + 14) // 8 + 1].ljust((count + 14) // 8 + 1, b"\0"), "big")
        v = (v >> (8 * ((count + 14) // 8 + 1) - (bit & 7) - count)) & ((1 << count) - 1)
        bit += count
        return v

    signed = lambda v, w: v - (1 << w) if v >> (w - 1) else v
    if kind >= 32:
        width = take(4) + 1
        f["shift"] = signed(take(5), 5)
        f["coefs"] = [signed(take(width), width) for _ in range(order)]
    method, parts = take(2), take(4)
    if method > 1 or n % (1 << parts):
        raise Damaged("a reserved coding of residuals")
    return f | {"order": order, "warm": warm, "wide": 5 if method else 4, "size": n >> parts, "bit": bit}


def _residuals(buf: np.ndarray, frames: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Residuals [step, frame] of frames ordered by their number of residuals, and the bits where they end."""
    count = np.array([f["n"] - f["order"] for f in frames], np.int64)
    p = np.array([f["bit"] for f in frames], np.int64)
    size, order = np.array([f["size"] for f in frames], np.int64), np.array([f["order"] for f in frames], np.int64)
    wide = np.array([f["wide"] for f in frames], np.int64)
    rem, k, raw = np.zeros(len(frames), np.int64), np.zeros(len(frames), np.int64), np.full(len(frames), -1, np.int64)
    next_size = size - order
    words = np.ndarray((len(buf) - 7,), ">u8", buf, strides=(1,))
    most = int(count[0])
    live = np.searchsorted(-count, -np.arange(most), side="left")
    out = np.zeros((most, len(frames)), np.int32)
    one, top, low6 = np.uint64(1), np.uint64(48), np.int64(7)
    any_raw, left, keep = False, 0, 63 - k
    for t in range(most):
        m = live[t]
        if not left:  # some frame may be at a partition's start
            new = np.flatnonzero(rem[:m] == 0)
            while len(new):  # an order as large as the partition leaves the first one empty
                w = words[p[new] >> 3].astype(np.uint64) << (p[new] & 7).astype(np.uint64)
                k[new] = (w >> (64 - wide[new]).astype(np.uint64)).astype(np.int64)
                escape = k[new] == (1 << wide[new]) - 1
                width = ((w << wide[new].astype(np.uint64)) >> np.uint64(59)).astype(np.int64)
                raw[new] = np.where(escape, width, -1)
                p[new] += wide[new] + np.where(escape, 5, 0)
                rem[new] = next_size[new]
                next_size[new] = size[new]
                new = new[rem[new] == 0]
            any_raw = bool((raw[:m] >= 0).any())
            keep = 63 - k
            left = int(rem[:m].min())
            rem[:m] -= left
        pm, km = p[:m], k[:m]
        w = words[pm >> 3].astype(np.uint64)
        w <<= (pm & low6).view(np.uint64)
        q = _CLZ[(w >> top).view(np.int64)]
        if any_raw or q.max() == 16:
            for i in np.flatnonzero((q == 16) | (raw[:m] >= 0)):
                value, end = _slow(buf, int(pm[i]), int(km[i]), int(raw[i]))
                out[t, i], p[i] = value, end
            ok = np.flatnonzero((q < 16) & (raw[:m] < 0))
            w, q, kk = w[ok], q[ok], km[ok]
            u = (q << kk) | (((w << (q + 1).astype(np.uint64)) >> one) >> (63 - kk).astype(np.uint64)).astype(np.int64)
            out[t, ok] = (u >> 1) ^ -(u & 1)
            p[ok] += q + 1 + kk
        else:
            pm += q
            w <<= q.view(np.uint64)  # the stop bit is on top, and goes with the next shift
            w <<= one
            w >>= one
            w >>= keep[:m].view(np.uint64)
            q <<= km
            q |= w.view(np.int64)
            out[t, :m] = (q >> 1) ^ -(q & 1)
            pm += km
            pm += 1
        left -= 1
    return out, p


def _slow(buf: np.ndarray, bit: int, k: int, raw: int) -> tuple[int, int]:
    """One residual read bit by bit: a long unary part, or an unencoded number of ``raw`` bits."""
    get = lambda b: (int(buf[b >> 3]) >> (7 - (b & 7))) & 1
    if raw >= 0:
        v = 0
        for j in range(raw):
            v = v << 1 | get(bit + j)
        return (v - (1 << raw) if raw and v >> (raw - 1) else v), bit + raw
    q = 0
    while not get(bit + q):
        q += 1
        if (bit + q) >> 3 >= len(buf) - 8:
            raise Damaged("residuals run beyond the data")
    u = q
    for j in range(k):
        u = u << 1 | get(bit + q + 1 + j)
    return (u >> 1) ^ -(u & 1), bit + q + 1 + k


def _restore(frames: list[dict], residuals: np.ndarray) -> list[np.ndarray]:
    """Samples of each frame from its warm-up samples and residuals."""
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(frames)
    groups: dict[tuple[bool, int], list[int]] = {}
    for i, f in enumerate(frames):
        groups.setdefault((f["coefs"] is not None, f["order"]), []).append(i)
    for (linear, order), members in groups.items():
        steps = max(frames[i]["n"] for i in members) - order
        r = residuals[:steps, members]
        warm = np.array([frames[i]["warm"] for i in members], np.int32).reshape(len(members), order).T
        if linear:
            x = np.zeros((steps + order, len(members)), np.int32)
            x[:order] = warm
            coefs = np.array([frames[i]["coefs"] for i in members], np.int32).T
            shift = np.array([frames[i]["shift"] for i in members], np.int32)
            back = coefs[::-1].copy()
            sums, part = np.empty_like(shift), np.empty_like(shift)
            for t in range(steps):
                np.multiply(back[0], x[t], out=sums)
                for j in range(1, order):
                    np.multiply(back[j], x[t + j], out=part)
                    sums += part
                sums >>= shift
                np.add(sums, r[t], out=x[t + order])
        else:
            x = r
            for j in range(order, 0, -1):  # the (j-1)-th differences from the j-th
                first = np.diff(warm[:j], n=j - 1, axis=0)
                x = np.cumsum(np.concatenate([first, x]), axis=0, dtype=np.int32)
        for c, i in enumerate(members):
            out[i] = x[: frames[i]["n"], c]
    return out


def _frames(buf: bytes, starts: list[int]) -> tuple[list[np.ndarray], list[int]]:
    """Samples of the frames at the byte offsets, and the offsets behind them; checksums are verified."""
    whole = np.frombuffer(buf, np.uint8)
    opened = [_open(buf, at) for at in starts]
    samples: list[np.ndarray] = [np.zeros(0, np.int32)] * len(opened)
    rice = sorted((i for i, f in enumerate(opened) if f["kind"] == "rice"), key=lambda i: opened[i]["order"] - opened[i]["n"])
    for at in range(0, len(rice), 4096):
        some = rice[at : at + 4096]
        own = [opened[i] for i in some]
        try:
            r, bits = _residuals(whole, own)
        except IndexError:
            raise Damaged("residuals run beyond the data") from None
        for i, x, b in zip(some, _restore(own, r), bits, strict=True):
            samples[i] = x
            opened[i]["end"] = int(b)
    for i, f in enumerate(opened):
        if f["kind"] == "constant":
            samples[i] = np.full(f["n"], np.int8(np.uint8(buf[f["data"]]).astype(np.int8)), np.int32)
        elif f["kind"] == "verbatim":
            samples[i] = np.frombuffer(buf, np.int8, f["n"], f["data"]).astype(np.int32)
    ends = np.array([(f["end"] + 7) // 8 for f in opened], np.int64)
    begins = np.array(starts, np.int64)
    want = np.array([int.from_bytes(buf[e : e + 2], "big") for e in ends], np.int64)
    if len(ends) and (crc16(whole, begins, ends - begins) != want).any():
        raise Damaged("a frame's checksum is wrong")
    return samples, [int(e) + 2 for e in ends]


def decode(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """For each stream its PCM blocks: (sample offset, signed 8-bit samples). All checksums are verified."""
    heads = [_metadata(s) for s in streams]
    buf = b"".join(streams) + b"\0" * 16
    base = np.concatenate(([0], np.cumsum([len(s) for s in streams]))).tolist()
    blocks: list[list[tuple[int, bytes]]] = [[] for _ in streams]
    # With a seek table all frames are known at once; without one the next frame follows the last.
    work = []
    for i, (first, total, _, seek) in enumerate(heads):
        at = [base[i] + first + o for _, o in seek] if seek and seek[0] == (0, 0) and all(b[0] - a[0] == BLOCK for a, b in zip(seek, seek[1:], strict=False)) else [base[i] + first] if total else []
        work += [(i, a) for a in at]
    done = [0] * len(streams)
    while work:
        samples, ends = _frames(buf, [a for _, a in work])
        following = {}
        for (i, _), x, end in zip(work, samples, ends, strict=True):
            if len(x) and (x.min() < -128 or x.max() > 127):
                raise Damaged("a sample beyond 8 bits")
            blocks[i].append((done[i], x.astype(np.int8).tobytes()))
            done[i] += len(x)
            following[i] = end
        work = [(i, end) for i, end in following.items() if done[i] < heads[i][1]]
    for i, (_, total, md5, _) in enumerate(heads):
        pcm = b"".join([b for _, b in blocks[i]])
        if len(pcm) != total or (any(md5) and hashlib.md5(pcm).digest() != md5):
            raise Damaged("the decoded samples differ from the stream's MD5")
    return blocks


def read(blocks: list[tuple[int, bytes]], start: int, count: int) -> bytes:
    """Samples start .. start + count of decoded blocks, found by their sample offsets."""
    return b"".join([b[max(0, start - o) : start + count - o] for o, b in blocks if o < start + count and o + len(b) > start])


def seek(stream: bytes, start: int, count: int) -> bytes:
    """Samples start .. start + count, decoding only the frames that hold them."""
    first, total, _, points = _metadata(stream)
    if not points:
        return read(decode([stream])[0], start, count)
    ends = [s for s, _ in points[1:]] + [total]
    need = [(s, o) for (s, o), e in zip(points, ends, strict=True) if s < start + count and e > start]
    samples, _ = _frames(stream + b"\0" * 16, [first + o for _, o in need])
    return read([(s, x.astype(np.int8).tobytes()) for (s, _), x in zip(need, samples, strict=True)], start, count)


def payload(text: bytes | None) -> bytes:
    text = text or b""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b"\0")


def _flip(pcm: bytes) -> bytes:
    return (np.frombuffer(pcm, np.uint8) ^ 0x80).tobytes()


def feature(pcm: bytes) -> str:
    """Root mean square, zero crossings and peak of signed 8-bit samples, in whole numbers."""
    x = np.frombuffer(pcm, np.int8).astype(np.int64)
    return f"rms={math.isqrt(int((x * x).sum()) // len(x))};zc={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};peak={int(np.abs(x).max())}"


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[bytes | None]]]:
    lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        size += n + UNIT
        if size >= PIECE or i == len(lengths) - 1:
            yield batch.column(0).slice(start, i + 1 - start), batch.column(1).slice(start, i + 1 - start).to_pylist()
            start, size = i + 1, 0


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the payload of each whole text as a FLAC stream."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _pieces(batch):
                media = encode([payload(t) for t in texts])
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, block, sample_offset, pcm): the decoded blocks of each stream of (doc_id, media)."""
    ship(media.sparkSession)
    kind = dict(media.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, streams in _pieces(batch):
                rows = [(i, k, o, b) for i, blocks in zip(ids.to_pylist(), decode(streams), strict=True) for k, (o, b) in enumerate(blocks)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], ids.type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())], ["doc_id", "block", "sample_offset", "pcm"])

    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, block int, sample_offset bigint, pcm binary")


def summarised(media: DataFrame) -> DataFrame:
    """What the decoded samples of (doc_id, n_bytes, media) give, without the samples themselves."""
    ship(media.sparkSession)
    kind = dict(media.dtypes)["doc_id"]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = dict(enumerate(batch.column(2).to_pylist()))
            at = 0
            for ids, streams in _pieces(batch.select([0, 1])):
                rows = []
                for s, blocks in zip(streams, decode(streams), strict=True):
                    total = sum(len(b) for _, b in blocks)
                    pcm = b"".join([b for _, b in blocks])
                    tail = _flip(read(blocks, total - UNIT, UNIT))
                    rows.append((sizes[at], total, hashlib.sha256(_flip(pcm)).hexdigest(), zlib.crc32(tail), len(s), hashlib.sha256(s).hexdigest(), feature(pcm)))
                    at += 1
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    return media.select("doc_id", "media", "n_bytes").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def op7_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarised(store(table(spark, sf_dir, "documents").select("doc_id", "text")))
