"""FLAC streams in a binary column: encode, decode with all checksums verified, seek.

A stream has one channel of 8-bit samples (a byte less 128). Blocks have BLOCK samples;
each is stored as a constant, verbatim, by a fixed predictor or by a linear predictor
(Levinson-Durbin on the block's autocorrelation, quantised), with Rice-coded residuals in
two partitions. The seek table has a point for every block, so any block can be read
alone. Decoding checks the header's CRC-8, the frame's CRC-16 and the stream's MD5 and
raises on a mismatch.

Rice codes are followed in lockstep: one step finds the next code of every frame of a
slice, so the work of a sample is vectorised over the frames of many rows.

Null media give null samples; an empty text is padded to one unit by `payloads`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

BLOCK = 1152
RATE = 8000
LPC_ORDER = 4
LPC_BITS = 12
UNIT = 192
_SLICE = 1 << 20
#: Fixed values of the format: block sizes that have a code of their own.
_CODES = {192: 1, 576: 2, 1152: 3, 2304: 4, 4608: 5, 256: 8, 512: 9, 1024: 10, 2048: 11, 4096: 12, 8192: 13, 16384: 14, 32768: 15}
_SIZES = {v: k for k, v in _CODES.items()}


class FlacError(ValueError):
    """A stream that isn't valid or that fails a checksum."""


def _crc_rows(poly: int, bits: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << np.uint32(bits - 8)
    top = np.uint32(1 << (bits - 1))
    for _ in range(8):
        table = np.where(table & top, (table << np.uint32(1)) ^ np.uint32(poly), table << np.uint32(1)) & np.uint32((1 << bits) - 1)
    return table.astype(np.uint16)


_CRC8 = _crc_rows(0x07, 8).tolist()
_CRC16 = _crc_rows(0x8005, 16)
_far = _CRC16[None, :].copy()  # row d: the checksum of a byte that d zero bytes follow


def _far_rows(n: int) -> np.ndarray:
    global _far
    while len(_far) < n:
        rows = [_far[-1]]
        for _ in range(len(_far)):
            x = rows[-1]
            rows.append(((x << np.uint16(8)) ^ _CRC16[x >> np.uint16(8)]).astype(np.uint16))
        _far = np.vstack([_far, np.array(rows[1:])])
    return _far


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each range of bytes; a checksum is the sum of what its bytes add at their distance from the end."""
    sizes = ends - starts
    total = int(sizes.sum())
    first = np.cumsum(sizes) - sizes
    at = np.arange(total) - np.repeat(first - starts, sizes)
    distance = np.repeat(ends, sizes) - 1 - at
    return np.bitwise_xor.reduceat(_far_rows(int(sizes.max()))[distance, data[at]], first)


@lru_cache(maxsize=1 << 16)
def frame_header(number: int, size: int) -> bytes:
    code = _CODES.get(size, 7)
    out = bytearray((0xFF, 0xF8, code << 4 | 4, 1 << 1))
    if number < 0x80:
        out.append(number)
    else:
        n = next(k for k in range(2, 8) if number < 1 << (5 * k + 1))
        out.append((0xFF00 >> n & 0xFF) | number >> 6 * (n - 1))
        out += bytes(0x80 | number >> 6 * k & 0x3F for k in range(n - 2, -1, -1))
    if code == 7:
        out += struct.pack(">H", size - 1)
    return bytes(out) + bytes((crc8(out),))


def _zigzag(x: np.ndarray) -> np.ndarray:
    return (x << 1) ^ (x >> 31)


def linear_predictors(x: np.ndarray, order: int = LPC_ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (frames, order) and shifts of each row."""
    y = x.astype(np.float64)
    r = np.stack([np.einsum("ij,ij->i", y[:, : y.shape[1] - k], y[:, k:]) for k in range(order + 1)], 1)
    r[:, 0] = r[:, 0] * (1 + 1e-9) + 1e-9
    a, err = np.zeros((len(x), order)), r[:, 0].copy()
    for i in range(order):
        k = (r[:, i + 1] - np.einsum("ij,ij->i", a[:, :i], r[:, i:0:-1])) / err
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err *= np.maximum(1 - k * k, 1e-12)
    top = np.maximum(np.abs(a).max(1), 1e-9)
    shift = np.clip(LPC_BITS - 2 - np.floor(np.log2(top)).astype(np.int64) - 1, 0, 15)
    limit = (1 << (LPC_BITS - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit).astype(np.int64), shift


def _lpc_residual(x: np.ndarray, coefs: np.ndarray, shift: np.ndarray) -> np.ndarray:
    order, n = coefs.shape[1], x.shape[1]
    sums = np.zeros((len(x), n - order), np.int64)
    for j in range(order):
        sums += coefs[:, j : j + 1] * x[:, order - 1 - j : n - 1 - j]
    return (x[:, order:] - (sums >> shift[:, None])).astype(np.int32)


def _rice(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best parameter of each row and its bits."""
    n = z.shape[1]
    guess = np.floor(np.log2(z.mean(1) + 1)).astype(np.int32)
    best, bits = None, None
    for d in (-1, 0, 1):
        k = np.clip(guess + d, 0, 14)
        b = n * (k + 1) + (z >> k[:, None]).sum(1)
        best, bits = (k, b) if best is None else (np.where(b < bits, k, best), np.minimum(b, bits))
    return best, bits


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = (value >> (width - 1 - j)) & 1


def encode_blocks(x: np.ndarray, numbers: list[int]) -> list[bytes]:
    """Frames of the rows of x, which are blocks of equal size."""
    count, size = x.shape
    x = x.astype(np.int32)
    d1 = np.diff(x, axis=1)
    d2 = np.diff(d1, axis=1)
    coefs, shift = linear_predictors(x)
    lpc = _lpc_residual(x, coefs, shift)
    costs = np.stack([np.abs(r).sum(1) + extra for r, extra in ((x, 0), (d1, 8), (d2, 16), (lpc, 60 + 8 * LPC_ORDER))], 1)
    kind = costs.argmin(1)  # 0-2: fixed of that order, 3: linear
    kind[(x == x[:, :1]).all(1)] = 4
    frames: list[bytes] = [b""] * count
    half = size // 2
    for which, order, residual in ((0, 0, x), (1, 1, d1), (2, 2, d2), (3, LPC_ORDER, lpc)):
        rows = np.flatnonzero(kind == which)
        if not len(rows):
            continue
        z = _zigzag(residual[rows])
        k1, b1 = _rice(z[:, : half - order])
        k2, b2 = _rice(z[:, half - order :])
        head = 8 + 8 * order + ((9 + LPC_BITS * order) if which == 3 else 0)
        total = head + 6 + 8 + b1 + b2
        kind[rows[total >= 8 + 8 * size]] = 5
        use = total < 8 + 8 * size
        rows, z, k1, k2, b1, total = rows[use], z[use], k1[use], k2[use], b1[use], total[use]
        if not len(rows):
            continue
        room = (total + 7) // 8 * 8
        begin = np.cumsum(room) - room
        bits = np.zeros(int(room.sum()), np.uint8)
        ones = np.ones(len(rows), np.int64)
        _put(bits, begin, ones * ((0b100000 | order - 1) if which == 3 else 0b001000 | order) * 2, 8)
        for j in range(order):
            _put(bits, begin + 8 + 8 * j, x[rows, j] & 0xFF, 8)
        at = begin + 8 + 8 * order
        if which == 3:
            _put(bits, at, ones * (LPC_BITS - 1), 4)
            _put(bits, at + 4, shift[rows], 5)
            for j in range(order):
                _put(bits, at + 9 + LPC_BITS * j, coefs[rows, j] & ((1 << LPC_BITS) - 1), LPC_BITS)
        at = begin + head
        _put(bits, at, ones, 6)  # method 0, partition order 1
        for k, part, start in ((k1, z[:, : half - order], at + 6), (k2, z[:, half - order :], at + 10 + b1)):
            _put(bits, start, k, 4)
            q = part >> k[:, None]
            length = q + 1 + k[:, None]
            stop = (start[:, None] + 4 + np.cumsum(length, 1) - length + q).astype(np.int64)
            bits[stop] = 1
            for j in range(int(k.max())):
                deep = k > j
                if deep.all():
                    bits[stop + 1 + j] = (part >> (k[:, None] - 1 - j)) & 1
                elif deep.any():
                    bits[stop[deep] + 1 + j] = (part[deep] >> (k[deep][:, None] - 1 - j)) & 1
        packed = np.packbits(bits).tobytes()
        for r, a, n in zip(rows.tolist(), (begin // 8).tolist(), (room // 8).tolist()):
            frames[r] = packed[a : a + n]
    for r in np.flatnonzero(kind >= 4).tolist():
        raw = (x[r] & 0xFF).astype(np.uint8).tobytes()
        frames[r] = b"\0" + raw[:1] if kind[r] == 4 else b"\2" + raw
    whole = [frame_header(number, size) + body for number, body in zip(numbers, frames)]
    data = np.frombuffer(b"".join(whole), np.uint8)
    ends = np.cumsum([len(w) for w in whole])
    sums = crc16(data, np.concatenate([[0], ends[:-1]]), ends)
    return [w + struct.pack(">H", c) for w, c in zip(whole, sums.tolist())]


def encode(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """A FLAC stream for each payload of 8-bit samples."""
    groups: dict[int, list[tuple[int, int]]] = {}
    frames = [[b""] * -(-len(p) // block) for p in payloads]
    for k, p in enumerate(payloads):
        for f in range(len(frames[k])):
            groups.setdefault(min(block, len(p) - f * block), []).append((k, f))
    for size, where in groups.items():
        x = np.frombuffer(b"".join(payloads[k][f * block : f * block + size] for k, f in where), np.uint8).reshape(-1, size).astype(np.int16) - 128
        if size < 2 * (LPC_ORDER + 2):
            raise FlacError(f"a block of {size} samples is too short")
        for (k, f), frame in zip(where, encode_blocks(x, [f for _, f in where])):
            frames[k][f] = frame
    out = []
    for p, fs in zip(payloads, frames):
        sizes = [len(f) for f in fs] or [0]
        signed = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        info = struct.pack(">HH", block, block) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + (RATE << 44 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        at, points = 0, []
        for f, frame in enumerate(fs):
            points.append(struct.pack(">QQH", f * block, at, min(block, len(p) - f * block)))
            at += len(frame)
        table = b"".join(points)
        out.append(b"fLaC" + b"\x00\x00\x00\x22" + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(fs))
    return out


class Stream:
    """The metadata of a stream: block size, samples, MD5, where frames begin and the seek points."""

    def __init__(self, media: bytes):
        if media[:4] != b"fLaC":
            raise FlacError("no stream marker")
        at, last, self.points = 4, False, []
        while not last:
            kind, size = media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
            last, body = bool(media[at] & 0x80), media[at + 4 : at + 4 + size]
            if kind == 0:
                self.block = struct.unpack(">H", body[:2])[0]
                packed = int.from_bytes(body[10:18], "big")
                self.rate, self.channels, self.bits, self.samples = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1)
                self.md5 = body[18:34]
            elif kind == 3:
                self.points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
            at += 4 + size
        self.first = at
        if self.channels != 1 or self.bits != 8:
            raise FlacError("only one channel of 8-bit samples is supported")


def _number(media: np.ndarray, at: int) -> tuple[int, int]:
    b = int(media[at])
    if b < 0x80:
        return b, at + 1
    n = 8 - (b ^ 0xFF).bit_length()
    value = b & ((1 << (7 - n)) - 1)
    for k in range(1, n):
        value = value << 6 | int(media[at + k]) & 0x3F
    return value, at + n


def decode_frames(media: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, list[int]]:
    """Samples of the frames that begin at starts, where they end, and their numbers. Checks all frame checksums."""
    n = len(starts)
    sizes, numbers, bodies = np.zeros(n, np.int64), [0] * n, np.zeros(n, np.int64)
    seen: dict[bytes, int] = {}
    for i, s in enumerate(starts.tolist()):
        if media[s] != 0xFF or media[s + 1] != 0xF8:
            raise FlacError("no frame where one should begin")
        numbers[i], at = _number(media, s + 4)
        code = int(media[s + 2]) >> 4
        if code in (6, 7):
            width = code - 5
            sizes[i] = int.from_bytes(media[at : at + width].tobytes(), "big") + 1
            at += width
        else:
            sizes[i] = _SIZES[code]
        head = media[s : at + 1].tobytes()
        if head not in seen:
            seen[head] = crc8(head[:-1])
        if seen[head] != head[-1]:
            raise FlacError("a frame header's checksum differs")
        bodies[i] = at + 1
    kind = media[bodies] >> 1 & 0x3F
    if (media[bodies] & 0x81).any():
        raise FlacError("padding bit or wasted bits in a subframe")
    order = np.where(kind & 0x20, (kind & 0x1F) + 1, np.where((kind & 0x38) == 8, kind & 7, 0)).astype(np.int64)
    coded = np.flatnonzero(kind >= 8)
    out: list[np.ndarray] = [None] * n  # type: ignore[list-item]
    ends = np.zeros(n, np.int64)
    for i in np.flatnonzero(kind < 8).tolist():
        b, size = int(bodies[i]) + 1, int(sizes[i])
        if kind[i] == 0:
            out[i], ends[i] = np.full(size, media[b], np.uint8).view(np.int8).astype(np.int64), b + 1
        elif kind[i] == 1:
            out[i], ends[i] = media[b : b + size].view(np.int8).astype(np.int64), b + size
        else:
            raise FlacError("a reserved subframe type")
    if len(coded):
        coded = coded[np.argsort(-(sizes[coded] - order[coded]), kind="stable")]
        padded = np.concatenate([media, np.zeros(8, np.uint8)])
        words = padded[:-7].astype(np.uint64)
        for j in range(1, 5):
            words = words << np.uint64(8) | padded[j : len(padded) - 7 + j]
        index = np.arange(len(media) * 8, dtype=np.int32)
        index[np.unpackbits(media) == 0] = np.iinfo(np.int32).max
        nxt = np.minimum.accumulate(index[::-1])[::-1]
        del index

        def peek(at: np.ndarray, width) -> np.ndarray:
            return (words[at >> 3] << (at & 7).astype(np.uint64) & np.uint64(0xFFFFFFFFFF)) >> (np.uint64(40) - np.asarray(width, np.uint64))

        size, p = sizes[coded], order[coded]
        pos = (bodies[coded] + 1) * 8
        warm = np.zeros((len(coded), 32), np.int64)
        for j in range(int(p.max(initial=0))):
            has = p > j
            warm[has, j] = peek(pos[has] + 8 * j, 8).astype(np.uint8).view(np.int8)
        pos = pos + 8 * p
        linear = kind[coded] >= 32
        precision, shift = np.zeros(len(coded), np.int64), np.zeros(len(coded), np.int64)
        coefs = np.zeros((len(coded), 32), np.int64)
        if linear.any():
            precision[linear] = peek(pos[linear], 4).astype(np.int64) + 1
            shift[linear] = peek(pos[linear] + 4, 5).astype(np.int64)
            pos = pos + np.where(linear, 9, 0)
            for j in range(int(p[linear].max())):
                has = linear & (p > j)
                c = peek(pos[has], precision[has]).astype(np.int64)
                coefs[has, j] = c - ((c >> (precision[has] - 1)) << precision[has])
                pos = pos + np.where(has, precision, 0)
        method, parts = peek(pos, 2).astype(np.int64), 1 << peek(pos + 2, 4).astype(np.int64)
        if (method > 1).any():
            raise FlacError("a reserved residual coding")
        pos = pos + 6
        wide = 4 + method
        each = size // parts
        count = size - p
        bound = np.zeros(len(coded), np.int64)  # the residual at which the next partition begins
        steps = int(count[0])
        at, k = np.zeros((steps, len(coded)), np.int32), np.zeros((steps, len(coded)), np.uint8)
        now = np.zeros(len(coded), np.int64)
        active = len(coded) - np.searchsorted(count[::-1], np.arange(steps), side="right")
        edges = {0}
        for e, o, m in {(int(a), int(b), int(c)) for a, b, c in zip(each, p, parts)}:
            edges |= {e * j - o for j in range(1, m)}
        for t in range(steps):
            m = int(active[t])
            if t in edges:
                fresh = np.flatnonzero(bound[:m] == t)
                if len(fresh):
                    now[fresh] = peek(pos[fresh], wide[fresh]).astype(np.int64)
                    if (now[fresh] == (1 << wide[fresh]) - 1).any():
                        raise FlacError("escaped partitions are not supported")
                    pos[fresh] += wide[fresh]
                    bound[fresh] += np.where(t == 0, each[fresh] - p[fresh], each[fresh])
            here = pos[:m]
            at[t, :m] = here
            k[t, :m] = now[:m]
            np.add(nxt[here], now[:m] + 1, out=here)
        stops = (pos + 7) // 8
        ends[coded] = stops
        flat = at.ravel()
        stop = nxt[flat].reshape(at.shape)
        low = peek(stop.astype(np.int64) + 1, k).astype(np.int64)
        z = ((stop - at).astype(np.int64) << k) | np.where(k > 0, low, 0)
        residual = (z >> 1) ^ -(z & 1)
        x = np.zeros((int(size.max()), len(coded)), np.int64)
        for o in np.unique(p):
            for lin in (False, True):
                cols = np.flatnonzero((p == o) & (linear == lin))
                if not len(cols):
                    continue
                x[:o, cols] = warm[cols, :o].T
                r = residual[:, cols]
                if lin:
                    c, s = np.ascontiguousarray(coefs[cols, :o].T), shift[cols]
                    y = x[:, cols]
                    back = y[:o][::-1].copy()
                    for t in range(min(len(r), int(size[cols].max()) - o)):
                        v = ((c * back).sum(0) >> s) + r[t]
                        y[o + t] = v
                        back[1:] = back[:-1].copy()
                        back[0] = v
                    x[:, cols] = y
                else:
                    long = int(size[cols].max())
                    line = r[: long - o]
                    for d in range(int(o), 0, -1):
                        first = np.diff(x[:o, cols], n=d - 1, axis=0)[-1] if o > 1 or d > 1 else x[0, cols]
                        line = first + np.cumsum(line, 0)
                    x[o:long, cols] = line
        for j, i in enumerate(coded.tolist()):
            out[i] = x[: int(size[j]), j]
    stored = media[ends].astype(np.int64) << 8 | media[ends + 1]
    if (crc16(media, starts, ends) != stored).any():
        raise FlacError("a frame's checksum differs")
    return out, ends + 2, numbers


def decode_blocks(medias: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """For each stream its PCM blocks: (sample offset, 8-bit samples)."""
    heads = [Stream(m) for m in medias]
    data = np.frombuffer(b"".join(medias), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(m) for m in medias])])
    out: list[list[tuple[int, bytes]]] = [[] for _ in medias]
    whole = [sum(p[2] for p in h.points) == h.samples for h in heads]
    starts = [(int(base[i]) + h.first + p[1], i) for i, h in enumerate(heads) if whole[i] for p in h.points]

    def take(where: list[tuple[int, int]]) -> np.ndarray:
        frames, ends, numbers = decode_frames(data, np.array([s for s, _ in where], np.int64))
        for (_, i), x, number in zip(where, frames, numbers):
            out[i].append((number * heads[i].block, (x + 128).astype(np.uint8).tobytes()))
        return ends

    if starts:
        take(starts)
    walk = [(int(base[i]) + h.first, i) for i, h in enumerate(heads) if not whole[i] and h.samples]
    while walk:  # without seek points a frame begins where the last one ends
        ends = take(walk)
        walk = [(int(e), i) for (_, i), e in zip(walk, ends) if sum(len(b) for _, b in out[i]) < heads[i].samples]
    for blocks, h in zip(out, heads):
        blocks.sort()
        signed = np.frombuffer(b"".join(b for _, b in blocks), np.uint8) ^ 0x80
        if len(signed) != h.samples or hashlib.md5(signed.tobytes()).digest() != h.md5:
            raise FlacError("the samples differ from the stream's MD5")
    return out


def read_at(media: bytes, sample: int) -> tuple[int, bytes]:
    """The block that holds a sample, found by the seek table: (its sample offset, samples)."""
    head = Stream(media)
    offset, at, _ = next(p for p in reversed(head.points) if p[0] <= sample)
    frames, _, _ = decode_frames(np.frombuffer(media, np.uint8), np.array([head.first + at], np.int64))
    return offset, (frames[0] + 128).astype(np.uint8).tobytes()


def payload(raw: bytes, unit: int = UNIT) -> bytes:
    """The bytes and spaces up to a positive multiple of the unit."""
    return raw.ljust(max(unit, -(-len(raw) // unit) * unit), b" ")


def features(samples: bytes) -> str:
    """Samples, mean and root mean square in thousandths, zero crossings and peak of a decoded payload."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"n={len(x)};mean={int(x.sum()) * 1000 // len(x)};rms={int((int((x * x).sum()) * 1_000_000 / len(x)) ** 0.5)};zc={crossings};peak={int(np.abs(x).max())}"


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a FLAC stream."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        raws = b.column(1).cast(pa.binary()).to_pylist()
        return common.batch(schema, b.column(0), [len(r) for r in raws], encode([payload(r) for r in raws]))

    return common.arrow_map(common.texts(df, id_col, text_col), run, "doc_id long, n_bytes long, media binary", limit=_SLICE)


def to_pcm(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, sample_offset, n_samples, pcm): a row for each decoded block; null media give none."""
    schema = pa.schema([("doc_id", pa.int64()), ("sample_offset", pa.int64()), ("n_samples", pa.int64()), ("pcm", pa.binary())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(d, o, len(x), x) for d, blocks in zip(b.column(0).to_pylist(), decode_blocks(b.column(1).to_pylist())) for o, x in blocks]
        return common.batch(schema, *(map(list, zip(*rows)) if rows else [[]] * 4))

    media = df.where(df[media_col].isNotNull()).select(df[id_col].cast("long").alias("doc_id"), df[media_col].cast(T.BinaryType()).alias("media"))
    return common.arrow_map(media, run, "doc_id long, sample_offset long, n_samples long, pcm binary", "media", _SLICE)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long"


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is read back from each text's stream (DIGEST); the streams don't leave the task."""
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in DIGEST.split(", "))])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        raws = b.column(1).cast(pa.binary()).to_pylist()
        medias = encode([payload(r) for r in raws])
        rows = []
        for raw, media, blocks in zip(raws, medias, decode_blocks(medias)):
            back = b"".join(x for _, x in blocks)
            rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(back), len(blocks)))
        return common.batch(schema, b.column(0), *map(list, zip(*rows)))

    return common.arrow_map(common.texts(df, id_col, text_col), run, DIGEST, limit=_SLICE)
