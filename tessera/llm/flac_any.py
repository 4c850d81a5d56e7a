"""A decoder for any FLAC stream: up to 8 channels of 4 to 32 bits, all kinds of subframes and residuals.

`flac` decodes what it writes (one channel of 8 bits) for many rows at once; this module follows one
stream bit by bit, for media that come from elsewhere: stereo by difference or by middle and side,
wasted bits, escaped partitions, long Rice parameters, blocks of varying size. Checks the CRC-8 of
each frame header, the CRC-16 of each frame, and the MD5 of all samples where the stream has one.

Null media give null; damaged or cut streams raise FlacError.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, flac

#: Fixed values of the format: bits of a sample and block sizes by their codes.
_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
_SIZES = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}


class Bits:
    """Reads a stream from the most significant bit on."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, 8 * at

    def take(self, n: int) -> int:
        if not n:
            return 0
        end = self.at + n
        if end > 8 * len(self.data):
            raise flac.FlacError("the stream ends too early")
        first, last = self.at >> 3, (end + 7) >> 3
        value = int.from_bytes(self.data[first:last], "big") >> (8 * last - end)
        self.at = end
        return value & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def zeros(self) -> int:
        """The zeros before the next one, which is read too."""
        count = 0
        while True:
            left = 8 - (self.at & 7)
            if self.at >> 3 >= len(self.data):
                raise flac.FlacError("the stream ends too early")
            rest = self.data[self.at >> 3] & ((1 << left) - 1)
            if rest:
                skipped = left - rest.bit_length()
                self.at += skipped + 1
                return count + skipped
            count += left
            self.at += left


def _residual(bits: Bits, size: int, order: int) -> list[int]:
    method = bits.take(2)
    if method > 1:
        raise flac.FlacError("a reserved residual coding")
    wide, parts, out = 4 + method, 1 << bits.take(4), []
    if size % parts or size // parts < order:
        raise flac.FlacError("partitions that don't fit the block")
    for part in range(parts):
        count, k = size // parts - (order if part == 0 else 0), bits.take(wide)
        if k == (1 << wide) - 1:  # not coded: plain numbers
            raw = bits.take(5)
            out += [bits.signed(raw) for _ in range(count)]
            continue
        for _ in range(count):
            z = bits.zeros() << k | bits.take(k)
            out.append(z >> 1 ^ -(z & 1))
    return out


def _subframe(bits: Bits, size: int, depth: int) -> list[int]:
    if bits.take(1):
        raise flac.FlacError("a padding bit is set")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.zeros() + 1
        depth -= wasted
    if kind == 0:
        x = [bits.signed(depth)] * size
    elif kind == 1:
        x = [bits.signed(depth) for _ in range(size)]
    elif 8 <= kind <= 12:
        order = kind - 8
        x = [bits.signed(depth) for _ in range(order)]
        weights = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])[order]
        for r in _residual(bits, size, order):
            x.append(r + sum(w * x[-1 - j] for j, w in enumerate(weights)))
    elif kind >= 32:
        order = kind - 31
        x = [bits.signed(depth) for _ in range(order)]
        precision, shift = bits.take(4) + 1, bits.signed(5)
        if precision == 16 or shift < 0:
            raise flac.FlacError("a reserved precision or a negative shift")
        weights = [bits.signed(precision) for _ in range(order)]
        for r in _residual(bits, size, order):
            x.append(r + (sum(w * x[-1 - j] for j, w in enumerate(weights)) >> shift))
    else:
        raise flac.FlacError("a reserved subframe type")
    return [v << wasted for v in x] if wasted else x


def frames(media: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(sample offset, samples by channel) of each frame; the last checks the MD5."""
    if media[:4] != b"fLaC":
        raise flac.FlacError("no stream marker")
    at, last, info = 4, False, b""
    while not last:
        if at + 4 > len(media):
            raise flac.FlacError("the stream ends too early")
        kind, size = media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        last = bool(media[at] & 0x80)
        if kind == 0:
            info = media[at + 4 : at + 4 + size]
        at += 4 + size
    if len(info) < 34:
        raise flac.FlacError("no stream information")
    packed = int.from_bytes(info[10:18], "big")
    depth_of_all, total = (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1)
    whole, done = hashlib.md5(), 0
    while at < len(media):
        bits = Bits(media, at)
        if bits.take(15) != 0x7FFC:
            raise flac.FlacError("no frame where one should begin")
        bits.take(1)
        size_code, rate_code, channel_code, bit_code = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
        if bits.take(1) or channel_code > 10 or bit_code == 3 or size_code == 0 or rate_code == 15:
            raise flac.FlacError("a reserved value in a frame header")
        lead = bits.take(8)
        for _ in range(max(0, 7 - (lead ^ 0xFF).bit_length())):
            bits.take(8)
        size = bits.take(8 * (size_code - 5)) + 1 if size_code in (6, 7) else _SIZES[size_code]
        bits.take({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
        depth = _BITS.get(bit_code, depth_of_all)
        if flac.crc8(media[at : bits.at >> 3]) != bits.take(8):
            raise flac.FlacError("a frame header's checksum differs")
        channels = channel_code + 1 if channel_code < 8 else 2
        # the channel that holds a difference has a bit more
        x = [np.array(_subframe(bits, size, depth + ((channel_code, c) in ((8, 1), (9, 0), (10, 1)))), np.int64) for c in range(channels)]
        if channel_code == 8:
            x[1] = x[0] - x[1]
        elif channel_code == 9:
            x[0] = x[0] + x[1]
        elif channel_code == 10:
            middle, side = x[0] << 1 | x[1] & 1, x[1]
            x = [(middle + side) >> 1, (middle - side) >> 1]
        end = (bits.at + 7) >> 3
        if end + 2 > len(media):
            raise flac.FlacError("the stream ends too early")
        if flac.crc16(np.frombuffer(media, np.uint8), np.array([at]), np.array([end]))[0] != int.from_bytes(media[end : end + 2], "big"):
            raise flac.FlacError("a frame's checksum differs")
        samples = np.stack(x)
        bytes_each = (depth + 7) // 8
        whole.update(samples.T.astype("<i8").tobytes() if bytes_each == 8 else np.ascontiguousarray(samples.T).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :bytes_each].tobytes())
        yield done, samples
        done, at = done + size, end + 2
    if total and done != total:
        raise flac.FlacError("the stream has another number of samples")
    if any(info[18:34]) and whole.digest() != info[18:34]:
        raise flac.FlacError("the samples' MD5 differs")


def to_samples(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, sample_offset, channel, samples array<int>) of the frames of each row, one after the other."""
    schema = pa.schema([("doc_id", pa.int64()), ("sample_offset", pa.int64()), ("channel", pa.int32()), ("samples", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for offset, x in frames(media) if media is not None else ():
                    yield common.batch(schema, [doc] * len(x), [offset] * len(x), list(range(len(x))), [c.tolist() for c in x])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(run, "doc_id long, sample_offset long, channel int, samples array<int>")


def header(media: bytes) -> tuple[int, int, int, int]:
    """(rate, channels, bits, samples) of a stream."""
    packed = struct.unpack(">Q", media[18:26])[0]
    return packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1)
