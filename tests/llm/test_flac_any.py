"""Streams of all kinds, written bit by bit here, and those that the operator writes."""

import hashlib
import os

import numpy as np
import pytest

from tessera.llm import flac, flac_any


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        if n:
            self.bits += format(value & ((1 << n) - 1), f"0{n}b")

    def unary(self, n):
        self.bits += "0" * n + "1"

    def bytes(self):
        return int((self.bits + "0" * (-len(self.bits) % 8)).ljust(8, "0"), 2).to_bytes((len(self.bits) + 7) // 8, "big")


def rice(w, values, order, method, parts, escape):
    w.put(method, 2)
    w.put(parts.bit_length() - 1, 4)
    each, at = (len(values) + order) // parts, 0
    for part in range(parts):
        some = values[at : at + each - (order if part == 0 else 0)]
        at += len(some)
        if part in escape:
            raw = max([1, *(int(v).bit_length() + 1 for v in some)])
            w.put((1 << (4 + method)) - 1, 4 + method)
            w.put(raw, 5)
            for v in some:
                w.put(v, raw)
            continue
        k = max(0, int(np.mean([abs(v) for v in some] or [0])).bit_length())
        w.put(k, 4 + method)
        for v in some:
            z = v << 1 if v >= 0 else (-v << 1) - 1
            w.unary(z >> k)
            w.put(z, k)


def subframe(w, x, depth, kind):
    wasted = kind.get("wasted", 0)
    x, depth, how = [v >> wasted for v in x], depth - wasted, kind["how"]
    w.put(0, 1)
    order = kind.get("order", 0)
    w.put({"constant": 0, "verbatim": 1, "fixed": 8 + order, "linear": 31 + order}[how], 6)
    w.put(1 if wasted else 0, 1)
    if wasted:
        w.unary(wasted - 1)
    if how == "constant":
        w.put(x[0], depth)
        return
    for v in x[: order if how in ("fixed", "linear") else len(x)]:
        w.put(v, depth)
    if how == "fixed":
        rice(w, np.diff(np.array(x, np.int64), n=order).tolist(), order, kind.get("method", 0), kind.get("parts", 1), kind.get("escape", ()))
    elif how == "linear":
        weights, shift = kind["weights"], kind["shift"]
        w.put(11, 4)
        w.put(shift, 5)
        for c in weights:
            w.put(c, 12)
        rice(w, [x[t] - (sum(c * x[t - 1 - j] for j, c in enumerate(weights)) >> shift) for t in range(order, len(x))], order, kind.get("method", 0), kind.get("parts", 1), kind.get("escape", ()))


def stream(blocks, depth, channels):
    """blocks: (samples by channel, channel code, how each subframe is written)."""
    out, at = b"", 0
    for number, (x, code, kinds) in enumerate(blocks):
        w = Writer()
        size = x.shape[1]
        w.put(0x7FFC, 15)
        w.put(0, 1)
        w.put(7, 4)
        w.put(0, 4)
        w.put(code, 4)
        w.put(0, 3)
        w.put(0, 1)
        w.put(number, 8)
        w.put(size - 1, 16)
        w.put(flac.crc8(w.bytes()), 8)
        a = [c.tolist() for c in x]
        if code == 8:
            a = [a[0], (x[0] - x[1]).tolist()]
        elif code == 9:
            a = [(x[0] - x[1]).tolist(), a[1]]
        elif code == 10:
            a = [((x[0] + x[1]) >> 1).tolist(), (x[0] - x[1]).tolist()]
        for c, (v, kind) in enumerate(zip(a, kinds)):
            subframe(w, v, depth + ((code, c) in ((8, 1), (9, 0), (10, 1))), kind)
        raw = w.bytes()
        out += raw + int(flac.crc16(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0]).to_bytes(2, "big")
        at += size
    plain = b"".join(int(v).to_bytes((depth + 7) // 8, "little", signed=True) for x, _, _ in blocks for column in x.T for v in column)
    info = b"\x00\x10\xff\xff" + bytes(6) + (44100 << 44 | (channels - 1) << 41 | (depth - 1) << 36 | at).to_bytes(8, "big") + hashlib.md5(plain).digest()
    return b"fLaC\x80\x00\x00\x22" + info + out


def wave(rng, n, depth):
    x = np.cumsum(rng.integers(-40, 41, n)) + (1000 * np.sin(np.arange(n) / 9)).astype(int)
    return np.clip(x, -(1 << (depth - 1)), (1 << (depth - 1)) - 1).astype(np.int64)


def test_streams_of_all_kinds():
    rng = np.random.default_rng(4)
    for depth in (8, 12, 16, 24):
        a, b = wave(rng, 96, depth), wave(rng, 96, depth)
        fixed = [{"how": "fixed", "order": k, "parts": 4, "escape": (1, 3)} for k in range(5)]
        blocks = [(np.stack([a, b]), 1, [fixed[k], {"how": "linear", "order": 2, "weights": [1900, -900], "shift": 10, "method": 1, "parts": 2, "escape": (0,)}]) for k in range(5)]
        blocks += [(np.stack([a, b]) >> 1, code, [{"how": "fixed", "order": 2}, {"how": "verbatim"}]) for code in (8, 9, 10)]
        blocks += [(np.stack([a << 2 >> 2, np.full(96, -3)]) & ~np.int64(3) if depth > 8 else np.stack([a & ~3, b & ~3]), 1, [{"how": "fixed", "order": 1, "wasted": 2}, {"how": "verbatim", "wasted": 2}])]
        blocks += [(np.stack([np.full(30, 5), np.full(30, -7)]), 1, [{"how": "constant"}, {"how": "constant"}])]
        media = stream(blocks, depth, 2)
        got = list(flac_any.frames(media))
        assert [o for o, _ in got] == [sum(x.shape[1] for x, _, _ in blocks[:k]) for k in range(len(blocks))]
        for (_, x), (want, _, _) in zip(got, blocks):
            assert np.array_equal(x, want)
        assert flac_any.header(media) == (44100, 2, depth, 96 * 9 + 30)


def test_as_the_operator_writes():
    for payload in (flac.payload(b"a text of some words " * 300), os.urandom(1152 * 2), b"\x07" * 2304):
        media = flac.encode([payload])[0]
        x = np.concatenate([x[0] for _, x in flac_any.frames(media)])
        assert (x + 128).astype(np.uint8).tobytes() == payload


def test_damage_and_frames_of_rows(spark):
    x = wave(np.random.default_rng(1), 64, 16)
    media = stream([(x[None, :], 0, [{"how": "fixed", "order": 2}])], 16, 1)
    for k in (0, 30, 50, 60, len(media) - 1):
        bad = bytearray(media)
        bad[k] ^= 4
        with pytest.raises((flac.FlacError, KeyError)):
            list(flac_any.frames(bytes(bad)))
    with pytest.raises(flac.FlacError):
        list(flac_any.frames(media[:-5]))
    rows = flac_any.to_samples(spark.createDataFrame([(1, bytearray(media)), (2, None)], "doc_id long, media binary")).collect()
    assert [(r.doc_id, r.sample_offset, r.channel, r.samples) for r in rows] == [(1, 0, 0, x.tolist())]
