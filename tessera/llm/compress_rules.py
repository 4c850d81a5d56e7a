"""Compression bands: zstandard ratios of the whole text and of fixed chunks.

A text's ratio is its compressed bytes over its bytes. Repetitive text lies below the
band of its length, noise (keys, base64, symbol soup) above it. Short texts compress
worse, so each length has limits of its own; a chunk is judged by the limits of its
length. A text is rejected if the whole lies outside its band, if chunks outside theirs
hold at least `bad_share` of its bytes, or if one chunk lies further than `far` outside.

Texts without words fail the base rules. Null texts have no words. Rows stand alone, so
repeated rows, order and skew don't matter; long texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import common

SYMBOLS = b"#*$%&|<>"
CHUNK = 512
LEVEL = 3


@dataclass(frozen=True)
class Band:
    """Limits of the ratio for texts of at least `least` bytes."""

    least: int
    low: float
    high: float


#: Set on labelled documents: just outside what clean prose of four languages has at that length, on either side.
BANDS = (
    Band(0, 0.0, 9.0),
    Band(64, 0.45, 1.30),
    Band(128, 0.50, 1.05),
    Band(256, 0.50, 0.90),
    Band(512, 0.47, 0.78),
    Band(1024, 0.44, 0.68),
    Band(2048, 0.425, 0.62),
    Band(4096, 0.405, 0.58),
    Band(8192, 0.385, 0.56),
    Band(32768, 0.37, 0.55),
)
BAD_SHARE = 0.05
#: Of labelled clean prose no chunk is out of its band at all; a chunk all of which is base64 or one repeated line is further out than this.
FAR = 0.04

FIELDS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("n_bytes", pa.int64()), ("ratio", pa.float64()), ("least_chunk_ratio", pa.float64()), ("most_chunk_ratio", pa.float64()), ("bad_bytes", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, ratio double, least_chunk_ratio double, most_chunk_ratio double, bad_bytes long, base_failed boolean, kept boolean"


def band(n: int, bands: tuple[Band, ...] = BANDS) -> Band:
    return [b for b in bands if b.least <= n][-1]


def ratios(raw: bytes, packer: zstandard.ZstdCompressor, chunk: int = CHUNK) -> tuple[float, list[tuple[int, float]]]:
    """Of the whole, and (bytes, ratio) of each chunk; the last chunk takes a shorter rest with it."""
    whole = len(packer.compress(raw)) / max(1, len(raw))
    if len(raw) < 2 * chunk:
        return whole, [(len(raw), whole)]
    cuts = [k * chunk for k in range(len(raw) // chunk)] + [len(raw)]
    return whole, [(b - a, len(packer.compress(raw[a:b])) / (b - a)) for a, b in zip(cuts, cuts[1:])]


def repeated_words(hashes: np.ndarray, starts: np.ndarray, window: int = 5) -> np.ndarray:
    """For each text, its words that lie in a window of words found twice or more in the text."""
    n = len(starts) - 1
    g = common.grams(hashes, window)
    if not len(g):
        return np.zeros(n, np.int64)
    owner = np.repeat(np.arange(n), np.diff(starts))
    at = np.flatnonzero(owner[: len(g)] == owner[window - 1 :])
    key, of = g[at], owner[at]
    order = np.lexsort((key, of))
    key, of, at = key[order], of[order], at[order]
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = (key[1:] == key[:-1]) & (of[1:] == of[:-1])
    hit = at[same[:-1] | same[1:]]
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(owner[covered], minlength=n).astype(np.int64)


def _dup_lines(raw: bytes) -> int:
    seen, n = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            n += 1
        elif line.split():
            seen.add(line)
    return n


def rules(df: DataFrame, bands: tuple[Band, ...] = BANDS, chunk: int = CHUNK, level: int = LEVEL, bad_share: float = BAD_SHARE, far: float = FAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: the base features, the ratios and the verdict (SCHEMA)."""
    schema = pa.schema(FIELDS)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        packer = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False)
        raws = b.column(1).cast(pa.binary()).to_pylist()
        hashes, starts = common.hashed_words(raws)
        n_words, repeats = np.diff(starts), repeated_words(hashes, starts)
        rows = []
        for doc, raw, n, again in zip(b.column(0).to_pylist(), raws, n_words.tolist(), repeats.tolist()):
            words = raw.translate(None, b" \t\n\x0b\x0c\r")
            chars = len(words.decode()) if not words.isascii() else len(words)
            symbols = len(words) - len(words.translate(None, SYMBOLS))
            whole, parts = ratios(raw, packer, chunk)
            bad = sum(m for m, r in parts if not band(m, bands).low <= r <= band(m, bands).high)
            farthest = max(max(band(m, bands).low - r, r - band(m, bands).high) for m, r in parts)
            fits = band(len(raw), bands).low <= whole <= band(len(raw), bands).high
            failed = n < 10 or 100 * again > 20 * n
            rows.append((doc, n, chars, symbols, _dup_lines(raw), again, len(raw), whole, min(r for _, r in parts), max(r for _, r in parts), bad, failed, not failed and fits and bad < bad_share * max(1, len(raw)) and farthest <= far))
        return common.batch(schema, *map(list, zip(*rows)))

    return common.arrow_map(common.texts(df, id_col, text_col), run, SCHEMA)
