"""Byte-level BPE by a local rank file with the tiktoken library.

Texts of any length: a long text is cut where a white-space character follows a
non-white-space character. No match of the split pattern spans such a place and none
looks behind, so the ids are those of the whole text. The library's pattern engine gives up
on some hundred thousand white-space characters in a row; of such a run all but the last
character (all, at the end of the text) are one match, whose bytes are merged without
the engine. Decoding joins raw token bytes.

Null and empty texts give no ids; repeated rows give equal rows; each row stands alone,
so order, ties and skew don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

#: Characters of a text that are encoded at once, about.
PART_CHARS = 1 << 16
_EDGE = re.compile(r"\S(?=[ \n])")
#: White-space characters in a row that are a match without the pattern engine, and what the library takes for white space.
LONG_WHITE = 1 << 14
_LONG_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_WHITE)
#: The end of split patterns by which a run of white space but its last character is one match.
_WHITE_RULE = r"|\s+(?!\S)|\s+"
_made: dict[str, BpeCodec] = {}


class BpeCodec:
    """Encodes and decodes by the content of a rank file."""

    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        size = max(table.values()) + 1
        tokens = [b""] * size
        for token, rank in table.items():
            tokens[rank] = token
        self.tokens = tokens
        others = pattern.removesuffix(_WHITE_RULE)
        self.white = others != pattern and r"\s" not in others.replace(r"[^\s", "") and not re.search(r"\\[rnt]", others)

    def parts(self, text: str, size: int = PART_CHARS):
        at = 0
        while len(text) - at > size:
            edge = _EDGE.search(text, at + size - 1)
            if edge is None:
                break
            yield text[at : edge.end()]
            at = edge.end()
        yield text[at:] if at else text

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= PART_CHARS:
            return np.array(self.encoding.encode_ordinary(text), "<u4")
        out, at = [], 0
        for run in _LONG_WHITE.finditer(text) if self.white else ():
            end = run.end() - (run.end() < len(text))
            out += [self.encoding.encode_ordinary(x) for x in self.parts(text[at : run.start()])]
            out.append(self.encoding._core_bpe.encode_single_piece(text[run.start() : end].encode()))
            at = end
        out += [self.encoding.encode_ordinary(x) for x in self.parts(text[at:])]
        return np.concatenate([np.array(ids, "<u4") for ids in out])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def codec(ranks: bytes, pattern: str) -> BpeCodec:
    """One codec for each Python worker and rank file."""
    key = hashlib.sha256(ranks).hexdigest() + pattern
    if key not in _made:
        _made[key] = BpeCodec(ranks, pattern)
    return _made[key]


def _ranks(df: DataFrame, path: str):
    ranks = open(path, "rb").read()
    if len(ranks) > common.BROADCAST_BYTES:
        raise ValueError(f"{path}: {len(ranks)} bytes of ranks are too many to broadcast")
    return df.sparkSession.sparkContext.broadcast(ranks)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary): the ids as little-endian unsigned 32-bit integers."""
    ranks = _ranks(df, path)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(ranks.value, pattern)
        return common.batch(schema, b.column(0), [c.encode(t).tobytes() for t in b.column(1).to_pylist()])

    return common.arrow_map(common.texts(df, id_col, text_col), run, "doc_id long, ids binary")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, raw binary): the bytes of the ids; null ids give no bytes."""
    ranks = _ranks(df, path)
    schema = pa.schema([("doc_id", pa.int64()), ("raw", pa.binary())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(ranks.value, pattern)
        return common.batch(schema, b.column(0), [c.decode(np.frombuffer(x or b"", "<u4")) for x in b.column(1).to_pylist()])

    return common.arrow_map(df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].cast(T.BinaryType()).alias("ids")), run, "doc_id long, raw binary", "ids")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) in one pass: encodes, then decodes the ids."""
    ranks = _ranks(df, path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(ranks.value, pattern)
        n, a, d = [], [], []
        for t in b.column(1).to_pylist():
            ids = c.encode(t)
            n.append(len(ids))
            a.append(hashlib.sha256(ids.tobytes()).hexdigest())
            d.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return common.batch(schema, b.column(0), n, a, d)

    return common.arrow_map(common.texts(df, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
