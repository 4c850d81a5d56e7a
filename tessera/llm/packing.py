"""Packs documents into fixed windows by Karmarkar-Karp multiway differencing.

A document longer than a window fills whole windows first. What is left of each
document is cut into pieces of at most `piece` tokens, and pieces gather, in the order
of the input partition, until they fill a block of `windows` windows but for a few
spare tokens; the last of them are cut finely. Multiway differencing then deals the pieces of the block into the windows:
each piece begins as a partial partition of its own; the two partial partitions with
the largest differences merge, the fullest windows of one upon the emptiest of the
other, until one is left, whose windows are nearly equal. If the fullest exceeds the
window size, the block is dealt again into one more window.

Blocks are of fixed size and are dealt within the scan's task: nothing is shuffled,
gathered or broadcast but the tokenizer, and a document of any length streams through.
A sequence id is the partition's number and a counter, so a task that runs again after
a lost executor gives the same rows.

Null and empty texts have the end id only; repeated rows are packed as rows of their own.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 2048
BLOCK_WINDOWS = 32
PIECE = 256
#: The last tokens of a block are cut into pieces of so many: small pieces level what differences are left.
FINE, FINE_PIECE = 384, 4
#: Tokens a window of a block is left short of on average, so that near-equal windows fit.
SPARE = 4
END_ID = 1
#: Words of one generation that a worker keeps.
KEPT_WORDS = 200_000
#: Texts with other characters than these are given to the library whole: outside them
#: normal forms, case folding or white space need more than a word at a time.
_OTHER = re.compile("[\x1c-\x1f\u0300-\u200f\u2028-\u20ab\u20ad-\U0010ffff]")
_CONTROL = re.compile("[\x1c-\x1f]")
_made: dict[str, Tokens] = {}
common.keeps(__name__, _made.clear)


class Tokens(dict):
    """Little-endian ids of each white-space word, as the library gives them.

    The split pattern of the tokenizer never spans white space and doesn't look around,
    so a text's ids are its words' ids in a row, and a word's those of its matches. Words
    are kept in two generations: when the younger is full, the older goes. All go when the
    worker begins another kind of task.
    """

    def __init__(self, content: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a text at a time: no threads in each worker
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_str(content)
        self.library.encode_special_tokens = True
        rules = json.loads(content)["pre_tokenizer"]
        steps = rules.get("pretokenizers", [rules])
        normal = json.loads(content)["normalizer"] or {}
        self.parted = self.library
        if all(x.get("type") in ("NFC", "Lowercase") or x.get("pattern") == {"Regex": "\\s+"} and x["content"] == " " for x in normal.get("normalizers", [normal])):
            # lower-case matches parted by spaces need neither normal forms nor the pattern
            self.parted = Tokenizer.from_str(json.dumps(json.loads(content) | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *steps[1:]]}}))
            self.parted.encode_special_tokens = True
        pattern = steps[0].get("pattern", {}).get("Regex", "")
        #: Whether texts may be taken apart: a pattern of plain runs whose matches are kept and the rest dropped.
        self.by_word = steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and bool(steps[0]["invert"]) and "[^\\s" in pattern and "(?" not in pattern and not any(x.get("add_prefix_space") or x.get("use_regex") for x in steps[1:])
        self.matches = regex.compile(pattern).findall
        #: Whether a word of letters is one match.
        self.letters = bool(re.match(r"('\w+\|)*\[\\p\{L\}\]\+\|", pattern))
        self.older: dict[str, bytes] = {}
        suffix = json.loads(content)["model"].get("end_of_word_suffix")
        ends = [k for w, k in self.library.get_vocab().items() if suffix and w.endswith(suffix)]
        #: Whether an id ends a match.
        self.ends = np.zeros(max(self.library.get_vocab().values()) + 1, bool)
        self.ends[ends] = True

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.older = dict(self)
            self.clear()
        out = self.older.get(word)
        if out is None:
            parts = self.matches(word)
            out = self.whole(word) if len(parts) < 2 else b"".join(map(self.__getitem__, parts))
        self[word] = out
        return out

    def learn(self, words: list[str]) -> None:
        """New words: their matches, encoded as one text and parted by the ids that end a match, and what these make up."""
        older, fresh, made = self.older, set(), []
        for w in words:
            if w in older:
                continue  # comes back when it is asked for
            if self.letters and w.isalpha():
                fresh.add(w)
            else:
                parts = self.matches(w)
                made.append((w, parts))
                fresh.update(parts)
        some = [p for p in fresh if p not in self and p not in older]
        if len(some) < 2 or not self.ends.any():
            return
        ids = np.array(self.parted.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(some) and stops[-1] == len(ids):
            raw, at = ids.tobytes(), 0
            for p, stop in zip(some, (4 * stops).tolist()):
                self[p] = raw[at:stop]
                at = stop
            for w, parts in made:
                if len(parts) > 1:
                    self[w] = b"".join(map(self.__getitem__, parts))

    def whole(self, text: str) -> bytes:
        """The library's ids, without the places that each has in the text."""
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not self.by_word or not text.isascii() and _OTHER.search(text) or _CONTROL.search(text):
            return self.whole(text)
        words = text.lower().split()
        new = [w for w in set(words) if w not in self]
        if len(new) > 4:
            self.learn(new)
        return b"".join(map(self.__getitem__, words))


def tokens(content: str) -> Tokens:
    if content not in _made:
        _made.clear()
        _made[content] = Tokens(content)
    return _made[content]


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """The items of each window by Karmarkar-Karp multiway differencing."""
    if windows == 1 or not sizes:
        return [list(range(len(sizes)))] + [[] for _ in range(windows - 1)]
    zero = [0] * (windows - 1)
    empty = [None] * (windows - 1)
    heap = [(-s, k, [s, *zero], [k, *empty]) for k, s in enumerate(sizes)]  # sums fall from left to right
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums = [p + q for p, q in zip(a, reversed(b))]
        held = [q if p is None else p if q is None else (p, q) for p, q in zip(x, reversed(y))]
        order = sorted(range(windows), key=sums.__getitem__, reverse=True)
        sums = [sums[k] for k in order]
        least = sums[-1]
        heapq.heappush(heap, (least - sums[0], n, [s - least for s in sums], [held[k] for k in order]))
        n += 1
    out = []
    for tree in heap[0][3]:
        found, stack = [], [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += node
            elif node is not None:
                found.append(node)
        out.append(sorted(found))
    return out


def deal(sizes: list[int], window: int = WINDOW) -> list[list[int]]:
    """As few windows as differencing needs: one more whenever the capacity is exceeded."""
    windows = max(1, -(-sum(sizes) // window))
    while True:
        out = differencing(sizes, windows)
        if all(sum(sizes[k] for k in w) <= window for w in out):
            return out
        windows += 1


class Packer:
    """Takes documents one by one and gives rows (doc, start, length, crc, doc tokens, sequence, offset)."""

    def __init__(self, first: int, window: int = WINDOW, windows: int = BLOCK_WINDOWS, piece: int = PIECE):
        self.next, self.window, self.piece = first, window, min(piece, window)
        self.full = max(1, windows * (window - SPARE))
        self.held: list[tuple] = []
        self.size = 0

    def add(self, doc: int | None, ids: bytes) -> Iterator[tuple]:
        n, at = len(ids) // 4, 0
        while n - at >= self.window:
            yield doc, at, self.window, zlib.crc32(ids[4 * at : 4 * (at + self.window)]), n, self.next, 0
            self.next += 1
            at += self.window
        while at < n:
            room = self.full - self.size
            length = min(FINE_PIECE, n - at, room) if room <= FINE else min(self.piece, n - at, room - FINE)
            self.held.append((doc, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n))
            self.size += length
            at += length
            if self.size == self.full:
                yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        if self.held:
            for w in deal([p[2] for p in self.held], self.window):
                offset = 0
                for k in w:
                    yield *self.held[k], self.next, offset
                    offset += self.held[k][2]
                self.next += bool(w)
        self.held, self.size = [], 0


def pack(df: DataFrame, path: str, window: int = WINDOW, windows: int = BLOCK_WINDOWS, piece: int = PIECE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length."""
    content = open(path, encoding="utf-8").read()
    if len(content) > common.BROADCAST_BYTES:
        raise ValueError(f"{path}: {len(content)} characters are too many to broadcast")
    shared = df.sparkSession.sparkContext.broadcast(content)
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = pa.schema([(n, pa.int64()) for n in names])
    end = np.array([end_id], "<u4").tobytes()

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return common.batch(schema, *([list(c) for c in zip(*rows)] if rows else [[] for _ in names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.settle(__name__)
        t = tokens(shared.value)
        packer = Packer(TaskContext.get().partitionId() << 40, window, windows, piece)
        rows: list[tuple] = []
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                rows += packer.add(doc, t.ids(text.as_py()) + end)
                if len(rows) >= 20_000:
                    yield out(rows)
                    rows = []
        rows += packer.flush()
        yield out(rows)

    return common.texts(df, id_col, text_col).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def padding(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(sequences, tokens, padded): a sequence is padded to the window unless its length is a power of two."""
    each = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    spare = F.when(F.log2(F.col("n")) == F.floor(F.log2(F.col("n"))), 0).otherwise(window - F.col("n"))
    return each.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(spare).alias("padded"))
