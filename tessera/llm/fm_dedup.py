"""Removes word windows that occur earlier in the corpus, by FM-indexes of its shards.

1. Routing. A window's key is the least hash of its short word runs, which depends on
   nothing but its words; neighbouring windows with one key form a run. Keys that only one
   run of the corpus has can't belong to a repeated window, so those runs are done. Keys
   are counted with partial sums and joined back; nothing is dropped but certain misses.
2. Shards. The words of each remaining run go to the shard of its key, so that all copies
   of a window meet. The runs of a key with very many are dealt over several shards by row and
   place. A shard has a bounded number of runs.
3. Index. A shard's texts become one text over word-block symbols (BLOCKS of them, a step apart, cover a
   window), its Burrows-Wheeler transform a wavelet matrix of bit vectors with rank counts:
   a compressed FM-index.
4. Matching statistics. The runs are streamed against the index: backward search from a window's last block
   to its first, in lockstep over all windows, goes on as long as the suffix interval holds
   two places or more. The words matched so are the window's statistic; where it reaches
   the window's length the interval is reported. Its start names the window's words, and the
   earliest place of a name is the first occurrence.
5. For keys dealt over several shards the first of each shard's windows are compared by a
   128-bit hash of the window's words.
6. Words that a repeated later window covers are removed; the kept words are hashed.

Order is (doc_id, start); a null id comes last. Texts with fewer words than a window, null and
empty texts lose nothing. Rows with one id and text are one document twice and don't count
as copies of each other; neither do windows at the same start of different rows with one id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 20
KEY_WORDS = 5
#: Windows of a run at most.
RUN = 96
#: Runs of a shard, about, and of one key in a shard, about.
SHARD_RUNS = 20_000
KEY_RUNS = 5_000
LAST = (1 << 63) - 1
#: Words of one document among which the runs of a hot key stay together.
NEAR_WORDS = 1 << 12
#: Blocks that cover a window.
BLOCKS = 4
_WORD_BYTES = 8
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


class BitVector:
    """Packed bits with the ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words[:-1]).astype(np.int64))]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Rank of symbols over a sequence of numbers below `size`."""

    def __init__(self, values: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.bits: list[BitVector] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1
            self.bits.append(BitVector(bit.astype(bool)))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        self.first = self._down(np.arange(size, dtype=np.int64), np.zeros(size, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros)):
            one = ((symbols >> (self.levels - 1 - k)) & 1).astype(bool)
            ones = bits.rank(at)
            at = np.where(one, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol comes before its position."""
        return self._down(symbols, at) - self.first[symbols]


class FMIndex:
    """Over texts of word hashes, for patterns of `window` words.

    A symbol is a block of words; BLOCKS of them, `step` words apart, cover a window. Suffixes
    are sorted by as many blocks as a pattern has, which is all that backward search of
    such patterns needs.
    """

    def __init__(self, words: np.ndarray, starts: np.ndarray, window: int = WINDOW):
        self.window, self.blocks = window, min(BLOCKS, window)
        self.step = window // self.blocks
        self.block = window - (self.blocks - 1) * self.step
        n, reach = len(words), (self.blocks - 1) * self.step
        owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        g = common.grams(words, self.block)
        inside = np.flatnonzero(owner[: len(g)] == owner[self.block - 1 :]) if len(g) else np.zeros(0, np.int64)
        names, symbol = np.unique(g[inside], return_inverse=True)
        size = len(names) + 1  # 0 stands for the end of a text
        self.symbols = np.zeros(n + reach, np.int64)
        self.symbols[inside] = symbol + 1
        end = starts[1:][owner[inside]] if len(inside) else inside
        order = np.zeros(len(inside), np.int64)
        for k in range(self.blocks - 1, -1, -1):
            here = np.where(inside + k * self.step + self.block <= end, self.symbols[inside + k * self.step], 0)
            order = here * (len(inside) + 1) + order
            if k:
                order = np.unique(order, return_inverse=True)[1]
        self.suffixes = inside[np.argsort(order, kind="stable")]
        begin = starts[:-1][owner[self.suffixes]] if len(inside) else inside
        back = self.suffixes - self.step
        bwt = np.where(back >= begin, self.symbols[np.maximum(back, 0)], 0)
        self.below = np.searchsorted(self.symbols[self.suffixes], np.arange(size + 1))
        # suffixes with a symbol that nothing follows come first of that symbol's, and no suffix has it before it
        last = inside + self.step + self.block > end
        self.first = self.below[:-1] + np.bincount(self.symbols[inside[last]], minlength=size)
        self.wavelet = WaveletMatrix(bwt, size)
        #: Where windows begin.
        self.windows = inside[inside + window <= end] if len(inside) else inside

    def statistics(self, at: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, lo, hi) for the windows that begin at these positions: how many of their last words, by whole blocks, occur
        at `least` places or more, and the suffix interval of these words."""
        words, lo, hi = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        a, b = np.zeros(len(at), np.int64), np.full(len(at), len(self.suffixes))
        for k in range(self.blocks - 1, -1, -1):
            symbol = self.symbols[at[live] + k * self.step]
            if k == self.blocks - 1:
                a, b = self.below[symbol], self.below[symbol + 1]
            else:
                a, b = self.first[symbol] + self.wavelet.rank(symbol, a), self.first[symbol] + self.wavelet.rank(symbol, b)
            wide = b - a >= least
            live, a, b = live[wide], a[wide], b[wide]
            words[live], lo[live], hi[live] = self.window - k * self.step, a, b
        return words, lo, hi


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, hash, text): with its text's hash an id is the identity of a row."""
    return common.texts(df, id_col, text_col).select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("hash"), "text")


def runs(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, doc_id, hash, place): the runs of windows of each text; place packs start, whether the run repeats itself, and windows."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("hash", pa.int64()), ("place", pa.int64())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        raws = b.column(2).cast(pa.binary()).to_pylist()
        words, starts = common.hashed_words(raws)
        n = len(words) - window + 1
        if n <= 0:
            return common.batch(schema, [], [], [], [])
        key = common.window_min(common.grams(words, KEY_WORDS), window - KEY_WORDS + 1)
        owner = np.repeat(np.arange(len(raws)), np.diff(starts))
        at = np.flatnonzero(owner[:n] == owner[window - 1 :])
        if not len(at):
            return common.batch(schema, [], [], [], [])
        whole = common.grams(words, window)[at]
        key, of, at = key[at], owner[at], at - starts[owner[at]]
        new = np.ones(len(at), bool)
        new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
        first = np.flatnonzero(new)
        long = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        first = np.flatnonzero(new | (long % RUN == 0))
        count = np.diff(np.append(first, len(at)))
        # a run of one key may repeat a window itself: a text with a short period
        run_of = np.cumsum(new)
        twice = np.zeros(len(at) + 1, np.int64)
        for d in range(1, min(window, len(at))):
            twice[:-1][:-d] |= (whole[d:] == whole[:-d]) & (run_of[d:] == run_of[:-d])
        own = (np.add.reduceat(twice[:-1], first) > 0) | (count > window - KEY_WORDS + 1) | (np.diff(np.append(first, len(at))) == RUN)
        row = pa.array(of[first])
        return common.batch(schema, common.i64(key[first]), b.column(0).take(row), b.column(1).take(row), pa.array(at[first] << 32 | own.astype(np.int64) << 31 | count << 24))

    return common.arrow_map(df, run, "key long, doc_id long, hash long, place long")


def repeated_runs(found: DataFrame) -> DataFrame:
    """(doc_id, hash, key, place, split): runs whose key another run has or that repeat themselves; split: over how many shards the key is dealt."""
    own = F.shiftright("place", 31).bitwiseAND(F.lit(1)) == 1
    counts = found.groupBy("key").agg(F.count("*").alias("n"), F.max(own).alias("own")).where("n > 1 or own").select(F.col("key"), F.ceil(F.col("n") / KEY_RUNS).cast("int").alias("split"))
    return found.join(counts.hint("merge"), "key").select("doc_id", "hash", "key", "place", "split")


def run_texts(docs: DataFrame, repeated: DataFrame, shards: int, window: int = WINDOW) -> DataFrame:
    """(shard, hot, doc_id, hash, start, words): the word hashes of each run."""
    schema = pa.schema([("shard", pa.int64()), ("hot", pa.bool_()), ("doc_id", pa.int64()), ("hash", pa.int64()), ("start", pa.int32()), ("words", pa.binary())])
    by_doc = repeated.groupBy("doc_id", "hash").agg(F.collect_list("key").alias("keys"), F.collect_list(F.struct("place", "split")).alias("places"))
    joined = docs.join(by_doc.hint("merge"), ["doc_id", "hash"]).groupBy("doc_id", "hash").agg(*[F.first(c).alias(c) for c in ("text", "keys", "places")])  # repeated rows once

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        docs_, hashes = b.column(0).to_numpy(), b.column(1).to_numpy()
        words, begin = common.hashed_words(b.column(2).cast(pa.binary()).to_pylist())
        found = b.column(4)
        row = np.repeat(np.arange(b.num_rows), np.diff(found.offsets.to_numpy()))
        key, (place, split) = b.column(3).flatten().to_numpy(), (found.flatten().field(k).to_numpy().astype(np.int64) for k in range(2))
        start, n = place >> 32, place >> 24 & 0x7F
        mixed = common.join2(common.mix(docs_[row].view(np.uint64)) ^ hashes[row].view(np.uint64), (start // NEAR_WORDS).astype(np.uint64), 3)
        part = (mixed >> np.uint64(1)).astype(np.int64) % split
        shard = (common.join2(key.view(np.uint64), part.astype(np.uint64), 4) >> np.uint64(1)).astype(np.int64) % shards
        raw = words.tobytes()
        at = (begin[row] + start) * _WORD_BYTES
        texts = [raw[i:j] for i, j in zip(at.tolist(), (at + (n + window - 1) * _WORD_BYTES).tolist())]
        return common.batch(schema, shard, split > 1, docs_[row], hashes[row], start.astype(np.int32), texts)

    return common.arrow_map(joined, run, "shard long, hot boolean, doc_id long, hash long, start int, words binary")


def shard_repeats(rows: list[tuple], window: int = WINDOW) -> list[tuple]:
    """Of one shard's rows (hot, doc_id, hash, start, words): (doc_id, hash, start, windows, key or None).

    With a key, of 128 bits of its words: the shard's first of that window, which other shards may have earlier.
    """
    same: dict[bytes, int] = {}
    which = np.array([same.setdefault(r[4], len(same)) for r in rows])
    words = np.frombuffer(b"".join(same), "<u8").astype(np.uint64)
    sizes = np.array([len(t) // _WORD_BYTES for t in same], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    copies = np.bincount(which)
    index = FMIndex(words, starts, window)
    # rows of equal words share their text, which then counts as often
    matched, lo, _ = index.statistics(index.windows)
    name = np.full(len(words) + 1, -1, np.int64)
    name[index.windows] = np.where(matched >= window, lo, -1)
    alone = np.flatnonzero((matched < window) & (copies[np.searchsorted(starts, index.windows, side="right") - 1] > 1))
    name[index.windows[alone]] = len(index.suffixes) + np.arange(len(alone))
    counts = sizes[which] - window + 1
    row = np.repeat(np.arange(len(rows)), counts)
    offset = common.ragged(np.zeros(len(rows), np.int64), counts)
    doc, first = np.array([r[1] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64)
    interval = name[starts[which[row]] + offset]
    place_doc, place_start = doc[row], first[row] + offset
    order = np.lexsort((place_start, place_doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (place_doc[order][1:] != place_doc[order][:-1]) | (place_start[order][1:] != place_start[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(fresh)
    repeated = interval >= 0
    best = np.full(len(index.suffixes) + len(alone), np.iinfo(np.int64).max)
    np.minimum.at(best, interval[repeated], rank[repeated])
    later = np.zeros(len(row), bool)
    later[repeated] = rank[repeated] > best[interval[repeated]]
    out = []
    edge = np.flatnonzero(later & np.concatenate([[True], ~(later[:-1] & (row[1:] == row[:-1]))]))
    stop = np.flatnonzero(later & np.concatenate([~(later[1:] & (row[1:] == row[:-1])), [True]]))
    for a, b in zip(edge.tolist(), stop.tolist()):
        r = rows[row[a]]
        out.append((r[1], r[2], int(place_start[a]), b - a + 1, None))
    hot = np.array([r[0] for r in rows])
    for k in np.flatnonzero(~later & hot[row]).tolist():
        r, o = rows[row[k]], int(offset[k])
        out.append((r[1], r[2], int(place_start[k]), 1, xxhash.xxh3_128_digest(r[4][o * _WORD_BYTES : (o + window) * _WORD_BYTES])))
    return out


def repeats(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, hash, start, windows): windows of (doc_id, hash, text) rows that occur earlier; reads tables of cut()."""
    with common.stored(runs(df, window)) as found:
        repeated = common.cut(repeated_runs(found))
    shards = max(1, -(-repeated.count() // SHARD_RUNS))
    parts = max(common.shuffles(df), min(shards, 4 * common.shuffles(df)))
    laid = run_texts(df, repeated, shards, window).repartition(parts, "shard").sortWithinPartitions("shard")
    schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("same", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def done() -> pa.RecordBatch:
            out = shard_repeats(held, window)
            return common.batch(schema, *(map(list, zip(*out)) if out else [[]] * 5))

        for b in batches:
            for shard, *row in zip(*(b.column(k).to_pylist() for k in range(6))):
                if held and shard != now:
                    yield done()
                    held = []
                now = shard
                held.append(tuple(row))
        if held:
            yield done()

    found = common.cut(laid.mapInArrow(run, "doc_id long, hash long, start int, windows int, same binary"))
    common.discard(repeated)
    hot = found.where("same is not null")
    first = hot.groupBy("same").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").select("same", "first")
    later = hot.join(first, "same").where(F.struct("doc_id", "start") > F.col("first")).select("doc_id", "hash", "start", "windows")
    return found.where("same is null").select("doc_id", "hash", "start", "windows").union(later)


def _covered(n: int, places: list[tuple[int, int]], window: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for start, windows in places:
        edge[start] += 1
        edge[start + windows + window - 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def _places(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, hash, found) of the rows that lose words."""
    return repeats(rows, window).groupBy("doc_id", "hash").agg(F.collect_list(F.struct("start", "windows")).alias("found"))


def dedup(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""
    rows = _rows(df, id_col, text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, text, found in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
            words = text.split()
            n = len(words)
            if found:
                gone = _covered(n, [(f["start"], f["windows"]) for f in found], window)
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            out.append((None if doc == LAST else doc, n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
        return common.batch(schema, *map(list, zip(*out)))

    met = rows.join(_places(rows, window).hint("merge"), ["doc_id", "hash"], "left").select("doc_id", "text", "found")
    return common.arrow_map(met, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_text(raw: bytes, gone: np.ndarray) -> bytes:
    """The text without the words marked, each with the white space before it; the rest stays as it was."""
    out, at = [], 0
    for m, g in zip(_WORD.finditer(raw), gone.tolist()):
        if not g:
            out.append(raw[at : m.end()])
        at = m.end()
    out.append(raw[at:])
    return b"".join(out).strip(b" \t\n\x0b\x0c\r") if gone.any() else raw


def keep_first(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with later windows taken out of their texts, all columns with them; documents left without a word go."""
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")).select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(text).alias("hash"))

    def trim(text: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, f in zip(text, found):
            if f is None or t is None:
                out.append(t)
                continue
            raw = t.encode()
            out.append(cut_text(raw, _covered(len(raw.split()), [(x["start"], x["windows"]) for x in f], window)).decode())
        return pd.Series(out, dtype=object)

    trimmed = F.pandas_udf(trim, "string")
    out = rows.join(_places(_rows(df, "doc_id", "text"), window).hint("merge"), ["doc_id", "hash"], "left").select("row", "found", trimmed(F.col("row.text").cast("string"), F.col("found")).alias("kept"))
    left = F.col("found").isNull() | F.coalesce("kept", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return out.where(left).select(*[F.col("kept").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in df.columns])
