"""Near-duplicate lines by a deletion-neighbourhood join; the earliest line is kept.

A line is its words. Two lines are near if their word edit distance (insertions, deletions,
substitutions) is within the bound of the longer: one edit for each `per` words, but one edit
from FEW words on. The bound of shorter lines is nought, so they must be equal. A line goes if
an earlier one, by (doc_id, hash of the text, line number), is equal or near.

1. Variants. Where the bound is one edit, a line has as variants itself and what is left when
   any one word is deleted; near lines share one. Longer lines have too many of those, so all
   but a run of words is deleted: k edits leave a run of (n - k) / (k + 1) words or more that
   both lines have. Of the runs of q words in each such stretch the least hash is taken,
   so both lines take the same, and a line has about one variant for three words.
2. A variant is three numbers: its hash, the line's key, and the line's length with the place
   of the run. They travel in packs, by buckets of their hashes. Lines none of whose variants
   another line of fitting length and place has are done: nearly all of them.
3. The rest fetch their text. Per variant a line meets the earliest line that it may be near
   by length, place and a sketch: SKETCH parities of the hashed words, of which k edits change
   2 k at most. The earliest of all of these is verified by the edit distance.
4. Lines that are still there meet more of those that come earlier, first WIDTHS[1] for
   each variant, then all. A group of near copies thus costs a pair a member, not one for each two.
5. Occurrences of lines that go are joined back to their documents.

Null and empty texts have no lines that could go; lines without words always stay and are equal
to nothing. Rows equal in id and text are one document twice: neither is earlier. A null id
comes last, and rows of one id with different texts are different documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Words of the longer line for each edit, and the least words for one edit (a fifth of such a line).
WORDS_PER_EDIT, FEW = 10, 5
#: Lines that a line meets for each variant: at first, then, then all.
WIDTHS = (1, 16, 1 << 40)
#: Buckets of variants for each shuffle partition, and variants of a bucket that a task holds before it lets shared ones pass.
BUCKETS, HELD = 4, 1 << 23
#: Pairs of lines that are looked at in one step, and bytes of text that are verified at once, about.
BLOCK, VERIFIED_BYTES = 1 << 19, 8 << 20
#: Parities of a line's words that pairs are judged by before their texts are read, 256 at most, and before their edit distance is looked for.
SKETCH, PARITIES = 256, 4096
#: Edits up to which pairs are verified many at once, and cells of their tables that one step holds.
MOST_BAND, BAND_CELLS = 400, 1 << 16
LAST = (1 << 63) - 1
#: From here on lengths are only known to be large, and places unknown.
LARGE = (1 << 16) - 1
_WHITE = r"[\x20\x09-\x0D]+"
_PLACE = ("doc_id", "hash", "at")
_SKETCH = tuple(f"s{k}" for k in range(SKETCH // 64))


def bound(n, per: int = WORDS_PER_EDIT):
    """Edits that a pair may differ by whose longer line has n words."""
    return np.maximum(n // per, np.minimum(n // FEW, 1))


def classes(per: int) -> list[tuple[int, int, int, int]]:
    """(least, most, q, w): a line of least to most words shares w runs of q words in a row with any near line that is no longer."""
    ends = range(2 * per, per * per + 1)  # longer lines share no less than those of per * per words
    shared = [-(-(n - n // per) // (n // per + 1)) for n in ends]
    lowest = [min(shared[k:]) for k in range(len(shared))]
    begin = [k for k in range(len(ends)) if k == 0 or lowest[k] > lowest[k - 1]]
    most = [ends[k] - 1 for k in begin[1:]] + [LAST]
    return [(ends[k], m, (lowest[k] + 1) // 2, lowest[k] // 2 + 1) for k, m in zip(begin, most)]


def distance(x: list, y: list) -> int:
    """Word edit distance: a column of the table is the bits of two integers."""
    while x and y and x[-1] == y[-1]:
        x, y = x[:-1], y[:-1]
    k = 0
    while k < min(len(x), len(y)) and x[k] == y[k]:
        k += 1
    x, y = x[k:], y[k:]
    if not x or not y:
        return len(x) + len(y)
    at: dict = {}
    for k, w in enumerate(x):
        at[w] = at.get(w, 0) | 1 << k
    full, top = (1 << len(x)) - 1, 1 << (len(x) - 1)
    up, down, d = full, 0, len(x)
    for w in y:
        eq = at.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        more, less = down | (full & ~(xh | up)), up & xh
        d += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & full, (less << 1) & full
        up, down = less | (full & ~(xv | more)), more & xv
    return d


def near_pairs(x: Lines, y: Lines, per: int = WORDS_PER_EDIT) -> np.ndarray:
    """Whether the lines of each pair are within the bound of the longer."""
    k = bound(np.maximum(x.n, y.n), per)
    out = np.zeros(len(k), bool)
    even = np.flatnonzero(x.n == y.n)
    if len(even):  # as many words changed as allowed at the most, in the same places
        a, b = (z.hashes[common.ragged(z.starts[even], z.n[even])] for z in (x, y))
        out[even] = np.add.reduceat((a != b).astype(np.int64), np.cumsum(x.n[even]) - x.n[even]) <= k[even]
    rest = ~out & (np.abs(x.n - y.n) <= k)
    some = np.flatnonzero(rest)
    rest[some] = _alike(x, y, some) <= 2 * k[some]
    some = np.flatnonzero(rest & (k <= MOST_BAND))
    out[some] = _within(x, y, some, k)
    for r in np.flatnonzero(rest & (k > MOST_BAND)).tolist():
        out[r] = distance(*(z.hashes[z.starts[r] : z.starts[r + 1]].tolist() for z in (x, y))) <= k[r]
    return out


def _alike(x: Lines, y: Lines, which: np.ndarray) -> np.ndarray:
    """How many of PARITIES parities of their words tell the lines of these pairs apart: an edit changes two at most."""
    out = np.zeros(len(which), np.int64)
    for at in range(0, len(which), 512):
        pair = which[at : at + 512]
        bits = [(z.hashes[common.ragged(z.starts[pair], z.n[pair])] >> np.uint64(20)).astype(np.int64) % PARITIES + np.repeat(np.arange(len(pair)) * PARITIES, z.n[pair]) for z in (x, y)]
        odd = np.bincount(np.concatenate(bits), minlength=len(pair) * PARITIES) & 1
        out[at : at + 512] = odd.reshape(len(pair), PARITIES).sum(axis=1)
    return out


def _within(x: Lines, y: Lines, which: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the edit distance of these pairs is k at most: many tables at once, an antidiagonal after the other, next to the main diagonal."""
    out = np.zeros(len(which), bool)
    order = np.lexsort((x.n[which] + y.n[which], k[which]))
    bounds = k[which[order]]
    at = 0
    while at < len(order):
        stop = min(at + max(1, BAND_CELLS // (int(bounds[at]) + 1)), int(np.searchsorted(bounds, bounds[at] + 1 + bounds[at] // 4, side="right")))
        _antidiagonals(x, y, which, order[at:stop], int(bounds[stop - 1]), k, out)
        at = stop
    return out


def _antidiagonals(x: Lines, y: Lines, which: np.ndarray, place: np.ndarray, most: int, k: np.ndarray, out: np.ndarray) -> None:
    """Sets out at these places. Cells (i, j) of step i + j are told apart by j - i, which is -most, 2 - most, ... or one more."""
    pair = which[place]
    n, m, limit = x.n[pair], y.n[pair], k[pair]
    wide, far = int(max(n.max(), m.max())) + 2 * most + 2, 1 << 13
    a, b = np.zeros((len(pair), wide), np.uint64), np.ones((len(pair), wide), np.uint64)  # never equal where there is no word
    row = np.arange(len(pair))
    a[np.repeat(row, n), wide - 1 - most - common.ragged(np.zeros(len(pair), np.int64), n)] = x.hashes[common.ragged(x.starts[pair], n)] | np.uint64(2)  # backwards
    b[np.repeat(row, m), most + common.ragged(np.zeros(len(pair), np.int64), m)] = y.hashes[common.ragged(y.starts[pair], m)] | np.uint64(2)
    # now: the cells whose j - i is of the parity of the step; lists with most + 1 cells, or with most and a far cell at either end
    if most % 2 == 0:
        now = np.full((len(pair), most + 1), far, np.int16)
        now[:, most // 2] = 0
        last = np.full((len(pair), most + 2), far, np.int16)
    else:
        now = np.full((len(pair), most + 2), far, np.int16)
        now[:, (most + 1) // 2] = 0
        last = np.full((len(pair), most + 1), far, np.int16)
    final = n + m
    for t in range(1, int(final.max()) + 1):
        inner = (t - most) % 2 != 0  # cells from 1 - most on, held between two far ones
        low = 1 - most if inner else -most
        count = most if inner else most + 1
        i, j = (t - low) // 2, (t + low) // 2  # of the first cell
        apart = a[:, wide - most - i : wide - most - i + count] != b[:, most + j - 1 : most + j - 1 + count]
        before = last[:, 1:-1] if inner else last
        new = before + apart
        np.minimum(new, np.minimum(now[:, :-1], now[:, 1:]) + np.int16(1), out=new)
        if t <= most:  # outside the table
            new[:, : max(0, -j)] = far
            new[:, max(0, i + 1) :] = far
        if inner:
            last = np.full((len(new), most + 2), far, np.int16)
            last[:, 1:-1] = new
        else:
            last = new
        last, now = now, last
        done = np.flatnonzero(final == t)
        if len(done):
            out[place[done]] = new[done, ((m - n)[done] - low) // 2] <= limit[done]
        if t % 16 == 0:
            live = np.flatnonzero((np.minimum(now.min(axis=1), last.min(axis=1)) <= limit) & (final > t))
            if len(live) < 0.7 * len(now):
                place, n, m, limit, final, a, b, now, last = (z[live] for z in (place, n, m, limit, final, a, b, now, last))
                if not len(live):
                    return


def _documents(df: DataFrame) -> DataFrame:
    """(doc_id, hash, text): with its text's hash an id is the identity of a row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))


class Lines:
    """Lines that have words: the hashes of all words in a row, and the number of words of each line."""

    def __init__(self, hashes: np.ndarray, n: np.ndarray) -> None:
        self.hashes, self.n = hashes, n
        self.starts = np.concatenate([[0], np.cumsum(n)])

    @classmethod
    def of(cls, column: pa.Array) -> Lines:
        """A line a row."""
        data, offsets = common.raw_bytes(column)
        begin, _, hashes = common.word_spans(data, offsets)
        return cls(hashes, np.diff(np.searchsorted(begin, offsets)))

    @classmethod
    def inside(cls, column: pa.Array) -> tuple[Lines, np.ndarray, np.ndarray]:
        """The lines of texts, with their rows and numbers."""
        data, offsets = common.raw_bytes(column)
        begin, _, hashes = common.word_spans(data, offsets)
        row = np.searchsorted(offsets, begin, side="right") - 1
        breaks = np.zeros(len(data) + 1, np.int32)
        np.cumsum(data == 10, out=breaks[1:])
        at = breaks[begin] - breaks[offsets[row]]
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1])])) if len(begin) else begin
        return cls(hashes, np.diff(np.append(first, len(begin)))), row[first], at[first]

    def some(self, which: np.ndarray) -> Lines:
        return Lines(self.hashes[common.ragged(self.starts[which], self.n[which])], self.n[which])

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each line in halves."""
        if not len(self.n):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        power = common.powers(int(self.n.max()))[0][common.ragged(np.zeros(len(self.n), np.int64), self.n)]
        n = self.n.astype(np.uint64)
        return tuple(common.join2(np.add.reduceat(common.mix(self.hashes ^ np.uint64(salt)) * power, self.starts[:-1]), n, salt & 0xFF) for salt in (0x8CB92BA72F3D8DD7, 0x5851F42D4C957F2D))

    def deletions(self, per: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, line, 0) of all variants of the lines whose bound with an equally long line is one edit."""
        some = np.flatnonzero((self.n >= FEW - 1) & (self.n < 2 * per))
        n, first = self.n[some], self.starts[some]
        owner = np.repeat(np.arange(len(some)), n)
        j = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        h = self.hashes[first[owner] + j]
        step = np.uint64(0xA0761D6478BD642F)
        stay, moved = common.mix(h + j.astype(np.uint64) * step), common.mix(h + (j - 1).astype(np.uint64) * step)
        upto = np.concatenate([[np.uint64(0)], np.cumsum(stay)])
        after = np.concatenate([[np.uint64(0)], np.cumsum(moved)])
        begin = np.cumsum(n) - n
        at = begin[owner] + j
        one = (upto[at] - upto[begin[owner]]) + (after[begin[owner] + n[owner]] - after[at + 1])
        whole = upto[begin + n] - upto[begin]
        token = np.concatenate([common.join2(one, (n[owner] - 1).astype(np.uint64), 21), common.join2(whole, n.astype(np.uint64), 21)])
        line = np.concatenate([some[owner], some])
        return token, line, np.zeros(len(line), np.int64)

    def runs(self, per: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(hash, line, place) of the runs taken, for each class of lengths; a run that a line has twice is anywhere."""
        for number, (least, most, q, w) in enumerate(classes(per)):
            which = np.flatnonzero((self.n >= least - least // per) & (self.n <= most))
            if not len(which):
                continue
            mine = self.some(which)
            g = common.grams(mine.hashes, q)
            order = common.mix(g ^ np.uint64(0x2545F4914F6CDD1D))
            lowest = common.window_min(order, w)  # every line has w runs or more
            whole = np.ones(len(lowest), bool)
            late = common.ragged(mine.starts[1:] - (q + w - 2), np.full(len(which), q + w - 2))  # windows that reach into the next line
            whole[late[late < len(whole)]] = False
            taken = np.zeros(len(g), bool)
            for d in range(w):
                taken[d : d + len(lowest)] |= whole & (order[d : d + len(lowest)] == lowest)
            at = np.flatnonzero(taken)
            line = np.searchsorted(mine.starts, at, side="right") - 1
            token, place = common.join2(g[at], np.full(len(at), number, np.uint64), 23), at - mine.starts[line]
            by = np.lexsort((token, line))
            token, line, place = token[by], line[by], place[by]
            first = np.ones(len(by), bool)
            first[1:] = (token[1:] != token[:-1]) | (line[1:] != line[:-1])
            once = first & np.append(first[1:], True)[: len(first)]
            yield token[first], which[line[first]], np.where(once, place, LARGE)[first]

    def variants(self, per: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, line, length and place in one number of 32 bits) of all variants."""
        found = [self.deletions(per), *self.runs(per)]
        token, line, place = (np.concatenate([f[k] for f in found]) for k in range(3))
        return token, line, (np.minimum(self.n[line], LARGE) << 16 | np.minimum(place, LARGE)).astype(np.uint32)

    def sketches(self) -> list[np.ndarray]:
        """SKETCH parities for each line, in numbers of 64: an edit changes two at most."""
        bit = self.hashes >> np.uint64(56)
        one = np.uint64(1) << (bit & np.uint64(63))
        out = []
        for part in range(SKETCH // 64):
            upto = np.zeros(len(bit) + 1, np.uint64)
            np.bitwise_xor.accumulate(np.where(bit >> np.uint64(6) == part, one, np.uint64(0)), out=upto[1:])
            out.append(upto[self.starts[1:]] ^ upto[self.starts[:-1]])
        return out


def packs(docs: DataFrame, per: int, buckets: int) -> DataFrame:
    """(bucket, places, pack): of all lines the variants, by buckets of their hashes, those of equal lines of a batch once, and, by row, the keys and places.

    A pack of variants is their tokens, keys and forms, one of places the lines' keys in halves, ids, hashes and numbers.
    """
    schema = pa.schema([("bucket", pa.int32()), ("places", pa.bool_()), ("pack", pa.binary())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found, row, at = Lines.inside(b.column(2))
        k1, k2 = found.keys()
        doc, hash_ = b.column(0).to_numpy(), b.column(1).to_numpy()
        spread = int(hash_[0]) % buckets if len(hash_) else 0
        whole = k1.tobytes() + k2.tobytes() + doc[row].tobytes() + hash_[row].tobytes() + at.astype(np.int32).tobytes()
        some = np.flatnonzero(found.n >= FEW - 1)
        key, first = np.unique(k1[some], return_index=True)
        token, line, form = found.some(some[first]).variants(per)
        bucket = (token >> np.uint64(33)).astype(np.int64) % buckets
        by = np.argsort(bucket, kind="stable")
        token, key, form = token[by], key[line[by]], form[by]
        ends = np.cumsum(np.bincount(bucket, minlength=buckets))
        full = np.flatnonzero(np.diff(np.concatenate([[0], ends])))
        spans = [(int(ends[k - 1]) if k else 0, int(ends[k])) for k in full.tolist()]
        made = [token[i:j].tobytes() + key[i:j].tobytes() + form[i:j].tobytes() for i, j in spans]
        return common.batch(schema, [spread, *full.tolist()], [True, *[False] * len(full)], [whole, *made])

    return common.arrow_map(docs, run, "bucket int, places boolean, pack binary", limit=common.SLICE_BYTES // 4)


def _unpacked(pack: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(pack) // 20
    return np.frombuffer(pack, np.uint64, n), np.frombuffer(pack, np.uint64, n, 8 * n), np.frombuffer(pack, np.uint32, n, 16 * n)


def _fit(form: np.ndarray, other: np.ndarray, per: int) -> np.ndarray:
    """Whether lines of these lengths, with a variant at these places, may be near."""
    n, place, m, at = (x.astype(np.int64) for x in (form >> 16, form & LARGE, other >> 16, other & LARGE))
    most = np.maximum(n, m)
    k = bound(most, per)
    anywhere = (place == LARGE) | (at == LARGE) | (most == LARGE)
    return (np.abs(n - m) <= k) & (anywhere | (np.abs(place - at) <= k) & (np.abs(n - place - m + at) <= k))


def _alive(token: np.ndarray, key: np.ndarray, form: np.ndarray, per: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The variants, once for each line, that a line of fitting length and place has too. May be more, never fewer."""
    by = np.argsort(token)
    token = token[by]
    same = token[1:] == token[:-1]
    many = np.zeros(len(token), bool)
    many[1:] |= same
    many[:-1] |= same
    token, key, form = token[many], key[by[many]], form[by[many]]
    by = np.lexsort((key, form, token))
    token, key, form = token[by], key[by], form[by]
    new = np.ones(len(by), bool)
    new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1]) | (form[1:] != form[:-1])
    token, key, form = token[new], key[new], form[new]
    begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(token)))
    # of a large group those whose neighbour in length is too far away are done
    out = np.zeros(len(token), bool)
    n = (form >> 16).astype(np.int64)
    step = (token[1:] == token[:-1]) & (n[1:] - n[:-1] <= bound(n[1:], per))
    out[1:] |= step
    out[:-1] |= step
    out &= np.repeat(size > 16, size)
    for d in range(1, min(16, int(size.max(initial=0)))):
        i = np.flatnonzero(token[d:] == token[:-d])
        i = i[key[i + d] != key[i]]
        i = i[_fit(form[i + d], form[i], per)]
        out[i] = out[i + d] = True
    return token[out], key[out], form[out]


class Bucket:
    """The variants of a bucket as they come; beyond HELD of them those that are shared so far pass unseen."""

    def __init__(self, per: int) -> None:
        self.per, self.held, self.rows, self.passed = per, [], 0, np.zeros(0, np.uint64)

    def _whole(self) -> list[np.ndarray]:
        found = [np.concatenate(c) for c in zip(*self.held)] if self.held else [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)]
        self.held, self.rows = [], 0
        return found

    def add(self, pack: bytes) -> Iterator[tuple]:
        self.held.append(_unpacked(pack))
        self.rows += len(self.held[-1][0])
        if self.rows > HELD:
            found = self._whole()
            tokens, count = np.unique(found[0], return_counts=True)
            self.passed = np.union1d(self.passed, tokens[count > 1])
            gone = np.isin(found[0], self.passed)
            yield tuple(c[gone] for c in found)
            self.held = [tuple(c[~gone] for c in found)]
            self.rows = len(self.held[0][0])

    def end(self) -> Iterator[tuple]:
        found = self._whole()
        if len(self.passed):
            gone = np.isin(found[0], self.passed)
            yield tuple(c[gone] for c in found)
            found = [c[~gone] for c in found]
        yield _alive(*found, self.per)


def scanned(docs: DataFrame, per: int) -> DataFrame:
    """(places, k1, k2, doc_id, hash, at): the key and place of each line that has words; where places is false, the variants that
    several lines have which may be near: in k2 the token, in doc_id the form."""
    schema = pa.schema([("places", pa.bool_()), *((c, pa.int64()) for c in ("k1", "k2", "doc_id", "hash")), ("at", pa.int32())])

    def shared(token: np.ndarray, key: np.ndarray, form: np.ndarray) -> pa.RecordBatch:
        none = np.zeros(len(key), np.int64)
        return common.batch(schema, none.astype(bool), common.i64(key), common.i64(token), common.i64(form), none, none.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bucket = None, Bucket(per)
        for b in batches:
            for number, places, pack in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if places:
                    raw, n = pack.as_buffer(), pack.as_buffer().size // 36
                    yield common.batch(schema, np.ones(n, bool), *(np.frombuffer(raw, np.int64, n, 8 * n * k) for k in range(4)), np.frombuffer(raw, np.int32, n, 32 * n))
                    continue
                if number != now:
                    yield from (shared(*x) for x in bucket.end())
                    now, bucket = number, Bucket(per)
                yield from (shared(*x) for x in bucket.add(pack.as_buffer()))
        yield from (shared(*x) for x in bucket.end())

    parts = common.shuffles(docs)
    return packs(docs, per, BUCKETS * parts).repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "places boolean, k1 long, k2 long, doc_id long, hash long, at int")


def fetched(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(k1, doc_id, hash, at, line, s0, ...): the lines at these places, words parted by one space, and their sketches."""
    schema = pa.schema([("k1", pa.int64()), ("doc_id", pa.int64()), ("hash", pa.int64()), ("at", pa.int32()), ("line", pa.string()), *((c, pa.int64()) for c in _SKETCH)])
    wanted = places.groupBy("doc_id", "hash").agg(F.collect_list("at").alias("wanted"), F.collect_list("k1").alias("k1"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        row, at, line, keys = [], [], [], []
        for r, (text, numbers, k1) in enumerate(zip(b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())):
            raws = text.split(b"\n")
            row += [r] * len(numbers)
            at += numbers
            keys += k1
            line += [b" ".join(raws[k].split()) for k in numbers]
        row, line = pa.array(row, pa.int32()), pa.array(line, pa.binary()).cast(pa.string())
        return common.batch(schema, keys, b.column(0).take(row), b.column(1).take(row), at, line, *map(common.i64, Lines.of(line).sketches()))

    met = docs.join(wanted.hint("merge"), ["doc_id", "hash"]).groupBy("doc_id", "hash").agg(*[F.first(c).alias(c) for c in ("text", "wanted", "k1")])  # repeated rows once
    return common.arrow_map(met, run, "k1 long, doc_id long, hash long, at int, line string, " + ", ".join(f"{c} long" for c in _SKETCH))


def _met(group: list[np.ndarray], skip: int, width: int, per: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, earlier line, whether there are more): for each open line the skip+1st to width-th earlier line of its group that it may be near."""
    token, doc, hash_, at, form, open_, *marks = group
    marks = [m.view(np.uint64) for m in marks]
    form, n = form.astype(np.uint32), form >> 16
    begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    size = np.diff(np.append(begin, len(token)))
    first = np.repeat(begin, size)

    def may(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        later = (doc[i] != doc[j]) | (hash_[i] != hash_[j]) | (at[i] != at[j])
        ok = later & _fit(form[i], form[j], per)
        i, j = i[ok], j[ok]
        apart = sum(np.bitwise_count(m[i] ^ m[j]).astype(np.int64) for m in marks)
        most = np.maximum(n[i], n[j])
        ok[ok] = (apart <= 2 * bound(most, per)) | (most == LARGE)
        return ok

    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = np.flatnonzero(open_.astype(bool) & (np.arange(len(token)) > first))
    before = np.cumsum(rows - first[rows])
    at_row = 0
    while at_row < len(rows):  # as many lines at once as have BLOCK earlier ones, one at least
        done = before[at_row - 1] if at_row else 0
        stop = max(at_row + 1, int(np.searchsorted(before, done + BLOCK, side="right")))
        some = rows[at_row:stop]
        many = some - first[some]
        i = np.repeat(some, many)
        j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + first[i]
        ok = may(i, j)
        i, j = i[ok], j[ok]
        start = np.searchsorted(i, some)
        rank = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
        total = np.repeat(np.diff(np.append(start, len(i))), np.diff(np.append(start, len(i))))
        kept = (rank >= skip) & (rank < width)
        out.append((i[kept], j[kept], total[kept] > width))
        at_row = stop
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def pairs(shared: DataFrame, live: DataFrame, skip: int, width: int, per: int) -> DataFrame:
    """(doc_id, hash, at, y_doc_id, y_hash, y_at, more): open lines, each with earlier lines that it may be near. live has a column open."""
    names = [*_PLACE, *(f"y_{c}" for c in _PLACE)]
    out = pa.schema([(c, pa.int64()) for c in names] + [("more", pa.bool_())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, _ in common.groups(batches, 6 + len(_SKETCH)):
            i, j, more = _met(group, skip, width, per)
            yield common.batch(out, *(common.i64(c[i]) for c in group[1:4]), *(common.i64(c[j]) for c in group[1:4]), more)

    rows = shared.join(live, "k1").select("token", *_PLACE, "form", "open", *_SKETCH)
    laid = rows.repartition(common.shuffles(live), "token").sortWithinPartitions("token", *_PLACE)
    return laid.mapInArrow(meet, ", ".join(f"{c} long" for c in names) + ", more boolean")


def verified(pairs: DataFrame, live: DataFrame, per: int) -> DataFrame:
    """(doc_id, hash, at, near, more) of each pair."""
    schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("at", pa.int64()), ("near", pa.bool_()), ("more", pa.bool_())])
    names = [f"y_{c}" for c in _PLACE]
    other = live.select(*[F.col(c).alias(n) for c, n in zip(_PLACE, names)], F.col("line").alias("y_line"))
    met = pairs.join(live.select(*_PLACE, "line"), list(_PLACE)).join(other, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.gathered(batches, VERIFIED_BYTES):
            yield common.batch(schema, *(b.column(k) for k in range(3)), near_pairs(Lines.of(b.column(4)), Lines.of(b.column(5)), per), b.column(3))

    return met.select("doc_id", "hash", F.col("at").cast("long").alias("at"), "more", "line", "y_line").mapInArrow(run, "doc_id long, hash long, at long, near boolean, more boolean")


def near_duplicates(docs: DataFrame, shared: DataFrame, first: DataFrame, per: int = WORDS_PER_EDIT) -> DataFrame:
    """(doc_id, hash, at): the first places of distinct lines that are near an earlier one. shared: (token, k1, form), first: (k1, doc_id, hash, at)."""
    live = common.cut(fetched(docs, first.join(shared.select("k1").distinct().hint("merge"), "k1").select("k1", *_PLACE)))
    left, gone = None, []
    for skip, width in zip((0, *WIDTHS), WIDTHS):
        some, marked = shared, live.withColumn("open", F.lit(True))
        if left is not None:  # only variants of lines that are open
            marked = live.join(left.withColumn("open", F.lit(True)), list(_PLACE), "left").withColumn("open", F.coalesce("open", F.lit(False)))
            tokens = shared.join(marked.where("open").select("k1").distinct(), "k1").select("token").distinct()
            some = shared.join(tokens, "token").select("token", "k1", "form")
        met = pairs(some, marked, skip if skip > 1 else 0, width, per)
        y = F.struct(*[F.col(f"y_{c}") for c in _PLACE])
        if left is None:  # the earliest alone
            met = met.groupBy(*_PLACE).agg(F.min(y).alias("y"), F.max(y).alias("last"), F.max("more").alias("more")).select(*_PLACE, "y.*", (F.col("more") | (F.col("y") != F.col("last"))).alias("more"))
        else:
            met = met.groupBy(*_PLACE, *[f"y_{c}" for c in _PLACE]).agg(F.max("more").alias("more"))
        judged = verified(met, live, per).groupBy(*_PLACE).agg(F.max("near").alias("near"), F.max("more").alias("more"))
        gone.append(common.cut(judged))
        left = gone[-1].where("more and not near").select(*_PLACE)
        if left.isEmpty():
            break
    found = gone[0]
    for more in gone[1:]:
        found = found.union(more)
    out = common.cut(found.where("near").select(*_PLACE).distinct())
    common.discard(live, *gone)
    return out


def removed(docs: DataFrame, per: int = WORDS_PER_EDIT) -> DataFrame:
    """(doc_id, hash, at, near): the lines that go, and whether an earlier line is near but not equal. docs: (doc_id, hash, text)."""
    found = common.cut(scanned(docs, per))
    each, shared = found.where("places").drop("places"), found.where("not places").select(F.col("k2").alias("token"), "k1", F.col("doc_id").alias("form"))
    first = each.groupBy("k1", "k2").agg(F.min(F.struct(*_PLACE)).alias("first"), F.max(F.struct(*_PLACE)).alias("last"))
    first = common.cut(first.select("k1", "k2", "first.*", (F.col("first") != F.col("last")).alias("again")))
    near = near_duplicates(docs, shared, first.select("k1", *_PLACE), per)
    met = first.join(near.withColumn("near", F.lit(True)).hint("merge"), list(_PLACE), "left").where("again or near")
    known = met.select("k1", "k2", F.struct(*_PLACE).alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    out = common.cut(each.join(known.hint("merge"), ["k1", "k2"]).where(F.col("near") | (F.struct(*_PLACE) > F.col("first"))).select(*_PLACE, "near"))
    common.discard(found, first, near)
    return out


def _kept_lines(text: pd.Series, gone: pd.Series) -> pd.Series:
    """The texts without the lines whose numbers are given."""
    out = []
    for t, g in zip(text, gone):
        if t is not None and g is not None:
            numbers = set(g)
            t = "\n".join([x for k, x in enumerate(t.split("\n")) if k not in numbers])
        out.append(t)
    return pd.Series(out, dtype=object)


def trimmed(df: DataFrame, per: int = WORDS_PER_EDIT) -> DataFrame:
    """(row, gone, near, kept) of each row: its columns, the numbers of lines that go (null if none), how many are near, what stays."""
    gone = removed(_documents(df), per).groupBy("doc_id", "hash").agg(F.collect_set("at").alias("gone"), F.count_distinct(F.when(F.col("near"), F.col("at"))).alias("near"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    rows = rows.select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit(""))).alias("hash"))
    kept = F.pandas_udf(_kept_lines, T.StringType())
    joined = rows.join(gone.hint("merge"), ["doc_id", "hash"], "left")
    text = F.col("row.text").cast("string")
    cut_ = kept(F.when(F.col("gone").isNotNull(), text), F.col("gone"))  # Python sees only texts that lose lines
    return joined.select("row", "gone", F.coalesce("near", F.lit(0)).alias("near"), F.when(F.col("gone").isNull(), text).otherwise(cut_).alias("kept"))


def dedup(df: DataFrame, per: int = WORDS_PER_EDIT) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_near, kept_sha256) of each row."""
    out = trimmed(df.select("doc_id", "text"), per)
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    return out.select(F.col("row.doc_id").cast("long").alias("doc_id"), (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.col("near").alias("n_near"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def keep_first(df: DataFrame, per: int = WORDS_PER_EDIT) -> DataFrame:
    """The documents without the lines that go, all columns with them; a document all of whose words go goes too."""
    out = trimmed(df, per)
    stays = F.col("gone").isNull() | (F.regexp_replace(F.coalesce("kept", F.lit("")), _WHITE, "") != "")
    return out.where(stays).select(*[F.col("kept").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in df.columns])
