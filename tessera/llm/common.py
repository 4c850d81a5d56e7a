"""What the operators share: Arrow batch maps, word hashing, checkpoints and components.

Conventions of all operators: a null text counts as an empty text, extra columns of
the input are ignored, and words are runs of bytes outside 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step of a task handles at most (one row at least).
SLICE_BYTES = 2 << 20
#: Entries after which a per-process word cache is emptied.
CACHE_ENTRIES = 400_000
#: Bytes whose words are hashed at once; a longer word stands alone.
BLOCK_BYTES = 1 << 20
#: Bytes from which a piece of memory goes back to the system as soon as it is free.
RETURNED_BYTES = 4 << 20
#: Bytes that may be broadcast.
BROADCAST_BYTES = 64 << 20
#: Has Spark delete the shuffles of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bounds the bytes that go to Python at once; Spark's own bound lets ten thousand long texts pass.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def _return_memory() -> None:
    """Python workers live on from stage to stage: what one has used must not stay with them."""
    pa.set_memory_pool(pa.system_memory_pool())
    with suppress(OSError, AttributeError):  # the C library's settings: from which size on, and how much may stay at the heap's end
        library = ctypes.CDLL("libc.so.6")
        library.mallopt(-3, RETURNED_BYTES)
        library.mallopt(-1, 4 * RETURNED_BYTES)


_return_memory()
#: What kind of task the worker ran last, and how it drops what a kind of task keeps for the next one.
_last, _drops = "", {}


def keeps(kind: str, drop: Callable[[], None]) -> None:
    """Tasks of this kind leave something in their worker for each other, which drop() clears."""
    _drops[kind] = drop


def settle(kind: str) -> None:
    """Begins a task: if the worker's last one was of another kind, what that kept, and pieces of memory between used ones, go back to the system."""
    global _last
    if kind == _last:
        return
    _last = kind
    for other, drop in _drops.items():
        if other != kind:
            drop()
    gc.collect()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, the latter never null."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose column has about `limit` bytes; a longer row stands alone."""
    ends = np.frombuffer(batch.column(column).buffers()[1], dtype=np.int32, count=batch.num_rows + 1 + batch.column(column).offset)[batch.column(column).offset:]
    at, n = 0, batch.num_rows
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, sliced: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """fn over slices of the Arrow batches of each partition."""

    kind = f"{fn.__module__}.{fn.__qualname__}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle(kind)
        for batch in batches:
            for part in slices(batch, sliced, limit):
                yield fn(part)

    return df.mapInArrow(run, schema)


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches of about `limit` bytes made of smaller ones; a larger one stays as it is."""
    held, size = [], 0
    for b in batches:
        if held and size + b.nbytes > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if b.num_rows:
            held.append(b)
            size += b.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string or binary column, and the offsets of its rows."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(data: bytes) -> bytes:
    return data.lower()  # bytes.lower() changes A-Z only


def _is_white(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number, and of its inverse, modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    return tuple(np.multiply.accumulate(np.full(n, np.uint64(x))) for x in (base, pow(base, -1, 1 << 64)))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(BLOCK_BYTES, 1 << max(n - 1, 1).bit_length()))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, 64-bit hash) of the words of texts that lie in a row, each from one offset to the next.

    A word's hash is the polynomial of its bytes, taken from one running sum over all of them.
    """
    if len(data) > BLOCK_BYTES:  # in blocks that end between texts or at white space
        parts, at = [], 0
        while at < len(data):
            stop = min(at + BLOCK_BYTES, len(data))
            if stop < len(data):
                text = int(offsets[np.searchsorted(offsets, stop, side="right") - 1])
                white = np.flatnonzero(_is_white(data[at:stop]))
                stop = max(text, at + int(white[-1]) + 1 if len(white) else at)
                if stop <= at:  # one word fills the block
                    after = np.flatnonzero(_is_white(data[at + BLOCK_BYTES :]))
                    stop = at + BLOCK_BYTES + int(after[0]) + 1 if len(after) else len(data)
                    stop = min(stop, int(offsets[np.searchsorted(offsets, at, side="right")]))
            inner = offsets[(offsets > at) & (offsets < stop)] - at
            begin, end, h = _word_spans(data[at:stop], np.concatenate([[0], inner, [stop - at]]))
            parts.append((begin + at, end + at, h))
            at = stop
        return tuple(np.concatenate([p[k] for p in parts]) for k in range(3))
    return _word_spans(data, offsets)


def _word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = ~_is_white(data)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offsets[:-1][offsets[:-1] < len(data)]
    first[at] = inside[at]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] = inside[at]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return begin, end, mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64) * _ROT)


def hashed_words(texts_: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts in a row, and where each text begins among them."""
    whole = b"".join(texts_)
    offsets = np.zeros(len(texts_) + 1, np.int64)
    np.cumsum([len(t) for t in texts_], out=offsets[1:])
    begin, _, hashes = word_spans(np.frombuffer(whole.lower() if lower else whole, np.uint8), offsets)
    return hashes, np.searchsorted(begin, offsets)


_MUL = np.uint64(0x9E3779B97F4A7C15)
_ROT = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ROT
    x = (x ^ (x >> np.uint64(29))) * _MUL
    return x ^ (x >> np.uint64(32))


def join2(a: np.ndarray, b: np.ndarray, salt: int = 1) -> np.ndarray:
    """A hash of the pair, in this order."""
    return mix(a * _MUL + np.uint64(salt) + mix(b + np.uint64(0x632BE59BD9B4E019)))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n values; as many as there are starts."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    powers, size, out, done = h, 1, None, 0
    while True:
        if n & size:
            m = len(h) - n + 1
            piece = powers[done : done + m] if out is not None else powers[: max(0, len(h) - size + 1)]
            if out is None:
                out = piece
            else:
                out = join2(out[:m], piece, size)
            done += size
        size *= 2
        if size > n:
            return out[: len(h) - n + 1]
        half = size // 2
        powers = join2(powers[: len(powers) - half], powers[half:], 7 + size)


def window_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours."""
    size, out = 1, x
    while size * 2 <= n:
        out = np.minimum(out[:-size], out[size:]) if len(out) > size else out[:0]
        size *= 2
    rest = n - size
    if rest and len(out) > rest:
        out = np.minimum(out[:-rest], out[rest:])
    elif rest:
        out = out[:0]
    return out


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each first on, as many as counted, in a row."""
    return np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)


def i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else np.asarray(x, np.int64))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _numpy(column: pa.Array) -> np.ndarray:
    """The values; of a binary column, whose values are all equally long, a row of 64-bit numbers each."""
    if not pa.types.is_binary(column.type):
        return column.to_numpy(zero_copy_only=False)
    data, _ = raw_bytes(column)
    return data.view(np.uint64).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.uint64)


def groups(batches: Iterator[pa.RecordBatch], columns: int, at_once: int = 0) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Whole groups of rows with one key, the first column, many at a time; of a group of over at_once rows (if that isn't 0) parts, marked so."""
    held: list[list[np.ndarray]] = []
    waiting, enough, parted = 0, 100_000, None
    for b in batches:
        if not b.num_rows:
            continue
        held.append([_numpy(b.column(k)) for k in range(columns)])
        waiting += b.num_rows
        if waiting < enough:
            continue
        rows = [np.concatenate(c) for c in zip(*held)]
        end = int(np.searchsorted(rows[0], rows[0][-1]))
        if parted is not None and end and rows[0][0] == parted:
            first = int(np.searchsorted(rows[0], parted, side="right"))
            yield [r[:first] for r in rows], True
            rows, end, parted = [r[first:] for r in rows], end - first, None
        if end:
            yield [r[:end] for r in rows], False
            rows = [r[end:] for r in rows]
        if at_once and len(rows[0]) > at_once:
            yield rows, True
            parted, rows = rows[0][-1], [r[:0] for r in rows]
        held, waiting = [rows], len(rows[0])
        enough = 100_000 + 2 * waiting
    rows = [np.concatenate(c) for c in zip(*held)] if held else []
    if rows and len(rows[0]):
        first = int(np.searchsorted(rows[0], parted, side="right")) if parted is not None and rows[0][0] == parted else 0
        if first:
            yield [r[:first] for r in rows], True
        if first < len(rows[0]):
            yield [r[first:] for r in rows], False


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session, and only where it is unset a local one."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tessera-")


_left: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    _left.discard(path)


@atexit.register
def _delete_left() -> None:
    """Tables that results still read last until the driver's process ends."""
    spark = SparkSession.getActiveSession()
    for path in list(_left) if spark is not None else ():
        with suppress(Exception):  # the session may be gone, and the folder with it
            _delete(spark, path)


def small_batches(spark: SparkSession) -> None:
    """Results that are planned now run later, so the setting stays; one that the caller has made stays too."""
    if spark.conf.get(_BATCH) in ("67108864", "67108864b"):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from a compressed table in the shared folder: later steps don't run the earlier ones again.

    The table survives lost executors, goes with discard() or when the driver's process ends.
    Spark drops the shuffles that led to it as soon as it is written. (checkpoint() would run
    the last stage twice, once to count and once to write.)
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    small_batches(spark)
    try:
        _left.add(path)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what cut() wrote for these; nothing that is still to run may read them."""
    for df in tables:
        _delete(df.sparkSession, df._cut_at)


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """cut() for the length of a block."""
    out = cut(df)
    try:
        yield out
    finally:
        discard(out)


def shuffles(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, src: str = "src", dst: str = "dst", node: str = "node") -> DataFrame:
    """(node, component): the least node that links reach, for every node of an edge; a table of cut().

    Alternating large-star and small-star steps over the edge table; each round is a
    pair of aggregations, so no component is ever gathered in one task or the driver.
    """
    links = cut(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.least("m", "u").alias("b"))
        up = large.where("a <> b").distinct()
        smallest = up.groupBy("a").agg(F.min("b").alias("m"))
        small = up.join(smallest, "a")
        last, links = links, cut(small.where("b <> m").select(F.col("b").alias("u"), F.col("m").alias("v")).union(small.select(F.col("a").alias("u"), F.col("m").alias("v"))).distinct())
        discard(last)
        now = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    stars = links.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias(node), "component")
    out = cut(stars.union(links.select(F.col("v").alias(node), F.col("v").alias("component")).distinct()).groupBy(node).agg(F.min("component").alias("component")))
    discard(links)
    return out
