"""Grouped prefix join of word shingle sets by Jaccard similarity, and its components.

1. A document's set is its distinct shingles (64-bit hashes). Documents of equal sets are
   one class, at the place of its least row by (doc_id, hash of the text). Shingles have one
   order for all: those that many documents share come last (at most HEAVY of them are
   ranked, by a count over all documents; the rank decides the order only, so it never
   changes a result), the others by hash.
2. Prefixes. Of two sets with Jaccard similarity of t or more, the larger is within t of
   the smaller and the first l common shingles lie within the first n - ceil(t n) + l of
   either; l grows with the size, so linked sets share several prefix shingles. Classes
   of equal prefix and size form a group; only groups are indexed.
3. Group filter. A shingle that only one class has in its prefix links nothing; a group
   that shares fewer prefix shingles than l of its smallest partner would be can't link.
   Both are sums by shingle and by group, without pairs. What is left expands to classes.
4. Rounds. The classes with one shingle, of about one size, meet in an order that each round
   deals anew; the first SPARSE_ROUNDS take one shingle in SPARSE, the others all that MANY classes have or more,
   the last all. A class is paired with the first before it in each of WIDTHS[r] other components
   whose sizes, places of the shingle and sketches (SKETCH parities of the
   shingles, of which no more can differ than shingles) allow a link, and two components by WIDTHS[r] pairs
   for a shingle. Pairs are verified by exact intersection of
   the whole sets, links merge components, and the next round pairs what is still apart.
   A group of near copies so costs a few pairs for each member and not one for each two;
   the last round has no width and takes every pair that is still apart and hasn't met. A shingle with many classes is dealt over
   several tasks by pairs of parts, as is a class with many partners in the verification.
5. Components of the links; the component of a document is the least id in it.

A text with fewer words than a shingle is one shingle; without words it is empty and linked
with nothing. A null id takes part, comes last, and never names a component unless there is
no other. Repeated rows are equal documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE = 4
PERCENT = 85
HEAVY = 1 << 18
#: Shingles of documents that a task counts at once.
HEAVY_HELD = 2_000_000
#: Hundredths of a set that l grows by.
MORE = 5
#: Partners of a class in one task of the verification, about.
PARTNERS = 512
#: Bits of a set's sketch.
SKETCH = 512
#: Partners of a class for each shingle, by round; the last has no limit.
WIDTHS = (1, 8, 4, 16, 1 << 40)
#: One shingle in so many takes part in each of the first rounds.
SPARSE, SPARSE_ROUNDS = 16, 2
#: Classes with one shingle from which on it takes part in the rounds between these and the last.
MANY = 32
#: Classes with one shingle that one task holds, about; more are dealt by pairs of parts.
HELD = 4096
#: Pairs of classes that are looked at in one step.
BLOCK = 1 << 18
LAST = (1 << 63) - 1


def needed(n, percent: int = PERCENT):
    """ceil(t n)"""
    return -(-n * percent // 100)


def shared(n: int) -> int:
    """l of a set of n."""
    return 1 + n * MORE // 100


def shingle_sets(raws: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    words, starts = common.hashed_words(raws, lower=True)
    g = common.grams(words, size)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(g[a : b - size + 1]))
        elif b > a:  # the whole sequence as one, told apart from longer ones by its length
            h = words[a : a + 1] * np.uint64(2 * (b - a) + 1)
            for k in range(a + 1, b):
                h = common.join2(h, words[k : k + 1], 100 + k - a)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> int:
    """63 bits of a set's content."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) >> 1


def _docs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return common.texts(df, id_col, text_col).select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "text", F.xxhash64("text").alias("hash"))


def heavy_shingles(docs: DataFrame, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents share, sorted, with their ranks from 1 (the least frequent)."""
    schema = pa.schema([("s", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0

        def out() -> pa.RecordBatch:
            s, n = np.unique(np.concatenate(held), return_counts=True)
            many = n >= max(4, len(held) // 1000)
            return common.batch(schema, common.i64(s[many]), pa.array(n[many].astype(np.int64)))

        for whole in batches:
            for b in common.slices(whole, "text"):
                for s in shingle_sets(b.column(1).cast(pa.binary()).to_pylist(), size):
                    held.append(s)
                    total += len(s)
                if total > HEAVY_HELD:
                    yield out()
                    held, total = [], 0
        if held:
            yield out()

    found = docs.select("doc_id", "text").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").limit(HEAVY).toPandas()  # at most HEAVY rows
    s, n = found["s"].to_numpy().astype(np.int64).view(np.uint64), found["n"].to_numpy()
    rank = np.empty(len(s), np.int64)
    rank[np.lexsort((s, n))] = np.arange(1, len(s) + 1)
    order = np.argsort(s)
    return s[order], rank[order]


def in_order(s: np.ndarray, heavy: np.ndarray, rank: np.ndarray) -> np.ndarray:
    if not len(heavy):
        return s
    at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
    return s[np.lexsort((s, np.where(heavy[at] == s, rank[at], 0)))]


def sketch(s: np.ndarray) -> bytes:
    """SKETCH parities of a set: two sets differ in no more of them than in members."""
    members = np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
    return np.packbits((members & 1).astype(np.uint8)).tobytes()


def prefixes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, hash, n, node, alike, prefix, sketch): the size, a key of the set, a key of prefix and size, the prefix and the sketch."""
    given = docs.sparkSession.sparkContext.broadcast(heavy_shingles(docs, size))
    schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("n", pa.int32()), ("node", pa.int64()), ("alike", pa.int64()), ("prefix", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        heavy, rank = given.value
        n, node, alike, flat, ends, marks = [], [], [], [], [0], []
        for s in shingle_sets(b.column(1).cast(pa.binary()).to_pylist(), size):
            k = len(s)
            p = in_order(s, heavy, rank)[: min(k, k - needed(k, percent) + shared(k))]
            n.append(k)
            node.append(set_key(s))
            alike.append(xxhash.xxh3_64_intdigest(p.tobytes() + k.to_bytes(4, "little")) >> 1)
            flat.append(p)
            ends.append(ends[-1] + len(p))
            marks.append(sketch(s))
        prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), common.i64(np.concatenate(flat)))
        return common.batch(schema, b.column(0), b.column(2), n, node, alike, prefix, marks)

    return common.arrow_map(docs, run, "doc_id long, hash long, n int, node long, alike long, prefix array<long>, sketch binary")


def _least_shared(n: Column, percent: int) -> Column:
    """l of the smallest partner of a set of n."""
    return (F.floor(F.ceil(n * percent / 100) * MORE / 100) + 1).cast("int")


def indexed(rows: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Tables of cut(): the classes (node, doc_id, hash, n, alike, prefix, sketch), and of those that may link the rows
    (token, bin, top, parts, many, pos, node, doc_id, hash, n, sketch): shingles that may be the first shared, by ranges of sizes; top: the
    range is the upper one of the set's two. Two sets meet in the one range of which one or both are at the top."""
    place = F.min(F.struct("doc_id", "hash")).alias("place")
    classes = common.cut(rows.where("n > 0").groupBy("node").agg(place, *[F.first(c).alias(c) for c in ("n", "alike", "prefix", "sketch")]).select("node", "place.*", "n", "alike", "prefix", "sketch"))
    groups = classes.groupBy("alike").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.count("*").cast("int").alias("members"))
    index = groups.select(F.posexplode("prefix").alias("pos", "token"), "alike", "n", "members")
    many = index.groupBy("token").agg(F.sum("members").alias("c")).where("c > 1").select("token")
    with common.stored(index.join(many.hint("merge"), "token").select("token", "alike", "n", "pos")) as index:
        enough = index.groupBy("alike").agg(F.count("*").alias("c"), F.first("n").alias("n")).where(F.col("c") >= F.least(_least_shared(F.col("n"), percent), F.col("c") + 1)).select("alike")
        members = classes.select("alike", "node", "doc_id", "hash", "sketch").join(enough, "alike", "left_semi")
        # the first shingle that a linked set shares leaves enough of the set; any two sizes that fit are in one range
        early = index.where(F.col("pos") + F.ceil(F.col("n") * percent / 100) <= F.col("n"))
        band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) - F.lit(1e-9)).cast("int")
        ranges = early.join(members, "alike").drop("alike").withColumn("band", band).withColumn("bin", F.explode(F.array(F.col("band"), F.col("band") - 1)))
        ranges = ranges.withColumn("top", F.col("bin") == F.col("band")).drop("band")
        with common.stored(ranges) as ranges:
            parts = ranges.groupBy("token", "bin").agg(F.count("*").alias("c")).where("c > 1").select("token", "bin", F.ceil(F.col("c") / HELD).cast("int").alias("parts"), (F.col("c") >= MANY).alias("many"))
            return classes, common.cut(ranges.join(parts.hint("merge"), ["token", "bin"]))


def may_link(n: np.ndarray, p: np.ndarray, m: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m can link if the first shingle that they share has these places."""
    return (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent) & (np.minimum(n - p, m - q) * (100 + percent) >= (n + m) * percent)


def most_apart(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Members in which linked sets of n and m differ at most."""
    return n + m + 2 * (-(n + m) * percent // (100 + percent))


def _ranks(*by: np.ndarray) -> np.ndarray:
    """How many equal ones come before each."""
    order = np.lexsort(by)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in by:
        new[1:] |= x[order][1:] != x[order][:-1]
    at = np.arange(len(order))
    out = np.empty(len(order), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def _meet(group: list[np.ndarray], width: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(earlier row, row) of the pairs of a round; rows come by key and order."""
    key, part, alone, top, pos, n, c_doc, c_hash, mark, node, seen = group
    whole = width >= WIDTHS[-1]
    c = common.join2(c_doc.view(np.uint64), c_hash.view(np.uint64))  # tells components apart where pairs are chosen, not where they are left out
    known = {k: set(x.tolist()) for k, x in enumerate(seen) if x is not None}
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(begin, len(key)))
    first = np.repeat(begin, size)
    many = np.arange(len(key)) - first
    upto = np.cumsum(many)
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    at = 0
    while at < len(key):  # as many rows at once as have BLOCK earlier ones, one at least
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK, side="right")))
        i = np.repeat(np.arange(at, stop), many[at:stop])
        j = np.arange(len(i)) - np.repeat(np.cumsum(many[at:stop]) - many[at:stop], many[at:stop]) + first[i]
        for ok in (
            lambda: ((c_doc[i] != c_doc[j]) | (c_hash[i] != c_hash[j])) & (alone[i] | (part[i] != part[j])) & (top[i] | top[j]),
            lambda: may_link(n[i], pos[i], n[j], pos[j], percent),
            lambda: np.bitwise_count(mark[i] ^ mark[j]).sum(axis=1, dtype=np.int64) <= most_apart(n[i], n[j], percent),
        ):
            keep = ok()
            i, j = i[keep], j[keep]
        if known:
            keep = np.array([y not in known.get(a, ()) and x not in known.get(b, ()) for a, b, x, y in zip(i.tolist(), j.tolist(), node[i].tolist(), node[j].tolist())], bool)
            i, j = i[keep], j[keep]
        if not whole:
            first_of = _ranks(c[j], i) == 0
            i, j = i[first_of], j[first_of]
            kept = _ranks(i) < width
            i, j = i[kept], j[kept]
        out.append((j, i))
        at = stop
    j, i = (np.concatenate([o[k] for o in out]) for k in range(2))
    if not whole:
        kept = _ranks(np.maximum(c[i], c[j]), np.minimum(c[i], c[j]), key[i]) < width
        i, j = i[kept], j[kept]
    return j, i


_PAIR = ("a_doc", "a_hash", "a", "b_doc", "b_hash", "b")


def candidates(index: DataFrame, found: DataFrame, number: int, percent: int, tested: list[DataFrame]) -> DataFrame:
    """(a_doc, a_hash, a, b_doc, b_hash, b): the pairs of a round, places and keys of two classes. found: (u, component) of places."""
    # the last round knows what each class has met; a class met few, whatever its group, and not those that met it
    seen = None
    if number == len(WIDTHS) - 1:
        met = tested[0].select("a", "b")
        for t in tested[1:]:
            met = met.union(t.select("a", "b"))
        seen = met.groupBy(F.col("b").alias("node")).agg(F.collect_set("a").alias("seen"))
    known = found.select(F.col("u.doc_id").alias("doc_id"), F.col("u.hash").alias("hash"), "component")
    if number >= SPARSE_ROUNDS and number < len(WIDTHS) - 1:
        index = index.where("many")
    elif number < len(WIDTHS) - 1:
        index = index.where(F.pmod(F.xxhash64("token", F.lit(number)), F.lit(SPARSE)) == 0)
    rows = index.join(known, ["doc_id", "hash"], "left").withColumn("c", F.coalesce("component", F.struct("doc_id", "hash")))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node", F.lit(number)), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = F.xxhash64("token", "bin", F.least("part", "other"), F.greatest("part", "other"))
    rows = rows.withColumn("seen", F.lit(None).cast("array<bigint>")) if seen is None else rows.join(seen, "node", "left")
    given = rows.select(key.alias("key"), "part", (F.col("part") == F.col("other")).alias("alone"), "top", "pos", "n", F.col("c.doc_id").alias("c_doc"), F.col("c.hash").alias("c_hash"), "sketch", "doc_id", "hash", "node", "seen", F.xxhash64("node", F.lit(number + 100)).alias("order"))
    laid = given.repartition(common.shuffles(index), "key").sortWithinPartitions("key", "order").drop("order")
    schema, width = pa.schema([(c, pa.int64()) for c in _PAIR]), WIDTHS[number]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, _ in common.groups(batches, 13):
            a, b = _meet([*group[:4], *(c.astype(np.int64) for c in group[4:8]), group[8], group[11], group[12]], width, percent)
            node = group[11]
            by = np.lexsort((node[b], node[a]))  # a pair once for all shingles at hand
            a, b = a[by], b[by]
            new = np.ones(len(a), bool)
            new[1:] = (node[a][1:] != node[a][:-1]) | (node[b][1:] != node[b][:-1])
            yield common.batch(schema, *(common.i64(c[a[new]]) for c in group[9:12]), *(common.i64(c[b[new]]) for c in group[9:12]))

    return laid.mapInArrow(meet, ", ".join(f"{c} long" for c in _PAIR)).distinct()


def verify(docs: DataFrame, pairs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(a, b): the keys of those pairs that link. The set of a goes once to each task that has partners of it."""
    parts = F.ceil(F.count("*") / PARTNERS).cast("int")
    hubs = pairs.groupBy("a", "a_doc", "a_hash").agg(parts.alias("parts"))
    partners = pairs.join(hubs.select("a", "parts").hint("merge"), "a").select(F.col("b_doc").alias("doc_id"), F.col("b_hash").alias("hash"), F.struct("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("hub")).alias("to"))
    firsts = hubs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(F.col("a_doc").alias("doc_id"), F.col("a_hash").alias("hash"), F.struct("a", "part", F.lit(True).alias("hub")).alias("to"))
    wanted = partners.union(firsts).groupBy("doc_id", "hash").agg(F.collect_list("to").alias("to"))
    given = docs.join(wanted.hint("merge"), ["doc_id", "hash"]).groupBy("doc_id", "hash").agg(F.first("text").alias("text"), F.first("to").alias("to"))  # repeated rows once
    schema = pa.schema([("a", pa.int64()), ("part", pa.int32()), ("hub", pa.bool_()), ("b", pa.int64()), ("set", pa.binary())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.slices(whole, "text", common.SLICE_BYTES // 4):
                out: list[tuple] = []
                held = 0
                for s, to in zip(shingle_sets(b.column(0).cast(pa.binary()).to_pylist(), size), b.column(1).to_pylist()):
                    node, raw = set_key(s), s.tobytes()
                    for t in to:
                        out.append((t["a"], t["part"], t["hub"], node, raw))
                        held += len(raw)
                        if held > 4 * common.SLICE_BYTES:
                            yield common.batch(schema, *map(list, zip(*out)))
                            out, held = [], 0
                if out:
                    yield common.batch(schema, *map(list, zip(*out)))

    sets = given.select("text", "to").mapInArrow(emit, "a long, part int, hub boolean, b long, set binary")
    laid = sets.repartition(common.shuffles(docs), "a", "part").sortWithinPartitions("a", "part", F.desc("hub"))
    linked = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.zeros(0, np.uint64)
        for b in batches:
            got: tuple[list[int], list[int]] = ([], [])
            for a, _, hub, other, raw in zip(*(b.column(k).to_pylist() for k in range(5))):
                s = np.frombuffer(raw, np.uint64)
                if hub:
                    first = s
                    continue
                at = np.searchsorted(first, s)
                both = int((first[np.minimum(at, len(first) - 1)] == s).sum())
                if 100 * both >= percent * (len(first) + len(s) - both):
                    got[0].append(a)
                    got[1].append(other)
            yield common.batch(linked, *got)

    return laid.mapInArrow(compare, "a long, b long")


def linked_classes(docs: DataFrame, rows: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The classes of indexed(), and (u, component): the places (doc_id, hash) of those that link with another, and the least place
    of their component; tables of cut()."""
    classes, index = indexed(rows, percent)
    place = "struct<doc_id:bigint,hash:bigint>"
    found = common.cut(docs.sparkSession.createDataFrame([], f"u {place}, component {place}"))
    tested: list[DataFrame] = []
    for number in range(len(WIDTHS)):
        met = common.cut(candidates(index, found, number, percent, tested))
        tested.append(met)
        if not met.isEmpty():
            a, b = F.struct(F.col("a_doc").alias("doc_id"), F.col("a_hash").alias("hash")), F.struct(F.col("b_doc").alias("doc_id"), F.col("b_hash").alias("hash"))
            links = met.join(verify(docs, met, size, percent).hint("merge"), ["a", "b"]).select(a.alias("u"), b.alias("component"))
            last, found = found, common.components(links.union(found), "u", "component", "u")
            common.discard(last)
    common.discard(index, *tested)
    return classes, found


def _rows(df: DataFrame, size: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hash, n, component) of each row, component being the least place (doc_id, hash) in it, null for an empty set."""
    docs = _docs(df, id_col, text_col)
    rows = common.cut(prefixes(docs, size, percent))
    classes, found = linked_classes(docs, rows, size, percent)
    own = F.struct("doc_id", "hash")
    named = classes.select("node", own.alias("u")).join(found.hint("merge"), "u", "left").select("node", F.coalesce("component", "u").alias("component"))
    return rows.select("doc_id", "hash", "n", F.when(F.col("n") > 0, F.col("node")).otherwise(-1 - F.shiftrightunsigned(F.xxhash64("doc_id", "hash"), 1)).alias("node")).join(named.hint("merge"), "node", "left").drop("node")


def components_of(df: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row."""
    out = _rows(df, size, percent, id_col, text_col)
    return out.select(F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.nullif(F.coalesce("component.doc_id", "doc_id"), F.lit(LAST)).alias("component_id"))


def keep_one(df: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, all columns with it: of the least place (doc_id, hash of the text), one of equal rows. Rows without words all stay."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = rows.select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(text).alias("hash"), text.rlike(r"[^\x20\x09-\x0D]").alias("full"))
    chosen = _rows(df.select("doc_id", "text"), size, percent).where("component is not null").select("component.*").distinct()
    kept = rows.where("full").join(chosen.hint("merge"), ["doc_id", "hash"], "left_semi").groupBy("doc_id", "hash").agg(F.first("row").alias("row")).select("row")
    return kept.union(rows.where("not full").select("row")).select(*[F.col("row").getField(c).alias(c) for c in df.columns])
