"""Line dedup against brute force that shares no code with it."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tessera.llm import common, line_dedup

from .test_corpus import empty, odd, odd_rows  # noqa: F401

SF = "/root/testdata/sf0.001"


def edit_distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x):
        before, row = row, [i + 1]
        for j, b in enumerate(y):
            row.append(min(before[j] + (a != b), before[j + 1] + 1, row[j] + 1))
    return row[-1]


def most_edits(n, per):
    return n // per if n >= per else int(n >= 5)


def place(i, t):
    """A row is its id and text; a null id is last, texts of one id go by their hash."""
    h = xxhash.xxh64_intdigest(t.encode(), 42)
    return (i is None, 0 if i is None else i, h - (1 << 64) if h >> 63 else h)


def by_hand(rows, per=10):
    """(id, removed lines, near lines, hash of the kept text) of each row."""
    first = {}
    for i, t in sorted({(i, t or "") for i, t in rows}, key=lambda r: place(*r)):
        for k, line in enumerate(t.split("\n")):
            w = tuple(line.encode().split())
            if w:
                first.setdefault(w, (*place(i, t), k))
    near, found = set(), list(first)
    sets = {x: collections.Counter(x) for x in found}
    for x in found:
        for y in found:
            k = most_edits(max(len(x), len(y)), per)
            if first[y] < first[x] and k and abs(len(x) - len(y)) <= k and (sets[x] & sets[y]).total() >= max(len(x), len(y)) - k and edit_distance(x, y) <= k:
                near.add(x)
                break
    out = []
    for i, t in rows:
        kept, gone, close = [], 0, 0
        for k, line in enumerate((t or "").split("\n")):
            w = tuple(line.encode().split())
            if w and (w in near or first[w] < (*place(i, t or ""), k)):
                gone, close = gone + 1, close + (w in near)
            else:
                kept.append(line)
        out.append((i, gone, close, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return collections.Counter(out)


def got(df, per=10):
    return collections.Counter((r.doc_id, r.n_removed, r.n_near, r.kept_sha256) for r in line_dedup.dedup(df, per).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        k = rng.randrange(len(w) + 1)
        w[k : k + rng.randrange(2)] = rng.choice([[], ["new"], [f"n{rng.randrange(9)}"]])
    return w


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(docs) == by_hand([(r.doc_id, r.text) for r in docs.collect()])


def test_rows_without_an_identity_of_their_own(spark):
    """Null ids, and ids that several texts have: no line goes that stands once."""
    rows = [(1, "A line that is here twice"), (5, "A line that is here twice"), (5, "Unique words of one row only"), (None, "A line that is here twice"), (None, "Other words, and these too, stand once"), (None, "Other words, and these too, stand once")]
    found = got(frame(spark, rows))
    assert found == by_hand(rows)
    kept = line_dedup.keep_first(frame(spark, rows)).collect()
    assert collections.Counter(r.text for r in kept) == {"A line that is here twice": 1, "Unique words of one row only": 1, "Other words, and these too, stand once": 2}


@pytest.mark.parametrize("seed", [1, 2])
def test_edits(spark, seed):
    """Lines of 1 to 230 words with edits within and beyond the bound, in groups, some with a common passage or a word again and again."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(9)]
    base = [[f"w{rng.randrange(60)}" for _ in range(n)] for n in (1, 3, 4, 5, 6, 8, 9, 10, 11, 18, 19, 20, 21, 29, 30, 31, 39, 45, 60, 81, 90, 101, 130, 230)] + [["same"] * 44, ["a", "b"] * 30]
    rows = []
    for i in range(90):
        lines = []
        for _ in range(3):
            w = rng.choice(base)
            w = edited(rng, w, rng.randrange(0, max(1, len(w) // rng.choice([5, 8, 10])) + 2))
            lines.append(" ".join(w + passage if rng.random() < 0.2 else w))
        rows.append((rng.choice([i, i, i, 7, None]), "\n".join(lines)))
    assert got(frame(spark, rows)) == by_hand(rows)


def test_a_pair_within_any_bound_shares_a_variant():
    """The pigeonhole of the runs, for all lengths about the borders of the classes and edits spread evenly or at random."""
    rng = random.Random(6)
    for per in (10, 20):
        for n in [5, 6, 9, 10, 2 * per - 1, 2 * per, 2 * per + 1, *range(3 * per - 2, 3 * per + 2), 47, 48, 49, 80, 81, 89, 90, 91, 99, 100, 110, 161, 162, 200, 300]:
            for trial in range(12):
                x = [b"%d" % rng.randrange(10**6) for _ in range(n)]
                k = int(line_dedup.bound(n, per))
                y = list(x)
                for e in range(k):  # only substitutions and deletions, so that x stays the longer
                    at = (e + 1) * len(y) // (k + 1) if trial % 2 else rng.randrange(len(y))
                    y[at : at + 1] = [] if trial % 3 == 0 else [b"new%d" % e]
                both = line_dedup.Lines.of(pa.array([b" ".join(x).decode(), b" ".join(y).decode()]))
                token, line, form = both.variants(per)
                shared = set(token[line == 0].tolist()) & set(token[line == 1].tolist())
                assert shared, (per, n, trial)
                found = line_dedup._alive(token, np.array([11, 22], np.uint64)[line], form, per)
                assert set(found[1].tolist()) == {11, 22}
                bucket = line_dedup.Bucket(per)
                some = list(bucket.add(token.tobytes() + line.astype(np.uint64).tobytes() + form.tobytes())) + list(bucket.end())
                assert set(np.concatenate([f[1] for f in some]).tolist()) == {0, 1}


def test_a_full_bucket_lets_pass(monkeypatch):
    rng = np.random.default_rng(2)
    token, key = np.sort(rng.integers(0, 3000, 4000)).astype(np.uint64), np.arange(4000, dtype=np.uint64)
    form = np.full(4000, 30 << 16, np.uint32)
    whole = set(line_dedup._alive(token, key, form, 10)[1].tolist())
    monkeypatch.setattr(line_dedup, "HELD", 500)
    bucket, got = line_dedup.Bucket(10), []
    order = rng.permutation(4000)
    for k in range(0, 4000, 100):
        some = order[k : k + 100]
        got += [k for f in bucket.add(token[some].tobytes() + key[some].tobytes() + form[some].tobytes()) for k in f[1].tolist()]
    got += [k for f in bucket.end() for k in f[1].tolist()]
    assert set(got) >= whole and len(set(got)) < 4000


def test_many_near_copies_and_a_hot_variant(spark):
    """A group of near copies, and many lines that share a passage but aren't near."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(50)]
    passage = [f"p{k}" for k in range(12)]
    rows = [(i, " ".join(edited(rng, base, 3))) for i in range(150)]
    rows += [(200 + i, " ".join([*[f"u{rng.randrange(10**6)}" for _ in range(15)], *passage, *[f"u{rng.randrange(10**6)}" for _ in range(15)]])) for i in range(150)]
    rng.shuffle(rows)
    assert got(frame(spark, rows)) == by_hand(rows)


def test_groups_of_rows_come_whole():
    rng = np.random.default_rng(1)
    token = np.sort(np.concatenate([rng.integers(0, 40_000, 400_000), np.full(300_000, 777), np.full(10, 40_001)]))
    for at_once in (0, 120_000):
        schema = pa.schema([("token", pa.int64()), ("v", pa.int64())])
        batches = (pa.RecordBatch.from_arrays([pa.array(token[k : k + 10_000]), pa.array(np.arange(len(token))[k : k + 10_000])], schema=schema) for k in range(0, len(token), 10_000))
        parts = list(common.groups(batches, 2, at_once))
        assert (np.concatenate([g[1] for g, _ in parts]) == np.arange(len(token))).all()
        whole = [set(np.unique(g[0])) for g, part in parts if not part]
        assert sum(map(len, whole)) == len(set().union(*whole))
        split = set().union(*(set(np.unique(g[0])) for g, part in parts if part)) if at_once else set()
        assert not split & set().union(*whole) and split == ({777} if at_once else set())


def test_distance():
    rng = random.Random(2)
    for _ in range(300):
        x = [rng.randrange(6) for _ in range(rng.randrange(0, 30))]
        y = [rng.randrange(6) for _ in range(rng.randrange(0, 30))]
        assert line_dedup.distance(list(x), list(y)) == edit_distance(x, y)


def test_pairs_within_the_bound():
    rng = random.Random(4)
    pairs = []
    for _ in range(1500):
        x = [f"w{rng.randrange(rng.choice([3, 50]))}" for _ in range(rng.choice([1, 4, 5, 9, 10, 19, 20, 33, 70, 140, 260]))]
        pairs.append((x, edited(rng, x, rng.randrange(0, len(x) // 8 + 2)) or ["z"]))
    pairs += [(["a"] * 700, ["a"] * 770), (["a"] * 700, ["b"] * 10 + ["a"] * 700), (["a", "b"] * 400, ["b", "a"] * 400)]
    x, y = (line_dedup.Lines.of(pa.array([" ".join(p[k]) for p in pairs])) for k in (0, 1))
    want = [edit_distance(a, b) <= most_edits(max(len(a), len(b)), 10) for a, b in pairs]
    assert line_dedup.near_pairs(x, y, 10).tolist() == want and 300 < sum(want) < 1400


def test_odd(spark, odd, empty):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(odd) == by_hand(rows) and len(rows) == len(odd_rows()) + 1
    assert line_dedup.dedup(empty).count() == 0 and line_dedup.keep_first(empty).count() == 0
    clash = odd.selectExpr("*", "'mine' as `__text`", "'mine' as hash", "1 as gone", "2 as kept", "3 as at", "'x' as `row`")
    kept = line_dedup.keep_first(clash)
    assert kept.columns == clash.columns and {4, 5, 6, 17, 1} <= {r.doc_id for r in kept.collect()}
    assert all(r["__text"] == "mine" and r["kept"] == 2 and r["hash"] == "mine" for r in kept.collect())


def test_very_long_texts(spark):
    """A line of 20,000 words beside its near copy, and a text of 3,000 lines."""
    long = [f"w{k % 9973}" for k in range(20_000)]
    rows = [(1, " ".join(long)), (2, " ".join(["x", *long[1:], "more"])), (3, "\n".join(f"line number {k} of many that are told apart by {k * 7} only" for k in range(3_000)))]
    found = {r.doc_id: r.n_removed for r in line_dedup.dedup(frame(spark, rows)).collect()}
    assert found[1] == 0 and found[2] == 1 and found[3] == 0
