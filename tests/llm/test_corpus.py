"""Operators over the whole corpus against brute force on small tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import brown_lm, common, fm_dedup, jaccard_join, toxicity

SF = "/root/testdata/sf0.001"
S = re.compile(r"[\x20\x09-\x0D]+")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd_rows():
    base = " ".join(f"w{k}" for k in range(60))
    near = base.replace("w30", "changed")
    far = " ".join(f"v{k}" for k in range(60))
    short = "only three words"
    rows = [
        (1, base), (2, near), (3, base), (4, None), (5, ""), (6, " \n\t "), (7, short), (8, short), (9, far + "\n" + base), (10, "x"), (11, "X"), (12, "der " * 400),
        (13, "é" * 50 + " " + far), (14, base + "\n" + far), (15, "a b c d e f g h\nA line of eight words is right here\nA line of eight words is right there"), (16, "A line of eight words is right\nother"), (17, "\n\n"), (18, "tie " * 25), (19, "tie " * 25),
    ]
    return rows + [(3, base)]  # a repeated row


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, 1, "n", "w", 2.0, "k", "c") for i, t in odd_rows()] + [(None, " ".join(f"u{k}" for k in range(40)), 1, "n", "w", 2.0, "k", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, start int, node string, word string, n double, key string, component string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# -- components ----------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(4)
    edges = [(a, a + 1) for a in range(0, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(200, 300 + k) for k in range(30)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: find(n) for n in parent if any(n in e and e[0] != e[1] for e in edges)}
    assert common.components(spark.createDataFrame([], "src long, dst long")).count() == 0


# -- substring dedup ------------------------------------------------------------------------------


def windows_by_hand(rows, size=20):
    first = {}
    for i, t in sorted((i, t or "") for i, t in rows):
        w = t.encode().split()
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), (i, k))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < (i, k):
                gone[k : k + size] = [True] * size
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return collections.Counter(out)


def test_fm_documents(spark):
    docs = documents(spark)
    got = collections.Counter(tuple(r) for r in fm_dedup.dedup(docs).collect())
    assert got == windows_by_hand([(r.doc_id, r.text) for r in docs.collect()])


def test_fm_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(fm_dedup, "KEY_RUNS", 4)
    monkeypatch.setattr(fm_dedup, "SHARD_RUNS", 60)
    passage = " ".join(f"p{k}" for k in range(50))
    rng = random.Random(1)
    rows = [(i, " ".join(f"z{rng.random()}" for _ in range(rng.randrange(0, 40))) + (" " + passage if i % 3 else "") + " " + " ".join(f"y{rng.random()}" for _ in range(rng.randrange(0, 30)))) for i in range(60)]
    got = collections.Counter(tuple(r) for r in fm_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == windows_by_hand(rows)


def test_fm_odd(spark, odd, empty):
    rows = [(i, t) for i, t in odd_rows()]
    got = collections.Counter(tuple(r) for r in fm_dedup.dedup(odd).collect() if r.doc_id is not None)
    assert got == windows_by_hand(rows)
    assert fm_dedup.dedup(empty).count() == 0
    odd = odd.selectExpr("*", "'mine' as `__text`", "7 as hash", "'x' as found", "'r' as `row`")
    kept = fm_dedup.keep_first(odd)
    assert kept.columns == odd.columns and all(r.hash == 7 and r["__text"] == "mine" for r in kept.collect())
    ids = [r.doc_id for r in kept.collect()]
    assert 2 in ids and 4 in ids and 5 in ids and 1 in ids and 3 not in ids


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=0, max_size=30), min_size=1, max_size=4), st.integers(2, 7))
def test_fm_index_counts(texts, window):
    words = np.array([x for t in texts for x in t], np.uint64)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    index = fm_dedup.FMIndex(common.mix(words) if len(words) else words, starts, window)
    where = [int(s) + k for s, t in zip(starts, texts) for k in range(len(t) - window + 1)]
    assert sorted(index.windows.tolist()) == where
    if where:
        matched, lo, hi = index.statistics(np.array(where))
        parts = [(p, k * index.step) for p in where for k in range(index.blocks)]
        inside = [p for s, t in zip(starts, texts) for p in range(int(s), int(s) + len(t))]
        ends = {p: int(s) + len(t) for s, t in zip(starts, texts) for p in range(int(s), int(s) + len(t))}

        def places(p, skip):  # of the window's words without the first `skip`
            words_ = words[p + skip : p + window].tolist()
            return [q for q in inside if q + len(words_) <= ends[q] and words[q : q + len(words_)].tolist() == words_]

        for p, m, a, b in zip(where, matched.tolist(), lo.tolist(), hi.tolist()):
            best = max((window - skip for q, skip in parts if q == p and len(places(p, skip)) >= 2), default=0)
            assert m == best and (not m or sorted(index.suffixes[a:b].tolist()) == places(p, window - m))


def test_fm_identity_of_rows(spark):
    """Null ids and ids of several texts; a window of one row is taken out of that row only."""
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(None, f"a{k} " + passage + f" z{k}") for k in range(6)] + [(5, passage), (5, "other " + passage), (5, "quite other words " * 3)]
    got = fm_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in got if r.doc_id is None) == [30] * 6
    assert sorted((r.n_words, r.n_removed) for r in got if r.doc_id == 5) == [(9, 0), (30, 0), (31, 30)]


def test_fm_one_periodic_text(spark, monkeypatch):
    monkeypatch.setattr(fm_dedup, "KEY_RUNS", 3)
    monkeypatch.setattr(fm_dedup, "NEAR_WORDS", 256)
    text = " ".join(f"w{k % 23}" for k in range(9_000))
    rows = [(1, text), (2, "x " + " ".join(f"w{k % 23}" for k in range(40)))]
    got = collections.Counter(tuple(r) for r in fm_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == windows_by_hand(rows)


def test_wavelet_rank():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 11, 500)
    w = fm_dedup.WaveletMatrix(v, 11)
    at, s = rng.integers(0, 501, 300), rng.integers(0, 11, 300)
    assert w.rank(s, at).tolist() == [int((v[:a] == c).sum()) for a, c in zip(at, s)]


# -- Jaccard join -----------------------------------------------------------------------------------


def sets_by_hand(rows, size=4):
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out.append((i, {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()))
    return out


def components_by_hand(rows, size=4, percent=85):
    sets = sets_by_hand(rows, size)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return collections.Counter((i, len(s), least[find(k)] if s else i) for k, (i, s) in enumerate(sets))


def test_join_documents(spark):
    docs = documents(spark)
    got = collections.Counter(tuple(r) for r in jaccard_join.components_of(docs).collect())
    assert got == components_by_hand([(r.doc_id, r.text) for r in docs.collect()])


def test_join_near_copies(spark, monkeypatch):
    """Chains of copies with edits at random places, of unequal length, and a common line."""
    monkeypatch.setattr(jaccard_join, "PARTNERS", 5)
    rng = random.Random(7)
    line = " ".join(f"common{k}" for k in range(12))
    rows, i = [], 0
    for group in range(6):
        words = [f"g{group}w{k}" for k in range(rng.choice([9, 30, 120]))]
        for _ in range(14):
            words = list(words)
            for _ in range(rng.randrange(0, 3)):
                k = rng.randrange(len(words))
                if rng.random() < 0.5:
                    words[k] = f"e{rng.random()}"
                else:
                    words.insert(k, f"e{rng.random()}")
            rows.append((i, " ".join(words) + ("\n" + line if i % 2 else "")))
            i += 1
    rng.shuffle(rows)
    got = collections.Counter(tuple(r) for r in jaccard_join.components_of(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == components_by_hand(rows)


def test_join_of_many_apart(spark, monkeypatch):
    """Sets that share most shingles but mostly don't link, in more rounds and parts than their number needs."""
    monkeypatch.setattr(jaccard_join, "WIDTHS", (1, 2, 1 << 40))
    monkeypatch.setattr(jaccard_join, "HELD", 7)
    rng = random.Random(12)
    base = [f"b{k}" for k in range(160)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join([*base[:90], *(f"u{rng.randrange(10**6)}" for _ in range(24))])) for i in range(40)]
    rng.shuffle(rows)
    got = collections.Counter(tuple(r) for r in jaccard_join.components_of(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == components_by_hand(rows) and 20 < len({c for _, _, c in got}) < 125


def test_components_meet_by_few_pairs_until_the_last_round():
    """Rows of one shingle that may all link: 60 of one component, 60 of another and 20 alone."""
    rows = 140
    component = np.concatenate([np.repeat([0, 1], 60), np.arange(2, 22)])
    order = np.random.default_rng(4).permutation(rows)
    one, c = np.ones(rows, np.int64), component[order]
    seen = np.full(rows, None, object)
    group = [one, 0 * one, one.astype(bool), one.astype(bool), 0 * one, 100 * one, c, 0 * one, np.zeros((rows, 8), np.uint64), order, seen]
    for width in (1, 4):
        a, b = jaccard_join._meet(group, width, 85)
        between = collections.Counter(tuple(sorted(p)) for p in zip(c[a].tolist(), c[b].tolist()))
        assert (a < b).all() and all(x != y for x, y in between) and max(between.values()) == width
        assert max(collections.Counter(zip(b.tolist(), c[a].tolist())).values()) == 1
    a, b = jaccard_join._meet(group, jaccard_join.WIDTHS[-1], 85)
    assert len(set(zip(a.tolist(), b.tolist()))) == len(a) == (rows**2 - 2 * 60**2 - 20) // 2


def test_one_row_of_each_component_stays(spark):
    text = " ".join(f"w{k}" for k in range(40))
    near = text.replace("w39", "x")
    rows = [(5, near), (5, "a text of its own that stays as it is"), (1, text), (None, text), (None, text), (1, text), (7, ""), (7, ""), (8, None), (None, "another that stands alone in the table")]
    df = spark.createDataFrame([(i, t, k, "mine") for k, (i, t) in enumerate(rows)], "doc_id long, text string, hash int, `__gone` string")
    kept = jaccard_join.keep_one(df)
    found = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    assert kept.columns == df.columns and found == {(1, text): 1, (5, rows[1][1]): 1, (7, ""): 2, (8, None): 1, (None, rows[-1][1]): 1}


def test_sketches():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    b = np.unique(np.concatenate([a[40:], rng.integers(0, 2**63, 30).astype(np.uint64)]))
    x, y = (np.frombuffer(jaccard_join.sketch(s), np.uint64) for s in (a, b))
    assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b)) and len(x) * 64 == jaccard_join.SKETCH
    for n, m in ((10, 10), (100, 117), (147, 147)):
        best = max(n + m - 2 * o for o in range(m + 1) if 100 * o >= 85 * (n + m - o))
        assert jaccard_join.most_apart(np.array([n]), np.array([m]), 85)[0] == best


def test_join_odd(spark, odd, empty):
    got = collections.Counter(tuple(r) for r in jaccard_join.components_of(odd).collect() if r.doc_id is not None)
    assert got == components_by_hand(odd_rows())
    assert [r.component_id for r in jaccard_join.components_of(odd).where("doc_id is null").collect()] == [None]
    assert jaccard_join.components_of(empty).count() == 0
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 4, 5, 7, None} and kept.where("doc_id in (3, 8)").count() == 0


# -- language model -------------------------------------------------------------------------------------


def test_base_score(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    counts = collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(t.encode().lower().split())
            counts[b""] += 1
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in brown_lm.perplexity(docs).collect()}
    for i, t in rows:
        w = [*t.encode().lower().split(), b""]
        r = got[i]
        assert r.n_tokens == len(w) and r.train_tokens == n and r.n_known == sum(counts[x] > 0 for x in w)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), abs=1e-6)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_add_up(spark):
    docs = common.texts(documents(spark))
    counts = common.cut(brown_lm.word_counts(docs))
    m = brown_lm.learn(docs, counts)
    assert np.allclose((10.0**m.transition).sum(1), 1, atol=1e-6)
    rare = collections.defaultdict(list)
    own = set(m.words)
    for r in counts.collect():
        if bytes(r.word) not in own:
            rare[brown_lm.bucket(bytes(r.word))].append(r.c)
    for c in range(brown_lm.CLASSES):
        units = np.flatnonzero(m.now == c)
        total = sum(10.0 ** m.emission[u] for u in units if u < len(m.words))
        total += sum(10.0 ** m.emission[u] * (sum(x + 1 for x in rare[u - len(m.words)]) + 1) for u in units if u >= len(m.words))
        assert not len(units) or total == pytest.approx(1, abs=1e-6)


def test_lm_odd(spark, odd, empty):
    got = brown_lm.perplexity(odd).collect()
    assert len(got) == odd.count() and all(math.isfinite(r.score) and r.n_tokens >= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    assert {r.n_tokens for r in got if r.doc_id in (4, 5, 6)} == {1}
    assert brown_lm.perplexity(empty).count() == 0


# -- toxicity ---------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    chain = toxicity.train(docs, labels.where("doc_id % 3 <> 0"))
    rows = toxicity.score(docs, chain).join(labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "y"), "doc_id").collect()
    hits = sum(r.toxic for r in rows if r.y == 1)
    assert hits >= 0.85 * sum(r.y for r in rows) and sum(r.toxic for r in rows if r.y == 0) <= 0.01 * len(rows)
    assert all(0 <= r.p_toxic <= 1 and 0 <= r.p_severe <= 1 for r in rows)


def test_chain_by_hand():
    """Out-of-fold probabilities by plain loops, each fold's words and targets its own; and that links feed later ones."""
    rng = np.random.default_rng(5)
    n, folds = 300, toxicity.FOLDS
    has = (rng.random((n, 12)) < 0.3).astype(float)
    y = (has[:, 0] + has[:, 1] + rng.random(n) > 1.2).astype(float)
    fold, sizes = rng.integers(0, folds, n), rng.integers(20, 400, n)
    columns = [sorted(rng.choice(12, 6, replace=False).tolist()) for _ in range(folds)] + [list(range(12))]
    counts = rng.integers(0, 6, (n, folds + 1))
    weights, p = toxicity.chain_weights(has, columns, counts, sizes, y, fold)
    want = np.zeros((n, 3))
    for c in range(3):
        for f in range(folds):
            train = [i for i in range(n) if fold[i] != f]
            target = [[y[i] * (counts[i, f] >= 3), y[i] * (counts[i, f] > 0) * (counts[i, f] >= 0.01 * sizes[i]), y[i]][c] for i in train]
            x = [[*has[i, columns[f]], float(counts[i, f] > 0), float(counts[i, f] > 1), float(counts[i, f] > 0 and sizes[i] <= 200), *want[i, :c]] for i in range(n)]
            w = toxicity.fit_logistic(np.array([x[i] for i in train]), np.array(target))
            for i in set(range(n)) - set(train):
                want[i, c] = 1 / (1 + math.exp(-(np.dot(x[i], w[:-1]) + w[-1])))
    assert np.allclose(p, want, atol=1e-9)
    assert [len(w) for w in weights] == [16, 17, 18] and abs(weights[2][15:17]).max() > 1e-3
    other = y.copy()
    other[fold == 2] = 1 - other[fold == 2]  # labels of a fold say nothing about that fold's own first link
    assert np.allclose(toxicity.chain_weights(has, columns, counts, sizes, other, fold)[1][fold == 2, 0], p[fold == 2, 0])


def test_words_are_chosen_without_the_fold(spark, monkeypatch):
    """A word that only one fold's toxic rows have is in no model of the others' and none is fitted on it out of fold."""
    texts = [(i, f"plain text number {i} of many" + (" nasty vile" if i % 2 else "")) for i in range(200)]
    folds = {r.doc_id: r.fold for r in toxicity.sample(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, toxic int")).collect()}
    texts = [(i, t + (" onlyhere" if folds[i] == 1 and i % 2 else "")) for i, t in texts]
    seen = {}
    real = toxicity.chain_weights
    monkeypatch.setattr(toxicity, "chain_weights", lambda has, columns, *rest: seen.update(has=has, columns=columns) or real(has, columns, *rest))
    docs = spark.createDataFrame([*texts, (1, "a second text of one id")] * 2, "doc_id long, text string")
    chain = toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, toxic int"))
    assert len(seen["has"]) == 200 and b"onlyhere" in chain.terms
    column = next(k for k in range(seen["has"].shape[1]) if 0 < seen["has"][:, k].sum() < 40 and k in seen["columns"][-1])
    assert column not in seen["columns"][1] and all(column in seen["columns"][f] for f in (0, 2, 3, 4))


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (7, None), (9, 0), (99, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(odd, labels).count() == odd.count()
    assert not any(r.toxic for r in toxicity.toxicity(odd, labels.limit(0)).collect())
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.keep_clean(odd, labels.limit(0)).columns == odd.columns


def test_newton_fit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x @ [2, -1, 0] + 0.5 + rng.logistic(size=400) > 0).astype(float)
    w = toxicity.fit_logistic(x, y)
    p = toxicity.predict(x, w)
    grad = np.hstack([x, np.ones((400, 1))]).T @ (p - y) + np.array([toxicity.RIDGE * 400] * 3 + [1e-6]) * w
    assert np.abs(grad).max() < 1e-3 and w[0] > 1 and w[1] < -0.4
