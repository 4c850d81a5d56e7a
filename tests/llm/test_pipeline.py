"""The pipeline's stages, each on its own input against brute force, and all together."""

import collections
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tessera.llm import common

from .test_corpus import components_by_hand
from .test_lines import by_hand as lines_by_hand
from .test_lines import place

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


def made(rng):
    """(id, text) with copies, near copies, passages, repeated lines, null and repeated ids, empty and blank texts."""
    words = [f"w{k}" for k in range(3000)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    line = " ".join(rng.choice(words) for _ in range(12))
    rows = [(i, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(5, 60))) for _ in range(rng.randrange(1, 5)))) for i in range(60)]
    for i in range(60, 100):
        text = rows[rng.randrange(60)][1].split(" ")
        for _ in range(rng.randrange(0, 4)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    rows += [(100 + i, rng.choice(words) + f" a{i} " + passage + f" b{i} c{i}\n" + line) for i in range(10)]
    rows += [(None, rows[3][1]), (None, rows[3][1]), (None, "a text without an id that stands alone here"), (5, "another text of a known id, unlike the first"), (5, rows[7][1]), (7, rows[7][1]), (200, None), (201, ""), (202, " \n "), (201, "")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return made(random.Random(21))


@pytest.fixture(scope="module")
def docs(spark, rows):
    frame = [(i, t, "en", "s", 0 if t is None else len(t), f"mine {k}", k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(frame, "doc_id long, text string, lang string, source string, n_chars int, hash string, `__key` int")


def stage(spark, docs, name):
    out = STAGE[name](spark, docs, SF)
    assert out.columns == docs.columns
    got = out.collect()
    given = {r["__key"]: r for r in docs.collect()}
    assert len({r["__key"] for r in got}) == len(got) and all(r.hash == given[r["__key"]].hash and r.doc_id == given[r["__key"]].doc_id for r in got)
    return {r["__key"]: r.text for r in got}


def test_lines_stage(spark, docs, rows):
    import hashlib

    got = stage(spark, docs, "line_dedup")
    want = collections.Counter((i, h) for (i, _, _, h), n in lines_by_hand(rows).items() for _ in range(n))
    for k, text in got.items():
        want[rows[k][0], hashlib.sha256((text or "").encode()).hexdigest()] -= 1
    left = {key: n for key, n in want.items() if n}
    assert all(n > 0 for n in left.values()) and {h for _, h in left} <= {hashlib.sha256(t).hexdigest() for t in (b"", b"\n", b"\n\n", b"\n\n\n")}  # gone whole
    assert all(k in got for k, (_, t) in enumerate(rows) if not (t or "").split())


def test_near_duplicates_stage(spark, docs, rows):
    got = stage(spark, docs, "ngram_jaccard_join")
    # rows by place, so that a component is named by its least row, not by an id that several have
    order = sorted(range(len(rows)), key=lambda k: (*place(rows[k][0], rows[k][1] or ""), k))
    found = components_by_hand([(order.index(k), t) for k, (_, t) in enumerate(rows)], 5, 80)
    want = {order[c] for i, n, c in found if n} | {k for k, (_, t) in enumerate(rows) if not (t or "").split()}
    assert {(rows[k][0], rows[k][1]) for k in got} == {(rows[k][0], rows[k][1]) for k in want} and len(got) == len(want)


def test_substring_stage(spark, docs, rows):
    got = stage(spark, docs, "substring_dedup")
    first = {}
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            first[key] = min(first.get(key, (True, 0, 0)), (i is None, i or 0, k))
    for n, (i, t) in enumerate(rows):
        w = (t or "").split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] < (i is None, i or 0, k):
                gone[k : k + 20] = [True] * 20
        kept = [x for x, g in zip(w, gone) if not g]
        assert (got[n] or "").split() == kept if kept or not w else n not in got


def test_toxicity_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    kept = {r.doc_id for r in STAGE["toxicity"](spark, docs, "/root/testdata/sf0.01").collect()}
    toxic, clean = {i for i, t in labels.items() if t}, {i for i, t in labels.items() if not t}
    assert len(toxic & kept) <= 0.1 * len(toxic) and len(clean & kept) >= 0.99 * len(clean)


def test_packing_stage(spark, docs, rows):
    packed = STAGE["packing"](spark, docs, SF).collect()
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    model.encode_special_tokens = True
    want = collections.Counter(i for i, t in rows for _ in range(len(model.encode(t or "", add_special_tokens=False).ids) + 1))
    got = collections.Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert got == want
    by_sequence = collections.defaultdict(list)
    for r in packed:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048


def test_run_and_entry(spark, monkeypatch):
    here = set(common._left)
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0
    assert len(set(common._left) - here) < 30
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
