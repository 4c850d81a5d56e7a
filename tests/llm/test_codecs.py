"""FLAC, byte-level BPE, packing, compression bands and HTML: exact round trips and brute force."""

import hashlib
import os
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe, common, compress_rules, flac, html_template, packing, toxicity

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "naïve café — “x” 12²\x1f\x85\xa0y"), (6, "word " * 5000), (7, "x" * 30000), (8, "tie"), (8, "tie"), (None, "null id"), (9, "👍🏽 नमस्ते 你好 İß Σας <|endoftext|>")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "src", "length", 1.5) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, length string, ids double")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# -- FLAC --------------------------------------------------------------------------------------


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=4000))
def test_flac_round_trip(raw):
    p = flac.payload(raw)
    media = flac.encode([p])
    assert b"".join(x for _, x in flac.decode_blocks(media)[0]) == p


def test_flac_predictors_and_seeking():
    wave = (128 + 60 * np.sin(np.arange(1152 * 9) / 9)).astype(np.uint8).tobytes()
    media = flac.encode([wave, b"\x07" * 1152, os.urandom(1152 * 2)])
    assert len(media[0]) < 0.6 * len(wave) and len(media[1]) < 100
    for p, blocks in zip([wave], flac.decode_blocks(media)):
        assert b"".join(x for _, x in blocks) == p and [o for o, _ in blocks] == list(range(0, len(p), 1152))
    offset, block = flac.read_at(media[0], 5000)
    assert offset == 4608 and wave[offset : offset + len(block)] == block
    head = flac.Stream(media[0])
    bare = media[0][:4] + b"\x80" + media[0][5:42] + media[0][head.first :]  # without a seek table
    assert b"".join(x for _, x in flac.decode_blocks([bare])[0]) == wave


@pytest.mark.parametrize("place", [-1, -30, 30, 60])
def test_flac_damage_is_found(place):
    media = bytearray(flac.encode([flac.payload(b"some text that is damaged " * 90)])[0])
    media[place] ^= 1
    with pytest.raises((flac.FlacError, KeyError, IndexError, ValueError)):
        flac.decode_blocks([bytes(media)])


def test_flac_crc():
    def slow(data, poly, bits):
        c = 0
        for b in data:
            c ^= b << (bits - 8)
            for _ in range(8):
                c = (c << 1 ^ poly if c >> (bits - 1) & 1 else c << 1) & ((1 << bits) - 1)
        return c

    data = os.urandom(500)
    got = flac.crc16(np.frombuffer(data, np.uint8), np.array([0, 100]), np.array([100, 500]))
    assert got.tolist() == [slow(data[:100], 0x8005, 16), slow(data[100:], 0x8005, 16)] and flac.crc8(data[:9]) == slow(data[:9], 7, 8)


def test_flac_query(spark, odd, empty):
    rows = flac.digests(odd).collect()
    assert len(rows) == len(ODD)
    want = Counter()
    for i, t in ODD:
        p = flac.payload((t or "").encode())
        want[(i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert flac.digests(empty).count() == 0
    media = flac.to_media(odd)
    pcm = flac.to_pcm(media.where("doc_id = 6")).orderBy("sample_offset").collect()
    assert b"".join(bytes(r.pcm) for r in pcm) == flac.payload(ODD[5][1].encode())


# -- byte-level BPE ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), P.PATTERN)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300), st.integers(1, 40))
def test_bpe_parts_change_nothing(codec, text, size):
    whole = codec.encoding.encode_ordinary(text)
    parts = [i for p in codec.parts(text, size) for i in codec.encoding.encode_ordinary(p)]
    assert parts == whole and codec.decode(np.array(whole, "<u4")) == text.encode()


def test_bpe_query(spark, odd, empty, codec):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = Counter(tuple(r) for r in bpe.round_trip(odd, path, P.PATTERN).collect())
    want = Counter()
    for i, t in ODD:
        ids = np.array(codec.encoding.encode_ordinary(t or ""), "<u4")
        want[(i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert got == want
    assert bpe.round_trip(empty, path, P.PATTERN).count() == 0
    back = bpe.decode(bpe.encode(odd, path, P.PATTERN), path, P.PATTERN).collect()
    assert Counter((r.doc_id, bytes(r.raw)) for r in back) == Counter((i, (t or "").encode()) for i, t in ODD)


def test_bpe_long_white_space(codec):
    """As the library where that can: runs beyond LONG_WHITE before, between and after words, of all its white space."""
    assert codec.white
    runs = [" " * 20_000, "\n" * 30_000, " \n\t" * 9_000, "\u3000" * 17_000, "\x85\u2028" * 9_000, "\x1c" * 20_000, " " * 100]
    texts = [a + "word" * k + b + c + "x's" * k for a in ("", "before 1") for k in (0, 1) for b in runs for c in ("", "!", runs[0], runs[1])]
    for t in texts:
        t += "y" * (bpe.PART_CHARS + 1 - len(t))
        assert codec.encode(t).tolist() == codec.encoding.encode_ordinary(t)
        t = t[::-1]
        assert codec.encode(t).tolist() == codec.encoding.encode_ordinary(t)


def test_bpe_millions_of_characters(codec):
    for t in (" " * 3_000_000, "\n" * 2_000_000, "a" + " \n" * 1_500_000 + "b c", "ab" * 1_500_000, "7" * 2_000_000, "#" * 2_000_000, "\u3000" * 1_000_000):
        assert codec.decode(codec.encode(t)) == t.encode()


# -- packing --------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=40))
def test_differencing_holds_everything(sizes):
    windows = packing.deal(sizes, 64)
    assert sorted(k for w in windows for k in w) == list(range(len(sizes)))
    assert all(sum(sizes[k] for k in w) <= 64 for w in windows)


def test_differencing_is_near_equal():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 257, 300).tolist()
    sums = [sum(sizes[k] for k in w) for w in packing.differencing(sizes, 32)]
    assert max(sums) - min(sums) < 40
    assert sorted(map(len, packing.differencing([8, 7, 6, 5, 4], 2))) == [2, 3]


def test_pack_query(spark, odd, empty):
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    rows = packing.pack(odd, path).collect()
    want = {}
    for i, t in ODD:
        want[i] = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for i, ids in want.items():
        copies = sum(j == i for j, _ in ODD)
        covered = Counter(k for r in by_doc[i] for k in range(r.start, r.start + r.length))
        assert covered == Counter({k: copies for k in range(len(ids))})
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert packing.pack(empty, path).count() == 0


def test_padding_is_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    p = packing.padding(packing.pack(docs, P.path("word_bpe_49k.json"))).first()
    # spare tokens of the blocks, and one window more of the last, which is not full
    assert p.padded < 0.004 * p.tokens + 2 * 2048


def test_ids_are_taken_without_their_places():
    """Only the call that doesn't trace places back is there; the ids are those of the whole text."""
    class Fast:
        def __init__(self, library):
            self.encode_batch_fast = library.encode_batch_fast

    t = packing.Tokens(open(P.path("word_bpe_49k.json")).read())
    plain, t.library = t.library, Fast(t.library)
    texts = ["", " ", "Some new words, quite a few of them: don't, 12.5 and x_y.", "Stra\u00dfe \u0130 e\u0301 \u4e2d\u6587 \U0001f600", "a\x1cb <s> [UNK] </s>\n\ttab", "word " * 50]
    for text in texts:
        assert np.frombuffer(t.ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_words_alone_give_the_same_ids():
    t = packing.tokens(open(P.path("word_bpe_49k.json")).read())
    assert t.by_word
    for text in [x or "" for _, x in ODD] + ["don't ''s 're''re x'd' ñ'll1 a_b --x", "A\x1cB"]:
        assert t.ids(text) == t.whole(text)


def test_workers_give_back_what_packing_keeps(spark, odd):
    """A worker that packed drops its words when it begins another kind of task."""
    path = P.path("word_bpe_49k.json")
    packing.pack(odd.repartition(8), path).collect()
    left = common.arrow_map(common.texts(odd.repartition(8)), lambda b: pa.RecordBatch.from_pydict({"n": pa.array([len(packing._made)] * b.num_rows, pa.int64())}), "n long")
    assert {r.n for r in left.collect()} == {0}
    packing.tokens(open(path).read())
    toxicity._verdict(None, 0.5)(pd.Series(["a text"]))
    assert not packing._made


def test_new_words_are_matched_once():
    """Words of letters are not matched at all, others once; what they make up is kept with them."""
    t = packing.Tokens(open(P.path("word_bpe_49k.json")).read())
    seen, matches = Counter(), t.matches
    t.matches = lambda w: seen.update([w]) or matches(w)
    text = "Plain Words, some of them new: don't, 12.5 and x_y. ñandú\u0130s stra\u00dfe ªº 'tis rock'n'roll it's'd a1b2 ½x €5 " * 2
    assert t.by_word and t.ids(text) == t.whole(text)
    assert seen and set(seen.values()) == {1} and not any(w.isalpha() for w in seen)


def test_kept_words_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 50)
    t = packing.Tokens(open(P.path("word_bpe_49k.json")).read())
    for k in range(60):
        text = " ".join(f"w{chr(97 + (k * j) % 26)}{chr(97 + j)}, v{k % 9}" for j in range(20))
        assert t.ids(text) == t.whole(text)
        assert len(t.older) < 50 + 200


# -- compression bands ------------------------------------------------------------------------------


def rules_by_hand(text):
    words = (text or "").encode().split()
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    n = Counter(windows)
    again = set()
    for k, w in enumerate(windows):
        if n[w] > 1:
            again |= set(range(k, k + 5))
    lines = (text or "").split("\n")
    dup = sum(1 for k, x in enumerate(lines) if x.encode().split() and x in lines[:k])
    joined = b"".join(words).decode()
    return len(words), len(joined), sum(joined.count(c) for c in "#*$%&|<>"), dup, len(again)


def test_rules_query(spark, odd, empty):
    got = compress_rules.rules(odd).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((i, *rules_by_hand(t)) for i, t in ODD)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert compress_rules.rules(empty).count() == 0


def test_rules_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in compress_rules.rules(docs).collect()}
    for d in docs.limit(200).collect():
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == rules_by_hand(d.text)
    clean = [x.doc_id for x in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").collect()]
    held = [got[i] for i in clean if not got[i].base_failed]
    assert sum(r.kept for r in held) >= 0.99 * len(held)


def test_bands_reject_noise_and_repetition(spark):
    import base64
    import random

    random.seed(1)
    noise = " ".join(base64.b64encode(os.urandom(60)).decode() for _ in range(60))
    nearly = "\n".join(f"row {k} of the table has the value {k * 7 % 5} and the same words as all the other rows" for k in range(300))
    rows = {r.doc_id: r.kept for r in compress_rules.rules(spark.createDataFrame([(1, noise), (2, nearly)], "doc_id long, text string")).collect()}
    assert rows == {1: False, 2: False}


def test_one_junk_passage_in_long_prose_is_enough(spark):
    import base64

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1"), "doc_id")
    kept = compress_rules.rules(docs).where("kept").select("doc_id")
    clean = [r.text for r in docs.join(kept, "doc_id").where("length(text) between 1500 and 4000").orderBy("doc_id").limit(40).collect()]
    junk = {"noise": base64.b64encode(bytes(random_bytes(3750))).decode(), "again": "all work and no play makes a dull day " * 10}
    rows = [(0, "\n".join(clean)[:16_000]), (1, clean[0])]
    for k, at in enumerate((0, 5_000, 16_000)):
        rows.append((10 + k, rows[0][1][:at] + " " + junk["noise"] + " " + rows[0][1][at:]))
    rows.append((20, clean[0][:700] + " " + junk["noise"][:1100] + " " + clean[0][700:]))
    rows.append((21, rows[0][1][:9_000] + " " + junk["again"] * 3 + rows[0][1][9_000:]))
    got = {r.doc_id: r for r in compress_rules.rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(r.base_failed for i, r in got.items() if i != 21)
    assert {i for i, r in got.items() if r.kept} == {0, 1}


def random_bytes(n):
    import random

    return random.Random(2).randbytes(n)


# -- HTML ------------------------------------------------------------------------------------------


def test_pages_of_the_tables(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    got = html_template.main_text(pages).collect()
    assert len(got) == len(source)
    for r in got:
        article = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>|<br>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def site(k, body):
    """A page without an article element and without telling names; menu and footer change from page to page."""
    menu = "".join(f"<li><a href='/{k}{j}'>menu {k} {j}</a></li>" for j in range(3))
    return f"<html><body><div class=q1><ul>{menu}</ul></div><div class=q2>{body}</div><div class=q3>page {k} of many</div></body></html>"


def sites():
    pages = {}
    for k in range(40):
        paragraphs = "".join(f"<p>Paragraph {j} of page {k} tells of {k * 31 + j} things.</p>" for j in range(2 + k % 4))
        notice = "<div class=q9><p>Members read this first</p><p>Join us</p></div>" if k % 2 else ""
        often = "<p>Said on some pages only</p>" if k % 3 == 0 else ""
        pages[k] = site(k, f"<h2>Title {k}</h2>{notice}{paragraphs}{often}<p>Read more here</p>")
    want = {k: "\n".join([f"Title {k}", *(f"Paragraph {j} of page {k} tells of {k * 31 + j} things." for j in range(2 + k % 4)), *(["Said on some pages only"] if k % 3 == 0 else [])]) for k in pages}
    return pages, want


def test_slots_of_the_template_are_the_text(spark, monkeypatch):
    """The container by its slots, texts of the root and of a nested class out, also where they are one paragraph among others."""
    pages, want = sites()
    df = spark.createDataFrame([(k, f"http://h/{k}", h) for k, h in pages.items()] + [(100 + k, f"http://h/{k}", pages[k]) for k in range(3)], "page_id long, url string, html string")
    found = {}
    for parts in (1, 4, 211):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            found[parts] = {r.page_id: r.text for r in html_template.main_text(df.repartition(parts)).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[1] == found[4] == found[211] == want | {100 + k: want[k] for k in range(3)}
    assert html_template.extract(list(pages.values())) == list(want.values())
    monkeypatch.setattr(html_template, "template", lambda tokens: (None, []))
    assert all(a != b for a, b in zip(html_template.extract(list(pages.values())), want.values()))


def test_few_pages_have_no_template(spark):
    pages, _ = sites()
    some = [pages[k] for k in range(5)] * 4  # repeated pages are one
    assert all("Read more here" in t and "menu" in t for t in html_template.extract(some))
    df = spark.createDataFrame([(k, "http://h/", h) for k, h in enumerate(some)], "page_id long, url string, html string")
    assert [r.text for r in html_template.main_text(df).orderBy("page_id").collect()] == html_template.extract(some)


def test_classes_by_hand():
    """Fingerprints against occurrence vectors, and the container against sums over the pages."""
    pages, _ = sites()
    vectors = {}
    for k, h in pages.items():
        for token, (times, _) in html_template.Page(h).counted().items():
            vectors.setdefault(token, [0] * len(pages))[k] = times
    ones = {t for t, v in vectors.items() if v == [1] * len(pages)}
    assert {p for text, p, _ in ones if not text} >= {"", "html>body>div.q1", "html>body>div.q2>h2"} and "html>body>div.q2>p" not in {p for text, p, _ in ones if not text}
    assert sum(text for text, *_ in ones) == 1
    tokens = [(*t, 0 if t in ones else 1 + hash(tuple(v)) % 10**9, sum(html_template.Page(h).counted().get(t, [0, 0])[1] for h in pages.values()), sum(v)) for t, v in vectors.items() if sum(map(bool, v)) >= html_template.SUPPORT]
    container, texts = html_template.template(tokens)
    assert container == "html>body>div.q2" and len(texts) == 3


def test_template_words_and_roles():
    page = '<html><body><header><h1>Site</h1></header><div id="content"><h2>Title {k}</h2><p>Body &amp; words number {k} {k}.</p><p>Read more here</p><div class="comments"><p>troll {k}</p></div></div><aside>side</aside><form>q</form><footer>f</footer></body></html>'
    got = html_template.extract([page.replace("{k}", str(k)) for k in range(40)])
    assert got[3] == "Title 3\nBody & words number 3 3."


def test_names_inside_an_article():
    page = "<article><h1>T {k}</h1><section id='social-effects'><p>On social effects {k}</p></section><div class='search-results x'><p>Found {k}</p></div><div class='x comments'>troll {k}</div><nav>n</nav></article>"
    got = html_template.extract([page.replace("{k}", str(k)) for k in range(3)])
    assert got[1] == "T 1\nOn social effects 1\nFound 1"


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "http://a/x", ""), (3, "http://a/y", "plain text"), (3, "http://a/y", "plain text"), (None, "http://b", "<p>x<p>y"), (4, "http://c", "<a title='b>c'>q</a><script>var a='</p>';</script><style>p{}"), (5, "http://c", "<p>" * 3000 + "deep"), (6, "http://d", "<" * 2000 + "a")]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, n_chars int, host string")
    got = {(r.page_id, r.text) for r in html_template.main_text(df).collect()}
    assert {(1, ""), (2, ""), (3, "plain text"), (None, "x\ny"), (4, "q"), (5, "deep")} <= got
    assert html_template.main_text(df).count() == len(rows)
    assert html_template.main_text(df.limit(0)).count() == 0
