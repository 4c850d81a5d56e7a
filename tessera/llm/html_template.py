"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its elements, told apart by their path, and its text runs, told apart by path
and words. Tokens that occur equally often on each page of a host, whose occurrence vectors are
equal, form an equivalence class; no vector is ever gathered: a token's sums of random
numbers of its pages, by partial sums over all pages of the host, are its vector's fingerprint.

1. Classes. Only tokens on SUPPORT different pages or more count, so hosts with fewer have no
   template. The class of tokens that occur once on each page is the root. Other classes, of
   CLASS tokens or more, are valid if their texts lie in their elements: blocks that only
   some pages have; they nest into the root.
2. Template. Texts of the root and of valid classes are the template's own: notices, labels
   and adverts that are always the same, wherever they stand. All other text fills slots.
3. Container. From the page down, the root element that holds MOST of the host's slot text is
   taken, and the one in it, as long as no heading that fills slots is left behind. On the way
   an article or main element ends the search, and if only the page's body is left, such
   an element is taken in its place: names break ties, the slots decide.
4. The main text is what fills the container's slots, less menus, headers, footers, asides, forms and the like
   by element or role, and by class or id: whole names of the list, outside the article parts of names too.

Pages whose host has no template, or that lack the container, give their article or main elements, or else
the whole body. A page's text depends on the pages of its host only, not on partitions. Hosts are
never gathered: a third of all pages may be one host's.

A null or empty page has an empty text. Pages without a URL form a host of their own. Repeated
pages are one page for SUPPORT. The text of a page is never cut.
"""

from __future__ import annotations

import html as html_entities
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Different pages that a token of a template is on at least (different ones by 63 classes of their hashes), and tokens of a class that isn't the root.
SUPPORT, CLASS = 8, 3
#: Share of the slot text that a container must hold.
MOST = 0.6

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*>""", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACE = re.compile(r"\s+")

# Elements of HTML by what they do to text.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img"}
_CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_AGAIN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_NOT_TEXT = {"head", "script", "style", "noscript", "template", "nav", "menu", "header", "footer", "aside", "form", "button", "select", "input", "textarea", "iframe", "object", "svg", "canvas", "dialog", "title"}
_NOT_NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "side", "aside", "complementary", "contentinfo", "notice", "notices", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "alert", "newsletter", "subscribe", "subscription", "signup", "login", "search", "share", "sharing", "social", "related", "recommended", "comment", "comments", "commentlist", "disqus", "respond", "replies", "reply", "pagination", "pager", "toolbar", "widget", "skip"}
_CONTAINERS = {"html", "body", "main", "article", "section", "div", "center", "table", "tbody", "tr", "td", "span"}
_NOT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}


def _label(name: str, attributes: str, inside: bool) -> tuple[str, bool]:
    """The element as a step of a path, and whether its names tell that its text is none of the article's."""
    label, hidden = name, name in _NOT_TEXT
    for kind, a, b, c in _NAMES.findall(attributes) if "=" in attributes else ():
        kind, value = kind.lower(), (a or b or c).strip().lower()
        if kind == "role":
            label += f"[role={value}]"
            hidden = hidden or value in _NOT_ROLES
        else:
            label += f".{value}" if kind == "class" else ""
            if name not in ("html", "body", "article", "main"):
                parts = value.split() if inside else [x for w in value.split() for x in (w, *re.split("[_-]", w))]
                hidden = hidden or not _NOT_NAMES.isdisjoint(parts)
    return label, hidden


def _last(path: str) -> str:
    """The element at a path's end."""
    return re.split(r"[.\[]", path.rpartition(">")[2], maxsplit=1)[0]


class Page:
    """tokens: (kind, path, hidden, text), kind one of "open", "close", "text"; spans: where the elements of a path begin and end."""

    __slots__ = ("tokens", "spans")

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str, bool, str]] = []
        stack: list[tuple[str, str, bool, bool]] = []  # name, path, hidden, in an article
        opened: list[int] = []
        self.spans: dict[str, list[tuple[int, int]]] = defaultdict(list)
        at, tokens = 0, self.tokens

        def close() -> None:
            _, path, hidden, _ = stack.pop()
            self.spans[path].append((opened.pop(), len(tokens)))
            tokens.append(("close", path, hidden, ""))

        def text(a: int, b: int) -> None:
            if a < b:
                tokens.append(("text", stack[-1][1] if stack else "", bool(stack and stack[-1][2]), source[a:b]))

        while True:
            m = _TOKEN.search(source, at)
            if m is None:
                text(at, len(source))
                break
            text(at, m.start())
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1)
                if depth >= 0 and (name not in _INLINE or all(s[0] in _INLINE for s in stack[depth:])):
                    while len(stack) > depth:
                        close()
                continue
            if name in _CLOSES_P:
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] not in _INLINE), -1)
                if depth >= 0 and stack[depth][0] == "p":
                    while len(stack) > depth:
                        close()
            elif name in _AGAIN:
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] not in _INLINE and stack[k][0] != "p"), -1)
                if depth >= 0 and stack[depth][0] in _AGAIN[name]:
                    while len(stack) > depth:
                        close()
            inside = bool(stack and stack[-1][3])
            label, hidden = _label(name, m[3] or "", inside)
            hidden = hidden or bool(stack and stack[-1][2])
            path = f"{stack[-1][1]}>{label}" if stack else label
            if name in _VOID:
                tokens.append(("open", path, hidden, ""))
                continue
            stack.append((name, path, hidden, inside or name in ("article", "main")))
            opened.append(len(tokens))
            tokens.append(("open", path, hidden, ""))
            if name in _RAW:
                end = re.compile(rf"</{re.escape(name)}\b", re.I).search(source, at)
                stop = end.start() if end else len(source)
                if name not in ("script", "style"):
                    text(at, stop)
                at = stop
        while stack:
            close()

    def counted(self) -> dict[tuple[bool, str, int], list[int]]:
        """(whether a text, path, hash of the words) -> [occurrences, visible characters in them]; the page itself has the path ""."""
        out: dict[tuple[bool, str, int], list[int]] = {}
        upto = [0]
        for kind, path, hidden, text in self.tokens:
            words = "" if hidden or kind != "text" else _words(text)
            if words:
                known = out.setdefault((True, path, text_key(path, words)), [0, 0])
                known[0] += 1
                known[1] += len(words)
            upto.append(upto[-1] + len(words))
        for path, spans in self.spans.items():
            out[False, path, 0] = [len(spans), sum(upto[b] - upto[a] for a, b in spans)]
        out[False, "", 0] = [1, upto[-1]]
        return out


def _words(text: str) -> str:
    return " ".join(text.split())


def text_key(path: str, words: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\n{words}".encode()) >> 1


def _named(page: Page) -> list[tuple[int, int]]:
    """Where a page's own article elements are, or else its main elements, or else all of it."""
    for name in ("article", "main"):
        spans = [s for path, all_ in page.spans.items() if _last(path) == name or name == "main" and path.endswith("[role=main]") for s in all_ if not page.tokens[s[0]][2]]
        if spans:
            return [s for s in sorted(spans) if not any(a < s[0] and s[1] <= b for a, b in spans)]
    return [(0, len(page.tokens))]


def blocks(page: Page, a: int, b: int, drop: frozenset[int]) -> list[str]:
    """The blocks of text between two tokens without the texts to drop."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = _SPACE.sub(" ", html_entities.unescape("".join(run))).strip(" ")
        if text:
            out.append(text)
        run.clear()

    for kind, path, hidden, text in page.tokens[a:b]:
        if kind == "text":
            if not hidden and not (drop and text_key(path, _words(text)) in drop):
                run.append(text)
            continue
        name = _last(path)
        if name not in _INLINE:
            end()
        elif name == "br" and kind == "open":
            run.append(" ")
    end()
    return out


def page_text(source: str, container: str | None, drop: frozenset[int]) -> str:
    """The main text of a page by its host's template."""
    page = Page(source)
    spans = page.spans.get(container, []) if container else []
    if not spans or _last(container) in ("html", "body"):
        spans = _named(page)
    return "\n".join(x for a, b in spans for x in blocks(page, a, b, drop))


def template(tokens: Iterable[tuple[bool, str, int, int, int, int]]) -> tuple[str | None, list[int]]:
    """The path of the container and the keys of the template's texts.

    tokens: (whether a text, path, key, class, characters, occurrences) of the classes of one host; the root is class 0.
    """
    members: dict[int, list[tuple]] = defaultdict(list)
    for t in tokens:
        members[t[3]].append(t)
    under = lambda path, top: path == top or path.startswith(f"{top}>") or not top
    own = []  # (path, key, characters) of the template's texts
    for number, found in members.items():
        texts = [(t[1], t[2], t[4]) for t in found if t[0]]
        tops = [t[1] for t in found if not t[0]]
        if number == 0:
            own += texts
        elif len(found) >= CLASS and tops:
            own += [x for x in texts if any(under(x[0], top) for top in tops)]
    root = {t[1]: t[4] for t in members[0] if not t[0]}

    def slots(top: str) -> int:
        return root.get(top, 0) - sum(n for path, _, n in own if under(path, top))

    heads = [t[1] for found in members.values() for t in found if not t[0] and re.fullmatch("h[1-3]", _last(t[1])) and t[4] > sum(n for path, _, n in own if under(path, t[1]))]
    whole = slots("")
    chain = sorted((p for p in root if p and _last(p) in _CONTAINERS | {"article", "main"} and whole > 0 and slots(p) >= MOST * whole), key=len)
    main = None
    for path in chain:
        if main is not None and any(under(h, main) and not under(h, path) for h in heads):
            break
        main = path
        if _last(path) in ("article", "main") or path.endswith("[role=main]"):
            break
    if main is None or _last(main) in ("html", "body"):
        named = [p for name in ("main", "article") for p in root if _last(p) == name]
        main = max(named, key=lambda p: (_last(p) == "article", slots(p), -len(p)), default=main)
    return main, sorted({key for _, key, _ in own})


def _pages(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    url = df[url_col].cast("string")
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    return df.select(df[id_col].cast("long").alias("page_id"), url.alias("url"), host.alias("host"), F.coalesce(df[html_col].cast(T.StringType()), F.lit("")).alias("html"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, container, texts) of the hosts that have a template, a table of cut(). pages: (host, html)."""
    schema = pa.schema([("host", pa.string()), ("is_text", pa.bool_()), ("path", pa.string()), ("key", pa.int64()), ("times", pa.int64()), ("chars", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bits", pa.int64())])

    def emit(b: pa.RecordBatch) -> pa.RecordBatch:
        sums: dict[tuple, list[int]] = {}
        for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            w = xxhash.xxh3_64_intdigest(source.encode())
            for token, (times, chars) in Page(source).counted().items():
                x = sums.setdefault((host, *token), [0, 0, 0, 0, 0])
                x[0] += times
                x[1] += chars
                x[2] += times * (w & 0x3FFFFFFF)
                x[3] += times * (w >> 30 & 0x3FFFFFFF)
                x[4] |= 1 << (w >> 32) % 63
        if not sums:
            return common.batch(schema, *[[]] * 9)
        return common.batch(schema, *map(list, zip(*((*k, *v) for k, v in sums.items()))))

    parts = common.arrow_map(pages, emit, "host string, is_text boolean, path string, key long, times long, chars long, f1 long, f2 long, bits long", "html")
    sums = parts.groupBy("host", "is_text", "path", "key").agg(*[F.sum(c).alias(c) for c in ("times", "chars", "f1", "f2")], F.bit_or("bits").alias("bits"))
    known = common.cut(sums.where(F.bit_count("bits") >= SUPPORT))
    whole = known.where("path = '' and not is_text").select("host", F.col("f1").alias("w1"), F.col("f2").alias("w2"))
    size = known.groupBy("host", "f1", "f2").agg(F.count("*").alias("size"), F.count_if(~F.col("is_text")).alias("elements"))
    root = (F.col("f1") == F.col("w1")) & (F.col("f2") == F.col("w2"))
    head = F.col("path").rlike(r"(^|>)h[1-3][^>]*$") & ~F.col("is_text")
    found = known.join(size, ["host", "f1", "f2"]).join(whole, "host").where(root | head | (F.col("size") >= CLASS) & (F.col("elements") > 0))
    number = F.when(root, F.lit(0)).otherwise(1 + F.shiftrightunsigned(F.xxhash64("f1", "f2"), 2))
    token = F.struct("is_text", "path", "key", number.alias("class"), "chars", "times")
    hosts = found.groupBy("host").agg(F.collect_list(token).alias("tokens"))  # as many as a page has, and blocks that some have
    out = pa.schema([("host", pa.string()), ("container", pa.string()), ("texts", pa.list_(pa.int64()))])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [template([tuple(t.values()) for t in tokens]) for tokens in b.column(1).to_pylist()]
            yield common.batch(out, b.column(0), [g[0] for g in got], [g[1] for g in got])

    made = common.cut(hosts.mapInArrow(decide, "host string, container string, texts array<long>"))
    common.discard(known)
    return made


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    pages = _pages(df, id_col, url_col, html_col)
    known = templates(pages.select("host", "html"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        made: dict[str, frozenset[int]] = {}
        texts = []
        for host, source, container, drop in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5))):
            if host not in made:
                made[host] = frozenset(drop or ())
            texts.append(page_text(source, container, made[host]))
        return common.batch(schema, b.column(0), b.column(1), texts, [len(t) for t in texts])

    met = pages.join(known, "host", "left").select("page_id", "url", "host", "html", "container", "texts")
    return common.arrow_map(met, run, "page_id long, url string, text string, n_chars long", "html")


def extract(sources: list[str]) -> list[str]:
    """The main texts of pages of one host, without Spark."""
    sums: dict[tuple[bool, str, int], list[int]] = {}
    for source in sources:
        w = xxhash.xxh3_64_intdigest(source.encode())
        for token, (times, chars) in Page(source).counted().items():
            x = sums.setdefault(token, [0, 0, 0, 0])
            for k, more in enumerate((times, chars, times * w)):
                x[k] += more
            x[3] |= 1 << (w >> 32) % 63
    whole = sums.get((False, "", 0), [0, 0, 0, 0])
    found = [(*token, 0 if x[2] == whole[2] else 1 + x[2], x[1], x[0]) for token, x in sums.items() if x[3].bit_count() >= SUPPORT]
    container, texts = template(found) if whole[3].bit_count() >= SUPPORT else (None, [])
    return [page_text(s, container, frozenset(texts)) for s in sources]
