"""Toxicity by a classifier chain of linear models.

Categories, in this order: repeated (toxic with REPEATED or more abusive words), severe (toxic
with abusive words making up SEVERE of the words or more) and toxic (the given label). The
first two tell how often abuse comes; the models only see which words and word beginnings a text
has, whether one or two abusive ones are among them, and whether the text is short, so they estimate it. Each category has a logistic model over these and the probabilities of
the categories before it; the verdict is the last one's, which both others feed.

For training the probabilities are out of fold: the rows fall into FOLDS folds by a hash of their
id, and a fold's probabilities come from models fitted on the others, over words that
were chosen, and abusive words that were found, on the others alone. The models that
score documents are fitted on all training rows with those probabilities.

The training sample is bounded: of the labelled rows, those of the MAX_TRAIN least hashes of the
id; of documents with one id the least text. Words are candidates if LEAST_ROWS toxic rows have them; the driver
gets at most MAX_WORDS of them for each fold left out and, of the sampled rows, which they have.
Every document is scored over its whole text, in a map over the scan.

Null and empty texts, and any text when there is nothing to learn from (no labels or none
of either kind), have probability 0. Null labels and labels of unknown documents are not
used; of contradicting labels toxic counts. Repeated rows are scored as rows of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CATEGORIES = ("repeated", "severe", "toxic")
MAX_TRAIN = 20_000
MAX_WORDS = 1_000
#: Words that a model sees besides the abusive ones.
TERMS = 200
LEAST_ROWS = 3
FOLDS = 5
REPEATED = 3
SEVERE = 0.01
THRESHOLD = 0.5
#: Words of a short text.
SHORT = 200
RIDGE = 1e-3
#: Bytes of a word's beginning that count as a feature of its own.
STEMS = (5, 6, 7, 8)
_LETTERS = bytes(c if c >= 0x80 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(raw: bytes) -> list[bytes]:
    """Lower-case runs of letters; bytes of other scripts count as letters."""
    return (raw if raw.isascii() else raw.decode().lower().encode()).translate(_LETTERS).split()


def marks(found: list[bytes]) -> set[bytes]:
    """The different words, and the beginnings of long ones, which compounds and inflected forms share."""
    out = set(found)
    for k in STEMS:
        out.update([b"^" + w[:k] for w in out if len(w) > k and w[:1] != b"^"])
    return out


def abusive_words(found: list[bytes], abusive: set[bytes]) -> int:
    """How many of the words are abusive or begin as abusive ones do."""
    return sum(w in abusive or any(b"^" + w[:k] in abusive for k in STEMS if len(w) > k) for w in found)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 40) -> np.ndarray:
    """Weights of a ridge logistic model by Newton steps, the last one the constant's."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge * max(1, len(x)))
    keep[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + keep * w
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(keep), g)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def hints(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether texts have an abusive word, two of them, and one in SHORT words or fewer."""
    return np.stack([counts > 0, counts > 1, (counts > 0) & (sizes <= SHORT)], axis=1).astype(float)


class Chain:
    """The words that count, the abusive ones and a weight vector for each category."""

    def __init__(self, terms: list[bytes], abusive: set[bytes], weights: list[np.ndarray]):
        self.terms, self.abusive, self.weights = {t: k for k, t in enumerate(terms)}, abusive, weights

    def features(self, raws: list[bytes]) -> np.ndarray:
        """Presence of each term, and what hints() tells."""
        x = np.zeros((len(raws), len(self.terms)))
        counts, sizes = np.zeros(len(raws), np.int64), np.zeros(len(raws), np.int64)
        for i, raw in enumerate(raws):
            found = words(raw)
            for t in self.terms.keys() & marks(found):
                x[i, self.terms[t]] = 1
            counts[i], sizes[i] = abusive_words(found, self.abusive), len(found)
        return np.hstack([x, hints(counts, sizes)])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        for w in self.weights:
            x = np.hstack([x, predict(x, w)[:, None]])
        return x[:, x.shape[1] - len(self.weights) :]


def targets(y: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The rows of each category."""
    return [y * (counts >= REPEATED), y * (counts >= SEVERE * np.maximum(1, sizes)) * (counts > 0), y]


def sample(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, text, y, fold) of the bounded training sample, a row an id."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    least = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    least = least.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int"))
    met = common.texts(docs).join(F.broadcast(least), "doc_id")  # bounded by max_train rows of three numbers
    return met.groupBy("doc_id", "y", "fold").agg(F.min("text").alias("text"))


def chosen(found: list[tuple[bytes, int, int]], total: tuple[int, int]) -> tuple[list[bytes], set[bytes]]:
    """The terms and the abusive words among (word, toxic rows, other rows) of a part of the sample, best first."""
    # a word is abusive if far more of its rows are toxic than chance among that many words would give
    rate = total[1] / max(1, sum(total))
    abusive = {w for w, n1, n0 in found if n1 / (n1 + n0) >= max(0.8, 4 * rate) and n1 >= max(LEAST_ROWS, 0.02 * total[1])}
    terms = [w for w, *_ in found[:TERMS]]
    return terms + sorted(abusive - set(terms)), abusive


def chain_weights(has: np.ndarray, columns: list[list[int]], counts: np.ndarray, sizes: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The weights for each category and the rows' out-of-fold probabilities.

    has: which words the rows have; columns and counts: for each fold left out, and last for none, the words of the models
    and the rows' abusive words.
    """
    p, weights = np.zeros((len(y), 0)), []
    for category in range(len(CATEGORIES)):
        mine = np.zeros(len(y))
        for f in range(FOLDS):
            out = fold == f
            if out.any() and not out.all():
                x = np.hstack([has[:, columns[f]], hints(counts[:, f], sizes), p])
                mine[out] = predict(x[out], fit_logistic(x[~out], targets(y, counts[:, f], sizes)[category][~out]))
        weights.append(fit_logistic(np.hstack([has[:, columns[FOLDS]], hints(counts[:, FOLDS], sizes), p]), targets(y, counts[:, FOLDS], sizes)[category]))
        p = np.hstack([p, mine[:, None]])
    return weights, p


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Chain | None:
    """The chain, or None if there is nothing to learn from."""
    with common.stored(sample(docs, labels, max_train)) as rows:
        total = np.zeros((FOLDS, 2), np.int64)
        for r in rows.groupBy("fold", "y").count().collect():
            total[r["fold"], r["y"]] = r["count"]
        if not total.sum(axis=0).all():
            return None
        word_schema = pa.schema([("word", pa.binary()), ("fold", pa.int32()), ("n1", pa.int64()), ("n0", pa.int64())])

        def presence(b: pa.RecordBatch) -> pa.RecordBatch:
            seen: dict[tuple[bytes, int], list[int]] = {}
            for raw, y, fold in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("y").to_pylist(), b.column("fold").to_pylist()):
                for w in marks(words(raw)):
                    seen.setdefault((w, fold), [0, 0])[1 - y] += 1
            return common.batch(word_schema, [k[0] for k in seen], [k[1] for k in seen], [v[0] for v in seen.values()], [v[1] for v in seen.values()])

        by_fold = common.arrow_map(rows, presence, "word binary, fold int, n1 long, n0 long")
        sums = [F.sum(F.when(F.col("fold") != f, F.col(c)).otherwise(0)).alias(f"{c}_{f}") for f in range(FOLDS + 1) for c in ("n1", "n0")]  # no row is of the last fold
        with common.stored(by_fold.groupBy("word").agg(*sums).where(F.col(f"n1_{FOLDS}") >= LEAST_ROWS)) as by_word:
            parts = []
            for f in range(FOLDS + 1):
                n0, n1 = (int(t) for t in total.sum(axis=0) - (total[f] if f < FOLDS else 0))
                score = (F.log((F.col(f"n1_{f}") + 0.1) / max(1, n1)) - F.log((F.col(f"n0_{f}") + 0.5) / max(1, n0))) * F.sqrt(f"n1_{f}")
                some = by_word.where(F.col(f"n1_{f}") >= LEAST_ROWS).withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "word").limit(MAX_WORDS)
                parts.append(some.select(F.lit(f).alias("f"), "word", F.col(f"n1_{f}").alias("n1"), F.col(f"n0_{f}").alias("n0"), "score"))
            every = parts[0]
            for part in parts[1:]:
                every = every.union(part)
            found = sorted(every.collect(), key=lambda r: (-r["score"], bytes(r["word"])))  # (FOLDS + 1) MAX_WORDS at most
        models = [chosen([(bytes(r["word"]), r["n1"], r["n0"]) for r in found if r["f"] == f], tuple(total.sum(axis=0) - (total[f] if f < FOLDS else 0))) for f in range(FOLDS + 1)]
        index = {t: k for k, t in enumerate(sorted(set().union(*(terms for terms, _ in models))))}
        lexicons = [abusive for _, abusive in models]
        any_of = set().union(*lexicons)
        schema = pa.schema([("fold", pa.int64()), ("y", pa.int64()), ("n", pa.list_(pa.int64())), ("size", pa.int64()), ("has", pa.list_(pa.int64()))])

        def which(b: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for raw, y, fold in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("y").to_pylist(), b.column("fold").to_pylist()):
                w = words(raw)
                hits = [x for x in w if abusive_words([x], any_of)]
                out.append((fold, y, [abusive_words(hits, lexicon) for lexicon in lexicons], len(w), sorted(index[t] for t in index.keys() & marks(w))))
            return common.batch(schema, *map(list, zip(*out)))

        got = common.arrow_map(rows, which, "fold long, y long, n array<long>, size long, has array<long>").toPandas()  # at most max_train rows of word numbers
    has = np.zeros((len(got), len(index)))
    for i, h in enumerate(got["has"]):
        has[i, np.asarray(h, np.int64)] = 1
    counts = np.array(got["n"].tolist(), np.int64).reshape(len(got), FOLDS + 1)
    weights, _ = chain_weights(has, [[index[t] for t in terms] for terms, _ in models], counts, got["size"].to_numpy(), got["y"].to_numpy().astype(float), got["fold"].to_numpy())
    return Chain(*models[FOLDS], weights)


def score(docs: DataFrame, chain: Chain | None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_repeated, p_severe, p_toxic, toxic): probabilities of the chain and the verdict."""
    names = [f"p_{c}" for c in CATEGORIES]
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.float64()) for n in names), ("toxic", pa.bool_())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        p = np.zeros((b.num_rows, len(names)))
        if chain is not None:
            raws = b.column("text").cast(pa.binary()).to_pylist()
            full = np.array([bool(r) for r in raws])
            p = chain.probabilities(chain.features(raws)) * full[:, None]
        return common.batch(schema, b.column("doc_id"), *(pa.array(p[:, k]) for k in range(len(names))), pa.array(p[:, -1] >= threshold))

    return common.arrow_map(common.texts(docs, id_col, text_col), run, "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return score(docs, train(docs, labels), threshold)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that aren't toxic, with all their columns."""
    chain = train(docs, labels)
    verdict = F.pandas_udf(_verdict(chain, threshold), "boolean")
    return docs.where(~verdict(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def _verdict(chain: Chain | None, threshold: float):
    def toxic(text: pd.Series) -> pd.Series:
        common.settle(f"{__name__}.toxic")
        if chain is None:
            return pd.Series(np.zeros(len(text), bool))
        out = np.zeros(len(text), bool)
        for a in range(0, len(text), 1000):
            raws = [t.encode() for t in text.iloc[a : a + 1000]]
            out[a : a + 1000] = (chain.probabilities(chain.features(raws))[:, -1] >= threshold) & np.array([bool(r) for r in raws])
        return pd.Series(out)

    return toxic
