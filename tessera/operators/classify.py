"""Pixel classification: feature rows, scaling, and classifiers over cubes or feature tables.

Feature rows are wide: one double column for each feature, so that scaling, Gaussian
naive Bayes and nearest centroids are aggregations and arithmetic. Labels of 0 or less, or
null, mean unlabelled; rows with a missing feature are neither learnt nor predicted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cube import Cube

BLOCK_ROWS = 4096


def labelled(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    return df.where(F.col(label).isNotNull() & (F.col(label) > 0)).dropna(subset=list(features))


def make_xy(cube: Cube, labels: DataFrame, on: Sequence[str], feature_dims: Sequence[str] = (), label: str = "label") -> tuple[DataFrame, list[str]]:
    """A row for each cell of the data dims with a column for each (feature dims, variable), and its label."""
    keep = [d for d in cube.dims if d not in feature_dims]
    if not feature_dims:
        return cube.df.join(labels, list(on), "left"), list(cube.variables)
    combos: list[tuple[int, ...]] = [()]
    for d in feature_dims:
        combos = [(*c, k) for c in combos for k in range(cube.dims[d])]
    def at(c: tuple[int, ...]) -> Column:
        out = F.lit(True)
        for d, k in zip(feature_dims, c):
            out = out & (F.col(d) == k)
        return out

    names = {f"{v}_{'_'.join(map(str, c))}": (c, v) for c in combos for v in cube.variables}
    wide = cube.df.groupBy(*keep).agg(*[F.max(F.when(at(c), F.col(v))).alias(n) for n, (c, v) in names.items()])
    return wide.join(labels, list(on), "left"), list(names)


def scaler(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature, one aggregation."""
    row = df.agg(*[F.avg(f).alias(f"{f}__m") for f in features], *[F.stddev_pop(f).alias(f"{f}__s") for f in features]).first()
    return {f: (row[f"{f}__m"], row[f"{f}__s"] or 1.0) for f in features}


def scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f: (F.col(f) - m) / s for f, (m, s) in fitted.items()})


class GaussianNB:
    """Gaussian naive Bayes; variances get 1e-9 of the largest added."""

    def __init__(self, smoothing: float = 1e-9):
        self.smoothing = smoothing

    def fit(self, df: DataFrame, features: Sequence[str], label: str = "label") -> GaussianNB:
        self.features = list(features)
        rows = labelled(df, features, label).groupBy(label).agg(F.count("*").alias("n"), *[F.avg(f).alias(f"{f}__m") for f in features], *[F.var_pop(f).alias(f"{f}__v") for f in features]).orderBy(label).collect()  # one row for each class
        top = labelled(df, features, label).agg(*[F.var_pop(f).alias(f) for f in features]).first()
        add = self.smoothing * max(top)
        total = sum(r["n"] for r in rows)
        self.classes = [(r[label], math.log(r["n"] / total), [(r[f"{f}__m"], r[f"{f}__v"] + add) for f in features]) for r in rows]
        return self

    def scores(self) -> list[Column]:
        out = []
        for _, prior, stats in self.classes:
            s = F.lit(prior - 0.5 * sum(math.log(2 * math.pi * v) for _, v in stats))
            for f, (m, v) in zip(self.features, stats):
                s = s - (F.col(f) - m) * (F.col(f) - m) / (2 * v)
            out.append(s)
        return out

    def predict(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        best = F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(-c[0]).alias("c")) for s, c in zip(self.scores(), self.classes)]))
        return df.withColumn("__s", best).withColumn(name, -F.col("__s.c")).drop("__s")

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """A p_<class> column for each class."""
        out = df.withColumn("__s", F.array(*self.scores()))
        out = out.withColumn("__m", F.array_max("__s"))
        total = F.aggregate("__s", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("__m")))
        return out.withColumns({f"p_{c[0]}": F.exp(F.col("__s")[k] - F.col("__m")) / total for k, c in enumerate(self.classes)}).drop("__s", "__m")


class NearestCentroid:
    def fit(self, df: DataFrame, features: Sequence[str], label: str = "label") -> NearestCentroid:
        self.features = list(features)
        rows = labelled(df, features, label).groupBy(label).agg(*[F.avg(f).alias(f) for f in features]).orderBy(label).collect()
        self.classes = [(r[label], [r[f] for f in features]) for r in rows]
        return self

    def predict(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        def distance(m: list[float]) -> Column:
            return sum(((F.col(f) - x) * (F.col(f) - x) for f, x in zip(self.features, m)), F.lit(0.0))

        best = F.array_min(F.array(*[F.struct(distance(m).alias("d"), F.lit(c).alias("c")) for c, m in self.classes]))
        return df.withColumn(name, best["c"])


class KNeighbors:
    """The majority of the k nearest labelled rows; ties go to the lower label.

    Labelled rows and queries fall into blocks of about BLOCK_ROWS; a block of either meets one of
    the other in one call, in vectorised steps, and gives the k nearest, which are then merged by query.
    """

    def __init__(self, k: int = 5):
        self.k = k

    def fit(self, df: DataFrame, features: Sequence[str], label: str = "label", key: str = "vec_id") -> KNeighbors:
        self.features = list(features)
        self.rows = labelled(df, features, label).select(F.col(key).alias("__id"), F.col(label).cast("long").alias("__label"), *features)
        return self

    def predict(self, df: DataFrame, key: str, name: str = "predicted") -> DataFrame:
        # a block of labelled rows meets a block of queries: either is held whole, however many rows there are
        blocks, parts = (max(1, -(-n // BLOCK_ROWS)) for n in (self.rows.count(), df.count()))

        def deal(rows: DataFrame, key: str, block: str, n: int, other: str, others: int) -> DataFrame:
            return rows.withColumn(block, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

        train = deal(self.rows, "__id", "__block", blocks, "__part", parts)
        asked = deal(df.dropna(subset=self.features).select(F.col(key).alias("__key"), *self.features), "__key", "__part", parts, "__block", blocks)
        k, features = self.k, self.features

        def nearest(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if not len(queries) or not len(rows):
                return pd.DataFrame({"__key": pd.Series(dtype="int64"), "d": pd.Series(dtype=float), "id": pd.Series(dtype="int64"), "label": pd.Series(dtype="int64")})
            b, out = rows[features].to_numpy(float), []
            for at in range(0, len(queries), 512):
                a = queries[features].iloc[at : at + 512].to_numpy(float)
                d = ((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :]).clip(0)
                take = np.argpartition(d, min(k, len(b)) - 1, 1)[:, : min(k, len(b))]
                q = np.repeat(queries["__key"].iloc[at : at + 512].to_numpy(), take.shape[1])
                out.append(pd.DataFrame({"__key": q, "d": np.take_along_axis(d, take, 1).ravel(), "id": rows["__id"].to_numpy()[take.ravel()], "label": rows["__label"].to_numpy()[take.ravel()]}))
            return pd.concat(out)

        found = asked.groupBy("__block", "__part").cogroup(train.groupBy("__block", "__part")).applyInPandas(nearest, "__key long, d double, id long, label long")
        best = found.groupBy("__key").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "id", "label"))), 1, k).alias("near"))  # k * blocks rows for each query
        votes = best.select("__key", F.explode("near.label").alias("label")).groupBy("__key", "label").count()
        top = votes.groupBy("__key").agg(F.max_by("label", F.struct("count", -F.col("label"))).alias(name))
        return df.join(top.withColumnRenamed("__key", key), key, "left")


class Estimator:
    """Any pyspark.ml estimator behind the same interface."""

    def __init__(self, estimator: Any):
        self.estimator = estimator

    def _vectors(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=self.features, outputCol="__features").transform(df.dropna(subset=self.features))

    def fit(self, df: DataFrame, features: Sequence[str], label: str | None = "label") -> Estimator:
        self.features = list(features)
        rows = labelled(df, features, label) if label else df
        set_to = {"featuresCol": "__features"} | ({"labelCol": label} if label else {})
        self.model = self.estimator.copy({self.estimator.getParam(k): v for k, v in set_to.items()}).fit(self._vectors(rows))
        return self

    def predict(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        out = self.model.transform(self._vectors(df))
        return out.withColumn(name, F.col("prediction").cast("int")).drop("__features", "rawPrediction", "probability", "prediction")


class Classifier:
    """Learns from and predicts cubes: Classifier(GaussianNB(), scale=True).fit(cube, labels, on).predict(cube)."""

    def __init__(self, model: Any, feature_dims: Sequence[str] = (), scale: bool = False):
        self.model, self.feature_dims, self.scaled = model, tuple(feature_dims), scale

    def fit(self, cube: Cube, labels: DataFrame, on: Sequence[str], label: str = "label") -> Classifier:
        rows, self.features = make_xy(cube, labels, on, self.feature_dims, label)
        self.label, self.fitted = label, None
        if self.scaled:
            self.fitted = scaler(labelled(rows, self.features, label), self.features)
            rows = scale(rows, self.fitted)
        self.model.fit(rows, self.features, label)
        return self

    def _rows(self, cube: Cube) -> DataFrame:
        keep = [d for d in cube.dims if d not in self.feature_dims]
        blank = cube.spark.createDataFrame([], ", ".join(f"{d} int" for d in keep) + f", {self.label} int")
        rows, _ = make_xy(cube, blank, keep, self.feature_dims, self.label)
        rows = rows.drop(self.label).dropna(subset=self.features)
        return scale(rows, self.fitted) if self.fitted else rows

    def predict(self, cube: Cube, func: str = "predict") -> DataFrame:
        if not hasattr(self.model, func):
            raise AttributeError(f"the model has no {func}")
        keep = [d for d in cube.dims if d not in self.feature_dims]
        out = getattr(self.model, func)(self._rows(cube))
        return out.select(*keep, *[c for c in out.columns if c == "predicted" or c.startswith("p_")])

    def fit_predict(self, cube: Cube, labels: DataFrame, on: Sequence[str], label: str = "label") -> DataFrame:
        return self.fit(cube, labels, on, label).predict(cube)

    def score(self, cube: Cube, labels: DataFrame, on: Sequence[str], metric: str = "accuracy") -> float:
        return score(self.predict(cube).join(labels, list(on)), self.label, "predicted", metric)


def score(df: DataFrame, label: str = "label", predicted: str = "predicted", metric: str = "accuracy") -> float:
    """accuracy, f1_macro, precision_macro or recall_macro over the labelled rows."""
    rows = df.where(F.col(label).isNotNull() & (F.col(label) > 0) & F.col(predicted).isNotNull())
    if metric == "accuracy":
        return rows.agg(F.avg((F.col(label) == F.col(predicted)).cast("double"))).first()[0]
    if metric not in ("f1_macro", "precision_macro", "recall_macro"):
        raise ValueError(f"no such metric: {metric}")
    pairs = rows.groupBy(label, predicted).count().collect()  # at most classes squared
    names = sorted({r[0] for r in pairs} | {r[1] for r in pairs})
    out = []
    for c in names:
        hit = sum(r["count"] for r in pairs if r[0] == c == r[1])
        said, true = sum(r["count"] for r in pairs if r[1] == c), sum(r["count"] for r in pairs if r[0] == c)
        p, q = hit / said if said else 0.0, hit / true if true else 0.0
        out.append({"precision_macro": p, "recall_macro": q, "f1_macro": 2 * p * q / (p + q) if p + q else 0.0}[metric])
    return sum(out) / len(out)
