"""Common grids of several cubes, class means, factorisation and common attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cube import Cube


def common_bounds(cubes: Sequence[Cube]) -> tuple[float, float, float, float]:
    b = [c.bounds for c in cubes]
    return min(x[0] for x in b), min(x[1] for x in b), max(x[2] for x in b), max(x[3] for x in b)


def common_resolution(cubes: Sequence[Cube], mode: str = "min") -> tuple[float, float]:
    if mode not in ("min", "max", "mean"):
        raise ValueError(f"{mode} is none of min, max, mean")
    if len({c.attrs.get("crs") for c in cubes}) > 1:
        raise ValueError("the cubes have different reference systems")
    fn = {"min": min, "max": max, "mean": lambda x: sum(x) / len(x)}[mode]
    r = [c.resolution for c in cubes]
    return fn([x[0] for x in r]), fn([x[1] for x in r])


def grid_summary(df: DataFrame, by: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Bounds, resolution and transform of regular grids of coordinates, one for each group."""
    def resolution(c: str) -> Column:
        return F.try_divide(F.max(c) - F.min(c), F.count_distinct(c) - 1)

    return df.groupBy(*by).agg(F.min(x).alias("left"), F.min(y).alias("bottom"), F.max(x).alias("right"), F.max(y).alias("top"), resolution(x).alias("xres"), resolution(y).alias("yres"))


def class_mean(cube: Cube, label: str) -> Cube:
    """Each variable replaced by its mean over the cells of the same label; no label, no value."""
    names = [v for v in cube.variables if v != label]
    means = cube.df.groupBy(label).agg(*[F.avg(v).alias(f"__{v}") for v in names])  # one row for each class
    joined = cube.df.join(means, label, "left")
    return cube.with_df(joined.select(*cube.dims, label, *[F.when(F.col(v).isNotNull(), F.col(f"__{v}")).alias(v) for v in names]), [label, *names])


def factorize(df: DataFrame, column: str, order: str, name: str = "code", start: int = 1) -> tuple[DataFrame, DataFrame]:
    """Codes by first appearance in the given order, and the legend (code, value)."""
    first = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("__first"))  # one row for each category
    legend = first.withColumn(name, F.row_number().over(Window.orderBy("__first", column)) + (start - 1)).select(name, column)
    coded = df.join(legend, column, "left").withColumn(name, F.coalesce(name, F.lit(start - 1)))
    return coded, legend


def common_attributes(attrs: DataFrame, source: str, key: str = "key", value: str = "value") -> DataFrame:
    """The (key, value) pairs that every source has."""
    total = attrs.select(source).distinct().count()
    same = attrs.groupBy(key).agg(F.count_distinct(source).alias("n"), F.count_distinct(value).alias("kinds"), F.min(value).alias(value))
    return same.where((F.col("n") == total) & (F.col("kinds") == 1)).select(key, value)


def collapse_dims(cube: Cube, variable: str, tolerance: float = 1e-8) -> list[str]:
    """The dims along which a variable doesn't change."""
    out = []
    for d in cube.dims:
        others = [x for x in cube.dims if x != d]
        spread = cube.df.groupBy(*others).agg((F.max(variable) - F.min(variable)).alias("s")).agg(F.max("s")).first()[0]
        if spread is None or spread <= tolerance:
            out.append(d)
    return out
