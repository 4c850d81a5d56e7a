"""The cube: a DataFrame with a row per cell, integer index columns and a column per variable."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REDUCERS: dict[str, Callable[[Column], Column]] = {"mean": F.avg, "std": F.stddev_pop, "var": F.var_pop, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "median": F.median}


@dataclass(frozen=True)
class Cube:
    """A handle on a lazily planned cube.

    dims: sizes by name, in order; each is an integer column of df. coords: (first, step)
    of dims on a regular grid. attrs: free metadata (crs, transform, legend...). A cell that
    is missing has no row or a null; NaN becomes null on entry.
    """

    df: DataFrame
    dims: dict[str, int]
    variables: tuple[str, ...]
    coords: dict[str, tuple[float, float]] = field(default_factory=dict)
    attrs: dict[str, Any] = field(default_factory=dict)

    # -- making and shaping --------------------------------------------------------------

    @classmethod
    def of(cls, df: DataFrame, dims: dict[str, int], variables: Sequence[str] | None = None, **more: Any) -> Cube:
        names = tuple(variables or [c for c in df.columns if c not in dims])
        kinds = dict(df.dtypes)
        clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in names]
        return cls(df.select(*[F.col(d).cast("int").alias(d) for d in dims], *clean), dict(dims), names, **more)

    @classmethod
    def measured(cls, df: DataFrame, dims: Sequence[str], variables: Sequence[str] | None = None, **more: Any) -> Cube:
        """Sizes are taken from the data, in one aggregation."""
        top = df.agg(*[F.max(d).alias(d) for d in dims]).first()
        return cls.of(df, {d: int(top[d]) + 1 if top[d] is not None else 0 for d in dims}, variables, **more)

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(self.dims.values())

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def with_df(self, df: DataFrame, variables: Sequence[str] | None = None, dims: dict[str, int] | None = None) -> Cube:
        dims = self.dims if dims is None else dims
        return replace(self, df=df, dims=dims, variables=tuple(self.variables if variables is None else variables), coords={d: c for d, c in self.coords.items() if d in dims})

    def select(self, *names: str) -> Cube:
        return self.with_df(self.df.select(*self.dims, *names), names)

    def assign(self, **columns: Column) -> Cube:
        return self.with_df(self.df.withColumns(columns), tuple(dict.fromkeys([*self.variables, *columns])))

    def where(self, condition: Column) -> Cube:
        """Cells where the condition fails become missing."""
        return self.with_df(self.df.select(*self.dims, *[F.when(condition, F.col(v)).alias(v) for v in self.variables]))

    def fillna(self, value: float) -> Cube:
        return self.with_df(self.df.fillna(value, subset=list(self.variables)))

    def isel(self, **ranges: int | slice) -> Cube:
        """Cells in index ranges; an integer drops the dim, a slice starts it from 0 again."""
        df, dims, coords = self.df, dict(self.dims), dict(self.coords)
        for d, r in ranges.items():
            if isinstance(r, slice):
                a, b, step = r.indices(self.dims[d])
                if step < 1:
                    raise ValueError("a slice must go upwards")
                df = df.where((F.col(d) >= a) & (F.col(d) < b) & ((F.col(d) - a) % step == 0)).withColumn(d, ((F.col(d) - a) / step).cast("int"))
                dims[d] = len(range(a, b, step))
                if d in coords:
                    coords[d] = (coords[d][0] + a * coords[d][1], coords[d][1] * step)
            else:
                k = r + self.dims[d] if r < 0 else r
                if not 0 <= k < self.dims[d]:
                    raise IndexError(f"{d}={r} is outside of 0..{self.dims[d] - 1}")
                df = df.where(F.col(d) == k).drop(d)
                del dims[d]
        return replace(self.with_df(df, dims=dims), coords={d: c for d, c in coords.items() if d in dims})

    def sel(self, **ranges: float | slice) -> Cube:
        """isel by coordinate: the nearest for a number, those within for a slice of two ends."""
        out: dict[str, int | slice] = {}
        for d, r in ranges.items():
            first, step = self.coords[d]
            if isinstance(r, slice):
                ends = sorted((r.start - first) / step if e == 0 else (r.stop - first) / step for e in (0, 1))
                out[d] = slice(max(0, int(-(-ends[0] // 1))), min(self.dims[d], int(ends[1] // 1) + 1))
            else:
                out[d] = min(max(round((r - first) / step), 0), self.dims[d] - 1)
        return self.isel(**out)

    def grid(self) -> DataFrame:
        """A row for each cell of the dims, made by one range and arithmetic, without a join."""
        total = 1
        for n in self.dims.values():
            total *= n
        left, columns = F.col("id"), {}
        for d, n in reversed(self.dims.items()):
            columns[d] = (left % max(n, 1)).cast("int")
            left = F.floor(left / max(n, 1))
        return self.spark.range(total).select(*[columns[d].alias(d) for d in self.dims])

    def densify(self, fill: float | None = None) -> Cube:
        """All cells of the dims; those that were missing are null or `fill`."""
        out = self.with_df(self.grid().join(self.df, list(self.dims), "left"))
        return out if fill is None else out.fillna(fill)

    def coordinate(self, dim: str) -> Column:
        first, step = self.coords[dim]
        return F.lit(first) + F.col(dim) * F.lit(step)

    # -- reducing and pivoting -----------------------------------------------------------

    def reduce(self, how: str | Callable[[Column], Column], *dims: str) -> Cube:
        """Aggregates all variables over the dims (all of them if none is given); missing cells don't count."""
        fn = REDUCERS[how] if isinstance(how, str) else how
        keep = {d: n for d, n in self.dims.items() if dims and d not in dims}
        df = self.df.groupBy(*keep).agg(*[fn(F.col(v)).alias(v) for v in self.variables])
        return self.with_df(df, dims=keep)

    def argmax(self, variable: str, dim: str) -> Cube:
        """The first index of the greatest value."""
        keep = {d: n for d, n in self.dims.items() if d != dim}
        best = F.max_by(F.when(F.col(variable).isNotNull(), F.col(dim)), F.struct(F.col(variable), -F.col(dim)))
        return self.with_df(self.df.where(F.col(variable).isNotNull()).groupBy(*keep).agg(best.alias(dim)), (dim,), keep)

    def to_long(self, name: str = "variable", value: str = "value") -> DataFrame:
        """Variables become an axis."""
        return self.df.unpivot(list(self.dims), list(self.variables), name, value)

    def expand_variables(self, dim: str, value: str, names: Sequence[Any]) -> Cube:
        """An axis becomes variables."""
        keep = {d: n for d, n in self.dims.items() if d != dim}
        df = self.df.groupBy(*keep).pivot(dim, list(names)).agg(F.first(value))
        return self.with_df(df, [str(n) for n in names], keep)

    # -- complex values --------------------------------------------------------------------

    def split_complex(self) -> Cube:
        """Struct variables (re, im) become v__re and v__im."""
        kinds = dict(self.df.dtypes)
        columns, names = [], []
        for v in self.variables:
            if kinds[v].startswith("struct<re:"):
                columns += [F.col(f"{v}.re").alias(f"{v}__re"), F.col(f"{v}.im").alias(f"{v}__im")]
                names += [f"{v}__re", f"{v}__im"]
            else:
                columns.append(F.col(v))
                names.append(v)
        return self.with_df(self.df.select(*self.dims, *columns), names)

    def join_complex(self) -> Cube:
        """v__re and v__im (or v_real and v_imag) become a struct variable, where both are there."""
        columns, names, left = [], [], set(self.variables)
        for v in self.variables:
            for a, b in (("__re", "__im"), ("_real", "_imag")):
                stem = v.removesuffix(a)
                if stem != v and stem + b in left:
                    columns.append(F.struct(F.col(v).alias("re"), F.col(stem + b).alias("im")).alias(stem))
                    names.append(stem)
                    left -= {v, stem + b}
        columns += [F.col(v) for v in self.variables if v in left]
        return self.with_df(self.df.select(*self.dims, *columns), [*names, *[v for v in self.variables if v in left]])

    @property
    def is_complex(self) -> bool:
        kinds = dict(self.df.dtypes)
        return any(kinds[v].startswith("struct<re:") for v in self.variables)

    # -- the grid --------------------------------------------------------------------------

    @property
    def crs(self):
        """The reference system by the attributes crs or coordinate_system_string; None if there is neither."""
        from .functions import projection

        name = self.attrs.get("crs", self.attrs.get("coordinate_system_string"))
        return None if name is None else projection.parse(name)

    @property
    def _given_transform(self) -> tuple[float, ...] | None:
        """The transform of the metadata: (a, b, c, d, e, f), or i2m as text (a, d, b, e, c, f)."""
        if "transform" in self.attrs:
            return tuple(map(float, self.attrs["transform"][:6]))
        if "i2m" in self.attrs:
            a, d, b, e, c, f = map(float, str(self.attrs["i2m"]).split(","))
            return a, b, c, d, e, f
        return None

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """left, bottom, right, top of the cell coordinates; failing these of the corners by the metadata's transform, or its bounds."""
        if "x" in self.coords and "y" in self.coords:
            ends = {d: sorted((c[0], c[0] + (self.dims[d] - 1) * c[1])) for d, c in self.coords.items()}
            return ends["x"][0], ends["y"][0], ends["x"][1], ends["y"][1]
        t = self._given_transform
        if t is not None:
            corners = [(t[0] * x + t[1] * y + t[2], t[3] * x + t[4] * y + t[5]) for x in (0, self.dims["x"] - 1) for y in (0, self.dims["y"] - 1)]
            return min(c[0] for c in corners), min(c[1] for c in corners), max(c[0] for c in corners), max(c[1] for c in corners)
        if "bounds" in self.attrs:
            return tuple(self.attrs["bounds"])
        raise ValueError("neither coordinates nor metadata tell the bounds")

    @property
    def resolution(self) -> tuple[float, float]:
        if "x" in self.coords and "y" in self.coords:
            return abs(self.coords["x"][1]), abs(self.coords["y"][1])
        t = self._given_transform
        if t is not None:
            return abs(t[0]), abs(t[4])
        if "res" in self.attrs:
            return tuple(self.attrs["res"])
        raise ValueError("neither coordinates nor metadata tell the resolution")

    @property
    def transform(self) -> tuple[float, ...]:
        """(a, b, c, d, e, f): x = a col + b row + c, y = d col + e row + f; the offset is the first coordinate."""
        if "x" in self.coords and "y" in self.coords:
            return self.coords["x"][1], 0.0, self.coords["x"][0], 0.0, self.coords["y"][1], self.coords["y"][0]
        t = self._given_transform
        if t is None:
            raise ValueError("neither coordinates nor metadata tell the transform")
        return t

    # -- storage ---------------------------------------------------------------------------

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """Parquet, complex split, with the handle beside it as one row of JSON."""
        flat = self.split_complex()
        flat.df.write.mode(mode).option("compression", "zstd").parquet(f"{path}/cells")
        meta = json.dumps({"dims": self.dims, "variables": flat.variables, "coords": self.coords, "attrs": self.attrs, "complex": self.is_complex})
        self.spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode(mode).text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Cube:
        meta = json.loads("".join(r[0] for r in spark.read.text(f"{path}/meta").collect()))
        out = cls(spark.read.parquet(f"{path}/cells"), meta["dims"], tuple(meta["variables"]), {k: tuple(v) for k, v in meta["coords"].items()}, meta["attrs"])
        return out.join_complex() if meta["complex"] else out

    # -- operators as methods ----------------------------------------------------------------

    @property
    def filter(self) -> Filters:
        return Filters(self)

    def change_omnibus(self, **kw: Any) -> Cube:
        from .operators import change

        return change.omnibus(self, **kw)

    def resample(self, **kw: Any) -> Cube:
        from .operators import warp

        return warp.resample(self, **kw)

    def reproject(self, **kw: Any) -> Cube:
        from .operators import warp

        return warp.reproject(self, **kw)

    def to_rgb(self, **kw: Any) -> DataFrame:
        from .operators import visual

        return visual.rgb(self, **kw)

    def apply(self, fn: Callable, signature: str = "()->()") -> Cube:
        from .operators import apply

        return apply.apply(self, fn, signature)


class Filters:
    """cube.filter.boxcar(...) and so on."""

    def __init__(self, cube: Cube):
        self.cube = cube

    def convolve(self, *a: Any, **kw: Any) -> Cube:
        from .operators import stencil

        return stencil.convolution(self.cube, *a, **kw)

    def boxcar(self, *a: Any, **kw: Any) -> Cube:
        from .operators import stencil

        return stencil.boxcar(self.cube, *a, **kw)

    def gaussian(self, *a: Any, **kw: Any) -> Cube:
        from .operators import stencil

        return stencil.gaussian(self.cube, *a, **kw)

    def nlmeans(self, *a: Any, **kw: Any) -> Cube:
        from .operators import nlmeans

        return nlmeans.nlmeans(self.cube, *a, **kw)
