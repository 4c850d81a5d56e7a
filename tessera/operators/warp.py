"""Resampling, reprojection, alignment and co-registration.

Coordinates are those of cell indices, while the same transform gives cell corners to the
sampler: the value at target index i is that at source position
((x0d + (i + 0.5) rd) - x0s) / rs - 0.5. Target cells are a range, each finds its taps (one
or four source indices) by arithmetic and meets them in an equi-join; missing taps are
left out and the other weights scaled up.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cube import Cube
from ..functions import projection
from . import reduce

INTS = ("int", "bigint", "smallint", "tinyint")


def target_grid(width: int | None, height: int | None, res, extent) -> tuple[int, int, float, float]:
    """Width, height and steps of a grid that covers the extent."""
    left, bottom, right, top = extent
    if res is not None:
        xr, yr = (res, res) if isinstance(res, (int, float)) else res
        return int(abs(right - left) / xr) + 1, int(abs(top - bottom) / yr) + 1, xr, yr
    if width is None and height is None:
        raise ValueError("a resolution, width or height is needed")
    if width is None:
        width = max(1, round(height * abs(right - left) / abs(top - bottom)))
    if height is None:
        height = max(1, round(width * abs(top - bottom) / abs(right - left)))
    return width, height, abs(right - left) / max(width - 1, 1), abs(top - bottom) / max(height - 1, 1)


def _taps(col: Column, row: Column, method: str) -> Column:
    if method == "nearest":
        return F.array(F.struct(F.floor(col + 0.5).cast("int").alias("x"), F.floor(row + 0.5).cast("int").alias("y"), F.lit(1.0).alias("w")))
    if method != "bilinear":
        raise ValueError(f"{method} is neither nearest nor bilinear")
    x0, y0 = F.floor(col), F.floor(row)
    dx, dy = col - x0, row - y0
    return F.array(*[F.struct((x0 + a).cast("int").alias("x"), (y0 + b).cast("int").alias("y"), ((dx if a else 1 - dx) * (dy if b else 1 - dy)).alias("w")) for b in (0, 1) for a in (0, 1)])


def sample(cube: Cube, coords: dict[str, tuple[float, float]], width: int, height: int, method: str | None, source: projection.CRS, target: projection.CRS) -> Cube:
    """The cube at the cells of another grid; variables of integers are sampled by the nearest cell and come back as floats."""
    kinds = dict(cube.df.dtypes)
    extras = [d for d in cube.dims if d not in ("x", "y")]
    (xs, xr), (ys, yr), (xd, xq), (yd, yq) = cube.coords["x"], cube.coords["y"], coords["x"], coords["y"]
    grid = cube.spark.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))
    px, py = projection.convert(target, source, F.lit(xd) + (F.col("x") + 0.5) * F.lit(xq), F.lit(yd) + (F.col("y") + 0.5) * F.lit(yq))
    col, row = (px - xs) / xr - 0.5, (py - ys) / yr - 0.5
    placed = grid.select("x", "y", col.alias("col"), row.alias("row")).where((F.col("col") > -0.5 - 1e-9) & (F.col("col") < cube.dims["x"] - 0.5 + 1e-9) & (F.col("row") > -0.5 - 1e-9) & (F.col("row") < cube.dims["y"] - 0.5 + 1e-9))
    out = None
    ways: dict[str, list[str]] = {}
    for v in cube.variables:
        ways.setdefault(method or ("nearest" if kinds[v] in INTS else "bilinear"), []).append(v)
    for way, names in ways.items():
        taps = placed.select("x", "y", F.explode(_taps(F.col("col"), F.col("row"), way)).alias("t")).where("t.w > 0").select("x", "y", F.col("t.x").alias("sx"), F.col("t.y").alias("sy"), F.col("t.w").alias("w"))
        values = cube.df.select(F.col("x").alias("sx"), F.col("y").alias("sy"), *extras, *names)
        joined = taps.join(values, ["sx", "sy"])
        means = [F.try_divide(F.sum(F.col("w") * F.col(v)), F.sum(F.when(F.col(v).isNotNull(), F.col("w")))).alias(v) for v in names]
        part = joined.groupBy(*extras, "y", "x").agg(*means)
        out = part if out is None else out.join(part, [*extras, "y", "x"], "full")
    dims = {**{d: cube.dims[d] for d in extras}, "y": height, "x": width}
    return Cube(out.select(*dims, *[F.col(v).cast("float").alias(v) if kinds[v] in INTS else F.col(v) for v in cube.variables]), dims, cube.variables, {**{d: c for d, c in cube.coords.items() if d in extras}, **coords}, {**cube.attrs, "lines": height, "samples": width})


def resample(cube: Cube, res=None, width: int | None = None, height: int | None = None, method: str | None = None) -> Cube:
    """The same extent and reference system with other cells."""
    w, h, xr, yr = target_grid(width, height, res, cube.bounds)
    left, bottom, right, top = cube.bounds
    down = cube.coords["y"][1] < 0
    crs = projection.parse(cube.attrs.get("crs", 4326))
    return sample(cube, {"x": (left, xr), "y": (top, -yr) if down else (bottom, yr)}, w, h, method, crs, crs)


def projected_bounds(cube: Cube, target: projection.CRS, steps: int = 21) -> tuple[float, float, float, float]:
    """Bounds in another system, of points along the edges."""
    source = projection.parse(cube.attrs.get("crs", 4326))
    left, bottom, right, top = cube.bounds
    points = [(left + (right - left) * k / (steps - 1), y) for k in range(steps) for y in (bottom, top)]
    points += [(x, bottom + (top - bottom) * k / (steps - 1)) for k in range(steps) for x in (left, right)]
    moved = [projection.convert(source, target, *p) for p in points]
    return min(p[0] for p in moved), min(p[1] for p in moved), max(p[0] for p in moved), max(p[1] for p in moved)


def extent(cube: Cube) -> tuple[float, float, float, float]:
    """Bounds in degrees."""
    return projected_bounds(cube, projection.parse(4326))


def common_extent(cubes: Sequence[Cube]) -> tuple[float, float, float, float]:
    """The bounds in degrees of all cubes together, each in its own system."""
    first = projection.parse(cubes[0].attrs.get("crs", 4326))
    boxes = [projected_bounds(c, first) for c in cubes]
    left, bottom, right, top = (fn(b[k] for b in boxes) for k, fn in enumerate((min, min, max, max)))
    whole = Cube(cubes[0].df, {"y": 2, "x": 2}, (), {"x": (left, right - left), "y": (bottom, top - bottom)}, {"crs": first})
    return projected_bounds(whole, projection.parse(4326))


def geometry(cube: Cube, crs=4326) -> list[tuple[float, float]]:
    """The ring of the corners in another system."""
    source, target = projection.parse(cube.attrs.get("crs", 4326)), projection.parse(crs)
    left, bottom, right, top = cube.bounds
    return [projection.convert(source, target, x, y) for x, y in ((left, bottom), (right, bottom), (right, top), (left, top), (left, bottom))]


def reproject(cube: Cube, dst_crs=None, crs=None, target: Cube | None = None, res=None, width: int | None = None, height: int | None = None, extent=None, transform=None, method: str | None = None) -> Cube:
    """The cube on a grid of another reference system.

    The grid comes from a target cube, a transform with width and height, an extent with a
    resolution or a shape; failing these it covers the projected bounds with cells whose
    number along the diagonal stays the same (an approximation of the usual default).
    """
    source = projection.parse(cube.attrs.get("crs", 4326))
    if target is not None:
        out = projection.parse(target.attrs.get("crs", 4326))
        done = sample(cube, {d: target.coords[d] for d in ("x", "y")}, target.dims["x"], target.dims["y"], method, source, out)
        return Cube(done.df, done.dims, done.variables, done.coords, {**done.attrs, "crs": target.attrs.get("crs", 4326)})
    name = dst_crs if dst_crs is not None else crs if crs is not None else cube.attrs.get("crs", 4326)
    out = projection.parse(name)
    if transform is not None:
        if width is None or height is None:
            raise ValueError("a transform needs a width and height")
        coords = {"x": (transform[2], transform[0]), "y": (transform[5], transform[4])}
    else:
        if extent is not None and res is None and width is None and height is None:
            raise ValueError("an extent needs a resolution or a shape")
        box = extent or projected_bounds(cube, out)
        if res is None and width is None and height is None:
            diagonal = math.hypot(box[2] - box[0], box[3] - box[1])
            res = diagonal / math.hypot(cube.dims["x"] - 1, cube.dims["y"] - 1)
        width, height, xr, yr = target_grid(width, height, res, box)
        down = cube.coords["y"][1] < 0
        coords = {"x": (box[0], xr), "y": (box[3], -yr) if down else (box[1], yr)}
    done = sample(cube, coords, width, height, method, source, out)
    return Cube(done.df, done.dims, done.variables, done.coords, {**done.attrs, "crs": name})


def align(cubes: Sequence[Cube], method: str | None = None) -> list[Cube]:
    """All cubes on one grid: their common bounds at the finest resolution."""
    box, res = reduce.common_bounds(cubes), reduce.common_resolution(cubes, "min")
    return [reproject(c, extent=box, res=res, crs=cubes[0].attrs.get("crs", 4326), method=method) for c in cubes]


def tie_points(cube: Cube, n: int = 50) -> DataFrame:
    """A sparse grid of (y, x, lon, lat)."""
    crs = projection.parse(cube.attrs.get("crs", 4326))
    ys = sorted({round(k * (cube.dims["y"] - 1) / max(n - 1, 1)) for k in range(n)})
    xs = sorted({round(k * (cube.dims["x"] - 1) / max(n - 1, 1)) for k in range(n)})
    at = lambda d, k: cube.coords[d][0] + k * cube.coords[d][1]
    rows = [(y, x, *map(float, projection.inverse(crs, at("x", x), at("y", y)))) for y in ys for x in xs]
    return cube.spark.createDataFrame(rows, "y int, x int, lon double, lat double")


def phase_shift(reference: np.ndarray, image: np.ndarray, upsampling: int = 10) -> tuple[float, float]:
    """The (row, column) shift that registers the image, by phase correlation refined on an upsampled DFT."""
    product = np.fft.fft2(reference) * np.conj(np.fft.fft2(image))
    product /= np.maximum(np.abs(product), 1e-12)
    peak = np.unravel_index(np.abs(np.fft.ifft2(product)).argmax(), product.shape)
    shift = np.array([p - n if p > n // 2 else p for p, n in zip(peak, product.shape)], float)
    if upsampling > 1:
        reach = 1.5
        offsets = np.arange(-reach, reach + 0.5 / upsampling, 1 / upsampling)
        fy, fx = np.fft.fftfreq(product.shape[0]), np.fft.fftfreq(product.shape[1])
        rows = np.exp(2j * np.pi * np.outer(shift[0] + offsets, fy))
        cols = np.exp(2j * np.pi * np.outer(fx, shift[1] + offsets))
        a, b = np.unravel_index(np.abs(rows @ product @ cols).argmax(), (len(offsets),) * 2)
        shift += [offsets[a], offsets[b]]
    return float(shift[0]), float(shift[1])


def shifted(image: np.ndarray, shift: tuple[float, float]) -> np.ndarray:
    """The image moved by a part of a cell, in the frequency domain."""
    fy, fx = np.fft.fftfreq(image.shape[0])[:, None], np.fft.fftfreq(image.shape[1])[None, :]
    return np.real(np.fft.ifft2(np.fft.fft2(image) * np.exp(-2j * np.pi * (fy * shift[0] + fx * shift[1]))))


def coregister(cube: Cube, reference: int = 0, upsampling: int = 10, band: str = "c11", time: str = "t") -> Cube:
    """Each time step moved onto the reference step. A step is an image and lies in one task; steps go in parallel."""
    cube = cube.split_complex().densify(0.0)
    h, w = cube.dims["y"], cube.dims["x"]
    base = cube.isel(**{time: reference}).df.select("y", "x", F.col(band).cast("double").alias("__base"))
    both = cube.df.join(base, ["y", "x"])
    names, order = list(cube.variables), list(cube.dims)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        image = lambda c: pdf[c].to_numpy(float).reshape(h, w)
        s = phase_shift(image("__base"), image(band), upsampling)
        return pdf.assign(**{v: shifted(image(v), s).ravel() for v in names})[[*order, *names]]

    schema = ", ".join([f"{d} int" for d in cube.dims] + [f"{v} double" for v in names])
    return cube.with_df(both.groupBy(time).applyInPandas(run, schema))


def shifts(cube: Cube, reference: int = 0, upsampling: int = 10, band: str = "c11", time: str = "t") -> DataFrame:
    """(t, dy, dx): the shift of each step."""
    cube = cube.split_complex().densify(0.0)
    h, w = cube.dims["y"], cube.dims["x"]
    base = cube.isel(**{time: reference}).df.select("y", "x", F.col(band).cast("double").alias("__base"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        dy, dx = phase_shift(pdf["__base"].to_numpy(float).reshape(h, w), pdf[band].to_numpy(float).reshape(h, w), upsampling)
        return pd.DataFrame({time: [pdf[time].iloc[0]], "dy": [dy], "dx": [dx]})

    return cube.df.join(base, ["y", "x"]).groupBy(time).applyInPandas(run, f"{time} int, dy double, dx double")
