"""Convolution, boxcar and Gaussian filters of any dims.

Edges become ghost rows, which at most `radius` cells next to an edge emit, and the sum
over a neighbourhood is a sum of lags in a window along each axis: one exchange for each
axis and no join. A kernel that is an outer product runs axis by axis.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cube import Cube
from ..functions.edges import ghosts


def with_ghosts(df: DataFrame, dim: str, n: int, before: int, after: int, mode: str) -> DataFrame:
    """The rows and, beyond both ends of the axis, the rows that the edge mode reads there."""
    if mode == "constant" or not (before or after):
        return df
    by_cell = ghosts(n, before, after, mode)
    if not by_cell:
        return df
    # a map from cells at the edges to the indices that read them: at most before + after entries
    table = F.create_map(*[x for k, v in by_cell.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    spread = F.concat(F.array(F.col(dim)), F.coalesce(F.try_element_at(table, F.col(dim)), F.array().cast("array<int>")))
    return df.withColumn(dim, F.explode(spread))


def along(df: DataFrame, dims: dict[str, int], dim: str, variables: Sequence[str], weights: dict[int, float], mode: str = "reflect", cval: float = 0.0) -> DataFrame:
    """Sum of weights[o] times the value at offset o along one axis of a dense cube. A missing value in reach makes the sum missing."""
    reach = [o for o, w in weights.items() if w]
    before, after = max([0, *[-o for o in reach]]), max([0, *reach])
    n = dims[dim]
    whole = with_ghosts(df, dim, n, before, after, mode)
    window = Window.partitionBy(*[d for d in dims if d != dim]).orderBy(dim)

    def term(v: str, o: int) -> Column:
        if mode == "constant":
            return F.lag(v, -o, cval).over(window)
        return F.lag(v, -o).over(window)

    sums = {v: sum((term(v, o) * F.lit(float(w)) for o, w in weights.items() if w), F.lit(0.0)) for v in variables}
    out = whole.select(*dims, *[c.alias(v) for v, c in sums.items()])
    return out.where((F.col(dim) >= 0) & (F.col(dim) < n)) if mode != "constant" else out


def _restored(cube: Cube, df: DataFrame) -> Cube:
    """Integer variables come back as what they were, truncated."""
    kinds = dict(cube.df.dtypes)
    return cube.with_df(df.select(*cube.dims, *[F.col(v).cast(kinds[v]).alias(v) if kinds[v] in ("int", "bigint", "smallint", "tinyint", "float") else F.col(v) for v in cube.variables]))


def separable(cube: Cube, kernels: dict[str, dict[int, float]], mode: str = "reflect", cval: float = 0.0) -> Cube:
    if cube.is_complex:
        return separable(cube.split_complex(), kernels, mode, cval).join_complex()
    df = cube.densify().df
    for dim, weights in kernels.items():
        df = along(df, cube.dims, dim, cube.variables, weights, mode, cval)
    return _restored(cube, df)


def factors(kernel: np.ndarray) -> list[np.ndarray] | None:
    """The 1-d kernels whose outer product the kernel is, if it is one."""
    out, rest = [], np.asarray(kernel, float)
    while rest.ndim > 1:
        flat = rest.reshape(rest.shape[0], -1)
        u, s, v = np.linalg.svd(flat, full_matrices=False)
        if len(s) > 1 and s[1] > 1e-12 * max(s[0], 1e-300):
            return None
        out.append(u[:, 0] * s[0])
        rest = v[0].reshape(rest.shape[1:])
    return [*out, rest]


def convolution(cube: Cube, dims: Sequence[str] = ("y", "x"), kernel=1.0, mode: str = "reflect", cval: float = 0.0) -> Cube:
    """out[i] = sum of kernel[j] * in[i + w // 2 - j] over the dims."""
    k = np.asarray(kernel, float)
    if k.ndim == 0:
        return cube
    if k.ndim != len(dims):
        raise ValueError(f"a kernel of {k.ndim} dims doesn't fit {len(dims)} dims")
    missing = [d for d in dims if d not in cube.dims]
    if missing:
        raise ValueError(f"no such dims: {', '.join(missing)}")
    parts = factors(k)
    if parts is not None and (mode != "constant" or cval == 0):
        return separable(cube, {d: {len(p) // 2 - j: float(w) for j, w in enumerate(p)} for d, p in zip(dims, parts)}, mode, cval)
    if cube.is_complex:
        return convolution(cube.split_complex(), dims, kernel, mode, cval).join_complex()
    return _restored(cube, _general(cube.densify().df, cube.dims, list(dims), cube.variables, k, mode, cval))


def _general(df: DataFrame, all_dims: dict[str, int], dims: list[str], variables: Sequence[str], k: np.ndarray, mode: str, cval: float) -> DataFrame:
    """Axis by axis: each pass gathers one axis of the neighbourhood into arrays, the last sums."""
    arrays = neighbourhood(df, all_dims, {d: (-(w - 1 - w // 2), w // 2) for d, w in zip(dims, k.shape)}, variables, mode, cval)
    weights = np.flip(k).ravel()  # the neighbourhood runs from the lowest offset up
    out = [sum((F.col(v)[j] * F.lit(float(w)) for j, w in enumerate(weights) if w), F.lit(0.0)).alias(v) for v in variables]
    return arrays.select(*all_dims, *out)


def neighbourhood(df: DataFrame, all_dims: dict[str, int], reach: dict[str, tuple[int, int]], variables: Sequence[str], mode: str, cval: float = 0.0) -> DataFrame:
    """Each variable as the array of its values at all offsets of the box, the last dim fastest."""
    values = {v: F.array(F.col(v).cast("double")) for v in variables}
    out = df.select(*all_dims, *[c.alias(v) for v, c in values.items()])
    width = 1
    for dim in reversed(list(reach)):
        low, high = reach[dim]
        out = with_ghosts(out, dim, all_dims[dim], -low, high, mode)
        window = Window.partitionBy(*[d for d in all_dims if d != dim]).orderBy(dim)
        blank = F.array(*[F.lit(float(cval))] * width)

        def shifted(v: str, o: int, window=window, blank=blank) -> Column:
            there = F.lag(v, -o).over(window)
            return F.coalesce(there, blank) if mode == "constant" else there

        out = out.select(*all_dims, *[F.flatten(F.array(*[shifted(v, o) for o in range(low, high + 1)])).alias(v) for v in variables])
        if mode != "constant":
            out = out.where((F.col(dim) >= 0) & (F.col(dim) < all_dims[dim]))
        width *= high - low + 1
    return out


def boxcar(cube: Cube, dims: Sequence[str] = ("y", "x"), w: int = 3, mode: str = "reflect", cval: float = 0.0) -> Cube:
    """The mean over a box of w cells along each dim."""
    return separable(cube, {d: {w // 2 - j: 1.0 / w for j in range(w)} for d in dims}, mode, cval)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> dict[int, float]:
    if sigma <= 0:
        return {0: 1.0}
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (x / sigma) ** 2) for x in range(-r, r + 1)]
    return {x: y / sum(w) for x, y in zip(range(-r, r + 1), w)}


def gaussian(cube: Cube, dims: Sequence[str] = ("y", "x"), sigma: float | Sequence[float] = 1.0, truncate: float = 4.0, mode: str = "reflect", cval: float = 0.0) -> Cube:
    sigmas = [sigma] * len(dims) if isinstance(sigma, (int, float)) else list(sigma)
    if len(sigmas) != len(dims):
        raise ValueError("one sigma for each dim is needed")
    return separable(cube, {d: gaussian_weights(s, truncate) for d, s in zip(dims, sigmas) if s > 0}, mode, cval)


def halo(dims: Sequence[str], kernel_shape: Sequence[int]) -> dict[str, int]:
    """Cells of a neighbouring tile that a convolution reads."""
    return {d: w // 2 for d, w in zip(dims, kernel_shape)}
