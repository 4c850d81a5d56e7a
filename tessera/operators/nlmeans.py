"""Non-local means: a weighted mean over a search box, weights by how alike patches are.

For a cell p and each q in the box of radius r around it, d2 is the mean over the patch of
radius f and over all variables of the squared differences, w = exp(-max(d2 - 2 sigma^2, 0)
/ h^2). The cell itself has the greatest weight of the others (1 if all are 0) or, with n_eff, the weight
that makes the effective sample size n_eff. Where no weight does, also because all others are 0,
the result is missing, as it is where a cell within r + f is. Edges mirror without repeating the edge.

The cube is dealt out in tiles with a halo of r + f cells: a cell goes to each tile that reads it,
a tile to one call, which is numpy over whole arrays for each offset of the box. A tile's size is
fixed, so tasks are bounded at any size of the cube.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..cube import Cube
from ..functions.edges import fold

#: Cells of a tile along each filtered dim, for one or two of these and for more, and along other dims.
TILE, TILE_OF_MANY, TILE_OTHER = 64, 32, 8


def self_weight(total: np.ndarray, squares: np.ndarray, n_eff: float) -> np.ndarray:
    """The w for which (S + w)^2 / (Q + w^2) = n; NaN where there is none."""
    with np.errstate(divide="ignore", invalid="ignore"):
        solvable = (squares > 0) & (n_eff - 1 <= total * total / squares)
        root = np.sqrt(np.where(solvable, n_eff * total * total - n_eff * n_eff * squares + n_eff * squares, np.nan))
        return (total + root) / (n_eff - 1)


def _patch_sums(x: np.ndarray, fs: Sequence[int]) -> np.ndarray:
    """Sums over 2 f + 1 neighbours along each of the first axes."""
    for axis, f in enumerate(fs):
        n = x.shape[axis] - 2 * f
        x = sum(x.take(range(o, o + n), axis=axis) for o in range(2 * f + 1)) if f else x
    return x


def filtered(a: np.ndarray, rs: Sequence[int], fs: Sequence[int], sigma: float, h: float, n_eff: float) -> np.ndarray:
    """Of an array (filtered dims with a halo of r + f, other dims..., variables) the means without the halo."""
    core = [n - 2 * (r + f) for n, r, f in zip(a.shape, rs, fs)]
    n = a.shape[-1] * int(np.prod([2 * f + 1 for f in fs]))

    def shifted(q: Sequence[int], margin: Sequence[int]) -> np.ndarray:
        return a[tuple(slice(r + f + o - m, r + f + o + m + c) for r, f, o, m, c in zip(rs, fs, q, margin, core))]

    zero = [0] * len(core)
    here, middle = shifted(zero, fs), shifted(zero, zero)
    total, squares, top, mean = 0.0, 0.0, 0.0, 0.0
    for q in itertools.product(*[range(-r, r + 1) for r in rs]):
        if any(q):
            d2 = _patch_sums(((here - shifted(q, fs)) ** 2).sum(axis=-1), fs) / n
            w = np.exp(-np.maximum(d2 - 2 * sigma**2, 0) / h**2)
            total, squares, top, mean = total + w, squares + w * w, np.maximum(top, w), mean + w[..., None] * shifted(q, zero)
    own = self_weight(total, squares, n_eff) if n_eff > 0 else np.where(top == 0, 1.0, top)
    return (mean + own[..., None] * middle) / (total + own)[..., None]


def nlmeans(cube: Cube, dims: Sequence[str] = ("y", "x"), r: int | Sequence[int] = 1, sigma: float = 1.0, h: float = 1.0, f: int | Sequence[int] = 1, n_eff: float = -1) -> Cube:
    rs = [r] * len(dims) if isinstance(r, int) else list(r)
    fs = [f] * len(dims) if isinstance(f, int) else list(f)
    fs = [0 if a == 0 else b for a, b in zip(rs, fs)]
    if cube.is_complex:
        return nlmeans(cube.split_complex(), dims, rs, sigma, h, fs, n_eff).join_complex()
    if not any(rs):
        return cube
    moved = [(d, a, b) for d, a, b in zip(dims, rs, fs) if a]
    order = [d for d, _, _ in moved] + [d for d in cube.dims if d not in {m[0] for m in moved}]
    reach = {d: a + b for d, a, b in moved}
    tile = {d: (TILE if len(moved) <= 2 else TILE_OF_MANY) if d in reach else TILE_OTHER for d in order}
    sizes, variables = dict(cube.dims), list(cube.variables)
    df = cube.df.select(*cube.dims, *[F.col(v).cast("double").alias(v) for v in variables])
    for d in order:  # the tiles whose cells or halo a cell is in
        m, last = reach.get(d, 0), (sizes[d] - 1) // tile[d]
        low, high = F.greatest(F.floor((F.col(d) - m) / tile[d]), F.lit(0)).cast("int"), F.least(F.floor((F.col(d) + m) / tile[d]), F.lit(last)).cast("int")
        df = df.withColumn(f"tile_{d}", F.explode(F.sequence(low, high)) if m else low)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first = [k * tile[d] for k, d in zip(key, order)]
        stop = [min(a + tile[d], sizes[d]) for a, d in zip(first, order)]
        low = [max(0, a - reach.get(d, 0)) for a, d in zip(first, order)]
        high = [min(sizes[d], b + reach.get(d, 0)) for b, d in zip(stop, order)]
        a = np.full([y - x for x, y in zip(low, high)] + [len(variables)], np.nan)
        a[tuple(rows[d].to_numpy() - x for d, x in zip(order, low))] = rows[variables].to_numpy()
        read = [[fold(i, sizes[d], "mirror") - x for i in range(p - reach.get(d, 0), q + reach.get(d, 0))] for d, x, p, q in zip(order, low, first, stop)]
        out = filtered(a[np.ix_(*read)], [m[1] for m in moved], [m[2] for m in moved], sigma, h, n_eff)
        places = np.indices(out.shape[:-1]).reshape(len(order), -1)
        return pd.DataFrame({d: (places[k] + first[k]).astype("int32") for k, d in enumerate(order)} | {v: out[..., k].ravel() for k, v in enumerate(variables)})

    schema = ", ".join([*(f"{d} int" for d in order), *(f"{v} double" for v in variables)])
    found = df.groupBy(*[f"tile_{d}" for d in order]).applyInPandas(run, schema)
    return cube.with_df(found.select(*cube.dims, *[F.when(~F.isnan(v), F.col(v)).alias(v) for v in variables]))
