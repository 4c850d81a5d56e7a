"""Generalised mapping of a function over chosen dims: "(t)->()", "(t,var)->(t)" and so on."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..cube import Cube

#: Cells that one call reads, about.
TILE_CELLS = 1 << 18
_SIGNATURE = re.compile(r"\s*\(([^()]*)\)\s*->\s*\(([^()]*)\)\s*")
#: numpy reductions that Spark has itself.
_NATIVE = {np.mean: "mean", np.nanmean: "mean", np.std: "std", np.nanstd: "std", np.var: "var", np.nanvar: "var", np.sum: "sum", np.nansum: "sum", np.max: "max", np.nanmax: "max", np.min: "min", np.nanmin: "min"}


def parse(signature: str) -> tuple[list[str], list[str]]:
    m = _SIGNATURE.fullmatch(signature)
    if not m:
        raise ValueError(f"{signature!r} is not a signature such as (t)->()")
    inner, outer = ([d.strip() for d in g.split(",") if d.strip()] for g in m.groups())
    if not set(outer) <= set(inner):
        raise ValueError("the output has dims that the input hasn't")
    return inner, outer


def apply(cube: Cube, fn: Callable, signature: str = "()->()", name: str = "result") -> Cube:
    """fn over arrays of the input dims, for each cell of the others. "var" stands for the axis of variables."""
    inner, outer = parse(signature)
    dims = [d for d in inner if d != "var"]
    unknown = [d for d in dims if d not in cube.dims]
    if unknown:
        raise ValueError(f"no such dims: {', '.join(unknown)}")
    if fn in _NATIVE and not outer and "var" not in inner and dims:
        return cube.reduce(_NATIVE[fn], *dims) if len(dims) < len(cube.dims) else cube.reduce(_NATIVE[fn])
    keep = [d for d in cube.dims if d not in dims]
    result = [d for d in cube.dims if d in keep or d in outer]
    as_axis = "var" in inner
    names = list(cube.variables) if not as_axis or "var" in outer else [name]
    sizes = [cube.dims[d] for d in dims]
    variables = list(cube.variables)

    # a call gets a tile of the kept dims, of about TILE_CELLS cells with all that fn reads of them
    side = max(1, int((TILE_CELLS / max(1, int(np.prod(sizes)))) ** (1 / max(1, len(keep)))))
    left = [d for d in outer if d != "var"]
    cube_sizes = dict(cube.dims)

    def of_cell(arrays: list[np.ndarray]) -> list[np.ndarray]:
        if not as_axis:
            return [np.asarray(fn(a)) for a in arrays]
        got = np.asarray(fn(np.moveaxis(np.stack(arrays), 0, inner.index("var"))))
        return list(np.moveaxis(got, outer.index("var"), 0)) if "var" in outer else [got]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = [int(k) * side for k in key[: len(keep)]]
        shape = [min(side, cube_sizes[d] - f) for d, f in zip(keep, first)]
        cells = tuple(pdf[d].to_numpy() - f for d, f in zip(keep, first))
        there = np.zeros(shape, bool)
        there[cells] = True
        arrays = []
        for v in variables:
            a = np.full([*shape, *sizes], np.nan)
            a[(*cells, *(pdf[d].to_numpy() for d in dims))] = pdf[v].to_numpy(float)
            arrays.append(a)
        found = [tuple(c) for c in np.argwhere(there)]
        done = [of_cell([a[c] for a in arrays]) for c in found]
        inside = np.indices([cube_sizes[d] for d in left]).reshape(len(left), -1) if left else np.zeros((0, 1), int)
        each = inside.shape[1]
        out = {d: np.repeat([c[k] + f for c in found], each) for k, (d, f) in enumerate(zip(keep, first))}
        out |= {d: np.tile(w, len(found)) for d, w in zip(left, inside)}
        out |= {n: np.concatenate([np.asarray(x[k], float).ravel() if left else np.array([float(x[k])]) for x in done]) for k, n in enumerate(names)}
        return pd.DataFrame(out)[[*result, *names]]

    schema = ", ".join([f"{d} int" for d in result] + [f"{n} double" for n in names])
    groups = cube.df.groupBy(*[F.floor(F.col(d) / side).cast("int").alias(f"tile_{d}") for d in keep]) if keep else cube.df.groupBy(F.lit(0))
    return cube.with_df(groups.applyInPandas(run, schema), names, {d: cube.dims[d] for d in result})
