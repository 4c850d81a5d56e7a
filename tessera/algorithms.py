"""The algorithms as classes: NLMeansFilter(r=2).apply(cube) is cube.filter.nlmeans(r=2).

Applied to a Dataset, a filter acts on the cubes that have its dims and passes the others through.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np

from .algorithm import Algorithm, as_function
from .cube import Cube
from .dataset import Dataset
from .operators import change, nlmeans, stencil, warp


class Filter(Algorithm):
    """What has dims and works on one cube; apply() finds the cubes that have them."""

    dims: Sequence[str] = ("y", "x")

    def filtered(self, cube: Cube) -> Cube:
        raise NotImplementedError

    def apply(self, cube: Cube | Dataset) -> Cube | Dataset:
        if isinstance(cube, Dataset):
            return cube.map(self.filtered, self.dims)
        missing = [d for d in self.dims if d not in cube.dims]
        if missing:
            raise ValueError(f"no such dims: {', '.join(missing)}")
        return self.filtered(cube)


class ConvolutionFilter(Filter):
    def __init__(self, dims: Sequence[str] = ("y", "x"), kernel: Any = 1.0, mode: str = "reflect", cval: float = 0.0):
        self.dims, self.kernel, self.mode, self.cval = tuple(dims), np.asarray(kernel, float), mode, cval

    def filtered(self, cube: Cube) -> Cube:
        return stencil.convolution(cube, self.dims, self.kernel, self.mode, self.cval)

    def halo(self, dim: str) -> int:
        return stencil.halo(self.dims, self.kernel.shape).get(dim, 0)


class BoxcarFilter(ConvolutionFilter):
    def __init__(self, dims: Sequence[str] = ("y", "x"), w: int = 3, mode: str = "reflect", cval: float = 0.0):
        super().__init__(dims, np.full((w,) * len(dims), 1.0 / w ** len(dims)), mode, cval)


class GaussianFilter(Filter):
    def __init__(self, dims: Sequence[str] = ("y", "x"), sigma: float | Sequence[float] = 1.0, truncate: float = 4.0, mode: str = "reflect", cval: float = 0.0):
        self.dims, self.truncate, self.mode, self.cval = tuple(dims), truncate, mode, cval
        self.sigma = [float(sigma)] * len(self.dims) if isinstance(sigma, (int, float)) else list(sigma)

    def filtered(self, cube: Cube) -> Cube:
        return stencil.gaussian(cube, self.dims, self.sigma, self.truncate, self.mode, self.cval)

    def halo(self, dim: str) -> int:
        return int(self.truncate * self.sigma[self.dims.index(dim)] + 0.5) if dim in self.dims else 0


class NLMeansFilter(Filter):
    def __init__(self, dims: Sequence[str] = ("y", "x"), r: int | Sequence[int] = 1, sigma: float = 1.0, h: float = 1.0, f: int | Sequence[int] = 1, n_eff: float = -1):
        self.dims, self.sigma, self.h, self.n_eff = tuple(dims), sigma, h, n_eff
        self.r, self.f = ([x] * len(self.dims) if isinstance(x, int) else list(x) for x in (r, f))

    def filtered(self, cube: Cube) -> Cube:
        return nlmeans.nlmeans(cube, self.dims, self.r, self.sigma, self.h, self.f, self.n_eff)

    def halo(self, dim: str) -> int:
        if dim not in self.dims:
            return 0
        r, f = (x[self.dims.index(dim)] for x in (self.r, self.f))
        return r + f if r else 0


class ChangeDetection(Algorithm):
    """What gives a cube of one boolean variable, change."""


class OmnibusTest(ChangeDetection):
    def __init__(self, ml: int | None = None, n: float = 1, alpha: float = 0.01, looks: float = 1):
        self.ml, self.n, self.alpha, self.looks = ml, n, alpha, looks

    def apply(self, cube: Cube) -> Cube:
        return change.omnibus(cube, ml=self.ml, n=self.n, alpha=self.alpha, looks=self.looks)

    def halo(self, dim: str) -> int:
        return self.ml // 2 if self.ml and dim in ("y", "x") else 0


class Reprojection(Algorithm):
    """Arguments as those of reproject(); variables without both space dims pass through a Dataset as they are."""

    def __init__(self, target: Cube | None = None, dst_crs: Any = None, crs: Any = None, extent: Sequence[float] | None = None, res: Any = None, width: int | None = None, height: int | None = None, transform: Sequence[float] | None = None, method: str | None = None):
        self.options = {"target": target, "dst_crs": dst_crs, "crs": crs, "extent": extent, "res": res, "width": width, "height": height, "transform": transform, "method": method}

    def apply(self, cube: Cube | Dataset) -> Cube | Dataset:
        if isinstance(cube, Dataset):
            return cube.map(self.apply, ("y", "x"))
        return warp.reproject(cube, **self.options)


class Resample(Algorithm):
    def __init__(self, res: Any = None, width: int | None = None, height: int | None = None, method: str | None = None):
        self.options = {"res": res, "width": width, "height": height, "method": method}

    def apply(self, cube: Cube | Dataset) -> Cube | Dataset:
        if isinstance(cube, Dataset):
            return cube.map(self.apply, ("y", "x"))
        return warp.resample(cube, **self.options)


class Alignment(Algorithm):
    """Several cubes on one grid: a list in, a list out, or files with path."""

    def __init__(self, target: Cube | None = None, method: str | None = None):
        self.target, self.method = target, method

    def apply(self, cubes: Sequence[Cube], path: str | None = None) -> list[Cube]:
        out = [warp.reproject(c, target=self.target, method=self.method) for c in cubes] if self.target is not None else warp.align(cubes, self.method)
        for k, c in enumerate(out if path else ()):
            c.save(f"{path}/{k}_aligned")
        return out


class Coregistration(Algorithm):
    def __init__(self, reference: int = 0, upsampling: int = 10, band: str = "c11", time: str = "t"):
        self.options = {"reference": reference, "upsampling": upsampling, "band": band, "time": time}

    def apply(self, cube: Cube) -> Cube:
        return warp.coregister(cube, **self.options)


def algorithms(base: type[Algorithm] = Algorithm) -> list[type[Algorithm]]:
    """All classes derived from a base that can be applied, by name."""
    found = {base.__name__: base}
    for sub in base.__subclasses__():
        found |= {c.__name__: c for c in algorithms(sub)}
    return [found[n] for n in sorted(found) if found[n] not in (Algorithm, Filter, ChangeDetection)]


convolution = as_function(ConvolutionFilter, "convolution")
boxcar = as_function(BoxcarFilter, "boxcar")
gaussian = as_function(GaussianFilter, "gaussian")
nlmeans_filter = as_function(NLMeansFilter, "nlmeans_filter")
omnibus = as_function(OmnibusTest, "omnibus")
reproject = as_function(Reprojection, "reproject")
resample = as_function(Resample, "resample")
coregister = as_function(Coregistration, "coregister")
