"""Omnibus change detection on series of 2x2 covariance matrices.

A cell's series is one row of arrays (one exchange by cell); the test of all subseries
from a start is then prefix sums over many cells at once. The chi-square distribution has
a closed form, as its degrees of freedom are multiples of four.

`alpha` is a limit of the distribution function: a change is where P > alpha.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..cube import Cube
from .stencil import boxcar

NAMES = ("c11", "c12r", "c12i", "c22")


def chi2_cdf(z: np.ndarray, f: int) -> np.ndarray:
    """For even f: 1 - exp(-z/2) sum of (z/2)^i / i! for i < f/2."""
    half = np.maximum(z, 0) / 2
    with np.errstate(invalid="ignore", over="ignore"):
        term, total = np.ones_like(half), np.ones_like(half)
        for i in range(1, f // 2):
            term = term * half / i
            total = total + term
        out = 1 - np.exp(-half) * total
    return np.where(np.isposinf(z), 1.0, np.where(z <= 0, 0.0, out))


def probability(logdet: np.ndarray, sums: np.ndarray, k: int, n: float) -> np.ndarray:
    """P of a subseries of k steps. logdet: sum of ln det; sums: (4, cells) of the covariance terms."""
    p, f = 2, (k - 1) * 4
    rho = 1 - (2 * p * p - 1) / (6 * (k - 1) * p) * (k / n - 1 / (n * k))
    omega = p * p * (p * p - 1) / (24 * rho**2) * (k / n**2 - 1 / (n * k) ** 2) - p * p * (k - 1) / 4 * (1 - 1 / rho) ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = np.log(sums[0] * sums[3] - (sums[1] ** 2 + sums[2] ** 2))
        z = -2 * rho * n * (p * k * np.log(k) + logdet - k * whole)
    a, b = chi2_cdf(z, f), chi2_cdf(z, f + 4)
    return a + omega * (b - a)


def changes(series: np.ndarray, n: float, alpha: float) -> np.ndarray:
    """series (cells, 4, steps) -> bool (cells, steps)."""
    cells, _, steps = series.shape
    out = np.zeros((cells, steps), bool)
    if steps < 2:
        return out
    det = series[:, 0] * series[:, 3] - (series[:, 1] ** 2 + series[:, 2] ** 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.log(np.abs(det))
    odd = np.cumsum(det < 0, 1)
    sums = np.cumsum(series, 2)
    start = np.zeros(cells, np.int64)
    for s in range(steps - 1):
        here = np.flatnonzero(start == s)
        if not len(here):
            continue
        base = sums[here, :, s - 1] if s else np.zeros((len(here), 4))
        gone = odd[here, s - 1] if s else np.zeros(len(here), np.int64)
        logdet = np.cumsum(logs[here, s:], 1)  # an infinite step must not reach starts after it
        first = np.full(len(here), -1)
        last = None
        for e in range(steps - 1, s, -1):
            value = logdet[:, e - s].copy()
            value[(odd[here, e] - gone) % 2 == 1] = np.nan
            hit = probability(value, (sums[here, :, e] - base).T, e - s + 1, n) > alpha
            if last is None:
                last = hit
                if not last.any():
                    break
            first[hit] = e
        found = last & (first > 0)
        out[here[found], first[found]] = True
        start[here] = np.where(found, first, steps)
    return out


def omnibus(cube: Cube, ml: int | None = None, n: float = 1, alpha: float = 0.01, looks: float = 1, names: Sequence[str] = NAMES, time: str = "t", space: Sequence[str] = ("y", "x")) -> Cube:
    """A cube of one boolean variable, change, over the same dims; ml: a boxcar of that width first, which makes n the ml * ml times the looks of a cell."""
    cube = cube.split_complex().select(*names)
    if ml:
        cube, n = boxcar(cube, space, ml), ml * ml * looks
    keys = [d for d in cube.dims if d != time]
    rows = cube.df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(time, *[F.col(v).cast("double").alias(v) for v in names]))).alias("s"))
    rows = rows.select(*keys, F.col(f"s.{time}").alias("steps"), *[F.col(f"s.{v}").alias(v) for v in names])
    fields = [pa.field(d, pa.int32()) for d in keys] + [pa.field("steps", pa.list_(pa.int32())), pa.field("changed", pa.list_(pa.bool_()))]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [b.schema.get_field_index(v) for v in names]
            steps = b.column(len(keys))
            lengths = np.diff(steps.offsets.to_numpy())
            flat = [b.column(k).flatten().to_numpy(zero_copy_only=False) for k in at]
            ends = np.cumsum(lengths)
            result = np.zeros(int(lengths.sum()), bool)
            for size in np.unique(lengths):
                rows_ = np.flatnonzero(lengths == size)
                where = (ends[rows_] - size)[:, None] + np.arange(size)
                result[where] = changes(np.stack([x[where] for x in flat], 1), n, alpha)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(result))
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(len(keys))], pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), steps.flatten()), lists], schema=schema)

    done = rows.mapInArrow(run, ", ".join([f"{d} int" for d in keys] + ["steps array<int>", "changed array<boolean>"]))
    out = done.select(*keys, F.explode(F.arrays_zip("steps", "changed")).alias("z")).select(*keys, F.col("z.steps").alias(time), F.col("z.changed").alias("change"))
    return cube.with_df(out.select(*cube.dims, "change"), ("change",))
