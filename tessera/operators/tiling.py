"""Splitting cubes into chunks and tiles with halos, mapping over them and merging again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cube import Cube


def chunk_size(n: int, chunks: int) -> int:
    return -(-n // chunks)


def block_of(index: Column, n: int, blocks: int) -> Column:
    """The block of an index when n cells go into near-equal blocks, the first n % blocks one longer."""
    q, r = divmod(n, blocks)
    if not 0 < blocks <= max(n, 1):
        raise ValueError(f"{n} cells can't go into {blocks} blocks")
    return F.when(index < r * (q + 1), F.floor(index / (q + 1))).otherwise(r + F.floor((index - r * (q + 1)) / max(q, 1))).cast("int")


def block_split(cube: Cube, blocks: dict[str, int]) -> DataFrame:
    return cube.df.withColumns({f"block_{d}": block_of(F.col(d), cube.dims[d], b) for d, b in blocks.items()})


def split(cube: Cube, sizes: dict[str, int], buffer: int | dict[str, int] = 0) -> DataFrame:
    """Cells with their tiles: tile_<dim> columns and is_core. A cell in a halo has a row for each tile that reads it."""
    df, core = cube.df, F.lit(True)
    for d, size in sizes.items():
        if d not in cube.dims:
            raise ValueError(f"no such dim: {d}")
        b = buffer if isinstance(buffer, int) else buffer.get(d, 0)
        top = (cube.dims[d] - 1) // size
        low = F.greatest(F.lit(0), F.floor((F.col(d) - b) / size)).cast("int")
        high = F.least(F.lit(top), F.floor((F.col(d) + b) / size)).cast("int")
        df = df.withColumn(f"tile_{d}", F.explode(F.sequence(low, high)) if b else F.floor(F.col(d) / size).cast("int"))
        core = core & (F.col(f"tile_{d}") == F.floor(F.col(d) / size))
    return df.withColumn("is_core", core)


def merge(tiles: DataFrame, cube: Cube) -> Cube:
    """Drops halos: the inverse of split."""
    return cube.with_df(tiles.where("is_core").select(*cube.dims, *cube.variables))


def debuffer(tiles: DataFrame, dims: Sequence[str], tile: str, along: str, variables: Sequence[str]) -> DataFrame:
    """Overlapping tiles without a halo flag: each cell comes from the tile in whose middle it lies deepest, the lower one in a tie."""
    ends = tiles.groupBy(tile).agg(F.min(along).alias("__lo"), F.max(along).alias("__hi"))  # one row for each tile
    depth = tiles.join(ends, tile).withColumn("__depth", F.least(F.col(along) - F.col("__lo"), F.col("__hi") - F.col(along)))
    # the first and last tiles are not cut at the ends of the axis
    whole = ends.agg(F.min("__lo").alias("__first"), F.max("__hi").alias("__last"))
    depth = depth.join(F.broadcast(whole)).withColumn("__depth", F.when(F.col("__lo") == F.col("__first"), F.col("__hi") - F.col(along)).when(F.col("__hi") == F.col("__last"), F.col(along) - F.col("__lo")).otherwise(F.col("__depth")))
    best = F.max_by(F.struct(*variables), F.struct(F.col("__depth"), -F.col(tile)))
    return depth.groupBy(*dims).agg(best.alias("__v")).select(*dims, *[F.col(f"__v.{v}").alias(v) for v in variables])


def write_tiles(tiles: DataFrame, path: str, keys: Sequence[str], skip_existing: bool = True) -> None:
    """A Parquet store by tile; tiles that are there already stay as they are."""
    if skip_existing:
        try:
            there = tiles.sparkSession.read.parquet(path).select(*keys).distinct()
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
        else:
            tiles = tiles.join(there, list(keys), "left_anti")
    tiles.write.mode("append").partitionBy(*keys).parquet(path)


def map_tiles(tiles: DataFrame, keys: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn over each tile, in parallel."""
    return tiles.groupBy(*keys).applyInPandas(fn, schema)


def parallel(cube: Cube, fn: Callable[[pd.DataFrame], pd.DataFrame], dim: str, chunks: int, schema: str, buffer: int = 0) -> Cube:
    """Splits along a dim, maps each chunk with its halo and merges the cores. schema: that of the cells."""
    if dim not in cube.dims:
        raise ValueError(f"no such dim: {dim}")
    size = chunk_size(cube.dims[dim], chunks)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = fn(pdf.drop(columns=[f"tile_{dim}", "is_core"]))
        return out[out[dim] // size == key[0]]

    return cube.with_df(split(cube, {dim: size}, buffer).groupBy(f"tile_{dim}").applyInPandas(run, schema))


def _ends(cube: Cube, dim: str) -> tuple[float, float]:
    first, step = cube.coords.get(dim, (0.0, 1.0))
    return first, first + (cube.dims[dim] - 1) * step


def sort_key(cube: Cube, dims: Sequence[str]) -> tuple[float, ...]:
    """The first and last coordinate along each dim, negative where they fall: sorts tiles as they lie."""
    return tuple(sign * c for first, last in (_ends(cube, d) for d in dims) for sign in (1 if last >= first else -1,) for c in (first, last))


def sort_into_array(cubes: Sequence[Cube], dims: Sequence[str] | None = None) -> np.ndarray:
    """An array of the tiles as they lie: an axis for each dim, tiles by their first coordinate in its direction."""
    dims = list(dims or cubes[0].dims)
    firsts = {d: sorted({_ends(c, d)[0] for c in cubes}, reverse=any(_ends(c, d)[1] < _ends(c, d)[0] for c in cubes)) for d in dims}
    out = np.empty([len(firsts[d]) for d in dims], dtype=object)
    for c in cubes:
        out[tuple(firsts[d].index(_ends(c, d)[0]) for d in dims)] = c
    return out
