"""Numbers behind pictures: percentile stretch, colour maps, composites and frames."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cube import Cube


def stretch_limits(df: DataFrame, variables: Sequence[str], pmin: float = 2, pmax: float = 98, by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """<v>_lo and <v>_hi: percentiles by linear interpolation; exact=False takes the mergeable sketch for very large cubes."""
    def limits(v: str) -> Column:
        at = F.array(F.lit(pmin / 100), F.lit(pmax / 100))
        return F.percentile(v, at) if exact else F.percentile_approx(v, at, 10_000)

    out = df.groupBy(*by).agg(*[limits(v).alias(v) for v in variables])
    return out.select(*by, *[F.col(v)[k].alias(f"{v}_{n}") for v in variables for k, n in enumerate(("lo", "hi"))])


def stretched(value: Column, lo: Column, hi: Column) -> Column:
    """0..255; no stretch where the limits don't differ."""
    x = F.when(hi > lo, F.try_divide(value - lo, hi - lo)).otherwise(value)
    return (F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)) * 255).cast("int")


def rgb(cube: Cube, channels: Sequence[Column] | None = None, pmin: float = 2, pmax: float = 98, vmin: float | None = None, vmax: float | None = None, mask: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """dims..., r, g, b. by: dims that are stretched each on its own, such as time for a film."""
    if channels is None:
        channels = [F.col("c11"), F.col("c22"), F.try_divide(F.col("c11"), F.col("c22"))]
    names = ["r", "g", "b"][: len(channels)] if len(channels) > 1 else ["grey"]
    df = cube.df.select(*cube.dims, *[c.cast("double").alias(n) for c, n in zip(channels, names)], (mask if mask is not None else F.lit(True)).alias("__m"))
    if vmin is not None and vmax is not None:
        limited = df.withColumns({f"{n}_{e}": F.lit(float(v)) for n in names for e, v in (("lo", vmin), ("hi", vmax))})
    else:
        limits = stretch_limits(df, names, pmin, pmax, by)  # one row, or one for each frame
        limited = df.join(limits, list(by)) if by else df.join(F.broadcast(limits))
    return limited.select(*cube.dims, *[F.when(F.col("__m"), stretched(F.col(n), F.col(f"{n}_lo"), F.col(f"{n}_hi"))).otherwise(0).alias(n) for n in names])


def ramp(n: int = 256) -> list[tuple[int, int, int]]:
    """A colour map from dark blue over green to yellow, by rule."""
    out = []
    for k in range(n):
        t = k / (n - 1)
        out.append((int(255 * max(0.0, 2 * t - 1)), int(255 * t), int(255 * (1 - t) * 0.6 + 40)))
    return out


def coloured(cube: Cube, label: str, colours: Sequence[tuple[int, int, int]] | None = None) -> DataFrame:
    """dims..., r, g, b of a cube of labels: a colour for each label in turn, black where there is none."""
    table = [tuple(c) for c in colours or ramp(16)]
    level = F.pmod(F.col(label), F.lit(len(table))).cast("int")
    pick = lambda k: F.when(F.col(label).isNotNull(), F.get(F.array(*[F.lit(int(c[k])) for c in table]), level)).otherwise(0)
    return cube.df.select(*cube.dims, *[pick(k).alias(n) for k, n in enumerate("rgb")])


def colour_mapped(cube: Cube, variable: str, colours: Sequence[tuple[int, int, int]] | None = None, by: Sequence[str] = (), **kw) -> DataFrame:
    """dims..., r, g, b of one variable, stretched and then looked up in a colour map of 256 entries at most."""
    table = [tuple(c) for c in colours or ramp()]
    grey = rgb(cube, [F.col(variable)], by=by, **kw)
    level = F.floor(F.col("grey") * (len(table) - 1) / 255).cast("int")
    return grey.select(*cube.dims, *[F.get(F.array(*[F.lit(int(c[k])) for c in table]), level).alias(n) for k, n in enumerate("rgb")])


def scaled(frame: DataFrame, old: tuple[int, int], shape: tuple[int | None, int | None] | None, keys: Sequence[str] = ()) -> DataFrame:
    """A picture (keys..., y, x, channels) in another height and width, by the nearest cell: each target cell reads one."""
    height, width = calculate_shape(shape, old)
    channels = [c for c in frame.columns if c not in ("y", "x", *keys)]
    grid = frame.sparkSession.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("__y"), (F.col("id") % width).cast("int").alias("__x"))
    taps = grid.select("__y", "__x", F.floor((F.col("__y") + 0.5) * old[0] / height).cast("int").alias("y"), F.floor((F.col("__x") + 0.5) * old[1] / width).cast("int").alias("x"))
    return frame.join(taps, ["y", "x"]).select(*keys, F.col("__y").alias("y"), F.col("__x").alias("x"), *channels)


def colorize(df: DataFrame, label: str, n: int, name: str = "level") -> DataFrame:
    """The level 0..255 of a label's colour, of n colours in turn."""
    return df.withColumn(name, F.floor(F.pmod(F.col(label), F.lit(n)) * 255 / (n - 1)).cast("int"))


def calculate_shape(new: tuple[int | None, int | None] | None, old: tuple[int, int]) -> tuple[int, int]:
    """Height and width; a side that isn't given follows from the other and is even."""
    if new is None or new == (None, None):
        return old
    h, w = new
    if h is None:
        h = int(old[0] / old[1] * w / 2) * 2
    elif w is None:
        w = int(old[1] / old[0] * h / 2) * 2
    return h, w


def png(rows: Sequence[Sequence[tuple[int, int, int]]]) -> bytes:
    """A small picture as PNG, on the driver."""
    height, width = len(rows), len(rows[0])
    raw = b"".join(b"\0" + bytes(c for p in r for c in p) for r in rows)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def write_png(frame: DataFrame, height: int, width: int, path: str) -> None:
    """y, x, r, g, b of one picture as a file."""
    if height * width > 64_000_000:
        raise ValueError("a picture of more than 64 million cells isn't drawn on the driver")
    image = [[(0, 0, 0)] * width for _ in range(height)]
    for r in frame.select("y", "x", "r", "g", "b").toLocalIterator():
        image[r[0]][r[1]] = (r[2], r[3], r[4])
    with open(path, "wb") as f:
        f.write(png(image))


def frames(cube: Cube, time: str = "t", **kw) -> DataFrame:
    """The composite of each time step, stretched by itself: what a film is made of."""
    return rgb(cube, by=[time], **kw)


def write_video(cube: Cube, path: str, time: str = "t", fps: int = 1, limit: int = 64_000_000, **kw) -> None:
    """The composites of all time steps as an AVI file of uncompressed pictures, drawn one after the other on the driver."""
    height, width, steps = cube.dims["y"], cube.dims["x"], cube.dims[time]
    if height * width > limit:
        raise ValueError(f"pictures of more than {limit} cells aren't drawn on the driver")
    rows, stride = frames(cube, time, **kw), -(-3 * width // 4) * 4
    names = [n for n in ("r", "g", "b", "grey") if n in rows.columns]
    size = stride * height

    def chunk(kind: bytes, data: bytes) -> bytes:
        return kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)

    header = struct.pack("<14I", 1_000_000 // fps, size * fps, 0, 0x10, steps, 0, 1, size, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"DIB ", 0, 0, 0, 0, 1, fps, 0, steps, size, 0, size, 0, 0, width, height)
    picture = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, size, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", header) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", picture)))
    movie = 4 + steps * (8 + size)
    with open(path, "wb") as f:
        f.write(b"RIFF" + struct.pack("<I", 4 + len(head) + 8 + movie + 8 + 16 * steps) + b"AVI " + head + b"LIST" + struct.pack("<I", movie) + b"movi")
        for k in range(steps):
            image = np.zeros((height, stride), np.uint8)
            for r in rows.where(F.col(time) == k).select("y", "x", *names).toLocalIterator():
                levels = [0 if v is None else v for v in r[2:]]
                image[height - 1 - r[0], 3 * r[1] : 3 * r[1] + 3] = (levels * 3 if len(levels) == 1 else levels)[2::-1]  # from the bottom up, blue first
            f.write(chunk(b"00db", image.tobytes()))
        f.write(b"idx1" + struct.pack("<I", 16 * steps) + b"".join(struct.pack("<4sIII", b"00db", 0x10, 4 + k * (8 + size), size) for k in range(steps)))
