"""Polygons: rasterizing, clipping, and reading of GeoJSON.

A polygon is an array of rings, a ring an array of (x, y). Candidates come from the
bounding box as index ranges, so the join with the grid is an explode and never a product;
the exact test is even-odd ray casting over the edges within the row.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cube import Cube
from ..functions import projection
from ..functions.general import parse_date

GEOMETRY = "array<array<struct<x:double,y:double>>>"


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """(feature_id, geometry, properties...) of a file with a feature collection; null geometries are left out. properties: their schema."""
    raw = spark.read.option("multiLine", True).json(path, schema=f"features array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>>")
    each = raw.select(F.posexplode("features").alias("feature_id", "f")).where("f.geometry is not null")
    polygon = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    many = F.flatten(F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>"))
    rings = F.when(F.col("f.geometry.type") == "MultiPolygon", many).otherwise(polygon)
    points = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return each.select(F.col("feature_id").cast("long"), points.alias("geometry"), "f.properties.*")


def to_geojson(rows: Sequence[dict]) -> str:
    """A feature collection of a few features, for tests and exports from the driver."""
    return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": r["properties"], "geometry": {"type": "Polygon", "coordinates": r["rings"]}} for r in rows]})


def box(geometry: Column) -> Column:
    """left, bottom, right, top of a polygon."""
    points = F.flatten(geometry)
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("left"), F.array_min(y).alias("bottom"), F.array_max(x).alias("right"), F.array_max(y).alias("top"))


def contains(geometry: Column, px: Column, py: Column) -> Column:
    """Even-odd ray casting: whether the point lies inside; each ring closes itself."""
    def crossings(ring: Column) -> Column:
        n = F.size(ring)

        def crosses(p: Column, k: Column) -> Column:
            q = F.get(ring, F.when(k + 1 < n, k + 1).otherwise(F.lit(0)))
            over = (p["y"] > py) != (q["y"] > py)
            at = p["x"] + F.try_divide((py - p["y"]) * (q["x"] - p["x"]), q["y"] - p["y"])
            return F.when(over & (px < at), 1).otherwise(0)

        return F.aggregate(F.transform(ring, crosses), F.lit(0), lambda a, b: a + b)

    return F.aggregate(F.transform(geometry, crossings), F.lit(0), lambda a, b: a + b) % 2 == 1


def clip(features: DataFrame, left: float, bottom: float, right: float, top: float, geometry: str = "geometry") -> DataFrame:
    """Features that share a point with a box: a corner of one in the other, or crossing edges."""
    g, b = F.col(geometry), box(F.col(geometry))
    near = (b["right"] >= left) & (b["left"] <= right) & (b["top"] >= bottom) & (b["bottom"] <= top)
    inside = F.exists(F.flatten(g), lambda p: p["x"].between(left, right) & p["y"].between(bottom, top))
    holds = contains(g, F.lit(float(left)), F.lit(float(bottom)))

    def enters(ring: Column) -> Column:
        n = F.size(ring)

        def edge(p: Column, k: Column) -> Column:
            q = F.get(ring, F.when(k + 1 < n, k + 1).otherwise(F.lit(0)))
            dx, dy = q["x"] - p["x"], q["y"] - p["y"]
            # Liang-Barsky: the part of the edge within the box isn't empty
            low = F.greatest(F.lit(0.0), *[F.when(d > 0, F.try_divide(a - s, d)).when(d < 0, F.try_divide(z - s, d)).otherwise(F.when((s >= a) & (s <= z), 0.0).otherwise(2.0)) for d, s, a, z in ((dx, p["x"], left, right), (dy, p["y"], bottom, top))])
            high = F.least(F.lit(1.0), *[F.when(d > 0, F.try_divide(z - s, d)).when(d < 0, F.try_divide(a - s, d)).otherwise(1.0) for d, s, a, z in ((dx, p["x"], left, right), (dy, p["y"], bottom, top))])
            return low <= high

        return F.exists(F.transform(ring, edge), lambda x: x)

    return features.where(near & (inside | holds | F.exists(g, enters)))


def burn(features: DataFrame, cube: Cube, value: str, order: str = "feature_id", extra: Sequence[str] = (), geometry: str = "geometry") -> DataFrame:
    """(extra..., y, x, value) of the cells whose centre lies in a feature; of several the last by order counts."""
    (x0, xr), (y0, yr) = cube.coords["x"], cube.coords["y"]
    b = box(F.col(geometry))

    def reach(low: Column, high: Column, first: float, step: float, n: int) -> Column:
        a, z = ((low - first) / step, (high - first) / step) if step > 0 else ((high - first) / step, (low - first) / step)
        a, z = F.greatest(F.ceil(a), F.lit(0)).cast("int"), F.least(F.floor(z), F.lit(n - 1)).cast("int")
        return F.when(a <= z, F.sequence(a, z)).otherwise(F.array().cast("array<int>"))

    rows = features.select(geometry, value, order, *extra, F.explode(reach(b["bottom"], b["top"], y0, yr, cube.dims["y"])).alias("y"))
    cells = rows.select(geometry, value, order, *extra, "y", F.explode(reach(b["left"], b["right"], x0, xr, cube.dims["x"])).alias("x"))
    hit = cells.where(contains(F.col(geometry), x0 + F.col("x") * xr, y0 + F.col("y") * yr))
    return hit.groupBy(*extra, "y", "x").agg(F.max_by(value, order).alias(value))


def reprojected(features: DataFrame, source, target, geometry: str = "geometry") -> DataFrame:
    """The corners of all features in another reference system."""
    a, b = projection.parse(source), projection.parse(target)

    def moved(p: Column) -> Column:
        x, y = projection.convert(a, b, p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return features.withColumn(geometry, F.transform(geometry, lambda ring: F.transform(ring, moved)))


def rasterize(features: DataFrame, cube: Cube, columns: Sequence[str], order: str = "feature_id", geometry: str = "geometry", encode: bool = True, date_field: str | None = None, date_fmt: str | None = None, crs=None) -> tuple[Cube, dict[str, DataFrame]]:
    """Columns burned onto the grid, 0 elsewhere; strings become codes from 1 with a legend.

    With a date field the features of each date make a step of a time axis, whose dates are in attrs["time"];
    features without a date are on none. crs: that of the features, if it isn't the cube's.
    """
    from .reduce import factorize

    if crs is not None:
        features = reprojected(features, crs, cube.attrs.get("crs", 4326), geometry)
    dims, extra, attrs = {"y": cube.dims["y"], "x": cube.dims["x"]}, [], dict(cube.attrs)
    spatial = Cube(cube.df, dims, (), cube.coords, cube.attrs)
    if date_field is not None:
        if date_field not in features.columns:
            raise ValueError(f"Field {date_field} does not exist.")
        kind = dict(features.dtypes)[date_field]
        day = parse_date(F.col(date_field), date_fmt) if kind == "string" else F.col(date_field).cast("timestamp_ntz")
        dated = features.withColumn("__day", day).where("__day is not null")
        days = [r[0] for r in dated.select("__day").distinct().orderBy("__day").collect()]  # the cube's axis
        steps = features.sparkSession.createDataFrame(list(enumerate(days)), "t int, __day timestamp_ntz")
        features = dated.join(F.broadcast(steps), "__day").drop("__day")  # a row for each step of the axis
        dims, extra, attrs = {**dims, "t": len(days)}, ["t"], {**attrs, "time": [d.isoformat() for d in days]}
    legends: dict[str, DataFrame] = {}
    out = Cube(cube.df, dims, ()).grid()
    for c in columns:
        source = features
        if encode and dict(features.dtypes)[c] == "string":
            source, legends[c] = factorize(features, c, order, "__code")
            source = source.drop(c).withColumnRenamed("__code", c)
        out = out.join(burn(source, spatial, c, order, extra, geometry), [*extra, "y", "x"], "left")
    numbers = [c for c in columns if encode or dict(features.dtypes)[c] != "string"]
    return Cube(out.fillna(0, subset=numbers).select(*dims, *columns), dims, tuple(columns), cube.coords, attrs), legends
