"""Algorithm classes, datasets, helpers, metadata, dated features, tiles, pictures and TIFFs."""

import datetime
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import tessera
from tessera import algorithms
from tessera.cube import Cube
from tessera.dataset import Dataset
from tessera.functions import general, projection
from tessera.operators import tiling, vector, visual, warp
from tessera.sources import rasters


def cube_of(spark, a, dims=("y", "x"), name="v", **kw):
    rows = [(*map(int, p), float(a[p])) for p in np.ndindex(a.shape)]
    return Cube.of(spark.createDataFrame(rows, ", ".join(f"{d} int" for d in dims) + f", {name} double"), dict(zip(dims, a.shape)), **kw)


def values(cube, name="v"):
    return {tuple(r[d] for d in cube.dims): r[name] for r in cube.df.collect()}


def test_every_algorithm_is_its_function(spark):
    a = np.random.default_rng(1).normal(size=(7, 6))
    cube = cube_of(spark, a, coords={"y": (5.0, -1.0), "x": (0.0, 2.0)}, attrs={"crs": 4326})
    for made, want in (
        (algorithms.BoxcarFilter(w=3), cube.filter.boxcar(w=3)),
        (algorithms.GaussianFilter(sigma=1), cube.filter.gaussian(sigma=1)),
        (algorithms.ConvolutionFilter(kernel=[[0, 1, 0], [1, 2, 1], [0, 1, 3]]), cube.filter.convolve(("y", "x"), [[0, 1, 0], [1, 2, 1], [0, 1, 3]])),
        (algorithms.NLMeansFilter(r=1, h=2.0), cube.filter.nlmeans(r=1, h=2.0)),
        (algorithms.Resample(width=4), cube.resample(width=4)),
        (algorithms.Reprojection(crs="epsg:3857"), cube.reproject(crs="epsg:3857")),
    ):
        got, want = values(made.apply(cube)), values(want)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got), made
    assert values(algorithms.boxcar(cube, w=3)) == pytest.approx(values(cube.filter.boxcar(w=3)))
    names = [c.__name__ for c in algorithms.algorithms()]
    assert names == sorted(names) and {"OmnibusTest", "Alignment", "Coregistration", "NLMeansFilter"} <= set(names)
    assert algorithms.GaussianFilter(sigma=(1, 2)).halo("x") == 8 and algorithms.NLMeansFilter(r=(0, 2), f=1).halo("y") == 0 and algorithms.NLMeansFilter(r=(0, 2), f=1).halo("x") == 3
    assert algorithms.BoxcarFilter(w=5).halo("y") == 2 and algorithms.BoxcarFilter(w=5).halo("t") == 0 and algorithms.OmnibusTest(ml=3).halo("x") == 1
    with pytest.raises(ValueError):
        algorithms.BoxcarFilter(dims=("y", "q")).apply(cube)
    assert all(hasattr(tessera, n) for n in tessera.__all__)


def test_variables_that_lack_dims_pass_through(spark):
    image, series = cube_of(spark, np.arange(12.0).reshape(3, 4)), cube_of(spark, np.arange(5.0), ("t",), "s")
    data = Dataset.of(image, series)
    assert data.variables_with(["y", "x"]) == ["v"] and data.variables_with(["y"], invert=True) == ["s"] and data.dims == {"y": 3, "x": 4, "t": 5}
    out = algorithms.BoxcarFilter(w=3).apply(data)
    assert values(out["s"], "s") == values(series, "s") and values(out["v"]) == pytest.approx(values(image.filter.boxcar(w=3)))
    with pytest.raises(ValueError):
        algorithms.BoxcarFilter(dims=("q",)).apply(data)
    with pytest.raises(ValueError):
        Dataset.of(image, image)
    rows = cube_of(spark, np.array([7.0, 8.0, 9.0]), ("y",), "w")
    assert {(r.y, r.x, r.w) for r in Dataset.of(image, rows).merged().df.collect()} == {(y, x, 7.0 + y) for y in range(3) for x in range(4)}


def test_helpers():
    assert general.squeeze(np.array([3])) == 3 and general.squeeze([1]) == [1]
    people = [{"a": 1, "b": 2}, {"a": 2, "b": 2}, {"a": 1, "b": 1}]
    assert general.select(people, lambda o: o["a"] == 1) == [people[0], people[2]] and general.select(people, lambda o: o["a"] == 2) == people[1]
    assert general.select(people, lambda o: o["a"] == 9, first=True) is None and general.select({"x": 1, "y": 2}, lambda o: o > 1) == {"y": 2}
    assert list(general.dict_product({"a": [1, 2], "b": "xy"})) == [{"a": 1, "b": "x"}, {"a": 1, "b": "y"}, {"a": 2, "b": "x"}, {"a": 2, "b": "y"}]
    a = np.arange(10).reshape(2, 5)
    assert [c.shape for c in general.array_chunks(a, 2, 1)] == [(2, 2), (2, 2), (2, 1)]
    assert np.array_equal(np.concatenate([a[tuple(i)] for i, _ in general.array_chunks(a, 3, 1, True)], 1), a)
    with pytest.raises(ValueError):
        list(general.array_chunks(a, 1, 2))
    assert general.str2date("2017-03-04") == datetime.datetime(2017, 3, 4) and general.str2date("04/03/2017", "%d/%m/%Y") == datetime.datetime(2017, 3, 4)
    assert general.str2date("2017-03-04T05:00:00", tz=True).tzinfo is not None and general.str2date("2017-03-04T05:00:00+02:00").tzinfo is None
    k = np.arange(6).reshape(2, 3)
    assert general.expand_kernel(k, ("y", "x"), ("x", "t", "y")).shape == (3, 1, 2) and np.array_equal(general.expand_kernel(k, ("y", "x"), ("x", "t", "y"))[:, 0, :], k.T)
    with pytest.raises(ValueError):
        general.expand_kernel(k, ("y", "x"), ("y", "t"))


def test_dates_in_columns(spark):
    rows = [("2017-03-04",), ("20170304T050607",), ("04-MAR-2017".title(),), ("2017-03-04 05:06:07",), ("nothing",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(general.parse_date(F.col("s"))).collect()]
    assert got == [datetime.datetime(2017, 3, 4), datetime.datetime(2017, 3, 4, 5, 6, 7), datetime.datetime(2017, 3, 4), datetime.datetime(2017, 3, 4, 5, 6, 7), None, None]


def test_metadata_stand_in_for_coordinates(spark):
    cube = cube_of(spark, np.zeros((3, 5)))
    with pytest.raises(ValueError):
        cube.bounds
    given = Cube(cube.df, cube.dims, cube.variables, {}, {"transform": (2.0, 0, 10.0, 0, -1.0, 50.0), "coordinate_system_string": "epsg:3857"})
    assert given.bounds == (10.0, 48.0, 18.0, 50.0) and given.resolution == (2.0, 1.0) and given.transform[2] == 10.0 and given.crs.code == 3857 and cube.crs is None
    text = Cube(cube.df, cube.dims, cube.variables, {}, {"i2m": "2.0,0.0,0.0,-1.0,10.0,50.0"})
    assert text.bounds == given.bounds
    named = Cube(cube.df, cube.dims, cube.variables, {}, {"bounds": (1, 2, 3, 4), "res": (0.5, 0.5)})
    assert named.bounds == (1, 2, 3, 4) and named.resolution == (0.5, 0.5)


def test_british_grid(spark):
    """A point whose position the mapping agency publishes, in both systems."""
    crs = projection.parse("epsg:27700")
    lon, lat = 1 + 42 / 60 + 57.787 / 3600, 52 + 39 / 60 + 28.723 / 3600
    assert projection.forward(crs, lon, lat) == pytest.approx((651409.90, 313177.27), abs=0.5)
    assert projection.inverse(crs, *projection.forward(crs, lon, lat)) == pytest.approx((lon, lat), abs=1e-6)
    as_columns = spark.range(1).select(*projection.forward(crs, F.lit(lon), F.lit(lat))).first()
    assert tuple(as_columns) == pytest.approx(projection.forward(crs, lon, lat), abs=1e-6)


def test_common_extent(spark):
    a = cube_of(spark, np.zeros((3, 3)), coords={"y": (10.0, -1.0), "x": (0.0, 1.0)}, attrs={"crs": 4326})
    b = cube_of(spark, np.zeros((3, 3)), coords={"y": (9.0, -1.0), "x": (1.0, 1.0)}, attrs={"crs": 4326})
    assert warp.common_extent([a, b]) == (0.0, 7.0, 3.0, 10.0)
    assert warp.common_extent([a.reproject(crs=3857), b]) == pytest.approx((0.0, 7.0, 3.0, 10.0), abs=1e-6)


def test_features_with_dates(spark):
    square = lambda x, y: [[(x - 0.4, y - 0.4), (x + 0.4, y - 0.4), (x + 0.4, y + 0.4), (x - 0.4, y + 0.4)]]
    rows = [(0, square(0, 0), 5, "apple", "2018-01-31"), (1, square(1, 0), 6, "pear", "2018-02-28"), (2, square(1, 0), 7, "apple", "2018-02-28"), (3, square(2, 1), 8, "fig", None)]
    features = spark.createDataFrame(rows, f"feature_id long, geometry {vector.GEOMETRY}, n int, kind string, day string")
    cube = cube_of(spark, np.zeros((2, 3)), coords={"y": (0.0, 1.0), "x": (0.0, 1.0)}, attrs={"crs": 4326})
    out, legends = vector.rasterize(features, cube, ["n", "kind"], date_field="day")
    assert out.dims == {"y": 2, "x": 3, "t": 2} and out.attrs["time"] == ["2018-01-31T00:00:00", "2018-02-28T00:00:00"]
    found = {(r.y, r.x, r.t): (r.n, r.kind) for r in out.df.collect()}
    assert len(found) == 12 and {k: v for k, v in found.items() if v != (0, 0)} == {(0, 0, 0): (5, 1), (0, 1, 1): (7, 1)}
    assert {(r.code if "code" in r else r[0], r[1]) for r in legends["kind"].collect()} == {(1, "apple"), (2, "pear")}
    moved = vector.reprojected(features, 4326, 3857)
    again, _ = vector.rasterize(moved, cube, ["n"], date_field="day", crs=3857)
    assert {(r.y, r.x, r.t): r.n for r in again.df.collect()} == {k: v[0] for k, v in found.items()}
    with pytest.raises(ValueError):
        vector.rasterize(features, cube, ["n"], date_field="nothing")


def test_tiles_as_they_lie(spark):
    tiles = [cube_of(spark, np.zeros((2, 2)), coords={"y": (y, -1.0), "x": (x, 1.0)}) for x in (0.0, 2.0) for y in (5.0, 9.0, 7.0)]
    grid = tiling.sort_into_array(tiles, ["y", "x"])
    assert [[c.coords["y"][0] for c in row] for row in grid] == [[9.0, 9.0], [7.0, 7.0], [5.0, 5.0]] and grid[0, 1].coords["x"][0] == 2.0
    assert sorted(tiles, key=lambda c: tiling.sort_key(c, ["y", "x"]))[0].coords == {"y": (9.0, -1.0), "x": (0.0, 1.0)}


def test_merged_tiles(spark, tmp_path):
    """Tiles with halos, as cubes and as saved tiles, give the whole again; attributes become variables."""
    a = np.arange(9.0 * 8).reshape(9, 8)
    whole = cube_of(spark, a, coords={"y": (20.0, -1.0), "x": (0.0, 0.5)}, attrs={"crs": 4326})
    tiles = []
    for k, (y0, y1) in enumerate(((0, 6), (4, 9))):
        for j, (x0, x1) in enumerate(((0, 5), (3, 8))):
            part = whole.isel(y=slice(y0, y1), x=slice(x0, x1))
            edge = (F.col("y") == (y1 - y0 - 1 if k == 0 else 0)) | (F.col("x") == (x1 - x0 - 1 if j == 0 else 0))  # wrong where a filter would be
            part = part.assign(v=F.when(edge, -1.0).otherwise(F.col("v")))
            tiles.append(Cube(part.df, part.dims, part.variables, part.coords, {"crs": 4326, "orbit": "up" if k else "down", "pass": 1.0 * j}))
    out = rasters.auto_merge(tiles, meta_variables=["orbit", "pass"])
    assert out.dims == whole.dims and out.coords == whole.coords and out.attrs == {"crs": 4326, "legend": {"orbit": ["down", "up"]}}
    rows = out.df.collect()
    assert {(r.y, r.x): r.v for r in rows} == values(whole) and {(r.y > 4, r.orbit) for r in rows if r.y not in (4, 5)} == {(False, 0), (True, 1)}
    for k, c in enumerate(tiles):
        c.save(f"{tmp_path}/part.{k}")
    merged = rasters.map_over_tiles(spark, f"{tmp_path}/part.*", lambda c, by: c.assign(v=F.col("v") * by), args=(2,), path=str(tmp_path / "out"), suffix=".x")
    assert values(merged) == {k: 2 * v for k, v in values(whole).items()}
    again = rasters.map_over_tiles(spark, f"{tmp_path}/part.*", lambda c: c, path=str(tmp_path / "out"), suffix=".x", merge=False)
    assert [p.rsplit("/", 1)[1] for p in again] == [f"part.{k}.x_new" for k in range(4)]
    stack = rasters.auto_merge([whole, whole])
    assert stack.dims == {"y": 9, "x": 8, "t": 2}
    with pytest.raises(ValueError):
        rasters.auto_merge(f"{tmp_path}/nothing.*", spark=spark)


def test_video(spark, tmp_path):
    a = np.arange(2 * 3 * 5, dtype=float).reshape(3, 5, 2)
    cube = cube_of(spark, a, ("y", "x", "t"))
    visual.write_video(cube, str(tmp_path / "a.avi"), channels=[F.col("v")], vmin=0, vmax=29)
    raw = (tmp_path / "a.avi").read_bytes()
    assert raw[:4] == b"RIFF" and struct.unpack("<I", raw[4:8])[0] == len(raw) - 8 and raw.count(b"00db") == 4
    for k in range(2):
        at = [i for i in range(len(raw)) if raw[i : i + 4] == b"00db"][k]
        picture = np.frombuffer(raw[at + 8 : at + 8 + 16 * 3], np.uint8).reshape(3, 16)[::-1, :15].reshape(3, 5, 3)
        assert (picture == (a[:, :, k] / 29 * 255).astype(int)[:, :, None]).all()


def test_pictures(spark):
    labels = Cube.of(spark.createDataFrame([(0, 0, 1), (0, 1, 5), (0, 2, None)], "y int, x int, c int"), {"y": 1, "x": 3})
    assert [tuple(r)[2:] for r in visual.coloured(labels, "c", [(1, 2, 3), (4, 5, 6)]).orderBy("x").collect()] == [(4, 5, 6), (4, 5, 6), (0, 0, 0)]
    cube = cube_of(spark, np.arange(4.0).reshape(2, 2))
    mapped = visual.colour_mapped(cube, "v", [(0, 0, 9), (9, 0, 0)], vmin=0, vmax=3)
    assert [tuple(r)[2:] for r in mapped.orderBy("y", "x").collect()] == [(0, 0, 9)] * 3 + [(9, 0, 0)]
    big = visual.scaled(cube.df, (2, 2), (4, None))
    assert {(r.y, r.x): r.v for r in big.collect()} == {(y, x): float(y // 2 * 2 + x // 2) for y in range(4) for x in range(4)}


def tiff(image, tile=None, way=1, differences=False):
    """A little-endian TIFF of one band of 16-bit numbers, in strips of two rows or in tiles."""
    h, w = image.shape
    high, wide = tile or (2, w)
    blocks = []
    for y in range(0, h, high):
        for x in range(0, w, wide):
            part = image[y : y + high, x : x + wide]
            if tile:
                part = np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1])))
            if differences:
                part = np.concatenate([part[:, :1], np.diff(part.astype(int), axis=1)], 1)
            raw = part.astype("<u2").tobytes()
            if way == 32773:
                raw = b"".join(bytes([len(raw[k : k + 100]) - 1]) + raw[k : k + 100] for k in range(0, len(raw), 100))
            blocks.append(zlib.compress(raw) if way == 8 else raw)
    tags = [(256, 3, [w]), (257, 3, [h]), (258, 3, [16]), (259, 3, [way]), (277, 3, [1]), (317, 3, [2 if differences else 1])]
    tags += [(322, 3, [wide]), (323, 3, [high])] if tile else [(278, 3, [high])]
    tags += [(324 if tile else 273, 4, None), (325 if tile else 279, 4, [len(b) for b in blocks]), (33550, 12, [0.5, 0.25, 0]), (33922, 12, [0, 0, 0, 10, 20, 0]), (34735, 3, [1, 1, 0, 1, 3072, 0, 1, 3857])]
    tags.sort()
    kinds, place = {3: "H", 4: "I", 12: "d"}, 8 + 2 + 12 * len(tags) + 4
    space = sum(n for n in (struct.calcsize("<" + kinds[k] * (len(v) if v else len(blocks))) for _, k, v in tags) if n > 4)
    starts = np.cumsum([0] + [len(b) for b in blocks])[:-1] + place + space
    out, extra = b"II*\0" + struct.pack("<IH", 8, len(tags)), b""
    for tag, kind, v in tags:
        v = v or starts.tolist()
        raw = struct.pack("<" + kinds[kind] * len(v), *v)
        if len(raw) > 4:
            raw, extra = struct.pack("<I", place + len(extra)), extra + raw
        out += struct.pack("<HHI", tag, kind, len(v)) + raw.ljust(4, b"\0")
    return out + b"\0" * 4 + extra + b"".join(blocks)


@pytest.mark.parametrize("kw", [{}, {"way": 8}, {"way": 8, "differences": True}, {"tile": (16, 16)}, {"tile": (16, 16), "way": 8, "differences": True}, {"way": 32773}])
def test_tiffs(spark, tmp_path, kw):
    image = np.random.default_rng(2).integers(0, 60_000, (21, 37))
    (tmp_path / "a.tif").write_bytes(tiff(image, **kw))
    cube = rasters.open_geotiff(spark, str(tmp_path / "a.tif"))
    got = np.zeros(image.shape)
    for r in cube.df.collect():
        got[r.y, r.x] = r.data
    assert np.array_equal(got, image) and cube.coords == {"x": (10.0, 0.5), "y": (20.0, -0.25)} and cube.attrs["crs"] == 3857
