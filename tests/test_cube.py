import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.cube import Cube
from tessera.functions import projection
from tessera.functions.edges import fold
from tessera.operators import change, classify, nlmeans, reduce, stencil, tiling, vector, visual, warp
from tessera.operators.apply import apply, parse
from tessera.algorithm import Algorithm, as_function
from tessera.sources import rasters


def cube_of(spark, a, dims=("y", "x"), name="v", **kw):
    return rasters.from_array(spark, np.asarray(a, float), dims, name, **kw)


def array_of(cube, name="v"):
    pdf = cube.df.toPandas()
    out = np.full(cube.shape, np.nan)
    out[tuple(pdf[d].to_numpy() for d in cube.dims)] = pdf[name].to_numpy(float)
    return out


def gathered(a, kernel, mode):
    out = np.zeros(a.shape)
    for p in np.ndindex(a.shape):
        for j in np.ndindex(kernel.shape):
            at = [fold(p[d] + kernel.shape[d] // 2 - j[d], a.shape[d], mode) for d in range(a.ndim)]
            out[p] += kernel[j] * (0.0 if None in at else a[tuple(at)])
    return out


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(42).normal(size=(7, 6))


@pytest.mark.parametrize("mode", ["reflect", "mirror", "nearest", "wrap", "constant"])
@pytest.mark.parametrize("shape", [(3, 5), (2, 3), (5, 1)])
def test_convolution(spark, noise, mode, shape):
    kernel = np.random.default_rng(1).normal(size=shape)
    got = array_of(cube_of(spark, noise).filter.convolve(("y", "x"), kernel, mode=mode))
    assert np.allclose(got, gathered(noise, kernel, mode))


def test_kernel_longer_than_axis(spark):
    a = np.arange(6.0).reshape(2, 3)
    kernel = np.ones((9, 9)) + np.eye(9)
    assert np.allclose(array_of(cube_of(spark, a).filter.convolve(("y", "x"), kernel)), gathered(a, kernel, "reflect"))


def test_identity_and_errors(spark, noise):
    cube = cube_of(spark, noise)
    one = np.zeros((3, 3))
    one[1, 1] = 1
    assert np.allclose(array_of(cube.filter.convolve(("y", "x"), one)), noise)
    assert cube.filter.convolve(("y", "x"), 1.0) is cube
    with pytest.raises(ValueError):
        cube.filter.convolve(("y",), one)
    with pytest.raises(ValueError):
        cube.filter.convolve(("y", "z"), one)


def test_boxcar_and_gaussian_are_separable(spark, noise):
    cube = cube_of(spark, noise)
    assert np.allclose(array_of(cube.filter.boxcar(("y", "x"), 3)), gathered(noise, np.full((3, 3), 1 / 9), "reflect"))
    w = np.array([v for _, v in sorted(stencil.gaussian_weights(0.7).items())])
    assert np.allclose(array_of(cube.filter.gaussian(("y", "x"), 0.7)), gathered(noise, np.outer(w, w), "reflect"))


def test_missing_cells_spread_in_filters_and_not_in_means(spark, noise):
    a = noise.copy()
    a[3, 3] = np.nan
    got = array_of(cube_of(spark, a).filter.boxcar(("y", "x"), 3))
    assert np.isnan(got[2:5, 2:5]).all() and np.isfinite(got).sum() == got.size - 9
    assert cube_of(spark, a).reduce("count").df.first()["v"] == a.size - 1


def test_complex_filter(spark, noise):
    cube = cube_of(spark, noise).assign(c=F.struct(F.col("v").alias("re"), (F.col("v") * 2).alias("im"))).select("c")
    out = cube.filter.boxcar(("y", "x"), 3)
    assert out.is_complex
    got = out.split_complex()
    assert np.allclose(array_of(got, "c__im"), 2 * array_of(got, "c__re"))


def nlm_direct(a, r, f, sigma, h):
    out = np.zeros(a.shape)
    at = lambda y, x: a[fold(y, a.shape[0], "mirror"), fold(x, a.shape[1], "mirror")]
    for y, x in np.ndindex(a.shape):
        w, v = [], []
        for dy in range(-r, r + 1):
            for dx in range(-r, r + 1):
                if dy or dx:
                    d = np.mean([(at(y + i, x + j) - at(y + dy + i, x + dx + j)) ** 2 for i in range(-f, f + 1) for j in range(-f, f + 1)])
                    w.append(np.exp(-max(d - 2 * sigma**2, 0) / h**2))
                    v.append(at(y + dy, x + dx))
        own = max(w) or 1.0
        out[y, x] = (np.dot(w, v) + own * a[y, x]) / (sum(w) + own)
    return out


def test_nlmeans(spark, noise):
    cube = cube_of(spark, noise)
    assert np.allclose(array_of(cube.filter.nlmeans(("y", "x"), r=1, f=1, sigma=0.3, h=0.8)), nlm_direct(noise, 1, 1, 0.3, 0.8))
    assert cube.filter.nlmeans(("y", "x"), r=0) is cube
    own, none, zero = nlmeans.self_weight(np.array([3.0, 3.0, 0.0]), np.array([2.0, 9.0, 0.0]), np.array([4.0]))
    assert (3 + own) ** 2 / (2 + own**2) == pytest.approx(4.0) and np.isnan(none) and np.isnan(zero)


def test_nlmeans_of_tiles(spark, monkeypatch):
    """Small tiles and a gap give what one tile gives; many variables and dims by plain loops."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=(11, 13, 5, 2))
    places = list(np.ndindex(11, 13, 5))
    rows = [(*p, float(a[p][0]), float(a[p][1])) for p in places]
    cube = Cube.of(spark.createDataFrame(rows, "y int, x int, t int, a double, b double"), {"y": 11, "x": 13, "t": 5})
    args = {"dims": ("t", "y", "x"), "r": (1, 2, 2), "f": 1, "sigma": 0.2, "h": 0.7}
    whole = {(r.y, r.x, r.t): (r.a, r.b) for r in cube.filter.nlmeans(**args).df.collect()}
    monkeypatch.setattr(nlmeans, "TILE_OF_MANY", 4)
    parts = {(r.y, r.x, r.t): (r.a, r.b) for r in cube.filter.nlmeans(**args).df.collect()}
    assert whole.keys() == parts.keys() == set(places) and all(np.allclose(whole[p], parts[p]) for p in places)
    for p in places[::37]:
        at = lambda q: a[tuple(fold(i, n, "mirror") for i, n in zip(q, (11, 13, 5)))]
        w, v = [], []
        for q in np.ndindex(5, 5, 3):
            o = np.array(q) - (2, 2, 1)
            if o.any():
                d = np.mean([(at(np.array(p) + s) - at(np.array(p) + o + s)) ** 2 for s in (np.array(m) - 1 for m in np.ndindex(3, 3, 3))])
                w.append(np.exp(-max(d - 0.08, 0) / 0.49))
                v.append(at(np.array(p) + o))
        assert np.allclose(whole[p], (np.dot(w, np.array(v)) + max(w) * a[p]) / (sum(w) + max(w)))
    far = Cube.of(spark.createDataFrame([(0, k, 1000.0 * k) for k in range(6)], "y int, x int, v double"), {"y": 1, "x": 6})
    assert [r.v for r in far.filter.nlmeans(("y", "x"), r=(0, 1), n_eff=2).df.collect()] == [None] * 6  # all weights are 0
    assert array_of(far.filter.nlmeans(("y", "x"), r=(0, 1)), "v").tolist() == [[1000.0 * k for k in range(6)]]
    gap = Cube.of(spark.createDataFrame([(0, k, 1.0) for k in range(9) if k != 4], "y int, x int, v double"), {"y": 1, "x": 9})
    assert {r.x for r in gap.filter.nlmeans(("y", "x"), r=(0, 1)).df.where("v is null").collect()} == {2, 3, 4, 5, 6}


def test_omnibus_step_change(spark):
    rng = np.random.default_rng(42)
    means = {"c11": (1, 10), "c12i": (0, 0), "c12r": (0, 0), "c22": (1, 10)}
    parts = {v: np.concatenate([rng.normal(m, 0.1, (5, 5, 5)) for m in pair], 2) for v, pair in means.items()}
    cube = None
    for v, a in parts.items():
        one = cube_of(spark, a, ("y", "x", "t"), v)
        cube = one if cube is None else Cube(cube.df.join(one.df, ["y", "x", "t"]), cube.dims, (*cube.variables, v))
    got = array_of(cube.change_omnibus(n=9, alpha=0.9), "change").astype(bool)
    assert got[:, :, 5].all() and got.sum() == 25


def test_chi2():
    assert change.chi2_cdf(np.array([0.0, 7.779440339734858, np.inf, -1.0]), 4) == pytest.approx([0, 0.9, 1, 0])


def test_split_merge_round_trip(spark):
    a = np.arange(5 * 7 * 6, dtype=float).reshape(5, 7, 6)
    cube = cube_of(spark, a, ("y", "x", "t"))
    for size, buffer in (({"t": 2}, 0), ({"y": 2, "x": 3}, 1), ({"x": 100}, 5), ({"t": 4}, {"t": 3})):
        tiles = tiling.split(cube, size, buffer)
        assert np.array_equal(array_of(tiling.merge(tiles, cube)), a)
    with pytest.raises(ValueError):
        tiling.split(cube, {"q": 2})


def test_block_split_is_array_split(spark):
    for n, blocks in ((30, 7), (10, 3), (6, 4)):
        got = [r[0] for r in spark.range(n).select(tiling.block_of(F.col("id"), n, blocks)).collect()]
        assert got == [k for k, part in enumerate(np.array_split(np.arange(n), blocks)) for _ in part]


def test_tiles_on_disk_stay_as_they_are(spark, tmp_path):
    cube = cube_of(spark, np.ones((4, 4)))
    tiles = tiling.split(cube, {"y": 2}).select("tile_y", "y", "x", "v")
    tiling.write_tiles(tiles.where("tile_y = 0"), str(tmp_path / "t"), ["tile_y"])
    tiling.write_tiles(tiles.withColumn("v", F.lit(5.0)), str(tmp_path / "t"), ["tile_y"])
    assert {(r[0], r[1]) for r in spark.read.parquet(str(tmp_path / "t")).select("tile_y", "v").distinct().collect()} == {(0, 1.0), (1, 5.0)}


def test_saved_cube(spark, tmp_path, noise):
    cube = cube_of(spark, noise, coords={"y": (5.0, -1.0), "x": (0.0, 2.0)}, attrs={"crs": 4326})
    cube.save(str(tmp_path / "c"))
    back = rasters.open_dataset(spark, str(tmp_path / "c"))
    assert np.array_equal(array_of(back), noise) and back.coords == cube.coords and back.bounds == (0.0, -1.0, 10.0, 5.0)
    with pytest.raises(OSError):
        rasters.open_dataset(spark, str(tmp_path / "nothing"))


def test_netcdf_and_envi(spark, tmp_path, noise):
    cube = cube_of(spark, noise, coords={"y": (5.0, -1.0), "x": (0.0, 2.0)}, attrs={"title": "t"})
    rasters.to_netcdf(cube, str(tmp_path / "a.nc"))
    back = rasters.open_dataset(spark, str(tmp_path / "a.nc"))
    assert np.array_equal(array_of(back), noise) and back.coords["y"] == (5.0, -1.0)
    (tmp_path / "b.hdr").write_text("ENVI\nsamples = 6\nlines = 7\nbands = 1\ndata type = 4\ninterleave = bsq\nbyte order = 1\nmap info = {g, 1, 1, 10, 20, 0.5, 0.25, WGS-84}\n")
    (tmp_path / "b.img").write_bytes(noise.astype(">f4").tobytes())
    envi = rasters.open_dataset(spark, str(tmp_path / "b.img"))
    assert np.allclose(array_of(envi, "data"), noise.astype("f4")) and envi.coords == {"x": (10.0, 0.5), "y": (20.0, -0.25)}


def test_dimap(spark, tmp_path, noise):
    (tmp_path / "s.data").mkdir()
    for b in ("C11", "C12_real", "C12_imag"):
        (tmp_path / "s.data" / f"{b}.hdr").write_text("ENVI\nsamples = 6\nlines = 7\nbands = 1\ndata type = 4\nbyte order = 1\n")
        (tmp_path / "s.data" / f"{b}.img").write_bytes(noise.astype(">f4").tobytes())
    bands = "".join(f"<Spectral_Band_Info><BAND_NAME>{b}</BAND_NAME></Spectral_Band_Info>" for b in ("C11", "C12_real", "C12_imag"))
    (tmp_path / "s.dim").write_text(f"<D><Production><PRODUCT_SCENE_RASTER_START_TIME>01-JAN-2017 10:00:00.5</PRODUCT_SCENE_RASTER_START_TIME></Production><R><NCOLS>6</NCOLS><NROWS>7</NROWS></R>{bands}</D>")
    cube = rasters.add_time(rasters.open_dataset(spark, str(tmp_path / "s.dim")))
    assert cube.is_complex and set(cube.variables) == {"C12", "C11", "time"} and str(cube.df.first()["time"]).startswith("2017-01-01 10")


def test_projections_round_trip():
    for code in (4326, 3857, 3395, 2163, 3086, 32630, "+proj=sinu +lon_0=-5", {"proj": "tmerc", "lon_0": "-3"}):
        crs = projection.parse(code)
        lon, lat = (-84.5, 30.1) if code in (2163, 3086) else (-4.2, 51.3)
        back = projection.inverse(crs, *projection.forward(crs, lon, lat))
        assert back == pytest.approx((lon, lat), abs=1e-6), code
    x, _ = projection.forward(projection.parse(32630), -3.0, 51.3)
    assert x == pytest.approx(500_000)
    assert projection.forward(projection.parse(3857), 180.0, 0.0)[0] == pytest.approx(20037508.342789244)
    with pytest.raises(projection.CRSError):
        projection.parse("EPSG:999999")


def test_identity_resample_and_align(spark, noise):
    cube = cube_of(spark, noise, coords={"y": (6.0, -1.0), "x": (0.0, 1.0)}, attrs={"crs": 4326})
    assert np.allclose(array_of(warp.resample(cube, width=6, height=7)), noise)
    assert np.allclose(array_of(warp.reproject(cube, target=cube)), noise)
    with pytest.raises(ValueError):
        warp.reproject(cube, transform=(1, 0, 0, 0, 1, 0))
    with pytest.raises(ValueError):
        reduce.common_resolution([cube], "median")


def test_coregistration(spark):
    rng = np.random.default_rng(3)
    base = warp.shifted(rng.normal(size=(40, 40)), (0, 0))
    base = stencil_smooth(base)
    moves = [(0.0, 0.0), (0.4, 0.7), (-1.3, 2.2)]
    series = np.stack([warp.shifted(base, m) for m in moves], 2)
    cube = cube_of(spark, series, ("y", "x", "t"), "c11")
    found = {r["t"]: (r["dy"], r["dx"]) for r in warp.shifts(cube, upsampling=20).collect()}
    for t, m in enumerate(moves):
        assert found[t] == pytest.approx((-m[0], -m[1]), abs=0.2)
    done = array_of(warp.coregister(cube, upsampling=20), "c11")
    assert np.abs(done - base[:, :, None]).max() < 0.5 * np.abs(series - base[:, :, None]).max()


def stencil_smooth(a):
    return sum(np.roll(np.roll(a, i, 0), j, 1) for i in range(3) for j in range(3)) / 9


def test_classifier_on_two_classes(spark):
    rng = np.random.default_rng(0)
    labels = np.where(np.arange(10) < 5, 2, 1)[None, :].repeat(6, 0)
    a = rng.normal(np.where(labels == 2, 1.0, 10.0), 0.1)
    cube = cube_of(spark, a)
    truth = cube_of(spark, labels, name="label").df.withColumn("label", F.col("label").cast("int"))
    for model in (classify.GaussianNB(), classify.NearestCentroid()):
        c = classify.Classifier(model, scale=True).fit(cube, truth, ["y", "x"])
        assert c.score(cube, truth, ["y", "x"]) == 1.0
    with pytest.raises(AttributeError):
        c.predict(cube, "predict_log")
    with pytest.raises(ValueError):
        c.score(cube, truth, ["y", "x"], "nothing")


def test_knn_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(classify, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 3))
    y = rng.integers(1, 4, 120)
    df = spark.createDataFrame([(int(k), *map(float, r), int(c)) for k, (r, c) in enumerate(zip(x, y))], "vec_id long, a double, b double, c double, label int")
    got = {r["vec_id"]: r["predicted"] for r in classify.KNeighbors(3).fit(df.where("vec_id >= 40"), ["a", "b", "c"]).predict(df.where("vec_id < 40"), "vec_id").collect()}
    for k in range(40):
        near = np.argsort(((x[40:] - x[k]) ** 2).sum(1))[:3]
        counts = np.bincount(y[40:][near])
        assert got[k] == counts.argmax()


def test_rasterize_square(spark):
    ring = [(1.5, 1.5), (4.5, 1.5), (4.5, 3.5), (1.5, 3.5)]
    features = spark.createDataFrame([(1, [ring], "pear"), (2, [[(2.5, 2.5), (9.5, 2.5), (9.5, 9.5), (2.5, 9.5)]], "apple")], f"feature_id long, geometry {vector.GEOMETRY}, kind string")
    grid = Cube(spark.range(0), {"y": 8, "x": 8}, (), {"y": (0.0, 1.0), "x": (0.0, 1.0)})
    cube, legends = vector.rasterize(features, grid, ["kind"])
    want = np.zeros((8, 8))
    want[2:4, 2:5] = 1
    want[3:, 3:] = 2
    assert np.array_equal(array_of(cube, "kind"), want)
    assert {(r[0], r[1]) for r in legends["kind"].collect()} == {(1, "pear"), (2, "apple")}
    assert [r[0] for r in vector.clip(features, 5, 5, 6, 6).select("feature_id").collect()] == [2]


def test_geojson(spark, tmp_path):
    (tmp_path / "f.geojson").write_text(vector.to_geojson([{"properties": {"name": "a"}, "rings": [[[0, 0], [2, 0], [2, 2], [0, 0]]]}]))
    row = vector.read_geojson(spark, str(tmp_path / "f.geojson"), "name:string").first()
    assert row["name"] == "a" and len(row["geometry"][0]) == 4


def test_pictures(spark, tmp_path):
    ramp = cube_of(spark, np.arange(100.0).reshape(10, 10))
    got = array_of(Cube(visual.rgb(ramp, [F.col("v")], pmin=0, pmax=100), ramp.dims, ("grey",)), "grey")
    assert np.array_equal(got, np.floor(np.arange(100) / 99 * 255).reshape(10, 10))
    assert visual.calculate_shape((None, 120), (40, 60)) == (80, 120) and visual.calculate_shape((60, None), (40, 60)) == (60, 90)
    visual.write_png(ramp.df.select("y", "x", *[F.lit(9).alias(c) for c in "rgb"]), 10, 10, str(tmp_path / "p.png"))
    assert (tmp_path / "p.png").read_bytes()[:4] == b"\x89PNG"
    with pytest.raises(ValueError):
        visual.write_video(cube_of(spark, np.zeros((3, 3, 1)), ("y", "x", "t")), str(tmp_path / "v.avi"), limit=8)


def test_apply_signatures(spark, noise):
    cube = cube_of(spark, noise.reshape(7, 3, 2), ("y", "x", "t"))
    a = noise.reshape(7, 3, 2)
    assert np.allclose(array_of(apply(cube, np.median, "(y)->()")), np.median(a, 0))
    assert np.allclose(array_of(apply(cube, lambda z: z - z.mean(), "(t, y) -> (t, y)")), a - a.mean((0, 2), keepdims=True))
    with pytest.raises(ValueError):
        parse("(t)->(q)")
    with pytest.raises(ValueError):
        parse("t->t")


def test_algorithm_front(spark, noise):
    class Twice(Algorithm):
        def __init__(self, by=2):
            self.by = by

        def apply(self, cube):
            return cube.assign(v=F.col("v") * self.by)

    assert np.allclose(array_of(as_function(Twice, "twice")(cube_of(spark, noise), by=3)), 3 * noise)
    with pytest.raises(ValueError):
        as_function(dict, "d")


def test_empty_and_single(spark):
    assert array_of(cube_of(spark, [[4.0]]).filter.boxcar(("y", "x"), 3))[0, 0] == pytest.approx(4.0)
    empty = Cube(spark.createDataFrame([], "y int, x int, v double"), {"y": 2, "x": 2}, ("v",))
    assert np.isnan(array_of(empty.densify())).all()


def test_streams(spark, tmp_path):
    from tessera.streaming import cubes

    rows = [(f"2024-01-01 00:{m:02d}:00", m % 2, float(m)) for m in range(60)]
    src = spark.createDataFrame(rows, "ts string, k int, value double").withColumn("ts", F.to_timestamp("ts"))
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = cubes.windowed_cells(stream, {"k": F.col("k")}, "value", width="30 minutes").writeStream.format("memory").queryName("cells").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["k"], r["n"]) for r in spark.table("cells").collect()} == {(0, 15), (1, 15)}
    q = cubes.level_shifts(stream.withColumn("value", F.when(F.col("value") == 59, 1e4).otherwise(F.col("value"))), "k", "value").writeStream.format("memory").queryName("shifts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["k"], r["value"]) for r in spark.table("shifts").collect()] == [(1, 1e4)]


def test_learners_without_sql_take_whole_vectors(spark, monkeypatch):
    """Forest and k-means learn from all dimensions, and every vector gets a prediction."""
    from tessera.operators import classify
    from tessera.plans import queries

    sf, seen, fit = "/root/testdata/sf0.001", [], classify.Estimator.fit
    monkeypatch.setattr(classify.Estimator, "fit", lambda self, df, features, *a: seen.append(list(features)) or fit(self, df, features, *a))
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    assert sorted(r.vec_id for r in queries.rf_predict(spark, sf).collect()) == sorted(r.vec_id for r in e)
    assert sum(r["count"] for r in queries.kmeans_fit(spark, sf).collect()) == len(e)
    assert seen == [[f"f{k}" for k in range(len(e[0].embedding))]] * 2
