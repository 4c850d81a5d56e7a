"""One query for each operator, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cube import Cube
from ..dataset import Dataset
from ..functions import projection
from ..functions.edges import fold_sql
from ..functions.general import parse_date
from ..operators import apply, change, classify, nlmeans, reduce, stencil, tiling, vector, visual, warp
from .cubes import EV, IMAGE, LI, NT, NX, NY, event_cube, image, lineitem_cube, r, rounded, rs, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# -- cubes -----------------------------------------------------------------------------------

@query(f"WITH {LI} SELECT y, x, t, {rs('c11')} AS c11, {rs('c22')} AS c22, {rs('c12r')} AS c12r, {rs('c12i')} AS c12i FROM li")
def cube_build(spark, sf):
    return rounded(lineitem_cube(spark, sf).df, "y", "x", "t")


@query(f"""WITH {LI}, g AS (SELECT CAST(i // 300 AS INTEGER) AS y, CAST(i // 30 % 10 AS INTEGER) AS x, CAST(i % 30 AS INTEGER) AS t FROM range(3000) AS s(i))
SELECT g.y, g.x, g.t, {rs('coalesce(c11, -1)')} AS c11 FROM g LEFT JOIN li ON g.y = li.y AND g.x = li.x AND g.t = li.t""")
def densify_fill(spark, sf):
    cube = lineitem_cube(spark, sf).select("c11")
    wide = Cube(cube.df, {"y": NY, "x": NX, "t": 30}, ("c11",))
    return rounded(wide.densify(-1.0).df, "y", "x", "t")


@query(f"WITH {LI} SELECT y - 2 AS y, CAST((x - 1) // 2 AS INTEGER) AS x, {rs('c11')} AS c11 FROM li WHERE y BETWEEN 2 AND 6 AND x % 2 = 1 AND t = 4")
def isel_slice(spark, sf):
    return rounded(lineitem_cube(spark, sf).select("c11").isel(y=slice(2, 7), x=slice(1, None, 2), t=4).df, "y", "x")


@query(f"WITH {LI} SELECT y, x, {rs('avg(c11)')} AS c11 FROM li WHERE t BETWEEN 8 AND 11 GROUP BY y, x")
def sel_year_mean(spark, sf):
    cube = lineitem_cube(spark, sf).select("c11").isel(t=slice(8, 12)).reduce("mean", "t")
    return rounded(cube.df, "y", "x")


@query(f"WITH {LI} SELECT y, x, {rs('avg(c11)')} AS c11, {rs('avg(c22)')} AS c22, {rs('avg(c12r)')} AS c12r, {rs('avg(c12i)')} AS c12i FROM li GROUP BY y, x")
def reduce_mean_time(spark, sf):
    return rounded(lineitem_cube(spark, sf).reduce("mean", "t").df, "y", "x")


@query(f"WITH {LI} SELECT t, {rs('stddev_pop(c11)')} AS c11, {rs('stddev_pop(c22)')} AS c22 FROM li GROUP BY t")
def reduce_std_space(spark, sf):
    return rounded(lineitem_cube(spark, sf).select("c11", "c22").reduce("std", "y", "x").df, "t")


@query(f"WITH {LI}, k AS (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY c11 DESC, t) AS rn FROM li) SELECT y, x, t FROM k WHERE rn = 1")
def argmax_time(spark, sf):
    return lineitem_cube(spark, sf).argmax("c11", "t").df


@query(f"WITH {LI} SELECT y, x, t, {rs('c11 / c22')} AS ratio, {rs('c11 - 273.15')} AS celsius FROM li")
def var_ratio(spark, sf):
    cube = lineitem_cube(spark, sf).assign(ratio=F.try_divide("c11", "c22"), celsius=F.col("c11") - 273.15)
    return rounded(cube.select("ratio", "celsius").df, "y", "x", "t")


@query(f"WITH {LI} SELECT y, x, t, {rs('c12r')} AS c12__re, {rs('c12i')} AS c12__im FROM li WHERE c11 > 25")
def complex_roundtrip(spark, sf):
    cube = lineitem_cube(spark, sf)
    cube = cube.assign(c12__re=F.col("c12r"), c12__im=F.col("c12i"))
    kept = Cube(cube.df.where("c11 > 25"), cube.dims, ("c12__re", "c12__im")).join_complex()
    return rounded(kept.split_complex().select("c12__re", "c12__im").df, "y", "x", "t")


@query(f"""WITH {LI} SELECT y, x, t, 'c11' AS variable, {rs('c11')} AS value FROM li UNION ALL SELECT y, x, t, 'c22', {rs('c22')} FROM li""")
def pivot_vars(spark, sf):
    return rounded(lineitem_cube(spark, sf).select("c11", "c22").to_long(), "y", "x", "t", "variable")


@query(f"WITH {LI} SELECT y, x, " + ", ".join(f"{rs(f'max(CASE WHEN t = {k} THEN c11 END)')} AS t{k}" for k in range(NT)) + " FROM li GROUP BY y, x")
def expand_variables(spark, sf):
    cube = lineitem_cube(spark, sf).select("c11").expand_variables("t", "c11", range(NT))
    return rounded(cube.df.select("y", "x", *[F.col(str(k)).alias(f"t{k}") for k in range(NT)]), "y", "x")


@query(f"""WITH {EV} SELECT band, CAST(min(x) AS DOUBLE) AS "left", CAST(min(y) AS DOUBLE) AS bottom, CAST(max(x) AS DOUBLE) AS "right", CAST(max(y) AS DOUBLE) AS top,
 {rs('(max(x) - min(x)) / (count(DISTINCT x) - 1)')} AS xres, {rs('(max(y) - min(y)) / (count(DISTINCT y) - 1)')} AS yres FROM ev GROUP BY band""")
def bounds_resolution_transform(spark, sf):
    ev = event_cube(spark, sf).select("band", F.col("x").cast("double"), F.col("y").cast("double"))
    return rounded(reduce.grid_summary(ev, ["band"]), "band")


@query(f"""WITH {EV}, b AS (SELECT band, min(x) AS l, min(y) AS b, max(x) AS r, max(y) AS t FROM ev GROUP BY band)
SELECT CAST(min(l) AS INTEGER) AS "left", CAST(min(b) AS INTEGER) AS bottom, CAST(max(r) AS INTEGER) AS "right", CAST(max(t) AS INTEGER) AS top FROM b""")
def common_bounds(spark, sf):
    each = event_cube(spark, sf).groupBy("band").agg(F.min("x").alias("l"), F.min("y").alias("b"), F.max("x").alias("r"), F.max("y").alias("t"))
    return each.agg(F.min("l").alias("left"), F.min("b").alias("bottom"), F.max("r").alias("right"), F.max("t").alias("top"))


@query("""WITH a AS (SELECT l_returnflag AS src, l_linestatus AS v, count(*) AS n FROM lineitem GROUP BY 1, 2),
 k AS (SELECT src, 'status' || v AS key, CASE WHEN n > 0 THEN 'some' ELSE 'none' END AS value FROM a)
 SELECT key, min(value) AS value FROM k GROUP BY key HAVING count(DISTINCT src) = (SELECT count(DISTINCT l_returnflag) FROM lineitem) AND count(DISTINCT value) = 1""")
def common_attrs(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("src"), F.col("l_linestatus").alias("v")).agg(F.count("*").alias("n"))
    attrs = counts.select("src", F.concat(F.lit("status"), "v").alias("key"), F.when(F.col("n") > 0, "some").otherwise("none").alias("value"))
    return reduce.common_attributes(attrs, "src")


# -- splitting and tiles -----------------------------------------------------------------------

@query(f"WITH {LI} SELECT y, x, t, {rs('c11')} AS c11 FROM li")
def xr_split_merge(spark, sf):
    cube = lineitem_cube(spark, sf).select("c11")
    tiles = tiling.split(cube, {"t": tiling.chunk_size(NT, 3)}, buffer=2)
    return rounded(tiling.merge(tiles, cube).df, "y", "x", "t")


_HALO = "greatest(0, CAST(floor(({d} - 1) / {s}.0) AS INTEGER)), least({top}, CAST(floor(({d} + 1) / {s}.0) AS INTEGER)) + 1"


@query(f"""WITH {LI}, a AS (SELECT y, x, t, unnest(range({_HALO.format(d='y', s=4, top=2)})) AS ty FROM li), b AS (SELECT *, unnest(range({_HALO.format(d='x', s=3, top=3)})) AS tx FROM a)
 SELECT CAST(ty AS INTEGER) AS tile_y, CAST(tx AS INTEGER) AS tile_x, count(*) AS cells, sum(CASE WHEN ty = y // 4 AND tx = x // 3 THEN 1 ELSE 0 END)::BIGINT AS core FROM b GROUP BY 1, 2""")
def halo_owner_map(spark, sf):
    tiles = tiling.split(lineitem_cube(spark, sf), {"y": 4, "x": 3}, buffer=1)
    return tiles.groupBy("tile_y", "tile_x").agg(F.count("*").alias("cells"), F.sum(F.col("is_core").cast("long")).alias("core"))


@query(f"WITH {LI} SELECT y, x, t, {rs('c11')} AS c11 FROM li")
def tile_debuffer(spark, sf):
    cube = lineitem_cube(spark, sf).select("c11")
    tiles = tiling.split(cube, {"y": 4}, buffer=1)
    return rounded(tiling.debuffer(tiles, list(cube.dims), "tile_y", "y", ["c11"]), "y", "x", "t")


@query(f"WITH {LI} SELECT CAST(CASE WHEN y < 4 THEN y // 4 ELSE 1 + (y - 4) // 3 END AS INTEGER) AS block_y, CAST(t // 7 AS INTEGER) AS block_t, count(*) AS cells, {rs('sum(c11)', 4)} AS total FROM li GROUP BY 1, 2")
def block_split(spark, sf):
    blocks = tiling.block_split(lineitem_cube(spark, sf), {"y": 3, "t": 4})
    return blocks.groupBy("block_y", "block_t").agg(F.count("*").alias("cells"), r(F.sum("c11"), 4).alias("total"))


# -- filters -----------------------------------------------------------------------------------

def conv_sql(kernel: np.ndarray, mode: str, source: str = "li", extra: str = "t") -> str:
    """A gather join: each cell with the offsets of the kernel, folded at the edges."""
    h, w = kernel.shape
    taps = ", ".join(f"({h // 2 - a}, {w // 2 - b}, {float(kernel[a, b])!r})" for a in range(h) for b in range(w) if kernel[a, b])
    fy, fx = fold_sql("c.y + k.oy", NY, mode), fold_sql("c.x + k.ox", NX, mode)
    keys = f"c.y, c.x{', c.' + extra if extra else ''}"
    same = f" AND s.{extra} = c.{extra}" if extra else ""
    head = f"WITH {LI}" if source == "li" else f"WITH {LI}, {IMAGE}"
    return f"""{head}, k(oy, ox, w) AS (VALUES {taps}) SELECT {keys}, {rs('sum(k.w * coalesce(s.c11, 0.0))')} AS c11
 FROM {source} c CROSS JOIN k LEFT JOIN {source} s ON s.y = {fy} AND s.x = {fx}{same} GROUP BY {keys}"""


SOBEL = np.array([[1, 0, -1], [2, 0, -2], [1, 0, -1]], float)
KERNEL = np.array([[(3 * a + 5 * b + a * b) % 7 - 2 for b in range(5)] for a in range(5)], float)


def conv(kernel: np.ndarray, mode: str) -> Query:
    def fn(spark, sf):
        cube = lineitem_cube(spark, sf).select("c11")
        return rounded(cube.filter.convolve(("y", "x"), kernel, mode=mode).df, "y", "x", "t")

    return fn


for _name, _kernel, _mode in (("conv_sobel", SOBEL, "reflect"), ("conv_reflect_5x5", KERNEL, "reflect"), ("conv_mode_nearest", KERNEL, "nearest"), ("conv_mode_mirror", KERNEL, "mirror"), ("conv_mode_wrap", KERNEL, "wrap"), ("conv_mode_constant", KERNEL, "constant")):
    QUERIES[_name], SQL[_name] = conv(_kernel, _mode), conv_sql(_kernel, _mode)


@query(conv_sql(np.full((3, 3), 1 / 9), "reflect"))
def boxcar_3(spark, sf):
    return rounded(lineitem_cube(spark, sf).select("c11").filter.boxcar(("y", "x"), 3).df, "y", "x", "t")


@query(f"""WITH {LI}, o(k) AS (VALUES (-1), (0), (1)) SELECT c.y, c.x, c.t, {rs('sum(s.c11) / 27')} AS c11
 FROM li c CROSS JOIN o a CROSS JOIN o b CROSS JOIN o d JOIN li s ON s.y = {fold_sql('c.y + a.k', NY, 'reflect')} AND s.x = {fold_sql('c.x + b.k', NX, 'reflect')} AND s.t = {fold_sql('c.t + d.k', NT, 'reflect')} GROUP BY 1, 2, 3""")
def boxcar_3d(spark, sf):
    return rounded(lineitem_cube(spark, sf).select("c11").filter.boxcar(("y", "x", "t"), 3).df, "y", "x", "t")


def _outer(*w: dict[int, float]) -> np.ndarray:
    a, b = ([v for _, v in sorted(x.items())] for x in w)
    return np.outer(a, b)


@query(conv_sql(_outer(stencil.gaussian_weights(1.0), stencil.gaussian_weights(1.0)), "reflect"))
def gaussian_1(spark, sf):
    return rounded(lineitem_cube(spark, sf).select("c11").filter.gaussian(("y", "x"), 1.0).df, "y", "x", "t")


@query(conv_sql(_outer(stencil.gaussian_weights(0.5), stencil.gaussian_weights(1.5)), "reflect"))
def gaussian_aniso(spark, sf):
    return rounded(lineitem_cube(spark, sf).select("c11").filter.gaussian(("y", "x"), (0.5, 1.5)).df, "y", "x", "t")


def nlm_sql(f: int, n_eff: float, sigma: float = 1.0, h: float = 1.0, variables: tuple[str, ...] = ("c11", "c22")) -> str:
    def at(c: str, dy: str, dx: str) -> str:
        return f"{fold_sql(f'{c}.y + {dy}', NY, 'mirror')} AND {{s}}.x = {fold_sql(f'{c}.x + {dx}', NX, 'mirror')}"

    o = ", ".join(f"({a}, {b})" for a in (-1, 0, 1) for b in (-1, 0, 1))
    p = ", ".join(f"({a}, {b})" for a in range(-f, f + 1) for b in range(-f, f + 1))
    own = "CASE WHEN mw = 0 THEN 1 ELSE mw END" if n_eff <= 0 else f"CASE WHEN qw > 0 AND ({n_eff} - 1) * qw <= sw * sw THEN (sw + sqrt({n_eff} * sw * sw - {n_eff} * {n_eff} * qw + {n_eff} * qw)) / ({n_eff} - 1) END"
    image_ = "img AS (SELECT y, x, " + ", ".join(f"avg({v}) AS {v}" for v in variables) + " FROM li GROUP BY y, x)"
    squares = " + ".join(f"sum((a.{v} - b.{v}) * (a.{v} - b.{v}))" for v in variables)
    return f"""WITH {LI}, {image_}, o(oy, ox) AS (VALUES {o}), p(py, px) AS (VALUES {p}),
 d AS (SELECT c.y, c.x, o.oy, o.ox, ({squares}) / ({len(variables)} * count(*)) AS d2
  FROM img c CROSS JOIN o CROSS JOIN p JOIN img a ON a.y = {at('c', 'p.py', 'p.px').format(s='a')} JOIN img b ON b.y = {at('c', 'o.oy + p.py', 'o.ox + p.px').format(s='b')}
  WHERE NOT (o.oy = 0 AND o.ox = 0) GROUP BY 1, 2, 3, 4),
 w AS (SELECT *, exp(-greatest(d2 - {2 * sigma**2}, 0) / {h**2}) AS w FROM d),
 s AS (SELECT w.y, w.x, sum(w) AS sw, sum(w * w) AS qw, max(w) AS mw, {", ".join(f"sum(w * q.{v}) AS s_{v}" for v in variables)} FROM w JOIN img q ON q.y = {at('w', 'w.oy', 'w.ox').format(s='q')} GROUP BY 1, 2),
 z AS (SELECT *, {own} AS ow FROM s)
 SELECT z.y, z.x, {", ".join(f"{rs(f'(s_{v} + ow * img.{v}) / (sw + ow)')} AS {v}" for v in variables)} FROM z JOIN img ON z.y = img.y AND z.x = img.x"""


@query(nlm_sql(0, -1))
def nlmeans_r1f0(spark, sf):
    return rounded(image(spark, sf).filter.nlmeans(("y", "x"), r=1, f=0).df, "y", "x")


@query(nlm_sql(1, -1))
def nlmeans_r1f1(spark, sf):
    return rounded(image(spark, sf).filter.nlmeans(("y", "x"), r=1, f=1).df, "y", "x")


@query(nlm_sql(1, 4.0, h=4.0))
def nlmeans_neff(spark, sf):
    return rounded(image(spark, sf).filter.nlmeans(("y", "x"), r=1, f=1, h=4.0, n_eff=4.0).df, "y", "x")


_FOUR = ("c11", "c22", "c12r", "c12i")


@query(nlm_sql(1, -1, variables=_FOUR))
def nlmeans_four(spark, sf):
    return rounded(lineitem_cube(spark, sf).reduce("mean", "t").filter.nlmeans(("y", "x"), r=1, f=1).df, "y", "x")


@query(nlm_sql(1, 2.0, variables=_FOUR))
def nlmeans_neff_h1(spark, sf):
    return rounded(lineitem_cube(spark, sf).reduce("mean", "t").filter.nlmeans(("y", "x"), r=1, f=1, n_eff=2.0).df, "y", "x")


# -- change detection ---------------------------------------------------------------------------

def omnibus_sql(n: float | str, alpha: float, source: str, select: str) -> str:
    """All subseries of a cell, their P, and the walk from change to change."""
    k, n = "(e - l + 1)", f"{float(n):e}"  # a double, so that nothing overflows
    return f"""WITH RECURSIVE {LI}{source}, m AS (SELECT y, x, t, c11, c12r, c12i, c22, ln(c11 * c22 - (c12r * c12r + c12i * c12i)) AS ld FROM src),
 sub AS (SELECT a.y, a.x, a.t AS l, b.t AS e, sum(s.ld) AS ld, sum(s.c11) AS s11, sum(s.c22) AS s22, sum(s.c12r) AS sr, sum(s.c12i) AS si
  FROM m a JOIN m b ON a.y = b.y AND a.x = b.x AND b.t > a.t JOIN m s ON s.y = a.y AND s.x = a.x AND s.t BETWEEN a.t AND b.t GROUP BY 1, 2, 3, 4),
 q AS (SELECT *, 1 - 7.0 / (12.0 * ({k} - 1)) * ({k} / {n} - 1.0 / ({n} * {k})) AS rho, {n} * (2 * {k} * ln({k}) + ld - {k} * ln(s11 * s22 - (sr * sr + si * si))) AS lnq FROM sub),
 z AS (SELECT *, greatest(-2 * rho * lnq, 0) / 2 AS h, 12.0 / (24 * rho * rho) * ({k} / ({n} * {n}) - 1.0 / (({n} * {k}) * ({n} * {k}))) - ({k} - 1) * (1 - 1 / rho) * (1 - 1 / rho) AS om FROM q),
 pr AS (SELECT y, x, l, e, CASE WHEN h <= 0 THEN 0 ELSE 1 - exp(-h) * list_sum(list_transform(range(0, CAST(2 * (e - l) AS BIGINT)), lambda i: exp(i * ln(h) - lgamma(i + 1)))) END AS p1,
  CASE WHEN h <= 0 THEN 0 ELSE 1 - exp(-h) * list_sum(list_transform(range(0, CAST(2 * (e - l) + 2 AS BIGINT)), lambda i: exp(i * ln(h) - lgamma(i + 1)))) END AS p2, om FROM z),
 p AS (SELECT y, x, l, e, p1 + om * (p2 - p1) AS p FROM pr),
 nx AS (SELECT y, x, l, min(CASE WHEN p > {alpha} THEN e END) AS nxt, max(CASE WHEN e = {NT - 1} AND p > {alpha} THEN 1 ELSE 0 END) AS whole FROM p GROUP BY 1, 2, 3),
 walk AS (SELECT y, x, nxt AS t FROM nx WHERE l = 0 AND whole = 1 UNION ALL SELECT nx.y, nx.x, nx.nxt FROM walk JOIN nx ON nx.y = walk.y AND nx.x = walk.x AND nx.l = walk.t AND nx.whole = 1)
 {select}"""


_ML = f""", bc AS (SELECT c.y, c.x, c.t, sum(s.c11) / 9 AS c11, sum(s.c22) / 9 AS c22, sum(s.c12r) / 9 AS c12r, sum(s.c12i) / 9 AS c12i FROM li c
 CROSS JOIN (VALUES (-1), (0), (1)) a(k) CROSS JOIN (VALUES (-1), (0), (1)) b(k) JOIN li s ON s.y = {fold_sql('c.y + a.k', NY, 'reflect')} AND s.x = {fold_sql('c.x + b.k', NX, 'reflect')} AND s.t = c.t GROUP BY 1, 2, 3), src AS (SELECT * FROM bc)"""
_SRC = ", src AS (SELECT * FROM li)"


@query(omnibus_sql(150, 0.9, _SRC, "SELECT DISTINCT y, x, CAST(t AS INTEGER) AS t FROM walk"))
def omnibus_change(spark, sf):
    return change.omnibus(lineitem_cube(spark, sf), n=150, alpha=0.9).df.where("change").select("y", "x", "t")


@query(omnibus_sql(1800, 0.9, _ML, "SELECT DISTINCT y, x, CAST(t AS INTEGER) AS t FROM walk"))
def omnibus_multilook(spark, sf):
    return change.omnibus(lineitem_cube(spark, sf), ml=3, looks=200, alpha=0.9).df.where("change").select("y", "x", "t")


@query(omnibus_sql(400, 0.95, _SRC, "SELECT g.y, g.x, count(walk.t) AS changes FROM (SELECT DISTINCT y, x FROM li) g LEFT JOIN walk ON g.y = walk.y AND g.x = walk.x GROUP BY 1, 2"))
def omnibus_count(spark, sf):
    out = lineitem_cube(spark, sf).change_omnibus(n=400, alpha=0.95)
    return out.df.groupBy("y", "x").agg(F.sum(F.col("change").cast("long")).alias("changes"))


# -- classification --------------------------------------------------------------------------------

_FEATURES = 64


def _vectors(spark: SparkSession, sf: str, n: int = _FEATURES) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", *[F.col("embedding")[k].cast("double").alias(f"f{k}") for k in range(n)])


_F = [f"f{k}" for k in range(_FEATURES)]
_E = "e AS (SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS f{k}" for k in range(_FEATURES)) + " FROM embeddings)"
_TRAIN = "vec_id % 5 <> 0 AND label > 0"
_SCORED = f"WITH {_E}, tr AS (SELECT * FROM e WHERE {_TRAIN}), te AS (SELECT * FROM e)"


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = _vectors(spark, sf)
    return e.where("vec_id % 5 <> 0"), e


@query(f"""WITH {LI} SELECT y, x, """ + ", ".join(f"{rs(f'max(CASE WHEN t = {k} THEN {v} END)')} AS {v}_{k}" for k in range(NT) for v in ("c11", "c22")) + """, CAST((x + y) % 3 AS INTEGER) AS label FROM li WHERE (x + y) % 3 > 0 GROUP BY y, x""")
def make_xy(spark, sf):
    cube = lineitem_cube(spark, sf).select("c11", "c22")
    labels = cube.isel(t=0).df.select("y", "x", ((F.col("x") + F.col("y")) % 3).cast("int").alias("label"))
    rows, features = classify.make_xy(cube, labels, ["y", "x"], ["t"])
    return rounded(classify.labelled(rows, features).select("y", "x", *features, "label"), "y", "x")


@query(f"WITH {_E}, s AS (SELECT " + ", ".join(f"avg({f}) AS m{f}, stddev_pop({f}) AS s{f}" for f in _F) + " FROM e) SELECT vec_id, label, " + ", ".join(f"{rs(f'({f} - m{f}) / s{f}')} AS {f}" for f in _F) + " FROM e, s")
def standard_scale(spark, sf):
    e = _vectors(spark, sf)
    return rounded(classify.scale(e, classify.scaler(e, _F)), "vec_id", "label")


@query(f"WITH {LI}, {IMAGE}, g AS (SELECT *, CAST((x + y) % 3 AS INTEGER) AS label FROM img) SELECT y, x, label, {rs('avg(c11) OVER (PARTITION BY label)')} AS c11, {rs('avg(c22) OVER (PARTITION BY label)')} AS c22 FROM g")
def class_mean(spark, sf):
    cube = image(spark, sf).assign(label=((F.col("x") + F.col("y")) % 3).cast("int"))
    return rounded(reduce.class_mean(cube, "label").df, "y", "x", "label")


_SQUARES = " + ".join(f"(te.{f} - tr.{f}) * (te.{f} - tr.{f})" for f in _F)


@query(f"""{_SCORED}, d AS (SELECT te.vec_id, tr.label, row_number() OVER (PARTITION BY te.vec_id ORDER BY {_SQUARES}, tr.vec_id) AS rn FROM te, tr),
 v AS (SELECT vec_id, label, count(*) AS n FROM d WHERE rn <= 5 GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS k FROM v)
 SELECT vec_id, CAST(label AS BIGINT) AS predicted FROM b WHERE k = 1""")
def knn_predict(spark, sf):
    train, test = _parts(spark, sf)
    return classify.KNeighbors(5).fit(train, _F).predict(test, "vec_id").select("vec_id", "predicted")


_NB = f"""{_SCORED}, mx AS (SELECT 1e-9 * greatest({', '.join(f'var_pop({f})' for f in _F)}) AS e FROM tr),
 st AS (SELECT label, count(*) AS n, {', '.join(f'avg({f}) AS m{f}, var_pop({f}) AS v{f}' for f in _F)} FROM tr GROUP BY label),
 sc AS (SELECT te.vec_id, te.label AS truth, st.label, ln(st.n / (SELECT CAST(count(*) AS DOUBLE) FROM tr)) - 0.5 * ({' + '.join(f'ln(2 * pi() * (v{f} + e)) + (te.{f} - m{f}) * (te.{f} - m{f}) / (v{f} + e)' for f in _F)}) AS s FROM te, st, mx),
 bb AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS k FROM sc)"""


@query(f"{_NB} SELECT vec_id, label AS predicted FROM bb WHERE k = 1")
def gnb_predict(spark, sf):
    train, test = _parts(spark, sf)
    return classify.GaussianNB().fit(train, _F).predict(test).select("vec_id", "predicted")


@query(f"{_NB}, mm AS (SELECT vec_id, max(s) AS m FROM sc GROUP BY 1), pp AS (SELECT sc.vec_id, sc.label, exp(s - m) AS e FROM sc JOIN mm ON sc.vec_id = mm.vec_id) SELECT vec_id, {', '.join(f'{rs(f'sum(CASE WHEN label = {c} THEN e END) / sum(e)')} AS p_{c}' for c in range(1, 10))} FROM pp GROUP BY 1")
def gnb_proba(spark, sf):
    train, test = _parts(spark, sf)
    out = classify.GaussianNB().fit(train, _F).predict_proba(test)
    return rounded(out.select("vec_id", *[c for c in out.columns if c.startswith("p_")]), "vec_id")


@query(f"""{_SCORED}, st AS (SELECT label, {', '.join(f'avg({f}) AS {f}' for f in _F)} FROM tr GROUP BY label),
 d AS (SELECT te.vec_id, tr.label, row_number() OVER (PARTITION BY te.vec_id ORDER BY {_SQUARES}, tr.label) AS k FROM te, st tr) SELECT vec_id, label AS predicted FROM d WHERE k = 1""")
def nearest_centroid(spark, sf):
    train, test = _parts(spark, sf)
    return classify.NearestCentroid().fit(train, _F).predict(test).select("vec_id", "predicted")


@query(f"{_NB} SELECT {rs('avg(CASE WHEN truth = label THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM bb WHERE k = 1 AND truth > 0")
def score_accuracy(spark, sf):
    train, test = _parts(spark, sf)
    value = classify.score(classify.GaussianNB().fit(train, _F).predict(test))
    return spark.range(1).select(r(F.lit(value)).alias("accuracy"))


@query(None)
def rf_predict(spark, sf):
    from pyspark.ml.classification import RandomForestClassifier

    e = _vectors(spark, sf)
    return classify.Estimator(RandomForestClassifier(numTrees=10, seed=1)).fit(e.where("vec_id % 5 <> 0"), _F).predict(e).select("vec_id", "predicted")


@query(None)
def kmeans_fit(spark, sf):
    from pyspark.ml.clustering import KMeans

    e = _vectors(spark, sf)
    return classify.Estimator(KMeans(k=9, seed=1)).fit(e, _F, None).predict(e).groupBy("predicted").count()


# -- warp -------------------------------------------------------------------------------------------

def resample_sql(width: int, height: int, method: str, xr: float, yr: float) -> str:
    """Steps xr and yr of the target in source cells; both grids begin at the first source cell."""
    pos = f"""g AS (SELECT CAST(i % {width} AS INTEGER) AS x, CAST(i // {width} AS INTEGER) AS y FROM range({width * height}) s(i)),
 p AS (SELECT x, y, (x + 0.5) * {xr!r} - 0.5 AS c, (y + 0.5) * {yr!r} - 0.5 AS rr FROM g), f AS (SELECT * FROM p WHERE c > -0.500000001 AND c < {NX} - 0.499999999 AND rr > -0.500000001 AND rr < {NY} - 0.499999999)"""
    if method == "nearest":
        return f"WITH {LI}, {IMAGE}, {pos} SELECT f.y, f.x, {rs('img.c11')} AS c11 FROM f JOIN img ON img.x = floor(c + 0.5) AND img.y = floor(rr + 0.5)"
    w = "(CASE WHEN o.a = 1 THEN c - floor(c) ELSE 1 - (c - floor(c)) END) * (CASE WHEN o.b = 1 THEN rr - floor(rr) ELSE 1 - (rr - floor(rr)) END)"
    return f"""WITH {LI}, {IMAGE}, {pos}, o(a, b) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1)), w AS (SELECT f.y, f.x, floor(c) + o.a AS sx, floor(rr) + o.b AS sy, {w} AS w FROM f CROSS JOIN o)
 SELECT w.y, w.x, {rs('sum(w * img.c11) / sum(w)')} AS c11 FROM w JOIN img ON img.x = sx AND img.y = sy WHERE w > 0 GROUP BY 1, 2"""


@query(resample_sql(15, 7, "nearest", (10 / 14) / (10 / 9), (10 / 6) / (10 / 9)))
def resample_nearest(spark, sf):
    return rounded(warp.resample(image(spark, sf).select("c11"), width=15, height=7, method="nearest").df.select("y", "x", "c11"), "y", "x")


@query(resample_sql(17, 13, "bilinear", (10 / 16) / (10 / 9), (10 / 12) / (10 / 9)))
def resample_bilinear(spark, sf):
    return rounded(warp.resample(image(spark, sf).select("c11"), width=17, height=13).df.select("y", "x", "c11"), "y", "x")


_MERC = projection.parse(3857)
_BOX = [projection.forward(_MERC, lon, lat) for lon, lat in ((-10.0, 50.0), (0.0, 60.0))]
_W, _H = 12, 14


@query(f"""WITH {LI}, {IMAGE}, g AS (SELECT CAST(i % {_W} AS INTEGER) AS x, CAST(i // {_W} AS INTEGER) AS y FROM range({_W * _H}) s(i)),
 m AS (SELECT x, y, {_BOX[0][0]:.17e} + (x + 5e-1) * {(_BOX[1][0] - _BOX[0][0]) / (_W - 1):.17e} AS mx, {_BOX[1][1]:.17e} - (y + 5e-1) * {(_BOX[1][1] - _BOX[0][1]) / (_H - 1):.17e} AS my FROM g),
 d AS (SELECT x, y, mx / 6378137e0 * 180e0 / pi() AS lon, (2 * atan(exp(my / 6378137e0)) - pi() / 2) * 180 / pi() AS lat FROM m),
 p AS (SELECT x, y, (lon + 10) / {10 / 9:.17e} - 5e-1 AS c, (lat - 60) / {-10 / 9:.17e} - 5e-1 AS rr FROM d)
 SELECT p.y, p.x, {rs('img.c11')} AS c11 FROM p JOIN img ON img.x = floor(c + 0.5) AND img.y = floor(rr + 0.5)""")
def reproject_mercator(spark, sf):
    box = (_BOX[0][0], _BOX[0][1], _BOX[1][0], _BOX[1][1])
    cube = image(spark, sf).select("c11").reproject(dst_crs=3857, extent=box, width=_W, height=_H, method="nearest")
    return rounded(cube.df.select("y", "x", "c11"), "y", "x")


@query(f"""WITH {LI}, {IMAGE}, g AS (SELECT CAST(i % 13 AS INTEGER) AS x, CAST(i // 13 AS INTEGER) AS y FROM range(156) s(i)),
 a AS (SELECT g.y, g.x, img.c11 FROM g JOIN img ON img.x = g.x AND img.y = g.y - 2), b AS (SELECT g.y, g.x, img.c11 FROM g JOIN img ON img.x = g.x - 3 AND img.y = g.y)
 SELECT 0 AS source, y, x, {rs('c11')} AS c11 FROM a UNION ALL SELECT 1, y, x, {rs('c11')} FROM b""")
def align_common_grid(spark, sf):
    one = image(spark, sf).select("c11")
    first = Cube(one.df, one.dims, one.variables, {"y": (50.0, -1.0), "x": (0.0, 1.0)}, {"crs": 4326})
    other = Cube(one.df, one.dims, one.variables, {"y": (52.0, -1.0), "x": (3.0, 1.0)}, {"crs": 4326})
    a, b = warp.align([first, other], method="nearest")
    out = a.df.select(F.lit(0).alias("source"), "y", "x", "c11").union(b.df.select(F.lit(1).alias("source"), "y", "x", "c11"))
    return rounded(out, "source", "y", "x")


@query(None)
def coregister_shift(spark, sf):
    return warp.shifts(lineitem_cube(spark, sf).select("c11"))


# -- polygons ----------------------------------------------------------------------------------------

# a quadrilateral for each supplier, from its keys
_POLY = [("0", "0"), ("5 + s_suppkey % 3", "0.5"), ("4.5", "4 + s_nationkey % 3"), ("-0.5", "3.5")]
_CX, _CY = "(s_suppkey * 7 % 90) + 0.25", "(s_nationkey * 11 % 90) + 0.25"


def _polygons(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    ring = F.array(*[F.struct((F.expr(_CX) + F.expr(a)).cast("double").alias("x"), (F.expr(_CY) + F.expr(b)).cast("double").alias("y")) for a, b in _POLY])
    category = F.concat(F.lit("nation"), (F.col("s_nationkey") % 4).cast("string"))
    return s.select(F.col("s_suppkey").alias("feature_id"), F.array(ring).alias("geometry"), (F.col("s_nationkey") + 1).cast("int").alias("integer"), category.alias("category"))


def _raster(spark: SparkSession) -> Cube:
    return Cube(spark.range(0), {"y": 100, "x": 100}, (), {"y": (99.0, -1.0), "x": (0.0, 1.0)}, {"crs": 4326})


_EDGES = ", ".join(f"({k}, {k + 1 if k < 3 else 0})" for k in range(4))
_PTS = "pt AS (SELECT s_suppkey AS id, s_nationkey AS nk, k, CASE k " + " ".join(f"WHEN {k} THEN {_CX} + {a}" for k, (a, _) in enumerate(_POLY)) + " END AS px, CASE k " + " ".join(f"WHEN {k} THEN {_CY} + {b}" for k, (_, b) in enumerate(_POLY)) + " END AS py FROM supplier, range(4) r(k))"
_HITS = f"""{_PTS}, ed AS (SELECT a.id, a.nk, a.px AS ax, a.py AS ay, b.px AS bx, b.py AS bz FROM pt a JOIN (VALUES {_EDGES}) e(i, j) ON a.k = e.i JOIN pt b ON b.id = a.id AND b.k = e.j),
 g AS (SELECT CAST(i // 100 AS INTEGER) AS y, CAST(i % 100 AS INTEGER) AS x, 99.0 - (i // 100) AS gy, CAST(i % 100 AS DOUBLE) AS gx FROM range(10000) s(i)),
 bb AS (SELECT id, min(px) AS l, max(px) AS r, min(py) AS b, max(py) AS t FROM pt GROUP BY id),
 hit AS (SELECT ed.id, ed.nk, g.y, g.x FROM bb JOIN g ON g.gx BETWEEN bb.l AND bb.r AND g.gy BETWEEN bb.b AND bb.t JOIN ed ON ed.id = bb.id
  GROUP BY 1, 2, 3, 4 HAVING sum(CASE WHEN (ay > gy) <> (bz > gy) AND gx < ax + (gy - ay) * (bx - ax) / (bz - ay) THEN 1 ELSE 0 END) % 2 = 1)"""
_HITS = _HITS.replace("JOIN ed ON ed.id = bb.id\n  GROUP BY 1, 2, 3, 4 HAVING", "JOIN ed ON ed.id = bb.id GROUP BY ed.id, ed.nk, g.y, g.x HAVING")


@query(f"WITH {_HITS}, top AS (SELECT y, x, nk, row_number() OVER (PARTITION BY y, x ORDER BY id DESC) AS k FROM hit) SELECT g.y, g.x, CAST(coalesce(nk + 1, 0) AS INTEGER) AS integer FROM g LEFT JOIN (SELECT * FROM top WHERE k = 1) top ON g.y = top.y AND g.x = top.x")
def rasterize_polygons(spark, sf):
    cube, _ = vector.rasterize(_polygons(spark, sf), _raster(spark), ["integer"])
    return cube.df


@query(f"""WITH {_HITS}, days AS (SELECT DISTINCT CAST(id % 3 AS INTEGER) AS d FROM pt), ax AS (SELECT d, CAST(row_number() OVER (ORDER BY d) - 1 AS INTEGER) AS t FROM days),
 top AS (SELECT y, x, id % 3 AS d, nk, row_number() OVER (PARTITION BY y, x, id % 3 ORDER BY id DESC) AS k FROM hit)
 SELECT ax.t, g.y, g.x, CAST(coalesce(nk + 1, 0) AS INTEGER) AS integer FROM g CROSS JOIN ax LEFT JOIN (SELECT * FROM top WHERE k = 1) top ON g.y = top.y AND g.x = top.x AND top.d = ax.d""")
def rasterize_dated(spark, sf):
    day = F.date_add(F.lit("2018-01-01").cast("date"), (F.col("feature_id") % 3).cast("int")).cast("string")
    cube, _ = vector.rasterize(_polygons(spark, sf).withColumn("day", day), _raster(spark), ["integer"], date_field="day")
    return cube.df.select("t", "y", "x", "integer")


@query("SELECT CAST(strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d') AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1")
def parse_dates(spark, sf):
    text = F.date_format("o_orderdate", "yyyyMMdd")
    return table(spark, sf, "orders").select(parse_date(text).cast("date").alias("day")).groupBy("day").agg(F.count("*").alias("n"))


@query(f"WITH {LI}, img AS (SELECT y, x, avg(c11) AS c11 FROM li GROUP BY y, x), line AS (SELECT y, avg(c22) AS c22 FROM li GROUP BY y) SELECT img.y, img.x, {rs('c11')} AS c11, {rs('c22')} AS c22 FROM img JOIN line ON img.y = line.y")
def routed_variables(spark, sf):
    """The mean over time of the variables that have it; one that only has rows passes through, and is the same along a row."""
    cube = lineitem_cube(spark, sf)
    data = Dataset.of(cube.select("c11"), cube.select("c22").reduce("mean", "x", "t"))
    return rounded(data.map(lambda c: c.reduce("mean", "t"), ["t"]).merged().df, "y", "x")


@query(f"WITH {_PTS}, bb AS (SELECT id, min(px) AS l, max(px) AS r, min(py) AS b, max(py) AS t FROM pt GROUP BY id) SELECT id AS feature_id FROM bb WHERE r >= 0 AND l <= 200 AND t >= -1 AND b <= 200")
def clip_all(spark, sf):
    return vector.clip(_polygons(spark, sf), 0, -1, 200, 200).select("feature_id")


@query(f"""WITH {_PTS}, ed AS (SELECT a.id, a.px AS ax, a.py AS ay, b.px AS bx, b.py AS bz FROM pt a JOIN (VALUES {_EDGES}) e(i, j) ON a.k = e.i JOIN pt b ON b.id = a.id AND b.k = e.j),
 box AS (SELECT 20.5 AS l, 20.5 AS b, 60.5 AS r, 60.5 AS t), cut AS (SELECT id, greatest(0.0, CASE WHEN bx > ax THEN (l - ax) / (bx - ax) WHEN bx < ax THEN (r - ax) / (bx - ax) WHEN ax BETWEEN l AND r THEN 0 ELSE 2 END,
  CASE WHEN bz > ay THEN (b - ay) / (bz - ay) WHEN bz < ay THEN (t - ay) / (bz - ay) WHEN ay BETWEEN b AND t THEN 0 ELSE 2 END) AS lo,
  least(1.0, CASE WHEN bx > ax THEN (r - ax) / (bx - ax) WHEN bx < ax THEN (l - ax) / (bx - ax) ELSE 1 END, CASE WHEN bz > ay THEN (t - ay) / (bz - ay) WHEN bz < ay THEN (b - ay) / (bz - ay) ELSE 1 END) AS hi FROM ed, box)
 SELECT DISTINCT id AS feature_id FROM cut WHERE lo <= hi""")
def clip_intersects(spark, sf):
    return vector.clip(_polygons(spark, sf), 20.5, 20.5, 60.5, 60.5).select("feature_id")


@query("""WITH f AS (SELECT o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY 1), l AS (SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS code FROM f)
 SELECT l.code, l.o_orderpriority, count(*) AS n FROM orders o JOIN l ON o.o_orderpriority = l.o_orderpriority GROUP BY 1, 2""")
def factorize_legend(spark, sf):
    coded, _ = reduce.factorize(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey")
    return coded.groupBy("code", "o_orderpriority").agg(F.count("*").alias("n"))


# -- pictures ------------------------------------------------------------------------------------------

@query(f"WITH {LI} SELECT t, {rs('quantile_cont(c11, 0.02)')} AS c11_lo, {rs('quantile_cont(c11, 0.98)')} AS c11_hi FROM li GROUP BY t")
def percentile_stretch(spark, sf):
    return rounded(visual.stretch_limits(lineitem_cube(spark, sf).df, ["c11"], by=["t"]), "t")


@query("SELECT p_size, CAST(floor(((p_size % 10) + 10) % 10 * 255 / 9) AS INTEGER) AS level, count(*) AS n FROM part GROUP BY 1, 2")
def colorize_labels(spark, sf):
    return visual.colorize(table(spark, sf, "part").select("p_size"), "p_size", 10).groupBy("p_size", "level").agg(F.count("*").alias("n"))


def _level(c: str) -> str:
    return f"CAST(floor(greatest(least(({c} - {c}_lo) / ({c}_hi - {c}_lo), 1), 0) * 255) AS INTEGER)"


@query(f"""WITH {LI}, {IMAGE}, c AS (SELECT y, x, c11 AS r, c22 AS g, c11 / c22 AS b FROM img), q AS (SELECT {', '.join(f'quantile_cont({k}, 0.02) AS {k}_lo, quantile_cont({k}, 0.98) AS {k}_hi' for k in 'rgb')} FROM c)
 SELECT y, x, {', '.join(f'{_level(k)} AS {k}' for k in 'rgb')} FROM c, q""")
def rgb_composite(spark, sf):
    return visual.rgb(image(spark, sf))


@query(f"""WITH {LI}, q AS (SELECT t, quantile_cont(c11, 0.05) AS c11_lo, quantile_cont(c11, 0.95) AS c11_hi FROM li GROUP BY t) SELECT li.t, li.y, li.x, {_level('c11')} AS grey FROM li JOIN q ON li.t = q.t""")
def video_frames(spark, sf):
    return visual.frames(lineitem_cube(spark, sf), channels=[F.col("c11")], pmin=5, pmax=95).select("t", "y", "x", "grey")


# -- mapping --------------------------------------------------------------------------------------------

@query(f"WITH {LI} SELECT y, x, {rs('avg(c11)')} AS c11, {rs('avg(c22)')} AS c22 FROM li GROUP BY y, x")
def apply_signature(spark, sf):
    return rounded(apply.apply(lineitem_cube(spark, sf).select("c11", "c22"), np.mean, "(t)->()").df, "y", "x")


@query(f"WITH {LI} SELECT y, x, t, {rs('sum(c11 + c22) OVER (PARTITION BY y, x ORDER BY t)')} AS result FROM li")
def apply_time_var(spark, sf):
    cube = lineitem_cube(spark, sf).select("c11", "c22")
    return rounded(apply.apply(cube, lambda a: np.cumsum(a.sum(1)), "(t,var)->(t)").df, "y", "x", "t")


@query(f"WITH {LI} SELECT y, x, t, {rs('c11 - avg(c11) OVER (PARTITION BY y, t)')} AS c11 FROM li")
def parallel_chunks(spark, sf):
    cube = lineitem_cube(spark, sf).select("c11")

    def centred(pdf):
        return pdf.assign(c11=pdf.c11 - pdf.groupby(["y", "t"]).c11.transform("mean"))

    return rounded(tiling.parallel(cube, centred, "y", 3, "y int, x int, t int, c11 double", buffer=1).df, "y", "x", "t")


FLAGSHIP = "omnibus_count"
