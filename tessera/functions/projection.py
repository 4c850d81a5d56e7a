"""Map projections as column expressions and as plain functions of floats.

Families: longlat (EPSG:4326), web Mercator (3857), ellipsoidal Mercator (3395), sinusoidal,
transverse Mercator, Lambert azimuthal equal area and Albers equal area, on WGS84 or a sphere,
transverse Mercator on other ellipsoids too (a, rf) with a datum shift (towgs84), as for the British grid.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

A = 6378137.0
FLAT = 1 / 298.257223563
E2 = FLAT * (2 - FLAT)


class CRSError(ValueError):
    """A reference system that isn't known."""


@dataclass(frozen=True)
class CRS:
    family: str
    params: dict[str, float] = field(default_factory=dict, hash=False)
    code: int | None = None


#: Reference systems by EPSG code.
_EPSG = {
    4326: CRS("longlat", {}, 4326),
    3857: CRS("webmerc", {}, 3857),
    3395: CRS("merc", {}, 3395),
    2163: CRS("laea", {"lat_0": 45.0, "lon_0": -100.0, "radius": 6370997.0}, 2163),
    27700: CRS("tmerc", {"lat_0": 49.0, "lon_0": -2.0, "k_0": 0.9996012717, "x_0": 400000.0, "y_0": -100000.0, "a": 6377563.396, "rf": 299.3249646, "towgs84": (446.448, -125.157, 542.06, 0.15, 0.247, 0.842, -20.489)}, 27700),
    3086: CRS("aea", {"lat_0": 24.0, "lon_0": -84.0, "lat_1": 24.0, "lat_2": 31.5, "x_0": 400000.0}, 3086),
}
_ZONE = re.compile(r"32([67])(\d\d)$")


def parse(crs: CRS | int | str | dict) -> CRS:
    if isinstance(crs, CRS):
        return crs
    if isinstance(crs, dict):
        params = {k: v for k, v in crs.items()}
    else:
        text = str(crs).strip()
        m = re.fullmatch(r"(?:epsg:)?(\d+)", text.removeprefix("+init="), re.I)
        if m:
            code = int(m[1])
            zone = _ZONE.match(m[1])
            if zone:
                return CRS("tmerc", {"lon_0": int(zone[2]) * 6 - 183.0, "k_0": 0.9996, "x_0": 500000.0, "y_0": 0.0 if zone[1] == "6" else 10_000_000.0}, code)
            if code in _EPSG:
                return _EPSG[code]
            raise CRSError(f"EPSG:{code} is not supported")
        params = dict(p.lstrip("+").split("=", 1) for p in text.split() if "=" in p)
    family = params.pop("proj", None)
    if params.get("init"):
        return parse(params["init"])
    names = {"longlat": "longlat", "latlong": "longlat", "merc": "merc", "sinu": "sinu", "tmerc": "tmerc", "utm": "utm", "laea": "laea", "aea": "aea", "webmerc": "webmerc"}
    if family not in names:
        raise CRSError(f"{crs!r} is not a supported reference system")
    numbers = {k: float(v) for k, v in params.items() if re.fullmatch(r"[-+0-9.eE]+", str(v))}
    if family == "utm":
        return CRS("tmerc", {"lon_0": numbers["zone"] * 6 - 183.0, "k_0": 0.9996, "x_0": 500000.0})
    return CRS(names[family], numbers)


class _Floats:
    """The functions for floats; for columns pyspark.sql.functions has the same names."""

    sin, cos, tan, asin, atan, atan2, exp, log, sqrt = math.sin, math.cos, math.tan, math.asin, math.atan, math.atan2, math.exp, math.log, math.sqrt


def _lib(x: Any) -> Any:
    return F if isinstance(x, Column) else _Floats


def _rad(x):
    return x * (math.pi / 180)


def _deg(x):
    return x * (180 / math.pi)


def _meridian(f, lat, a=A, flat=FLAT):
    """Length along the meridian from the equator."""
    n = flat / (2 - flat)
    a0 = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    return a0 * (lat - (3 * n / 2 - 9 * n**3 / 16) * f.sin(lat * 2) + (15 * n**2 / 16 - 15 * n**4 / 32) * f.sin(lat * 4) - 35 * n**3 / 48 * f.sin(lat * 6) + 315 * n**4 / 512 * f.sin(lat * 8))


def _foot(f, m, a=A, flat=FLAT):
    """The latitude at a length along the meridian."""
    n = flat / (2 - flat)
    mu = m / (a / (1 + n) * (1 + n**2 / 4 + n**4 / 64))
    return mu + (3 * n / 2 - 27 * n**3 / 32) * f.sin(mu * 2) + (21 * n**2 / 16 - 55 * n**4 / 32) * f.sin(mu * 4) + 151 * n**3 / 96 * f.sin(mu * 6) + 1097 * n**4 / 512 * f.sin(mu * 8)


def _q(f, s):
    e = math.sqrt(E2)
    return (1 - E2) * (s / (1 - s * s * E2) - f.log((1 - s * e) / (1 + s * e)) * (1 / (2 * e)))


def _ellipsoid(p: dict) -> tuple[float, float, float]:
    """Half axis, flattening and squared eccentricity."""
    flat = 1 / p["rf"] if "rf" in p else FLAT
    return p.get("a", A), flat, flat * (2 - flat)


def _datum(f, lon, lat, p: dict, back: bool):
    """Degrees on WGS84 as degrees on the system's own ellipsoid, or back: three shifts in metres, three turns in seconds and a scale in millionths."""
    dx, dy, dz, rx, ry, rz, ds = p["towgs84"]
    (rx, ry, rz), m = (math.radians(r / 3600) for r in (rx, ry, rz)), 1 + ds * 1e-6
    (a1, _, e1), (a2, _, e2) = ((_ellipsoid(p), (A, FLAT, E2)) if back else ((A, FLAT, E2), _ellipsoid(p)))
    lam, phi = _rad(lon), _rad(lat)
    nu = a1 / f.sqrt(1 - f.sin(phi) * f.sin(phi) * e1)
    x, y, z = nu * f.cos(phi) * f.cos(lam), nu * f.cos(phi) * f.sin(lam), nu * f.sin(phi) * (1 - e1)
    if back:
        x, y, z = (x - y * rz + z * ry) * m + dx, (x * rz + y - z * rx) * m + dy, (y * rx - x * ry + z) * m + dz
    else:  # the turns are so small that the transposed matrix is the inverse
        x, y, z = (x - dx) / m, (y - dy) / m, (z - dz) / m
        x, y, z = x + y * rz - z * ry, y - x * rz + z * rx, z + x * ry - y * rx
    r = f.sqrt(x * x + y * y)
    phi = f.atan2(z, r * (1 - e2))
    for _ in range(4):  # converges by a factor of 150 a step
        phi = f.atan2(z + f.sin(phi) * e2 * a2 / f.sqrt(1 - f.sin(phi) * f.sin(phi) * e2), r)
    return _deg(f.atan2(y, x)), _deg(phi)


def _albers(c: CRS) -> tuple[float, float, float]:
    p = c.params
    phi1, phi2, phi0 = (_rad(p.get(k, 0.0)) for k in ("lat_1", "lat_2", "lat_0"))

    def m(x: float) -> float:
        return math.cos(x) / math.sqrt(1 - E2 * math.sin(x) ** 2)

    q1, q2, q0 = (_q(_Floats, math.sin(x)) for x in (phi1, phi2, phi0))
    n = (m(phi1) ** 2 - m(phi2) ** 2) / (q2 - q1) if phi1 != phi2 else math.sin(phi1)
    k = m(phi1) ** 2 + n * q1
    return n, k, A * math.sqrt(k - n * q0) / n


def forward(crs: CRS, lon, lat):
    """(x, y) of a longitude and latitude in degrees."""
    f, p = _lib(lon), crs.params
    x0, y0 = p.get("x_0", 0.0), p.get("y_0", 0.0)
    if crs.family == "longlat":
        return lon, lat
    if "towgs84" in p:
        lon, lat = _datum(f, lon, lat, p, back=False)
    lam, phi = _rad(lon - p.get("lon_0", 0.0)), _rad(lat)
    if crs.family == "webmerc":
        return lam * A, f.log(f.tan(phi / 2 + math.pi / 4)) * A
    if crs.family == "merc":
        e = math.sqrt(E2)
        s = f.sin(phi) * e
        return lam * A + x0, (f.log(f.tan(phi / 2 + math.pi / 4)) - f.log((1 + s) / (1 - s)) * (e / 2)) * A + y0
    if crs.family == "sinu":
        return lam * f.cos(phi) / f.sqrt(1 - f.sin(phi) * f.sin(phi) * E2) * A + x0, _meridian(f, phi) + y0
    if crs.family == "tmerc":
        k0, (half, flat, e2) = p.get("k_0", p.get("k", 1.0)), _ellipsoid(p)
        s, c, t = f.sin(phi), f.cos(phi), f.tan(phi)
        ep = e2 / (1 - e2)
        nu = half / f.sqrt(1 - s * s * e2)
        tt, cc, a = t * t, c * c * ep, lam * c
        x = nu * (a + (1 - tt + cc) * a * a * a / 6 + (5 - tt * 18 + tt * tt + cc * 72 - 58 * ep) * a * a * a * a * a / 120)
        y = _meridian(f, phi, half, flat) - _meridian(_Floats, _rad(p.get("lat_0", 0.0)), half, flat) + nu * t * (a * a / 2 + (5 - tt + cc * 9 + cc * cc * 4) * a * a * a * a / 24 + (61 - tt * 58 + tt * tt + cc * 600 - 330 * ep) * a * a * a * a * a * a / 720)
        return x * k0 + x0, y * k0 + y0
    if crs.family == "laea":  # on a sphere
        r, phi0 = p.get("radius", A), _rad(p.get("lat_0", 0.0))
        s, c = f.sin(phi), f.cos(phi)
        k = f.sqrt(2 / (1 + s * math.sin(phi0) + c * f.cos(lam) * math.cos(phi0)))
        return k * c * f.sin(lam) * r + x0, k * (s * math.cos(phi0) - c * f.cos(lam) * math.sin(phi0)) * r + y0
    if crs.family == "aea":
        n, k, rho0 = _albers(crs)
        rho = f.sqrt(_q(f, f.sin(phi)) * -n + k) * (A / n)
        return rho * f.sin(lam * n) + x0, rho0 - rho * f.cos(lam * n) + y0
    raise CRSError(crs.family)


def inverse(crs: CRS, x, y):
    """(longitude, latitude) in degrees of a position."""
    f, p = _lib(x), crs.params
    if crs.family == "longlat":
        return x, y
    x, y, lon0 = x - p.get("x_0", 0.0), y - p.get("y_0", 0.0), p.get("lon_0", 0.0)
    if crs.family == "webmerc":
        return _deg(x / A) + lon0, _deg(f.atan(f.exp(y / A)) * 2 - math.pi / 2)
    if crs.family == "merc":
        e, t = math.sqrt(E2), f.exp(y / -A)
        phi = f.atan(t) * -2 + math.pi / 2
        for _ in range(5):  # converges by a factor of 150 a step
            s = f.sin(phi) * e
            phi = f.atan(t * f.exp(f.log((1 - s) / (1 + s)) * (e / 2))) * -2 + math.pi / 2
        return _deg(x / A) + lon0, _deg(phi)
    if crs.family == "sinu":
        phi = _foot(f, y)
        return _deg(x * f.sqrt(1 - f.sin(phi) * f.sin(phi) * E2) / (f.cos(phi) * A)) + lon0, _deg(phi)
    if crs.family == "tmerc":
        k0, (half, flat, e2) = p.get("k_0", p.get("k", 1.0)), _ellipsoid(p)
        ep = e2 / (1 - e2)
        phi = _foot(f, y / k0 + _meridian(_Floats, _rad(p.get("lat_0", 0.0)), half, flat), half, flat)
        s, c, t = f.sin(phi), f.cos(phi), f.tan(phi)
        nu = half / f.sqrt(1 - s * s * e2)
        rho = half * (1 - e2) / ((1 - s * s * e2) * f.sqrt(1 - s * s * e2))
        tt, cc, d = t * t, c * c * ep, x / (nu * k0)
        lat = phi - nu * t / rho * (d * d / 2 - (5 + tt * 3 + cc * 10 - cc * cc * 4 - 9 * ep) * d * d * d * d / 24 + (61 + tt * 90 + cc * 298 + tt * tt * 45 - 252 * ep - cc * cc * 3) * d * d * d * d * d * d / 720)
        lon = (d - (1 + tt * 2 + cc) * d * d * d / 6 + (5 - cc * 2 + tt * 28 - cc * cc * 3 + 8 * ep + tt * tt * 24) * d * d * d * d * d / 120) / c
        lon, lat = _deg(lon) + lon0, _deg(lat)
        return _datum(f, lon, lat, p, back=True) if "towgs84" in p else (lon, lat)
    if crs.family == "laea":
        r, phi0 = p.get("radius", A), _rad(p.get("lat_0", 0.0))
        rho = f.sqrt(x * x + y * y)
        c = f.asin(rho / (2 * r)) * 2
        tiny = 1e-12
        lat = f.asin(f.cos(c) * math.sin(phi0) + y * f.sin(c) * math.cos(phi0) / (rho + tiny))
        lon = f.atan2(x * f.sin(c), (rho + tiny) * math.cos(phi0) * f.cos(c) - y * math.sin(phi0) * f.sin(c))
        return _deg(lon) + lon0, _deg(lat)
    if crs.family == "aea":
        n, k, rho0 = _albers(crs)
        dy = y * -1 + rho0
        q = (x * x + dy * dy) * (n * n / (A * A)) * (-1 / n) + k / n
        phi = f.asin(q / 2)
        e = math.sqrt(E2)
        for _ in range(6):
            s = f.sin(phi)
            w = 1 - s * s * E2
            phi = phi + w * w / (f.cos(phi) * 2) * (q / (1 - E2) - s / w + f.log((1 - s * e) / (1 + s * e)) * (1 / (2 * e)))
        return _deg(f.atan2(x, dy) / n) + lon0, _deg(phi)
    raise CRSError(crs.family)


def convert(source: CRS, target: CRS, x, y):
    if source == target and source.params == target.params:
        return x, y
    return forward(target, *inverse(source, x, y))
