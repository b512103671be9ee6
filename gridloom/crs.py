"""Map projections in closed form, as Column expressions and plain functions.

Spherical Mercator, transverse Mercator zones by Krüger's series (to the fourth order), and Albers' conic on the
ellipsoid, each way. ``transform`` finds the way between two EPSG codes. Datum shifts are out of scope. Formulas: EPSG
guidance note 7-2 and Karney (2011).
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import ResampleNeeded

#: Semi-major axis and inverse flattening of GRS80, and the sphere of web maps (fixed values).
A, INVERSE_F = 6378137.0, 298.257222101
_columns = SimpleNamespace(sin=F.sin, cos=F.cos, tan=F.tan, atan=F.atan, atan2=F.atan2, log=F.log, exp=F.exp, sqrt=F.sqrt, sinh=F.sinh, cosh=F.cosh, atanh=F.atanh, asinh=F.asinh, asin=F.asin)
_plain = SimpleNamespace(**{k: getattr(math, k) for k in vars(_columns)})


def _of(x) -> SimpleNamespace:
    return _columns if isinstance(x, Column) else _plain


def _let(x, fn):
    """``fn(x)`` with a Column computed once; without it, repeated use doubles the expression at every step."""
    return F.get(F.transform(F.array(x), fn), F.lit(0)) if isinstance(x, Column) else fn(x)


def to_web_mercator(lon, lat):
    m, d = _of(lon), math.pi / 180
    return lon * (A * d), m.log(m.tan(lat * (d / 2) + math.pi / 4)) * A


def from_web_mercator(x, y):
    m, d = _of(x), 180 / math.pi
    return x * (d / A), (m.atan(m.exp(y / A)) * 2 - math.pi / 2) * d


_f = 1 / INVERSE_F
_n = _f / (2 - _f)
_e = math.sqrt(_f * (2 - _f))
_rectifying = A / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
_alpha = (
    _n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180,
    13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440,
    61 * _n**3 / 240 - 103 * _n**4 / 140,
    49561 * _n**4 / 161280,
)
_beta = (
    _n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360,
    _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440,
    17 * _n**3 / 480 - 37 * _n**4 / 840,
    4397 * _n**4 / 161280,
)


def to_utm(lon, lat, zone: int, south: bool = False):
    m, d = _of(lon), math.pi / 180
    dl, phi = (lon - (6 * zone - 183)) * d, lat * d
    t = m.sinh(m.atanh(m.sin(phi)) - m.atanh(m.sin(phi) * _e) * _e)
    xi, eta = m.atan2(t, m.cos(dl)), m.asinh(m.sin(dl) / m.sqrt(t * t + m.cos(dl) * m.cos(dl)))
    north, east = xi, eta
    for j, a in enumerate(_alpha, 1):
        north = north + m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * a
        east = east + m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * a
    return east * (0.9996 * _rectifying) + 500000.0, north * (0.9996 * _rectifying) + (10000000.0 if south else 0.0)


def from_utm(x, y, zone: int, south: bool = False):
    m, d = _of(x), 180 / math.pi
    xi, eta = (y - (10000000.0 if south else 0.0)) / (0.9996 * _rectifying), (x - 500000.0) / (0.9996 * _rectifying)
    a, b = xi, eta
    for j, c in enumerate(_beta, 1):
        a = a - m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * c
        b = b - m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * c
    conformal = m.asin(m.sin(a) / m.cosh(b))
    target, lat = m.atanh(m.sin(conformal)), conformal
    for _ in range(5):  # the isometric latitude, by iteration
        lat = _let(lat, lambda p: m.asin(_tanh(target + m.atanh(m.sin(p) * _e) * _e)))
    return m.atan2(m.sinh(b), m.cos(a)) * d + (6 * zone - 183), lat * d


def _tanh(x):
    return F.tanh(x) if isinstance(x, Column) else math.tanh(x)


def _albers_constants(lat0: float, lat1: float, lat2: float) -> tuple[float, float, float]:
    def q(phi: float) -> float:
        s = math.sin(phi)
        return (1 - _e**2) * (s / (1 - (_e * s) ** 2) + math.atanh(_e * s) / _e)

    def m2(phi: float) -> float:
        return math.cos(phi) ** 2 / (1 - (_e * math.sin(phi)) ** 2)

    p0, p1, p2 = (math.radians(x) for x in (lat0, lat1, lat2))
    n = (m2(p1) - m2(p2)) / (q(p2) - q(p1))
    c = m2(p1) + n * q(p1)
    return n, c, A * math.sqrt(c - n * q(p0)) / n


def to_albers(lon, lat, lon0: float = 132.0, lat0: float = 0.0, lat1: float = -18.0, lat2: float = -36.0):
    m, d = _of(lon), math.pi / 180
    n, c, rho0 = _albers_constants(lat0, lat1, lat2)
    s = m.sin(lat * d)
    q = (s / (1 - s * s * _e**2) + m.atanh(s * _e) / _e) * (1 - _e**2)
    rho, theta = m.sqrt(c - q * n) * (A / n), (lon - lon0) * (d * n)
    return rho * m.sin(theta), rho0 - rho * m.cos(theta)


def from_albers(x, y, lon0: float = 132.0, lat0: float = 0.0, lat1: float = -18.0, lat2: float = -36.0):
    m, d = _of(x), 180 / math.pi
    n, c, rho0 = _albers_constants(lat0, lat1, lat2)
    sign = math.copysign(1.0, n)
    up = (y * -1 + rho0) * sign
    rho, theta = m.sqrt(x * x + up * up), m.atan2(x * sign, up)
    q = (rho * rho * (-((n / A) ** 2)) + c) / n
    lat = m.asin(q / 2)

    def nearer(p):
        s = m.sin(p)
        k = s * s * -(_e**2) + 1
        return p + k * k / (m.cos(p) * 2) * (q / (1 - _e**2) - s / k - m.atanh(s * _e) / _e)

    for _ in range(6):
        lat = _let(lat, nearer)
    return theta * (d / n) + lon0, lat * d


def _ways(code: str) -> tuple[Callable, Callable]:
    """To and from longitude and latitude."""
    n = int(m.group(1)) if (m := re.fullmatch(r"(?i)EPSG:(\d+)", code.strip())) else -1
    if n in (4326, 4283, 4269):
        return (lambda lon, lat: (lon, lat)), (lambda x, y: (x, y))
    if n == 3857:
        return to_web_mercator, from_web_mercator
    if n == 3577:
        return to_albers, from_albers
    for base, south, first, last in ((32600, False, 1, 60), (32700, True, 1, 60), (28300, True, 46, 59)):
        if first <= n - base <= last:
            zone = n - base
            return (lambda lon, lat: to_utm(lon, lat, zone, south)), (lambda x, y: from_utm(x, y, zone, south))
    raise ResampleNeeded(f"no way is known to or from {code!r}")


def transform(source: str, target: str) -> Callable:
    """(x, y) of ``source`` to ``target``: geographic, web Mercator, UTM and MGA zones, Australian Albers, by EPSG code."""
    if source == target:
        return lambda x, y: (x, y)
    back, on = _ways(source)[1], _ways(target)[0]

    def way(x, y):
        lon, lat = back(x, y)
        if not isinstance(lon, Column):
            return on(lon, lat)
        place = F.struct(lon.alias("lon"), lat.alias("lat"))
        return _let(place, lambda p: on(p["lon"], p["lat"])[0]), _let(place, lambda p: on(p["lon"], p["lat"])[1])

    return way
