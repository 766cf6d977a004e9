"""Coordinate systems as formulas for columns and for numbers.

A system is an EPSG code that CODES or the UTM zones on WGS84 name, or a definition in PROJ's notation (``+proj=lcc +lat_1=33 ...``):
longitude and latitude, spherical (web) Mercator, transverse Mercator by Krüger's series, and the conics of Lambert (conformal) and
Albers (of equal area) on any ellipsoid, with datums that three shifts lead to WGS84.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0
GEOGRAPHIC, MERCATOR = ("EPSG:4326", "EPSG:4269", "OGC:CRS84"), ("EPSG:3857", "EPSG:900913")

# Ellipsoids (half axis, reciprocal flattening), shifts of datums to WGS84, units in metres, definitions of codes.
ELLIPSOIDS = {"WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101), "clrk66": (6378206.4, 294.9786982), "intl": (6378388.0, 297.0), "airy": (6377563.396, 299.3249646), "bessel": (6377397.155, 299.1528128), "sphere": (6370997.0, math.inf)}
DATUMS = {"WGS84": ("WGS84", (0.0, 0.0, 0.0)), "NAD83": ("GRS80", (0.0, 0.0, 0.0)), "NAD27": ("clrk66", (-8.0, 160.0, 176.0))}
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "us-ft": 1200 / 3937}
CODES = {
    "EPSG:2154": "+proj=lcc +lat_0=46.5 +lon_0=3 +lat_1=49 +lat_2=44 +x_0=700000 +y_0=6600000 +ellps=GRS80",
    "EPSG:3034": "+proj=lcc +lat_0=52 +lon_0=10 +lat_1=35 +lat_2=65 +x_0=4000000 +y_0=2800000 +ellps=GRS80",
    "EPSG:3310": "+proj=aea +lat_0=0 +lon_0=-120 +lat_1=34 +lat_2=40.5 +x_0=0 +y_0=-4000000 +datum=NAD83",
    "EPSG:3577": "+proj=aea +lat_0=0 +lon_0=132 +lat_1=-18 +lat_2=-36 +x_0=0 +y_0=0 +ellps=GRS80",
    "EPSG:4267": "+proj=longlat +datum=NAD27",
    "EPSG:5070": "+proj=aea +lat_0=23 +lon_0=-96 +lat_1=29.5 +lat_2=45.5 +x_0=0 +y_0=0 +datum=NAD83",
}


@dataclass(frozen=True)
class System:
    """Angles in radians, lengths in metres. ``shift`` leads geocentric coordinates to WGS84."""

    kind: str
    a: float = RADIUS
    flattening: float = 1 / 298.257223563
    lat0: float = 0.0
    lon0: float = 0.0
    lat1: float = 0.0
    lat2: float = 0.0
    scale: float = 1.0
    x0: float = 0.0
    y0: float = 0.0
    shift: tuple[float, float, float] = (0.0, 0.0, 0.0)
    unit: float = 1.0

    @property
    def e2(self) -> float:
        return self.flattening * (2 - self.flattening)

    @property
    def e(self) -> float:
        return math.sqrt(self.e2)


def _defined(text: str) -> System:
    given = dict(p.lstrip("+").split("=", 1) if "=" in p else (p.lstrip("+"), "") for p in text.split())
    kind = given.get("proj")
    number = lambda name, default=0.0: float(given.get(name, default))
    if kind == "utm":
        return _zone(int(given["zone"]), "south" in given)
    if kind not in ("longlat", "latlong", "tmerc", "lcc", "aea"):
        raise ValueError(f"no formula for {text}")
    known = {"proj", "datum", "ellps", "a", "b", "rf", "towgs84", "lat_0", "lon_0", "lat_1", "lat_2", "k", "k_0", "x_0", "y_0", "units", "to_meter", "no_defs", "type", "wktext"}
    if more := given.keys() - known:
        raise ValueError(f"no formula for {', '.join(sorted(more))} in {text}")
    ellipsoid, shift = DATUMS[given["datum"]] if "datum" in given else (given.get("ellps", "WGS84"), (0.0, 0.0, 0.0))
    a, reciprocal = ELLIPSOIDS[given.get("ellps", ellipsoid)]
    if "a" in given:
        a, reciprocal = number("a"), math.inf
        reciprocal = number("rf") if "rf" in given else a / (a - number("b")) if number("b", a) != a else reciprocal
    if "towgs84" in given:
        values = [float(v) for v in given["towgs84"].split(",")]
        if any(values[3:]):
            raise ValueError("only the three shifts of a datum are supported, not turns and scales")
        shift = tuple((values + [0.0] * 3)[:3])
    rad = math.pi / 180
    lat0 = number("lat_0")
    lat1 = number("lat_1", lat0)
    unit = number("to_meter") if "to_meter" in given else UNITS[given.get("units", "m")]
    kind = "degrees" if kind in ("longlat", "latlong") else kind
    return System(kind, a, 1 / reciprocal, lat0 * rad, number("lon_0") * rad, lat1 * rad, number("lat_2", lat1) * rad, number("k_0", number("k", 1.0)), number("x_0"), number("y_0"), shift, unit)


def _zone(number: int, south: bool) -> System:
    return System("tmerc", lon0=math.radians(6 * number - 183), scale=0.9996, x0=500000.0, y0=10000000.0 if south else 0.0)


@functools.lru_cache(maxsize=256)
def system(crs: str) -> System:
    """The system of a code or a definition."""
    name = crs.strip()
    if name.startswith("+"):
        return _defined(name)
    name = name.upper()
    code = name.removeprefix("EPSG:")
    if name in GEOGRAPHIC:
        return System("degrees")
    if name in MERCATOR:
        return System("mercator")
    if name in CODES:
        return _defined(CODES[name])
    if code.isdigit() and int(code) // 100 in (326, 327) and 1 <= int(code) % 100 <= 60:
        return _zone(int(code) % 100, code.startswith("327"))
    raise ValueError(f"no formula for {crs}")


class Krueger:
    """The series of the transverse Mercator projection, to the third power of the third flattening."""

    def __init__(self, s: System):
        n = s.flattening / (2 - s.flattening)
        self.e = s.e
        self.radius = s.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        self.alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
        self.beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
        self.delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)

    def forward(self, m, turn, lat):
        sine = m.sin(lat)
        t = m.sinh(m.atanh(sine) - m.atanh(sine * self.e) * self.e)
        xi, eta = m.atan(t / m.cos(turn)), m.atanh(m.sin(turn) / m.sqrt(t * t + 1))
        up, right = xi, eta
        for j, c in enumerate(self.alpha, 1):
            up = up + m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * c
            right = right + m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * c
        return right, up

    def inverse(self, m, right, up):
        xi, eta = up, right
        for j, c in enumerate(self.beta, 1):
            xi = xi - m.sin(up * (2 * j)) * m.cosh(right * (2 * j)) * c
            eta = eta - m.cos(up * (2 * j)) * m.sinh(right * (2 * j)) * c
        chi = m.asin(m.sin(xi) / m.cosh(eta))
        lat = chi
        for j, c in enumerate(self.delta, 1):
            lat = lat + m.sin(chi * (2 * j)) * c
        return m.atan(m.sinh(eta) / m.cos(xi)), lat


def _cosine(s: System, lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - s.e2 * math.sin(lat) ** 2)


def _conformal(m, s: System, lat):
    """Tangent of half the conformal colatitude."""
    sine = m.sin(lat) * s.e
    return m.tan(lat * -0.5 + math.pi / 4) / m.pow((sine * -1 + 1) / (sine + 1), s.e / 2)


def _authalic(m, s: System, lat):
    if not s.e:
        return m.sin(lat) * 2
    sine = m.sin(lat) * s.e
    return (m.sin(lat) / (sine * sine * -1 + 1) - m.log((sine * -1 + 1) / (sine + 1)) / (2 * s.e)) * (1 - s.e2)


def _cone(s: System) -> tuple[float, float, float]:
    """The cone's constant, its other factor, and the radius of the origin's parallel."""
    m1, m2, level = _cosine(s, s.lat1), _cosine(s, s.lat2), abs(s.lat1 - s.lat2) < 1e-10
    if s.kind == "lcc":
        t1, t2 = _conformal(math, s, s.lat1), _conformal(math, s, s.lat2)
        n = math.sin(s.lat1) if level else math.log(m1 / m2) / math.log(t1 / t2)
        c = s.a * s.scale * m1 / (n * t1**n)
        return n, c, c * _conformal(math, s, s.lat0) ** n
    q1, q2 = _authalic(math, s, s.lat1), _authalic(math, s, s.lat2)
    n = math.sin(s.lat1) if level else (m1**2 - m2**2) / (q2 - q1)
    c = m1**2 + n * q1
    return n, c, s.a * math.sqrt(c - n * _authalic(math, s, s.lat0)) / n


def _series(m, angle, terms):
    out = angle
    for j, c in enumerate(terms, 1):
        out = out + m.sin(angle * (2 * j)) * c
    return out


def _to_radians(m, x, y, s: System):
    """Longitude and latitude on the system's own ellipsoid. ``m`` has the functions: math for numbers, pyspark.sql.functions for columns."""
    if s.kind == "degrees":
        return x * (math.pi / 180), y * (math.pi / 180)
    if s.kind == "mercator":
        return x / RADIUS, m.atan(m.exp(y / RADIUS)) * 2 - math.pi / 2
    x, y = x * s.unit - s.x0, y * s.unit - s.y0
    if s.kind == "tmerc":
        k = Krueger(s)
        _, up0 = k.forward(math, 0.0, s.lat0)
        turn, lat = k.inverse(m, x / (s.scale * k.radius), y / (s.scale * k.radius) + up0)
        return turn + s.lon0, lat
    n, c, r0 = _cone(s)
    sign = math.copysign(1.0, n)
    down = y * -1 + r0
    turn = m.atan2(x * sign, down * sign) / n + s.lon0
    e2 = s.e2
    if s.kind == "lcc":
        t = m.pow(m.sqrt(x * x + down * down) * sign / c, 1 / n)
        terms = (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360, 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520, 7 * e2**3 / 120 + 81 * e2**4 / 1120, 4279 * e2**4 / 161280)
        return turn, _series(m, m.atan(t) * -2 + math.pi / 2, terms)
    q = ((x * x + down * down) * (-((n / s.a) ** 2)) + c) / n
    terms = (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360)
    return turn, _series(m, m.asin(q / _authalic(math, s, math.pi / 2)), terms)


def _from_radians(m, lon, lat, s: System):
    if s.kind == "degrees":
        return lon * (180 / math.pi), lat * (180 / math.pi)
    if s.kind == "mercator":
        return lon * RADIUS, m.log(m.tan(lat * 0.5 + math.pi / 4)) * RADIUS
    if s.kind == "tmerc":
        k = Krueger(s)
        _, up0 = k.forward(math, 0.0, s.lat0)
        right, up = k.forward(m, lon - s.lon0, lat)
        x, y = right * (s.scale * k.radius), (up - up0) * (s.scale * k.radius)
    else:
        n, c, r0 = _cone(s)
        r = m.pow(_conformal(m, s, lat), n) * c if s.kind == "lcc" else m.sqrt(_authalic(m, s, lat) * -n + c) * (s.a / n)
        angle = (lon - s.lon0) * n
        x, y = r * m.sin(angle), r * m.cos(angle) * -1 + r0
    return (x + s.x0) / s.unit, (y + s.y0) / s.unit


def _moved(m, lon, lat, of: System, to: System):
    """Longitude and latitude on another ellipsoid, by geocentric coordinates of points on the first."""
    sine = m.sin(lat)
    radius = of.a / m.sqrt(sine * sine * -of.e2 + 1)
    dx, dy, dz = (p - q for p, q in zip(of.shift, to.shift, strict=True))
    x, y, z = radius * m.cos(lat) * m.cos(lon) + dx, radius * m.cos(lat) * m.sin(lon) + dy, radius * (1 - of.e2) * sine + dz
    across, b = m.sqrt(x * x + y * y), to.a * (1 - to.flattening)
    flat = m.atan2(z * to.a, across * b)
    up = m.pow(m.sin(flat), 3) * (to.e2 / (1 - to.e2) * b) + z
    return m.atan2(y, x), m.atan2(up, across - m.pow(m.cos(flat), 3) * (to.e2 * to.a))


def _transformed(m, x, y, source: str, target: str):
    if source == target:
        return x, y
    of, to = system(source), system(target)
    if of == to:
        return x, y
    lon, lat = _to_radians(m, x, y, of)
    if of.shift != to.shift:
        lon, lat = _moved(m, lon, lat, of, to)
    return _from_radians(m, lon, lat, to)


def transform(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """Columns ``x``, ``y`` of ``source`` in ``target``. Transverse Mercator is good to a millimetre some ten degrees about its meridian.
    A latitude beyond a pole is no place and gives null, as do places that the formula has no value for."""
    if source != target and system(source).kind == "degrees":
        y = F.when(F.abs(y) <= 90, y)
    return _transformed(F, x, y, source, target)


def transform_point(x: float, y: float, source: str, target: str) -> tuple[float, float]:
    if source != target and system(source).kind == "degrees" and abs(y) > 90:
        raise ValueError(f"latitude {y} is beyond a pole")
    return _transformed(math, x, y, source, target)
