"""Projections from published formulas (Snyder, USGS Professional Paper 1395; Krüger's series for UTM), WGS84 and GRS80.

Each projection is written once over an arithmetic namespace, so that it works on numpy arrays and on Spark columns
alike: ``forward`` takes degrees to metres, ``inverse`` metres to degrees. Datum shifts between WGS84 and GRS80 datums
(below a metre or two) are not applied.
"""

from __future__ import annotations

import math
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

A, FLAT = 6378137.0, 1 / 298.257223563
GRS = 1 / 298.257222101

NUMPY = SimpleNamespace(sin=np.sin, cos=np.cos, tan=np.tan, atan=np.arctan, asin=np.arcsin, atan2=np.arctan2, exp=np.exp, log=np.log, sqrt=np.sqrt, sinh=np.sinh, cosh=np.cosh, asinh=np.arcsinh, atanh=np.arctanh, where=np.where, clip=lambda x, a, b: np.clip(x, a, b))
SPARK = SimpleNamespace(sin=F.sin, cos=F.cos, tan=F.tan, atan=F.atan, asin=F.asin, atan2=F.atan2, exp=F.exp, log=F.log, sqrt=F.sqrt, sinh=F.sinh, cosh=F.cosh, asinh=F.asinh, atanh=F.atanh, where=lambda c, a, b: F.when(c, a).otherwise(b), clip=lambda x, a, b: F.greatest(F.lit(a), F.least(F.lit(b), x)))


def _m(x) -> SimpleNamespace:
    return SPARK if isinstance(x, Column) else NUMPY


def epsg(crs: str | int) -> int:
    """The code of ``EPSG:n``, a number, or a URN that ends in one."""
    s = str(crs).strip()
    n = s.rsplit(":", 1)[-1]
    if not n.isdigit():
        raise ValueError(f"Only EPSG codes are known, not {crs!r}")
    return int(n)


def norm_crs(crs: str | int) -> str:
    return f"EPSG:{epsg(crs)}"


class LonLat:
    def forward(self, lon, lat):
        return lon, lat

    inverse = forward


class Mercator:
    """Spherical, as web maps use it."""

    def forward(self, lon, lat):
        m = _m(lon)
        return A * lon * (math.pi / 180), A * m.atanh(m.sin(lat * (math.pi / 180)))

    def inverse(self, x, y):
        m = _m(x)
        return x / A * (180 / math.pi), m.atan(m.sinh(y / A)) * (180 / math.pi)


class TransverseMercator:
    """Krüger's series to the sixth order in n."""

    def __init__(self, lon0: float, k0: float = 0.9996, fe: float = 500000.0, fn: float = 0.0, flat: float = FLAT):
        n = flat / (2 - flat)
        self.lon0, self.fe, self.fn = lon0, fe, fn
        self.e = math.sqrt(flat * (2 - flat))
        self.k = k0 * A / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
        self.alpha = (
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
            13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
            61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
            49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
            34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
            212378941 * n**6 / 319334400,
        )
        self.beta = (
            n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360 - 81 * n**5 / 512 + 96199 * n**6 / 604800,
            n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440 + 46 * n**5 / 105 - 1118711 * n**6 / 3870720,
            17 * n**3 / 480 - 37 * n**4 / 840 - 209 * n**5 / 4480 + 5569 * n**6 / 90720,
            4397 * n**4 / 161280 - 11 * n**5 / 504 - 830251 * n**6 / 7257600,
            4583 * n**5 / 161280 - 108847 * n**6 / 3991680,
            20648693 * n**6 / 638668800,
        )

    def forward(self, lon, lat):
        m = _m(lon)
        lam, phi = (lon - self.lon0) * (math.pi / 180), lat * (math.pi / 180)
        s = m.sin(phi)
        t = m.sinh(m.atanh(s) - self.e * m.atanh(self.e * s))
        xi, eta = m.atan2(t, m.cos(lam)), m.asinh(m.sin(lam) / m.sqrt(t * t + m.cos(lam) * m.cos(lam)))
        x, y = eta, xi
        for j, a in enumerate(self.alpha, 1):
            x = x + a * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
            y = y + a * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
        return self.fe + self.k * x, self.fn + self.k * y

    def inverse(self, x, y):
        m = _m(x)
        xi0, eta0 = (y - self.fn) / self.k, (x - self.fe) / self.k
        xi, eta = xi0, eta0
        for j, b in enumerate(self.beta, 1):
            xi = xi - b * m.sin(2 * j * xi0) * m.cosh(2 * j * eta0)
            eta = eta - b * m.cos(2 * j * xi0) * m.sinh(2 * j * eta0)
        lam = m.atan2(m.sinh(eta), m.cos(xi))
        t0 = m.sin(xi) / m.sqrt(m.sinh(eta) * m.sinh(eta) + m.cos(xi) * m.cos(xi))
        t = t0
        e2 = self.e**2
        for _ in range(3):  # Newton steps for the tangent of the latitude
            root = m.sqrt(1 + t * t)
            sig = m.sinh(self.e * m.atanh(self.e * t / root))
            ti = t * m.sqrt(1 + sig * sig) - sig * root
            t = t + (t0 - ti) / m.sqrt(1 + ti * ti) * (1 + (1 - e2) * t * t) / ((1 - e2) * root)
        return self.lon0 + lam * (180 / math.pi), m.atan(t) * (180 / math.pi)


def _q(m, s, e):
    """Snyder's q for the authalic latitude."""
    return (1 - e * e) * (s / (1 - e * e * s * s) + m.atanh(e * s) / e)


def _authalic_inverse(m, beta, e):
    e2, e4, e6 = e**2, e**4, e**6
    return beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * m.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * m.sin(4 * beta) + 761 * e6 / 45360 * m.sin(6 * beta)


class Albers:
    """Equal-area conic with two standard parallels."""

    def __init__(self, lon0: float, lat0: float, lat1: float, lat2: float, fe: float = 0.0, fn: float = 0.0, flat: float = GRS):
        self.lon0, self.fe, self.fn = lon0, fe, fn
        e = self.e = math.sqrt(flat * (2 - flat))
        s0, s1, s2 = (math.sin(math.radians(v)) for v in (lat0, lat1, lat2))
        m1, m2 = (math.cos(math.radians(v)) / math.sqrt(1 - e * e * s * s) for v, s in ((lat1, s1), (lat2, s2)))
        q0, q1, q2 = (_q(math, s, e) for s in (s0, s1, s2))
        self.n = (m1 * m1 - m2 * m2) / (q2 - q1)
        self.c = m1 * m1 + self.n * q1
        self.rho0 = A * math.sqrt(self.c - self.n * q0) / self.n
        self.qp = _q(math, 1.0, e)

    def forward(self, lon, lat):
        m = _m(lon)
        rho = m.sqrt(self.c - self.n * _q(m, m.sin(lat * (math.pi / 180)), self.e)) * (A / self.n)
        th = (lon - self.lon0) * (self.n * math.pi / 180)
        return self.fe + rho * m.sin(th), self.fn + self.rho0 - rho * m.cos(th)

    def inverse(self, x, y):
        m = _m(x)
        x, y = x - self.fe, self.rho0 - (y - self.fn)
        sign = 1.0 if self.n > 0 else -1.0
        rho = m.sqrt(x * x + y * y) * sign
        th = m.atan2(x * sign, y * sign)
        q = (self.c - (rho * self.n / A) * (rho * self.n / A)) / self.n
        beta = m.asin(m.clip(q / self.qp, -1.0, 1.0))
        return self.lon0 + th * (180 / math.pi / self.n), _authalic_inverse(m, beta, self.e) * (180 / math.pi)


class PolarStereographic:
    """South polar, true to scale at a parallel."""

    def __init__(self, lon0: float, lat_ts: float, flat: float = FLAT):
        self.lon0 = lon0
        e = self.e = math.sqrt(flat * (2 - flat))
        p = math.radians(-lat_ts)
        self.tc = math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
        self.mc = math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)

    def forward(self, lon, lat):
        m = _m(lon)
        p, s = lat * (-math.pi / 180), m.sin(lat * (-math.pi / 180))
        t = m.tan(math.pi / 4 - p / 2) * m.exp(self.e * m.atanh(self.e * s))
        rho, lam = A * self.mc / self.tc * t, (lon - self.lon0) * (math.pi / 180)
        return rho * m.sin(lam), rho * m.cos(lam)

    def inverse(self, x, y):
        m = _m(x)
        t = m.sqrt(x * x + y * y) * (self.tc / (A * self.mc))
        chi = math.pi / 2 - 2 * m.atan(t)
        e2 = self.e**2
        phi = chi + (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360) * m.sin(2 * chi) + (7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520) * m.sin(4 * chi) + (7 * e2**3 / 120 + 81 * e2**4 / 1120) * m.sin(6 * chi) + 4279 * e2**4 / 161280 * m.sin(8 * chi)
        return self.lon0 + m.atan2(x, y) * (180 / math.pi), phi * (-180 / math.pi)


class CylindricalEqualArea:
    """Equal-area cylindrical (EASE-Grid 2.0 global)."""

    def __init__(self, lat_ts: float, lon0: float = 0.0, flat: float = FLAT):
        e = self.e = math.sqrt(flat * (2 - flat))
        self.lon0 = lon0
        self.k0 = math.cos(math.radians(lat_ts)) / math.sqrt(1 - (e * math.sin(math.radians(lat_ts))) ** 2)
        self.qp = _q(math, 1.0, e)

    def forward(self, lon, lat):
        m = _m(lon)
        return (lon - self.lon0) * (A * self.k0 * math.pi / 180), _q(m, m.sin(lat * (math.pi / 180)), self.e) * (A / (2 * self.k0))

    def inverse(self, x, y):
        m = _m(x)
        beta = m.asin(m.clip(y * (2 * self.k0 / (A * self.qp)), -1.0, 1.0))
        return self.lon0 + x * (180 / math.pi / (A * self.k0)), _authalic_inverse(m, beta, self.e) * (180 / math.pi)


def projection(crs: str | int):
    n = epsg(crs)
    if n in (4326, 4269, 4283, 4979):
        return LonLat()
    if n in (3857, 900913):
        return Mercator()
    if 32601 <= n <= 32660 or 32701 <= n <= 32760:
        return TransverseMercator((n % 100) * 6 - 183, fn=10000000.0 if n > 32700 else 0.0)
    if 28348 <= n <= 28358 or 7846 <= n <= 7859:  # MGA zones
        zone = n - 28300 if n > 20000 else n - 7800
        return TransverseMercator(zone * 6 - 183, fn=10000000.0, flat=GRS)
    if n in (3577, 9473):
        return Albers(132.0, 0.0, -18.0, -36.0)
    if n == 5070:
        return Albers(-96.0, 23.0, 29.5, 45.5)
    if n == 3031:
        return PolarStereographic(0.0, -71.0)
    if n == 6933:
        return CylindricalEqualArea(30.0)
    raise ValueError(f"EPSG:{n} is not known here")


def transform(x, y, source: str | int, target: str | int):
    """Coordinates from one projection to another; numpy arrays or columns."""
    if epsg(source) == epsg(target):
        return x, y
    return projection(target).forward(*projection(source).inverse(x, y))


def is_geographic(crs: str | int) -> bool:
    return isinstance(projection(crs), LonLat)


def utm_of(lon: float, lat: float) -> str:
    """The UTM zone of a place."""
    zone = min(60, max(1, int(math.floor((lon + 180) / 6)) + 1))
    return f"EPSG:{(32600 if lat >= 0 else 32700) + zone}"


def pick_crs(crs: str | int, bbox: tuple[float, float, float, float]) -> str:
    """A projection; ``utm``, ``utm-n`` and ``utm-s`` mean the zone of a box in degrees."""
    s = str(crs).lower()
    if not s.startswith("utm"):
        return norm_crs(crs)
    lon, lat = (bbox[0] + bbox[2]) / 2, (bbox[1] + bbox[3]) / 2
    return utm_of(lon, abs(lat) if s == "utm-n" else -abs(lat) - 1e-9 if s == "utm-s" else lat)


def densified(ring: list[tuple[float, float]], step: float) -> list[tuple[float, float]]:
    """A ring with points added so that none are further apart than ``step``."""
    out = [ring[0]]
    for (x0, y0), (x1, y1) in zip(ring[:-1], ring[1:], strict=True):
        n = max(1, math.ceil(math.hypot(x1 - x0, y1 - y0) / step)) if step > 0 else 1
        out += [(x0 + (x1 - x0) * k / n, y0 + (y1 - y0) * k / n) for k in range(1, n + 1)]
    return out


def area(ring: list[tuple[float, float]]) -> float:
    return abs(sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(ring[:-1], ring[1:], strict=True))) / 2


def reproject_ring(ring: list[tuple[float, float]], source: str, target: str) -> list[tuple[float, float]]:
    """A ring in another projection, its edges first cut to a step of sqrt(area) * 4 / 100."""
    if epsg(source) == epsg(target):
        return ring
    pts = np.array(densified(ring, math.sqrt(area(ring)) * 4 / 100), float)
    x, y = transform(pts[:, 0], pts[:, 1], source, target)
    return list(zip(np.asarray(x).tolist(), np.asarray(y).tolist(), strict=True))
