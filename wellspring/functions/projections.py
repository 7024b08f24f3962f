"""Map projections as Column expressions, in metres."""

from __future__ import annotations

from math import cos, log, pi, radians, sin, sqrt, tan

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semi-major axis and squared eccentricity of ellipsoids.
ELLIPSOIDS = {"grs80": (6378137.0, 0.00669438002290), "wgs84": (6378137.0, 0.00669437999014), "clarke1866": (6378206.4, 0.00676865799761)}


def lambert_conic(lat: Column, lon: Column, lat1: float, lat2: float, lat0: float, lon0: float, ellipsoid: str = "grs80", east0: float = 0.0, north0: float = 0.0) -> tuple[Column, Column]:
    """Lambert conformal conic with two standard parallels (x, y)."""
    a, e2 = ELLIPSOIDS[ellipsoid]
    e = sqrt(e2)

    def m(p: float) -> float:
        return cos(p) / sqrt(1 - e2 * sin(p) ** 2)

    def t(p: float) -> float:
        return tan(pi / 4 - p / 2) * ((1 + e * sin(p)) / (1 - e * sin(p))) ** (e / 2)

    p1, p2, p0 = radians(lat1), radians(lat2), radians(lat0)
    n = sin(p1) if lat1 == lat2 else (log(m(p1)) - log(m(p2))) / (log(t(p1)) - log(t(p2)))
    scale = a * m(p1) / (n * t(p1) ** n)
    phi = F.radians(lat)
    here = F.tan(F.lit(pi / 4) - phi / 2) * F.pow((1 + e * F.sin(phi)) / (1 - e * F.sin(phi)), F.lit(e / 2))
    rho, theta = scale * F.pow(here, F.lit(n)), n * F.radians(lon - lon0)
    return east0 + rho * F.sin(theta), north0 + scale * t(p0) ** n - rho * F.cos(theta)


def _equal_area(standard: float) -> tuple[float, float, float, float]:
    """Axis, eccentricity, scale at the standard parallel, and q of the pole."""
    a, e2 = ELLIPSOIDS["wgs84"]
    e = sqrt(e2)
    return a, e, cos(radians(standard)) / sqrt(1 - e2 * sin(radians(standard)) ** 2), (1 - e2) * (1 / (1 - e2) - log((1 - e) / (1 + e)) / (2 * e))


def equal_area(lat: Column, lon: Column, standard: float = 30.0) -> tuple[Column, Column]:
    """Cylindrical equal-area projection on WGS84 (x, y)."""
    a, e, k0, _ = _equal_area(standard)
    s = F.sin(F.radians(lat))
    q = (1 - e * e) * (s / (1 - e * e * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    return a * k0 * F.radians(lon), a * q / (2 * k0)


def equal_area_inverse(x: Column, y: Column, standard: float = 30.0) -> tuple[Column, Column]:
    """(latitude, longitude) of a place in that projection."""
    a, e, k0, pole = _equal_area(standard)
    beta = F.asin(F.least(F.greatest(2 * y * k0 / (a * pole), F.lit(-1.0)), F.lit(1.0)))
    e2, e4, e6 = e**2, e**4, e**6
    lat = beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + (761 * e6 / 45360) * F.sin(6 * beta)
    return F.degrees(lat), F.degrees(x / (a * k0))
