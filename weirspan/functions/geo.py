"""Distances, projections, boxes and grid cells as column expressions. Degrees in, metres or kilometres out."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from weirspan.functions.steps import let

# Mean earth radius and kilometres per degree; the GRS80 ellipsoid; the parameters of the
# conterminous-US Albers projection; transverse Mercator scale and false easting; Web Mercator radius.
EARTH_KM = 6371.0
KM_PER_DEGREE = 111.0
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
ALBERS_LAT1, ALBERS_LAT2, ALBERS_LAT0, ALBERS_LON0 = 29.5, 45.5, 23.0, -96.0
UTM_SCALE, UTM_EAST = 0.9996, 500000.0

E2 = FLATTENING * (2 - FLATTENING)
E1 = math.sqrt(E2)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    a1, a2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a2 - a1) / 2), F.lit(2.0)) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))


def box(lat: Column, lon: Column, km: float) -> dict[str, Column]:
    """Box reaching ``km`` to every side; degrees of longitude shrink with latitude."""
    dy = F.lit(km / KM_PER_DEGREE)
    dx = F.lit(km / KM_PER_DEGREE) / F.cos(F.radians(lat))
    return {"xmin": lon - dx, "ymin": lat - dy, "xmax": lon + dx, "ymax": lat + dy}


def _authalic(sin_lat: float) -> float:
    s = sin_lat
    return (1 - E2) * (s / (1 - E2 * s * s) - math.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1))


def _albers_constants() -> tuple[float, float, float]:
    def m2(lat: float) -> float:
        return math.cos(lat) ** 2 / (1 - E2 * math.sin(lat) ** 2)

    p1, p2, p0 = (math.radians(v) for v in (ALBERS_LAT1, ALBERS_LAT2, ALBERS_LAT0))
    q1, q2, q0 = (_authalic(math.sin(p)) for p in (p1, p2, p0))
    n = (m2(p1) - m2(p2)) / (q2 - q1)
    c = m2(p1) + n * q1
    return n, c, AXIS * math.sqrt(c - n * q0) / n


ALBERS_N, ALBERS_C, ALBERS_RHO0 = _albers_constants()


def albers(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Equal-area metres for the conterminous US."""
    s = F.sin(F.radians(lat))
    q = F.lit(1 - E2) * (s / (1 - F.lit(E2) * s * s) - F.log((1 - F.lit(E1) * s) / (1 + F.lit(E1) * s)) / F.lit(2 * E1))
    rho = F.lit(AXIS / ALBERS_N) * F.sqrt(F.lit(ALBERS_C) - F.lit(ALBERS_N) * q)
    theta = F.lit(ALBERS_N) * F.radians(lon - F.lit(ALBERS_LON0))
    return rho * F.sin(theta), F.lit(ALBERS_RHO0) - rho * F.cos(theta)


AUTHALIC_POLE = _authalic(1.0)
# Coefficients of the published series of latitude in sines of even multiples of the authalic and of the rectifying latitude.
AUTHALIC_SERIES = (E2 / 3 + 31 * E2**2 / 180 + 517 * E2**3 / 5040, 23 * E2**2 / 360 + 251 * E2**3 / 3780, 761 * E2**3 / 45360)
_THIRD = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
FOOTPOINT_SERIES = (3 * _THIRD / 2 - 27 * _THIRD**3 / 32, 21 * _THIRD**2 / 16 - 55 * _THIRD**4 / 32, 151 * _THIRD**3 / 96, 1097 * _THIRD**4 / 512)


def _with_sines(angle: Column, series: tuple[float, ...]) -> Column:
    return sum((F.lit(c) * F.sin(2 * (k + 1) * angle) for k, c in enumerate(series)), angle)


def albers_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """Latitude and longitude of equal-area metres: series of the authalic latitude, then one Newton step."""
    down = F.lit(ALBERS_RHO0) - y
    q = (F.lit(ALBERS_C) - (x * x + down * down) * F.lit((ALBERS_N / AXIS) ** 2)) / F.lit(ALBERS_N)

    def refined(phi: Column) -> Column:
        s = F.sin(phi)
        w = 1 - F.lit(E2) * s * s
        miss = q / F.lit(1 - E2) - s / w + F.log((1 - F.lit(E1) * s) / (1 + F.lit(E1) * s)) / F.lit(2 * E1)
        return F.degrees(phi + w * w / (2 * F.cos(phi)) * miss)

    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / F.lit(AUTHALIC_POLE))))
    lat = let(let(beta, lambda b: _with_sines(b, AUTHALIC_SERIES)), refined)
    return lat, F.lit(ALBERS_LON0) + F.degrees(F.atan2(x, down)) / F.lit(ALBERS_N)


def utm_zone(lon: Column) -> Column:
    return F.floor((lon + 180) / 6).cast("int") + 1


def utm(lat: Column, lon: Column, zone: Column | None = None) -> tuple[Column, Column]:
    """Northern UTM easting and northing in the zone given, or that of the longitude (series to sixth order)."""
    phi = F.radians(lat)
    dl = F.radians(lon - ((utm_zone(lon) if zone is None else zone) * 6 - 183))
    ep2 = E2 / (1 - E2)
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    n = F.lit(AXIS) / F.sqrt(1 - F.lit(E2) * sin * sin)
    t, c, a = tan * tan, F.lit(ep2) * cos * cos, cos * dl
    m = F.lit(AXIS) * (
        F.lit(1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256) * phi
        - F.lit(3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024) * F.sin(2 * phi)
        + F.lit(15 * E2**2 / 256 + 45 * E2**3 / 1024) * F.sin(4 * phi)
        - F.lit(35 * E2**3 / 3072) * F.sin(6 * phi)
    )
    a2 = a * a
    east = F.lit(UTM_EAST) + F.lit(UTM_SCALE) * n * (
        a + (1 - t + c) * a2 * a / 6 + (5 - 18 * t + t * t + 72 * c - F.lit(58 * ep2)) * a2 * a2 * a / 120
    )
    north = F.lit(UTM_SCALE) * (
        m + n * tan * (a2 / 2 + (5 - t + 9 * c + 4 * c * c) * a2 * a2 / 24 + (61 - 58 * t + t * t + 600 * c - F.lit(330 * ep2)) * a2 * a2 * a2 / 720)
    )
    return east, north


def utm_inverse(east: Column, north: Column, zone: Column) -> tuple[Column, Column]:
    """Latitude and longitude of northern UTM metres, from the latitude at which the meridian is as long (series to sixth order)."""
    mu = north / F.lit(UTM_SCALE * AXIS * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
    ep2 = E2 / (1 - E2)

    def point(phi: Column) -> Column:
        sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
        w = 1 - F.lit(E2) * sin * sin
        t, c, n = tan * tan, F.lit(ep2) * cos * cos, F.lit(AXIS) / F.sqrt(w)
        d = (east - F.lit(UTM_EAST)) / (F.lit(UTM_SCALE) * n)
        d2 = d * d
        # n tan / r, with the meridian radius r = n (1 - e2) / w
        lat = phi - tan * w / F.lit(1 - E2) * d2 * (
            F.lit(0.5) - (5 + 3 * t + 10 * c - 4 * c * c - F.lit(9 * ep2)) * d2 / 24
            + (61 + 90 * t + 298 * c + 45 * t * t - F.lit(252 * ep2) - 3 * c * c) * d2 * d2 / 720
        )
        lon = d * (1 - (1 + 2 * t + c) * d2 / 6 + (5 - 2 * c + 28 * t - 3 * c * c + F.lit(8 * ep2) + 24 * t * t) * d2 * d2 / 120) / cos
        return F.struct(F.degrees(lat).alias("lat"), (zone * 6 - 183 + F.degrees(lon)).alias("lon"))

    at = let(let(mu, lambda m: _with_sines(m, FOOTPOINT_SERIES)), point)
    return at["lat"], at["lon"]


def web_mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    return F.lit(AXIS) * F.radians(lon), F.lit(AXIS) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def web_mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(2 * F.atan(F.exp(y / F.lit(AXIS))) - F.lit(math.pi / 2)), F.degrees(x / F.lit(AXIS))


# Codes of the reference systems. Northern UTM zones are 326zz and 269zz; their two datums lie within a metre and are not told apart.
DEGREES, ALBERS_CODE, WEB_MERCATOR_CODE = 4326, 5070, 3857
DEGREE_CODES = (4326, 4269)
UTM_CODES = (32600, 26900)


def zone_of_code(code: int) -> int | None:
    """Zone of the code of a northern UTM system."""
    return next((code - base for base in UTM_CODES if 1 <= code - base <= 60), None)


def to_degrees(code: int, x: Column, y: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a point in the reference system ``code``."""
    zone = zone_of_code(code)
    if code in DEGREE_CODES:
        return y, x
    if zone:
        return utm_inverse(x, y, F.lit(zone))
    if code == ALBERS_CODE:
        return albers_inverse(x, y)
    if code == WEB_MERCATOR_CODE:
        return web_mercator_inverse(x, y)
    raise ValueError(f"unknown reference system {code}")


def from_degrees(code: int, lat: Column, lon: Column) -> tuple[Column, Column]:
    """``x`` and ``y`` in the reference system ``code``."""
    zone = zone_of_code(code)
    if code in DEGREE_CODES:
        return lon, lat
    if zone:
        return utm(lat, lon, F.lit(zone))
    if code == ALBERS_CODE:
        return albers(lat, lon)
    if code == WEB_MERCATOR_CODE:
        return web_mercator(lat, lon)
    raise ValueError(f"unknown reference system {code}")


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a segment."""
    f = segment_fraction(px, py, x1, y1, x2, y2)
    return F.hypot(px - (x1 + f * (x2 - x1)), py - (y1 + f * (y2 - y1)))


def segment_fraction(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Position of the nearest point on a segment, 0 at its start and 1 at its end."""
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    return F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / F.when(square > 0, square)))).otherwise(F.lit(0.0))


def segments_distance(a: list[Column], b: list[Column]) -> Column:
    """Distance of two segments ``[x1, y1, x2, y2]``: 0 if they cross, else the nearest end point."""
    ax, ay, bx, by = a
    cx, cy, dx, dy = b

    def side(px, py, qx, qy, rx, ry):
        return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))

    crossing = (side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) < 0) & (side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) < 0)
    ends = F.least(
        segment_distance(ax, ay, cx, cy, dx, dy), segment_distance(bx, by, cx, cy, dx, dy),
        segment_distance(cx, cy, ax, ay, bx, by), segment_distance(dx, dy, ax, ay, bx, by),
    )
    return F.when(crossing, F.lit(0.0)).otherwise(ends)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test of a point against a ring ``array<struct<x,y>>``, closed or open."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, F.when(i == n, 1).otherwise(i + 1))
        straddles = (a["y"] > y) != (b["y"] > y)
        at = (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) + a["x"]
        return F.when(straddles & (x < at), F.lit(1)).otherwise(F.lit(0))

    hits = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + crosses(i))
    return let(hits, lambda h: h % 2 == 1)


def grid_cell(x: Column, y: Column, x0: Column, y0: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """Row and column of a raster with origin ``(x0, y0)`` at the top left; rows count downwards."""
    return ((y0 - y) / dy).cast("int"), ((x - x0) / dx).cast("int")


def cell_centre(row: Column, col: Column, x0: Column, y0: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    return x0 + (col + 0.5) * dx, y0 - (row + 0.5) * dy
