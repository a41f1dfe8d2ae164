"""Geometry as column expressions. Coordinates are arrays of structs (lon, lat); no native geometry is needed."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
#: Metres per degree of latitude (fixed values): for lengths and snapping, and for sampling and nearest nodes.
M_PER_DEG_NETWORK, M_PER_DEG_ROUTING = 110_570.0, 111_320.0
GRID = 240


def metres_per_degree_lon(lat: Column) -> Column:
    return F.lit(M_PER_DEG_ROUTING) * F.cos(F.radians(lat))


def flat_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, per_lat: float = M_PER_DEG_NETWORK) -> Column:
    """Equirectangular distance in metres at the mean latitude of the two points."""
    dx = (lon2 - lon1) * metres_per_degree_lon((lat1 + lat2) / 2)
    return F.sqrt(F.pow(dx, F.lit(2)) + F.pow((lat2 - lat1) * per_lat, F.lit(2)))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2))
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(a))


def polyline_length(coords: Column) -> Column:
    """Haversine length of an array of (lon, lat)."""
    steps = F.zip_with(F.slice(coords, F.lit(1), F.greatest(F.size(coords) - 1, F.lit(0))), F.slice(coords, F.lit(2), F.greatest(F.size(coords) - 1, F.lit(0))), lambda a, b: haversine(a.lat, a.lon, b.lat, b.lon))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def cell_of(lat: Column, lon: Column, west: Column, south: Column, east: Column, north: Column, n: int = GRID) -> Column:
    """Row (0: north) and column (0: west) of a point, clipped to the grid."""
    row = (north - lat) / (north - south) * n
    col = (lon - west) / (east - west) * n
    clip = lambda x: F.least(F.greatest(x.cast("int"), F.lit(0)), F.lit(n - 1))
    return F.struct(clip(row).alias("row"), clip(col).alias("col"))


def snap_key(lon: Column, lat: Column, lat0: float, snap_m: float) -> Column:
    """Node key of a point: metres over the snap distance, rounded half to even as the reference does."""
    x = lon * F.lit(M_PER_DEG_ROUTING * math.cos(math.radians(lat0))) / snap_m
    y = lat * F.lit(M_PER_DEG_NETWORK) / snap_m
    return F.struct(F.rint(x).cast("long").alias("kx"), F.rint(y).cast("long").alias("ky"))


def segment_distance_sq(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance of a point from a segment; the foot is clamped to its ends."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / length, F.lit(0.0)), F.lit(1.0)))
    return F.pow(px - (ax + t * dx), F.lit(2)) + F.pow(py - (ay + t * dy), F.lit(2))


def touches(coords: Column, west: float, south: float, east: float, north: float) -> Column:
    """Whether any vertex lies in the box, borders included. A line that crosses without a vertex inside does not touch."""
    return F.exists(coords, lambda c: c.lon.between(west, east) & c.lat.between(south, north))


def affine_point(row: Column, col: Column, transform: tuple[float, ...]) -> Column:
    """x, y of a cell's centre under an affine transform (a, b, c, d, e, f): x = a col + b row + c, y = d col + e row + f."""
    a, b, c, d, e, f = transform
    i, j = col + 0.5, row + 0.5
    return F.struct((a * i + b * j + c).alias("x"), (d * i + e * j + f).alias("y"))


def affine_cell(x: Column, y: Column, transform: tuple[float, ...]) -> Column:
    """row, col of a point under the inverse of an affine transform, cut towards zero."""
    a, b, c, d, e, f = transform
    det = a * e - b * d
    if not det:
        raise ValueError("the transform has no inverse")
    col, row = (e * (x - c) - b * (y - f)) / det, (a * (y - f) - d * (x - c)) / det
    return F.struct(row.cast("int").alias("row"), col.cast("int").alias("col"))


def parse_coordinates(raw: Column) -> Column:
    """Array of (lon, lat) from "lon,lat[,alt] lon,lat ..."; tokens that are no pair of numbers are skipped."""
    tokens = F.filter(F.split(F.trim(raw), "\\s+"), lambda t: t != "")
    pairs = F.transform(tokens, lambda t: F.struct(F.get(F.split(t, ","), F.lit(0)).try_cast("double").alias("lon"), F.get(F.split(t, ","), F.lit(1)).try_cast("double").alias("lat")))
    return F.filter(pairs, lambda c: c.lon.isNotNull() & c.lat.isNotNull())


def valid_coordinates(coords: Column) -> Column:
    """Finite points inside the world, to six decimals."""
    ok = lambda c: c.lon.between(-180, 180) & c.lat.between(-90, 90) & ~F.isnan(c.lon) & ~F.isnan(c.lat)
    return F.transform(F.filter(coords, ok), lambda c: F.struct(F.round(c.lon, 6).alias("lon"), F.round(c.lat, 6).alias("lat")))


def utm(lat: Column, lon: Column, zone: int) -> Column:
    """Easting and northing on the northern half of a UTM zone, by the transverse Mercator series on WGS84."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    big_a = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - F.lit(zone * 6 - 183.0))
    atanh = lambda x: F.log((1 + x) / (1 - x)) / 2
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((500_000 + k0 * big_a * east).alias("easting"), (k0 * big_a * north).alias("northing"))
