"""Distances, grids and rings as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

EARTH_M = 6371000.0


def haversine(lat1, lon1, lat2, lon2):
    """Metres between two points; null if a coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.nanvl(F.asin(F.sqrt(a)), F.lit(math.pi / 2))  # rounding may lift a above 1


#: Fixed values of the national 5 km forecast grid: radius km, spacing km, two standard parallels, origin lon/lat, origin cell.
LAMBERT = {"re": 6371.00877, "grid": 5.0, "slat1": 30.0, "slat2": 60.0, "olon": 126.0, "olat": 38.0, "xo": 43, "yo": 136}


def lambert_constants() -> dict:
    rad, p = math.pi / 180, LAMBERT
    re = p["re"] / p["grid"]
    s1, s2, ol = p["slat1"] * rad, p["slat2"] * rad, p["olat"] * rad
    tan = lambda x: math.tan(math.pi / 4 + x / 2)
    sn = math.log(math.cos(s1) / math.cos(s2)) / math.log(tan(s2) / tan(s1))
    sf = tan(s1) ** sn * math.cos(s1) / sn
    return {"re": re, "sn": sn, "sf": sf, "ro": re * sf / tan(ol) ** sn, "olon": p["olon"] * rad, "xo": p["xo"], "yo": p["yo"]}


def lambert_cell(lat, lon):
    """(nx, ny) of the 5 km grid."""
    k = lambert_constants()
    ra = F.lit(k["re"] * k["sf"]) / F.pow(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2), F.lit(k["sn"]))
    theta = (F.radians(lon) - F.lit(k["olon"])) * F.lit(k["sn"])
    return F.floor(ra * F.sin(theta) + k["xo"] + 0.5), F.floor(F.lit(k["ro"]) - ra * F.cos(theta) + k["yo"] + 0.5)


def lambert_point(nx, ny):
    """(lat, lon) of a grid place, also between cells: the inverse of lambert_cell's projection."""
    k = lambert_constants()
    x, y = nx - F.lit(float(k["xo"])), F.lit(k["ro"] + k["yo"]) - ny
    ra = F.sqrt(x * x + y * y)
    lat = F.lit(2.0) * F.atan(F.pow(F.lit(k["re"] * k["sf"]) / ra, F.lit(1 / k["sn"]))) - F.lit(math.pi / 2)
    return F.degrees(lat), F.degrees(F.atan2(x, y) / k["sn"] + k["olon"])


def cell_of(lat, lon, size: float = 0.01):
    """Row and column of a square grid, for bucket joins."""
    return F.floor(lat / size), F.floor(lon / size)


def ring_edges(ring):
    """A ring's edges (array of struct x, y; closed or not): from (x, y) to (x2, y2), with dx, dy and squared length (null if 0)."""
    n = F.size(ring)

    def edge(a, i):
        b = F.get(ring, (i + 1) % n)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        return F.struct(a["x"].alias("x"), a["y"].alias("y"), b["y"].alias("y2"), dx.alias("dx"), dy.alias("dy"), F.nullif(dx * dx + dy * dy, F.lit(0.0)).alias("long"))

    return F.transform(ring, edge)


def _crossings(x, y, edges):
    hit = lambda e: ((e["y"] > y) != (e["y2"] > y)) & (x < e["dx"] * (y - e["y"]) / F.nullif(e["dy"], F.lit(0.0)) + e["x"])
    return F.size(F.filter(edges, hit))


def in_ring(x, y, ring):
    """Ray cast: whether the point is inside the ring (array of struct x, y; closed or not)."""
    return _crossings(x, y, ring_edges(ring)) % 2 == 1


def edges_metres(lat, lon, edges):
    """Metres from a point to an area of ring_edges(): 0 inside its ring, else to the place of its boundary that is nearest in the plane.

    Each step is an array of its own: a later one names its values instead of repeating how they come about, for lambdas
    are evaluated as they are written."""
    along = lambda e: ((lon - e["x"]) * e["dx"] + (lat - e["y"]) * e["dy"]) / e["long"]
    t = F.transform(edges, lambda e: F.struct(e.alias("e"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along(e), F.lit(0.0)))).alias("t")))
    foot = F.transform(t, lambda s: F.struct((s["e"]["x"] + s["t"] * s["e"]["dx"]).alias("x"), (s["e"]["y"] + s["t"] * s["e"]["dy"]).alias("y")))
    d2 = F.transform(foot, lambda f: F.struct(((lon - f["x"]) * (lon - f["x"]) + (lat - f["y"]) * (lat - f["y"])).alias("d2"), f["x"].alias("x"), f["y"].alias("y")))
    far = F.transform(F.array(F.array_min(d2)), lambda f: haversine(lat, lon, f["y"], f["x"]))[0]
    return F.when(_crossings(lon, lat, edges) % 2 == 1, F.lit(0.0)).otherwise(far)


def wind_components(speed, direction):
    """(u, v) of a wind that blows from `direction` degrees."""
    return -speed * F.sin(F.radians(direction)), -speed * F.cos(F.radians(direction))
