"""Points and distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ids of the reference systems and the mean earth radius in metres.
CARTESIAN, CARTESIAN_3D, WGS84, WGS84_3D = 7203, 9157, 4326, 4979
RADIUS = 6_371_008.8
NAMES = {CARTESIAN: "cartesian", CARTESIAN_3D: "cartesian-3d", WGS84: "wgs-84", WGS84_3D: "wgs-84-3d"}


def point(x: Column, y: Column, z: Column | None = None, srid: int | None = None) -> Column:
    """A point; null if a coordinate is null.  x is the longitude and y the latitude on the globe."""
    srid = srid or (CARTESIAN if z is None else CARTESIAN_3D)
    depth = F.lit(None).cast("double") if z is None else z.cast("double")
    whole = F.struct(F.lit(srid).alias("srid"), x.cast("double").alias("x"), y.cast("double").alias("y"), depth.alias("z"))
    known = x.isNotNull() & y.isNotNull() & (F.lit(True) if z is None else z.isNotNull())
    return F.when(known, whole)


def distance(a: Column, b: Column) -> Column:
    """Euclidean for cartesian points, metres along the great circle for geographic ones (with the
    difference in height as the third side); null for different systems."""
    dz = F.coalesce(a["z"], F.lit(0.0)) - F.coalesce(b["z"], F.lit(0.0))
    flat = F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2) + dz * dz)
    lat_a, lat_b = F.radians(a["y"]), F.radians(b["y"])
    h = F.pow(F.sin((lat_a - lat_b) / 2), 2) + F.cos(lat_a) * F.cos(lat_b) * F.pow(F.sin(F.radians(a["x"] - b["x"]) / 2), 2)
    arc = F.lit(2 * RADIUS) * F.asin(F.least(F.sqrt(h), F.lit(1.0)))
    globe = F.when(dz == 0, arc).otherwise(F.sqrt(arc * arc + dz * dz))
    return F.when(a["srid"] == b["srid"], F.when(a["srid"].isin(WGS84, WGS84_3D), globe).otherwise(flat))


def crs(p: Column) -> Column:
    out = F.lit(None).cast("string")
    for srid, name in NAMES.items():
        out = F.when(p["srid"] == srid, F.lit(name)).otherwise(out)
    return out


def within(rows: DataFrame, x: str, y: str, at: tuple[float, float], radius: float) -> DataFrame:
    """Rows whose cartesian point is within ``radius``: the bounding box reaches the scan, then the exact test."""
    cx, cy = at
    box = F.col(x).between(cx - radius, cx + radius) & F.col(y).between(cy - radius, cy + radius)
    return rows.filter(box).filter(F.sqrt(F.pow(F.col(x) - cx, 2) + F.pow(F.col(y) - cy, 2)) <= radius)


def point_of(names: dict[str, Column]) -> Column:
    """``point({x, y[, z]})`` or ``point({longitude, latitude[, height]})``; a latitude beyond 90 degrees
    or a longitude beyond 180 is an error."""
    if "longitude" not in names:
        return point(names["x"], names["y"], names.get("z"))
    lon, lat, height = names["longitude"], names["latitude"], names.get("height")
    outside = (F.abs(lon) > 180) | (F.abs(lat) > 90)
    lon = F.when(outside, F.raise_error(F.lit("a longitude or latitude is out of range")).cast("double")).otherwise(lon.cast("double"))
    return point(lon, lat, height, WGS84 if height is None else WGS84_3D)


def component(p: Column, name: str) -> Column:
    """x, y, z, longitude, latitude, height, srid or crs; null where a point has no such one."""
    globe = p["srid"].isin(WGS84, WGS84_3D)
    if name == "crs":
        return crs(p)
    alias = {"longitude": "x", "latitude": "y", "height": "z"}
    return F.when(globe, p[alias[name]]) if name in alias else p[name]


def equal(a: Column, b: Column) -> Column:
    """Points are equal if system and coordinates are; null if a side is null."""
    return F.when(a.isNotNull() & b.isNotNull(), a.eqNullSafe(b))


def order_key(p: Column) -> Column:
    """What ORDER BY sorts points by: system, then coordinates."""
    return F.when(p.isNotNull(), F.struct(p["srid"], p["x"], p["y"], F.coalesce(p["z"], F.lit(float("-inf")))))
