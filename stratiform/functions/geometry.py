"""Rings as arrays of (x, y) structs: area, validity, WKT and GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hexagon(cx: Column, cy: Column, radius: float) -> Column:
    """Pointy-top vertices at 30 + 60k degrees."""
    return F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.struct((cx + radius * F.cos(F.radians(k * 60.0 + 30))).alias("x"), (cy + radius * F.sin(F.radians(k * 60.0 + 30))).alias("y")))


def rectangle(x0: Column, y0: Column, dx: float, dy: float) -> Column:
    corners = [(0, 0), (1, 0), (1, 1), (0, 1)]
    return F.array(*[F.struct((x0 + a * dx).alias("x"), (y0 + b * dy).alias("y")) for a, b in corners])


def finite(ring: Column) -> Column:
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.filter(ring, lambda p: good(p["x"]) & good(p["y"]))


def is_valid(ring: Column) -> Column:
    return F.size(finite(ring)) >= 3


def area(ring: Column) -> Column:
    """Shoelace area; non-finite vertices are left out, fewer than three make 0."""
    ring = finite(ring)
    turned = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    twice = F.aggregate(F.zip_with(ring, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(ring) >= 3, F.abs(twice) / 2).otherwise(0.0)


def closed(ring: Column) -> Column:
    return F.when(F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def wkt(ring: Column, digits: int = 6) -> Column:
    points = F.array_join(F.transform(closed(ring), lambda p: F.concat_ws(" ", F.round(p["x"], digits).cast("string"), F.round(p["y"], digits).cast("string"))), ", ")
    return F.when(F.size(ring) >= 3, F.concat(F.lit("POLYGON(("), points, F.lit("))"))).otherwise("POLYGON EMPTY")


def geojson_feature(ring: Column, properties: Column) -> Column:
    """One feature as JSON text; the ring is closed."""
    coordinates = F.array(F.transform(closed(ring), lambda p: F.array(p["x"], p["y"])))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"), properties.alias("properties")))
