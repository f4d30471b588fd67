"""Delaunay triangles of knots, and the barycentric basis on them as a sparse table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import polygons


def _shaken(ids, xs, ys, size: float):
    """Places moved by a tiny amount that depends on the id alone, so that no four lie on a circle."""
    import numpy as np

    part = lambda k: np.modf(np.abs(np.sin(np.asarray(ids, float) * 12.9898 + k) * 43758.5453))[0] - 0.5
    return np.asarray(xs, float) + size * part(1.0), np.asarray(ys, float) + size * part(2.0)


def delaunay(knots: DataFrame, reach: float = 1000.0) -> DataFrame:
    """unit_id, a, b, c, rings: the triangles of knots (id, x, y; places differ), counter-clockwise, with a < b and a < c.

    Three knots are a triangle where their Voronoi cells meet, so each knot's cell is cut by the others from near to far and tells the
    two knots behind each of its corners; a triangle is one that at least two of its knots see. Knots on common circles are told apart by tiny
    shifts. Triangles whose circle lies farther out than `reach` times the extent are flat and left out. The number
    of knots is a parameter of a model; they are sent to all tasks.
    """
    import numpy as np
    import pandas as pd

    rows = sorted((r.id, r.x, r.y) for r in knots.select("id", "x", "y").collect())
    spark = knots.sparkSession
    schema = f"unit_id long, a long, b long, c long, rings {polygons.RINGS}"
    if len(rows) < 3:
        return spark.createDataFrame([], schema)
    ids, xs, ys = (np.array(v) for v in zip(*rows))
    extent = max(np.ptp(xs), np.ptp(ys)) or 1.0
    shaken = spark.sparkContext.broadcast(_shaken(ids, xs, ys, 1e-7 * extent))
    far, mid = reach * extent, ((xs.min() + xs.max()) / 2, (ys.min() + ys.max()) / 2)
    box = [(mid[0] + a * far, mid[1] + b * far, -1) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]

    def cut(ring, a, b, c, label):
        """Part of the ring where a x + b y <= c; each corner carries the knot behind the edge that begins there."""
        out = []
        for (x0, y0, own), (x1, y1, _) in zip(ring, ring[1:] + ring[:1]):
            d0, d1 = a * x0 + b * y0 - c, a * x1 + b * y1 - c
            if d0 <= 0:
                out.append((x0, y0, own))
            if d0 * d1 < 0:
                t = d0 / (d0 - d1)
                out.append((x0 + t * (x1 - x0), y0 + t * (y1 - y0), label if d0 < 0 else own))
        return out

    def corners(batches):
        px, py = shaken.value
        for pdf in batches:
            found = []
            for i in pdf["id"]:
                x, y = px[i], py[i]
                apart = np.hypot(px - x, py - y)
                ring, limit = box, math.inf
                for k in np.argsort(apart, kind="stable").tolist():
                    if apart[k] > 2 * limit:
                        break
                    if k != i:
                        # measured from the cell's knot, so that far corners lose no digits of near ones
                        dx, dy = px[k] - x, py[k] - y
                        ring = cut([(p - x, q - y, n) for p, q, n in ring], dx, dy, (dx * dx + dy * dy) / 2, k)
                        limit = max(math.hypot(p, q) for p, q, _ in ring)
                        ring = [(p + x, q + y, n) for p, q, n in ring]
                found += {tuple(sorted((i, u, v))) for (_, _, u), (_, _, v) in zip(ring, ring[1:] + ring[:1]) if u >= 0 and v >= 0}
            yield pd.DataFrame(found, columns=["a", "b", "c"], dtype="int64")

    seen = spark.range(len(rows)).repartition(min(len(rows), spark.sparkContext.defaultParallelism)).mapInPandas(corners, "a long, b long, c long")
    sure = seen.groupBy("a", "b", "c").agg(F.count("*").alias("n")).filter("n >= 2")
    # at most two triangles a knot
    table = spark.createDataFrame([(k, i, float(x), float(y)) for k, (i, x, y) in enumerate(rows)], "k long, id long, x double, y double")
    for name in "abc":
        sure = sure.join(F.broadcast(table.select(F.col("k").alias(name), F.struct("id", "x", "y").alias(f"p{name}"))), name)
    left = (F.col("pb.x") - F.col("pa.x")) * (F.col("pc.y") - F.col("pa.y")) - (F.col("pb.y") - F.col("pa.y")) * (F.col("pc.x") - F.col("pa.x"))
    second, third = F.when(left > 0, F.col("pb")).otherwise(F.col("pc")), F.when(left > 0, F.col("pc")).otherwise(F.col("pb"))
    ring = F.array(*[F.struct(p["x"].alias("x"), p["y"].alias("y")) for p in (F.col("pa"), second, third)])
    number = (F.col("a") * len(rows) + F.col("b")) * len(rows) + F.col("c")
    return sure.filter(left != 0).select(number.alias("unit_id"), F.col("pa.id").alias("a"), second["id"].alias("b"), third["id"].alias("c"), F.array(ring).alias("rings"))


def barycentric(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """id, knot, weight: each point's (id, x, y) weights at the corners of its triangle, which sum to 1; no row outside of all triangles.

    Triangles are found by cells. A point on the outer border that belongs to none by the rule of borders is looked for again a hair nearer to the middle.
    """
    span = points.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    flat = points.select("id", "x", "y")
    first = polygons.assigned(flat, triangles)
    hair = 1e-9
    pulled = lambda v, m: F.col(v) + (F.lit(float(m or 0.0)) - F.col(v)) * hair
    again = first.filter("unit_id is null").select("id", F.col("x").alias("x0"), F.col("y").alias("y0"), pulled("x", span[0]).alias("x"), pulled("y", span[1]).alias("y"))
    again = polygons.assigned(again, triangles).filter("unit_id is not null").select("id", F.col("x0").alias("x"), F.col("y0").alias("y"), "unit_id")
    placed = first.filter("unit_id is not null").select("id", "x", "y", "unit_id").unionByName(again).join(triangles, "unit_id")
    p = [F.col("rings")[0][k] for k in range(3)]
    twice = lambda ax, ay, bx, by, cx, cy: (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    x, y = F.col("x"), F.col("y")
    whole = twice(p[0]["x"], p[0]["y"], p[1]["x"], p[1]["y"], p[2]["x"], p[2]["y"])
    second = twice(p[0]["x"], p[0]["y"], x, y, p[2]["x"], p[2]["y"]) / whole
    third = twice(p[0]["x"], p[0]["y"], p[1]["x"], p[1]["y"], x, y) / whole
    entries = F.array(*[F.struct(F.col(k).alias("knot"), w.alias("weight")) for k, w in (("a", 1 - second - third), ("b", second), ("c", third))])
    return placed.select("id", F.explode(entries).alias("e")).select("id", "e.knot", "e.weight")


def interpolated(basis: DataFrame, values: DataFrame) -> DataFrame:
    """id, value: the basis applied to values (knot, value)."""
    return basis.join(values, "knot").groupBy("id").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))
