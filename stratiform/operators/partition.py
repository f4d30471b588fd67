"""Areal units: lattices, hexagons, seeds, and centroid loops whose every round is one aggregation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..sources.shared import with_checkpoints
from .prepare import with_scalars


def lattice_units(points: DataFrame, side: float) -> DataFrame:
    """unit_id (1-based, y fastest), cx, cy, ring over the bounding box of the points (x, y)."""
    x0, x1, y0, y1 = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).collect()[0]
    nx, ny = max(1, math.ceil((x1 - x0) / side)), max(1, math.ceil((y1 - y0) / side))
    cells = points.sparkSession.range(nx * ny).select(F.floor(F.col("id") / ny).alias("a"), (F.col("id") % ny).alias("b"), (F.col("id") + 1).alias("unit_id"))
    left, low = F.lit(x0) + F.col("a") * side, F.lit(y0) + F.col("b") * side
    return cells.select("unit_id", (left + side / 2).alias("cx"), (low + side / 2).alias("cy"), geometry.rectangle(left, low, side, side).alias("ring"))


def lattice_assigned(points: DataFrame, side: float) -> DataFrame:
    """Each point's cell by arithmetic, no join: a cell is half open, the far edge belongs to the last cell."""
    df = with_scalars(points, __x0=F.min("x"), __x1=F.max("x"), __y0=F.min("y"), __y1=F.max("y"))
    count = lambda a, b: F.greatest(F.lit(1), F.ceil((F.col(b) - F.col(a)) / side))
    cell = lambda v, a, b: F.least(F.floor((F.col(v) - F.col(a)) / side), count(a, b) - 1)
    return df.withColumn("unit_id", (cell("x", "__x0", "__x1") * count("__y0", "__y1") + cell("y", "__y0", "__y1") + 1).cast("long")).drop("__x0", "__x1", "__y0", "__y1")


def hexagon_units(points: DataFrame, radius: float) -> DataFrame:
    """Pointy-top hexagons over the bounding box: columns sqrt(3) r apart, rows 1.5 r apart, odd rows shifted by half."""
    x0, x1, y0, y1 = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).collect()[0]
    dx, dy = math.sqrt(3) * radius, 1.5 * radius
    nx, ny = math.ceil((x1 - x0) / dx) + 2, math.ceil((y1 - y0) / dy) + 2
    cells = points.sparkSession.range(nx * ny).select(F.floor(F.col("id") / nx).alias("row"), (F.col("id") % nx).alias("col"), (F.col("id") + 1).alias("unit_id"))
    cx = F.lit(x0) + F.col("col") * dx + F.when(F.col("row") % 2 == 1, dx / 2).otherwise(0.0)
    cy = F.lit(y0) + F.col("row") * dy
    return cells.select("unit_id", cx.alias("cx"), cy.alias("cy"), geometry.hexagon(cx, cy, radius).alias("ring"))


def hexagon_assigned(points: DataFrame, radius: float) -> DataFrame:
    """Each point's hexagon of `hexagon_units` by arithmetic, no join: the nearest of the two columns beside it in the two rows beside it; the first wins a tie."""
    df = with_scalars(points, __x0=F.min("x"), __x1=F.max("x"), __y0=F.min("y"), __y1=F.max("y"))
    dx, dy = math.sqrt(3) * radius, 1.5 * radius
    nx, ny = F.ceil((F.col("__x1") - F.col("__x0")) / dx) + 2, F.ceil((F.col("__y1") - F.col("__y0")) / dy) + 2
    found = []
    for up in (0, 1):
        row = F.least(F.floor((F.col("y") - F.col("__y0")) / dy) + up, ny - 1)
        shift = F.when(row % 2 == 1, dx / 2).otherwise(0.0)
        for right in (0, 1):
            col = F.greatest(F.least(F.floor((F.col("x") - F.col("__x0") - shift) / dx) + right, nx - 1), F.lit(0))
            cx, cy = F.col("__x0") + col * dx + shift, F.col("__y0") + row * dy
            found.append(F.struct((F.pow(F.col("x") - cx, 2) + F.pow(F.col("y") - cy, 2)).alias("d"), (row * nx + col + 1).cast("long").alias("u")))
    return df.withColumn("unit_id", F.least(*found)["u"]).drop("__x0", "__x1", "__y0", "__y1")


def nearest_unit(points: DataFrame, units: list[tuple[int, float, float]], name: str = "unit_id") -> DataFrame:
    """Nearest of a bounded list of centroids as an expression over an array literal; the first wins a tie."""
    array = F.array(*[F.struct((F.pow(F.col("x") - cx, 2) + F.pow(F.col("y") - cy, 2)).alias("d"), F.lit(u).cast("long").alias("u")) for u, cx, cy in units])
    return points.withColumn(name, F.array_min(array)["u"])


def density_seeds(points: DataFrame, target: int, cell: float, seed: int = 42) -> list[tuple[int, float, float]]:
    """Seeds (number, x, y) drawn without replacement from the places of points, denser ones more likely: weights 1 / mean distance to five neighbours."""
    from .graphs import drawn_by_density

    return [(k + 1, x, y) for k, (x, y) in enumerate(drawn_by_density(points, target, 5, cell, seed))]


def centroid_loop(points: DataFrame, start: list[tuple[int, float, float]], rounds: int = 20, damping: float = 1.0, tolerance: float = 1e-6) -> list[tuple[int, float, float]]:
    """Lloyd's loop; with damping below 1 a step shrinks as damping * 0.99**round. Only centroids reach the driver."""
    units = list(start)
    for number in range(rounds):
        means = {r.unit_id: (r.mx, r.my) for r in nearest_unit(points, units).groupBy("unit_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my")).collect()}
        step = damping * 0.99**number if damping < 1 else 1.0
        moved = [(u, x + step * (means.get(u, (x, y))[0] - x), y + step * (means.get(u, (x, y))[1] - y)) for u, x, y in units]
        shift = max(abs(a[1] - b[1]) + abs(a[2] - b[2]) for a, b in zip(units, moved))
        units = moved
        if shift < tolerance:
            break
    return units


def inducing_points(points: DataFrame, count: int, method: str = "kmeans", seed: int = 42) -> DataFrame:
    """`count` representative points of (id, x, y); a method that looks for the nearest observation may give fewer.

    random draws rows, kmeans gives centres (without ids of points), quantile and regular take the observation nearest to
    targets along the marginal quantiles or ranges (the smaller id of equally near ones). Targets are a parameter's
    worth of numbers, and all their nearest observations come from one aggregation.
    """
    if method == "random":
        return points.select("id", "x", "y").orderBy(F.rand(seed), "id").limit(count)
    if method == "kmeans":
        start = [(i + 1, r.x, r.y) for i, r in enumerate(points.select("x", "y").distinct().orderBy(F.xxhash64("x", "y", F.lit(seed)), "x", "y").limit(count).collect())]
        return points.sparkSession.createDataFrame(centroid_loop(points, start, rounds=200), "id long, x double, y double")
    shares = [i / max(count - 1, 1) for i in range(count)]
    if method == "quantile":
        array = ", ".join(f"{s:.17g}D" for s in shares)
        xs, ys = points.agg(*[F.expr(f"percentile({v}, array({array}))") for v in ("x", "y")]).collect()[0]
    elif method == "regular":
        x0, x1, y0, y1 = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).collect()[0]
        xs, ys = ([a + (b - a) * s for s in shares] for a, b in ((x0, x1), (y0, y1)))
    else:
        raise ValueError(f"unknown method {method}")
    d2 = lambda a, b: F.pow(F.col("x") - a, 2) + F.pow(F.col("y") - b, 2)
    nearest = [F.min(F.struct(d2(a, b).alias("d2"), "id", "x", "y")).alias(f"n{i}") for i, (a, b) in enumerate(zip(xs, ys))]
    return points.agg(*nearest).select(F.explode(F.array(*[f"n{i}" for i in range(count)])).alias("n")).select("n.id", "n.x", "n.y").distinct()


def quadrant_units(points: DataFrame, target: int, min_points: int = 2, binary: bool = False) -> DataFrame:
    """Split every region at its medians until `target` regions or none is viable; `binary` cuts only the axis of larger variance.

    All regions of a round are measured in one aggregation and split in one expression.
    """
    with_checkpoints(points.sparkSession)
    df = points.withColumn("region", F.lit("r"))
    for _ in range(64):
        stats = df.groupBy("region").agg(F.count("*").alias("n"), F.expr("percentile(x, 0.5)").alias("mx"), F.expr("percentile(y, 0.5)").alias("my"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"))
        rows = stats.collect()
        parts = 2 if binary else 4
        viable = sorted((r for r in rows if r.n >= parts * min_points), key=lambda r: (-r.n, r.region))
        room = (target - len(rows)) // (parts - 1)
        chosen = [r for r in viable[: max(room, 0)]]
        if not chosen:
            break
        cut = F.lit(None).cast("string")
        for r in chosen:
            right, top = F.when(F.col("x") > r.mx, "1").otherwise("0"), F.when(F.col("y") > r.my, "1").otherwise("0")
            label = (right if (r.vx or 0) >= (r.vy or 0) else top) if binary else F.concat(right, top)
            cut = F.when(F.col("region") == r.region, label).otherwise(cut)
        df = df.withColumn("region", F.concat("region", F.coalesce(cut, F.lit(""))))
        df = df.checkpoint()
    return df


def merge_small(assigned: DataFrame, min_points: int) -> DataFrame:
    """Give units below `min_points` to the nearest unit that has enough."""
    units = assigned.groupBy("unit_id").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    small, large = units.filter(F.col("n") < min_points), units.filter(F.col("n") >= min_points)
    pairs = small.alias("s").join(F.broadcast(large.alias("l")), F.lit(True)).groupBy(F.col("s.unit_id").alias("unit_id"))
    d2 = F.pow(F.col("s.cx") - F.col("l.cx"), 2) + F.pow(F.col("s.cy") - F.col("l.cy"), 2)
    moved = pairs.agg(F.min(F.struct(d2.alias("d"), F.col("l.unit_id").alias("u")))["u"].alias("target"))
    return assigned.join(moved, "unit_id", "left").withColumn("unit_id", F.coalesce("target", "unit_id")).drop("target")


def unit_table(assigned: DataFrame) -> DataFrame:
    """unit_id, cx, cy, point_count."""
    return assigned.groupBy("unit_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("point_count"))


def kde_grid(points: DataFrame, side: int) -> DataFrame:
    """Gaussian density at grid nodes, bandwidth a quarter of the sd, truncated at five bandwidths, normalised to sum 1."""
    x0, x1, y0, y1, sx, sy = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.stddev_samp("x"), F.stddev_samp("y")).collect()[0]
    bx, by = max(0.25 * (sx or 0), 1e-4), max(0.25 * (sy or 0), 1e-4)
    gx, gy = (x1 - x0) / max(side - 1, 1) or 1.0, (y1 - y0) / max(side - 1, 1) or 1.0
    span = lambda v, low, step, b: F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col(v) - 5 * b - low) / step)), F.least(F.lit(side - 1), F.floor((F.col(v) + 5 * b - low) / step))))
    near = points.withColumn("a", span("x", x0, gx, bx)).withColumn("b", span("y", y0, gy, by))
    u, v = (F.col("x") - (x0 + F.col("a") * gx)) / bx, (F.col("y") - (y0 + F.col("b") * gy)) / by
    dens = near.groupBy("a", "b").agg(F.sum(F.exp(-0.5 * (u * u + v * v))).alias("k"))
    return with_scalars(dens, __s=F.sum("k")).select("a", "b", (F.col("k") / F.col("__s")).alias("density"))


def spatial_grid_folds(points: DataFrame, folds: int) -> DataFrame:
    """Grid blocks of ceil(sqrt(folds)) per side, right-closed, dealt to folds in turn."""
    side = math.ceil(math.sqrt(folds))
    df = with_scalars(points, __x0=F.min("x"), __x1=F.max("x"), __y0=F.min("y"), __y1=F.max("y"))
    cell = lambda v, a, b: F.greatest(F.lit(1), F.least(F.lit(side), F.ceil((F.col(v) - F.col(a)) / ((F.col(b) + 1e-6 - F.col(a)) / side))))
    number = (cell("y", "__y0", "__y1") - 1) * side + cell("x", "__x0", "__x1")
    return df.withColumn("fold", (F.pmod(number - 1, F.lit(folds)) + 1).cast("long")).drop("__x0", "__x1", "__y0", "__y1")


def chain(xy: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Hull of places, counter-clockwise."""
    xy = sorted(set(xy))
    if len(xy) < 3:
        return xy
    halves = []
    for run in (xy, xy[::-1]):
        half: list[tuple[float, float]] = []
        for p in run:
            while len(half) >= 2 and (half[-1][0] - half[-2][0]) * (p[1] - half[-2][1]) - (half[-1][1] - half[-2][1]) * (p[0] - half[-2][0]) <= 0:
                half.pop()
            half.append(p)
        halves += half[:-1]
    return halves


def convex_hull(points: DataFrame) -> list[tuple[float, float]]:
    """Hull of (x, y), counter-clockwise. Each task keeps the hull of its own points, so the driver joins small hulls."""
    import pandas as pd

    def own(batches):
        kept: list[tuple[float, float]] = []
        for pdf in batches:
            kept = chain(kept + list(zip(pdf["x"], pdf["y"])))
        yield pd.DataFrame(kept, columns=["x", "y"])

    return chain([(r.x, r.y) for r in points.select("x", "y").mapInPandas(own, "x double, y double").collect()])


def voronoi_cells(centroids: DataFrame, hull: list[tuple[float, float]]) -> DataFrame:
    """unit_id, cx, cy, ring: each centroid's cell, the hull cut by the half-plane nearer to it than to every other centroid.

    One row for each areal unit. The centroids are sent to all tasks; a task cuts its own cells by the others from near to
    far, and stops where none can reach the cell any more.
    """
    import numpy as np
    import pandas as pd

    rows = [(r.unit_id, r.cx, r.cy) for r in centroids.select("unit_id", "cx", "cy").collect()]
    places = centroids.sparkSession.sparkContext.broadcast(np.array([(x, y) for _, x, y in rows], float).reshape(-1, 2))

    def cut(ring, a, b, c):
        """Part of the ring where a x + b y <= c."""
        out = []
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            d0, d1 = a * x0 + b * y0 - c, a * x1 + b * y1 - c
            if d0 <= 0:
                out.append((x0, y0))
            if d0 * d1 < 0:
                t = d0 / (d0 - d1)
                out.append((x0 + t * (x1 - x0), y0 + t * (y1 - y0)))
        return out

    def cells(batches):
        others = places.value
        for pdf in batches:
            rings = []
            for x, y in zip(pdf["cx"], pdf["cy"]):
                ring = list(hull)
                apart = np.hypot(others[:, 0] - x, others[:, 1] - y)
                reach = max((np.hypot(p - x, q - y) for p, q in ring), default=0.0)
                for k in np.argsort(apart, kind="stable"):
                    if not ring or apart[k] > 2 * reach:
                        break
                    if apart[k] > 0:
                        ox, oy = others[k].tolist()
                        ring = cut(ring, 2 * (ox - x), 2 * (oy - y), ox * ox + oy * oy - x * x - y * y)
                        reach = max((np.hypot(p - x, q - y) for p, q in ring), default=0.0)
                rings.append([{"x": float(p), "y": float(q)} for p, q in ring])
            yield pdf.assign(ring=rings)

    return centroids.select("unit_id", "cx", "cy").mapInPandas(cells, "unit_id long, cx double, cy double, ring array<struct<x:double,y:double>>")


def spatial_kmeans_folds(points: DataFrame, folds: int) -> DataFrame:
    """Folds as k-means blocks; the loop costs one aggregation a round."""
    start = [(i + 1, r.x, r.y) for i, r in enumerate(points.orderBy("id").limit(folds).collect())]
    return nearest_unit(points, centroid_loop(points, start), "fold")
