"""Areal units from points by any method: agglomerative Voronoi units, an exact number of units, and one entry for all methods.

The table of units is bounded by a parameter (`max_units`, or the target), so units are paired and counted on the driver; points are only
aggregated, and polygons are cut, joined and dissolved by Spark.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..sources.shared import with_checkpoints
from . import graphs, partition, polygons

Unit = tuple[int, float, float]
#: Units that an expression compares each point with; more of them are found by a neighbour search.
LITERAL = 128


def nearest_units(points: DataFrame, units: list[Unit], name: str = "unit_id") -> DataFrame:
    """Each point's nearest unit, the smaller id of equally near ones."""
    units = sorted(units)
    if len(units) <= LITERAL:
        return partition.nearest_unit(points, units, name)
    xs, ys = [u[1] for u in units], [u[2] for u in units]
    cell = max(max(xs) - min(xs), max(ys) - min(ys)) / math.sqrt(len(units)) or 1.0
    # even ids for points, odd ones for units, so that none is taken for the other
    table = points.sparkSession.createDataFrame([(2 * u + 1, x, y) for u, x, y in units], "id long, x double, y double")
    found = graphs.nearest(points.select((F.col("id") * 2).alias("id"), "x", "y"), table, 1, cell)
    return points.join(found.select((F.col("id") / 2).cast("long").alias("id"), ((F.col("j") - 1) / 2).cast("long").alias(name)), "id")


@dataclass
class Limits:
    """What a unit must keep: points, distinct times (column t), and area."""

    min_points: int = 1
    min_times: int = 1
    min_area: float = 0.0
    max_area: float = math.inf

    def broken(self, n: int, times: int, area: float) -> bool:
        return n < self.min_points or times < self.min_times or 0 < area < self.min_area or area > self.max_area


def pairs_to_merge(units: list[Unit], counts: dict[int, int], violators: set[int], room: int) -> list[tuple[int, int]]:
    """A matching: violators in order of their points take their nearest unit, if neither is taken yet; `room` pairs at most."""
    place, taken, pairs = {u: (x, y) for u, x, y in units}, set(), []
    for u in sorted(violators, key=lambda u: (counts.get(u, 0), u)):
        if len(pairs) == room:
            break
        x, y = place[u]
        to = min((v for v in place if v != u), key=lambda v: ((place[v][0] - x) ** 2 + (place[v][1] - y) ** 2, v), default=None)
        if to is not None and not {u, to} & taken:
            pairs.append((u, to))
            taken |= {u, to}
    return pairs


def agglomerated(points: DataFrame, seeds: list[Unit], hull: list[tuple[float, float]], limits: Limits, min_units: int = 3, per_round: int | None = None) -> tuple[list[Unit], str]:
    """Agglomerative Voronoi units: units that break a limit merge, until none does or `min_units` are left; with the reason why it ended.

    Points (id, x, y and, if there is one, t) go to the nearest unit, which is one aggregation a round. In a round all violators that form pairs with
    their nearest units merge (`per_round` of them at most: 1 is the plain sequential method), at the mean of both weighted by points.
    A unit above the largest area can only grow by merging, so it counts as a violator only while units may be split.
    """
    units = sorted(seeds)
    times = F.count_distinct("t") if "t" in points.columns else F.lit(limits.min_times)
    needs_area = limits.min_area > 0
    while len(units) > min_units:
        found = nearest_units(points, units).groupBy("unit_id").agg(F.count("*").alias("n"), times.alias("times")).collect()
        counts, held = {r.unit_id: r.n for r in found}, {r.unit_id: r.times for r in found}
        areas: dict[int, float] = {}
        if needs_area:
            table = points.sparkSession.createDataFrame(units, "unit_id long, cx double, cy double")
            areas = {r.unit_id: r.area for r in partition.voronoi_cells(table, hull).select("unit_id", geometry.area(F.col("ring")).alias("area")).collect()}
        small = Limits(limits.min_points, limits.min_times, limits.min_area)
        violators = {u for u, _, _ in units if small.broken(counts.get(u, 0), held.get(u, 0), areas.get(u, 0.0))}
        if not violators:
            return units, "limits_kept"
        room = min(len(units) - min_units, per_round or len(units))
        place = {u: (x, y) for u, x, y in units}
        for u, to in pairs_to_merge(units, counts, violators, room):
            a, b = counts.get(u, 0), counts.get(to, 0)
            share = a / (a + b) if a + b else 0.5
            place[to] = tuple(share * p + (1 - share) * q for p, q in zip(place[u], place[to]))
            del place[u]
        units = sorted((u, x, y) for u, (x, y) in place.items())
    return units, "min_units_reached"


def _half(ring, axis: int, at: float, keep_low: bool):
    """The part of a ring on one side of a line."""
    out, sign = [], 1 if keep_low else -1
    for p, q in zip(ring, ring[1:] + ring[:1]):
        d, e = sign * (p[axis] - at), sign * (q[axis] - at)
        if d <= 0:
            out.append(p)
        if d * e < 0:
            t = d / (d - e)
            cut = [a + t * (b - a) for a, b in zip(p, q)]
            cut[axis] = at
            out.append(tuple(cut))
    return out


def bisected(units: DataFrame, first_id: int) -> DataFrame:
    """Each polygon (unit_id, rings, cx, cy) as two, cut at its centroid across its longer side. The second of each gets an id from `first_id`, in order of unit_id."""
    import pandas as pd

    numbered = units.select("unit_id", "rings", "cx", "cy", F.expr(f"{first_id} - 1 + row_number() OVER (ORDER BY unit_id)").cast("long").alias("other"))

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                rings = [[(p["x"], p["y"]) for p in ring] for ring in row.rings]
                xs, ys = zip(*(p for ring in rings for p in ring))
                axis = 0 if max(xs) - min(xs) >= max(ys) - min(ys) else 1
                for unit, low in ((row.unit_id, True), (row.other, False)):
                    cut = [_half(ring, axis, (row.cx, row.cy)[axis], low) for ring in rings]
                    out.append((unit, [[{"x": x, "y": y} for x, y in ring] for ring in cut if len(ring) >= 3]))
            yield pd.DataFrame(out, columns=["unit_id", "rings"])

    return numbered.mapInPandas(run, f"unit_id long, rings {polygons.RINGS}")


def groups_down_to(sizes: list[tuple[int, float, float, float]], target: int) -> dict[int, int]:
    """unit -> group: the unit of least area joins the one with the nearest centroid, until `target` are left; (unit, area, cx, cy)."""
    left, groups = {u: (a, x, y) for u, a, x, y in sizes}, {u: u for u, *_ in sizes}
    while len(left) > max(target, 1):
        u = min(left, key=lambda u: (left[u][0], u))
        a, x, y = left.pop(u)
        to = min(left, key=lambda v: ((left[v][1] - x) ** 2 + (left[v][2] - y) ** 2, v))
        b, p, q = left[to]
        left[to] = (a + b, (a * x + b * p) / ((a + b) or 1), (a * y + b * q) / ((a + b) or 1))
        groups = {k: to if g == u else g for k, g in groups.items()}
    return groups


def exact_units(units: DataFrame, target: int, tolerance: float = 1e-7) -> DataFrame:
    """Exactly `target` polygons (unit_id, rings): too many are dissolved, smallest first; of too few the largest are bisected, in rounds of all above half of the largest."""
    with_checkpoints(units.sparkSession)
    units = units.select("unit_id", "rings").checkpoint()
    while True:
        measured = units.join(polygons.measures(units), "unit_id").checkpoint()
        sizes = [(r.unit_id, r.area, r.cx, r.cy) for r in measured.select("unit_id", "area", "cx", "cy").collect()]
        if len(sizes) > target:
            groups = units.sparkSession.createDataFrame(list(groups_down_to(sizes, target).items()), "unit_id long, group_id long")
            return polygons.dissolved(units, groups, tolerance)
        largest = sorted(sizes, key=lambda s: (-s[1], s[0]))
        chosen = [u for u, a, _, _ in largest[: target - len(sizes)] if a > largest[0][1] / 2]
        if not chosen:
            return units
        cut = bisected(measured.filter(F.col("unit_id").isin(chosen)), max(s[0] for s in sizes) + 1)
        units = units.filter(~F.col("unit_id").isin(chosen)).unionByName(cut).checkpoint()


def expanded_hull(points: DataFrame, buffer: float) -> list[tuple[float, float]]:
    """Convex hull of the points, moved outwards by about `buffer`: the hull of sixteen-cornered circles around its corners."""
    hull = partition.convex_hull(points)
    if buffer <= 0 and len(hull) >= 3:
        return hull
    reach = buffer if buffer > 0 else 1e-6
    around = [(x + reach * math.cos(math.pi * k / 8), y + reach * math.sin(math.pi * k / 8)) for x, y in hull for k in range(16)]
    return partition.chain(around)


@dataclass
class Tessellation:
    """units: unit_id, rings, cx, cy, area, point_count; assigned: the points with unit_id; edges: i, j, w of the touch graph, bridged where it isn't connected."""

    units: DataFrame
    assigned: DataFrame
    edges: DataFrame
    reason: str


METHODS = ("avt", "cvt", "kvt", "qvt", "bvt", "hexagonal", "lattice", "user")


def spatial_units(
    points: DataFrame, method: str = "avt", target_units: int | None = None, target_area: float | None = None, exact: bool = False, side: float | None = None, user_polygons: DataFrame | None = None,
    limits: Limits = Limits(), min_units: int = 3, max_units: int | None = None, merge_small: bool = False, prune_empty: bool = False, buffer: float = 0.5, seed: int = 42, tolerance: float = 1e-7,
) -> Tessellation:
    """Areal units of points (id, x, y and, for limits on times, t) by one of METHODS.

    `target_area` sets the number of units from the hull's area, `side` the cell of lattices and hexagons. Polygons below the least area are merged by
    shared border, `exact` enforces the number of units, `prune_empty` drops units without points. Points go to the nearest centroid; with user
    polygons (unit_id, rings) to the polygon that holds them, and to the nearest centroid outside of all.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; one of {', '.join(METHODS)}")
    with_checkpoints(points.sparkSession)
    spark = points.sparkSession
    hull = expanded_hull(points, buffer)
    if not hull:
        raise ValueError("no points to make units of")
    hull_area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(hull, hull[1:] + hull[:1]))) / 2
    target = target_units or (max(1, round(hull_area / target_area)) if target_area else 10)
    side = side or math.sqrt(target_area or hull_area / target)
    reason, flat = f"{method}_grid", points.select("id", "x", "y")
    if method == "user":
        units, reason = user_polygons.select("unit_id", "rings"), "user_polygons"
    elif method == "lattice":
        units = partition.lattice_units(flat, side).select("unit_id", F.array("ring").alias("rings"))
    elif method == "hexagonal":
        units = partition.hexagon_units(flat, side * math.sqrt(2 / (3 * math.sqrt(3)))).select("unit_id", F.array("ring").alias("rings"))
    else:
        if method in ("qvt", "bvt"):
            regions = partition.quadrant_units(flat, target, binary=method == "bvt").groupBy("region").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).orderBy("region").collect()
            seeds, reason = [(k + 1, r.x, r.y) for k, r in enumerate(regions)], "regions_split"
        else:
            seeds, reason = partition.density_seeds(flat, target if method != "avt" else max_units or 2 * target, side, seed), "centroids_settled"
        if method == "avt":
            seeds, reason = agglomerated(points, seeds, hull, limits, min_units)
        elif method in ("cvt", "kvt"):
            seeds = partition.centroid_loop(flat, seeds, damping=1.0 if method == "cvt" else 0.7)
        cells = partition.voronoi_cells(spark.createDataFrame(seeds, "unit_id long, cx double, cy double"), hull)
        units = cells.filter(F.size("ring") >= 3).select("unit_id", F.array("ring").alias("rings"))
    units = units.checkpoint()
    if merge_small or limits.min_area > 0:
        units = polygons.merged_slivers(units, limits.min_area, tolerance).checkpoint()
    if exact:
        units = exact_units(units, target, tolerance).checkpoint()
    measured = units.join(polygons.measures(units), "unit_id").filter(F.col("area") > 0).checkpoint()
    while True:
        centroids = [(r.unit_id, r.cx, r.cy) for r in measured.select("unit_id", "cx", "cy").collect()]
        if method == "user":
            inside = polygons.assigned(points, measured)
            rest = nearest_units(inside.filter("unit_id is null").drop("unit_id"), centroids)
            assigned = inside.filter("unit_id is not null").unionByName(rest.select(*inside.columns))
        else:
            assigned = nearest_units(points, centroids)
        counts = assigned.groupBy("unit_id").agg(F.count("*").alias("point_count"))
        counted = measured.select("unit_id", "rings", "cx", "cy", "area").join(counts, "unit_id", "left").na.fill(0, ["point_count"]).checkpoint()
        if not prune_empty or counted.filter("point_count = 0").isEmpty():
            break
        measured = counted.filter("point_count > 0").drop("point_count").checkpoint()
    nodes = counted.select(F.col("unit_id").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    edges = graphs.connected(nodes, polygons.adjacency(counted, tolerance=tolerance), math.sqrt(hull_area / max(len(centroids), 1)))
    return Tessellation(counted, assigned, edges, reason)
