"""User polygons: WKT, point location, adjacency, dissolving and merging by shared border.

A polygon is a row (unit_id, rings), rings an array of arrays of (x, y) structs, outer rings and holes alike: a place is inside where
a ray crosses an odd number of edges. Edges are cut into the cells of a grid, and everything is joined by cell, so no polygon
meets all points or all other polygons. A place on a border belongs to one side only: an edge holds what lies above it or to its right.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..sources.shared import with_checkpoints

RINGS = "array<array<struct<x:double,y:double>>>"
#: The grid's origin, as a share of a cell, lies where borders of round numbers don't.
SHIFT = 0.3819660112501051


def from_wkt(text: Column) -> Column:
    """Rings of a POLYGON or MULTIPOLYGON; anything else, or a ring of fewer than three places, gives no ring."""
    rings = F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), 1)
    number = lambda s, k: F.get(F.split(F.trim(s), r"\s+"), F.lit(k)).try_cast("double")
    place = lambda s: F.struct(number(s, 0).alias("x"), number(s, 1).alias("y"))
    parsed = F.transform(rings, lambda ring: geometry.finite(F.transform(F.split(ring, ","), place)))
    return F.filter(F.when(F.upper(F.trim(text)).rlike("^(MULTI)?POLYGON"), parsed).otherwise(F.array().cast(RINGS)), lambda ring: F.size(ring) >= 3)


def to_wkt(rings: Column) -> Column:
    """A POLYGON of all rings, each closed."""
    texts = F.transform(rings, lambda ring: F.concat(F.lit("("), F.array_join(F.transform(geometry.closed(ring), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")")))
    return F.when(F.size(rings) > 0, F.concat(F.lit("POLYGON("), F.array_join(texts, ", "), F.lit(")"))).otherwise("POLYGON EMPTY")


def directed_edges(polygons: DataFrame) -> DataFrame:
    """unit_id, ring, pos, x1, y1, x2, y2 of every edge, without those of no length."""
    rings = polygons.select("unit_id", F.posexplode("rings").alias("ring", "places"))
    turned = F.concat(F.slice("places", 2, F.greatest(F.size("places"), F.lit(1))), F.slice("places", 1, 1))
    pairs = rings.select("unit_id", "ring", F.posexplode(F.arrays_zip(F.col("places").alias("a"), turned.alias("b"))).alias("pos", "e"))
    flat = pairs.select("unit_id", "ring", "pos", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))
    return flat.filter((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def measures(polygons: DataFrame) -> DataFrame:
    """unit_id, area, cx, cy. Rings within rings count as holes, whatever their direction, so polygons must not overlap themselves."""
    twice = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    rings = directed_edges(polygons).groupBy("unit_id", "ring").agg(F.sum(twice).alias("s"), F.sum((F.col("x1") + F.col("x2")) * twice).alias("sx"), F.sum((F.col("y1") + F.col("y2")) * twice).alias("sy"))
    depth = ring_depths(polygons)
    sign = F.when(F.col("depth") % 2 == 0, 1).otherwise(-1) * F.signum("s")
    total = rings.join(depth, ["unit_id", "ring"]).groupBy("unit_id").agg(F.sum(sign * F.col("s")).alias("s"), F.sum(sign * F.col("sx")).alias("sx"), F.sum(sign * F.col("sy")).alias("sy"))
    return total.select("unit_id", (F.col("s") / 2).alias("area"), (F.col("sx") / (3 * F.col("s"))).alias("cx"), (F.col("sy") / (3 * F.col("s"))).alias("cy"))


def ring_depths(polygons: DataFrame) -> DataFrame:
    """unit_id, ring, depth: how many other rings of the unit a ring's first place lies in; only units of several rings are joined."""
    rings = polygons.select("unit_id", F.posexplode("rings").alias("ring", "places"))
    several = polygons.filter(F.size("rings") > 1)
    first = several.select("unit_id", F.posexplode("rings").alias("ring", "places")).select("unit_id", "ring", F.col("places")[0]["x"].alias("x"), F.col("places")[0]["y"].alias("y"))
    edges = directed_edges(several).select("unit_id", F.col("ring").alias("other"), "x1", "y1", "x2", "y2")
    met = first.join(edges, "unit_id").filter(F.col("ring") != F.col("other"))
    inside = met.groupBy("unit_id", "ring", "other").agg((F.sum(_crosses_left(F.col("x"), F.col("y"), *map(F.col, ("x1", "y1", "x2", "y2")))) % 2).alias("odd"))
    depth = inside.groupBy("unit_id", "ring").agg(F.sum("odd").alias("depth"))
    return rings.select("unit_id", "ring").join(depth, ["unit_id", "ring"], "left").na.fill(0, ["depth"])


def _at(v: Column, v1: Column, v2: Column, u1: Column, u2: Column) -> Column:
    """u of an edge where it has v; the same number for both directions of the edge."""
    swap = (v1 > v2) | ((v1 == v2) & (u1 > u2))
    a, b, c, d = F.when(swap, v2).otherwise(v1), F.when(swap, v1).otherwise(v2), F.when(swap, u2).otherwise(u1), F.when(swap, u1).otherwise(u2)
    return c + (v - a) / (b - a) * (d - c)


def _crosses_left(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """1 if the edge crosses the ray from (x, y) to the left."""
    return F.when((y1 > y) != (y2 > y), F.when(_at(y, y1, y2, x1, x2) <= x, 1).otherwise(0)).otherwise(0)


def edge_cells(edges: DataFrame, side: float, margin: float = 0.0) -> DataFrame:
    """A row for each cell (gx, gy) that an edge runs through, or comes nearer to than `margin`."""
    cell = lambda v: F.floor(v / side - SHIFT)
    slack = margin + 1e-9 * side
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.withColumn("gy", F.explode(F.sequence(cell(low - slack), cell(high + slack))))
    flat = F.col("y1") == F.col("y2")
    end = lambda y: F.greatest(low, F.least(high, y))
    bottom, top = end((F.col("gy") + SHIFT) * side - slack), end((F.col("gy") + 1 + SHIFT) * side + slack)
    ends = [F.when(flat, F.col(f"x{k}")).otherwise(_at(y, F.col("y1"), F.col("y2"), F.col("x1"), F.col("x2"))) for k, y in ((1, bottom), (2, top))]
    return rows.withColumn("gx", F.explode(F.sequence(cell(F.least(*ends) - slack), cell(F.greatest(*ends) + slack))))


def default_side(polygons: DataFrame, cells: int = 4) -> float:
    """A cell such that a polygon of mean extent is about `cells` wide."""
    each = directed_edges(polygons).groupBy("unit_id").agg((F.max("x1") - F.min("x1") + F.max("y1") - F.min("y1")).alias("extent"))
    return float(each.agg(F.avg("extent")).first()[0] or 2.0) / (2 * cells)


def cell_table(polygons: DataFrame, side: float) -> DataFrame:
    """gx, gy, units: for each cell the polygons that hold some of it, each with the parity of the cell's lower left corner and the edges in the cell (none: it holds the whole cell)."""
    edges = directed_edges(polygons)
    ends = ["x1", "y1", "x2", "y2"]
    border = edge_cells(edges, side).groupBy("unit_id", "gx", "gy").agg(F.collect_list(F.struct(*ends)).alias("edges"))
    # crossings of the lower line of each row of cells, by the cell in which they lie
    line = F.sequence(F.ceil(F.least("y1", "y2") / side - SHIFT), F.floor(F.greatest("y1", "y2") / side - SHIFT) + 1)
    crossed = edges.filter("y1 != y2").withColumn("gy", F.explode(line)).withColumn("y", (F.col("gy") + SHIFT) * side).filter((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y")))
    crossed = crossed.select("unit_id", F.floor(_at(F.col("y"), F.col("y1"), F.col("y2"), F.col("x1"), F.col("x2")) / side - SHIFT).alias("gx"), "gy").groupBy("unit_id", "gx", "gy").agg(F.count("*").alias("crossings"))
    row = Window.partitionBy("unit_id", "gy").orderBy("gx")
    left = F.coalesce(F.sum("crossings").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # an edge that crosses a cell's lower line lies in that cell, so every crossing has a border cell
    marked = border.join(crossed, ["unit_id", "gx", "gy"], "left").na.fill(0, ["crossings"]).withColumns({"left": left, "next": F.lead("gx").over(row)})
    own = marked.select("gx", "gy", F.struct("unit_id", (F.col("left") % 2).alias("odd"), "edges").alias("unit"))
    runs = marked.filter((F.col("next") > F.col("gx") + 1) & ((F.col("left") + F.col("crossings")) % 2 == 1))
    inner = runs.select(F.explode(F.sequence(F.col("gx") + 1, F.col("next") - 1)).alias("gx"), "gy", F.struct("unit_id", F.lit(1).cast("long").alias("odd"), F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>").alias("edges")).alias("unit"))
    return own.unionByName(inner).groupBy("gx", "gy").agg(F.collect_list("unit").alias("units"))


def located(points: DataFrame, polygons: DataFrame, side: float | None = None) -> DataFrame:
    """The points (x, y and any other columns) with `units`, the sorted ids of all polygons that hold each; an empty array if none does.

    A point in a cell without edges takes its cell's polygons; in a border cell the path from the cell's corner up and then right to
    the point crosses the cell's edges an even or odd number of times.
    """
    side = side or default_side(polygons)
    cells = cell_table(polygons, side).withColumnsRenamed({"gx": "__gx", "gy": "__gy", "units": "__units"})
    placed = points.withColumns({"__gx": F.floor(F.col("x") / side - SHIFT), "__gy": F.floor(F.col("y") / side - SHIFT)})
    x0, y0 = (F.col("__gx") + SHIFT) * side, (F.col("__gy") + SHIFT) * side

    def inside(unit: Column) -> Column:
        def crossings(total: Column, e: Column) -> Column:
            up = _at(x0, e["x1"], e["x2"], e["y1"], e["y2"])
            rising = F.when((e["x1"] > x0) != (e["x2"] > x0), F.when((up > y0) & (up <= F.col("y")), 1).otherwise(0)).otherwise(0)
            across = _at(F.col("y"), e["y1"], e["y2"], e["x1"], e["x2"])
            right = F.when((e["y1"] > F.col("y")) != (e["y2"] > F.col("y")), F.when((across > x0) & (across <= F.col("x")), 1).otherwise(0)).otherwise(0)
            return total + rising + right

        return F.aggregate(unit["edges"], unit["odd"], lambda total, e: (total + crossings(F.lit(0), e)).cast("long")) % 2 == 1

    joined = placed.join(cells, ["__gx", "__gy"], "left")
    units = F.array_sort(F.transform(F.filter("__units", inside), lambda u: u["unit_id"]))
    return joined.withColumn("units", F.coalesce(units, F.array().cast("array<long>"))).drop("__gx", "__gy", "__units")


def assigned(points: DataFrame, polygons: DataFrame, side: float | None = None) -> DataFrame:
    """The points with unit_id: the smallest id of the polygons that hold each, null outside of all."""
    return located(points, polygons, side).withColumn("unit_id", F.get("units", F.lit(0))).drop("units")


def touching_edges(polygons: DataFrame, tolerance: float, side: float) -> DataFrame:
    """i, j, shared for each pair of edges of two polygons (i < j) that come nearer than `tolerance`: how long they run beside each other."""
    edges = directed_edges(polygons)
    cut = edge_cells(edges, side, tolerance)
    name = lambda k: cut.select("gx", "gy", *[F.col(c).alias(f"{c}_{k}") for c in ("unit_id", "ring", "pos", "x1", "y1", "x2", "y2")])
    pairs = name("a").join(name("b"), ["gx", "gy"]).filter("unit_id_a < unit_id_b").drop("gx", "gy").distinct()

    def along(px: str, py: str, k: str) -> tuple[Column, Column]:
        """Place along the edge k, from 0 to its length, and distance from its line."""
        dx, dy = F.col(f"x2_{k}") - F.col(f"x1_{k}"), F.col(f"y2_{k}") - F.col(f"y1_{k}")
        length = F.hypot(dx, dy)
        vx, vy = F.col(px) - F.col(f"x1_{k}"), F.col(py) - F.col(f"y1_{k}")
        return (vx * dx + vy * dy) / length, F.abs(vx * dy - vy * dx) / length

    def near(px: str, py: str, k: str) -> Column:
        t, off = along(px, py, k)
        length = F.hypot(F.col(f"x2_{k}") - F.col(f"x1_{k}"), F.col(f"y2_{k}") - F.col(f"y1_{k}"))
        return F.hypot(F.greatest(-t, t - length, F.lit(0.0)), off) <= tolerance

    turn = lambda o, p, q, k, m: (F.col(f"x{p}_{k}") - F.col(f"x{o}_{k}")) * (F.col(f"y{q}_{m}") - F.col(f"y{o}_{k}")) - (F.col(f"y{p}_{k}") - F.col(f"y{o}_{k}")) * (F.col(f"x{q}_{m}") - F.col(f"x{o}_{k}"))
    crossing = (turn(1, 2, 1, "a", "b") * turn(1, 2, 2, "a", "b") < 0) & (turn(1, 2, 1, "b", "a") * turn(1, 2, 2, "b", "a") < 0)
    touch = near("x1_a", "y1_a", "b") | near("x2_a", "y2_a", "b") | near("x1_b", "y1_b", "a") | near("x2_b", "y2_b", "a") | crossing
    (t1, off1), (t2, off2) = along("x1_b", "y1_b", "a"), along("x2_b", "y2_b", "a")
    length = F.hypot(F.col("x2_a") - F.col("x1_a"), F.col("y2_a") - F.col("y1_a"))
    beside = F.greatest(F.least(length, F.greatest(t1, t2)) - F.greatest(F.lit(0.0), F.least(t1, t2)), F.lit(0.0))
    shared = F.when((off1 <= tolerance) & (off2 <= tolerance) & (beside > tolerance), beside).otherwise(0.0)
    return pairs.filter(touch).select(F.col("unit_id_a").alias("i"), F.col("unit_id_b").alias("j"), shared.alias("shared"))


def borders(polygons: DataFrame, tolerance: float = 1e-7, side: float | None = None) -> DataFrame:
    """i, j, shared, both ways: every two polygons that touch, overlap or come nearer than `tolerance`, with the length of border they share (0 where only a corner)."""
    once = touching_edges(polygons, tolerance, side or default_side(polygons)).groupBy("i", "j").agg(F.sum("shared").alias("shared"))
    return once.unionByName(once.select(F.col("j").alias("i"), F.col("i").alias("j"), "shared"))


def adjacency(polygons: DataFrame, queen: bool = True, tolerance: float = 1e-7, side: float | None = None) -> DataFrame:
    """Directed edges (i, j, w) of the touch graph; without `queen` only where some length of border is shared."""
    found = borders(polygons, tolerance, side)
    return (found if queen else found.filter(F.col("shared") > tolerance)).select("i", "j", F.lit(1.0).alias("w"))


def noded(polygons: DataFrame, groups: DataFrame, tolerance: float, side: float) -> DataFrame:
    """group_id, x1, y1, x2, y2: all edges, oriented with the inside on the left, and cut at places of other edges of the group that lie on them."""
    depth = ring_depths(polygons)
    edges = directed_edges(polygons)
    turn = edges.groupBy("unit_id", "ring").agg(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).alias("s"))
    flip = (F.col("s") > 0) != (F.col("depth") % 2 == 0)
    ends = [F.when(flip, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))]
    edges = edges.join(turn, ["unit_id", "ring"]).join(depth, ["unit_id", "ring"]).join(groups.select("unit_id", "group_id"), "unit_id").select("group_id", "unit_id", "ring", "pos", *ends)
    cut = edge_cells(edges, side, tolerance)
    places = edges.select("group_id", F.col("x1").alias("px"), F.col("y1").alias("py")).distinct()
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 1) for b in (-1, 1)])).alias("o")
    cell = lambda v, o: F.floor((F.col(v) + F.col(f"o.{o}") * tolerance) / side - SHIFT)
    places = places.select("*", around).select("group_id", "px", "py", cell("px", "a").alias("gx"), cell("py", "b").alias("gy")).distinct()
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = F.hypot(dx, dy)
    t = ((F.col("px") - F.col("x1")) * dx + (F.col("py") - F.col("y1")) * dy) / length
    off = F.abs((F.col("px") - F.col("x1")) * dy - (F.col("py") - F.col("y1")) * dx) / length
    key = ["group_id", "unit_id", "ring", "pos", "x1", "y1", "x2", "y2"]
    on = cut.join(places, ["group_id", "gx", "gy"]).filter((off <= tolerance) & (t > tolerance) & (t < length - tolerance)).groupBy(*key).agg(F.sort_array(F.collect_set(F.struct(t.alias("t"), F.col("px").alias("x"), F.col("py").alias("y")))).alias("cuts"))
    stops = F.concat(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))), F.transform(F.coalesce("cuts", F.array().cast("array<struct<t:double,x:double,y:double>>")), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))), F.array(F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))))
    pieces = edges.join(on, key, "left").select("group_id", stops.alias("s")).select("group_id", F.explode(F.arrays_zip(F.slice("s", 1, F.size("s") - 1).alias("a"), F.slice("s", 2, F.size("s") - 1).alias("b"))).alias("e"))
    return pieces.select("group_id", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def dissolved(polygons: DataFrame, groups: DataFrame, tolerance: float = 1e-7, side: float | None = None) -> DataFrame:
    """unit_id (the group's id) and rings of the union of each group (unit_id, group_id) of polygons that share borders but don't overlap.

    Edges that two polygons of a group have in opposite directions cancel. What is left is traced into rings, the leftmost turn
    first so that rings that meet at a place stay apart; outer rings are counter-clockwise and come first, holes are kept. A group's border is one row of
    the result, so it is traced in one task.
    """
    side = side or default_side(polygons)
    digits = max(0, -math.floor(math.log10(tolerance)) - 1) if tolerance > 0 else 15
    edges = noded(polygons, groups, tolerance, side)
    place = lambda k: (F.round(f"x{k}", digits), F.round(f"y{k}", digits))
    forward = F.struct(*place(1)) < F.struct(*place(2))
    pair = F.when(forward, F.struct(*[c.alias(n) for c, n in zip((*place(1), *place(2)), "abcd")])).otherwise(F.struct(*[c.alias(n) for c, n in zip((*place(2), *place(1)), "abcd")]))
    way = F.when(forward, 1).otherwise(-1)
    left = edges.withColumns({"pair": pair, "way": way}).groupBy("group_id", "pair").agg(F.sum("way").alias("net"), F.first(F.struct("x1", "y1", "x2", "y2", "way")).alias("e")).filter("net != 0")
    same = F.col("e.way") * F.signum("net") > 0
    kept = left.select("group_id", *[F.when(same, F.col(f"e.{a}")).otherwise(F.col(f"e.{b}")).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))])
    return kept.groupBy("group_id").applyInPandas(_traced(digits), f"unit_id long, rings {RINGS}")


def _traced(digits: int):
    def run(pdf):
        import pandas as pd

        out: dict[tuple, list[int]] = {}
        start = list(zip(pdf.x1.round(digits) + 0.0, pdf.y1.round(digits) + 0.0))
        end = list(zip(pdf.x2.round(digits) + 0.0, pdf.y2.round(digits) + 0.0))
        place = list(zip(pdf.x1, pdf.y1))
        angle = [math.atan2(b, a) for a, b in zip(pdf.x2 - pdf.x1, pdf.y2 - pdf.y1)]
        for i in sorted(range(len(pdf)), key=lambda i: (start[i], angle[i])):
            out.setdefault(start[i], []).append(i)
        free, rings = set(range(len(pdf))), []
        for first in sorted(free, key=lambda i: start[i]):
            if first not in free:
                continue
            ring, at = [], first
            while at in free:
                free.discard(at)
                ring.append(place[at])
                # the leftmost turn, so that the inside stays on the left
                back = angle[at] + math.pi
                onward = [i for i in out.get(end[at], []) if i in free]
                if not onward:
                    break
                at = min(onward, key=lambda i: (back - angle[i]) % (2 * math.pi) or 2 * math.pi)
            rings.append(ring)
        signed = lambda ring: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))
        rings.sort(key=lambda ring: (signed(ring) < 0, ring))
        return pd.DataFrame({"unit_id": [int(pdf.group_id.iloc[0])], "rings": [[[{"x": x, "y": y} for x, y in ring] for ring in rings]]})

    return run


def merge_groups(sizes: DataFrame, found: DataFrame, centroids: DataFrame, least: float) -> DataFrame:
    """unit_id, group_id: units (unit_id, size) below `least` go, in rounds, to the neighbour with which they share most border.

    Borders (i, j, shared) of merged units are added up. In a round a small unit moves unless its target moves too; of two that choose each other the
    larger one stays. A unit without neighbours goes to the nearest centroid (unit_id, cx, cy). Rounds end when no unit is small, or one is left.
    """
    from .graphs import nearest

    with_checkpoints(sizes.sparkSession)
    groups = sizes.select("unit_id", F.col("unit_id").alias("group_id")).checkpoint()
    while True:
        named = groups.join(sizes, "unit_id").join(centroids, "unit_id")
        totals = named.groupBy("group_id").agg(F.sum("size").alias("size"), F.avg("cx").alias("x"), F.avg("cy").alias("y")).checkpoint()
        small = totals.filter(F.col("size") < least)
        if small.isEmpty() or totals.limit(2).count() < 2:
            return groups
        to = groups.select(F.col("unit_id").alias("j"), F.col("group_id").alias("target"))
        outer = small.select("group_id").join(groups, "group_id").select(F.col("unit_id").alias("i"), "group_id").join(found, "i").join(to, "j").filter("group_id != target")
        best = outer.groupBy("group_id", "target").agg(F.sum("shared").alias("shared")).groupBy("group_id").agg(F.max_by("target", F.struct("shared", -F.col("target"))).alias("target"))
        alone = small.join(best, "group_id", "left_anti").select(F.col("group_id").alias("id"), "x", "y")
        if not alone.isEmpty():
            x0, x1, y0, y1, n = totals.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
            cell = max(x1 - x0, y1 - y0) / math.sqrt(n) or 1.0
            best = best.unionByName(nearest(alone, totals.select(F.col("group_id").alias("id"), "x", "y"), 1, cell).select(F.col("id").alias("group_id"), F.col("j").alias("target")))
        moves = best.join(totals.select("group_id", "size"), "group_id")
        theirs = moves.select(F.col("group_id").alias("target"), F.col("target").alias("next"), F.col("size").alias("target_size"))
        judged = moves.join(theirs, "target", "left")
        mutual = F.col("next") == F.col("group_id")
        smaller = F.struct("size", -F.col("group_id")) < F.struct(F.col("target_size"), -F.col("target"))
        # a cycle of choices has a smallest unit, which moves; others wait for their target
        last = F.col("next").isNull() | (mutual & smaller)
        if judged.filter(last).isEmpty():
            size, unit = judged.agg(F.min(F.struct("size", "group_id")).alias("m")).select("m.*").first()
            last = (F.col("size") == size) & (F.col("group_id") == unit)
        groups = groups.join(judged.filter(last).select("group_id", "target"), "group_id", "left").select("unit_id", F.coalesce("target", "group_id").alias("group_id")).checkpoint()


def merged_slivers(polygons: DataFrame, min_area: float, tolerance: float = 1e-7, side: float | None = None) -> DataFrame:
    """The polygons with those below `min_area` dissolved into neighbours, under the neighbours' ids."""
    with_checkpoints(polygons.sparkSession)
    sizes, side = measures(polygons).checkpoint(), side or default_side(polygons)
    groups = merge_groups(sizes.select("unit_id", F.col("area").alias("size")), borders(polygons, tolerance, side).checkpoint(), sizes.select("unit_id", "cx", "cy"), min_area)
    return dissolved(polygons, groups, tolerance, side)
