"""User polygons: location against brute ray crossing, adjacency against lattices, unions by area and border, merging of slivers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stratiform.functions import geometry
from stratiform.operators import graphs, partition, polygons


def table(spark, units):
    rows = [(u, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for u, rings in units.items()]
    return spark.createDataFrame(rows, f"unit_id long, rings {polygons.RINGS}").repartition(3)


def crossing(rings, x, y):
    """The usual ray to the right; the edge's lower end first, as shared edges run both ways."""
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y):
                (a, b), (c, d) = sorted(((y1, x1), (y2, x2)))
                odd ^= b + (y - a) / (c - a) * (d - b) > x
    return odd


def star(rng, cx, cy, size, n):
    return [(cx + r * math.cos(2 * math.pi * k / n), cy + r * math.sin(2 * math.pi * k / n)) for k in range(n) for r in [size * rng.uniform(0.3, 1)]]


@pytest.mark.parametrize("side", [None, 0.7, 40.0])
def test_location_against_ray_crossing(spark, side):
    """Overlapping stars, holes, several parts, a third of all points in one place; places on borders and corners of a lattice go to one unit."""
    rng = random.Random(4)
    units = {u: [star(rng, rng.uniform(0, 30), rng.uniform(0, 30), 8, rng.randrange(3, 40))] for u in range(12)}
    units[20] = [[(0, 0), (20, 0), (20, 20), (0, 20)], [(5, 5), (15, 5), (15, 15), (5, 15)], [(8, 8), (8, 12), (12, 12), (12, 8)]]
    units[21] = [[(40, 0), (41, 0), (41, 1)], [(45, 0), (46, 0), (46, 3), (45, 3)]]
    units |= {100 + 5 * i + j: [[(50 + i, j), (51 + i, j), (51 + i, j + 1), (50 + i, j + 1)]] for i in range(5) for j in range(5)}
    points = [(rng.uniform(-5, 60), rng.uniform(-5, 35)) for _ in range(500)] + [(50 + i / 2, j / 2) for i in range(11) for j in range(11)] + [(5.0, 5.0), (5.0, 9.0), (15.0, 15.0), (20.0, 7.0), (12.0, 10.0)] + [(10.0, 6.0)] * 300
    df = spark.createDataFrame([(i, x, y, "own") for i, (x, y) in enumerate(points)], "id long, x double, y double, gx string").repartition(4)
    found = {r.id: r.units for r in polygons.located(df, table(spark, units), side).collect()}
    assert found == {i: sorted(u for u, rings in units.items() if crossing(rings, x, y)) for i, (x, y) in enumerate(points)}
    # within the lattice a place has one unit, on borders too
    assert all(len([u for u in found[i] if u >= 100]) == 1 for i, (x, y) in enumerate(points) if 50 <= x < 55 and 0 <= y < 5)


def test_location_without_rows(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, None, 0.5)], "id long, x double, y double")
    square = table(spark, {7: [[(0, 0), (1, 0), (1, 1), (0, 1)]]})
    assert {(r.id, r.unit_id) for r in polygons.assigned(points, square).collect()} == {(1, 7), (2, None)}
    assert {(r.id, r.unit_id) for r in polygons.assigned(points, square.limit(0)).collect()} == {(1, None), (2, None)}
    assert polygons.assigned(points.limit(0), square).collect() == []


def test_wkt(spark):
    texts = ["POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1))", "multipolygon (((0 0, 1 0, 1 1)), ((5 5,6 5,6 6,5 5)))", "POINT(1 2)", "POLYGON((0 0, 1 1))", "POLYGON((0 0, x 1, 1 1, 2 0))", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "unit_id long, text string").withColumn("rings", polygons.from_wkt(F.col("text")))
    found = {r.unit_id: [[(p.x, p.y) for p in ring] for ring in r.rings or []] for r in rows.collect()}
    assert [len(r) for r in found[0]] == [5, 4] and [len(r) for r in found[1]] == [3, 4] and found[2] == found[3] == found[5] == [] and found[4] == [[(0, 0), (1, 1), (2, 0)]]
    area = {r.unit_id: r.area for r in polygons.measures(rows).collect()}
    assert area[0] == 15.5 and area[1] == 1.0
    again = rows.filter("size(rings) > 0").select("unit_id", polygons.from_wkt(polygons.to_wkt(F.col("rings"))).alias("rings"))
    assert {r.unit_id: r.area for r in polygons.measures(again).collect()} == {k: area[k] for k in (0, 1, 4)}


@pytest.mark.parametrize("queen", [True, False])
def test_lattice_adjacency(spark, queen):
    points = spark.createDataFrame([(0.0, 0.0), (7.0, 5.0)], "x double, y double")
    units = partition.lattice_units(points, 1.0).select("unit_id", F.array("ring").alias("rings"))
    want = {(r.i, r.j) for r in graphs.lattice_edges(spark, 7, 5, queen).collect()}
    assert {(r.i, r.j) for r in polygons.adjacency(units, queen).collect()} == want


def test_borders_of_unequal_edges(spark):
    """A long edge beside two short ones, a corner in the middle of an edge, an overlap, a gap below and one above the tolerance, and one within."""
    square = lambda x, y, s: [[(x, y), (x + s, y), (x + s, y + s), (x, y + s)]]
    units = {1: square(0, 0, 4), 2: square(4, 0, 2), 3: square(4, 2, 2), 4: [[(2, 4), (3, 6), (1, 6)]], 5: square(-1, -1, 2), 6: square(4 + 1e-9, 4 + 1e-9, 1), 7: square(6.01, 0, 1), 8: square(1.5, 1.5, 0.5)}
    found = {(r.i, r.j): r.shared for r in polygons.borders(table(spark, units)).collect()}
    want = {(1, 2): 2.0, (1, 3): 2.0, (2, 3): 2.0, (1, 4): 0.0, (1, 5): 0.0, (1, 6): 0.0, (3, 6): 1.0}
    assert found == pytest.approx(want | {(j, i): s for (i, j), s in want.items()})


def test_voronoi_cells_get_edges(spark):
    rng = random.Random(6)
    seeds = spark.createDataFrame([(i, rng.uniform(0, 9), rng.uniform(0, 9)) for i in range(25)], "unit_id long, cx double, cy double")
    cells = partition.voronoi_cells(seeds, [(0, 0), (9, 0), (9, 9), (0, 9)]).select("unit_id", F.array("ring").alias("rings"))
    edges = {(r.i, r.j) for r in polygons.adjacency(cells, queen=False, tolerance=1e-9).collect()}
    assert edges == {(j, i) for i, j in edges} and len(edges) / 2 <= 3 * 25 - 6
    assert graphs.connectivity(seeds.select(F.col("unit_id").alias("id")), polygons.adjacency(cells, tolerance=1e-9)).count() == 1
    measured = polygons.measures(cells).collect()
    assert sum(r.area for r in measured) == pytest.approx(81)


def test_dissolving(spark):
    """A ring of cells around a hole, two that touch in a corner, a T-junction, and a unit with a hole filled by another."""
    cell = lambda x, y, s=1: [[(x, y), (x + s, y), (x + s, y + s), (x, y + s)]]
    units = {10 * x + y: cell(x, y) for x in range(3) for y in range(3)}
    units |= {50: cell(10, 0), 51: cell(11, 1), 60: cell(20, 0, 2), 61: cell(22, 0), 62: cell(22, 1), 70: [[(30, 0), (34, 0), (34, 4), (30, 4)], [(31, 1), (33, 1), (33, 3), (31, 3)]], 71: [list(reversed(cell(31, 1, 2)[0]))]}
    groups = {u: 1 for u in range(100) if u in units and u < 50 and u != 11} | {11: 11, 50: 50, 51: 50, 60: 60, 61: 60, 62: 60, 70: 70, 71: 70}
    df = table(spark, units)
    out = polygons.dissolved(df, spark.createDataFrame(list(groups.items()), "unit_id long, group_id long")).cache()
    rings = {r.unit_id: [[(p.x, p.y) for p in ring] for ring in r.rings] for r in out.collect()}
    assert {u: len(r) for u, r in rings.items()} == {1: 2, 11: 1, 50: 2, 60: 1, 70: 1}
    area = {r.unit_id: r.area for r in polygons.measures(out).collect()}
    assert area == pytest.approx({1: 8, 11: 1, 50: 2, 60: 6, 70: 16})
    probe = [(x + 0.3, y + 0.6) for x in range(-1, 36) for y in range(-1, 6)]
    for x, y in probe:
        want = {groups[u] for u, r in units.items() if crossing(r, x, y)}
        assert {u for u, r in rings.items() if crossing(r, x, y)} == want


def test_merging_slivers(spark):
    """Slivers go where most border is shared; chains and pairs that choose each other end, and areas add up."""
    box = lambda x, y, w, h: [[(x, y), (x + w, y), (x + w, y + h), (x, y + h)]]
    units = {1: box(0, 0, 4, 4), 2: box(4, 0, 4, 4), 3: box(4, 4, 0.1, 1), 4: box(0, 4, 4, 0.2), 5: box(4.1, 4, 0.1, 0.5), 6: box(20, 20, 0.1, 0.1), 7: box(20.1, 20, 0.1, 0.1), 8: box(8, 1, 0.1, 1)}
    out = polygons.merged_slivers(table(spark, units), 0.9).cache()
    area = {r.unit_id: r.area for r in polygons.measures(out).collect()}
    total = 32 + 0.1 + 0.8 + 0.05 + 0.02 + 0.1
    assert sum(area.values()) == pytest.approx(total) and set(area) <= {1, 2, 3, 4} and min(area.values()) >= 0.9
    assert area[2] >= 16.1 and geometry is not None


def test_merging_by_points_keeps_all_units_apart_when_large(spark):
    sizes = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 1.0)], "unit_id long, size double")
    found = spark.createDataFrame([(1, 3, 2.0), (3, 1, 2.0), (2, 3, 1.0), (3, 2, 1.0)], "i long, j long, shared double")
    centroids = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 2.0, 0.0)], "unit_id long, cx double, cy double")
    assert {(r.unit_id, r.group_id) for r in polygons.merge_groups(sizes, found, centroids, 2.0).collect()} == {(1, 1), (2, 2), (3, 1)}
