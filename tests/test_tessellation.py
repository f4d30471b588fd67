"""Agglomerative units against a sequential program, exact numbers of units, and every method of the one entry."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stratiform.operators import graphs, partition, polygons, tessellation
from stratiform.operators.tessellation import Limits


def clustered(spark, n=400, seed=1):
    rng = random.Random(seed)
    centres = [(rng.uniform(0, 100), rng.uniform(0, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        cx, cy = centres[min(rng.randrange(9), 5)]
        rows.append((i, rng.gauss(cx, 7), rng.gauss(cy, 7), rng.randrange(5)))
    return rows, spark.createDataFrame(rows, "id long, x double, y double, t long").repartition(4)


def sequential(rows, seeds, least, times, min_units):
    """One violator after another, the one with fewest points first, into the unit that is nearest."""
    units = {u: (x, y) for u, x, y in seeds}
    while len(units) > min_units:
        held = {u: [] for u in units}
        for i, x, y, t in rows:
            held[min(units, key=lambda u: ((units[u][0] - x) ** 2 + (units[u][1] - y) ** 2, u))].append(t)
        bad = [u for u in units if len(held[u]) < least or len(set(held[u])) < times]
        if not bad:
            break
        u = min(bad, key=lambda u: (len(held[u]), u))
        (x, y), a = units.pop(u), len(held[u])
        to = min(units, key=lambda v: ((units[v][0] - x) ** 2 + (units[v][1] - y) ** 2, v))
        b, (p, q) = len(held[to]), units[to]
        share = a / (a + b) if a + b else 0.5
        units[to] = (share * x + (1 - share) * p, share * y + (1 - share) * q)
    return units


def test_agglomeration_against_a_sequential_program(spark):
    rows, df = clustered(spark, 250)
    rng = random.Random(2)
    seeds = [(k + 1, rng.uniform(0, 100), rng.uniform(0, 60)) for k in range(14)]
    units, reason = tessellation.agglomerated(df, seeds, [], Limits(min_points=15, min_times=4), per_round=1)
    want = sequential(rows, seeds, 15, 4, 3)
    assert {u for u, _, _ in units} == set(want) and reason == "limits_kept"
    for u, x, y in units:
        assert (x, y) == pytest.approx(want[u])


def test_rounds_of_pairs_keep_the_limits(spark):
    rows, df = clustered(spark)
    seeds = [(k + 1, x, y) for k, (_, x, y, _) in enumerate(rows[:60])]
    hull = tessellation.expanded_hull(df, 0.5)
    units, reason = tessellation.agglomerated(df, seeds, hull, Limits(min_points=20, min_times=3, min_area=40.0))
    counts = tessellation.nearest_units(df, units).groupBy("unit_id").agg(F.count("*").alias("n"), F.count_distinct("t").alias("times")).collect()
    assert reason == "limits_kept" and len(counts) == len(units) < 20 and sum(r.n for r in counts) == len(rows)
    assert min(r.n for r in counts) >= 20 and min(r.times for r in counts) >= 3
    none, reason = tessellation.agglomerated(df, seeds, hull, Limits(min_points=10_000), min_units=4)
    assert len(none) == 4 and reason == "min_units_reached"


def test_nearest_units_of_many(spark):
    rows, df = clustered(spark, 300)
    rng = random.Random(7)
    units = [(k + 1, rng.uniform(0, 100), rng.uniform(0, 60)) for k in range(tessellation.LITERAL + 40)]
    want = {i: min(units, key=lambda u: ((u[1] - x) ** 2 + (u[2] - y) ** 2, u[0]))[0] for i, x, y, _ in rows}
    assert {r.id: r.unit_id for r in tessellation.nearest_units(df, units).collect()} == want


@pytest.mark.parametrize("target", [1, 4, 9, 25])
def test_exact_number_of_units(spark, target):
    _, df = clustered(spark, 100)
    cells = partition.voronoi_cells(spark.createDataFrame([(k, 10.0 * k, 7.0 * (k * k % 5)) for k in range(9)], "unit_id long, cx double, cy double"), [(0, 0), (90, 0), (90, 35), (0, 35)])
    units = cells.select("unit_id", F.array("ring").alias("rings"))
    out = tessellation.exact_units(units, target).cache()
    area = [r.area for r in polygons.measures(out).collect()]
    assert len(area) == out.select("unit_id").distinct().count() == target and sum(area) == pytest.approx(90 * 35)


def test_groups_join_smallest_first():
    sizes = [(1, 5.0, 0.0, 0.0), (2, 1.0, 1.0, 0.0), (3, 4.0, 10.0, 0.0), (4, 1.0, 9.0, 0.0)]
    assert tessellation.groups_down_to(sizes, 2) == {1: 1, 2: 1, 3: 3, 4: 3}


@pytest.mark.parametrize("method", tessellation.METHODS)
def test_every_method(spark, method):
    rows, df = clustered(spark, 300)
    own = None
    if method == "user":
        own = spark.createDataFrame([(k, f"POLYGON(({x} {y}, {x + 40} {y}, {x + 40} {y + 40}, {x} {y + 40}))") for k, (x, y) in enumerate([(-30, -30), (10, -30), (50, -30), (-30, 10), (10, 10), (50, 10)])], "unit_id long, text string").withColumn("rings", polygons.from_wkt(F.col("text")))
    found = tessellation.spatial_units(df, method, target_units=8, user_polygons=own, prune_empty=method == "lattice", limits=Limits(min_points=5 if method == "avt" else 1))
    units = {r.unit_id: r for r in found.units.collect()}
    assigned = found.assigned.collect()
    assert sorted(r.id for r in assigned) == list(range(300)) and {r.unit_id for r in assigned} <= set(units)
    assert sum(u.point_count for u in units.values()) == 300 and all(u.area > 0 for u in units.values())
    if method == "lattice":
        assert min(u.point_count for u in units.values()) > 0
    for r in assigned:
        inside = [u for u, v in units.items() if method == "user" and v.rings[0][0]["x"] <= r.x < v.rings[0][2]["x"] and v.rings[0][0]["y"] <= r.y < v.rings[0][2]["y"]]
        assert r.unit_id == (inside[0] if inside else min(units, key=lambda u: ((units[u].cx - r.x) ** 2 + (units[u].cy - r.y) ** 2, u)))
    edges = {(r.i, r.j) for r in found.edges.collect()}
    assert edges == {(j, i) for i, j in edges} and graphs.connectivity(found.units.select(F.col("unit_id").alias("id")), found.edges).count() == 1


def test_exact_units_of_the_entry(spark):
    _, df = clustered(spark, 200)
    found = tessellation.spatial_units(df, "avt", target_units=7, exact=True, limits=Limits(min_points=3), max_units=20)
    assert found.units.count() == 7 and sum(r.point_count for r in found.units.collect()) == 200
    hull = tessellation.expanded_hull(df, 0.5)
    size = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(hull, hull[1:] + hull[:1]))) / 2
    assert found.units.agg(F.sum("area")).first()[0] == pytest.approx(size) and not math.isnan(size)
