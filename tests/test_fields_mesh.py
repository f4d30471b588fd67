"""Sparse fields against dense algebra, and triangles and barycentric weights against their definitions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratiform.operators import fields, graphs, mesh, polygons
from stratiform.operators.partition import chain


def dense(matrix, n):
    out = np.zeros((n, n))
    for r in matrix.collect():
        out[r.i - 1, r.j - 1] += r.q
    return out


@pytest.fixture(scope="module")
def lattice(spark):
    edges = graphs.lattice_edges(spark, 5, 4).withColumn("w", 1.0 + F.pmod(F.xxhash64(F.least("i", "j"), F.greatest("i", "j")), F.lit(5)) / 4).cache()
    nodes = spark.range(1, 21).select(F.col("id").alias("i"))
    w = np.zeros((20, 20))
    for r in edges.collect():
        w[r.i - 1, r.j - 1] = r.w
    return edges, nodes, w


def test_precision_matrices(lattice):
    edges, nodes, w = lattice
    one, lap = np.eye(20), np.diag(w.sum(1)) - w
    rows = w / w.sum(1, keepdims=True)
    low = np.tril(w, -1)
    gram = lambda m, rho: (one - rho * m).T @ (one - rho * m)
    want = {"icar": lap, "leroux": 0.8 * lap + 0.2 * one, "spde": (one + lap) @ (one + lap), "sar": gram(rows, 0.8), "dag": gram(low, 0.8), "networkflow": gram(w, 0.8)}
    for kind, q in want.items():
        assert np.allclose(dense(fields.precision(edges, nodes, kind, ridge=0.3), 20), q + 0.3 * one)
    arcs = edges.filter("i < j")
    for flow, m in (("upstream", np.triu(w).T), ("downstream", np.triu(w)), ("bidirectional", w / 2)):
        assert np.allclose(dense(fields.precision(arcs, nodes, "networkflow", flow=flow), 20), gram(m, 0.8))
    with pytest.raises(ValueError):
        fields.precision(edges, nodes, "none")


@pytest.mark.parametrize("kind", ["icar", "spde"])
def test_solutions_of_several_draws(spark, lattice, kind):
    edges, nodes, _ = lattice
    matrix = fields.precision(edges, nodes, kind, ridge=0.05)
    rng = np.random.default_rng(1)
    b = rng.normal(size=(3, 20))
    b[2] = 0
    right = spark.createDataFrame([(d, i + 1, float(b[d, i])) for d in range(3) for i in range(20)], "draw long, i long, value double")
    found = fields.solved(matrix, right)
    x = np.zeros((3, 20))
    for r in found.collect():
        x[r.draw, r.i - 1] = r.value
    assert np.allclose(x, np.linalg.solve(dense(matrix, 20), b.T).T, rtol=1e-7, atol=1e-9)
    back = np.zeros((3, 20))
    for r in fields.applied(matrix, found).collect():
        back[r.draw, r.i - 1] = r.value
    assert np.abs(back - b).max() < 1e-8


def test_solution_that_does_not_settle_is_an_error(spark, lattice):
    edges, nodes, _ = lattice
    right = nodes.select(F.lit(0).cast("long").alias("draw"), "i", F.sin("i").alias("value"))
    with pytest.raises(ArithmeticError):
        fields.solved(fields.precision(edges, nodes, "icar", ridge=1e-6), right, rounds=2)
    assert fields.solved(fields.precision(edges, nodes, "leroux"), right.limit(0)).collect() == []


def test_smoothing_fills_nodes_without_observations(spark, lattice):
    edges, nodes, w = lattice
    n = [0 if i % 3 else 4 for i in range(20)]
    observed = spark.createDataFrame([(0, i + 1, n[i], n[i] * math.sin(i)) for i in range(20)], "draw long, i long, n long, total double")
    found = {r.i: r.value for r in fields.smoothed(fields.precision(edges, nodes, "icar"), observed, 0.5).collect()}
    q = np.diag(w.sum(1)) - w + np.diag(n) / 0.25
    assert np.allclose([found[i + 1] for i in range(20)], np.linalg.solve(q, [n[i] * math.sin(i) / 0.25 for i in range(20)]), atol=1e-7)


def knots_of(kind):
    rng = random.Random(3)
    if kind == "lattice":
        return [(10 + i, float(i % 6), float(i // 6)) for i in range(30)]
    if kind == "line":
        return [(i, float(i), 0.0) for i in range(6)]
    return [(i, rng.gauss(0, 3), rng.gauss(0, 3)) for i in range(45)] + [(99, 400.0, 3.0)]


@pytest.mark.parametrize("kind", ["random", "lattice"])
def test_triangles_have_empty_circles_and_fill_the_hull(spark, kind):
    rows = knots_of(kind)
    at = {i: (x, y) for i, x, y in rows}
    found = mesh.delaunay(spark.createDataFrame(rows, "id long, x double, y double")).cache()
    for r in found.collect():
        (ax, ay), (bx, by), (cx, cy) = at[r.a], at[r.b], at[r.c]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        ux = ((ax * ax + ay * ay) * (by - cy) + (bx * bx + by * by) * (cy - ay) + (cx * cx + cy * cy) * (ay - by)) / d
        uy = ((ax * ax + ay * ay) * (cx - bx) + (bx * bx + by * by) * (ax - cx) + (cx * cx + cy * cy) * (bx - ax)) / d
        radius = math.hypot(ax - ux, ay - uy)
        assert d > 0 and all(math.hypot(x - ux, y - uy) > radius - 1e-4 for x, y in at.values())
    hull = chain(list(at.values()))
    size = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(hull, hull[1:] + hull[:1])) / 2
    assert sum(r.area for r in polygons.measures(found).collect()) == pytest.approx(size, rel=1e-3)


def test_no_triangles(spark):
    assert mesh.delaunay(spark.createDataFrame(knots_of("line")[:2], "id long, x double, y double")).collect() == []
    line = mesh.delaunay(spark.createDataFrame(knots_of("line"), "id long, x double, y double"))
    assert line.collect() == []


def test_barycentric_weights(spark):
    rows = knots_of("lattice")
    knots = spark.createDataFrame(rows, "id long, x double, y double")
    rng = random.Random(9)
    points = [(i, rng.uniform(-1, 6), rng.uniform(-1, 5)) for i in range(300)] + [(1000 + i, x, y) for i, x, y in rows] + [(2000, 2.5, 4.0), (2001, 5.0, 1.5), (2002, 0.0, 3.3)]
    df = spark.createDataFrame(points, "id long, x double, y double").repartition(3)
    basis = mesh.barycentric(df, mesh.delaunay(knots)).cache()
    by = {}
    for r in basis.collect():
        by.setdefault(r.id, {})[r.knot] = r.weight
    inside = {i for i, x, y in points if 0 <= x <= 5 and 0 <= y <= 4}
    assert set(by) == inside
    for i, w in by.items():
        assert sum(w.values()) == pytest.approx(1) and min(w.values()) > -1e-6
    # a linear function is reproduced, and a knot has its own value
    values = knots.select(F.col("id").alias("knot"), (2 * F.col("x") - 3 * F.col("y") + 1).alias("value"))
    got = {r.id: r.value for r in mesh.interpolated(basis, values).collect()}
    assert got == pytest.approx({i: 2 * x - 3 * y + 1 for i, x, y in points if i in inside}, abs=1e-6)
