"""Analytic cases, invariants and round trips of the engine's operators."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratiform.functions import bases, geometry, likelihoods, scalars
from stratiform.operators import effects, graphs, movement, partition, posterior, prepare
from stratiform.sources import store, synthetic
from stratiform.streaming import live


def value(spark, column):
    return spark.range(1).select(column).collect()[0][0]


def normal_log(y, mu, s):
    return -0.5 * ((y - mu) / s) ** 2 - math.log(s) - 0.5 * math.log(2 * math.pi)


def test_likelihood_cases(spark):
    zero = likelihoods.log_density("poisson", F.lit(0), F.lit(1.0))
    assert value(spark, likelihoods.zero_inflated("poisson", F.lit(0), zero, zero, 0.2)) == pytest.approx(math.log(0.2 + 0.8 * math.exp(-math.e)))
    lp = likelihoods.log_density("gaussian", F.lit(0.3), F.lit(1.0), 0.5)
    assert value(spark, lp) == pytest.approx(normal_log(0.3, 1.0, 0.5))
    low, high = F.lit(2.0), F.lit(float("inf"))
    upper_tail = 0.5 * math.erfc(2 / math.sqrt(2))
    assert value(spark, likelihoods.censored_gaussian(F.lit(0.0), F.lit(1.0), 0.5, low, high)) == pytest.approx(math.log(upper_tail), rel=1e-4)
    a, b = 0.377541 * 20, 0.622459 * 20
    beta = math.lgamma(20) - math.lgamma(a) - math.lgamma(b) + (a - 1) * math.log(0.4) + (b - 1) * math.log(0.6)
    assert value(spark, likelihoods.log_density("beta", F.lit(0.4), F.lit(-0.5), extra=20.0)) == pytest.approx(beta, rel=1e-4)
    r, mean = 2.0, math.exp(1.5)
    nb = math.lgamma(4) - math.lgamma(2) - math.log(2) + r * math.log(r / (r + mean)) + 2 * math.log(mean / (r + mean))
    assert value(spark, likelihoods.log_density("negbin", F.lit(2), F.lit(1.5), extra=2.0)) == pytest.approx(nb)


def test_scalars(spark):
    assert value(spark, scalars.mod1(F.lit(12), 12)) == 12
    assert value(spark, scalars.logsumexp(F.lit(0.0), F.lit(0.0))) == pytest.approx(math.log(2))
    assert value(spark, scalars.canonical_term(F.lit("b*a"))) == "a&b"
    assert value(spark, scalars.base_name(F.lit("beta[3]"))) == "beta"
    assert value(spark, scalars.logistic(F.lit(-800.0))) == 0.0


def test_geometry(spark):
    square = geometry.rectangle(F.lit(0.0), F.lit(0.0), 2.0, 3.0)
    assert value(spark, geometry.area(square)) == 6.0
    assert value(spark, geometry.wkt(square)).startswith("POLYGON((0.0 0.0, 2.0 0.0")
    assert value(spark, geometry.wkt(F.slice(square, 1, 2))) == "POLYGON EMPTY"
    assert value(spark, geometry.area(geometry.hexagon(F.lit(0.0), F.lit(0.0), 1.0))) == pytest.approx(3 * math.sqrt(3) / 2)


def test_bspline_adds_up(spark):
    b = bases.bspline(F.col("id") / 10.0, [3.0, 6.0], 0.0, 9.0)
    sums = [r[0] for r in spark.range(91).select(F.aggregate(b, F.lit(0.0), lambda a, x: a + x)).collect()]
    assert sums == pytest.approx([1.0] * 91)


def test_discretise_right_closed(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3)], "x double")
    rows = prepare.discretised(df, "x", "provided", provided=[0.0, 1.0, 2.0, 3.0]).orderBy("x").collect()
    assert [r.bin for r in rows] == [1, 1, 2, 3]


def test_weights_and_components(spark):
    edges = graphs.lattice_edges(spark, 3, 3)
    assert edges.count() == 40
    sums = [r.s for r in graphs.weighted(edges, "row_standardized").groupBy("i").agg(F.sum("w").alias("s")).collect()]
    assert sums == pytest.approx([1.0] * 9)
    nodes = spark.range(1, 11)
    report = {r.component: r.members for r in graphs.connectivity(nodes, edges).collect()}
    assert report == {1: 9, 10: 1}


def test_knn_against_brute_force(spark):
    import numpy as np

    xy = np.random.default_rng(1).random((60, 2)) * 10
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    got = {}
    for r in graphs.nearest(pts, pts, 3, 0.5).collect():
        got.setdefault(r.id, set()).add(r.j)
    for i in range(60):
        d = ((xy - xy[i]) ** 2).sum(1)
        d[i] = np.inf
        assert got[i] == set(np.argsort(d)[:3].tolist())


def test_partition_invariants(spark):
    pts = synthetic.panel(spark, 20, 5).select(F.monotonically_increasing_id().alias("id"), F.col("s_x").alias("x"), F.col("s_y").alias("y")).cache()
    assert partition.quadrant_units(pts, 7, binary=True).select("region").distinct().count() == 7
    assert partition.lattice_assigned(pts, 2.5).filter("unit_id is null").count() == 0
    total = partition.kde_grid(pts, 10).agg(F.sum("density")).collect()[0][0]
    assert total == pytest.approx(1.0)


def test_movement_rows_sum_to_one(spark):
    gamma = spark.createDataFrame([(1, 1, 0.6), (1, 2, 0.4), (2, 1, 0.3), (2, 2, 0.7)], "i long, j long, w double")
    sums = [r.s for r in movement.multistep(gamma, 2).groupBy("i").agg(F.sum("w").alias("s")).collect()]
    assert sums == pytest.approx([1.0, 1.0])
    walks = movement.trajectories(spark.createDataFrame([(1, 1), (2, 2)], "indiv long, unit_id long"), gamma, spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0)], "id long, cx double, cy double"), 5, 0.5)
    assert walks.count() == 12


def test_effects(spark):
    z = spark.createDataFrame([(1, t, float(t)) for t in range(1, 6)], "g long, t long, z double")
    assert [r.effect for r in effects.rw2(z, ["g"], "t", "z").orderBy("t").collect()] == [1, 4, 10, 20, 35]
    got = [r.effect for r in effects.ar2(z, ["g"], "t", "z", 0.5, 0.0).orderBy("t").collect()]
    assert got == pytest.approx([1.0, 2.5, 4.25, 6.125, 8.0625])
    edges = graphs.lattice_edges(spark, 3, 3)
    total = effects.field_effect(spark.range(1, 10).select(F.lit(1).cast("long").alias("draw"), F.col("id").alias("unit_id"), F.randn(1).alias("z")), effects.spectral_map(edges)).agg(F.sum("effect")).collect()[0][0]
    assert total == pytest.approx(0.0, abs=1e-6)
    assert effects.bym2_scale(edges) * effects.bym2_scale(edges, inverse=True) == pytest.approx(1.0)


def test_store_round_trip(spark, tmp_path):
    results = store.ResultStore(spark, f"file://{tmp_path}/db", "m1")
    results.save_metrics({"rmse": 1.5, "shape": [1.0, 2.0]})
    results.save_metadata({"formula": "y ~ x"})
    assert set(results.load()) == {"metrics", "model_metadata"}
    assert results.read("predictions") is None
    assert results.sql("SELECT count(*) FROM m1_metrics").collect()[0][0] == 3
    draws = spark.createDataFrame([(1, 1, 0.5, [1.0, 2.0])], "chain int, iteration int, sigma double, beta array<double>")
    tidy = store.tidy_draws(draws, ["sigma", "beta"])
    assert {r.parameter for r in tidy.collect()} == {"sigma", "beta[1]", "beta[2]"}
    assert store.wide_draws(tidy, ["sigma", "beta[1]"]).columns == ["chain", "iteration", "sigma", "beta[1]"]
    pts = spark.createDataFrame([(0.0, 0.0), (3.0, 2.0)], "x double, y double")
    store.export_geojson(partition.lattice_units(pts, 1.0), f"file://{tmp_path}/geo", ["unit_id"])
    parts = [json.loads(p.read_text()) for p in tmp_path.glob("geo/part-*")]
    assert all(p["type"] == "FeatureCollection" for p in parts)
    assert sorted(f["properties"]["unit_id"] for p in parts for f in p["features"]) == [1, 2, 3, 4, 5, 6]


def test_store_saves_and_compacts(spark, tmp_path):
    results = store.ResultStore(spark, f"file://{tmp_path}/store")
    rows = spark.range(10, numPartitions=4).select("id", (F.col("id") * 2).alias("value"))
    results.save({"predictions": rows, "spatial": rows}, metadata={"family": "poisson"}, metrics={"rmse": 1.5})
    assert set(results.load()) == {"predictions", "plot_data_spatial", "model_metadata", "metrics"}
    results.compact("predictions")
    assert len(list(tmp_path.glob("store/predictions/part-*"))) == 1
    assert sorted(r.value for r in results.read("predictions").collect()) == [2 * i for i in range(10)]
    assert set(results.names()) == {"predictions", "plot_data_spatial", "model_metadata", "metrics"}


def test_hexagons_by_arithmetic(spark):
    pts = spark.range(3000).select("id", (F.rand(1) * 500).alias("x"), (F.rand(2) * 300).alias("y")).persist()
    units = [(u.unit_id, u.cx, u.cy) for u in partition.hexagon_units(pts, 37.0).collect()]
    want = {r.id: r.unit_id for r in partition.nearest_unit(pts, units).collect()}
    assert {r.id: r.unit_id for r in partition.hexagon_assigned(pts, 37.0).collect()} == want


def test_weighted_density(spark):
    rows = spark.createDataFrame([(-2.0, 0.5), (-2.0, None), (-math.inf, 0.0)], "ll double, w double")
    assert [r[0] for r in rows.select(likelihoods.weighted(F.col("ll"), F.col("w"))).collect()] == [-1.0, -2.0, 0.0]


def test_psis(spark):
    """Draws of a normal mean given n observations: elpd is close to the exact leave-one-out density, and k is small."""
    rng = np.random.default_rng(3)
    y = rng.normal(size=30)
    mu = rng.normal(y.mean(), 1 / math.sqrt(len(y)), 2000)
    ll = -0.5 * (y[:, None] - mu) ** 2 - 0.5 * math.log(2 * math.pi)
    rows = spark.createDataFrame(pd.DataFrame({"obs_id": np.repeat(np.arange(30), 2000), "draw": np.tile(np.arange(2000), 30), "ll": ll.ravel()}))
    for r in posterior.psis_loo(rows).collect():
        rest = np.delete(y, r.obs_id)
        spread = 1 + 1 / len(rest)
        exact = -0.5 * (y[r.obs_id] - rest.mean()) ** 2 / spread - 0.5 * math.log(2 * math.pi * spread)
        assert r.elpd == pytest.approx(exact, abs=0.03) and r.pareto_k < 0.5


def test_bma(spark):
    weights = posterior.model_weights(spark.createDataFrame([("a", 10.0), ("b", 12.0), ("c", float("nan"))], "model_name string, waic double"))
    got = {r.model_name: r.bma_weight for r in weights.collect()}
    assert got["c"] == 0 and got["a"] == pytest.approx(1 / (1 + math.exp(-1)))


def test_panels(spark):
    df = synthetic.areal_disease_panel(spark)
    assert df.count() == 560
    assert df.filter("y_cat1 + y_cat2 + y_cat3 != 20").count() == 0
    assert synthetic.compositional(spark).filter("cat_1 + cat_2 + cat_3 + cat_4 not between 80 and 150").count() == 0


def test_streaming_transitions(spark, tmp_path):
    rows = [(1, 1, 10), (1, 2, 11), (2, 1, 10), (1, 3, 10)]
    spark.createDataFrame(rows, "tag long, t long, unit long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("tag long, t long, unit long").parquet(f"{tmp_path}/in")
    q = live.transitions(stream, "tag", "t", "unit").writeStream.format("memory").queryName("moves").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.tag, r.from_unit, r.to_unit) for r in spark.table("moves").collect()) == [(1, 10, 11), (1, 11, 10)]


def test_log_densities_in_the_tails(spark):
    """Values that plain formulas lose: a bound nine deviations out, a sure failure, no extra zeros."""
    from stratiform.functions import likelihoods as lk

    exact = lambda z: math.log(0.5 * math.erfc(z / math.sqrt(2)))
    one = spark.range(1).select(F.lit(0.0).alias("eta"))
    inf, eta = math.inf, F.col("eta")
    value = lambda c: one.select(c.cast("double")).first()[0]
    for z in (-3.0, 0.0, 1.5, 2.5, 5.0, 9.0, 20.0):
        got = value(lk.censored_gaussian(F.lit(0.0), eta, 1.0, F.lit(z), F.lit(inf)))
        assert abs(got - exact(z)) < 1e-4 * max(1, abs(exact(z)))
        assert abs(value(lk.censored_gaussian(F.lit(0.0), eta, 1.0, F.lit(-inf), F.lit(-z))) - exact(z)) < 1e-4 * max(1, abs(exact(z)))
    between = math.log(0.5 * math.erfc(8 / math.sqrt(2)) - 0.5 * math.erfc(9 / math.sqrt(2)))
    assert abs(value(lk.censored_gaussian(F.lit(0.0), eta, 1.0, F.lit(8.0), F.lit(9.0))) - between) < 1e-4
    assert abs(value(lk.log_density("bernoulli", F.lit(0), F.lit(40.0))) + 40) < 1e-9
    assert abs(value(lk.log_density("bernoulli", F.lit(1), F.lit(-800.0))) + 800) < 1e-9
    lp = lk.log_density("poisson", F.lit(0), eta)
    assert abs(value(lk.zero_inflated("poisson", F.lit(0), lp, lp, 0.0)) + 1) < 1e-9


def test_components_of_a_long_path(spark):
    """A shuffled path of 600 nodes, a pair, and a node without edges."""
    import random

    from stratiform.operators import graphs

    ids = list(range(1, 601))
    random.Random(4).shuffle(ids)
    edges = spark.createDataFrame([*zip(ids, ids[1:]), (900, 901), (901, 900)], "i long, j long")
    nodes = spark.createDataFrame([(i,) for i in [*ids, 900, 901, 999]], "id long")
    found = {r.id: r.component for r in graphs.components(nodes, edges).collect()}
    assert found == {**{i: 1 for i in ids}, 900: 900, 901: 900, 999: 999}


def test_jenks_against_all_values(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    for x in (np.round(rng.lognormal(0, 2, 180), 3), np.concatenate((rng.normal(0, 1, 90), [5e4, 5e4, 9e5]))):
        v = np.sort(x)
        n = len(v)
        s, q = np.r_[0, np.cumsum(v)], np.r_[0, np.cumsum(v * v)]
        cost = lambda a, b: q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a)
        best = [0.0] + [np.inf] * n
        for _ in range(5):
            best = [np.inf] + [min(best[a] + cost(a, b) for a in range(b)) for b in range(1, n + 1)]
        brks = prepare.jenks_breaks(spark.createDataFrame([(float(a),) for a in x] + [(None,), (float("nan"),)], "x double"), "x", 5)
        assert len(brks) == 6
        at = np.searchsorted(v, brks[1:], side="right")
        assert sum(cost(a, b) for a, b in zip(np.r_[0, at[:-1]], at) if b > a) == pytest.approx(best[n], rel=1e-6)
    assert prepare.jenks_breaks(spark.createDataFrame([], "x double"), "x", 5) == []
    assert prepare.jenks_breaks(spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "x double"), "x", 5) == [1.0, 1.0, 2.0]


def test_log_gamma(spark):
    xs = [1e-8, 0.01, 0.5, 1.0, 2.0, 3.7, 50.0, 1e5, 1e9]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", likelihoods.lgamma(F.col("x")).alias("g")).collect()
    for row in rows:
        assert row.g == pytest.approx(math.lgamma(row.x), rel=1e-11, abs=1e-11)
    assert spark.range(1).select(likelihoods.log_density("half_student_t", F.lit(-1.0), F.lit(0.0))).first()[0] == -math.inf


def test_connected_bridges_by_closest_pair(spark):
    places = {1: (0.0, 0.0), 2: (1.0, 0.0), 3: (5.0, 0.0), 4: (6.0, 0.0), 5: (40.0, 0.0), 6: (41.0, 1.0)}
    nodes = spark.createDataFrame([(k, *v) for k, v in places.items()], "id long, x double, y double")
    edges = spark.createDataFrame([(a, b, 1.0) for p, q in ((1, 2), (3, 4), (5, 6)) for a, b in ((p, q), (q, p))], "i long, j long, w double")
    found = graphs.connected(nodes, edges, 1.0)
    assert {(r.i, r.j) for r in graphs.endpoints(found).collect()} == {(1, 2), (3, 4), (5, 6), (2, 3), (4, 5)}
    assert graphs.connectivity(nodes, found).count() == 1


def test_inducing_points(spark):
    pts = spark.createDataFrame([(i, float(i % 7), float(i // 7)) for i in range(49)], "id long, x double, y double")
    assert partition.inducing_points(pts, 5, "random").count() == 5
    assert partition.inducing_points(pts, 4, "kmeans").count() == 4
    assert [r.id for r in partition.inducing_points(pts, 3, "regular").orderBy("id").collect()] == [0, 24, 48]
