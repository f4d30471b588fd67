"""Cases of larger tables, in small: values beyond those of the small tables, many rows at one place, results that must not depend on how they are found."""

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from stratiform.operators import graphs, movement, partition, posterior, prepare
from stratiform.plans import queries as plans


def saved(spark, folder, **tables):
    for name, frame in tables.items():
        spark.createDataFrame(frame).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_splines_reach_the_largest_value(spark, tmp_path):
    folder = saved(spark, tmp_path, events=pd.DataFrame({"event_id": range(5), "value": [0.0, 120.5, 500.0, 500.5, 560.21]}))
    assert {r.total for r in plans.bspline_basis(spark, folder).collect()} == {1.0}


def scattered(rng, n=900):
    """Even points, a dense cluster, copies at few places and far outliers."""
    xy = np.vstack([rng.uniform(0, 100, (n, 2)), rng.normal(50, 0.01, (n, 2)), rng.integers(0, 4, (n, 2)) * 9.0, rng.uniform(1e4, 1e6, (9, 2))])
    return pd.DataFrame({"id": rng.permutation(len(xy)), "x": xy[:, 0], "y": xy[:, 1]})


def nearest_by_hand(p, k, before):
    found = set()
    for q in p.itertuples():
        rows = p[(p.x < q.x) | ((p.x == q.x) & ((p.y < q.y) | ((p.y == q.y) & (p.id < q.id))))] if before else p[p.id != q.id]
        d = np.sqrt((q.x - rows.x) ** 2 + (q.y - rows.y) ** 2)
        order = np.lexsort((rows.id, d))[:k]
        found |= {(q.id, int(j), r + 1) for r, j in enumerate(rows.id.to_numpy()[order])}
    return found


@pytest.mark.parametrize("before", [False, True])
def test_neighbours_are_settled_by_tiles(spark, monkeypatch, before):
    """Most places in rounds of tiles, whatever the density: few are left to the descent, which takes a row for each query and cell."""
    p = scattered(np.random.default_rng(7))
    left = []
    descent = graphs._descent
    monkeypatch.setattr(graphs, "_descent", lambda queries, *more: left.append(queries.count()) or descent(queries, *more))
    monkeypatch.setattr(graphs, "FEW", 20)
    monkeypatch.setattr(graphs, "CROWD", 2500)
    df = spark.createDataFrame(p)
    got = graphs.preceding_neighbours(df, 4, 25.0) if before else graphs.nearest(df, df, 4, 25.0)
    assert {(r.id, r.j, r["rank"]) for r in got.collect()} == nearest_by_hand(p, 4, before)
    assert sum(left) < 100


def test_components_without_edges(spark):
    """The components of a radius graph, also where cells are linked only by points that are not their furthest ones."""
    rng = np.random.default_rng(3)
    for n, radius in ((1500, 3.0), (250, 6.0)):
        p = pd.DataFrame({"id": rng.permutation(n), "x": rng.uniform(0, 130, n), "y": rng.uniform(0, 130, n)})
        p.loc[:80, ["x", "y"]] = [7.0, 7.0]
        df = spark.createDataFrame(p)
        want = graphs.connectivity(df, graphs.radius_edges(df, radius)).collect()
        assert sorted(map(tuple, graphs.radius_components(df, radius).collect())) == sorted(map(tuple, want))


def test_edges_of_copies_are_made_after_the_join(spark, monkeypatch):
    """Places meet, not their points: what is joined does not grow with the square of the copies."""
    rng = np.random.default_rng(11)
    xy = rng.uniform(-30, 30, (60, 2))
    for held, copies in ((1024, 7), (3, 40)):
        monkeypatch.setattr(graphs, "HELD", held)
        p = pd.DataFrame(np.repeat(xy, copies, axis=0), columns=["x", "y"])
        p["id"] = rng.permutation(len(p))
        df = spark.createDataFrame(p).unionByName(spark.createDataFrame([(10**6, None, 1.0), (10**6 + 1, float("nan"), 1.0), (10**6 + 2, float("nan"), 1.0)], "id long, x double, y double"))
        x, y, ids = (p[c].to_numpy() for c in ("x", "y", "id"))
        near = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 <= 64.0
        np.fill_diagonal(near, False)
        a, b = np.nonzero(near)
        got = [(r.i, r.j) for r in graphs.radius_edges(df, 8.0).collect()]
        assert len(got) == len(a) and set(got) == set(zip(ids[a].tolist(), ids[b].tolist()))
        if held > copies:
            assert graphs._place_pairs(df, 8.0).count() < len(a) / copies**2 + len(xy)


@pytest.mark.parametrize("pairs", [1_000_000_000, 900])
def test_neighbours_of_distinct_places_travel_together(spark, monkeypatch, pairs):
    """A row for each place and piece of its neighbours, not for each pair of places; tiles dealt to groups, values of any size, repeated ids."""
    monkeypatch.setattr(graphs, "PAIRS", pairs)
    rng = np.random.default_rng(3)
    xy = np.vstack([rng.uniform(-20, 20, (200, 2)), rng.integers(-3, 3, (30, 2)) * 8.0, [[1e18, 0], [1e18, 3], [-1e300, 2], [-1e300, 9.5], [np.inf, 0], [np.inf, 0], [np.nan, 0]]])
    ids = np.arange(len(xy)) - 5
    ids[::40] = 7
    df = spark.createDataFrame(pd.DataFrame({"id": ids, "x": xy[:, 0], "y": xy[:, 1]})).unionByName(spark.createDataFrame([(None, 0.0, 0.0), (500, None, 0.0)], "id long, x double, y double"))
    d2 = (xy[:, None, 0] - xy[:, 0]) ** 2 + (xy[:, None, 1] - xy[:, 1]) ** 2
    a, b = np.nonzero((d2 <= 64.0) & (ids[:, None] != ids))
    assert sorted((r.i, r.j) for r in graphs.radius_edges(df, 8.0).collect()) == sorted(zip(ids[a].tolist(), ids[b].tolist()))
    assert graphs._place_pairs(df, 8.0).count() <= len(xy) < len(a) / 10


def test_neighbours_of_a_tile_come_in_pieces(monkeypatch):
    """Whatever is compared at once and held in a row, each own place gets all points within reach once."""
    rng = np.random.default_rng(8)
    x, y, own = rng.uniform(-8, 40, 90), rng.uniform(-8, 16, 90), rng.random(90) < 0.4
    ids = [[1000 * n + m for m in range(1 + n % 3)] for n in range(90)]
    tile = pa.table({"x": x, "y": y, "ids": pa.array(ids, pa.list_(pa.int64())), "own": own})
    want = {n: {i for m in range(90) if (x[n] - x[m]) ** 2 + (y[n] - y[m]) ** 2 <= 64 for i in ids[m]} for n in np.flatnonzero(own)}
    for at_once, edges in ((1 << 16, 1 << 16), (50, 4), (1, 1)):
        monkeypatch.setattr(graphs, "AT_ONCE", at_once)
        monkeypatch.setattr(graphs, "EDGES", edges)
        rows = [row for batch in graphs._within(tile, 8.0) for row in batch.to_pylist()]
        got = {n: [i for row in rows if row["a"] == ids[n] for i in row["b"]] for n in want}
        assert {n: set(b) for n, b in got.items()} == want and all(len(got[n]) == len(want[n]) for n in want)
        assert sum(len(row["b"]) for row in rows) == sum(map(len, want.values())) and all(len(row["b"]) <= max(1, edges // len(row["a"])) for row in rows)
    assert not [*graphs._within(tile.set_column(3, "own", pa.array([False] * 90)), 8.0)]


def test_component_query_makes_no_edges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graphs, "radius_edges", None)
    events = pd.DataFrame({"event_id": range(400), "user_id": 1, "value": 1.0, "event_type": "a", "ts": pd.Timestamp("2024-01-01")})
    assert [tuple(r) for r in plans.graph_components(spark, saved(spark, tmp_path, events=events)).collect()] == [(0, 400)]


@pytest.mark.parametrize("shift", [0.0, float("inf"), float("nan")])
def test_quantiles_without_a_table_of_all_values(spark, monkeypatch, shift):
    """The numbers of percentile(), in rounds of counts; copies, wide ranges and infinite values included."""
    monkeypatch.setattr(prepare, "BUCKETS", 8)
    rng = np.random.default_rng(5)
    x = [*rng.normal(0, 1, 150), *([3.25] * 40), *(10 ** rng.uniform(-9, 9, 60)), 0.0 if shift == 0 else shift]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    shares = [0.0, 0.025, 1 / 3, 0.5, 0.9, 0.975]
    want = df.selectExpr(f"percentile(v, array({', '.join(f'{s:.17g}D' for s in shares)}))").first()[0]
    assert prepare.exact_quantiles(df, "v", shares) == want
    plan = prepare.breaks(df, "v", "quantile_regular")._jdf.queryExecution().toString()
    assert "percentile" not in plan
    assert prepare.exact_quantiles(df.limit(0), "v", shares) is None


def test_draws_are_held_by_observation(spark):
    """Rows of draws and arrays of draws give the same, and the arrays are neither exploded nor grouped again."""
    rng = np.random.default_rng(2)
    ll = rng.normal(-2, 0.7, (40, 100))
    ll[0] = -1.0
    arrays = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(ll)], "obs_id long, draws array<double>")
    rows = arrays.selectExpr("obs_id", "posexplode(draws) as (draw, ll)")
    for f, by in ((posterior.waic, "waic"), (posterior.psis_loo, "obs_id")):
        a, b = f(arrays).orderBy(by).collect(), f(rows).orderBy(by).collect()
        number = lambda r: [float("nan") if v is None else v for v in r]
        assert [number(r) for r in a] == [pytest.approx(number(r), rel=1e-9, nan_ok=True) for r in b]
    plan = posterior.waic(arrays)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1


def test_walks_are_dealt_and_stay_the_same(spark):
    """Individuals are dealt to tasks, however few files they come from, and walk as one drawn alone does."""
    gamma = spark.createDataFrame([(i, j, float(1 + (i * j) % 3)) for i in range(4) for j in range(4)], "i long, j long, w double")
    place = [(i, float(i), float(i % 2)) for i in range(4)]
    starts = spark.range(60).selectExpr("id as indiv", "id % 4 as unit_id").coalesce(1)
    walks = movement.trajectories(starts, gamma, spark.createDataFrame(place, "id long, cx double, cy double"), 6, persistence=0.7)
    assert "hashpartitioning(indiv" in walks._jdf.queryExecution().executedPlan().toString()
    got, at = {(r.indiv, r.step): r.unit_id for r in walks.collect()}, {i: np.array([x, y]) for i, x, y in place}
    weights = {i: np.array([float(1 + (i * j) % 3) for j in range(4)]) for i in range(4)}
    for indiv in range(60):
        rng, before, here = np.random.default_rng([42, indiv]), None, indiv % 4
        for step in range(7):
            assert got[indiv, step] == here
            w = weights[here]
            if before is not None:
                heading, ways = at[here] - at[before], np.array([at[j] - at[here] for j in range(4)])
                norm = np.linalg.norm(ways, axis=1) * np.linalg.norm(heading)
                w = w * np.exp(0.7 * np.divide(ways @ heading, norm, out=np.zeros(4), where=norm > 0))
            before, here = here, int(rng.choice(4, p=w / w.sum()))


def test_vectors_are_compared_in_parts(spark, monkeypatch):
    """Queries in several parts and blocks, with copies, against brute force."""
    monkeypatch.setattr(graphs, "QUERIES", 9)
    monkeypatch.setattr(graphs, "COMPARED", 4)
    rng = np.random.default_rng(4)
    v = np.vstack([rng.normal(1e3, 1, (150, 6)), np.repeat(rng.normal(1e3, 1, (5, 6)), 8, axis=0)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "id long, v array<double>")
    got = {(r.i, r.j, r["rank"]) for r in graphs.vector_knn(df.filter("id % 5 = 0"), df, 5).collect()}
    want = set()
    for i in range(0, len(v), 5):
        near = sorted((float(np.sqrt(((v[i] - v[j]) ** 2).cumsum()[-1])), j) for j in range(len(v)) if j != i)
        want |= {(i, j, r + 1) for r, (_, j) in enumerate(near[:5])}
    assert got == want


def test_every_vector_asks(spark, monkeypatch, tmp_path):
    """Every row of the table gets its neighbours, those without a vector or with values that are no numbers, and repeated ids, as in SQL."""
    monkeypatch.setattr(graphs, "QUERIES", 20)
    monkeypatch.setattr(graphs, "COMPARED", 7)
    rng = np.random.default_rng(7)
    v = [x.tolist() for x in np.vstack([rng.normal(0, 1, (60, 3)), np.repeat(rng.normal(0, 1, (3, 3)), 6, axis=0)])]
    v += [None, None, [np.nan, 0.0, 1.0], [np.inf, 0.0, 1.0], [np.inf, 1.0, 1.0], [-np.inf, np.nan, 0.0], [1e30, -1e30, 0.0]]
    ids = rng.permutation(len(v)).tolist()
    rows = list(zip([*ids, 2, 2, ids[-7], None], [*v, v[5], v[9], None, v[1]]))
    few = [(1, [0.0, 0.0]), (2, None), (3, [np.inf, 0.0]), (4, None), (5, [np.nan, 0.0]), (6, None), (7, [3.0, 4.0])]
    for name, table in (("many", rows), ("few", few), ("none", [(n, None) for n in range(9)]), ("one", [(1, [1.0])]), ("empty", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(table, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
        got = sorted((r.i, r["rank"], r.j) for r in plans.vector_neighbours(spark, folder).collect())
        con = duckdb.connect()
        con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
        assert got == sorted((i, rank, j) for i, j, rank in con.sql(plans.ORACLES["vector_neighbours"]).fetchall())
        assert {i for i, _, _ in got} == {i for i, _ in table if i is not None and len(table) > 1}


def test_places_are_drawn_by_density_without_stored_neighbours(spark, monkeypatch):
    """Each place's key has its mean distance to five others, by tiles and by the rest; of all places only the least keys and the open ones are written."""
    p = scattered(np.random.default_rng(5), 600)
    places = p[["x", "y"]].drop_duplicates()
    written = []
    keep = graphs.saved
    monkeypatch.setattr(graphs, "saved", lambda df: (lambda out: written.append((out.columns, out.count())) or out)(keep(df)))
    monkeypatch.setattr(graphs, "FEW", 20)
    monkeypatch.setattr(graphs, "CROWD", 900)
    monkeypatch.setattr(graphs, "nearest", None)
    means = []
    apart = graphs._mean_apart
    for number, (x, y) in enumerate(places.to_numpy()[:: len(places) // 20]):
        d = np.sort(np.hypot(places.x - x, places.y - y))[1:6]
        got = apart(np.array([x]), np.array([y]), places.x.to_numpy(), places.y.to_numpy(), 5)
        means.append((got[0][0], got[1][0], d.mean(), d.max()))
    for mean, far, want, furthest in means:
        assert mean == pytest.approx(want) and far == pytest.approx(furthest)
    df = spark.createDataFrame(p)
    got = partition.density_seeds(df, 12, 25.0)
    assert [k for k, _, _ in got] == list(range(1, 13)) and len(set(got)) == 12 and {(x, y) for _, x, y in got} <= set(map(tuple, places.to_numpy()))
    assert got == partition.density_seeds(df.repartition(7), 12, 25.0)
    assert not any(set(columns) & {"j", "d", "near"} for columns, _ in written)
    assert max(n for columns, n in written if "key" in columns) < len(places)
    # all are drawn where as many are asked for, whichever way they are settled
    assert {(x, y) for _, x, y in partition.density_seeds(df, len(places) + 5, 25.0)} == set(map(tuple, places.to_numpy()))
    # a cluster a thousand times as dense takes nearly all
    dense = sum(abs(x - 50) < 1 and abs(y - 50) < 1 for _, x, y in got)
    assert dense >= 10
