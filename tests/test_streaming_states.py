"""AR(1) states of a stream against the recursion, for several ways of cutting the input into micro-batches."""

import random

import pytest

from stratiform.streaming import live


def recursion(z, rho, sigma):
    x, out = 0.0, []
    for k, v in enumerate(z):
        x = sigma * v / (1 - rho * rho + 1e-6) ** 0.5 if k == 0 else rho * x + sigma * v
        out.append(x)
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_states_do_not_depend_on_batches(spark, tmp_path, seed):
    """Rows in any order over several files, repeated, late and before the first period; a unit with a gap holds what follows it."""
    rng = random.Random(seed)
    z = {u: [rng.gauss(0, 1) for _ in range(12)] for u in (1, 2, 3)}
    rows = [(u, t + 1, v) for u, own in z.items() for t, v in enumerate(own) if (u, t) != (3, 5)]
    rows += [(1, 0, 9.0), (1, -4, 9.0)]
    rng.shuffle(rows)
    rows += [(2, 3, z[2][2])]
    cuts = sorted(rng.sample(range(1, len(rows)), 3 if seed else 1))
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        spark.createDataFrame(rows[a:b], "unit long, t long, z double").coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    stream = spark.readStream.schema("unit long, t long, z double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = live.ar1_states(stream, 0.7, 0.5).writeStream.format("memory").queryName(f"ar1_{seed}").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").start()
    query.processAllAvailable()
    query.stop()
    found = sorted((r.unit, r.t, r.x) for r in spark.table(f"ar1_{seed}").collect())
    want = [(u, t + 1, x) for u, own in z.items() for t, x in enumerate(recursion(own, 0.7, 0.5)) if u != 3 or t < 5]
    assert [f[:2] for f in found] == [w[:2] for w in want]
    assert [f[2] for f in found] == pytest.approx([w[2] for w in want])
