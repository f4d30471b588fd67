"""Movement: transitions from telemetry, kernels, multi-step products, trajectories, population recursions."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graphs import multiply


def successive(df: DataFrame, tag: str, order: list[str], unit: str) -> DataFrame:
    """Each event with the unit and time of the tag's next one; the last of a tag has none."""
    w = Window.partitionBy(tag).orderBy(*order)
    return df.withColumn("next_unit", F.lead(unit).over(w)).withColumn("next_time", F.lead(order[0]).over(w)).filter("next_unit is not null")


def advection_ratio(units: DataFrame, advection: str, diffusion: str) -> DataFrame:
    """Add `ratio`, advection over the mean diffusion of all units (a Peclet number), and whether advection prevails."""
    mean = F.broadcast(units.agg((F.avg(diffusion) + 1e-6).alias("__mean")))
    found = units.join(mean).withColumn("ratio", F.col(advection) / F.col("__mean")).drop("__mean")
    return found.withColumn("advective", F.col("ratio") > 1)


def transition_counts(steps: DataFrame, unit: str) -> DataFrame:
    return steps.groupBy(F.col(unit).alias("i"), F.col("next_unit").alias("j")).agg(F.count("*").cast("double").alias("w"))


def row_normalised(edges: DataFrame) -> DataFrame:
    """Each row divided by its sum where that is positive."""
    sums = edges.groupBy("i").agg(F.sum("w").alias("__sum")).filter("__sum > 0")
    return edges.join(sums, "i").withColumn("w", F.col("w") / F.col("__sum")).drop("__sum")


def multistep(gamma: DataFrame, steps: int) -> DataFrame:
    """Gamma to the power `steps`, rows renormalised each time; the kernel has units, not observations, for rows."""
    out = gamma
    for _ in range(steps - 1):
        out = row_normalised(multiply(out, gamma))
    return out


def suitability_kernel(suitability: DataFrame, edges: DataFrame, sensitivity: float = 1.0, diffusion: float = 0.1) -> DataFrame:
    """Stay with exp(b s_i), move with (exp(b s_j) + D) w, rows normalised."""
    e = F.exp(sensitivity * F.col("s"))
    stay = suitability.select(F.col("id").alias("i"), F.col("id").alias("j"), e.alias("w"))
    target = suitability.select(F.col("id").alias("j"), e.alias("e"))
    move = edges.filter("i != j").join(target, "j").select("i", "j", ((F.col("e") + diffusion) * F.col("w")).alias("w"))
    return row_normalised(stay.unionByName(move))


def regional(gamma: DataFrame, strata: DataFrame) -> DataFrame:
    """Kernel summed by (stratum_i, stratum_j) and row-normalised; strata is (id, stratum)."""
    a = strata.select(F.col("id").alias("i"), F.col("stratum").alias("si"))
    b = strata.select(F.col("id").alias("j"), F.col("stratum").alias("sj"))
    return row_normalised(gamma.join(a, "i").join(b, "j").groupBy(F.col("si").alias("i"), F.col("sj").alias("j")).agg(F.sum("w").alias("w")))


def velocity(grid: DataFrame, strength: float, exponential: bool = True) -> DataFrame:
    """Central differences of (r, c, p), one-sided at the borders."""

    def slope(along: str, across: str):
        w = Window.partitionBy(across).orderBy(along)
        before, after = F.lag("p").over(w), F.lead("p").over(w)
        return F.when(before.isNull(), after - F.col("p")).when(after.isNull(), F.col("p") - before).otherwise((after - before) / 2)

    scale = strength / F.greatest(F.col("p"), F.lit(1e-6)) if exponential else F.lit(strength)
    return grid.withColumn("gx", slope("c", "r")).withColumn("gy", slope("r", "c")).select("r", "c", (F.col("gx") * scale).alias("vx"), (F.col("gy") * scale).alias("vy"))


def correlated_density(base: DataFrame, column: str, correlation: float, seed: int = 42) -> DataFrame:
    """A density with the given correlation to the z-score of a column."""
    from .prepare import transformed

    z = transformed(base, column, "zscore", "__z")
    return z.withColumn("density", F.exp(correlation * F.col("__z") + (1 - correlation**2) ** 0.5 * F.randn(seed))).drop("__z")


def trajectories(starts: DataFrame, gamma: DataFrame, centroids: DataFrame, steps: int, persistence: float = 0.0, seed: int = 42) -> DataFrame:
    """indiv, step, unit_id: walks over the kernel, each move weighted by exp(rho cos of the turn).

    Every task walks its own individuals; the kernel over areal units is broadcast to it.
    """
    place = {r.id: (r.cx, r.cy) for r in centroids.collect()}
    kernel: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i, rows in pd.DataFrame([tuple(r) for r in gamma.select("i", "j", "w").collect()], columns=["i", "j", "w"]).groupby("i"):
        kernel[i] = rows["j"].to_numpy(), rows["w"].to_numpy()

    def moves(before: int | None, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Next units and their cumulative shares, as Generator.choice adds them up."""
        j, w = kernel.get(at, (np.array([at]), np.array([1.0])))
        if persistence and before in place and at in place:
            heading = np.subtract(place[at], place[before])
            ways = np.array([np.subtract(place.get(k, place[at]), place[at]) for k in j])
            norm = np.linalg.norm(ways, axis=1) * np.linalg.norm(heading)
            cos = np.divide(ways @ heading, norm, out=np.zeros(len(j)), where=norm > 0)
            w = w * np.exp(persistence * cos)
        total = (w / w.sum()).cumsum()
        return j, total / total[-1]

    def walk(batches):
        known = lru_cache(maxsize=1 << 14)(moves)
        for pdf in batches:
            start = pdf["unit_id"].to_numpy()
            draws = np.array([np.random.default_rng([seed, int(i)]).random(steps) for i in pdf["indiv"]]).reshape(len(pdf), steps)
            before, at, path = None, start, [start]
            for step in range(steps):
                # all individuals that made the same move share its shares
                turns = pd.DataFrame({"before": at if before is None else before, "at": at})
                after = np.empty(len(at), np.int64)
                for (b, a), rows in turns.groupby(["before", "at"], sort=False).indices.items():
                    j, total = known(None if before is None else int(b), int(a))
                    after[rows] = j[total.searchsorted(draws[rows, step], side="right")]
                before, at = at, after
                path.append(at)
            yield pd.DataFrame({"indiv": np.repeat(pdf["indiv"].to_numpy(), steps + 1), "step": np.tile(np.arange(steps + 1), len(pdf)), "unit_id": np.stack(path, axis=1).ravel()})

    # a file of individuals is small beside the work that their walks are
    return starts.select("indiv", "unit_id").repartition("indiv").mapInPandas(walk, "indiv long, step long, unit_id long")


def population(units: DataFrame, times: int, model: str = "logistic", **p: float) -> DataFrame:
    """unit_id, t, n: a recursion for each unit (unit_id, n0, k, r) as a fold over the time sequence, without Python.

    logistic: n + r n (1 - n / k); gompertz: n + r n (1 - log n / log k); delay_difference: survival and lagged recruitment.
    """
    step = {
        "logistic": lambda s: s["n"] + F.col("r") * s["n"] * (1 - s["n"] / F.col("k")),
        "gompertz": lambda s: s["n"] + F.col("r") * s["n"] * (1 - F.log(s["n"]) / F.log(F.col("k"))),
        "delay_difference": lambda s: p.get("survival", 0.7) * s["n"] + F.col("r") * s["before"] / (1 + s["before"] / F.col("k")),
    }[model]

    def fold(s, _):
        n = F.greatest(step(s) * (1 - p.get("harvest", 0.0)), F.lit(1e-6))
        return F.struct(n.alias("n"), s["n"].alias("before"), F.concat(s["out"], F.array(n)).alias("out"))

    n0 = F.col("n0").cast("double")
    start = F.struct(n0.alias("n"), n0.alias("before"), F.array(n0).alias("out"))
    series = F.aggregate(F.sequence(F.lit(2), F.lit(times)) if times > 1 else F.array().cast("array<int>"), start, fold)
    return units.select("unit_id", F.posexplode(series["out"]).alias("pos", "n")).select("unit_id", (F.col("pos") + 1).cast("long").alias("t"), "n")


def lotka_volterra(units: DataFrame, times: int, a: float = 0.6, b: float = 0.02, c: float = 0.4, d: float = 0.01, dt: float = 0.1) -> DataFrame:
    """unit_id, t, prey, predator."""

    def fold(s, _):
        x = F.greatest(s["x"] + dt * (a * s["x"] - b * s["x"] * s["y"]), F.lit(1e-6))
        y = F.greatest(s["y"] + dt * (d * s["x"] * s["y"] - c * s["y"]), F.lit(1e-6))
        return F.struct(x.alias("x"), y.alias("y"), F.concat(s["out"], F.array(F.struct(x.alias("prey"), y.alias("predator")))).alias("out"))

    x, y = F.col("prey0").cast("double"), F.col("predator0").cast("double")
    start = F.struct(x.alias("x"), y.alias("y"), F.array(F.struct(x.alias("prey"), y.alias("predator"))).alias("out"))
    series = F.aggregate(F.sequence(F.lit(2), F.lit(times)), start, fold)
    return units.select("unit_id", F.posexplode(series["out"]).alias("pos", "s")).select("unit_id", (F.col("pos") + 1).cast("long").alias("t"), "s.prey", "s.predator")


def leslie(units: DataFrame, matrix: list[list[float]], times: int) -> DataFrame:
    """unit_id, t, age, n from (unit_id, ages array): age classes times the projection matrix each step."""
    rows = F.array(*[F.array(*map(F.lit, map(float, r))) for r in matrix])

    def fold(s, _):
        n = F.transform(rows, lambda r: F.aggregate(F.zip_with(r, s["n"], lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v))
        return F.struct(n.alias("n"), F.concat(s["out"], F.array(n)).alias("out"))

    ages = F.col("ages").cast("array<double>")
    series = F.aggregate(F.sequence(F.lit(2), F.lit(times)), F.struct(ages.alias("n"), F.array(ages).alias("out")), fold)
    by_time = units.select("unit_id", F.posexplode(series["out"]).alias("t", "n"))
    return by_time.select("unit_id", (F.col("t") + 1).cast("long").alias("t"), F.posexplode("n").alias("age", "n")).select("unit_id", "t", (F.col("age") + 1).cast("long").alias("age"), "n")
