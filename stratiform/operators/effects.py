"""Forward maps of latent components: draws to effects, as joins, windows and small numpy solves."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _running(by: list[str], order: str) -> Window:
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def iid(draws: DataFrame, z: str, sigma: Column | float) -> DataFrame:
    return draws.withColumn("effect", F.col(z) * sigma)


def rw1(df: DataFrame, by: list[str], order: str, z: str) -> DataFrame:
    """Running sum of innovations."""
    return df.withColumn("effect", F.sum(z).over(_running(by, order)))


def rw2(df: DataFrame, by: list[str], order: str, z: str) -> DataFrame:
    """2 f[t-1] - f[t-2] + z[t]: the running sum of a running sum."""
    once = df.withColumn("__once", F.sum(z).over(_running(by, order)))
    return once.withColumn("effect", F.sum("__once").over(_running(by, order))).drop("__once")


def differences(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Add diff1 and diff2, the first and second differences along each series; null where a series has too few rows before."""
    w = Window.partitionBy(*by).orderBy(order)
    x, one, two = F.col(value), F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    return df.withColumns({"diff1": x - one, "diff2": x - 2 * one + two})


def _folded(df: DataFrame, by: list[str], order: str, columns: list[str], start: Column, step) -> DataFrame:
    """Fold a recursion over each group's rows in order, within one array; groups are one draw or unit long."""
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("rows"))
    folded = F.aggregate("rows", start, step)
    return rows.select(*by, F.explode(F.arrays_zip(F.col("rows"), folded["out"].alias("effect"))).alias("r")).select(*by, f"r.rows.{order}", *[f"r.rows.{c}" for c in columns], F.col("r.effect").alias("effect"))


def _state(*names: str) -> Column:
    return F.struct(*[F.lit(None).cast("double").alias(n) for n in names], F.array().cast("array<double>").alias("out"))


def ar1(df: DataFrame, by: list[str], order: str, z: str, rho: float, sigma: float = 1.0, eps: float = 1e-6) -> DataFrame:
    """First state z / sqrt(1 - rho^2 + eps), then rho * before + z, all times sigma."""

    def step(s, r):
        x = F.when(s["x"].isNull(), r[z] / math.sqrt(1 - rho * rho + eps)).otherwise(rho * s["x"] + r[z])
        return F.struct(x.alias("x"), F.concat(s["out"], F.array(x * sigma)).alias("out"))

    return _folded(df, by, order, [z], _state("x"), step)


def ar2(df: DataFrame, by: list[str], order: str, z: str, p1: float, p2: float, sigma: float = 1.0) -> DataFrame:
    """From partial autocorrelations: rho1 = p1 (1 - p2), rho2 = p2."""
    r1, r2 = p1 * (1 - p2), p2

    def step(s, r):
        x = r[z] + r1 * F.coalesce(s["x"], F.lit(0.0)) + r2 * F.coalesce(s["y"], F.lit(0.0))
        return F.struct(x.alias("x"), s["x"].alias("y"), F.concat(s["out"], F.array(x * sigma)).alias("out"))

    return _folded(df, by, order, [z], _state("x", "y"), step)


def tar(df: DataFrame, by: list[str], order: str, z: str, threshold_on: str, rho_low: float, rho_high: float, threshold: float, sigma: float = 1.0) -> DataFrame:
    """Two regimes of AR1; the second holds where the threshold variable lies strictly above its mean plus the parameter."""
    mean = Window.partitionBy(*by)
    df = df.withColumn("__high", F.when(F.col(threshold_on) > F.avg(threshold_on).over(mean) + threshold, rho_high).otherwise(rho_low))

    def step(s, r):
        x = r[z] + r["__high"] * F.coalesce(s["x"], F.lit(0.0))
        return F.struct(x.alias("x"), F.concat(s["out"], F.array(x * sigma)).alias("out"))

    return _folded(df, by, order, [z, "__high"], _state("x"), step).drop("__high")


def svar(df: DataFrame, unit: str, order: str, z: str, field: str, sigma: float = 1.0, eps: float = 1e-6) -> DataFrame:
    """AR1 for each unit with coefficient tanh(field)."""

    def step(s, r):
        rho = F.tanh(r[field])
        x = F.when(s["x"].isNull(), sigma * r[z] / F.sqrt(1 - rho * rho + eps)).otherwise(rho * s["x"] + sigma * r[z])
        return F.struct(x.alias("x"), F.concat(s["out"], F.array(x)).alias("out"))

    return _folded(df, [unit], order, [z, field], _state("x"), step)


def basis_effect(df: DataFrame, basis: Column, beta: list[float], sigma: float = 1.0) -> DataFrame:
    """Basis row times coefficients."""
    weights = F.array(*[F.lit(float(b) * sigma) for b in beta])
    return df.withColumn("effect", F.aggregate(F.zip_with(basis, weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))


def varying_coefficient(df: DataFrame, effects: DataFrame, index: str, covariate: str) -> DataFrame:
    """SVC or TVC: effect of the unit or time, times the covariate."""
    return df.join(effects, index).withColumn("effect", F.col("effect") * F.col(covariate))


def grouped_effect(df: DataFrame, effects: DataFrame, group: str, slope: str | None = None) -> DataFrame:
    """Random intercept (and slope) by group; the effects are a dimension table."""
    joined = df.join(effects, group)
    return joined.withColumn("effect", F.col("intercept") + (F.col("slope") * F.col(slope) if slope else F.lit(0.0)))


def spectral_map(edges: DataFrame, kind: str = "icar", **hyper: float) -> np.ndarray:
    """Matrix M with effect = M z for a small areal graph: eigenvectors of its Laplacian, scaled by kind.

    The number of areal units, not of observations, bounds what reaches the driver.
    """
    rows = edges.select("i", "j", "w").collect()
    n = max(max(r.i, r.j) for r in rows)
    q = np.zeros((n, n))
    for r in rows:
        q[r.i - 1, r.j - 1] -= r.w
        q[r.i - 1, r.i - 1] += r.w
    q = (q + q.T) / 2
    lam, u = np.linalg.eigh(q)
    lam = np.clip(lam, 0, None)
    if kind in ("icar", "besag", "cyclic", "rw1"):
        scale = np.where(np.arange(n) < 1, 0.0, 1 / np.sqrt(lam + 1e-6))
    elif kind == "rw2":
        scale = np.where(np.arange(n) < 2, 0.0, 1 / np.sqrt(lam + 1e-6))
    elif kind == "leroux":
        rho = hyper["rho"]
        scale = 1 / np.sqrt((1 - rho) + rho * lam + 1e-6)
    elif kind == "spde":
        scale = 1 / np.sqrt((hyper["kappa"] ** 2 + lam) ** 2 + 1e-6)
    elif kind == "sar":
        w = np.zeros((n, n))
        for r in rows:
            w[r.i - 1, r.j - 1] = r.w
        w /= np.maximum(w.sum(1, keepdims=True), 1e-12)
        return np.linalg.inv(np.eye(n) - hyper["rho"] * w)
    elif kind == "dag":
        w = np.zeros((n, n))
        for r in rows:
            w[r.i - 1, r.j - 1] = r.w
        return np.linalg.inv(np.eye(n) - hyper["rho"] * np.tril(w, -1))
    else:
        raise ValueError(f"unknown field {kind}")
    return u * scale


def field_effect(draws: DataFrame, matrix: np.ndarray, sigma: float = 1.0) -> DataFrame:
    """Effect of each unit for each draw from (draw, unit_id, z): one matrix product for each draw's group."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.zeros(matrix.shape[1])
        z[pdf["unit_id"].to_numpy() - 1] = pdf["z"].to_numpy()
        return pd.DataFrame({"draw": pdf["draw"].iloc[0], "unit_id": np.arange(1, len(matrix) + 1), "effect": sigma * (matrix @ z)})

    return draws.groupBy("draw").applyInPandas(one, "draw long, unit_id long, effect double")


def bym2(structured: DataFrame, rho: float, sigma: float) -> DataFrame:
    """sigma (sqrt(rho) structured + sqrt(1 - rho) unstructured), from columns `effect` and `z`."""
    return structured.withColumn("effect", sigma * (math.sqrt(rho) * F.col("effect") + math.sqrt(1 - rho) * F.col("z")))


def bym2_scale(edges: DataFrame, inverse: bool = False) -> float:
    """exp(-mean log of the non-null eigenvalues of D - W), or its reciprocal."""
    rows = edges.select("i", "j", "w").collect()
    n = max(max(r.i, r.j) for r in rows)
    q = np.zeros((n, n))
    for r in rows:
        q[r.i - 1, r.j - 1] -= r.w
        q[r.i - 1, r.i - 1] += r.w
    lam = np.linalg.eigvalsh((q + q.T) / 2)
    value = float(np.exp(-np.log(lam[lam > 1e-12]).mean()))
    return 1 / value if inverse else value


def marginal_iid(df: DataFrame, unit: str, residual: str, sigma: float, noise: float) -> DataFrame:
    """Gaussian log marginal likelihood of an iid effect from per-unit counts and sums: no matrix is built."""
    s2, n2 = sigma * sigma, noise * noise
    per = df.groupBy(unit).agg(F.count("*").alias("n"), F.sum(residual).alias("s"), F.sum(F.col(residual) * F.col(residual)).alias("q"))
    n = F.col("n").cast("double")
    term = -0.5 * (n * math.log(2 * math.pi * n2) + F.log1p(n * s2 / n2) + F.col("q") / n2 - F.col("s") * F.col("s") * s2 / (n2 * (n2 + n * s2)))
    return per.agg(F.sum(term).alias("log_marginal"))


def assembled(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Linear predictor: the sum of contributions (keys, effect) over all components."""
    out = parts[0].select(*keys, "effect")
    for part in parts[1:]:
        out = out.unionByName(part.select(*keys, "effect"))
    return out.groupBy(*keys).agg(F.sum("effect").alias("eta"))
