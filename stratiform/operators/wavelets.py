"""Wavelets on series as tables: the Haar transform by lifting, its inverse, and a basis of scaled and shifted wavelets."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROOT = math.sqrt(2.0)


def haar(series: DataFrame, by: list[str], index: str, value: str, levels: int) -> DataFrame:
    """by, level, k, s, d: Haar coefficients of each series, whose index runs from 0 without gaps; any length.

    A level is one aggregation by pairs of neighbours, on half the rows of the level before: no series is brought into one task. d is the
    detail of a pair at `level`; the rows of level `levels` also hold the smooth part s. A last value without a
    partner goes up as it is, with a null detail. Levels beyond the length of a series change nothing but the scale of the pair.
    """
    smooth = series.select(*by, F.col(index).cast("long").alias("k"), F.col(value).cast("double").alias("s"))
    out = None
    for level in range(1, levels + 1):
        even, odd = F.max(F.when(F.col("k") % 2 == 0, F.col("s"))), F.max(F.when(F.col("k") % 2 == 1, F.col("s")))
        pairs = smooth.groupBy(*by, F.floor(F.col("k") / 2).alias("k")).agg(even.alias("a"), odd.alias("b"))
        # predict the odd value by the even one, update the even one to the pair's mean, scale
        detail = F.col("b") - F.col("a")
        lifted = pairs.select(*by, "k", F.when(F.col("b").isNull(), F.col("a")).otherwise((F.col("a") + detail / 2) * ROOT).alias("s"), (detail / ROOT).alias("d"))
        rows = lifted.select(*by, F.lit(level).alias("level"), "k", (F.col("s") if level == levels else F.lit(None).cast("double")).alias("s"), "d")
        out = rows if out is None else out.unionByName(rows)
        smooth = lifted.select(*by, "k", "s")
    return out


def inverse_haar(coefficients: DataFrame, by: list[str], levels: int) -> DataFrame:
    """by, k, value: the series again, to rounding."""
    smooth = coefficients.filter(F.col("level") == levels).select(*by, "k", "s")
    for level in range(levels, 0, -1):
        details = coefficients.filter(F.col("level") == level).select(*by, "k", "d")
        mean = F.col("s") / ROOT
        half = F.col("d") * ROOT / 2
        pair = F.when(F.col("d").isNull(), F.array(F.col("s"))).otherwise(F.array(mean - half, mean + half))
        smooth = smooth.join(details, [*by, "k"]).select(*by, "k", F.posexplode(pair).alias("pos", "v")).select(*by, (F.col("k") * 2 + F.col("pos")).alias("k"), F.col("v").alias("s"))
    return smooth.withColumnRenamed("s", "value")


def filters(family: str) -> np.ndarray:
    """Scaling filter of the Haar wavelet (db1) or of the Daubechies wavelet of four taps (db2), by its formula."""
    if family in ("haar", "db1"):
        return np.array([1.0, 1.0]) / ROOT
    if family == "db2":
        r = math.sqrt(3.0)
        return np.array([1 + r, 3 + r, 3 - r, 1 - r]) / (4 * ROOT)
    raise ValueError(f"unknown wavelet {family}")


def mother_wavelet(family: str, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Grid on the support and the wavelet there, by the cascade from a box: phi(t) = sqrt(2) sum h_k phi(2t - k), psi likewise with the mirrored filter."""
    h = filters(family)
    size = len(h)
    g = np.array([(-1.0) ** k * h[size - 1 - k] for k in range(size)])
    grid = np.linspace(0.0, size - 1.0, max(2, 2**rounds * (size - 1) + 1))
    phi, psi = (grid < 1.0).astype(float), np.zeros(len(grid))
    for _ in range(rounds):
        # beyond the support there is nothing
        parts = [np.interp(2 * grid - k, grid, phi, left=0.0, right=0.0) for k in range(size)]
        phi, psi = (ROOT * sum(c * p for c, p in zip(f, parts)) for f in (h, g))
    return grid, psi


def interpolated(x: Column, grid: np.ndarray, values: np.ndarray) -> Column:
    """Values on an even grid, linear between its places, the end values beyond them; a JVM expression."""
    step, last = float(grid[1] - grid[0]), len(grid) - 1
    table = F.array(*[F.lit(float(v)) for v in values])
    at = F.greatest(F.lit(0.0), F.least(F.lit(float(last)), (x - float(grid[0])) / step))
    low = F.least(F.floor(at), F.lit(last - 1)).cast("int")
    return F.get(table, low) + (at - low) * (F.get(table, low + 1) - F.get(table, low))


def wavelet_basis(df: DataFrame, value: str, bins: int, family: str = "db2", lengthscale: float = 0.5, rounds: int = 6) -> DataFrame:
    """Add `basis`, an array of `bins` wavelets at scales lengthscale * 2^j of the range, centred at quantiles of the values.

    One aggregation gives the range and all centres (within 1 / 10000 of a rank); the rest is an expression per row.
    """
    scales = max(1, int(math.log2(bins / 4))) if bins >= 4 else 1
    counts = [bins // scales] * (scales - 1)
    counts.append(bins - sum(counts))
    shares = [[0.5] if n == 1 else [i / (n - 1) for i in range(n)] for n in counts]
    flat = ", ".join(f"{p:.17g}D" for own in shares for p in own)
    low, high, centres = df.agg(F.min(value), F.max(value), F.expr(f"percentile_approx(`{value}`, array({flat}), 10000)")).first()
    if low is None:
        return df.withColumn("basis", F.array().cast("array<double>"))
    span = high - low if high - low >= 1e-9 else 1.0
    widths = [lengthscale * 2.0**j * span for j, n in enumerate(counts) for _ in range(n)]
    grid, psi = mother_wavelet(family, rounds)
    # the centres and widths are zipped in the row, so that the wavelet's table stands in the plan once
    places = F.array(*[F.struct(F.lit(float(c)).alias("c"), F.lit(w).alias("w")) for c, w in zip(centres, widths)])
    return df.withColumn("basis", F.transform(places, lambda p: interpolated((F.col(value) - p["c"]) / p["w"], grid, psi)))
