"""Basis functions of one variable as array columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def harmonic(t: Column, period: float, order: int) -> Column:
    """cos and sin of the first harmonics: [cos1, sin1, cos2, sin2, ...]."""
    parts = []
    for k in range(1, order + 1):
        angle = t * (2 * math.pi * k / period)
        parts += [F.cos(angle), F.sin(angle)]
    return F.array(*parts)


def hat(x: Column, knots: list[float]) -> Column:
    """Piecewise linear functions that are 1 at their knot and 0 at the others."""
    parts = []
    for i, k in enumerate(knots):
        value = F.when(x == k, 1.0)
        if i:
            value = value.when((x >= knots[i - 1]) & (x < k), (x - knots[i - 1]) / (k - knots[i - 1]))
        if i + 1 < len(knots):
            value = value.when((x > k) & (x <= knots[i + 1]), (knots[i + 1] - x) / (knots[i + 1] - k))
        parts.append(value.otherwise(0.0))
    return F.array(*parts)


def tps(x: Column, knots: list[float]) -> Column:
    """Thin-plate radial functions |x - k|^3."""
    return F.array(*[F.pow(F.abs(x - k), 3) for k in knots])


def tps_2d(x: Column, y: Column, knots: list[tuple[float, float]]) -> Column:
    """r^2 log r."""
    parts = []
    for a, b in knots:
        r2 = (x - a) * (x - a) + (y - b) * (y - b)
        parts.append(F.when(r2 > 0, 0.5 * r2 * F.log(r2)).otherwise(0.0))
    return F.array(*parts)


def fourier(x: Column, lengthscale: float, order: int) -> Column:
    return harmonic(x, lengthscale, order)


def rff(x: Column, frequencies: list[float], phases: list[float]) -> Column:
    """Random Fourier features sqrt(2/M) cos(w x + b)."""
    scale = math.sqrt(2 / len(frequencies))
    return F.array(*[scale * F.cos(w * x + b) for w, b in zip(frequencies, phases)])


def rff_parameters(n: int, lengthscale: float, seed: int = 42, nu: float | None = None) -> tuple[list[float], list[float]]:
    """Frequencies of a squared exponential kernel, or of a Matern one with smoothness nu."""
    rng = np.random.default_rng(seed)
    w = rng.standard_normal(n) if nu is None else rng.standard_t(2 * nu, n)
    return (w / lengthscale).tolist(), (rng.random(n) * 2 * math.pi).tolist()


def tensor(a: Column, b: Column) -> Column:
    """Outer product of two array columns, the second varying fastest."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def bspline(x: Column, interior: list[float], low: float, high: float, degree: int = 3) -> Column:
    """Cox-de Boor recursion with clamped ends, unrolled into expressions."""
    inner = sorted({low, high, *interior})
    t = [inner[0]] * degree + inner + [inner[-1]] * degree
    count = len(t) - degree - 1
    last = max(j for j in range(len(t) - 1) if t[j] < t[j + 1])
    b = [F.when((x >= t[j]) & ((x < t[j + 1]) | ((x == t[-1]) if j == last else F.lit(False))), 1.0).otherwise(0.0) if t[j] < t[j + 1] else F.lit(0.0) for j in range(len(t) - 1)]
    for d in range(1, degree + 1):
        b = [
            (b[j] * (x - t[j]) / (t[j + d] - t[j]) if t[j + d] - t[j] > 1e-9 else F.lit(0.0)) + (b[j + 1] * (t[j + d + 1] - x) / (t[j + d + 1] - t[j + 1]) if t[j + d + 1] - t[j + 1] > 1e-9 else F.lit(0.0))
            for j in range(len(b) - 1)
        ]
    return F.array(*b[:count])
