"""Scalar functions: numerics, links, recodes, kernels and names."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def mod1(x: Column, n: int) -> Column:
    """x modulo n within 1..n."""
    return F.pmod(x - 1, F.lit(n)) + 1


def logistic(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow on either side."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def logsumexp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def log1mexp(x: Column) -> Column:
    """log(1 - exp(x)) for x < 0."""
    return F.when(x > -math.log(2), F.log(-F.expm1(x))).otherwise(F.log1p(-F.exp(x)))


def log_difference(a: Column, b: Column) -> Column:
    """log(exp(a) - exp(b)) for a > b."""
    return a + log1mexp(b - a)


def softmax(x: Column) -> Column:
    """Of an array column."""
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, w: a + w))


def inverse_link(family: str, eta: Column, phi: Column | float = 0.0, zero_inflated: bool = False, trials: Column | float = 1) -> Column:
    """Mean from the linear predictor; log-link predictors are held within -20..20."""
    if family in ("poisson", "negbin", "gamma", "exponential", "lognormal", "inverse_gaussian", "pareto"):
        mean = F.exp(clamp(eta, -20.0, 20.0))
    elif family in ("bernoulli", "binomial"):
        mean = logistic(eta) * trials
    elif family == "beta":
        mean = logistic(eta)
    else:
        mean = eta
    return mean * (1 - phi) if zero_inflated else mean


def squared_distance(a: Column, b: Column) -> Column:
    """Between two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0).cast("double"), lambda s, v: s + v.cast("double"))


def poincare_distance(a: Column, b: Column, curvature: float = 1.0) -> Column:
    """Distance on the Poincare disk of two array columns."""
    norm = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    c = abs(curvature)
    ratio = 2 * c * squared_distance(a, b) / ((1 - c * norm(a)) * (1 - c * norm(b)))
    return F.acosh(1 + F.greatest(ratio, F.lit(0.0))) / math.sqrt(c)


def kernel(name: str, d: Column, lengthscale: float = 1.0, sigma: float = 1.0) -> Column:
    """Covariance at distance d."""
    s, v = d / lengthscale, sigma * sigma
    if name in ("se", "rbf", "gaussian"):
        return v * F.exp(-0.5 * s * s)
    if name == "matern12":
        return v * F.exp(-s)
    if name == "matern32":
        return v * (1 + math.sqrt(3) * s) * F.exp(-math.sqrt(3) * s)
    if name == "matern52":
        return v * (1 + math.sqrt(5) * s + 5 * s * s / 3) * F.exp(-math.sqrt(5) * s)
    if name == "spherical":
        return F.when(s < 1, v * (1 - 1.5 * s + 0.5 * s * s * s)).otherwise(0.0)
    if name == "cosine":
        return v * F.cos(2 * math.pi * s)
    if name == "constant":
        return F.lit(v)
    raise ValueError(f"unknown kernel {name}")


def cross_kernel(name: str, at: list[Column], inducing: list[tuple[float, ...]], lengthscales: float | list[float] = 1.0, sigma: float = 1.0) -> Column:
    """Covariances of a row's place with a bounded list of inducing points, as an array; a length-scale for each coordinate, or one for all."""
    scales = lengthscales if isinstance(lengthscales, list) else [lengthscales] * len(at)
    if len(scales) != len(at):
        raise ValueError("one length-scale for each coordinate")
    out = []
    for point in inducing:
        if name == "linear":
            out.append(sigma * sigma * sum((x * p for x, p in zip(at, point)), F.lit(0.0)))
        else:
            out.append(kernel(name, F.sqrt(sum((F.pow((x - p) / s, 2) for x, p, s in zip(at, point, scales)), F.lit(0.0))), 1.0, sigma))
    return F.array(*out)


def cleaned_parameter(name: Column) -> Column:
    """A chain's parameter name without its wrapper, prefix and leading colons."""
    name = F.regexp_replace(F.regexp_replace(name, r"^Parameter\((.*)\)$", "$1"), r"^parameters\.", "")
    return F.regexp_replace(name, "^:+", "")


def sanitised_name(name: Column) -> Column:
    """A column name from a formula term."""
    name = F.replace(F.replace(name, F.lit("⊗"), F.lit("_kron_")), F.lit("∘"), F.lit("_comp_"))
    return F.regexp_replace(F.regexp_replace(F.trim(name), r"[^\p{L}\p{N}_]+", "_"), r"_+", "_")


def base_name(parameter: Column) -> Column:
    return F.split_part(parameter, F.lit("["), F.lit(1))


def canonical_term(term: Column) -> Column:
    """Interaction names sorted and joined by &."""
    return F.array_join(F.array_sort(F.transform(F.split(term, r"[*&:]"), lambda x: F.trim(x))), "&")


def seasonal_month(day: Column) -> Column:
    """Month of a day of the year, half rounded to even."""
    return (F.bround(day / 365.0 * 12) + 1).cast("long")
