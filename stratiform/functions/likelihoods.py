"""Log-densities of observations as Column expressions, with censoring, hurdles and zero inflation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import clamp, log_difference, logistic, logsumexp

DISCRETE = ("poisson", "negbin", "binomial", "bernoulli")


def lgamma(x: Column | float) -> Column:
    """Log-gamma of a positive number, which Spark SQL lacks: Stirling's series ten steps up, and back by the recurrence."""
    x = (x if isinstance(x, Column) else F.lit(x)).cast("double")
    z = x + 10
    i = 1 / z
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + i * (1 / 12 - i * i * (1 / 360 - i * i * (1 / 1260 - i * i / 1680)))
    steps = x
    for k in range(1, 10):
        steps = steps * (x + k)
    return series - F.log(steps)


def log_factorial(y: Column) -> Column:
    return lgamma(y + 1)


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 26.2.17; absolute error below 7.5e-8."""
    # fixed values: the published coefficients
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def log_upper_tail(z: Column) -> Column:
    """log P(Z > z) of a standard normal. Far out by the continued fraction of Mills' ratio, so it never underflows."""
    z = z.cast("double")
    # a fold keeps the expression small; thirty nested quotients take minutes to plan
    fraction = F.aggregate(F.sequence(F.lit(30), F.lit(1)), z, lambda f, k: z + k / f)
    far = -0.5 * z * z - 0.5 * math.log(2 * math.pi) - F.log(fraction)
    return F.when(z > 2, far).otherwise(F.log(1 - normal_cdf(z)))


def log_probability(p: Column) -> Column:
    """log(p), minus infinity at 0."""
    return F.when(p > 0, F.log(p)).when(p == 0, -math.inf)


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow; -softplus(-eta) is the log of the logistic function."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def log_density(family: str, y: Column, eta: Column, sigma: Column | float = 1.0, extra: Column | float | None = None, trials: Column | float = 1) -> Column:
    """log p(y | eta). `extra` is shape, precision or degrees of freedom."""
    sigma = F.lit(sigma) if not isinstance(sigma, Column) else sigma
    shape = lambda default: F.lit(default if extra is None else extra) if not isinstance(extra, Column) else extra
    if family == "gaussian":
        s = sigma + 1e-9
        return -0.5 * F.pow((y - eta) / s, 2) - F.log(s) - 0.5 * math.log(2 * math.pi)
    if family == "lognormal":
        mu = eta - sigma * sigma / 2
        return -0.5 * F.pow((F.log(y) - mu) / sigma, 2) - F.log(sigma) - F.log(y) - 0.5 * math.log(2 * math.pi)
    if family == "poisson":
        mean = clamp(F.exp(clamp(eta, -30.0, 30.0)), 1e-9, 1e9)
        return y * F.log(mean) - mean - log_factorial(y)
    if family == "negbin":
        r, mean = shape(1.0), F.exp(clamp(eta, -30.0, 30.0))
        return lgamma(y + r) - lgamma(r) - log_factorial(y) + r * F.log(r / (r + mean)) + y * F.log(mean / (r + mean))
    if family in ("bernoulli", "binomial"):
        n = F.lit(trials) if not isinstance(trials, Column) else trials
        return log_factorial(n) - log_factorial(y) - log_factorial(n - y) - y * softplus(-eta) - (n - y) * softplus(eta)
    if family == "exponential":
        return -eta - y * F.exp(-eta)
    if family == "gamma":
        a = shape(1.0)
        scale = F.exp(eta) / a
        return (a - 1) * F.log(y) - y / scale - lgamma(a.cast("double")) - a * F.log(scale)
    if family == "beta":
        phi, mean = shape(10.0), logistic(eta)
        a, b = mean * phi, (1 - mean) * phi
        return lgamma(a + b) - lgamma(a) - lgamma(b) + (a - 1) * F.log(y) + (b - 1) * F.log(1 - y)
    if family == "inverse_gaussian":
        mean, lam = F.exp(eta), shape(1.0)
        return 0.5 * (F.log(lam) - math.log(2 * math.pi) - 3 * F.log(y)) - lam * F.pow(y - mean, 2) / (2 * mean * mean * y)
    if family == "student_t":
        nu = shape(5.0)
        z = (y - eta) / sigma
        return lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * F.log(nu * math.pi) - F.log(sigma) - (nu + 1) / 2 * F.log1p(z * z / nu)
    if family == "laplace":
        return -F.abs(y - eta) / sigma - F.log(2 * sigma)
    if family == "half_student_t":
        # twice the density of a t about 0; the predictor has no part in it
        nu = shape(5.0)
        full = log_density("student_t", y, F.lit(0.0), sigma, nu)
        return F.when(y >= 0, math.log(2) + full).otherwise(-math.inf)
    if family == "half_normal":
        return F.when(y >= 0, 0.5 * math.log(2 / math.pi) - F.log(sigma) - 0.5 * F.pow(y / sigma, 2)).otherwise(-math.inf)
    if family == "pareto":
        a = F.greatest(shape(1.1), F.lit(1.0 + 1e-9))
        scale = F.exp(eta) * (a - 1) / a
        return F.when(y >= scale, F.log(a) + a * F.log(scale) - (a + 1) * F.log(y)).otherwise(-math.inf)
    raise ValueError(f"family {family} is not supported")


def weighted(ll: Column, weight: Column | float) -> Column:
    """Log-density times the weight of its observation; without a weight it counts once, and weight 0 leaves it out whatever its density."""
    weight = F.coalesce(weight if isinstance(weight, Column) else F.lit(weight), F.lit(1.0))
    return F.when(weight == 0, 0.0).otherwise(weight * ll)


def dirichlet_multinomial(counts: list[Column], etas: list[Column], concentration: Column | float) -> Column:
    """log p of counts over categories whose probabilities are Dirichlet, with mean softmax(etas) and total `concentration`."""
    total = F.greatest(concentration if isinstance(concentration, Column) else F.lit(concentration), F.lit(1e-6))
    top = F.greatest(*etas)
    powers = [F.exp(e - top) for e in etas]
    alphas = [total * p / sum(powers[1:], powers[0]) for p in powers]
    n = sum(counts[1:], counts[0])
    out = log_factorial(n) + lgamma(total) - lgamma(n + total)
    for y, a in zip(counts, alphas):
        out = out + lgamma(y + a) - lgamma(a) - log_factorial(y)
    return out


def zero_inflated(family: str, y: Column, lp: Column, lp0: Column, phi: Column | float) -> Column:
    """Mixture with extra zeros of probability phi. A continuous family has no mass of its own at 0."""
    phi = F.lit(phi) if not isinstance(phi, Column) else phi
    at_zero = logsumexp(log_probability(phi), log_probability(1 - phi) + lp0) if family in DISCRETE else log_probability(phi)
    return F.when(y == 0, at_zero).otherwise(log_probability(1 - phi) + lp)


def hurdle(y: Column, lp: Column, log_above: Column, phi: Column | float, threshold: float = 0.0) -> Column:
    """Below or at the threshold with probability 1 - phi; above it the density given that it is above."""
    phi = F.lit(phi) if not isinstance(phi, Column) else phi
    return F.when(y <= threshold, log_probability(1 - phi)).otherwise(log_probability(phi) + lp - log_above)


def censoring_state(lower: Column, upper: Column) -> Column:
    """Only a lower bound is right-censored, only an upper one left-censored."""
    has_low, has_high = lower > -math.inf, upper < math.inf
    return F.when(has_low & has_high, "interval").when(has_low, "right").when(has_high, "left").otherwise("none")


def censored_gaussian(y: Column, eta: Column, sigma: Column | float, lower: Column, upper: Column) -> Column:
    s = (sigma if isinstance(sigma, Column) else F.lit(sigma)) + 1e-9
    a, b = (lower - eta) / s, (upper - eta) / s
    # an interval on one side of the mean is a difference of tails on that side
    interval = F.when(a > 0, log_difference(log_upper_tail(a), log_upper_tail(b))).when(b < 0, log_difference(log_upper_tail(-b), log_upper_tail(-a))).otherwise(F.log(normal_cdf(b) - normal_cdf(a)))
    state = censoring_state(lower, upper)
    return F.when(state == "interval", interval).when(state == "right", log_upper_tail(a)).when(state == "left", log_upper_tail(-b)).otherwise(log_density("gaussian", y, eta, sigma))


def ordinal_probability(category: Column, eta: Column, cuts: list[float]) -> Column:
    """Cumulative logit: P(category) from ordered cut-points; categories start at 1."""
    upto = lambda k: F.lit(1.0) if k > len(cuts) else F.lit(0.0) if k < 1 else logistic(F.lit(cuts[k - 1]) - eta)
    out = F.lit(None).cast("double")
    for k in range(1, len(cuts) + 2):
        out = F.when(category == k, upto(k) - upto(k - 1)).otherwise(out)
    return out
