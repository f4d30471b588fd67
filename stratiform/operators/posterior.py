"""Posterior draws in long form (chain, iteration, parameter, value): summaries, diagnostics and model weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def summary(draws: DataFrame, by: list[str], value: str = "value", alpha: float = 0.05) -> DataFrame:
    """mean, median, sd and the central interval over draws."""
    q = F.expr(f"percentile({value}, array({alpha / 2}D, 0.5D, {1 - alpha / 2}D))")
    found = draws.filter(finite(F.col(value))).groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), q.alias("q"))
    return found.select(*by, "mean", F.col("q")[1].alias("median"), "sd", F.col("q")[0].alias("lower"), F.col("q")[2].alias("upper"))


def equal_chains(draws: DataFrame) -> DataFrame:
    """The draws of each parameter's chains up to the length of its shortest chain."""
    chain = Window.partitionBy("parameter", "chain")
    placed = draws.withColumn("__pos", F.row_number().over(chain.orderBy("iteration")))
    least = draws.groupBy("parameter", "chain").agg(F.count("*").alias("n")).groupBy("parameter").agg(F.min("n").alias("__least"))
    return placed.join(least, "parameter").filter("__pos <= __least").drop("__pos", "__least")


def rhat(draws: DataFrame) -> DataFrame:
    """Between-chain R-hat: two or more chains of equal length, four draws each at least; held within 1..10."""
    chains = draws.filter(finite(F.col("value"))).groupBy("parameter", "chain").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    per = chains.groupBy("parameter").agg(F.count("*").alias("chains"), F.min("n").alias("n"), F.max("n").alias("most"), F.var_samp("m").alias("vm"), F.avg("v").alias("w"))
    n = F.col("n").cast("double")
    value = F.sqrt(((n - 1) / n * F.col("w") + F.col("vm")) / F.col("w"))
    good = (F.col("chains") >= 2) & (F.col("n") == F.col("most")) & (F.col("n") >= 4) & (F.col("w") > 1e-12)
    return per.filter(good).select("parameter", F.greatest(F.lit(1.0), F.least(F.lit(10.0), value)).alias("rhat"))


def split_rhat(draws: DataFrame) -> DataFrame:
    """One chain cut in halves; an odd last draw is left out; twenty draws at least."""
    sized = draws.filter(finite(F.col("value"))).join(draws.filter(finite(F.col("value"))).groupBy("parameter").agg(F.count("*").alias("total")), "parameter")
    half = F.floor(F.col("total") / 2)
    halves = sized.filter((F.col("total") >= 20) & (F.col("iteration") <= 2 * half)).withColumn("chain", F.when(F.col("iteration") <= half, 1).otherwise(2))
    return rhat(halves.select("parameter", "chain", "iteration", "value"))


def ess(draws: DataFrame) -> DataFrame:
    """n (1 - r1) / (1 + r1) with the lag-1 autocorrelation over the pooled order; held within 1..n; ten draws at least."""
    order = Window.partitionBy("parameter").orderBy("chain", "iteration")
    pooled = draws.filter(finite(F.col("value"))).withColumn("before", F.lag("value").over(order))
    means = draws.filter(finite(F.col("value"))).groupBy("parameter").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    c, b = F.col("value") - F.col("m"), F.col("before") - F.col("m")
    per = pooled.join(means, "parameter").groupBy("parameter", "n").agg(F.sum(c * b).alias("top"), F.sum(c * c).alias("bottom"))
    r1 = F.col("top") / F.col("bottom")
    n = F.col("n").cast("double")
    return per.filter("n >= 10 and bottom > 0").select("parameter", F.greatest(F.lit(1.0), F.least(n, n * (1 - r1) / (1 + r1))).alias("ess"))


def diagnostics(stats: DataFrame) -> DataFrame:
    """One row from parameter rows with rhat and ess: the mean of usable R-hat (1 without any) and the least usable ESS (0 without any)."""
    rhats = F.when(finite(F.col("rhat")) & (F.col("rhat") > 0), F.col("rhat"))
    sizes = F.when(finite(F.col("ess")) & (F.col("ess") >= 0), F.col("ess"))
    return stats.agg(F.coalesce(F.avg(rhats), F.lit(1.0)).alias("mean_rhat"), F.coalesce(F.min(sizes), F.lit(0.0)).alias("min_ess"))


def by_observation(loglik: DataFrame) -> DataFrame:
    """obs_id, draws: an observation's log-likelihoods as an array, from rows (obs_id, draw, ll) or from a table that has the arrays already."""
    if "draws" in loglik.columns:
        return loglik.select("obs_id", F.filter("draws", lambda ll: ll.isNotNull()).alias("draws")).filter(F.size("draws") > 0)
    return loglik.filter("ll is not null").groupBy("obs_id").agg(F.collect_list("ll").alias("draws"))


def waic(loglik: DataFrame) -> DataFrame:
    """One row from (obs_id, draw, ll), or (obs_id, draws): -2 sum of log mean likelihood less the variance of ll.

    Where a row holds an observation's draws, nothing is shuffled and a task holds one observation at a time.
    """
    if "draws" in loglik.columns:
        ll, sums = F.col("draws"), lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))
        sized = by_observation(loglik).withColumns({"top": F.array_max(ll), "n": F.size(ll).cast("double"), "mean": sums(ll, lambda x: x) / F.size(ll)})
        per = sized.select("top", F.col("n").alias("draws"), sums(ll, lambda x: F.exp(x - F.col("top"))).alias("s"), F.when(F.col("n") > 1, sums(ll, lambda x: F.pow(x - F.col("mean"), 2)) / (F.col("n") - 1)).alias("v"))
    else:
        # the window and the grouping share one shuffle by observation
        topped = loglik.select("obs_id", "ll", F.max("ll").over(Window.partitionBy("obs_id")).alias("top"))
        per = topped.groupBy("obs_id").agg(F.first("top").alias("top"), F.sum(F.exp(F.col("ll") - F.col("top"))).alias("s"), F.count("*").alias("draws"), F.var_samp("ll").alias("v"))
    lppd = F.col("top") + F.log("s") - F.log(F.col("draws").cast("double"))
    return per.agg((-2 * F.sum(lppd - F.col("v"))).alias("waic"), F.sum("v").alias("p_waic"), F.sum(lppd).alias("lppd"))


def model_weights(models: DataFrame) -> DataFrame:
    """delta_waic and bma_weight from (model_name, waic); a model without WAIC has weight 0, and all are equal when all are 0."""
    everything = Window.partitionBy()
    usable = finite(F.col("waic"))
    delta = F.when(usable, F.col("waic") - F.min(F.when(usable, F.col("waic"))).over(everything))
    raw = F.coalesce(F.exp(-delta / 2), F.lit(0.0))
    weighed = models.withColumn("delta_waic", delta).withColumn("__raw", raw)
    total = F.sum("__raw").over(everything)
    return weighed.withColumn("bma_weight", F.when(total > 0, F.col("__raw") / total).otherwise(1 / F.count("*").over(everything))).drop("__raw")


def bma_predictions(predictions: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean of (model_name, obs_id, pred_mean) and the between-model sd."""
    joined = predictions.join(F.broadcast(weights.select("model_name", "bma_weight")), "model_name")
    # one entry for each model, so the list is short; the sd is taken about the mean, for a difference of squares cancels
    models = joined.groupBy("obs_id").agg(F.collect_list(F.struct(F.col("bma_weight").alias("w"), F.col("pred_mean").alias("m"))).alias("models"))
    total = lambda value: F.aggregate("models", F.lit(0.0), lambda s, x: s + x["w"] * value(x["m"]))
    means = models.withColumn("__w", total(lambda m: F.lit(1.0))).withColumn("bma_mean", total(lambda m: m) / F.col("__w"))
    return means.select("obs_id", "bma_mean", F.sqrt(total(lambda m: F.pow(m - F.col("bma_mean"), 2)) / F.col("__w")).alias("bma_sd"))


def priors(stats: DataFrame) -> DataFrame:
    """Normal priors from parameter_stats; a parameter of scale is truncated at 0."""
    scale = F.lower("parameter").rlike("sigma|kappa|tau|lengthscale|phi")
    return stats.select("parameter", F.lit("Normal").alias("family"), F.col("mean").alias("mu"), F.greatest("sd", F.lit(1e-4)).alias("sigma"), F.when(scale, 0.0).alias("lower"))


def post_stratification(predictions: DataFrame, stratum: str = "s_idx", value: str = "pred", draw: str = "draw") -> DataFrame:
    """Stratum mean over own prediction, per draw."""
    means = predictions.groupBy(stratum, draw).agg(F.avg(value).alias("__mean"))
    return predictions.join(means, [stratum, draw]).withColumn("ps_weight", F.col("__mean") / (F.col(value) + 1e-9)).drop("__mean")


def fit_metrics(df: DataFrame, observed: str, predicted: str) -> DataFrame:
    """rmse, pearson r and r2; rows without an observation are left out."""
    rows = df.filter(finite(F.col(observed)) & finite(F.col(predicted)))
    y, p = F.col(observed), F.col(predicted)
    found = rows.agg(F.avg(F.pow(y - p, 2)).alias("mse"), F.coalesce(F.corr(y, p), F.lit(0.0)).alias("pearson_r"), F.sum(F.pow(y - p, 2)).alias("res"), (F.var_pop(y) * F.count("*")).alias("tot"))
    return found.select(F.sqrt("mse").alias("rmse"), "pearson_r", (1 - F.col("res") / (F.col("tot") + 1e-15)).alias("r2"))


def unit_metrics(counts: DataFrame, value: str) -> DataFrame:
    """mean, sd, coefficient of variation, min and max over units."""
    x = F.col(value).cast("double")
    return counts.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), (F.stddev_samp(x) / (F.avg(x) + 1e-9)).alias("cv"), F.min(x).alias("min"), F.max(x).alias("max"))


def standardised_rate(df: DataFrame, unit: str, y: str, log_offset: str) -> DataFrame:
    """Sum of counts over the sum of exposure, per unit."""
    return df.groupBy(unit).agg((F.sum(y) / F.greatest(F.sum(F.exp(log_offset)), F.lit(1e-12))).alias("rate"))


def psis_loo(loglik: DataFrame) -> DataFrame:
    """obs_id, elpd, pareto_k from (obs_id, draw, ll), or (obs_id, draws); a generalised Pareto tail is fitted for each observation.

    Observations of a batch with as many draws are fitted together, as rows of a matrix.
    """
    import numpy as np
    import pandas as pd

    def fitted(ll: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lw = -ll - (-ll).max(axis=1, keepdims=True)
        rows, n = lw.shape
        k, tail = np.full(rows, np.nan), int(min(0.2 * n, 3 * np.sqrt(n)))
        if tail >= 5:
            order = np.argsort(lw, axis=1)
            cut = np.take_along_axis(lw, order[:, -tail - 1 : -tail], 1)
            x = np.exp(np.take_along_axis(lw, order[:, -tail:], 1)) - np.exp(cut)
            fit = np.flatnonzero(x.max(axis=1) > 0)
            x, m = x[fit], 30 + int(np.sqrt(tail))
            theta = 1 / x[:, -1:] + (1 - np.sqrt(m / (np.arange(1, m + 1) - 0.5))) / (3 * x[:, [max(int(tail / 4 + 0.5) - 1, 0)]] + 1e-300)
            ks = np.stack([np.log1p(-theta[:, [i]] * x).mean(axis=1) for i in range(m)], axis=1)
            score = tail * (np.log(-theta / ks) - ks - 1)
            weights = np.exp(score - score.max(axis=1, keepdims=True))
            t = (theta * weights).sum(axis=1) / weights.sum(axis=1)
            shape = np.log1p(-t[:, None] * x).mean(axis=1)
            sigma = (-shape / t)[:, None]
            shape = (shape * tail + 5) / (tail + 10)
            p, s = (np.arange(1, tail + 1) - 0.5) / tail, shape[:, None]
            smooth = np.where(np.abs(s) > 1e-12, sigma * np.expm1(-s * np.log1p(-p)) / np.where(s == 0, 1, s), -sigma * np.log1p(-p))
            lw[fit[:, None], order[fit, -tail:]] = np.minimum(np.log(np.exp(cut[fit]) + smooth), 0.0)
            k[fit] = shape
        top, most = (lw + ll).max(axis=1, keepdims=True), lw.max(axis=1, keepdims=True)
        elpd = top[:, 0] + np.log(np.exp(lw + ll - top).sum(axis=1)) - (most[:, 0] + np.log(np.exp(lw - most).sum(axis=1)))
        return elpd, k

    def run(batches):
        for batch in batches:
            draws = batch["draws"].to_numpy()
            sizes = np.array([len(ll) for ll in draws])
            elpd, k = np.empty(len(draws)), np.empty(len(draws))
            for n in np.unique(sizes):
                same = np.flatnonzero(sizes == n)
                step = max(1, 200_000 // n)
                for part in (same[i : i + step] for i in range(0, len(same), step)):
                    with np.errstate(all="ignore"):
                        elpd[part], k[part] = fitted(np.stack(draws[part]).astype(float))
            yield pd.DataFrame({"obs_id": batch["obs_id"], "elpd": elpd, "pareto_k": k})

    return by_observation(loglik).mapInPandas(run, "obs_id long, elpd double, pareto_k double")


def compare_models(metrics: DataFrame) -> DataFrame:
    """(model_name, metric, value) with each value's distance to the best: the largest elpd and r2, the smallest of the rest."""
    all_of = Window.partitionBy("metric")
    high = F.lower("metric").rlike("elpd|r2|pearson")
    best = F.when(high, F.max("value").over(all_of)).otherwise(F.min("value").over(all_of))
    delta = F.when(high, best - F.col("value")).otherwise(F.col("value") - best)
    return metrics.withColumn("delta", delta).withColumn("clearly_worse", F.lower("metric").rlike("elpd") & (F.col("delta") > 4))
