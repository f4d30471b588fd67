"""Data products behind the figures, one table each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def posterior_predictive_check(df: DataFrame, observed: str, predicted: str, bins: int = 20) -> DataFrame:
    """Histogram of observed and predicted values over common bins."""
    both = df.select(F.explode(F.array(F.struct(F.lit("observed").alias("kind"), F.col(observed).cast("double").alias("v")), F.struct(F.lit("predicted").alias("kind"), F.col(predicted).cast("double").alias("v")))).alias("x")).select("x.*")
    ends = F.broadcast(both.agg(F.min("v").alias("a"), F.max("v").alias("b")))
    number = F.least(F.lit(bins), F.floor((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")) * bins) + 1)
    return both.crossJoin(ends).groupBy("kind", number.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def spatial_fit(df: DataFrame, unit: str, observed: str, predicted: str) -> DataFrame:
    """Observed, fitted and residual means for each unit."""
    return df.groupBy(unit).agg(F.avg(observed).alias("observed"), F.avg(predicted).alias("fitted"), F.avg(F.col(observed) - F.col(predicted)).alias("residual"))


def temporal(df: DataFrame, time: str, value: str, alpha: float = 0.05) -> DataFrame:
    """Mean and central interval at each time."""
    q = F.expr(f"percentile({value}, array({alpha / 2}D, {1 - alpha / 2}D))")
    return df.groupBy(time).agg(F.avg(value).alias("mean"), q.alias("q")).select(time, "mean", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))


def seasonal(df: DataFrame, month: str, value: str) -> DataFrame:
    return df.groupBy(month).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def trajectories(df: DataFrame, unit: str, time: str, value: str) -> DataFrame:
    """Unit by time means; a missing unit-time takes the unit's mean over all times."""
    cells = df.groupBy(unit, time).agg(F.avg(value).alias("m"))
    units = df.groupBy(unit).agg(F.avg(value).alias("overall"))
    times = F.broadcast(df.select(time).distinct())
    return units.crossJoin(times).join(cells, [unit, time], "left").select(unit, time, F.coalesce("m", "overall").alias("mean"), F.col("m").isNull().alias("filled"))


def fixed_effects(stats: DataFrame) -> DataFrame:
    return stats.filter(F.col("parameter").rlike("^beta|^intercept")).select("parameter", "mean", "lower", "upper")


def conditional_grid(df: DataFrame, target: str, points: int = 50) -> DataFrame:
    """Rows for a conditional effect: `target` over its range (or its levels) while every other column stays at a reference.

    The reference is the median of whole numbers, the mean of fractions and the first level of anything else.
    """
    kinds = dict(df.dtypes)
    whole = lambda c: kinds[c] in ("tinyint", "smallint", "int", "bigint")
    number = lambda c: whole(c) or kinds[c] in ("float", "double") or kinds[c].startswith("decimal")

    def reference(c: str):
        if whole(c):
            return F.bround(F.expr(f"percentile(`{c}`, 0.5D)")).cast(kinds[c]).alias(c)
        return (F.avg(c) if number(c) else F.min(c)).alias(c)

    rest = [c for c in df.columns if c != target]
    row = F.broadcast(df.agg(*map(reference, rest), F.min(target).alias("__low"), F.max(target).alias("__high")))
    if not number(target):
        return df.select(target).distinct().join(row).select(*df.columns)
    low, high = F.col("__low"), F.col("__high")
    if whole(target):
        step = F.greatest(F.lit(1), F.bround((high - low) / max(points - 1, 1))).cast("long")
        values = F.sequence(low.cast("long"), high.cast("long"), step)
    else:
        values = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: low + (high - low) * k / max(points - 1, 1))
    return row.withColumn(target, F.explode(values)).select(*df.columns)
