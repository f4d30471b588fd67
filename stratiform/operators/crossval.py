"""Cross-validation folds as columns, and train sets as filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, time: str) -> DataFrame:
    """Distinct times with their rank and number; a dimension table."""
    times = df.select(time).distinct()
    return times.withColumn("__rank", F.row_number().over(Window.orderBy(time))).withColumn("__n", F.count("*").over(Window.partitionBy()))


def temporal_blocks(df: DataFrame, time: str, folds: int) -> DataFrame:
    """ceil(T / folds) consecutive times make a fold."""
    fold = F.floor((F.col("__rank") - 1) / F.ceil(F.col("__n") / folds)) + 1
    return df.join(_ranked(df, time), time).withColumn("fold", fold.cast("long")).drop("__rank", "__n")


def forward_chain(df: DataFrame, time: str, folds: int) -> DataFrame:
    """The last `folds` times are test folds; null means train only. More folds than times less one is an error."""
    ranked = _ranked(df, time)
    if ranked.count() <= folds:
        raise ValueError("forward chaining needs more times than folds")
    fold = F.col("__rank") - (F.col("__n") - folds)
    return df.join(ranked, time).withColumn("fold", F.when(fold > 0, fold).cast("long")).drop("__rank", "__n")


def forward_train(df: DataFrame, time: str, fold: int) -> DataFrame:
    """Rows strictly earlier than the first time of a forward-chain fold."""
    first = df.filter(F.col("fold") == fold).agg(F.min(time).alias("__first"))
    return df.crossJoin(F.broadcast(first)).filter(F.col(time) < F.col("__first")).drop("__first")


def leave_one_location_out(df: DataFrame, location: str) -> DataFrame:
    """One fold for each location in order of its value."""
    places = df.select(location).distinct().withColumn("fold", F.row_number().over(Window.orderBy(location)).cast("long"))
    return df.join(places, location)


def kfold(df: DataFrame, key: str, folds: int, seed: int = 42) -> DataFrame:
    """Folds by a hash of the key: no sort, and the same fold in every run."""
    return df.withColumn("fold", (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds)) + 1).cast("long"))


def fold_scores(df: DataFrame, observed: str, group: str) -> DataFrame:
    """Held-out rmse of the group mean of the other folds, all folds in one pass: total less own sums is the train set."""
    cells = df.groupBy(group, "fold").agg(F.sum(observed).alias("s"), F.count("*").alias("n"))
    totals = cells.groupBy(group).agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    means = cells.join(totals, group).filter("tn > n").select(group, "fold", ((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("pred"))
    return df.join(means, [group, "fold"]).groupBy("fold").agg(F.sqrt(F.avg(F.pow(F.col(observed) - F.col("pred"), 2))).alias("rmse"), F.count("*").alias("n_test"))
