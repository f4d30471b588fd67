"""Synthetic tables, generated by partitions from seeded expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import logistic, mod1, seasonal_month


def panel(spark: SparkSession, units: int = 30, times: int = 12, seed: int = 42) -> DataFrame:
    """Space-time panel: s_idx, t_idx, year, month, s_x, s_y, three responses and covariates."""
    base = spark.range(units * times).select((F.col("id") % units + 1).alias("s_idx"), (F.floor(F.col("id") / units) + 1).alias("t_idx"))
    base = base.withColumns({"year": F.col("t_idx") + 2000, "month": mod1(F.col("t_idx"), 12), "s_x": F.rand(seed) * 10, "s_y": F.rand(seed + 1) * 10})
    eta = 0.5 + F.sin(F.col("s_x")) * 0.3 + F.cos(F.col("t_idx")) * 0.2
    base = base.withColumns({"cov1": F.randn(seed + 2), "cov2": F.rand(seed + 3), "cov3": (F.floor(F.rand(seed + 4) * 5) - 2).cast("long")})
    return base.withColumns({"y_gauss": eta + 0.1 * F.randn(seed + 5), "y_pois": F.floor(F.exp(eta + F.randn(seed + 6) * 0.5)).cast("long"), "y_bin": (F.rand(seed + 7) < logistic(eta)).cast("long")})


def areal_disease_panel(spark: SparkSession, districts: int = 56, years: int = 10, seed: int = 42) -> DataFrame:
    """District by year counts with offsets, rates, ordinal and categorical responses, covariates and groups."""
    regions = F.array(*map(F.lit, ("North", "South", "East", "West")))
    base = spark.range(districts * years).select((F.col("id") % districts + 1).alias("district"), (F.floor(F.col("id") / districts) + 1).alias("year"))
    base = base.withColumns({"s_idx": F.col("district"), "t_idx": F.col("year"), "log_offsets": F.log(F.rand(seed) * 20 + 1), "y": F.floor(F.abs(9 + 4 * F.randn(seed + 1))).cast("long")})
    base = base.withColumns({"counts": F.col("y"), "y_pois": F.col("y"), "y_rate": F.col("y") / F.exp("log_offsets"), "day": (F.floor(F.rand(seed + 2) * 365) + 1).cast("long")})
    base = base.withColumns({"month": seasonal_month(F.col("day")), "ordinal_y": F.when(F.col("y") == 0, 1).when(F.col("y") < 5, 2).otherwise(3).cast("long"), "region": F.get(regions, ((F.col("district") - 1) % 4).cast("int")), "f1": F.when(F.rand(seed + 3) < 0.5, "A").otherwise("B")})
    base = base.withColumns({"group": F.col("region"), "s_x": F.col("district") % 8 + F.rand(seed + 4), "s_y": F.floor(F.col("district") / 8) + F.rand(seed + 5), **{f"cov{k}": F.randn(seed + 10 + k) for k in range(1, 7)}})
    first = F.floor(F.rand(seed + 20) * 11).cast("long")
    base = base.withColumn("y_cat1", first)
    base = base.withColumn("y_cat2", F.floor(F.rand(seed + 21) * (21 - F.col("y_cat1"))).cast("long"))
    return base.withColumns({"y_cat3": 20 - F.col("y_cat1") - F.col("y_cat2"), "y_gauss": F.col("y_rate") + 0.1 * F.randn(seed + 22)})


def point_process(spark: SparkSession, side: int = 15, seed: int = 42) -> DataFrame:
    """Counts on a lattice."""
    cells = spark.range(side * side).select((F.col("id") + 1).alias("s_idx"), (F.col("id") % side + 1.0).alias("s_x"), (F.floor(F.col("id") / side) + 1.0).alias("s_y"))
    return cells.withColumns({"cell_area": F.lit(1.0), "counts": F.floor(F.exp(1 + 0.5 * F.randn(seed))).cast("long")})


def compositional(spark: SparkSession, units: int = 50, categories: int = 4, seed: int = 42) -> DataFrame:
    """cat_1..cat_K counts that add up to totals of 80 to 150."""
    df = spark.range(units).select((F.col("id") + 1).alias("s_idx"), (F.rand(seed) * 10).alias("s_x"), (F.rand(seed + 1) * 10).alias("s_y"), (F.floor(F.rand(seed + 2) * 71) + 80).cast("long").alias("left"))
    for k in range(1, categories):
        df = df.withColumn(f"cat_{k}", F.floor(F.rand(seed + 2 + k) * (F.col("left") + 1)).cast("long")).withColumn("left", F.col("left") - F.col(f"cat_{k}"))
    return df.withColumnRenamed("left", f"cat_{categories}")


def telemetry(spark: SparkSession, marks: int = 10, units: int = 20, seed: int = 42) -> DataFrame:
    """A release and a recapture row for each mark."""
    rows = spark.range(marks).select((F.col("id") + 1).alias("tagid"), F.explode(F.array(F.lit(0), F.lit(1))).cast("long").alias("tag"), F.rand(seed).alias("individual_covariate"))
    return rows.withColumns({"s_idx": (F.floor(F.rand(seed + 1) * units) + 1).cast("long"), "time": F.col("tag") * 5.0 + F.rand(seed + 2)})
