"""Result store: normalised tables with an optional prefix, ad-hoc SQL over them, bundles and exports."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry

#: Tables of a result, see README.
TABLES = ("model_metadata", "metrics", "parameter_stats", "predictions", "spatial_geometries", "posterior_samples", "models_registry", "out_of_sample_predictions")


class ResultStore:
    """Parquet tables under one path. Missing tables are tolerated; empty frames are not written."""

    def __init__(self, spark: SparkSession, path: str, prefix: str = ""):
        self.spark, self.path = spark, path.rstrip("/")
        self.prefix = f"{prefix.rstrip('_')}_" if prefix else ""

    def _at(self, name: str) -> str:
        return f"{self.path}/{self.prefix}{name}"

    def write(self, name: str, df: DataFrame, overwrite: bool = True) -> None:
        if df.isEmpty():
            return
        df.write.mode("overwrite" if overwrite else "ignore").parquet(self._at(name))

    def save(self, tables: dict[str, DataFrame], metadata: dict | None = None, metrics: dict | None = None, overwrite: bool = True) -> None:
        """A whole result in one call; unknown names are kept as plot data."""
        for name, df in tables.items():
            self.write(name if name in TABLES or name.startswith("plot_data_") else f"plot_data_{name}", df, overwrite)
        if metadata:
            self.save_metadata(metadata)
        if metrics:
            self.save_metrics(metrics)

    def _folder(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def names(self) -> list[str]:
        folder, fs = self._folder(self.path)
        if not fs.exists(folder):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
        return sorted(n[len(self.prefix) :] for n in found if n.startswith(self.prefix))

    def read(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(self._at(name)) if name in self.names() else None

    def load(self) -> dict[str, DataFrame]:
        """Every known table that is there, and all plot data tables."""
        return {n: self.spark.read.parquet(self._at(n)) for n in self.names() if n in TABLES or n.startswith("plot_data_")}

    def sql(self, query: str) -> DataFrame:
        """Any SQL over the stored tables, which are registered as views."""
        for n in self.names():
            self.spark.read.parquet(self._at(n)).createOrReplaceTempView(f"{self.prefix}{n}")
        return self.spark.sql(query)

    def save_metadata(self, metadata: dict) -> None:
        rows = [(str(k), v if isinstance(v, str) else json.dumps(v)) for k, v in metadata.items()]
        self.write("model_metadata", self.spark.createDataFrame(rows, "property string, value string"))

    def save_metrics(self, metrics: dict) -> None:
        """Vectors become key_1, key_2, ..."""
        rows = []
        for k, v in metrics.items():
            rows += [(f"{k}_{i}", float(x)) for i, x in enumerate(v, 1)] if isinstance(v, (list, tuple)) else [(k, float(v))]
        self.write("metrics", self.spark.createDataFrame(rows, "metric string, value double"))

    def compact(self, name: str, files: int = 1) -> None:
        """Rewrite a table in fewer files: beside it first, then by renaming, so that no row is lost if the job ends early."""
        self.spark.read.parquet(self._at(name)).coalesce(files).write.mode("overwrite").parquet(self._at(f"__compact_{name}"))
        now, fs = self._folder(self._at(name))
        new, old = self._folder(self._at(f"__compact_{name}"))[0], self._folder(self._at(f"__old_{name}"))[0]
        fs.delete(old, True)
        if not (fs.rename(now, old) and fs.rename(new, now)):
            raise OSError(f"{name} could not be replaced; its rows are in {old} or {now}")
        fs.delete(old, True)
        self.spark.catalog.refreshByPath(self._at(name))


def tidy_draws(draws: DataFrame, parameters: list[str]) -> DataFrame:
    """Wide draws (chain, iteration, one column each) to chain, iteration, parameter, value; arrays become name[k]."""
    parts = []
    for p in parameters:
        if draws.schema[p].dataType.typeName() == "array":
            part = draws.select("chain", "iteration", F.posexplode(p).alias("pos", "value"))
            parts.append(part.select("chain", "iteration", F.concat(F.lit(f"{p}["), (F.col("pos") + 1).cast("string"), F.lit("]")).alias("parameter"), F.col("value").cast("double").alias("value")))
        else:
            parts.append(draws.select("chain", "iteration", F.lit(p).alias("parameter"), F.col(p).cast("double").alias("value")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def wide_draws(tidy: DataFrame, parameters: list[str]) -> DataFrame:
    """One column for each parameter; the names are given, so no pass is spent on finding them."""
    return tidy.groupBy("chain", "iteration").pivot("parameter", parameters).agg(F.first("value"))


def appended_draws(old: DataFrame, new: DataFrame) -> DataFrame:
    """New draws follow the old ones of their chain."""
    last = old.groupBy("chain").agg(F.max("iteration").alias("__last"))
    moved = new.join(F.broadcast(last), "chain", "left").withColumn("iteration", F.col("iteration") + F.coalesce("__last", F.lit(0))).drop("__last")
    return old.unionByName(moved)


def export_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_geojson(units: DataFrame, path: str, properties: list[str]) -> None:
    """Every partition writes a file of its own that is a whole FeatureCollection, one feature a line."""

    def collection(batches):
        yield pa.RecordBatch.from_pydict({"value": ['{"type":"FeatureCollection","features":[']})
        before = ""
        for batch in batches:
            lines = []
            for feature in batch.column(0).to_pylist():
                lines.append(before + feature)
                before = ","
            yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string())})
        yield pa.RecordBatch.from_pydict({"value": ["]}"]})

    good = units.filter(geometry.is_valid(F.col("ring")))
    features = good.select(geometry.geojson_feature(F.col("ring"), F.struct(*properties)).alias("value"))
    features.mapInArrow(collection, "value string").write.mode("overwrite").text(path)


def geometries(units: DataFrame) -> DataFrame:
    return units.select("unit_id", F.col("cx").alias("centroid_x"), F.col("cy").alias("centroid_y"), geometry.area(F.col("ring")).alias("area"), geometry.wkt(F.col("ring")).alias("wkt"))
