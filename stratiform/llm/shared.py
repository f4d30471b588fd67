"""Shared folders for tables that cut lineage, and small guards."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder


#: Spark takes no more buckets by default.
MOST_BUCKETS = 100_000


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write a table to the shared folder and read it back: a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """As `stored`, in buckets of `key`, so that no join on it shuffles the table again. A task makes a file for each
    bucket it has rows of, so it should hold few keys. The table's name goes at once, its files stay."""
    spark = df.sparkSession
    table, buckets = f"{name}_{uuid.uuid4().hex}", min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
    df.write.option("compression", "zstd").option("path", f"{shared_folder(spark)}/{table}").bucketBy(buckets, key).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return found


def columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under private names, so that no other column can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: A key is hot if it has more than this share of the rows of an even partition.
HOT_SHARE, HOT_ROWS = 8, 1000


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str, how: str = "inner") -> DataFrame:
    """Join on `keys`, which are unique in `right`; its column `rows` says how many rows of `left` each has.

    Hot keys are joined by broadcast, so that their rows stay where they are: of keys with more than one part in
    HOT_SHARE * partitions of all rows there can't be more than HOT_SHARE * partitions, at any size of the tables.
    `left` is read twice, so both tables should be stored ones.
    """
    parts = HOT_SHARE * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = max(HOT_ROWS, (right.agg(F.sum(rows)).first()[0] or 0) // parts)
    hot = right.filter(F.col(rows) > limit)
    if hot.isEmpty():
        return left.join(right, keys, how)
    warm = left.join(F.broadcast(hot), keys)
    cold = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.filter(F.col(rows) <= limit), keys, how)
    return warm.unionByName(cold)
