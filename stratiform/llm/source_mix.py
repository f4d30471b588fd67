"""Mixing sources to target weights: repetition rates per source, whole copies and one Bernoulli copy per document.

Sizes (words) are summed per source. The sources, in order of their names, get weights and share `share` times all sizes;
a target stops at `most` times its source's size and the excess is shared again by weight until none is above. A round of
that is one aggregation of the source table. A source's rate is target / size; each of its documents is emitted floor(rate) times, and
once more if a uniform number drawn from a hash of its id lies below the rate's fraction. The hash takes a seed: of `seeds` seeds each
source takes the one whose copies come nearest to its target, for long documents weigh much in a small source. All
seeds are summed in one pass over ids and sizes, so texts are read once and documents never move for it.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; repeated rows are drawn alike; null ids share a draw
among equal sizes; a source of size 0 has target 0 and its documents are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import hot_join, stored

# fixed values: the weights of sources in turn
WEIGHTS = (3, 1, 2)
SHARE, MOST, SEEDS = 1.5, 2, 64
KEY = ["__has", "__source"]


def sized(docs: DataFrame, text_col: str, source_col: str, keep: dict) -> DataFrame:
    """The source key, words of the text and the columns `keep` of every row."""

    def run(batches):
        for batch in tk.slices(batches, text=0):
            _, _, doc = tk.word_spans(*tk.buffer_of(batch.column(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.bincount(doc, minlength=batch.num_rows).astype(np.int64))], names=[*names, "__size"])

    key = {"__has": F.col(f"`{source_col}`").isNotNull(), "__source": F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))}
    narrow = docs.select(F.col(f"`{text_col}`").cast("string").alias("__text"), *[c.alias(n) for n, c in (key | keep).items()])
    names = narrow.columns[1:]
    return narrow.mapInArrow(run, narrow.drop("__text").schema.add("__size", "long"))


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Add `__rank`, from 0 by name, null last. Ranked within ranges of names, with the counts of the ranges before."""
    order = [F.col("__has").desc(), F.col("__source")]
    ranged = stored(sizes.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "sources")
    counts = ranged.groupBy("__range").agg(F.count("*").alias("n"))
    # a row for each range: no more than shuffle partitions
    counts = counts.withColumn("__before", F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return ranged.withColumn("__own", own).join(F.broadcast(counts), "__range").withColumn("__rank", F.col("__own") + F.col("__before")).drop("__own", "__before", "__range")


def with_targets(sources: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Add `target` to a stored table of sources with `source_size` and `__weight`. Sums reach the driver, sources don't."""
    cap = F.col("source_size") * F.lit(most)
    total, weight = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("__weight"), F.lit(0))).first()
    budget, caps, full_weight = Fraction(share) * total, 0, 0
    while True:
        # the sources that are not full share what the full ones leave; each round fills more of them, or none
        level = F.lit(float(budget - caps)) * F.col("__weight") / F.lit(float(max(weight - full_weight, 1)))
        full = level >= cap
        found = sources.filter(full).agg(F.coalesce(F.sum(cap), F.lit(0)), F.coalesce(F.sum("__weight"), F.lit(0))).first()
        if found[1] == weight or tuple(found) == (caps, full_weight):
            return sources.withColumn("target", F.when(full, cap.cast("double")).otherwise(level))
        caps, full_weight = found


def draw(seed, doc_id: str, size: str):
    """A number in [0, 1) for each document, from 52 bits of a digest."""
    text = F.concat_ws(":", F.lit(seed).cast("string") if isinstance(seed, int) else seed.cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(size).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def copies_at(seed, rate, doc_id: str, size: str):
    """Whole copies and the Bernoulli copy."""
    whole = F.floor(rate)
    return whole + F.when(draw(seed, doc_id, size) < rate - whole, 1).otherwise(0)


def rates(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: Sequence[int] = WEIGHTS, seeds: int = SEEDS) -> DataFrame:
    """source_size, target, rate, seed and row count of each source, from a stored table of sources, ids and sizes."""
    sources = sizes.groupBy(*KEY).agg(F.sum("__size").alias("source_size"), F.count("*").alias("rows"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__rank") % len(weights) + 1).cast("int"))
    sources = stored(ranked_sources(sources).withColumn("__weight", weight), "ranked-sources")
    sources = with_targets(sources, share, most).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    sources = stored(sources.drop("__rank", "__weight"), "rates")
    tried = hot_join(sizes, sources, KEY, "rows")
    sums = tried.groupBy(*KEY).agg(*[F.sum(copies_at(k, F.col("rate"), "__id", "__size") * F.col("__size")).alias(f"t{k}") for k in range(seeds)])
    # the first of the seeds that come nearest
    off = F.array(*[F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("off"), F.lit(k).alias("seed")) for k in range(seeds)])
    return stored(sources.join(sums, KEY).withColumn("seed", F.array_min(off)["seed"]).select(*sources.columns, "seed"), "seeds")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (words of all copies) of every document, those left out too."""
    sizes = stored(sized(docs, text_col, source_col, {"__id": F.col(f"`{id_col}`").cast("long")}), "sizes")
    placed = hot_join(sizes, rates(sizes, **options), KEY, "rows").withColumn("copies", copies_at(F.col("seed"), F.col("rate"), "__id", "__size"))
    return placed.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("__size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of the mix: each document as often as the plan says, with all its columns and `copy_number` from 1."""
    row = {"__id": F.col(f"`{id_col}`").cast("long"), "__row": F.struct(*[F.col(f"`{c}`") for c in docs.columns])}
    whole = sized(docs, text_col, source_col, row)
    sizes = stored(whole.drop("__row"), "sizes")
    placed = hot_join(whole, rates(sizes, **options), KEY, "rows").withColumn("copies", copies_at(F.col("seed"), F.col("rate"), "__id", "__size"))
    out = placed.filter("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns], F.col("__copy").alias("copy_number"))
