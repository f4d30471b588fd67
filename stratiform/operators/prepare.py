"""Transforms, discretisation, recodes and design columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_scalars(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Add whole-table aggregates to every row: one row is broadcast, nothing is shuffled but partial sums."""
    return df.crossJoin(F.broadcast(df.agg(*[a.alias(n) for n, a in aggregates.items()])))


def transformed(df: DataFrame, column: str, how: str, name: str | None = None) -> DataFrame:
    """Add `<column>_<how>`: zscore, center, scale (min-max) or log (of x - min + 1)."""
    x = F.col(column)
    needs = {
        "zscore": ({"__m": F.avg(x), "__s": F.stddev_samp(x)}, (x - F.col("__m")) / F.col("__s")),
        "center": ({"__m": F.avg(x)}, x - F.col("__m")),
        "scale": ({"__a": F.min(x), "__b": F.max(x)}, (x - F.col("__a")) / (F.col("__b") - F.col("__a"))),
        "log": ({"__a": F.min(x)}, F.log(x - F.col("__a") + 1)),
    }
    if how not in needs:
        raise ValueError(f"unknown transform {how}")
    aggregates, value = needs[how]
    return with_scalars(df, **aggregates).withColumn(name or f"{column}_{how}", value).drop(*aggregates)


#: Buckets of an interval in a round of the search for quantiles.
BUCKETS = 1024


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float] | None:
    """The same numbers as percentile(), without its table of all distinct values in one task; None without any value.

    Each rank that is wanted lies in an interval of values; a round counts the rows in its buckets, and the one with the rank is the next
    interval, until it holds a single value. A round is one aggregation, and the driver gets BUCKETS rows for each interval.
    """
    x = F.col(column).cast("double")
    values = df.select(x.alias("x")).filter("x is not null")
    n, low, high = values.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return None
    wanted = sorted({r for s in shares for r in (math.floor((n - 1) * s), math.ceil((n - 1) * s))})
    # rank -> interval and the rows below it
    held = {r: (low, high, 0) for r in wanted}
    single = lambda a, b: a == b or math.isnan(a)

    def place(a: float, b: float) -> Column:
        if math.isfinite(b - a):
            return F.least(F.floor((F.col("x") - F.lit(a)) / F.lit(b - a) * BUCKETS), F.lit(BUCKETS - 1)).cast("long")
        # an infinite end (NaN is the largest value) is a bucket of its own
        return F.when(F.col("x") == F.lit(a), 0).when(F.col("x") == F.lit(b), 2).otherwise(1).cast("long")

    while spans := list(dict.fromkeys((a, b) for a, b, _ in held.values() if not single(a, b))):
        number = F.coalesce(*[F.when(F.col("x").between(a, b), F.struct(F.lit(i).alias("span"), place(a, b).alias("bucket"))) for i, (a, b) in enumerate(spans)])
        found: dict[int, list] = {}
        for row in values.withColumn("at", number).filter("at is not null").groupBy("at.span", "at.bucket").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).orderBy("span", "bucket").collect():
            found.setdefault(row["span"], []).append(row)
        for r, (a, b, below) in held.items():
            if single(a, b):
                continue
            for row in found[spans.index((a, b))]:
                if below + row["n"] > r:
                    held[r] = (row["a"], row["b"], below)
                    break
                below += row["n"]
    out = []
    for s in shares:
        at = (n - 1) * s
        a, b = math.floor(at), math.ceil(at)
        out.append(held[a][0] if held[a][0] == held[b][0] else (b - at) * held[a][0] + (at - a) * held[b][0])
    return out


def breaks(df: DataFrame, column: str, method: str = "quantile", bins: int = 9, provided: list[float] | None = None, bounds: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """One row: `brks`, an array of bins + 1 breaks."""
    x = F.col(column).cast("double")
    steps = F.sequence(F.lit(0), F.lit(bins))
    one_row = lambda brks: df.sparkSession.createDataFrame([(brks,)], "brks array<double>")
    if method == "quantile":
        q = exact_quantiles(df, column, [i / bins for i in range(bins + 1)])
        return one_row(q and [*q[:-1], q[-1] + 1e-6])
    if method == "quantile_regular":
        ends = exact_quantiles(df, column, list(bounds))
        return one_row(ends and [ends[0] + i * (ends[1] - ends[0]) / bins for i in range(bins + 1)])
    if method == "regular":
        low, high = F.col("low"), F.col("high")
        return df.agg(F.min(x).alias("low"), F.max(x).alias("high")).select(F.transform(steps, lambda i: low + i * (high - low) / bins).alias("brks"))
    if method == "provided":
        return df.sparkSession.range(1).select(F.array(*map(F.lit, provided)).alias("brks"))
    if method == "kmeans":
        return one_row(kmeans_breaks(df, column, bins))
    if method == "jenks":
        return one_row(jenks_breaks(df, column, bins))
    raise ValueError(f"unknown method {method}")


def kmeans_breaks(df: DataFrame, column: str, bins: int, rounds: int = 30) -> list[float] | None:
    """Midpoints of one-dimensional k-means centres. Every round is one aggregation; only centres reach the driver."""
    x = F.col(column).cast("double")
    low, high = df.agg(F.min(x), F.max(x)).first()
    centres = exact_quantiles(df, column, [(i + 0.5) / bins for i in range(bins)])
    if centres is None:
        return None
    for _ in range(rounds):
        cuts = [(a + b) / 2 for a, b in zip(centres, centres[1:])]
        cell = sum((F.when(x > c, 1).otherwise(0) for c in cuts), F.lit(0))
        means = dict(df.groupBy(cell.alias("cell")).agg(F.avg(x)).collect())
        moved = [means.get(i, c) for i, c in enumerate(centres)]
        if moved == centres:
            break
        centres = sorted(moved)
    return [low, *((a + b) / 2 for a, b in zip(centres, centres[1:])), high]


def _cell_sums(values: DataFrame, edges: list[float], centre: float) -> list:
    """cell, n, sum and sum of squares about `centre`, least and largest value of every cell that has values.

    A cell ends with its edge. Each task adds up its own rows, so the shuffle holds a row for each task and cell.
    """
    import numpy as np
    import pandas as pd

    def own(batches):
        for pdf in batches:
            x = np.sort(pdf["x"].to_numpy())
            if len(x):
                cell = np.searchsorted(edges, x, side="left")
                first = np.flatnonzero(np.r_[True, np.diff(cell) > 0])
                last, c = np.r_[first[1:], len(x)], x - centre
                yield pd.DataFrame({"cell": cell[first], "n": last - first, "s": np.add.reduceat(c, first), "q": np.add.reduceat(c * c, first), "low": x[first], "high": x[last - 1]})

    parts = values.mapInPandas(own, "cell long, n long, s double, q double, low double, high double")
    return parts.groupBy("cell").agg(F.sum("n"), F.sum("s"), F.sum("q"), F.min("low"), F.max("high")).orderBy("cell").collect()


def _best_cuts(rows: list, bins: int) -> list[int]:
    """Where each class but the first begins, by the least sum of squares within classes of consecutive cells."""
    import numpy as np

    n, s, q = (np.concatenate(([0.0], np.cumsum([r[i] for r in rows]))) for i in (1, 2, 3))
    m = len(rows)
    best, back = np.full(m + 1, np.inf), np.zeros((bins + 1, m + 1), int)
    best[0] = 0
    for k in range(1, bins + 1):
        now = np.full(m + 1, np.inf)
        for b in range(k, m + 1):
            a = np.arange(k - 1, b)
            total = best[a] + q[b] - q[a] - (s[b] - s[a]) ** 2 / (n[b] - n[a])
            back[k, b] = a[np.argmin(total)]
            now[b] = total.min()
        best = now
    cuts, b = [], m
    for k in range(bins, 1, -1):
        b = int(back[k, b])
        cuts.append(b)
    return cuts[::-1]


def jenks_breaks(df: DataFrame, column: str, bins: int, cells: int = 256) -> list[float]:
    """Natural breaks. Cells at regular places and at quantiles are classed first; then the cells on either side of a
    break are split and all are classed again, until each break lies between two neighbouring values.

    With at most `cells` distinct values, evenly held, every value is a cell of its own and the breaks are exact. What
    the driver holds grows with the rounds, not with the table. Null and NaN are left out; no value at all gives no break.
    """
    x = F.col(column).cast("double")
    values = df.select(x.alias("x")).filter("x is not null and not isnan(x)")
    points = ", ".join(f"{i / cells:.17g}D" for i in range(cells + 1))
    low, high, centre, quantiles = values.agg(F.min("x"), F.max("x"), F.avg("x"), F.expr(f"approx_percentile(x, array({points}), {10 * cells})")).collect()[0]
    if low is None:
        return []
    edges = sorted({*quantiles, *(low + (high - low) * i / cells for i in range(1, cells))})
    while True:
        rows = _cell_sums(values, edges, centre)
        cuts = _best_cuts(rows, bins) if len(rows) > bins else list(range(1, len(rows)))
        near = {i for c in cuts for i in (c - 1, c)} if len(rows) > bins else set(range(len(rows)))
        wide = [rows[i] for i in sorted(near) if rows[i][4] < rows[i][5]]
        if not wide:
            return [low, *(rows[c - 1][5] for c in cuts), high]
        edges = sorted({*edges, *(e for r in wide for e in (r[4], *(r[4] + (r[5] - r[4]) * i / 32 for i in range(1, 32))) if e < r[5])})


def bin_index(x: Column, brks: Column) -> Column:
    """Right-closed bins: the number of breaks below x, held within 1..bins."""
    return F.greatest(F.lit(1), F.least(F.size(brks) - 1, F.size(F.filter(brks, lambda b: b < x)))).cast("long")


def discretised(df: DataFrame, column: str, method: str = "quantile", bins: int = 9, name: str = "bin", **options) -> DataFrame:
    """Add the bin and its midpoint."""
    cut = F.broadcast(breaks(df, column, method, bins, **options))
    out = df.crossJoin(cut).withColumn(name, bin_index(F.col(column), F.col("brks")))
    mids = F.zip_with(F.slice("brks", 1, F.size("brks") - 1), F.slice("brks", 2, F.size("brks") - 1), lambda a, b: a + (b - a) / 2)
    return out.withColumn(f"{name}_mid", F.get(mids, (F.col(name) - 1).cast("int"))).drop("brks")


def ranked_levels(df: DataFrame, column: str, name: str) -> DataFrame:
    """1..K in order of value. The levels are a dimension table: the window runs over levels, not rows."""
    levels = df.select(column).filter(F.col(column).isNotNull()).distinct()
    levels = levels.withColumn(name, F.row_number().over(Window.orderBy(column)).cast("long"))
    return df.join(levels, column)


def first_seen_levels(df: DataFrame, column: str, order: str, name: str) -> DataFrame:
    """1..G in order of first appearance."""
    levels = df.groupBy(column).agg(F.min(order).alias("__first"))
    levels = levels.withColumn(name, F.row_number().over(Window.orderBy("__first", column)).cast("long")).drop("__first")
    return df.join(levels, column)


def cell_means(df: DataFrame, unit: str, time: str, value: str, empty: float = 0.0) -> DataFrame:
    """Mean of every unit at every time of the table; a pair without rows has `empty`. Units and times are dimension tables."""
    grid = df.select(unit).distinct().join(F.broadcast(df.select(time).distinct()))
    means = df.groupBy(unit, time).agg(F.avg(value).alias("mean"))
    return grid.join(means, [unit, time], "left").withColumn("mean", F.coalesce("mean", F.lit(empty)))


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, and how often: none for a key."""
    return df.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")


def space_time_index(s: Column, t: Column, units: Column | int) -> Column:
    return ((t - 1) * units + s).cast("long")


def contrasts(df: DataFrame, column: str, levels: list, scheme: str = "dummy") -> DataFrame:
    """Contrast columns of a categorical variable, named `<column>_<level>`."""
    x, out = F.col(column), {}
    for i, level in enumerate(levels[1:], 1):
        if scheme == "dummy":
            value = F.when(x == level, 1.0).otherwise(0.0)
        elif scheme == "effects":
            value = F.when(x == level, 1.0).when(x == levels[0], -1.0).otherwise(0.0)
        elif scheme == "helmert":
            value = F.when(x == level, float(i)).when(x.isin(levels[:i]), -1.0).otherwise(0.0)
        else:
            raise ValueError(f"unknown contrast {scheme}")
        out[f"{column}_{level}"] = value
    return df.withColumns(out)
