"""Structured Streaming forms: windowed counts, running summaries, transitions per tag and sequential updates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str, late: str, value: str) -> DataFrame:
    """Regular time bins as tumbling windows; rows later than the watermark are dropped."""
    found = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by)
    return found.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("window_start"), *by, "n", "mean")


def running_summary(draws: DataFrame) -> DataFrame:
    """Streaming aggregate of draws (parameter, value): count, mean and sd so far."""
    return draws.groupBy("parameter").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def transitions(events: DataFrame, tag: str, time: str, unit: str) -> DataFrame:
    """tag, from_unit, to_unit, time: every event with the unit of the tag's previous one, kept as state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(time, kind="stable")
        units = rows[unit].tolist()
        before = [state.get[0] if state.exists else None, *units[:-1]]
        state.update((units[-1],))
        out = pd.DataFrame({"tag": [key[0]] * len(rows), "from_unit": before, "to_unit": units, "time": rows[time].tolist()})
        yield out[out["from_unit"].notna()].astype({"from_unit": "int64"})

    kind = dict(events.dtypes)[time]
    return events.groupBy(tag).applyInPandasWithState(step, f"tag long, from_unit long, to_unit long, time {kind}", "unit long", "append", GroupStateTimeout.NoTimeout)


def ar1_states(innovations: DataFrame, rho: float, sigma: float = 1.0, first: int = 1, eps: float = 1e-6) -> DataFrame:
    """unit, t, x: the AR(1) recursion x_t = rho x_(t-1) + sigma z_t of each unit as a stream of innovations (unit, t, z), stationary at t = `first`.

    Kept as state are the last period and its value, and the innovations that arrived before their turn. A period is emitted once, as soon as
    all before it are there, so the rows do not depend on how the input falls into micro-batches nor on its order. Of repeated rows of a period the
    first to arrive counts (the smallest of one batch); rows of periods that are done or lie before the first are dropped, and a null innovation is 0.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, x, ahead_t, ahead_z = state.get if state.exists else (first - 1, 0.0, [], [])
        ahead = dict(zip(ahead_t, ahead_z))
        for pdf in batches:
            for t, z in sorted(zip(pdf["t"].tolist(), pdf["z"].fillna(0.0).tolist())):
                if t > last:
                    ahead.setdefault(t, z)
        out = []
        while last + 1 in ahead:
            last += 1
            z = sigma * ahead.pop(last)
            x = z / (1 - rho * rho + eps) ** 0.5 if last == first else rho * x + z
            out.append((key[0], last, x))
        times = sorted(ahead)
        state.update((last, x, times, [ahead[t] for t in times]))
        yield pd.DataFrame(out, columns=["unit", "t", "x"]).astype({"unit": "int64", "t": "int64", "x": "float64"})

    kept = "last long, x double, ahead_t array<long>, ahead_z array<double>"
    return innovations.select("unit", "t", "z").groupBy("unit").applyInPandasWithState(step, "unit long, t long, x double", kept, "append", GroupStateTimeout.NoTimeout)


def sequential_normal(batch: DataFrame, prior: dict[str, tuple[float, float]], noise: float) -> dict[str, tuple[float, float]]:
    """Normal prior (mean, sd) per parameter, updated by one micro-batch; meant for foreachBatch, whose state is a row per parameter."""
    out = dict(prior)
    for r in batch.groupBy("parameter").agg(F.count("*").alias("n"), F.avg("value").alias("m")).toLocalIterator():
        mean, sd = prior.get(r.parameter, (0.0, 1e3))
        precision = 1 / sd**2 + r.n / noise**2
        out[r.parameter] = ((mean / sd**2 + r.n * r.m / noise**2) / precision, precision**-0.5)
    return out
