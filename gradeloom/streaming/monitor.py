"""Monitoring of a training run: look-back alarms, running means, coverage curves."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def alarms(points: DataFrame, *, window: int = 3, delta: float = 0.1, length_share: float = 0.25, run: str | None = None) -> DataFrame:
    """Each evaluation point against the one ``window`` points before (or the first): the proxy gained while the gold didn't,
    or lengths grew. A run has a point for each evaluation, so the window over a run is small."""
    w = (Window.partitionBy(run) if run else Window.partitionBy()).orderBy("step")
    old = lambda c: F.coalesce(F.lag(c, window).over(w), F.first(c).over(w))
    out = points.withColumns({"_p": old("proxy"), "_g": old("gold"), "_l": old("length")})
    gain, gold = F.col("proxy") - F.col("_p"), F.col("gold") - F.col("_g")
    return out.select(*([run] if run else []), "step", gain.alias("proxy_gain"), gold.alias("gold_gain"), ((gain >= delta) & (F.col("gold") <= F.col("_g"))).alias("divergence"), ((F.col("_l") > 0) & (F.col("length") / F.col("_l") - 1 >= length_share)).alias("length_alarm"))


def running_mean(events: DataFrame, key: str = "event_type", value: str = "value") -> DataFrame:
    """Count and mean of each key so far, kept as state across micro-batches."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for rows in batches:
            n, total = n + int(rows[value].notna().sum()), total + float(rows[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [group[0]], "n": [n], "mean": [total / n if n else None]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} string, n long, mean double", "n long, total double", "update", "NoTimeout").select(key, "n", "mean")


def coverage_curve(cells: DataFrame) -> DataFrame:
    """(batch, fresh, covered): cells first seen in each batch and all seen so far."""
    first = cells.groupBy("cell").agg(F.min("batch").alias("batch")).groupBy("batch").agg(F.count("*").alias("fresh"))
    out = cells.select("batch").distinct().join(first, "batch", "left").select("batch", F.coalesce("fresh", F.lit(0)).cast("long").alias("fresh"))
    return out.withColumn("covered", F.sum("fresh").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)))  # one row a batch
