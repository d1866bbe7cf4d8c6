"""Vectors: novelty, near-duplicates, similarity of different tasks, a Lloyd step, k-means, farthest-first picks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.operators.blocks import MAX_BLOCK, against
from gradeloom.operators.decontam import unit


def cluster_step(points: DataFrame, centres: DataFrame, *, key: str, vector: str, centre: str = "centre") -> tuple[DataFrame, DataFrame]:
    """One Lloyd step: (key, centre, distance2) and the new centres as (centre, dim, value, n).

    Centres are few by contract (k of them) and broadcast; new ones are sums by component with map-side combination.
    """
    c = centres.select(F.col(centre).alias("_c"), F.col(vector).alias("_w"))
    met = points.select(F.col(key).alias("_k"), F.col(vector).alias("_v")).join(F.broadcast(c.agg(F.collect_list(F.struct("_c", "_w")).alias("_all"))))
    near = F.array_min(F.transform("_all", lambda e: F.struct(F.aggregate(F.zip_with("_v", e["_w"], lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x).alias("d"), e["_c"].alias("c"))))
    got = met.select("_k", "_v", near.alias("_n"))
    assigned = got.select(F.col("_k").alias(key), F.col("_n.c").alias(centre), F.col("_n.d").alias("distance2"))
    moved = got.select(F.col("_n.c").alias(centre), F.posexplode("_v").alias("dim", "x")).groupBy(centre, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"), F.count("*").alias("n"))
    return assigned, moved


def novelty(rows: DataFrame, tested: DataFrame, *, key: str, vector: str, max_block: int = MAX_BLOCK) -> DataFrame:
    """Least cosine distance of each row to any tested vector, in blocks; 1 where there are none or a length is zero. Keys are whole numbers."""

    def emit(products: np.ndarray, own: list, other: list) -> dict:
        return {"_k": own[0].astype(np.int64), "c": products.max(1, initial=0.0)}

    met = against(rows.select(key, vector), tested.select(key, vector), emit, "_k long, c double", max_block=max_block)
    return met.groupBy(F.col("_k").cast(rows.schema[key].dataType).alias(key)).agg(F.max("c").alias("c")).select(key, F.greatest(F.lit(0.0), 1 - F.col("c")).alias("novelty"))


def near_pairs(rows: DataFrame, *, key: str, vector: str, threshold: float = 0.95, max_block: int = MAX_BLOCK) -> DataFrame:
    """(a, b, cosine) of all pairs at least that similar: every row against blocks of all rows by matrix products.

    Exact at any dimension, where cells or pivots prune nothing. Only pairs that are near leave a task. Keys are whole numbers.
    """

    def emit(products: np.ndarray, own: list, other: list) -> dict:
        i, j = np.nonzero((products >= threshold) & (own[0][:, None] < other[0][None, :]))
        return {"a": own[0][i].astype(np.int64), "b": other[0][j].astype(np.int64), "cosine": products[i, j]}

    both = rows.select(key, vector)
    return against(both, both, emit, "a long, b long, cosine double", max_block=max_block)


def distinct_task_similarity(rows: DataFrame, *, key: str, vector: str, task: str, share: float = 0.99, places: int = 5, max_block: int = MAX_BLOCK) -> DataFrame:
    """That percentile of the cosine, to ``places``, of all pairs of different tasks; null tasks take no part.

    Each task of Spark counts its products by rounded value, so a batch leaves at most as many rows as there are values.
    """
    scale = 10**places

    def emit(products: np.ndarray, own: list, other: list) -> dict:
        apart = own[1][:, None] < other[1][None, :]
        values, times = np.unique(np.floor(np.abs(products[apart]) * scale + 0.5).astype(np.int64) * np.sign(products[apart]).astype(np.int64), return_counts=True)
        return {"v": values, "k": times.astype(np.int64)}

    named = rows.where(F.col(task).isNotNull()).select(key, vector, task)
    counts = against(named, named, emit, "v long, k long", max_block=max_block).groupBy("v").agg(F.sum("k").alias("k"))  # at most 2 * scale + 1 rows
    place = counts.select("v", "k", F.sum("k").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("k").over(Window.partitionBy()).alias("n"))
    found = place.where(F.col("upto") >= F.ceil(F.lit(share) * F.col("n"))).agg(F.min("v").alias("v"), F.min("n").alias("pairs"))
    return found.select((F.col("v") / F.lit(float(scale))).alias("cosine"), "pairs")


def farthest_first(rows: DataFrame, *, key: str, vector: str, k: int) -> DataFrame:
    """k picks, each the row least similar to those before: a distributed arg-max a pick, the first least similar to the mean."""
    spark = rows.sparkSession
    left = rows.select(F.col(key).alias("_k"), unit(vector).alias("_v"))
    mean = [r[1] for r in left.select(F.posexplode("_v").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("x")).orderBy("d").collect()]
    picks: list = []
    against = [mean]
    for _ in range(k):
        lit = [F.array(*(F.lit(float(x)) for x in v)) for v in against]
        cos = [F.aggregate(F.zip_with("_v", v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for v in lit]
        near = F.round(F.greatest(*cos) if len(cos) > 1 else cos[0], 9)
        free = left.where(~F.col("_k").isin(picks)) if picks else left
        best = free.select(near.alias("c"), "_k", "_v").orderBy("c", "_k").first()
        if best is None:
            break
        against = [list(best["_v"])] if not picks else [*against, list(best["_v"])]
        picks.append(best["_k"])
    return spark.createDataFrame([(i + 1, p) for i, p in enumerate(picks)], f"pick int, {key} {rows.schema[key].dataType.simpleString()}")
