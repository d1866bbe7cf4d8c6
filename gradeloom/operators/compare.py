"""Two or more runs of the same tasks: paired deltas, re-run noise, slices, two-way shares, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.keys import hash_int


def paired(rows: DataFrame, *, task: str = "task_id", arm: str = "arm", metric: str = "reward", before: str = "before", after: str = "after", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., task, mean_before, mean_after): a side that a task lacks is null. One aggregation serves both arms: no join."""
    side = lambda name: F.avg(F.when(F.col(arm) == name, F.col(metric)))
    return rows.groupBy(*by, task).agg(side(before).alias("mean_before"), side(after).alias("mean_after")).where("mean_before IS NOT NULL OR mean_after IS NOT NULL")


def compare_runs(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Shared and one-sided tasks, means, mean paired delta and its sample deviation, and the shared share."""
    d = F.col("mean_after") - F.col("mean_before")
    out = pairs.groupBy(*by).agg(
        F.count(d).alias("n_shared"), F.sum(F.col("mean_after").isNull().cast("long")).alias("only_before"), F.sum(F.col("mean_before").isNull().cast("long")).alias("only_after"),
        F.avg("mean_before").alias("before"), F.avg("mean_after").alias("after"), F.avg(d).alias("delta"), F.stddev_samp(d).alias("delta_sd"),
    )
    return out.withColumn("paired_share", F.col("n_shared") / (F.col("n_shared") + F.col("only_before") + F.col("only_after")))


def resampled_means(values: DataFrame, value: str, key: str, draws: int, seed: int) -> DataFrame:
    """(draw, mean): a bootstrap in which each value counts as often as a Poisson(1) draw by hash says.

    Counts follow from the key alone, so a draw needs no order, no collected list and no join: values are
    spread over draws, weighted and summed with map-side combination, which gives one row a draw.
    """
    u = (hash_int(F.concat_ws(":", F.lit(str(seed)), F.col("draw"), F.col(key))) + 0.5) / F.lit(4294967296.0)
    times, below, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 9):
        below += term
        times = times + (u > below).cast("int")
        term /= k
    spread = values.select(key, F.col(value).alias("_v")).where("_v IS NOT NULL").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    spread = spread.withColumn("_k", times)
    return spread.groupBy("draw").agg((F.sum(F.col("_v") * F.col("_k")) / F.sum("_k")).alias("mean"))


def percentile_interval(means: DataFrame, draws: int, level: float = 0.95) -> DataFrame:
    """Order statistics floor((1-L)/2 B) and floor((1+L)/2 B) - 1 of the draws (a bounded number of rows)."""
    sorted_means = F.array_sort(F.collect_list("mean"))
    lo, hi = int((1 - level) / 2 * draws + 1e-9), int((1 + level) / 2 * draws + 1e-9) - 1
    return means.agg(sorted_means.alias("_m")).select(F.element_at("_m", lo + 1).alias("ci_lo"), F.element_at("_m", hi + 1).alias("ci_hi"))


def sign_flips(pairs: DataFrame, key: str, draws: int, seed: int) -> DataFrame:
    """Permutation p of the mean paired delta: signs flip by a hash of draw and task."""
    d = pairs.select(key, (F.col("mean_after") - F.col("mean_before")).alias("_d")).where("_d IS NOT NULL")
    spread = d.withColumn("draw", F.explode(F.sequence(F.lit(-1), F.lit(draws - 1))))  # draw -1 keeps all signs
    flip = F.when((F.col("draw") < 0) | (hash_int(F.concat_ws(":", F.lit(str(seed)), F.col("draw"), F.col(key))) % 2 == 0), F.col("_d")).otherwise(-F.col("_d"))
    means = spread.groupBy("draw").agg(F.avg(flip).alias("mean"))
    seen = means.where("draw = -1").select(F.col("mean").alias("delta"))
    far = means.where("draw >= 0").join(F.broadcast(seen)).agg(F.sum((F.abs("mean") >= F.abs("delta") - 1e-12).cast("long")).alias("extreme"), F.first("delta").alias("delta"))
    return far.select("delta", "extreme", ((F.col("extreme") + 1) / F.lit(draws + 1)).alias("p"))


def eval_variance(rows: DataFrame, *, run: str = "eval_run", task: str = "task_id", metric: str = "reward") -> DataFrame:
    """Macro mean of each re-run in one row: how many, their mean and sample std, and the tasks that all have."""
    per = rows.groupBy(run, task).agg(F.avg(metric).alias("v"))
    runs = per.groupBy(run).agg(F.avg("v").alias("m"))
    out = runs.agg(F.count("*").alias("n_runs"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("run_std"), F.min("m").alias("lowest"), F.max("m").alias("highest"))
    common = per.groupBy(task).agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("tasks"))
    return out.join(F.broadcast(common), out["n_runs"] == common["k"], "left").select(*out.columns, F.coalesce("tasks", F.lit(0)).cast("long").alias("common_tasks"))


def pooled_run_std(rows: DataFrame, *, arm: str = "arm", run: str = "eval_run", task: str = "task_id", metric: str = "reward") -> DataFrame:
    """Run-to-run std of both arms pooled by degrees of freedom."""
    means = rows.groupBy(arm, run, task).agg(F.avg(metric).alias("v")).groupBy(arm, run).agg(F.avg("v").alias("m"))
    sides = means.groupBy(arm).agg((F.count("*") - 1).alias("df"), F.var_samp("m").alias("var")).where("df > 0")
    return sides.agg(F.sqrt(F.sum(F.col("df") * F.col("var")) / F.sum("df")).alias("run_std"), F.sum("df").cast("long").alias("df"))


def by_slice(pairs: DataFrame, slice_of: str, *, min_tasks: int = 6, weak: float = 0.5, ceiling: float = 0.9) -> DataFrame:
    """``compare_runs`` overall (slice null) and in every slice present on both sides, in one GROUPING SETS pass, with low_n and weak."""
    d = F.col("mean_after") - F.col("mean_before")
    out = pairs.cube(slice_of).agg(F.grouping(slice_of).alias("_all"), F.count(d).alias("n_shared"), F.avg("mean_before").alias("before"), F.avg("mean_after").alias("after"), F.avg(d).alias("delta"))
    out = out.where("_all = 1 OR n_shared > 0").withColumn("low_n", F.col("n_shared") < min_tasks)
    return out.withColumn("weak", ~F.col("low_n") & ((F.col("after") < weak) | ((F.col("delta") <= 0) & (F.col("after") < ceiling)))).withColumn("overall", F.col("_all") == 1).drop("_all")


def two_way(rows: DataFrame, *, harness: str = "harness", model: str = "model", task: str = "task_id", metric: str = "reward") -> DataFrame:
    """Shares of variance of cell means by harness, model and their interaction, from one GROUPING SETS pass over cells."""
    cells = rows.groupBy(harness, model, task).agg(F.avg(metric).alias("v")).groupBy(harness, model).agg(F.avg("v").alias("v"))
    w = lambda *c: Window.partitionBy(*c)
    out = cells.withColumns({"h": F.avg("v").over(w(harness)), "m": F.avg("v").over(w(model)), "g": F.avg("v").over(w())})
    a, b = F.col("h") - F.col("g"), F.col("m") - F.col("g")
    rest = F.col("v") - F.col("h") - F.col("m") + F.col("g")
    out = out.agg(F.sum(a * a).alias("ss_h"), F.sum(b * b).alias("ss_m"), F.sum(rest * rest).alias("ss_i"))
    total = F.col("ss_h") + F.col("ss_m") + F.col("ss_i")
    return out.select(*(F.try_divide(F.col(f"ss_{x}"), total).alias(name) for x, name in (("h", "harness_share"), ("m", "model_share"), ("i", "interaction_share"))))


def balance(rows: DataFrame, *, arm: str = "arm", task: str = "task_id", key: str = "row_key", seed: int = 0) -> DataFrame:
    """Tasks on both sides cut to the smaller side's count, which rows by a hash; one-sided tasks stay whole."""
    sizes = rows.groupBy(task, arm).agg(F.count("*").alias("k")).groupBy(task).agg(F.min("k").alias("least"), F.count("*").alias("sides"))
    order = Window.partitionBy(task, arm).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(arm), F.col(key).cast("string")).cast("binary")), key)
    ranked = rows.withColumn("_k", F.row_number().over(order)).join(sizes, task)
    return ranked.where("sides < 2 OR _k <= least").drop("_k", "least", "sides")
