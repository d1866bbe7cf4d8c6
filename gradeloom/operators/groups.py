"""Groups of graded rollouts: pass@k, group signal, trims, difficulty tiers, calibration, training stamps.

Everything here starts from (n, c): how many graded rollouts a task has and how many passed. That table is
one row a task, made by one partial aggregation; a task's rollouts are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.stats import all_of_k, any_of_k, wilson

BAND = (0.2, 0.8)
MIN_K = 4


def binary(reward: str = "reward") -> Column:
    """The reward where it is exactly 0 or 1, else null."""
    return F.when(F.col(reward).isin(0.0, 1.0), F.col(reward))


def task_stats(rows: DataFrame, *, task: str = "task_id", reward: str = "reward", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., task, n, c) over binary rewards; tasks without any are left out."""
    found = rows.select(*by, task, binary(reward).alias("_r")).where("_r IS NOT NULL")
    return found.groupBy(*by, task).agg(F.count("*").alias("n"), F.sum("_r").cast("long").alias("c"))


def pass_at(stats: DataFrame, k: int = MIN_K, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Macro pass@1 over all tasks, pass^k and pass@k over those with n >= k, headroom, and how many tasks each had."""
    out = stats.groupBy(*by).agg(
        F.count("*").alias("n_tasks"), F.sum("n").cast("long").alias("n_rows"),
        F.sum((F.col("n") >= k).cast("long")).alias("n_eligible"),
        F.avg(F.col("c") / F.col("n")).alias("pass_at_1"),
        F.avg(all_of_k(F.col("n"), F.col("c"), k)).alias("pass_pow_k"),
        F.avg(any_of_k(F.col("n"), F.col("c"), k)).alias("pass_at_k"),
    )
    return out.withColumn("headroom", F.col("pass_at_k") - F.col("pass_at_1"))


def pass_at_default(stats: DataFrame, *, min_k: int = MIN_K, unanimous_short: bool = False) -> DataFrame:
    """``pass_at`` with k as the least n of the tasks with two rollouts or more, as the column ``k``.

    Below ``min_k`` the k-way numbers are null. ``unanimous_short``: tasks of fewer than k rollouts and one
    outcome count with that outcome (``n_imputed``); mixed short ones stay out.
    """
    k = stats.agg(F.min(F.when(F.col("n") >= 2, F.col("n")))).first()[0] or 1
    able = F.col("n") >= k
    short = ~able & ((F.col("c") == 0) | (F.col("c") == F.col("n"))) & F.lit(unanimous_short)
    rate = F.col("c") / F.col("n")
    shown = lambda x: F.avg(F.when(short, rate).otherwise(x)) if k >= min_k else F.lit(None).cast("double")
    out = stats.agg(
        F.lit(int(k)).alias("k"), F.count("*").alias("n_tasks"), F.sum("n").cast("long").alias("n_rows"),
        F.sum(able.cast("long")).alias("n_eligible"), F.sum(short.cast("long")).alias("n_imputed"), F.avg(rate).alias("pass_at_1"),
        shown(all_of_k(F.col("n"), F.col("c"), k)).alias("pass_pow_k"), shown(any_of_k(F.col("n"), F.col("c"), k)).alias("pass_at_k"),
    )
    return out.withColumn("headroom", F.col("pass_at_k") - F.col("pass_at_1"))


def group_signal(stats: DataFrame, lo: float = BAND[0], hi: float = BAND[1]) -> DataFrame:
    """How many tasks are single, mixed, all failing, all passing and in the band, and the share of mixed ones."""
    n, c, many = F.col("n"), F.col("c"), F.col("n") >= 2
    count = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0)).cast("long")
    mixed = many & (c > 0) & (c < n)
    out = stats.agg(
        count(n == 1).alias("single"), count(mixed).alias("mixed"), count(many & (c == 0)).alias("all_0"), count(many & (c == n)).alias("all_1"),
        count(mixed & (c / n).between(lo, hi)).alias("in_band"), count(many).alias("multi"),
    )
    return out.withColumn("mixed_rate", F.try_divide(F.col("mixed"), F.col("multi")))


def pass_rates(stats: DataFrame) -> DataFrame:
    """``stats`` with pass_rate and its Wilson interval."""
    lo, hi = wilson(F.col("c"), F.col("n"))
    return stats.withColumns({"pass_rate": F.col("c") / F.col("n"), "ci_lo": lo, "ci_hi": hi})


def without_tasks(rows: DataFrame, tasks: DataFrame, task: str = "task_id") -> DataFrame:
    return rows.join(tasks.select(task).distinct(), task, "left_anti")


def trim_unanimous(rows: DataFrame, min_k: int = 2, **kw) -> DataFrame:
    """Without the tasks of ``min_k`` or more labels that are all equal; single ones stay."""
    return without_tasks(rows, task_stats(rows, **kw).where((F.col("n") >= min_k) & ((F.col("c") == 0) | (F.col("c") == F.col("n")))), kw.get("task", "task_id"))


def trim_out_of_band(rows: DataFrame, lo: float = BAND[0], hi: float = BAND[1], min_k: int = 2, **kw) -> DataFrame:
    """Without the mixed tasks whose pass rate is outside [lo, hi]; unanimous and short ones stay."""
    n, c = F.col("n"), F.col("c")
    return without_tasks(rows, task_stats(rows, **kw).where((n >= min_k) & (c > 0) & (c < n) & ~(c / n).between(lo, hi)), kw.get("task", "task_id"))


def retire_solved(rows: DataFrame, solved: float = 0.8, min_rollouts: int = 2, **kw) -> DataFrame:
    """Without the tasks whose pass rate is above ``solved`` over at least ``min_rollouts``."""
    return without_tasks(rows, task_stats(rows, **kw).where((F.col("n") >= min_rollouts) & (F.col("c") / F.col("n") > solved)), kw.get("task", "task_id"))


def curriculum(stats: DataFrame, *, task: str = "task_id", solved: float = 0.8, floor: float = 0.2, tiers: int = 3, min_rollouts: int = 2) -> DataFrame:
    """Each task's state (retired, not_ready, thin, trainable) and, for trainable ones, the tier from easy (0) to hard.

    A tier is floor(rank / (number / tiers)). The rank comes from counts below each distinct pass rate and a
    rank inside it, so no task list is sorted in one place; pass rates have few distinct values.
    """
    rate = F.col("c") / F.col("n")
    state = F.when(F.col("n") < min_rollouts, "thin").when(rate > solved, "retired").when(rate < floor, "not_ready").otherwise("trainable")
    found = stats.withColumns({"pass_rate": rate, "state": state})
    able = found.where("state = 'trainable'")
    steps = able.groupBy("pass_rate").agg(F.count("*").alias("k"))  # a row for each distinct ratio of small counts
    steps = steps.select("pass_rate", (F.sum("k").over(Window.orderBy(F.desc("pass_rate")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("k")).alias("before"), F.sum("k").over(Window.partitionBy()).alias("total"))
    inside = F.row_number().over(Window.partitionBy("pass_rate").orderBy(task)) - 1
    ranked = able.join(F.broadcast(steps), "pass_rate").withColumn("rank", F.col("before") + inside)
    tier = F.least(F.lit(tiers - 1), F.floor(F.col("rank") / (F.col("total") / F.lit(float(tiers))))).cast("int")
    return found.where("state <> 'trainable'").select(task, "pass_rate", "state", F.lit(None).cast("int").alias("tier")).unionByName(ranked.select(task, "pass_rate", "state", tier.alias("tier")))


def stamp_groups(rows: DataFrame, *, task: str = "task_id", reward: str = "reward") -> DataFrame:
    """Rows with their group's id, size, fails, passes, mean and population std (what group-relative trainers read)."""
    w = Window.partitionBy(task)
    r = F.col(reward)
    return rows.withColumns({
        "group_id": F.substring(F.sha1(F.col(task).cast("string").cast("binary")), 1, 12), "group_k": F.count(r).over(w),
        "group_n0": F.sum((r < 0.5).cast("long")).over(w), "group_n1": F.sum((r > 0.5).cast("long")).over(w),
        "group_mean": F.avg(r).over(w), "group_std": F.stddev_pop(r).over(w),
    })


def carry_calibration(kept: DataFrame, stats: DataFrame, task: str = "task_id") -> DataFrame:
    """Kept rows with the n, pass rate and interval measured on all graded rows of their task."""
    return kept.join(pass_rates(stats).select(task, "n", "pass_rate", "ci_lo", "ci_hi"), task, "left")


def next_round(stats: DataFrame, tasks: DataFrame, lo: float = BAND[0], hi: float = BAND[1], task: str = "task_id") -> DataFrame:
    """Each candidate task and why it is in or out: in_band, unknown (both kept), solved, unsolved."""
    rate = F.col("c") / F.col("n")
    why = F.when(F.col("n").isNull(), "unknown").when(rate > hi, "solved").when(rate < lo, "unsolved").otherwise("in_band")
    return tasks.select(task).distinct().join(stats, task, "left").select(task, why.alias("why"), why.isin("unknown", "in_band").alias("kept"))


def metric_means(rows: DataFrame, metrics: list[str], *, task: str = "task_id", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., metric, mean over tasks of task means, tasks, rows): all metrics in one pass."""
    per_task = rows.groupBy(*by, task).agg(*(F.avg(m).alias(m) for m in metrics), *(F.count(m).alias(f"_n_{m}") for m in metrics))
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v"), F.col(f"_n_{m}").alias("k")) for m in metrics))).alias("x")
    long = per_task.select(*by, pairs).select(*by, "x.*").where("v IS NOT NULL")
    return long.groupBy(*by, "metric").agg(F.avg("v").alias("mean"), F.count("*").alias("n_tasks"), F.sum("k").cast("long").alias("n_rows"))
