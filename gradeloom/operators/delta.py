"""Two arms on the same tasks, every metric at once: deltas, intervals, re-run noise, verdicts, and one headline."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.keys import hash_int
from gradeloom.functions.stats import noise_band
from gradeloom.operators.compare import pooled_run_std

#: Fewer paired tasks than this have no interval; below this share of paired tasks the arms were given different tasks.
MIN_TASKS, LEAST_PAIRED = 3, 0.5
#: A before side that passes this share leaves little room.
CEILING = 0.9


def paired_metrics(rows: DataFrame, metrics: list[str], *, task: str = "task_id", arm: str = "arm") -> DataFrame:
    """(task, b_<metric>, a_<metric>): a task's means on both sides, null where a side lacks it. One aggregation for all metrics."""
    side = lambda name, m: F.avg(F.when(F.col(arm) == name, F.col(m)))
    return rows.groupBy(task).agg(*(side(name, m).alias(f"{k}_{m}") for m in metrics for k, name in (("b", "before"), ("a", "after"))))


def poisson_means(pairs: DataFrame, metrics: list[str], *, key: str, draws: int, seed: int) -> DataFrame:
    """(draw, <metric>...): mean paired delta of every draw, each task counting as often as a Poisson(1) draw by hash says.

    One hash serves all metrics of a task, sums are combined on the map side, and the result has a row a draw.
    """
    u = (hash_int(F.concat_ws(":", F.lit(str(seed)), F.col("draw"), F.col(key))) + 0.5) / F.lit(4294967296.0)
    times, below, term = F.lit(0), 0.0, math.exp(-1)
    for k in range(1, 9):
        below += term
        times = times + (u > below).cast("int")
        term /= k
    d = {m: F.col(f"a_{m}") - F.col(f"b_{m}") for m in metrics}
    spread = pairs.select(key, *(x.alias(m) for m, x in d.items())).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_k", times)
    sums = spread.groupBy("draw").agg(*(F.sum(F.col(m) * F.col("_k")).alias(f"s_{m}") for m in metrics), *(F.sum(F.when(F.col(m).isNotNull(), F.col("_k"))).alias(f"n_{m}") for m in metrics))
    return sums.select("draw", *(F.try_divide(f"s_{m}", f"n_{m}").alias(m) for m in metrics))


def delta_report(rows: DataFrame, metrics: list[str], *, lower_is_better: tuple[str, ...] = (), task: str = "task_id", arm: str = "arm", run: str | None = "eval_run", draws: int = 200, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """One row a metric: before, after, delta, n_paired, n_unpaired, ci_lo, ci_hi, run_std, noise_band, within_noise, verdict, gain_verdict.

    ``verdict``: b_better or a_better where the interval of the mean paired delta (hashed Poisson bootstrap over
    tasks) excludes 0, no_difference where it doesn't, insufficient_data below ``MIN_TASKS`` paired tasks. ``gain_verdict`` reads a
    metric of ``lower_is_better`` the other way; numbers keep their sign. The noise band is the run-to-run
    std of both arms pooled, times sqrt(1 / runs before + 1 / runs after), times the t quantile at the pooled degrees of
    freedom; null without re-runs on both sides.
    """
    pairs = paired_metrics(rows, metrics, task=task, arm=arm)
    means = poisson_means(pairs, metrics, key=task, draws=draws, seed=seed)
    lo, hi = int(alpha / 2 * draws + 1e-9), int((1 - alpha / 2) * draws + 1e-9) - 1
    ends = means.agg(*(F.array_sort(F.collect_list(m)).alias(m) for m in metrics))  # as many values as draws
    runs = {r[0]: r[1] for r in rows.groupBy(arm).agg(F.countDistinct(run)).collect()} if run else {}
    n_b, n_a = runs.get("before", 0), runs.get("after", 0)
    both, d = [], lambda m: F.col(f"a_{m}") - F.col(f"b_{m}")
    for m in metrics:
        both += [F.avg(f"b_{m}").alias(f"before_{m}"), F.avg(f"a_{m}").alias(f"after_{m}"), F.avg(d(m)).alias(f"delta_{m}"), F.count(d(m)).alias(f"n_{m}"), F.count(F.coalesce(f"a_{m}", f"b_{m}")).alias(f"all_{m}")]
    whole = pairs.agg(*both).join(F.broadcast(ends))  # one row each
    each = []
    for m in metrics:
        sure = F.col(f"n_{m}") >= MIN_TASKS
        at = lambda k, m=m: F.get(F.col(m), F.lit(k))
        std, band = F.lit(None).cast("double"), F.lit(None).cast("double")
        if min(n_b, n_a) >= 2 and (found := pooled_run_std(rows.where(F.col(m).isNotNull()), arm=arm, run=run, task=task, metric=m).first()) and found["run_std"] is not None:
            std = F.lit(found["run_std"])
            band = F.lit(noise_band(found["run_std"], n_b, n_a, df=found["df"], level=1 - alpha))
        names = ("before", "after", "delta")
        each.append(F.struct(F.lit(m).alias("metric"), *(F.col(f"{x}_{m}").alias(x) for x in names), F.col(f"n_{m}").alias("n_paired"), (F.col(f"all_{m}") - F.col(f"n_{m}")).alias("n_unpaired"), F.when(sure, at(lo)).alias("ci_lo"), F.when(sure, at(hi)).alias("ci_hi"), std.alias("run_std"), band.alias("noise_band"), F.lit(m in lower_is_better).alias("lower_is_better")))
    out = whole.select(F.explode(F.array(*each)).alias("e")).select("e.*")
    verdict = F.when(F.col("ci_lo").isNull(), "insufficient_data").when(F.col("ci_lo") > 0, "b_better").when(F.col("ci_hi") < 0, "a_better").otherwise("no_difference")
    out = out.withColumn("within_noise", F.coalesce(F.abs("delta") < F.col("noise_band"), F.lit(False))).withColumn("verdict", verdict)
    turned = F.when(F.col("verdict") == "b_better", "a_better").when(F.col("verdict") == "a_better", "b_better").otherwise(F.col("verdict"))
    return out.withColumn("gain_verdict", F.when(F.col("lower_is_better"), turned).otherwise(F.col("verdict")))


def _word(gain: Column, noise: Column, replicated: Column) -> Column:
    """What became of a metric, in one word."""
    return (
        F.when(gain == "insufficient_data", gain).when((gain != "no_difference") & noise, "within_eval_noise").when(gain == "a_better", "moved_the_wrong_way")
        .when(gain == "b_better", F.when(replicated, "moved").otherwise("moved_unreplicated")).otherwise("no_change_detected")
    )


def delta_headline(report: DataFrame, *, target: str, guards: tuple[str, ...] = (), proxy: str | None = None) -> DataFrame:
    """One row: target_verdict, improved, slipped, regressions, over_optimized, not_comparable, ceiling, ok, headline.

    ``guards`` that get significantly worse fail the report; ``slipped`` are others that do. A ``proxy`` that improved
    where the target didn't, or whose interval lies above the target's, is over-optimised. Fewer than half of the
    tasks on both sides make the arms not comparable. The headline is PASS only for a gain the report supports.
    """
    loud = ~F.col("within_noise")
    names = lambda test: F.array_sort(F.collect_list(F.when(test & loud, F.col("metric"))))
    of = lambda m, x: F.max(F.when(F.col("metric") == m, x))
    guard = F.col("metric").isin(*guards) if guards else F.lit(False)
    worse, better = F.col("gain_verdict") == "a_better", F.col("gain_verdict") == "b_better"
    word = _word(F.col("gain_verdict"), F.col("within_noise"), F.col("run_std").isNotNull())
    share = F.col("n_paired") / (F.col("n_paired") + F.col("n_unpaired"))
    found = report.agg(
        F.coalesce(of(target, word), F.lit("target_not_measured")).alias("target_verdict"), names(better).alias("improved"), names(worse & ~guard).alias("slipped"), names(worse & guard).alias("regressions"),
        (of(proxy, F.col("gain_verdict")) == "b_better" if proxy else F.lit(False)).alias("_proxy_up"), (of(proxy, F.col("ci_lo")) > of(target, F.col("ci_hi")) if proxy else F.lit(False)).alias("_above"),
        F.coalesce(of(target, (share < LEAST_PAIRED).cast("int")) == 1, F.lit(False)).alias("not_comparable"), F.coalesce(of(target, F.col("before")) >= CEILING, F.lit(False)).alias("ceiling"),
    )
    moved = F.col("target_verdict").isin("moved", "moved_unreplicated")
    over = F.coalesce((F.col("_proxy_up") & ~moved) | F.col("_above"), F.lit(False))
    out = found.withColumn("over_optimized", over)
    ok = (F.size("regressions") == 0) & (F.col("target_verdict") != "moved_the_wrong_way") & ~F.col("not_comparable") & ~F.col("over_optimized")
    headline = F.when(F.col("not_comparable"), "NOT COMPARABLE").when(~F.col("ok"), "FAIL").when(moved, "PASS").otherwise("NO DIFFERENCE")
    return out.withColumn("ok", ok).withColumn("headline", headline).drop("_proxy_up", "_above")


def family_error(n_metrics: int, alpha: float = 0.05) -> float:
    """Chance that at least one of so many verdicts is a false alarm."""
    return 1 - (1 - alpha) ** n_metrics
