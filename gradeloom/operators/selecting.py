"""Training-set selection: supervised picks, whole groups for reinforcement, preference pairs, round-robins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.keys import stable_key

MIN_MARGIN = 1.0
#: Chosen is longer in this share of so many pairs, or in all of so few: a length confound.
CONFOUND_PAIRS, CONFOUND_SHARE, CONFOUND_ALL = 8, 0.75, 3


def best_per_prompt(rows: DataFrame, *, prompt: str, reward: str, signature: str, order: list[str], min_reward: float = 1.0, k: int = 1) -> DataFrame:
    """The ``k`` best rows of each prompt: by reward, then a stable hash of prompt and signature, then ``order``."""
    tie = stable_key(F.concat_ws("|", F.col(prompt).cast("string"), F.col(signature).cast("string")), "sft")
    w = Window.partitionBy(prompt).orderBy(F.desc(reward), tie, *order)
    return rows.where(F.col(reward) >= min_reward).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def round_robin(rows: DataFrame, bucket: str, order: list, target: int, salts: int = 32) -> DataFrame:
    """``target`` rows, one from each bucket in turn: larger buckets first, then by name; with ``pick``, its place.

    At most ``target`` rows of a bucket can be picked, so each salted part of a bucket is cut to its first
    ``target`` before the bucket's ranks are made: a bucket that holds most rows is never in one task.
    """
    part = F.pmod(F.xxhash64(*[c for c in rows.columns]), F.lit(salts))
    cut = rows.withColumn("_p", part).withColumn("_k", F.row_number().over(Window.partitionBy(bucket, "_p").orderBy(*order))).where(F.col("_k") <= target).drop("_k", "_p")
    turn = cut.withColumn("turn", F.row_number().over(Window.partitionBy(bucket).orderBy(*order)))
    sizes = rows.groupBy(bucket).agg(F.count("*").alias("bucket_size"))
    first = turn.join(sizes, bucket).orderBy("turn", F.desc("bucket_size"), bucket).limit(target)
    return first.withColumn("pick", F.row_number().over(Window.partitionBy().orderBy("turn", F.desc("bucket_size"), bucket)))  # at most target rows


def whole_groups(stats: DataFrame, *, task: str, bucket: str, target: int, lo: float = 0.2, hi: float = 0.8) -> DataFrame:
    """Tasks taken one a bucket in turn until their rows reach ``target``: the last one may overshoot.

    Buckets by size, then name; in a bucket in-band tasks first, then one of each distinct pass rate in turn, ties by hash.
    A task has a row at least, so ``target`` tasks are the most that can be taken.
    """
    rate = F.round(F.col("c") / F.col("n"), 4)
    ranked = stats.withColumns({"rate": rate, "in_band": (F.col("c") / F.col("n")).between(lo, hi), "tie": stable_key(F.col(task), "rl")})
    lap = F.row_number().over(Window.partitionBy(bucket, "in_band", "rate").orderBy("tie", task))
    ranked = ranked.withColumn("lap", lap).where(F.col("lap") <= target)
    taken = round_robin(ranked, bucket, [F.desc("in_band"), "lap", "rate", "tie", task], target)
    so_far = F.sum("n").over(Window.partitionBy().orderBy("pick").rowsBetween(Window.unboundedPreceding, -1))
    return taken.withColumn("before", F.coalesce(so_far, F.lit(0))).where(F.col("before") < target)


def preference_pairs(rows: DataFrame, *, task: str, score: str, length: str, key: str, order: list[str], min_margin: float = MIN_MARGIN) -> DataFrame:
    """One pair a task: the best row and, of those worse by the margin, the one closest in length, the better and earlier on ties."""
    best = rows.withColumn("_k", F.row_number().over(Window.partitionBy(task).orderBy(F.desc(score), *order))).where("_k = 1")
    best = best.select(task, F.col(key).alias("chosen"), F.col(score).alias("chosen_score"), F.col(length).alias("chosen_length"))
    met = rows.join(best, task).where(F.col("chosen_score") - F.col(score) >= min_margin)
    near = Window.partitionBy(task).orderBy(F.abs(F.col(length) - F.col("chosen_length")), F.desc(score), *order)
    out = met.withColumn("_k", F.row_number().over(near)).where("_k = 1")
    return out.select(task, "chosen", F.col(key).alias("rejected"), (F.col("chosen_score") - F.col(score)).alias("margin"), "chosen_length", F.col(length).alias("rejected_length"))


def preference_sets(rows: DataFrame, *, task: str, score: str, length: str, key: str, order: list[str], pairs: int = 1, min_margin: float = MIN_MARGIN) -> DataFrame:
    """Up to ``pairs`` pairs a task, with ``pair`` from 1: each round takes the best row that isn't used yet and the one closest to it in length.

    A round that finds nothing for a task ends it there, as lower rows have fewer rows below them still.
    """
    if min_margin <= 0:
        raise ValueError("equal scores carry no preference")
    left, out = rows.where(F.col(score).between(0, 1)), None
    for k in range(1, pairs + 1):
        made = preference_pairs(left, task=task, score=score, length=length, key=key, order=order, min_margin=min_margin).withColumn("pair", F.lit(k))
        out = made if out is None else out.unionByName(made)
        if k < pairs:
            used = made.select(task, F.explode(F.array("chosen", "rejected")).alias(key))
            left = left.join(used, [task, key], "left_anti")
    return out


def length_confound(pairs: DataFrame) -> DataFrame:
    """(n, chosen_longer, confounded): whether a trainer would learn length before behaviour."""
    longer = F.sum((F.col("chosen_length") > F.col("rejected_length")).cast("long"))
    out = pairs.agg(F.count("*").alias("n"), F.coalesce(longer, F.lit(0)).alias("chosen_longer"))
    share = F.try_divide("chosen_longer", "n")
    often = ((F.col("n") >= CONFOUND_PAIRS) & (share >= CONFOUND_SHARE)) | ((F.col("n") >= CONFOUND_ALL) & (F.col("chosen_longer") == F.col("n")))
    return out.withColumn("confounded", F.coalesce(often, F.lit(False)))


def spread_by(rows: DataFrame, value: Column, order: list[str]) -> DataFrame:
    """Round-robin over ascending distinct values: lap and value give the order."""
    out = rows.withColumn("value", F.round(value, 4))
    return out.withColumn("lap", F.row_number().over(Window.partitionBy("value").orderBy(*order)))


def balanced_pick(rows: DataFrame, *, prompt: str, reward: str, order: list[str], keep: int) -> DataFrame:
    """Per prompt half passes and half fails, topped up from the other side, earliest first; advantage over the pool's pass rate."""
    w = Window.partitionBy(prompt)
    passed = F.col(reward) >= 0.5
    out = rows.withColumns({"_p": passed, "pool_rate": F.avg(passed.cast("double")).over(w), "_np": F.sum(passed.cast("long")).over(w), "_n": F.count("*").over(w)})
    out = out.withColumn("_k", F.row_number().over(Window.partitionBy(prompt, "_p").orderBy(*order)))
    half = keep // 2
    fails = F.col("_n") - F.col("_np")
    take_pass = F.least(F.col("_np"), F.greatest(F.lit(half), F.lit(keep) - fails))
    take_fail = F.least(fails, F.lit(keep) - F.least(F.col("_np"), F.lit(half)))
    out = out.where(F.when(F.col("_p"), F.col("_k") <= take_pass).otherwise(F.col("_k") <= take_fail))
    return out.withColumn("advantage", F.col(reward) - F.col("pool_rate")).drop("_p", "_np", "_n", "_k")


def redistribute(rows: DataFrame, *, group: str, reward: str, factor: str, cap: float = 3.0, threshold: float = 0.5) -> DataFrame:
    """Group-relative advantages in which passes are scaled by their factor, keeping their sum, and centred again."""
    w = Window.partitionBy(group)
    a = F.col(reward) - F.avg(reward).over(w)
    out = rows.withColumns({"_a": a, "_pass": F.col(reward) >= threshold})
    total, scaled = F.sum(F.when(F.col("_pass"), F.col("_a"))).over(w), F.sum(F.when(F.col("_pass"), F.col("_a") * F.col(factor))).over(w)
    lam = F.least(F.try_divide(total, scaled), F.lit(cap))
    out = out.withColumn("_b", F.when(F.col("_pass") & lam.isNotNull(), lam * F.col(factor) * F.col("_a")).otherwise(F.col("_a")))
    return out.withColumn("advantage", F.col("_b") - F.avg("_b").over(w)).drop("_a", "_b", "_pass")


def rank_factors(rows: DataFrame, *, group: str, score: str, least: float = 0.5) -> DataFrame:
    """Linear factor from 1 (best of its group) to ``least``; ties share their mean rank."""
    w = Window.partitionBy(group)
    rank = F.rank().over(w.orderBy(F.desc(score))) - 1 + (F.count("*").over(Window.partitionBy(group, score)) - 1) / 2
    n = F.count("*").over(w)
    return rows.withColumn("factor", F.when(n > 1, 1 - (1 - least) * rank / (n - 1)).otherwise(1.0))
