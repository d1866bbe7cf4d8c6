"""Judges against gold: confusion, kappa, length sensitivity, annotators, rankings; labels onto rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.stats import kappa, wilson


def agreement(rows: DataFrame, *, judged: str = "reward", gold: str = "gold_reward", by: tuple[str, ...] = ()) -> DataFrame:
    """Confusion counts, agreement, kappa, leak rate (passed though gold failed) and miss rate (failed though gold passed)."""
    j, g = F.col(judged) == 1, F.col(gold) == 1
    ok = F.col(judged).isin(0, 1) & F.col(gold).isin(0, 1)
    n = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0)).cast("long")
    out = rows.where(ok).groupBy(*by).agg(n(j & g).alias("tp"), n(j & ~g).alias("fp"), n(~j & g).alias("fn"), n(~j & ~g).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    lo, _ = wilson(tp + tn, total)
    return out.withColumns({"agreement": F.try_divide(tp + tn, total), "agreement_lo": lo, "kappa": kappa(tp, fp, fn, tn), "leak_rate": F.try_divide(fp, fp + tn), "miss_rate": F.try_divide(fn, fn + tp)})


def judge_vs_gold(judged: DataFrame, gold: DataFrame, key: str, *, reward: str = "reward", label: str = "label", order: str | None = None) -> DataFrame:
    """Judged rows beside the first gold label of their key."""
    first = gold.groupBy(key).agg(F.min_by(label, order or label).alias("gold_reward"))
    return judged.join(first, key).select(key, F.col(reward).alias("reward"), "gold_reward")


def length_sensitivity(rows: DataFrame, *, judged: str, gold: str, length: str) -> DataFrame:
    """Pass rate of replies up to and above the median length within each gold label, and the gap.

    The median is the upper middle element: from counts of lengths, so no label's rows are sorted together.
    """
    counts = rows.groupBy(gold, length).agg(F.count("*").alias("k"))
    w = Window.partitionBy(gold).orderBy(length).rowsBetween(Window.unboundedPreceding, 0)  # rows are distinct lengths
    place = counts.select(gold, length, F.sum("k").over(w).alias("upto"), F.sum("k").over(Window.partitionBy(gold)).alias("n"))
    median = place.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(gold).agg(F.min(length).alias("median_length"))
    split = rows.join(F.broadcast(median), gold)
    long = F.col(length) > F.col("median_length")
    rate = lambda x: F.avg(F.when(x, F.col(judged).cast("double")))
    out = split.groupBy(gold, "median_length").agg(rate(~long).alias("short_rate"), rate(long).alias("long_rate"), F.count("*").alias("n"))
    return out.withColumn("gap", F.col("long_rate") - F.col("short_rate"))


def rank_judges(scored: DataFrame, judge: str, *, min_agreement: float = 0.8, min_kappa: float = 0.6) -> DataFrame:
    """One row a judge: by kappa, then agreement, nulls last; ok where both floors are cleared; best is the first ok one, else the first."""
    order = Window.partitionBy().orderBy(F.desc_nulls_last("kappa"), F.desc_nulls_last("agreement"), judge)  # one row a judge
    ok = F.coalesce((F.col("agreement_lo") >= min_agreement) & (F.col("kappa") >= min_kappa), F.lit(False))
    out = scored.withColumns({"ok": ok, "rank": F.row_number().over(order)})
    best = F.coalesce(F.min(F.when(F.col("ok"), F.col("rank"))).over(Window.partitionBy()), F.lit(1))
    return out.withColumn("best", F.col("rank") == best)


def annotator_agreement(labels: DataFrame, *, row: str = "row_key", annotator: str = "annotator", label: str = "label", ts: str = "ts") -> DataFrame:
    """(a, b, n, agreement, kappa) of every two annotators, from the last label of each on each row."""
    last = labels.groupBy(row, annotator).agg(F.max_by(label, ts).alias("l"))
    pairs = last.select(row, F.col(annotator).alias("a"), F.col("l").alias("x")).join(last.select(row, F.col(annotator).alias("b"), F.col("l").alias("y")), row).where("a < b")
    return agreement(pairs, judged="x", gold="y", by=("a", "b")).select("a", "b", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"), "agreement", "kappa")


def attach_labels(rows: DataFrame, labels: DataFrame, keys: list, *, row: str = "row_key", name: str = "name", label: str = "label") -> DataFrame:
    """Each row's majority label (a tie unsets it) and its numbers of votes.

    ``keys``: the spellings under which a label may name a row. A name that fits several rows labels none
    and counts as ambiguous, one that fits none is unmatched: both are returned with a null row.
    """
    names = rows.select(row, F.explode(F.array_distinct(F.array(*(k.cast("string") for k in keys)))).alias(name)).where(f"{name} IS NOT NULL")
    once = names.groupBy(name).agg(F.min(row).alias(row), F.countDistinct(row).alias("fits"))
    met = labels.join(once, name, "left").withColumn(row, F.when(F.col("fits") == 1, F.col(row)))
    votes = met.groupBy(row).agg(F.sum((F.col(label) == 1).cast("long")).alias("yes"), F.sum((F.col(label) == 0).cast("long")).alias("no"), F.sum((F.coalesce("fits", F.lit(0)) > 1).cast("long")).alias("ambiguous"), F.sum(F.col("fits").isNull().cast("long")).alias("unmatched"))
    return votes.withColumn("gold_reward", F.when(F.col(row).isNotNull(), F.when(F.col("yes") > F.col("no"), 1).when(F.col("yes") < F.col("no"), 0)))
