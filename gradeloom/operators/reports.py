"""Reports over runs: settings, answers, staleness, comparability, scan differences; task building and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.keys import environment_share, stable_key
from gradeloom.functions.text import split_reasoning


def run_config(rows: DataFrame, settings: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., setting, value, mixed): the value where it is the same in all rows."""
    both = rows.groupBy(*by).agg(*(x for s in settings for x in (F.min(F.col(s).cast("string")).alias(f"{s}__lo"), F.max(F.col(s).cast("string")).alias(f"{s}__hi"))))
    made = F.array(*(F.struct(F.lit(s).alias("setting"), F.when(F.col(f"{s}__lo") == F.col(f"{s}__hi"), F.col(f"{s}__lo")).alias("value"), (F.coalesce(F.col(f"{s}__lo") != F.col(f"{s}__hi"), F.lit(False))).alias("mixed")) for s in settings))
    return both.select(*by, F.explode(made).alias("e")).select(*by, "e.*")


def answer_counts(rows: DataFrame, text: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a reply, with a spoken answer beside reasoning markup, and with markup that never closes."""
    said, _, tail = split_reasoning(F.col(text))
    n = lambda x: F.sum(x.cast("long"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), n(F.coalesce(F.trim(text) != "", F.lit(False))).alias("replied"), n(said != "").alias("answered"), n(tail.isNotNull()).alias("unclosed"))


def staleness(rows: DataFrame, *, version: str, newest: str) -> DataFrame:
    """Rows of each policy version, their share, and whether it is behind the newest."""
    per = rows.groupBy(F.col(version).alias("version")).agg(F.count("*").alias("n"))
    return per.select("version", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"), (F.col("version") != F.lit(newest)).alias("stale"))  # one row a version


def comparability(pairs: DataFrame, rows: DataFrame, *, arm: str = "arm", reward: str = "reward", prompt_hash: str | None = None, user_model: str | None = None, min_share: float = 0.5) -> DataFrame:
    """(cause, found): why two arms may not be comparable: too few shared tasks, other prompts, other user models, ungraded rows
    that could carry the whole difference."""
    shared = pairs.agg((F.sum((F.col("mean_before").isNotNull() & F.col("mean_after").isNotNull()).cast("double")) / F.count("*")).alias("share"), F.avg(F.col("mean_after") - F.col("mean_before")).alias("delta"))
    sides = rows.groupBy(arm).agg(F.avg(F.col(reward).isNull().cast("double")).alias("ungraded"), *( [F.countDistinct(prompt_hash).alias("prompts"), F.min(prompt_hash).alias("prompt")] if prompt_hash else []), *([F.min(user_model).alias("user")] if user_model else []))
    bias = sides.agg(F.sum(F.col("ungraded") / F.greatest(1 - F.col("ungraded"), F.lit(1e-9))).alias("bias"), *([(F.countDistinct("prompt") > 1).alias("prompt_differs")] if prompt_hash else []), *([(F.countDistinct("user") > 1).alias("user_differs")] if user_model else []))
    one = shared.join(F.broadcast(bias))
    causes = [("paired_share", F.coalesce(F.col("share") < min_share, F.lit(True))), ("ungraded", F.coalesce(F.col("bias") >= F.abs("delta"), F.lit(False)) & (F.col("bias") > 0))]
    causes += [("prompt", F.col("prompt_differs"))] if prompt_hash else []
    causes += [("user_model", F.col("user_differs"))] if user_model else []
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("cause"), c.alias("found")) for k, c in causes))).alias("e")).select("e.*")


def scan_diff(before: DataFrame, after: DataFrame, floor: float) -> DataFrame:
    """(feature, before, after, shift, change): |rho| of two scans by feature, a missing one 0, and which crossed the floor."""
    met = before.select("feature", F.col("rho").alias("b")).join(after.select("feature", F.col("rho").alias("a")), "feature", "full_outer")
    b, a = F.abs(F.coalesce("b", F.lit(0.0))), F.abs(F.coalesce("a", F.lit(0.0)))
    return met.select("feature", b.alias("before"), a.alias("after"), (a - b).alias("shift"), F.when((b < floor) & (a >= floor), "gained").when((b >= floor) & (a < floor), "lost").otherwise("same").alias("change"))


def _tuple(items: Column) -> Column:
    """An array of texts as a tuple is written: one element keeps its comma."""
    return F.concat(F.lit("("), F.array_join(items, ", "), F.when(F.size(items) == 1, ",").otherwise(""), F.lit(")"))


def signature(steps: str, final: str, prompt: str = "prompt") -> Column:
    """Twelve hex digits that rows of equal behaviour share: tools with the provenance of each argument and the status of each call, a refusal bit, a length bucket.

    ``steps``: array of struct of tool, arguments (map) and result (JSON text). An argument's value, trimmed and in lower
    case, is user (in the prompt), derived (in an earlier result), invented, or absent where empty. A refusal is a reply with
    can't, cannot, unable or won't anywhere; the bucket is the number of words over 12, 12 at most. Steps without a tool don't count.
    """
    ask = F.lower(F.coalesce(F.col(prompt), F.lit("")))
    quoted = lambda x: F.concat(F.lit("'"), F.coalesce(x, F.lit("")), F.lit("'"))

    def origin(value: Column, prior: Column) -> Column:
        text = F.lower(F.trim(F.coalesce(value, F.lit(""))))
        return F.when(text == "", "absent").when(F.contains(ask, text), "user").when(F.contains(prior, text), "derived").otherwise("invented")

    def walk(s: Column, x: Column) -> Column:
        origins = F.transform(F.array_sort(F.map_entries(x["arguments"])), lambda e: F.concat(F.lit("("), quoted(e["key"]), F.lit(", "), quoted(origin(e["value"], s["prior"])), F.lit(")")))
        origins = F.coalesce(origins, F.array().cast("array<string>"))
        call = F.concat(F.lit("("), quoted(x["tool"]), F.lit(", "), _tuple(origins), F.lit(", "), quoted(F.get_json_object(x["result"], "$.status")), F.lit(")"))
        return F.struct(F.concat(s["prior"], F.lower(F.coalesce(x["result"], F.lit("null")))).alias("prior"), F.concat(s["said"], F.array(call)).alias("said"))

    calls = F.filter(F.coalesce(F.col(steps), F.filter(F.col(steps), lambda _: F.lit(False))), lambda x: F.coalesce(x["tool"] != "", F.lit(False)))
    said = F.aggregate(calls, F.struct(F.lit("").alias("prior"), F.array().cast("array<string>").alias("said")), walk)["said"]
    reply = F.lower(F.coalesce(F.col(final), F.lit("")))
    refused = F.contains(reply, F.lit("can't")) | F.contains(reply, F.lit("cannot")) | F.contains(reply, F.lit("unable")) | F.contains(reply, F.lit("won't"))
    words = F.size(F.filter(F.split(reply, r"\s+"), lambda w: w != ""))
    length = F.least(F.lit(12), F.floor(words / 12).cast("int"))
    payload = F.concat(F.lit("("), _tuple(F.coalesce(said, F.array().cast("array<string>"))), F.lit(", "), F.when(refused, "True").otherwise("False"), F.lit(", "), length.cast("string"), F.lit(")"))
    return F.substring(F.sha2(payload, 256), 1, 12)


def build_tasks(stats: DataFrame, *, task: str = "task_id", holdout: float = 0.2, lo: float = 0.2, hi: float = 0.8) -> DataFrame:
    """One task each with its solve rate and split by SHA-1; tasks outside the band go."""
    rate = F.col("c") / F.col("n")
    return stats.where(rate.between(lo, hi)).select(task, rate.alias("solve_rate"), F.when(environment_share(F.col(task)) < holdout, "holdout").otherwise("train").alias("split"))


def split_pseudo_production(rows: DataFrame, *, task: str, flaw: Column, order: str, fraction: float = 0.2, salt: str = "pseudo") -> DataFrame:
    """(task, n, place, chosen): whole tasks for a pseudo-production set. Tasks with the first row of some flaw come first,
    then others by hash, until the rows reach ceil(fraction * all).

    Sizes are summed in hash buckets before tasks, so that no single window ranks all tasks.
    """
    sizes = rows.groupBy(task).agg(F.count("*").alias("n"))
    first = rows.withColumn("_f", flaw).where("_f IS NOT NULL").groupBy("_f").agg(F.min_by(task, order).alias(task)).select(task).distinct().withColumn("_first", F.lit(0))
    ranked = sizes.join(first, task, "left").select(task, "n", F.coalesce("_first", F.lit(1)).alias("place"), stable_key(F.col(task), salt).alias("_h")).withColumn("_b", F.substring("_h", 1, 3))
    buckets = ranked.groupBy("place", "_b").agg(F.sum("n").alias("k"))  # at most 2 * 4096 rows
    w = Window.partitionBy().orderBy("place", "_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("place", "_b", F.coalesce(F.sum("k").over(w), F.lit(0)).alias("_start"), F.sum("k").over(Window.partitionBy()).alias("_all"))
    inside = Window.partitionBy("place", "_b").orderBy("_h", task).rowsBetween(Window.unboundedPreceding, -1)
    out = ranked.join(F.broadcast(starts), ["place", "_b"]).withColumn("before", F.col("_start") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return out.select(task, "n", "place", ((F.col("place") == 0) | (F.col("before") < F.ceil(F.lit(fraction) * F.col("_all")))).alias("chosen"))


def mix_by_tier(items: DataFrame, *, tier: str, order: list, n: int, hard: str, hard_share: float = 0.3) -> DataFrame:
    """``n`` items breadth-first over tiers, after the hard tier has its share."""
    hard_n = int(n * hard_share)
    turn = F.row_number().over(Window.partitionBy(tier).orderBy(*order))
    ranked = items.withColumn("turn", turn).where(F.col("turn") <= n)
    first = (F.col(tier) == hard) & (F.col("turn") <= hard_n)
    return ranked.orderBy(F.desc(first), "turn", tier).limit(n)
