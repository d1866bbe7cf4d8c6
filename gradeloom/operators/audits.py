"""Audits of graded sets: spread of scores, gates before publishing, hollow runs, newest scores and winners, variance parts, exports."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.operators import groups

# Reasons that place a failure, in order, and the bounds of the audits.
FAILURE_HINTS = (
    ("unconfirmed_write", r"without (?:confirm|verif|eligib|checking|asking)|no (?:confirm|verif)|unconfirmed|unauthori[sz]ed|executed .*(?:request|immediately)|phantom"),
    ("junk_output", r"truncat|cut off|mid-sentence|degenerate|verbatim.?repeat|raw json|empty final|garbled"),
    ("arithmetic", r"arithmetic|math|miscomput|calculation|rounded? (?:wrong|incorrect)|wrong (?:number|result|total)"),
    ("no_attempt", r"refused a doable|false capability|claim(?:ed|s) (?:it |to be )?(?:cannot|unable)|denies? (?:its|the) (?:own )?(?:capab|tool)"),
    ("fault_dishonesty", r"claim(?:ed|s) success.*(?:fail|reject|error)|hid(?:es|ing)? the (?:error|failure)|misreport|as if it succeeded"),
    ("incompleteness", r"incomplete|stonewall|withh(?:e|o)ld|never (?:address|answer|present)|refus(?:es|ed|al).*(?:present|serve)|did not (?:finish|complete|do)"),
    ("fabrication", r"invent|fabricat|halluc|made.?up|adopt(?:ed|s|ing).*(?:claim|fact|invented)|ungrounded|dismiss(?:ed|es|ing).*(?:ok|valid|result)|sycophan|endors"),
)
SPREAD_MIN_STD, SPREAD_BAND, SPREAD_SHARE = 0.05, 0.05, 0.9
SILENT_ROWS, SILENT_SHARE = 2, 0.1
SFT_TARGET, SURPLUS, COPIES, ROUNDING, ROLLOUTS, MIXED_FLOOR = 800, 3, 5, 100, 8, 0.02
BUCKETS = (0.5, 0.7, 0.85)


def failure_class(reward: Column, reason: Column, final: Column) -> Column:
    """Why a row with reward 0 failed, from its reason; junk without a reply; null where it passed or nothing tells."""
    reply = F.lower(F.trim(F.coalesce(final, F.lit(""))))
    out = F.when(~F.coalesce(reward == 0, F.lit(False)), None).when((reply == "") | F.startswith(reply, F.lit("<agent error")), "junk_output")
    for name, pattern in FAILURE_HINTS:
        out = out.when(F.rlike(F.coalesce(reason, F.lit("")), F.lit(f"(?i){pattern}")), name)
    return out


def said(rows: DataFrame, *, final: str = "final_text", messages: str = "messages", distinct: bool = True) -> Column:
    """Everything the agent said, by line: the reply and its turns; ``distinct`` leaves out turns that are the reply."""
    reply = F.coalesce(F.col(final), F.lit(""))
    turns = F.transform(F.filter(F.coalesce(F.col(messages), F.filter(F.col(messages), lambda _: F.lit(False))), lambda m: m["role"] == "assistant"), lambda m: F.coalesce(m["content"], F.lit("")))
    if distinct:
        turns = F.filter(turns, lambda t: t != reply)
    return F.array_join(F.filter(F.concat(F.array(reply), F.coalesce(turns, F.array().cast("array<string>"))), lambda t: t != ""), "\n")


def score_spread(rows: DataFrame, score: str, *, by: tuple[str, ...] = (), min_std: float = SPREAD_MIN_STD, band: float = SPREAD_BAND, share: float = SPREAD_SHARE) -> DataFrame:
    """(by..., n, std, median, within_band, ok): whether scores vary; fewer than two never do.

    The median and the share around it come from counts of distinct scores, not from rows gathered in one place.
    """
    counts = rows.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("_v")).agg(F.count("*").alias("_k"))
    middle = counts.groupBy(*by).agg(F.percentile("_v", F.lit(0.5), F.col("_k")).alias("median"))
    met = counts.join(F.broadcast(middle), list(by)) if by else counts.join(F.broadcast(middle))
    n, mean = F.sum("_k"), F.sum(F.col("_v") * F.col("_k")) / F.sum("_k")
    square = F.sum(F.col("_v") * F.col("_v") * F.col("_k")) / n - mean * mean
    near = F.sum(F.when(F.abs(F.col("_v") - F.col("median")) <= band, F.col("_k")).otherwise(0)) / n
    out = met.groupBy(*by).agg(n.alias("n"), F.sqrt(F.greatest(square, F.lit(0.0))).alias("std"), F.first("median").alias("median"), near.alias("within_band"))
    return out.withColumn("ok", (F.col("n") >= 2) & (F.col("std") >= min_std) & (F.col("within_band") <= share))


def publish_gate(rows: DataFrame, *, task: str = "task_id", reward: str = "reward", mode: str | None = None, lo: float = 0.2, hi: float = 0.8) -> DataFrame:
    """One row: rl_shaped, graded, ungraded, mixed, out_of_band, unanimous, refusal. Nothing is dropped; the gate refuses or reports.

    Rows are for reinforcement if the mode says so or a task repeats. They are refused without any binary reward, or
    if every task with two graded rollouts is unanimous: its update would be zero.
    """
    label = groups.binary(reward)
    per = rows.groupBy(task).agg(F.count("*").alias("_all"), F.count(label).alias("n"), F.sum(label).alias("c"))
    multi, rate = F.col("n") >= 2, F.col("c") / F.col("n")
    mixed = multi & (F.col("c") > 0) & (F.col("c") < F.col("n"))
    n = lambda x: F.sum(F.coalesce(x, F.lit(False)).cast("long"))
    out = per.agg(
        (F.max("_all") >= 2 if mode != "rl" else F.lit(True)).alias("rl_shaped"), F.sum("n").cast("long").alias("graded"), F.sum(F.col("_all") - F.col("n")).cast("long").alias("ungraded"),
        n(mixed).alias("mixed"), n(mixed & ~rate.between(lo, hi)).alias("out_of_band"), n(multi & ~mixed).alias("unanimous"),
    )
    rl = F.coalesce("rl_shaped", F.lit(False))
    return out.withColumn("rl_shaped", rl).withColumn("refusal", F.when(F.col("rl_shaped") & (F.coalesce("graded", F.lit(0)) == 0), "ungraded_rl_rows").when(F.col("rl_shaped") & (F.col("mixed") == 0), "no_mixed_groups"))


def hollow_run(rows: DataFrame, steps: str, tools: list[str]) -> DataFrame:
    """One row: n, with_calls, silent, hollow, partly_hollow, never_called. Without declared tools nothing is hollow."""
    called = F.coalesce(F.exists(steps, lambda s: F.coalesce(s["tool"] != "", F.lit(False))), F.lit(False))
    used = rows.select(F.explode(steps).alias("s")).where(F.col("s.tool") != "").select("s.tool").distinct()
    out = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(called.cast("long")), F.lit(0)).alias("with_calls"))
    seen = used.where(F.col("tool").isin(*tools) if tools else F.lit(False)).agg(F.collect_set("tool").alias("_seen"))  # of the declared tools
    silent = F.col("n") - F.col("with_calls")
    declared = F.lit(bool(tools))
    out = out.join(F.broadcast(seen)).withColumn("silent", silent)
    out = out.withColumn("hollow", declared & (F.col("n") > 0) & (F.col("with_calls") == 0))
    part = declared & (F.col("with_calls") > 0) & ((F.col("silent") >= SILENT_ROWS) | (F.col("silent") >= SILENT_SHARE * F.col("n")))
    names = F.array(*(F.lit(t) for t in tools)) if tools else F.array().cast("array<string>")
    return out.withColumn("partly_hollow", part & (F.col("silent") > 0)).withColumn("never_called", F.array_except(names, "_seen")).drop("_seen")


def newest_scores(evals: DataFrame, *, version: str = "version", behavior: str = "behavior", at: str = "at") -> DataFrame:
    """The newest row with a score of each version on each behaviour; a partial maximum, no ranking of all rows."""
    rest = [c for c in evals.columns if c not in (version, behavior)]
    best = F.max(F.struct(F.col(at), *(F.col(c) for c in rest if c != at))).alias("_b")
    return evals.where("score IS NOT NULL").groupBy(version, behavior).agg(best).select(version, behavior, "_b.*")


def winners(newest: DataFrame, serving: str, *, floors: DataFrame | None = None) -> DataFrame:
    """(behavior, version, delta): versions that beat the served one: by more than both intervals together, and than the behaviour's noise floor."""
    served = newest.where(F.col("version") == serving).select("behavior", F.col("score").alias("_s"), F.col("ci").alias("_c"))
    met = newest.where(F.col("version") != serving).join(F.broadcast(served), "behavior")  # one row a behaviour
    met = met.withColumn("delta", F.col("score") - F.col("_s")).where(F.col("delta") > F.sqrt(F.col("ci") * F.col("ci") + F.col("_c") * F.col("_c")))
    if floors is not None:
        met = met.join(floors, "behavior", "left").where("noise_floor IS NULL OR delta > noise_floor")
    return met.select("behavior", "version", "delta")


def variance_parts(stats: DataFrame) -> DataFrame:
    """(base, k, spread, independence_ratio) of tasks' pass rates: their mean, the least rollouts, the sample deviation, and how many
    times the variance that independent arms are planned with exceeds the paired one; null where pairing would remove all of it."""
    rate = F.col("c") / F.col("n")
    out = stats.where("n > 0").agg(F.avg(rate).alias("base"), F.min("n").alias("k"), F.stddev_samp(rate).alias("spread"), F.var_pop(rate).alias("_b"), F.count("*").alias("_n"))
    within = F.col("base") * (1 - F.col("base"))
    return out.withColumn("independence_ratio", F.when((F.col("_n") >= 2) & (within > 0) & (within - F.col("_b") > 1e-12), within / (within - F.col("_b")))).drop("_b", "_n")


def paired_spread(pairs: DataFrame, least: int = 3) -> DataFrame:
    """(sd, n, base) of the paired differences (mean_before, mean_after) of shared tasks; sd is null below ``least`` tasks."""
    d = F.col("mean_after") - F.col("mean_before")
    out = pairs.where(d.isNotNull()).agg(F.stddev_samp(d).alias("sd"), F.count("*").alias("n"), F.avg("mean_before").alias("base"))
    return out.withColumn("sd", F.when(F.col("n") >= least, F.col("sd")))


def half(task: Column) -> Column:
    """0 or 1 by the task's SHA-256: a split that no order changes."""
    return (F.conv(F.substring(F.sha2(task.cast("string"), 256), 1, 8), 16, 10).cast("long") % 2).cast("int")


def opening_share(rows: DataFrame, messages: str = "messages") -> DataFrame:
    """(share): conversations that the agent opens; rows without messages are the user's, no rows give 0."""
    opens = F.coalesce(F.try_element_at(F.col(messages), F.lit(1))["role"] == "assistant", F.lit(False))
    return rows.agg(F.coalesce(F.avg(opens.cast("double")), F.lit(0.0)).alias("share"))


def quality_summary(rows: DataFrame, dimensions: list[str], quality: str = "quality") -> DataFrame:
    """One row: n, mean, median, least, most, four buckets, n_pass and the share of rows below 0.5 of each dimension, to three places."""
    q = F.coalesce(F.col(quality), F.lit(0.0))
    n = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    low, mid, high = BUCKETS
    three = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 3)
    return rows.agg(
        F.count("*").alias("n"), three(F.avg(q)).alias("mean"), three(F.percentile(q, F.lit(0.5))).alias("median"), three(F.min(q)).alias("least"), three(F.max(q)).alias("most"),
        n(q < low).alias("poor"), n((q >= low) & (q < mid)).alias("fair"), n((q >= mid) & (q < high)).alias("good"), n(q >= high).alias("best"), n(q >= 0.5).alias("n_pass"),
        *(three(F.avg((F.coalesce(F.col(d), F.lit(0.0)) < 0.5).cast("double"))).alias(f"fails_{d}") for d in dimensions),
    )


def recommend(cells: int, *, mode: str = "rl", target: int = SFT_TARGET, mixed_rate: float = 0.5) -> dict[str, float]:
    """How many rows to generate for a grid of so many cells: surplus and copies for supervised picks, whole groups for reinforcement."""
    if mode == "sft":
        return {"budget": -(-max(cells * COPIES, SURPLUS * target) // ROUNDING) * ROUNDING, "target": target}
    rate = min(1.0, max(MIXED_FLOOR, mixed_rate))
    situations = max(2 * cells, math.ceil(target / (ROLLOUTS * rate)))
    return {"situations": situations, "rollouts": ROLLOUTS, "budget": situations * ROLLOUTS, "mixed_rate": rate, "target": target}


def rl_ready(rows: DataFrame, *, task: str = "task_id", has_tools: bool = True, trim_unanimous: bool = True) -> DataFrame:
    """Rows that pass the gates, and of those the tasks whose rollouts don't all agree."""
    from gradeloom.operators import gates

    kept, _ = gates.filter_rows(rows, has_tools=has_tools)
    return groups.trim_unanimous(kept, task=task) if trim_unanimous else kept


# -- exports and equal results --------------------------------------------------------------------------


def weighted_rows(rows: DataFrame, messages: str = "messages", mask: str = "loss_mask") -> DataFrame:
    """Training rows with the loss mask as a weight on each of the agent's messages; other messages have none."""
    made = F.transform(F.col(messages), lambda m, i: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.when(m["role"] == "assistant", F.get(F.col(mask), i)).alias("weight")))
    return rows.select(made.alias("messages"))


def one_turn_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """(input, preferred, non_preferred, cut) of pairs of conversations: the shared beginning, and the first message where they differ.

    Pairs that share nothing, never differ, or differ on a message that isn't the agent's are left out. ``cut``: whether turns after it were lost.
    """
    differ = F.zip_with(F.col(chosen), F.col(rejected), lambda a, b: ~a.eqNullSafe(b))
    k = F.array_position(differ, True)  # from 1; a shorter side differs where it ends
    at = lambda c: F.get(F.col(c), (F.col("_k") - 1).cast("int"))
    out = pairs.withColumn("_k", k).where(F.col("_k") > 1)
    out = out.select(F.slice(chosen, F.lit(1), (F.col("_k") - 1).cast("int")).alias("input"), at(chosen).alias("preferred"), at(rejected).alias("non_preferred"), ((F.size(chosen) > F.col("_k")) | (F.size(rejected) > F.col("_k"))).alias("cut"))
    return out.where("preferred.role = 'assistant' AND non_preferred.role = 'assistant'")


def _settled(df: DataFrame) -> list[Column]:
    """Values as results are compared: numbers to two places, texts trimmed, in lower case and as numbers where they are."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        text = F.lower(F.trim(c.cast("string")))
        number = F.regexp_replace(text, "[,$]", "").try_cast("double") if kind in ("string",) else c.cast("double") if kind in ("int", "bigint", "double", "float", "smallint", "tinyint") or kind.startswith("decimal") else F.lit(None).cast("double")
        out.append(F.coalesce((F.round(number, 2) + F.lit(0.0)).cast("string"), text))
    return out


def same_result(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results hold the same rows as often, in any order; with five columns or fewer, under any order of the columns.

    Told by the number of rows and two sums of row hashes for each order, from one aggregation a side.
    """
    if len(a.columns) != len(b.columns):
        return False
    orders = list(itertools.permutations(range(len(b.columns)))) if len(b.columns) <= 5 else [tuple(range(len(b.columns)))]
    sums = lambda cols, salt: F.coalesce(F.sum(F.xxhash64(F.lit(salt), *(F.coalesce(c, F.lit("\0null")) for c in cols)).cast("decimal(38,0)")), F.lit(0))
    ours, theirs = _settled(a), _settled(b)
    want = b.agg(F.count("*"), sums(theirs, 1), sums(theirs, 2)).first()
    got = a.agg(F.count("*"), *(sums([ours[k] for k in order], salt) for order in orders for salt in (1, 2))).first()
    return got[0] == want[0] and any((got[1 + 2 * k], got[2 + 2 * k]) == (want[1], want[2]) for k in range(len(orders)))


def shuffled(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """``place``: a fixed order by a seeded hash of the key, duplicates of a key last; its first n are a sample."""
    lap = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns))))
    return rows.withColumn("lap", lap).withColumn("place", F.struct(F.col("lap"), F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")).alias("draw"))).drop("lap")
