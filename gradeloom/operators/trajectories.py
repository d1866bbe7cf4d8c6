"""Conversations and steps: messages, loss masks, unrolling, stages, log-probabilities, policy updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_messages(turns: DataFrame, *, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, messages): the turns of each conversation in order (bounded by the conversation)."""
    made = turns.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content")))).alias("_m"))
    return made.select(conv, F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def loss_mask(messages: str = "messages", mode: str = "assistant") -> Column:
    """1 for each assistant message, or for the last one only (``final``)."""
    each = F.transform(messages, lambda m: (m["role"] == "assistant").cast("int"))
    if mode == "assistant":
        return each
    last = F.size(messages) - F.array_position(F.reverse(each), 1)
    return F.transform(messages, lambda m, i: ((m["role"] == "assistant") & (i == last)).cast("int"))


def unroll(rows: DataFrame, messages: str = "messages") -> DataFrame:
    """One row for each assistant turn: the messages up to it (``sample`` from 1)."""
    at = rows.select("*", F.posexplode(messages).alias("_i", "_m")).where("_m.role = 'assistant'")
    upto = F.slice(F.col(messages), F.lit(1), F.col("_i") + 1)
    sample = F.size(F.filter(upto, lambda m: m["role"] == "assistant"))
    return at.select(*(c for c in rows.columns if c != messages), upto.alias(messages), sample.alias("sample")).drop("_i", "_m")


def spoken_beats(messages: str = "messages") -> Column:
    """How often the speaker changes, system messages aside, plus 1."""
    said = F.filter(F.transform(messages, lambda m: m["role"]), lambda r: r != "system")
    changes = F.size(F.filter(F.transform(said, lambda r, i: (i > 0) & (r != F.get(said, i - 1))), lambda x: x))
    return F.when(F.size(said) > 0, changes + 1).otherwise(0)


def stage_report(rows: DataFrame, *, stage: str, task: str) -> DataFrame:
    """Per stage rows, tasks, and the tasks that evaluation also has (leaks of a training stage)."""
    per = rows.groupBy(stage, task).agg(F.count("*").alias("k"))
    held = per.where(F.col(stage) == "eval").select(task, F.lit(1).alias("_e"))
    return per.join(held, task, "left").groupBy(stage).agg(F.sum("k").cast("long").alias("row_count"), F.count("*").alias("tasks"), F.sum(F.when(F.col(stage) != "eval", F.coalesce("_e", F.lit(0))).otherwise(0)).cast("long").alias("leaks"))


def mean_kl(rows: DataFrame, reference: DataFrame, key: str, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Pooled sum(logprob - reference) / sum(tokens) over the rows that the reference has."""
    met = rows.join(reference.select(key, "ref_logprob"), key)
    return met.groupBy(*by).agg(F.count("*").alias("n"), (F.sum(F.col("logprob") - F.col("ref_logprob")) / F.sum("n_tokens")).alias("mean_kl"))


def nearest_rank(rows: DataFrame, value: str, quantiles: dict[str, float]) -> DataFrame:
    """Quantiles by nearest rank round(q (n - 1)), from counts of distinct values."""
    from pyspark.sql import Window

    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("k"))
    place = counts.select("v", F.sum("k").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("k").over(Window.partitionBy()).alias("n"))
    return place.agg(*(F.min(F.when(F.col("upto") > F.bround(F.lit(q) * (F.col("n") - 1), 0), F.col("v"))).alias(name) for name, q in quantiles.items()))


# -- policy updates: arrays of one trajectory, no explode, so a step is one projection ------------------


def gae(rewards: Column, values: Column, lam: Column, gamma: float = 1.0) -> Column:
    """Advantages A_t = r_t + gamma V_{t+1} - V_t + gamma lambda A_{t+1}, from the last token backwards."""
    n = F.size(values)
    delta = F.transform(F.sequence(F.lit(0), n - 1), lambda t: F.get(rewards, t) + gamma * F.coalesce(F.get(values, t + 1), F.lit(0.0)) - F.get(values, t))
    back = F.aggregate(F.reverse(delta), F.array().cast("array<double>"), lambda acc, d: F.concat(F.array(d + gamma * lam * F.coalesce(F.get(acc, F.lit(0)), F.lit(0.0))), acc))
    return F.when(n > 0, back).otherwise(F.array().cast("array<double>"))


def adaptive_lambda(tokens: Column, alpha: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - 1 / (F.lit(alpha) * F.greatest(tokens, F.lit(1))))


def ratios(logprobs: str, behaviour: str, clamp: float = 30.0) -> Column:
    return F.zip_with(logprobs, behaviour, lambda a, b: F.exp(F.greatest(F.lit(-clamp), F.least(F.lit(clamp), a - b))))


def flash_reinforce(batch: DataFrame, *, trust: float = 0.003, floor: float = 1e-6) -> DataFrame:
    """Critic-free update: batch-mean advantage, admitted where the mean Bernoulli KL of sampler and learner is within trust;
    coefficients A * ratio / (T * B). Needs reward, logprobs and behavior_logprobs."""
    mean = batch.agg(F.avg("reward").alias("_mean"), F.count("*").alias("_b"))
    p = lambda x: F.least(F.lit(1 - floor), F.greatest(F.lit(floor), F.exp(x)))
    kl = F.zip_with("behavior_logprobs", "logprobs", lambda b, a: p(b) * F.ln(p(b) / p(a)) + (1 - p(b)) * F.ln((1 - p(b)) / (1 - p(a))))
    out = batch.join(F.broadcast(mean)).withColumns({"advantage": F.col("reward") - F.col("_mean"), "mean_kl": F.aggregate(kl, F.lit(0.0), lambda s, x: s + x) / F.size("logprobs")})
    out = out.withColumn("admitted", F.col("mean_kl") <= trust)
    rho = ratios("logprobs", "behavior_logprobs")
    return out.withColumn("coefficients", F.transform(rho, lambda r: F.when(F.col("admitted"), F.col("advantage") * r / (F.size("logprobs") * F.col("_b"))).otherwise(0.0))).drop("_mean", "_b")


def single_rollout(batch: DataFrame, *, band: tuple[float, float] = (0.7, 6.0), alpha: float = 1.5, gamma: float = 1.0) -> DataFrame:
    """Critic update for one rollout a prompt: length-adaptive GAE, ratios outside the band masked, over all action tokens."""
    n = F.size("values")
    rewards = F.transform(F.sequence(F.lit(1), n), lambda t: F.when(t == n, F.col("reward")).otherwise(0.0))
    out = batch.withColumn("advantages", gae(rewards, F.col("values"), adaptive_lambda(n, alpha), gamma)).withColumn("_rho", ratios("logprobs", "behavior_logprobs"))
    total = out.agg(F.sum(F.size("values")).alias("_t"))
    out = out.join(F.broadcast(total))
    return out.withColumn("coefficients", F.zip_with("_rho", "advantages", lambda r, a: F.when((r > band[0]) & (r < band[1]), r * a).otherwise(0.0) / F.col("_t"))).drop("_rho", "_t")


def bounded_critic(batch: DataFrame, *, clip: float = 0.2, alpha: float = 0.4) -> DataFrame:
    """GAE with gamma 1; a token's clip range is clip over its behaviour probability: positive advantages count while the
    ratio is at most 1 + range, negative ones while it is at least 1 - range."""
    n = F.size("values")
    rewards = F.transform(F.sequence(F.lit(1), n), lambda t: F.when(t == n, F.col("reward")).otherwise(0.0))
    out = batch.withColumn("advantages", gae(rewards, F.col("values"), adaptive_lambda(n, alpha))).withColumn("_rho", ratios("logprobs", "behavior_logprobs"))
    half = F.transform("behavior_logprobs", lambda b: F.lit(clip) / F.exp(b))
    zipped = F.arrays_zip(F.col("_rho").alias("r"), F.col("advantages").alias("a"), half.alias("h"))
    return out.withColumn("coefficients", F.transform(zipped, lambda z: F.when(z["a"] >= 0, F.when(z["r"] <= 1 + z["h"], z["r"] * z["a"])).otherwise(F.when(z["r"] >= 1 - z["h"], z["r"] * z["a"])))).withColumn("coefficients", F.transform("coefficients", lambda x: F.coalesce(x, F.lit(0.0)))).drop("_rho")
