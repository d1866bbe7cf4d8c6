"""Row hygiene: repeats, near-duplicate prompts, lengths, truncation, reward correlations, tool outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.stats import pearson, wilson
from gradeloom.functions.text import looks_finished, normalised, words

NEAR_DUP_JACCARD = 0.8
MAX_SPREAD = 4.0


def dedupe_first(rows: DataFrame, key: list[Column], order: list[str], label: str | None = None) -> DataFrame:
    """Each row's place among its repeats (``copy`` 1 is kept) and whether its label differs from the kept one's.

    A window over the hash of the key: repeats of one key meet, but rows that nothing repeats don't.
    """
    w = Window.partitionBy(F.md5(F.to_json(F.array(*(k.cast("string") for k in key))).cast("binary"))).orderBy(*order)
    out = rows.withColumn("copy", F.row_number().over(w))
    return out if label is None else out.withColumn("label_conflict", (F.col("copy") > 1) & ~F.col(label).eqNullSafe(F.first(label).over(w)))


def is_truncated(columns: list[str], text: str = "final_text", least: int = 200) -> Column:
    """Length-capped by stamp (finish_reason, or a step marked truncated), said so by the verdict, or a long reply that just stops."""
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+$", "")
    found = (F.length(body) >= least) & ~looks_finished(F.col(text))
    if "reason" in columns:
        said = normalised(F.col("reason"))
        found = F.contains(said, F.lit("truncat")) | F.contains(said, F.lit("cut off")) | found
    if "steps" in columns:
        found = F.coalesce(F.exists("steps", lambda s: F.coalesce(s["truncated"], F.lit(False))), F.lit(False)) | found
    if "finish_reason" in columns:
        found = (F.coalesce(F.col("finish_reason"), F.lit("")) == "length") | found
    return found


def near_duplicate_pairs(prompts: DataFrame, *, key: str, text: str, threshold: float = NEAR_DUP_JACCARD) -> DataFrame:
    """(a, b, jaccard) of the texts whose token sets are that similar; empty sets are skipped.

    Texts of one token set are a class: its smallest key stands for it and is paired once with each other member
    (jaccard 1), so many copies make as many rows, not all pairs. Between classes the representatives are paired. An exact
    join by prefix: tokens are ranked from rare to frequent, and two sets of that similarity
    share one of their first size - ceil(threshold * size) + 1 tokens. So frequent tokens, which most
    texts have, hardly ever join.
    """
    whole = prompts.select(F.col(key).alias("_id"), F.array_sort(F.array_distinct(words(F.col(text)))).alias("_set")).where(F.size("_set") > 0)
    sets = whole.groupBy("_set").agg(F.min("_id").alias("_id"))
    copies = whole.join(sets.withColumnRenamed("_id", "_rep"), "_set").where("_id <> _rep").select(F.col("_rep").alias("a"), F.col("_id").alias("b"), F.lit(1.0).alias("jaccard"))
    each = sets.select("_id", F.size("_set").alias("_n"), F.explode("_set").alias("_t"))
    df = each.groupBy("_t").agg(F.count("*").alias("_df"))
    ranked = each.join(df, "_t").groupBy("_id", "_n").agg(F.transform(F.array_sort(F.collect_list(F.struct("_df", "_t"))), lambda x: x["_t"]).alias("_set"))
    need = F.ceil(F.col("_n") * threshold - 1e-9)
    prefix = ranked.select("_id", "_n", F.explode(F.slice("_set", F.lit(1), (F.col("_n") - need + 1).cast("int"))).alias("_t"))
    b = prefix.select(F.col("_id").alias("_id2"), F.col("_n").alias("_n2"), "_t")
    pairs = prefix.join(b, "_t").where((F.col("_id") < F.col("_id2")) & (F.least("_n", "_n2") >= threshold * F.greatest("_n", "_n2") - 1e-9)).select("_id", "_id2").distinct()
    both = pairs.join(sets, "_id").join(sets.select(F.col("_id").alias("_id2"), F.col("_set").alias("_set2")), "_id2")
    common = F.size(F.array_intersect("_set", "_set2"))
    score = common / (F.size("_set") + F.size("_set2") - common)
    return both.select(F.col("_id").alias("a"), F.col("_id2").alias("b"), score.alias("jaccard")).where(F.col("jaccard") >= threshold).unionByName(copies)


def length_report(rows: DataFrame, *, group: str, length: str, max_spread: float = MAX_SPREAD) -> DataFrame:
    """Median and longest length, and groups whose longest is more than ``max_spread`` times their median."""
    groups = rows.groupBy(group).agg(F.percentile(length, F.lit(0.5)).alias("m"), F.max(length).alias("x"), F.count("*").alias("k"))
    wide = groups.agg(F.sum(((F.col("k") >= 2) & (F.col("m") > 0) & (F.col("x") > max_spread * F.col("m"))).cast("long")).alias("wide_groups"), F.count("*").alias("n_groups"))
    # the median over all rows from counts of distinct lengths, not from rows sorted in one place
    counts = rows.groupBy(F.col(length).alias("v")).agg(F.count("*").alias("k"))
    whole = counts.agg(F.percentile("v", F.lit(0.5), F.col("k")).alias("median_length"), F.max("v").alias("max_length"))
    return wide.join(F.broadcast(whole))


def correlations(rows: DataFrame, reward: str, features: list[str], flag: float = 0.3) -> DataFrame:
    """(feature, r, flagged): Pearson of reward and each feature, all from one aggregation; null without variance."""
    x = lambda f: F.col(f).cast("double")
    there = lambda f: F.col(f).isNotNull() & F.col(reward).isNotNull()
    sums = []
    for f in features:
        for name, v in (("n", F.lit(1.0)), ("x", x(f)), ("y", x(reward)), ("xx", x(f) * x(f)), ("yy", x(reward) * x(reward)), ("xy", x(f) * x(reward))):
            sums.append(F.sum(F.when(there(f), v)).alias(f"{f}__{name}"))
    c = lambda f, k: F.coalesce(F.col(f"{f}__{k}"), F.lit(0.0))
    made = [F.struct(F.lit(f).alias("feature"), pearson(c(f, "n"), c(f, "x"), c(f, "y"), c(f, "xx"), c(f, "yy"), c(f, "xy")).alias("r")) for f in features]
    return rows.agg(*sums).select(F.explode(F.array(*made)).alias("e")).select("e.*").withColumn("flagged", F.coalesce(F.abs("r") >= flag, F.lit(False)))


def tool_outcomes(calls: DataFrame, *, tool: str, failed: Column, injected: Column | None = None) -> DataFrame:
    """Per tool: calls, ok, faults and injected faults."""
    n = lambda x: F.sum(x.cast("long"))
    return calls.groupBy(F.col(tool).alias("tool")).agg(F.count("*").alias("calls"), n(~failed).alias("ok"), n(failed).alias("faults"), n(failed & (injected if injected is not None else F.lit(False))).alias("injected"))


def dead_tools(outcomes: DataFrame, *, r_max: float = 0.3, min_calls: int = 3) -> DataFrame:
    """Tools whose success has an upper bound below ``r_max``, not explained by injected faults."""
    _, hi = wilson(F.col("ok"), F.col("calls"))
    return outcomes.withColumn("ok_hi", hi).where((F.col("calls") >= min_calls) & (F.col("ok_hi") < r_max) & (F.col("injected") < F.col("faults")))


def coverage_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and the distinct values of each column."""
    return rows.agg(F.count("*").alias("row_count"), *(F.countDistinct(c).alias(f"distinct_{c}") for c in columns))
