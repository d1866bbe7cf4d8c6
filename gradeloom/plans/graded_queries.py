"""Queries over graded rollouts: pass@k, group signal, trims, tiers, comparisons, noise."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions.keys import holdout_share, row_key, task_key
from gradeloom.operators import compare, groups
from gradeloom.plans.tables import GRADED_SQL, ORDER, ROLLOUTS_SQL, STATS_SQL, graded, rollouts, table


def rounded(df, *keep):
    """Doubles to six places, so that sums in another order agree."""
    return df.select(*(F.round(c, 6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))


def stats(spark, sf):
    return groups.task_stats(graded(spark, sf))


def pass_at_k(spark, sf):
    return rounded(groups.pass_at(stats(spark, sf)))


def pass_at_least_k(spark, sf):
    """k isn't given: the least number of rollouts of a task that has two or more; short tasks of one outcome count as if they stayed so."""
    return rounded(groups.pass_at_default(stats(spark, sf), min_k=2, unanimous_short=True))


def pass_at_k_by_arm(spark, sf):
    return rounded(groups.pass_at(groups.task_stats(graded(spark, sf), by=("arm",)), by=("arm",)))


def group_signal(spark, sf):
    return rounded(groups.group_signal(stats(spark, sf)))


def task_pass_rates(spark, sf):
    return rounded(groups.pass_rates(stats(spark, sf)))


def _by_task(df):
    return rounded(df.groupBy("task_id").agg(F.count("*").alias("n"), F.sum("reward").cast("long").alias("c")))


def trim_unanimous(spark, sf):
    return _by_task(groups.trim_unanimous(graded(spark, sf)))


def trim_out_of_band(spark, sf):
    return _by_task(groups.trim_out_of_band(graded(spark, sf)))


def retire_solved(spark, sf):
    return _by_task(groups.retire_solved(graded(spark, sf)))


def curriculum_tiers(spark, sf):
    return rounded(groups.curriculum(stats(spark, sf)))


def group_stamps(spark, sf):
    return rounded(groups.stamp_groups(graded(spark, sf)).select("task_id", "group_id", "group_k", "group_n0", "group_n1", "group_mean", "group_std").distinct())


def calibration(spark, sf):
    kept = table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), "o_orderstatus")
    return rounded(groups.carry_calibration(kept, stats(spark, sf)))


def next_round(spark, sf):
    tasks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"))
    return groups.next_round(stats(spark, sf), tasks)


def metric_summary(spark, sf):
    return rounded(groups.metric_means(graded(spark, sf), ["reward", "cheap", "big", "score"], by=("arm",)))


def _pairs(spark, sf, by=()):
    return compare.paired(graded(spark, sf), by=by)


def compare_runs(spark, sf):
    return rounded(compare.compare_runs(_pairs(spark, sf)))


def compare_metrics(spark, sf):
    long = graded(spark, sf).select("task_id", "arm", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in ("reward", "cheap", "big")))).alias("x")).select("task_id", "arm", "x.*")
    return rounded(compare.compare_runs(compare.paired(long, metric="v", by=("metric",)), by=("metric",)))


def bootstrap_interval(spark, sf):
    pairs = _pairs(spark, sf).select("task_id", (F.col("mean_after") - F.col("mean_before")).alias("d"))
    return rounded(compare.percentile_interval(compare.resampled_means(pairs, "d", "task_id", 100, 7), 100))


def sign_flip_test(spark, sf):
    return rounded(compare.sign_flips(_pairs(spark, sf), "task_id", 100, 7))


def eval_variance(spark, sf):
    return rounded(compare.eval_variance(graded(spark, sf)))


def pooled_run_std(spark, sf):
    return rounded(compare.pooled_run_std(graded(spark, sf)))


def compare_by_slice(spark, sf):
    dims = table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("slice"))
    return rounded(compare.by_slice(_pairs(spark, sf).join(dims, "task_id"), "slice"))


def harness_shares(spark, sf):
    return rounded(compare.two_way(graded(spark, sf)))


def balanced_rollouts(spark, sf):
    rows = graded(spark, sf).withColumn("row_key", F.concat_ws("-", *ORDER[:3], F.col("l_extendedprice").cast("decimal(18,2)")))
    out = compare.balance(rows)
    return rounded(out.groupBy("task_id", "arm").agg(F.count("*").alias("n"), F.sum("reward").cast("long").alias("c"), F.sum("l_partkey").cast("long").alias("parts")))


def holdout_split(spark, sf):
    tasks = stats(spark, sf).withColumn("split", F.when(holdout_share(F.col("task_id")) < 0.2, "holdout").otherwise("train"))
    return tasks.groupBy("split").agg(F.count("*").alias("tasks"), F.sum("n").cast("long").alias("row_count"))


def keys_of_rows(spark, sf):
    rows = table(spark, sf, "documents").select(F.lit("").alias("scenario_id"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("t"), "doc_id")).alias("task_id"), F.col("text").alias("prompt"), F.lit("").alias("final_text"), "doc_id")
    return rows.select("doc_id", F.md5(task_key(rows.columns).cast("binary")).alias("task_key"), row_key(["prompt", "final_text"]).alias("row_key"))


def retry_success(spark, sf):
    """Share of tasks whose first pass comes at each rollout index."""
    first = rollouts(spark, sf).where("reward = 1.0").groupBy("task_id").agg(F.min("rollout_index").alias("first_pass"))
    return first.groupBy("first_pass").agg(F.count("*").alias("tasks"))


def headroom_by_priority(spark, sf):
    dims = table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), "o_orderpriority")
    return rounded(groups.pass_at(stats(spark, sf).join(dims, "task_id"), by=("o_orderpriority",)))


_POW = "CASE WHEN n >= 4 THEN greatest(c,0)*greatest(c-1,0)*greatest(c-2,0)*greatest(c-3,0)/(n*(n-1)*(n-2)*(n-3))::DOUBLE END"
_ANY = "CASE WHEN n >= 4 THEN 1 - greatest(n-c,0)*greatest(n-c-1,0)*greatest(n-c-2,0)*greatest(n-c-3,0)/(n*(n-1)*(n-2)*(n-3))::DOUBLE END"
_PASS = f"count(*) AS n_tasks, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(CASE WHEN n >= 4 THEN 1 ELSE 0 END) AS BIGINT) AS n_eligible, round(avg(c / n::DOUBLE), 6) AS pass_at_1, round(avg({_POW}), 6) AS pass_pow_k, round(avg({_ANY}), 6) AS pass_at_k, round(avg({_ANY}) - avg(c / n::DOUBLE), 6) AS headroom"
_WILSON = "round(greatest(0.0, ((c/n::DOUBLE) + 3.8416/(2*n)) / (1 + 3.8416/n) - 1.96*sqrt((c/n::DOUBLE)*(1-c/n::DOUBLE)/n + 3.8416/(4.0*n*n)) / (1 + 3.8416/n)), 6) AS ci_lo, round(least(1.0, ((c/n::DOUBLE) + 3.8416/(2*n)) / (1 + 3.8416/n) + 1.96*sqrt((c/n::DOUBLE)*(1-c/n::DOUBLE)/n + 3.8416/(4.0*n*n)) / (1 + 3.8416/n)), 6) AS ci_hi"
PAIRS_SQL = GRADED_SQL + """, pairs AS (
  SELECT task_id, avg(reward) FILTER (WHERE arm = 'before') AS mb, avg(reward) FILTER (WHERE arm = 'after') AS ma FROM graded GROUP BY task_id)"""
_COMPARE = "count(ma - mb) AS n_shared, CAST(sum(CASE WHEN ma IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_before, CAST(sum(CASE WHEN mb IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_after, round(avg(mb), 6) AS before, round(avg(ma), 6) AS after, round(avg(ma - mb), 6) AS delta, round(stddev_samp(ma - mb), 6) AS delta_sd, round(count(ma - mb) / count(*)::DOUBLE, 6) AS paired_share"
_HASH = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"

QUERIES = {f.__name__: f for f in (
    pass_at_k, pass_at_least_k, pass_at_k_by_arm, group_signal, task_pass_rates, trim_unanimous, trim_out_of_band, retire_solved, curriculum_tiers, group_stamps, calibration, next_round, metric_summary,
    compare_runs, compare_metrics, bootstrap_interval, sign_flip_test, eval_variance, pooled_run_std, compare_by_slice, harness_shares, balanced_rollouts, holdout_split, keys_of_rows, retry_success, headroom_by_priority,
)}

ORACLES = {
    "pass_at_k": f"WITH {STATS_SQL} SELECT {_PASS} FROM stats",
    "pass_at_least_k": f"""WITH {STATS_SQL}, k AS (SELECT coalesce(min(n) FILTER (WHERE n >= 2), 1) AS k FROM stats), p AS (SELECT n, c, k, n >= k AS able, n < k AND (c = 0 OR c = n) AS short FROM stats, k),
        v AS (SELECT n, c, able, short, CASE WHEN able THEN list_product(list_transform(range(k), lambda i: greatest(c - i, 0) / (n - i)::DOUBLE)) WHEN short THEN c / n::DOUBLE END AS pow, CASE WHEN able THEN 1 - list_product(list_transform(range(k), lambda i: greatest(n - c - i, 0) / (n - i)::DOUBLE)) WHEN short THEN c / n::DOUBLE END AS least_one FROM p)
        SELECT (SELECT CAST(k AS INTEGER) FROM k) AS k, count(*) AS n_tasks, CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (WHERE able) AS n_eligible, count(*) FILTER (WHERE short) AS n_imputed, round(avg(c / n::DOUBLE), 6) AS pass_at_1,
          round(avg(pow), 6) AS pass_pow_k, round(avg(least_one), 6) AS pass_at_k, round(avg(least_one) - avg(c / n::DOUBLE), 6) AS headroom FROM v""",
    "pass_at_k_by_arm": f"WITH {GRADED_SQL}, stats AS (SELECT arm, task_id, count(*) AS n, CAST(sum(reward) AS BIGINT) AS c FROM graded GROUP BY arm, task_id) SELECT arm, {_PASS} FROM stats GROUP BY arm",
    "group_signal": f"""WITH {STATS_SQL}, k AS (SELECT CAST(count(*) FILTER (WHERE n = 1) AS BIGINT) AS single, count(*) FILTER (WHERE n >= 2 AND c > 0 AND c < n) AS mixed, count(*) FILTER (WHERE n >= 2 AND c = 0) AS all_0,
        count(*) FILTER (WHERE n >= 2 AND c = n) AS all_1, count(*) FILTER (WHERE n >= 2 AND c > 0 AND c < n AND c / n::DOUBLE BETWEEN 0.2 AND 0.8) AS in_band, count(*) FILTER (WHERE n >= 2) AS multi FROM stats)
        SELECT *, round(mixed / multi::DOUBLE, 6) AS mixed_rate FROM k""",
    "task_pass_rates": f"WITH {STATS_SQL} SELECT task_id, n, c, round(c / n::DOUBLE, 6) AS pass_rate, {_WILSON} FROM stats",
    "trim_unanimous": f"WITH {STATS_SQL} SELECT * FROM stats WHERE NOT (n >= 2 AND (c = 0 OR c = n))",
    "trim_out_of_band": f"WITH {STATS_SQL} SELECT * FROM stats WHERE NOT (n >= 2 AND c > 0 AND c < n AND NOT (c / n::DOUBLE BETWEEN 0.2 AND 0.8))",
    "retire_solved": f"WITH {STATS_SQL} SELECT * FROM stats WHERE NOT (n >= 2 AND c / n::DOUBLE > 0.8)",
    "curriculum_tiers": f"""WITH {STATS_SQL}, s AS (SELECT task_id, c / n::DOUBLE AS r, CASE WHEN n < 2 THEN 'thin' WHEN c / n::DOUBLE > 0.8 THEN 'retired' WHEN c / n::DOUBLE < 0.2 THEN 'not_ready' ELSE 'trainable' END AS state FROM stats),
        t AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY r DESC, task_id) - 1 AS k, count(*) OVER (PARTITION BY state) AS total FROM s)
        SELECT task_id, round(r, 6) AS pass_rate, state, CASE WHEN state = 'trainable' THEN CAST(least(2, floor(k / (total / 3.0::DOUBLE))) AS INTEGER) END AS tier FROM t""",
    "group_stamps": f"WITH {GRADED_SQL} SELECT task_id, substr(sha1(CAST(task_id AS VARCHAR)), 1, 12) AS group_id, count(*) AS group_k, count(*) FILTER (WHERE reward < 0.5) AS group_n0, count(*) FILTER (WHERE reward > 0.5) AS group_n1, round(avg(reward), 6) AS group_mean, round(stddev_pop(reward), 6) AS group_std FROM graded GROUP BY task_id",
    "calibration": f"WITH {STATS_SQL}, w AS (SELECT task_id, n, round(c / n::DOUBLE, 6) AS pass_rate, {_WILSON} FROM stats) SELECT o_orderkey AS task_id, o_orderstatus, n, pass_rate, ci_lo, ci_hi FROM orders LEFT JOIN w ON task_id = o_orderkey",
    "next_round": f"WITH {STATS_SQL}, w AS (SELECT o_orderkey AS task_id, CASE WHEN n IS NULL THEN 'unknown' WHEN c / n::DOUBLE > 0.8 THEN 'solved' WHEN c / n::DOUBLE < 0.2 THEN 'unsolved' ELSE 'in_band' END AS why FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN stats ON task_id = o_orderkey) SELECT *, why IN ('unknown', 'in_band') AS kept FROM w",
    "metric_summary": f"""WITH {GRADED_SQL}, t AS (SELECT arm, task_id, unnest(['reward', 'cheap', 'big', 'score']) AS metric, unnest([avg(reward), avg(cheap), avg(big), avg(score)]) AS v, count(*) AS k FROM graded GROUP BY arm, task_id)
        SELECT arm, metric, round(avg(v), 6) AS mean, count(*) AS n_tasks, CAST(sum(k) AS BIGINT) AS n_rows FROM t GROUP BY arm, metric""",
    "compare_runs": f"WITH {PAIRS_SQL} SELECT {_COMPARE} FROM pairs",
    "compare_metrics": f"""WITH {GRADED_SQL}, pairs AS (SELECT task_id, unnest(['reward', 'cheap', 'big']) AS metric, unnest([avg(reward) FILTER (WHERE arm = 'before'), avg(cheap) FILTER (WHERE arm = 'before'), avg(big) FILTER (WHERE arm = 'before')]) AS mb,
        unnest([avg(reward) FILTER (WHERE arm = 'after'), avg(cheap) FILTER (WHERE arm = 'after'), avg(big) FILTER (WHERE arm = 'after')]) AS ma FROM graded GROUP BY task_id) SELECT metric, {_COMPARE} FROM pairs GROUP BY metric""",
    "bootstrap_interval": f"""WITH {PAIRS_SQL}, d AS (SELECT task_id, ma - mb AS d FROM pairs WHERE ma IS NOT NULL AND mb IS NOT NULL),
        u AS (SELECT draw, d, ({_HASH.format("'7:' || draw || ':' || task_id")} + 0.5) / 4294967296.0::DOUBLE AS u FROM d, (SELECT unnest(range(100)) AS draw)),
        k AS (SELECT draw, d, (u > 0.36787944117144233)::INT + (u > 0.7357588823428847)::INT + (u > 0.9196986029286058)::INT + (u > 0.9810118431238462)::INT + (u > 0.9963401531726563)::INT + (u > 0.9994058151824183)::INT + (u > 0.999916758850712)::INT + (u > 0.9999897508033253)::INT AS k FROM u),
        m AS (SELECT draw, sum(d * k) / sum(k) AS mean FROM k GROUP BY draw), o AS (SELECT list_sort(list(mean)) AS m FROM m) SELECT round(m[3], 6) AS ci_lo, round(m[97], 6) AS ci_hi FROM o""",
    "sign_flip_test": f"""WITH {PAIRS_SQL}, d AS (SELECT task_id, ma - mb AS d FROM pairs WHERE ma IS NOT NULL AND mb IS NOT NULL),
        m AS (SELECT draw, avg(CASE WHEN draw < 0 OR {_HASH.format("'7:' || draw || ':' || task_id")} % 2 = 0 THEN d ELSE -d END) AS mean FROM d, (SELECT unnest(range(-1, 100)) AS draw) GROUP BY draw),
        s AS (SELECT mean AS delta FROM m WHERE draw = -1)
        SELECT round(max(delta), 6) AS delta, count(*) FILTER (WHERE abs(mean) >= abs(delta) - 1e-12) AS extreme, round((count(*) FILTER (WHERE abs(mean) >= abs(delta) - 1e-12) + 1) / 101.0::DOUBLE, 6) AS p FROM m, s WHERE draw >= 0""",
    "eval_variance": f"""WITH {GRADED_SQL}, per AS (SELECT eval_run, task_id, avg(reward) AS v FROM graded GROUP BY ALL), r AS (SELECT eval_run, avg(v) AS m FROM per GROUP BY eval_run), c AS (SELECT task_id FROM per GROUP BY task_id HAVING count(*) = (SELECT count(*) FROM r))
        SELECT count(*) AS n_runs, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS run_std, round(min(m), 6) AS lowest, round(max(m), 6) AS highest, (SELECT count(*) FROM c) AS common_tasks FROM r""",
    "pooled_run_std": f"""WITH {GRADED_SQL}, r AS (SELECT arm, eval_run, avg(v) AS m FROM (SELECT arm, eval_run, task_id, avg(reward) AS v FROM graded GROUP BY ALL) GROUP BY ALL), s AS (SELECT arm, count(*) - 1 AS df, var_samp(m) AS v FROM r GROUP BY arm HAVING count(*) > 1)
        SELECT round(sqrt(sum(df * v) / sum(df)), 6) AS run_std, CAST(sum(df) AS BIGINT) AS df FROM s""",
    "compare_by_slice": f"""WITH {PAIRS_SQL}, j AS (SELECT o_orderpriority AS slice, mb, ma FROM pairs JOIN orders ON o_orderkey = task_id), g AS (
        SELECT slice, grouping(slice) = 1 AS overall, count(ma - mb) AS n_shared, avg(mb) AS before, avg(ma) AS after, avg(ma - mb) AS delta FROM j GROUP BY GROUPING SETS ((), (slice)))
        SELECT slice, n_shared, round(before, 6) AS before, round(after, 6) AS after, round(delta, 6) AS delta, n_shared < 6 AS low_n, n_shared >= 6 AND (after < 0.5 OR (delta <= 0 AND after < 0.9)) AS weak, overall FROM g WHERE overall OR n_shared > 0""",
    "harness_shares": f"""WITH {GRADED_SQL}, cells AS (SELECT harness, model, avg(v) AS v FROM (SELECT harness, model, task_id, avg(reward) AS v FROM graded GROUP BY ALL) GROUP BY ALL),
        x AS (SELECT v, avg(v) OVER (PARTITION BY harness) AS h, avg(v) OVER (PARTITION BY model) AS m, avg(v) OVER () AS g FROM cells), s AS (SELECT sum((h-g)*(h-g)) AS a, sum((m-g)*(m-g)) AS b, sum((v-h-m+g)*(v-h-m+g)) AS i FROM x)
        SELECT round(a/(a+b+i), 6) AS harness_share, round(b/(a+b+i), 6) AS model_share, round(i/(a+b+i), 6) AS interaction_share FROM s""",
    "balanced_rollouts": f"""WITH {GRADED_SQL}, k AS (SELECT *, concat_ws('-', l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(18,2))) AS row_key FROM graded), r AS (SELECT *, row_number() OVER (PARTITION BY task_id, arm ORDER BY md5('0:' || arm || ':' || row_key), row_key) AS i FROM k),
        z AS (SELECT task_id, min(c) AS least, count(*) AS sides FROM (SELECT task_id, arm, count(*) AS c FROM graded GROUP BY ALL) GROUP BY task_id)
        SELECT r.task_id, arm, count(*) AS n, CAST(sum(reward) AS BIGINT) AS c, CAST(sum(l_partkey) AS BIGINT) AS parts FROM r JOIN z ON r.task_id = z.task_id WHERE sides < 2 OR i <= least GROUP BY r.task_id, arm""",
    "holdout_split": f"WITH {STATS_SQL} SELECT CASE WHEN CAST('0x' || substr(sha256(CAST(task_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967295.0::DOUBLE < 0.2 THEN 'holdout' ELSE 'train' END AS split, count(*) AS tasks, CAST(sum(n) AS BIGINT) AS row_count FROM stats GROUP BY 1",
    "keys_of_rows": "SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN 't' || doc_id ELSE text END) AS task_key, substr(sha1(text || chr(31)), 1, 16) AS row_key FROM documents",
    "retry_success": f"WITH {ROLLOUTS_SQL}, f AS (SELECT task_id, CAST(min(rollout_index) AS INTEGER) AS first_pass FROM rollouts WHERE reward = 1.0 GROUP BY task_id) SELECT first_pass, count(*) AS tasks FROM f GROUP BY first_pass",
    "headroom_by_priority": f"WITH {STATS_SQL} SELECT o_orderpriority, {_PASS} FROM stats JOIN orders ON o_orderkey = task_id GROUP BY o_orderpriority",
}
