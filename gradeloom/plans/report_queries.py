"""Queries of reports, task building and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import compare, delta, groups, reports, scanning
from gradeloom.plans.graded_queries import rounded
from gradeloom.plans.tables import GRADED_SQL, STATS_SQL, graded, table


def run_settings(spark, sf):
    rows = graded(spark, sf).withColumn("fixed", F.lit("t0"))
    return reports.run_config(rows, ["harness", "model", "fixed"], by=("arm",))


def answered_shares(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.when(F.col("doc_id") % 4 == 0, F.lit("<think>so</think>")).when(F.col("doc_id") % 4 == 1, F.lit("ok <think>more")).when(F.col("doc_id") % 4 == 2, F.lit(" ")).otherwise(F.col("text")).alias("t"))
    return reports.answer_counts(d, "t", by=("lang",))


def policy_staleness(spark, sf):
    return rounded(reports.staleness(table(spark, sf, "orders"), version="o_orderstatus", newest="O"))


def comparability_causes(spark, sf):
    rows = graded(spark, sf).withColumn("reward", F.when(F.col("reply_length") % 10 != 0, F.col("reward"))).withColumn("prompt_hash", F.lit("p")).withColumn("user_model", F.col("model"))
    return reports.comparability(compare.paired(rows), rows, prompt_hash="prompt_hash", user_model="user_model")


def hack_scan_changes(spark, sf):
    rows = graded(spark, sf).withColumn("length", F.col("reply_length").cast("double"))
    scan = lambda arm, fs: scanning.within_rho(rows.where(F.col("arm") == arm), fs, task="task_id", reward="reward")
    return rounded(reports.scan_diff(scan("before", ["cheap", "big", "score"]), scan("after", ["cheap", "big", "length"]), 0.01))


def behaviour_signatures(spark, sf):
    o = table(spark, sf, "orders")
    step = lambda tool, key, arg, result: F.struct(F.lit(tool).alias("tool"), F.create_map(F.lit(key), arg).alias("arguments"), result.alias("result"))
    k = F.col("o_orderkey")
    steps = F.array(step("find", "q", F.when(k % 2 == 0, "X1").otherwise("x9"), F.lit('{"id": "id77", "status": "ok"}')), step("open", "id", F.when(k % 3 == 0, "id77").otherwise("id88"), F.when(k % 5 == 0, '{"status": "error"}').otherwise("{}")))
    rows = o.select("o_orderkey", F.lit("about x1 please").alias("prompt"), steps.alias("steps"), F.when(k % 7 == 0, "It cannot be done").otherwise("done").alias("final_text"))
    return rows.select("o_orderkey", reports.signature("steps", "final_text").alias("signature"))


def _delta(spark, sf):
    return delta.delta_report(graded(spark, sf), ["reward", "cheap", "big"], lower_is_better=("big",), draws=100)


def delta_report(spark, sf):
    return rounded(_delta(spark, sf))


def delta_headline(spark, sf):
    out = delta.delta_headline(_delta(spark, sf), target="reward", guards=("cheap",), proxy="big")
    return out.select(*(F.array_join(c, ",").alias(c) if c in ("improved", "slipped", "regressions") else F.col(c) for c in out.columns))


def built_tasks(spark, sf):
    return rounded(reports.build_tasks(groups.task_stats(graded(spark, sf))))


def pseudo_production(spark, sf):
    rows = graded(spark, sf).withColumn("place", F.struct("task_id", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    flaw = F.when(F.col("reward") == 0, F.concat_ws("-", "model", (F.col("reply_length") % 10).cast("string")))
    return reports.split_pseudo_production(rows, task="task_id", flaw=flaw, order="place")


def tier_mix(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return reports.mix_by_tier(o, tier="o_orderpriority", order=["o_orderkey"], n=200, hard="1-URGENT").select("o_orderkey", "o_orderpriority", "turn")


QUERIES = {f.__name__: f for f in (run_settings, answered_shares, policy_staleness, comparability_causes, hack_scan_changes, behaviour_signatures, delta_report, delta_headline, built_tasks, pseudo_production, tier_mix)}

_RHO = "SELECT feature, sum(xc*rc) / sqrt(sum(xc*xc) * sum(rc*rc)) AS rho FROM c WHERE arm = '{0}' AND feature IN ({1}) GROUP BY feature HAVING count(*) FILTER (WHERE x <> 0) >= 20"
_DRAW = "(CAST('0x' || substr(md5('0:' || draw || ':' || task_id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE"
_DELTA = f"""{GRADED_SQL}, m AS (SELECT arm, eval_run, task_id, unnest(['reward', 'cheap', 'big']) AS metric, unnest([reward, cheap, big]) AS v FROM graded),
  pairs AS (SELECT metric, task_id, avg(v) FILTER (WHERE arm = 'before') AS b, avg(v) FILTER (WHERE arm = 'after') AS a FROM m GROUP BY metric, task_id),
  u AS (SELECT draw, task_id, {_DRAW} AS u FROM (SELECT DISTINCT task_id FROM graded), (SELECT unnest(range(100)) AS draw)),
  k AS (SELECT draw, task_id, (u > 0.36787944117144233)::INT + (u > 0.7357588823428847)::INT + (u > 0.9196986029286058)::INT + (u > 0.9810118431238462)::INT + (u > 0.9963401531726563)::INT + (u > 0.9994058151824183)::INT + (u > 0.999916758850712)::INT + (u > 0.9999897508033253)::INT AS k FROM u),
  d AS (SELECT metric, draw, sum((a - b) * k) / sum(CASE WHEN a - b IS NOT NULL THEN k END) AS mean FROM pairs JOIN k ON pairs.task_id = k.task_id GROUP BY metric, draw), e AS (SELECT metric, list_sort(list(mean)) AS ends FROM d GROUP BY metric),
  runs AS (SELECT metric, arm, eval_run, avg(v) AS r FROM (SELECT metric, arm, eval_run, task_id, avg(v) AS v FROM m GROUP BY ALL) GROUP BY ALL), pooled AS (SELECT metric, sqrt(sum(df * var) / sum(df)) AS run_std FROM (SELECT metric, arm, count(*) - 1 AS df, var_samp(r) AS var FROM runs GROUP BY ALL) GROUP BY metric),
  s AS (SELECT metric, avg(b) AS before, avg(a) AS after, avg(a - b) AS delta, count(a - b) AS n_paired, count(*) - count(a - b) AS n_unpaired FROM pairs GROUP BY metric),
  t0 AS (SELECT s.*, ends[3] AS ci_lo, ends[97] AS ci_hi, run_std, run_std * sqrt(2 / 3.0::DOUBLE) * 2.7764451051977987::DOUBLE AS noise_band, s.metric = 'big' AS lower_is_better FROM s JOIN e ON s.metric = e.metric JOIN pooled ON s.metric = pooled.metric),
  t1 AS (SELECT *, abs(delta) < noise_band AS within_noise, CASE WHEN ci_lo > 0 THEN 'b_better' WHEN ci_hi < 0 THEN 'a_better' ELSE 'no_difference' END AS verdict FROM t0),
  told AS (SELECT *, CASE WHEN lower_is_better AND verdict = 'b_better' THEN 'a_better' WHEN lower_is_better AND verdict = 'a_better' THEN 'b_better' ELSE verdict END AS gain_verdict FROM t1)"""
ORACLES = {
    "run_settings": f"WITH {GRADED_SQL}, l AS (SELECT arm, unnest(['harness', 'model', 'fixed']) AS setting, unnest([harness, model, 't0']) AS v FROM graded) SELECT arm, setting, CASE WHEN min(v) = max(v) THEN min(v) END AS value, min(v) <> max(v) AS mixed FROM l GROUP BY arm, setting",
    "answered_shares": "SELECT lang, count(*) AS n, count(*) FILTER (WHERE doc_id % 4 <> 2) AS replied, count(*) FILTER (WHERE doc_id % 4 IN (1, 3)) AS answered, count(*) FILTER (WHERE doc_id % 4 = 1) AS unclosed FROM documents GROUP BY lang",
    "policy_staleness": "SELECT o_orderstatus AS version, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders)::DOUBLE, 6) AS share, o_orderstatus <> 'O' AS stale FROM orders GROUP BY o_orderstatus",
    "comparability_causes": f"""WITH {GRADED_SQL}, g AS (SELECT *, CASE WHEN reply_length % 10 <> 0 THEN reward END AS r FROM graded), p AS (SELECT task_id, avg(r) FILTER (WHERE arm = 'before') AS b, avg(r) FILTER (WHERE arm = 'after') AS a FROM g GROUP BY task_id), q AS (SELECT * FROM p WHERE a IS NOT NULL OR b IS NOT NULL),
        s AS (SELECT count(a - b) / count(*)::DOUBLE AS share, avg(a - b) AS delta FROM q), u AS (SELECT sum(d / (1 - d)) AS bias FROM (SELECT avg((r IS NULL)::INT::DOUBLE) AS d FROM g GROUP BY arm)), m AS (SELECT count(DISTINCT x) > 1 AS differs FROM (SELECT min(model) AS x FROM g GROUP BY arm))
        SELECT unnest(['paired_share', 'ungraded', 'prompt', 'user_model']) AS cause, unnest([share < 0.5, bias >= abs(delta) AND bias > 0, false, differs]) AS found FROM s, u, m""",
    "hack_scan_changes": f"""WITH {GRADED_SQL}, l AS (SELECT arm, task_id, reward - avg(reward) OVER (PARTITION BY arm, task_id) AS rc, unnest(['cheap', 'big', 'score', 'length']) AS feature, unnest([cheap, big, score, reply_length::DOUBLE]) AS x FROM graded), c AS (SELECT *, x - avg(x) OVER (PARTITION BY arm, feature, task_id) AS xc FROM l),
        b AS ({_RHO.format("before", "'cheap', 'big', 'score'")}), a AS ({_RHO.format("after", "'cheap', 'big', 'length'")}), m AS (SELECT coalesce(a.feature, b.feature) AS feature, abs(coalesce(b.rho, 0)) AS b, abs(coalesce(a.rho, 0)) AS a FROM b FULL JOIN a ON a.feature = b.feature)
        SELECT feature, round(b, 6) AS before, round(a, 6) AS after, round(a - b, 6) AS shift, CASE WHEN b < 0.01 AND a >= 0.01 THEN 'gained' WHEN b >= 0.01 AND a < 0.01 THEN 'lost' ELSE 'same' END AS change FROM m""",
    "behaviour_signatures": """SELECT o_orderkey, substr(sha256('((' || '(''find'', ((''q'', ''' || CASE WHEN o_orderkey % 2 = 0 THEN 'user' ELSE 'invented' END || '''),), ''ok''), ' || '(''open'', ((''id'', ''' || CASE WHEN o_orderkey % 3 = 0 THEN 'derived' ELSE 'invented' END || '''),), ''' || CASE WHEN o_orderkey % 5 = 0 THEN 'error' ELSE '' END || ''')), ' || CASE WHEN o_orderkey % 7 = 0 THEN 'True' ELSE 'False' END || ', 0)'), 1, 12) AS signature FROM orders""",
    "delta_report": f"WITH {_DELTA} SELECT metric, round(before, 6) AS before, round(after, 6) AS after, round(delta, 6) AS delta, n_paired, n_unpaired, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi, round(run_std, 6) AS run_std, round(noise_band, 6) AS noise_band, lower_is_better, within_noise, verdict, gain_verdict FROM told",
    "delta_headline": f"""WITH {_DELTA}, w AS (SELECT *, CASE WHEN gain_verdict = 'insufficient_data' THEN gain_verdict WHEN gain_verdict <> 'no_difference' AND within_noise THEN 'within_eval_noise' WHEN gain_verdict = 'a_better' THEN 'moved_the_wrong_way' WHEN gain_verdict = 'b_better' THEN 'moved' ELSE 'no_change_detected' END AS word FROM told),
        t AS (SELECT * FROM w WHERE metric = 'reward'), p AS (SELECT * FROM w WHERE metric = 'big'),
        l AS (SELECT coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE gain_verdict = 'b_better' AND NOT within_noise), '') AS improved, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE gain_verdict = 'a_better' AND NOT within_noise AND metric <> 'cheap'), '') AS slipped,
          coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE gain_verdict = 'a_better' AND NOT within_noise AND metric = 'cheap'), '') AS regressions FROM w),
        x AS (SELECT t.word AS target_verdict, improved, slipped, regressions, t.n_paired / (t.n_paired + t.n_unpaired)::DOUBLE < 0.5 AS not_comparable, t.before >= 0.9 AS ceiling, (p.gain_verdict = 'b_better' AND t.word NOT IN ('moved', 'moved_unreplicated')) OR p.ci_lo > t.ci_hi AS over_optimized FROM t, p, l),
        y AS (SELECT *, regressions = '' AND target_verdict <> 'moved_the_wrong_way' AND NOT not_comparable AND NOT over_optimized AS ok FROM x)
        SELECT *, CASE WHEN not_comparable THEN 'NOT COMPARABLE' WHEN NOT ok THEN 'FAIL' WHEN target_verdict IN ('moved', 'moved_unreplicated') THEN 'PASS' ELSE 'NO DIFFERENCE' END AS headline FROM y""",
    "built_tasks": f"WITH {STATS_SQL} SELECT task_id, round(c / n::DOUBLE, 6) AS solve_rate, CASE WHEN CAST('0x' || substr(sha1(CAST(task_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967295.0::DOUBLE < 0.2 THEN 'holdout' ELSE 'train' END AS split FROM stats WHERE c / n::DOUBLE BETWEEN 0.2 AND 0.8",
    "pseudo_production": f"""WITH {GRADED_SQL}, f AS (SELECT model || '-' || (reply_length % 10) AS flaw, task_id, row_number() OVER (PARTITION BY model || '-' || (reply_length % 10) ORDER BY task_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM graded WHERE reward = 0),
        s AS (SELECT task_id, count(*) AS n, CASE WHEN task_id IN (SELECT task_id FROM f WHERE k = 1) THEN 0 ELSE 1 END AS place FROM graded GROUP BY task_id), w AS (SELECT *, coalesce(sum(n) OVER (ORDER BY place, sha256('pseudo:' || task_id), task_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM s)
        SELECT task_id, n, place, place = 0 OR before < ceil(0.2 * total) AS chosen FROM w""",
    "tier_mix": "WITH t AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS turn FROM orders) SELECT o_orderkey, o_orderpriority, CAST(turn AS INTEGER) AS turn FROM t ORDER BY (o_orderpriority = '1-URGENT' AND turn <= 60) DESC, turn, o_orderpriority LIMIT 200",
}
