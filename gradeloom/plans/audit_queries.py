"""Queries over audits of graded sets, replies of judges and export shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions import parsing as P
from gradeloom.operators import audits as A
from gradeloom.operators import compare, groups, trajectories
from gradeloom.plans.graded_queries import rounded
from gradeloom.plans.tables import GRADED_SQL, STATS_SQL, graded, table

# What judges replied, by turns, with what is to be read: (reply, score, winner, reward on [0, 1], status, reward on 1 to 5, status there, JSON, schema problem)
SCHEMA = {"type": "object", "required": ["score"], "properties": {"score": {"type": "number"}, "reason": {"type": "string"}}}
REPLIES = (
    ('{"score": 0.5, "reason": "half"}', 0.5, None, 0.5, "ok", None, "invalid_result", '{"reason":"half","score":0.5}', None),
    ('Well. {"winner": "b", "reason": "x"}', None, "B", None, "invalid_result", None, "invalid_result", '{"reason":"x","winner":"b"}', "required score"),
    ("3", None, None, None, "invalid_result", 0.5, "ok", "3", "type object"),
    ("true", None, None, 1.0, "ok", None, "invalid_result", "true", "type object"),
    ('{"score": 2}', None, None, None, "invalid_result", 0.25, "ok", '{"score":2}', None),
    ('so "score": 1, then', 1.0, None, None, "invalid_result", None, "invalid_result", None, "not JSON"),
    ("winner: tie", None, "tie", None, "invalid_result", None, "invalid_result", None, "not JSON"),
    ('{"verdict": "fine"}', None, None, None, "missing_reward", None, "missing_reward", '{"verdict":"fine"}', "required score"),
    ('```json {"score": "0.5", "reason": 1} ```', 0.5, None, None, "invalid_result", None, "invalid_result", '{"reason":1,"score":"0.5"}', "property score"),
    ("", None, None, None, "invalid_result", None, "invalid_result", None, "not JSON"),
)
REASONS = (("It was executed without asking.", "unconfirmed_write"), ("Cut off mid-sentence", "junk_output"), ("The wrong total", "arithmetic"), ("It claimed it cannot do that", "no_attempt"), ("Misreported what failed", "fault_dishonesty"), ("left INCOMPLETE", "incompleteness"), ("a made-up id", "fabrication"), ("so it goes", None))


def _pick(key, values):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (key % len(values) + 1).cast("int"))


def failure_classes(spark, sf):
    k = F.col("doc_id")
    d = table(spark, sf, "documents").select((k % 2).cast("double").alias("reward"), _pick(k, [r for r, _ in REASONS]).alias("reason"), F.when(k % 5 == 0, F.lit(" ")).otherwise(F.col("text")).alias("final"))
    return d.groupBy(A.failure_class(F.col("reward"), F.col("reason"), F.col("final")).alias("why")).agg(F.count("*").alias("n"))


def read_replies(spark, sf):
    """Replies of judges, each read in every way."""
    e = table(spark, sf, "events").select("event_id", _pick(F.col("event_id"), [r[0] for r in REPLIES]).alias("t"))
    t = F.col("t")
    e = e.select("event_id", P.score_of(t)["score"].alias("score"), P.winner_of(t).alias("winner"), P.result_of(t).alias("r"), P.result_of(t, (1.0, 5.0)).alias("s"), P.json_text(t).alias("js"), P.schema_problems(t, SCHEMA).alias("problem"))
    return e.groupBy("score", "winner", F.col("r.reward").alias("reward"), F.col("r.status").alias("status"), F.col("s.reward").alias("rating"), F.col("s.status").alias("rating_status"), "js", "problem").agg(F.count("*").alias("n"))


def rubric_leanings(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(P.rubric_words(F.col("text")), " ").alias("words"))


def word_vectors(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", P.embedded(F.col("text")).alias("v")).select("doc_id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


def score_spread(spark, sf):
    return rounded(A.score_spread(graded(spark, sf), "score", by=("harness",)))


def publish_gate(spark, sf):
    return A.publish_gate(graded(spark, sf))


def hollow_run(spark, sf):
    k = F.col("o_orderkey")
    step = lambda tool: F.array(F.struct(F.lit(tool).alias("tool")))
    rows = table(spark, sf, "orders").select(F.when(k % 3 == 0, step("lookup")).when(k % 3 == 1, step("refund")).otherwise(step("")).alias("steps"))
    out = A.hollow_run(rows, "steps", ["lookup", "refund", "cancel"])
    return out.select("n", "with_calls", "silent", "hollow", "partly_hollow", F.array_join("never_called", ",").alias("never_called"))


def _evals(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderstatus").alias("version"), F.col("o_orderpriority").alias("behavior"), F.col("o_orderkey").alias("posted"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("score"), F.lit(100.0).alias("ci"))


def newest_scores(spark, sf):
    return rounded(A.newest_scores(_evals(spark, sf), at="posted"))


def version_winners(spark, sf):
    return rounded(A.winners(A.newest_scores(_evals(spark, sf), at="posted"), "O"))


def variance_parts(spark, sf):
    return rounded(A.variance_parts(groups.task_stats(graded(spark, sf))))


def paired_spread(spark, sf):
    return rounded(A.paired_spread(compare.paired(graded(spark, sf))))


def task_halves(spark, sf):
    return table(spark, sf, "orders").select(A.half(F.col("o_orderkey")).alias("half")).groupBy("half").agg(F.count("*").alias("n"))


def _chats(spark, sf):
    return trajectories.as_messages(table(spark, sf, "conversations"), conv="conv_id", turn="turn", role="role", text="text")


def assistant_opens(spark, sf):
    return rounded(A.opening_share(_chats(spark, sf)))


def agent_said(spark, sf):
    rows = _chats(spark, sf).withColumn("final_text", F.try_element_at(F.filter("messages", lambda m: m["role"] == "assistant"), F.lit(-1))["content"])
    return rows.select("conv_id", F.md5(A.said(rows).cast("binary")).alias("said"), F.md5(F.lower(A.said(rows, distinct=False)).cast("binary")).alias("whole"))


def quality_summary(spark, sf):
    k = F.col("doc_id")
    d = table(spark, sf, "documents").select((k % 101 / 100).alias("quality"), (k % 7 / 6).alias("opener"), F.when(k % 3 == 0, k % 5 / 4).alias("structure"))
    return A.quality_summary(d, ["opener", "structure"])


def weighted_export(spark, sf):
    rows = _chats(spark, sf).withColumn("loss_mask", trajectories.loss_mask(mode="final"))
    out = A.weighted_rows(rows)
    weights = F.transform("messages", lambda m: F.coalesce(m["weight"].cast("string"), F.lit("-")))
    return out.select(F.array_join(weights, "").alias("weights")).groupBy("weights").agg(F.count("*").alias("n"))


def one_turn_preferences(spark, sf):
    k = F.col("o_orderkey")
    say = lambda role, text: F.struct(F.lit(role).alias("role"), F.lit(text).alias("content"))
    ask, good, bad, more, world = say("user", "a"), say("assistant", "b"), say("assistant", "c"), say("assistant", "d"), say("tool", "e")
    chosen = F.when(k % 5 == 0, F.array(ask, good)).when(k % 5 == 1, F.array(ask, good, more)).when(k % 5 == 2, F.array(good)).otherwise(F.array(ask, good, world))
    rejected = F.when(k % 5 == 2, F.array(bad)).when(k % 5 == 3, F.array(ask, good, more)).when(k % 5 == 4, F.array(ask, good)).otherwise(F.array(ask, bad))
    out = A.one_turn_preferences(table(spark, sf, "orders").select(chosen.alias("chosen"), rejected.alias("rejected")))
    return out.groupBy(F.size("input").alias("shared"), F.col("preferred.content").alias("preferred"), F.col("non_preferred.content").alias("other"), "cut").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    failure_classes, read_replies, rubric_leanings, word_vectors, score_spread, publish_gate, hollow_run, newest_scores, version_winners, variance_parts, paired_spread, task_halves, assistant_opens, agent_said, quality_summary, weighted_export, one_turn_preferences,
)}


def _sql(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x}::DOUBLE"


_NEWEST = "SELECT version, behavior, max(posted) AS posted, arg_max(score, posted) AS score, 100.0::DOUBLE AS ci FROM (SELECT o_orderstatus AS version, o_orderpriority AS behavior, o_orderkey AS posted, o_totalprice AS score FROM orders WHERE o_orderkey % 5 <> 0) GROUP BY version, behavior"
_AGENT = "c AS (SELECT conv_id, list(text ORDER BY turn, role, text) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY conv_id)"
ORACLES = {
    "failure_classes": f"SELECT CASE WHEN doc_id % 2 <> 0 THEN NULL WHEN doc_id % 5 = 0 OR trim(text, ' ') = '' THEN 'junk_output' ELSE ([{', '.join(_sql(w) for _, w in REASONS)}])[doc_id % {len(REASONS)} + 1] END AS why, count(*) AS n FROM documents GROUP BY 1",
    "read_replies": "WITH r AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {', '.join(_sql(x) for x in r[1:])})" for k, r in enumerate(REPLIES)) + f") AS t(k, score, winner, reward, status, rating, rating_status, js, problem)) SELECT score::DOUBLE AS score, winner, reward::DOUBLE AS reward, status, rating::DOUBLE AS rating, rating_status, js, problem, count(*) AS n FROM events JOIN r ON event_id % {len(REPLIES)} = k GROUP BY ALL",
    "rubric_leanings": "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM w WHERE w NOT IN (" + ", ".join(_sql(x) for x in sorted(P.RUBRIC_STOP)) + ") GROUP BY doc_id, w), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS k FROM c), j AS (SELECT doc_id, string_agg(w, ' ' ORDER BY k) AS words FROM k WHERE k <= 8 GROUP BY doc_id) SELECT d.doc_id, coalesce(words, '') AS words FROM documents d LEFT JOIN j ON d.doc_id = j.doc_id",
    "score_spread": f"WITH {GRADED_SQL}, m AS (SELECT harness, quantile_cont(score, 0.5) AS median FROM graded GROUP BY harness), s AS (SELECT g.harness, count(*) AS n, stddev_pop(score) AS std, any_value(median) AS median, avg((abs(score - median) <= 0.05)::INT) AS within_band FROM graded g JOIN m ON g.harness = m.harness GROUP BY g.harness) SELECT harness, n, round(std, 6) AS std, round(median, 6) AS median, round(within_band, 6) AS within_band, n >= 2 AND std >= 0.05 AND within_band <= 0.9 AS ok FROM s",
    "publish_gate": f"WITH {STATS_SQL}, g AS (SELECT max(n) >= 2 AS rl_shaped, CAST(sum(n) AS BIGINT) AS graded, 0::BIGINT AS ungraded, count(*) FILTER (WHERE n >= 2 AND c > 0 AND c < n) AS mixed, count(*) FILTER (WHERE n >= 2 AND c > 0 AND c < n AND NOT (c / n::DOUBLE BETWEEN 0.2 AND 0.8)) AS out_of_band, count(*) FILTER (WHERE n >= 2 AND (c = 0 OR c = n)) AS unanimous FROM stats) SELECT *, CASE WHEN rl_shaped AND graded = 0 THEN 'ungraded_rl_rows' WHEN rl_shaped AND mixed = 0 THEN 'no_mixed_groups' END AS refusal FROM g",
    "hollow_run": "SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 3 < 2) AS with_calls, count(*) FILTER (WHERE o_orderkey % 3 = 2) AS silent, false AS hollow, count(*) FILTER (WHERE o_orderkey % 3 = 2) >= 2 AS partly_hollow, 'cancel' AS never_called FROM orders",
    "newest_scores": f"SELECT version, behavior, posted, round(score, 6) AS score, ci FROM ({_NEWEST})",
    "version_winners": f"WITH n AS ({_NEWEST}) SELECT a.behavior, a.version, round(a.score - b.score, 6) AS delta FROM n a JOIN n b ON a.behavior = b.behavior AND b.version = 'O' AND a.version <> 'O' WHERE a.score - b.score > sqrt(20000.0::DOUBLE)",
    "variance_parts": f"WITH {STATS_SQL}, s AS (SELECT avg(c / n::DOUBLE) AS base, min(n) AS k, stddev_samp(c / n::DOUBLE) AS spread, var_pop(c / n::DOUBLE) AS b FROM stats) SELECT round(base, 6) AS base, k, round(spread, 6) AS spread, round(base * (1 - base) / (base * (1 - base) - b), 6) AS independence_ratio FROM s",
    "paired_spread": f"WITH {GRADED_SQL}, p AS (SELECT avg(reward) FILTER (WHERE arm = 'before') AS b, avg(reward) FILTER (WHERE arm = 'after') AS a FROM graded GROUP BY task_id) SELECT round(stddev_samp(a - b), 6) AS sd, count(*) AS n, round(avg(b), 6) AS base FROM p WHERE a IS NOT NULL AND b IS NOT NULL",
    "task_halves": "SELECT CAST(CAST('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 2 AS INTEGER) AS half, count(*) AS n FROM orders GROUP BY 1",
    "assistant_opens": "WITH f AS (SELECT conv_id, arg_min(role, struct_pack(a := turn, b := role, c := text)) AS r FROM conversations GROUP BY conv_id) SELECT round(avg((r = 'assistant')::INT), 6) AS share FROM f",
    "agent_said": f"WITH {_AGENT}, p AS (SELECT conv_id, coalesce(a, []) AS a, coalesce(a[-1], '') AS l FROM c) SELECT conv_id, md5(array_to_string(list_filter(list_concat([l], list_filter(a, lambda x: x <> l)), lambda x: x <> ''), chr(10))) AS said, md5(lower(array_to_string(list_filter(list_concat([l], a), lambda x: x <> ''), chr(10)))) AS whole FROM p",
    "quality_summary": """WITH d AS (SELECT (doc_id % 101) / 100.0::DOUBLE AS q, (doc_id % 7) / 6.0::DOUBLE AS o, coalesce(CASE WHEN doc_id % 3 = 0 THEN (doc_id % 5) / 4.0::DOUBLE END, 0) AS s FROM documents)
        SELECT count(*) AS n, round(avg(q), 3) AS mean, round(quantile_cont(q, 0.5), 3) AS median, round(min(q), 3) AS least, round(max(q), 3) AS most, count(*) FILTER (WHERE q < 0.5) AS poor, count(*) FILTER (WHERE q >= 0.5 AND q < 0.7) AS fair, count(*) FILTER (WHERE q >= 0.7 AND q < 0.85) AS good, count(*) FILTER (WHERE q >= 0.85) AS best,
          count(*) FILTER (WHERE q >= 0.5) AS n_pass, round(avg((o < 0.5)::INT), 3) AS fails_opener, round(avg((s < 0.5)::INT), 3) AS fails_structure FROM d""",
    "weighted_export": "WITH c AS (SELECT conv_id, list(role ORDER BY turn, role, text) AS r FROM conversations GROUP BY conv_id), p AS (SELECT r, coalesce(list_max(list_filter(range(1, len(r) + 1), lambda i: r[i] = 'assistant')), 0) AS l FROM c), w AS (SELECT array_to_string(list_transform(range(1, len(r) + 1), lambda i: CASE WHEN r[i] <> 'assistant' THEN '-' WHEN i = l THEN '1' ELSE '0' END), '') AS weights FROM p) SELECT weights, count(*) AS n FROM w GROUP BY weights",
    "one_turn_preferences": "SELECT 1 AS shared, 'b' AS preferred, 'c' AS other, o_orderkey % 5 = 1 AS cut, count(*) AS n FROM orders WHERE o_orderkey % 5 IN (0, 1) GROUP BY 4",
}
