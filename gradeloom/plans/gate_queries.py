"""Queries over the gates on single rollouts: documents with their labels seen as an agent's rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions import text as T
from gradeloom.functions.text import looks_finished
from gradeloom.operators import gates as G
from gradeloom.operators import hygiene
from gradeloom.plans.tables import table


def _when(key, cases: dict, other):
    out = None
    for k, v in cases.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(other)


def agent_rows(spark, sf):
    """doc_id, lang, prompt, final_text, reward, fallback_reward, label_source, judge_status, lineage_source, steps, messages, finish_reason, reason, markers."""
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    d, k, text = table(spark, sf, "documents").join(labels, "doc_id", "left"), F.col("doc_id"), F.coalesce("text", F.lit(""))
    none = F.lit(None).cast("string")
    prompt = _when(k % 3, {0: F.lit("Please refund order #12 for me"), 1: F.lit("ok?")}, F.lit("Tell me about rain"))
    endings = {
        0: F.lit("  "), 1: F.lit("<Agent error: gone>"), 2: F.concat(text, F.lit(" <tool_call>")), 3: F.lit("a" * 40), 4: F.lit("Shall I do that?"),
        5: F.concat(text, F.lit("\nBest,\nSam")), 6: F.concat(text, F.lit(" ```x```")), 7: F.concat(text, F.lit("\n#### 42")), 8: F.concat(text, F.lit(" and so")),
    }
    final = _when(k % 20, endings, text)
    result = F.when(k % 8 == 0, F.lit('{"status": "Timeout"}')).otherwise(F.lit('{"status": "ok"}'))
    step = F.struct(F.lit("lookup").alias("tool"), result.alias("result"), none.alias("text"), (k % 48 == 0).alias("truncated"))
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    turns = F.array(say("user", prompt), say("assistant", final))
    return d.select(
        "doc_id", "lang", prompt.alias("prompt"), final.alias("final_text"), F.when(k % 7 == 0, 0.5).otherwise(F.col("quality").cast("double")).alias("reward"),
        F.when(k % 2 == 0, F.col("toxic").cast("double")).alias("fallback_reward"), _when(k % 5, {0: F.lit("Gold-set"), 1: F.lit("claude-x")}, F.lit("rules")).alias("label_source"),
        F.when(k % 9 == 0, "missing_reward").otherwise("ok").alias("judge_status"), F.when(k % 11 == 0, "eval").otherwise("run").alias("lineage_source"),
        F.when(k % 4 == 0, F.array(step)).otherwise(F.filter(F.array(step), lambda _: F.lit(False))).alias("steps"),
        F.when(k % 6 == 5, F.concat(turns, F.array(say("user", F.lit("and?"))))).otherwise(turns).alias("messages"),
        F.when(k % 31 == 0, "length").otherwise("stop").alias("finish_reason"), F.when(k % 37 == 0, "It was  Cut off there").alias("reason"),
        F.create_map(F.lit("brief"), F.when(F.length(text) < 500, 1.0).otherwise(0.4), F.lit("civil"), 1.0 - F.coalesce("toxic", F.lit(0)), F.lit("kept"), F.lit(0.5)).alias("markers"),
    )


def drop_reasons(spark, sf):
    """What the gates drop, by reason."""
    return G.filter_rows(agent_rows(spark, sf))[1]


def drop_reasons_by_label(spark, sf):
    """With the gates that read the reply off."""
    return G.filter_rows(agent_rows(spark, sf), text_gates=False)[1]


def kept_rows(spark, sf):
    return G.filter_rows(agent_rows(spark, sf))[0].select("doc_id", G.binary_label(["reward", "fallback_reward"]).alias("label"), G.scalar_reward(["reward", "fallback_reward"]).alias("score"))


def reward_views(spark, sf):
    return G.reward_views(agent_rows(spark, sf))


def reward_ranges(spark, sf):
    r = F.col("reward")
    n = lambda x: F.sum(x.cast("long"))
    return agent_rows(spark, sf).groupBy("lang").agg(n(G.in_reward_range(r, 0.5, 1.0)).alias("closed"), n(G.in_reward_range(r, 0.0, 1.0, inclusive=False)).alias("open"))


def lost_reasons(spark, sf):
    rows = agent_rows(spark, sf)
    return rows.groupBy(G.lost_reason(rows.columns).alias("why")).agg(F.count("*").alias("n"))


def flawed_rows(spark, sf):
    rows = agent_rows(spark, sf)
    n = lambda x: F.sum(x.cast("long"))
    return rows.groupBy("lang").agg(n(G.fault_worthy(rows.columns)).alias("faulty"), n(G.flawed(rows.columns)).alias("flawed"), n(G.is_do_nothing(rows.columns)).alias("idle"), n(G.is_do_nothing(rows.columns, has_tools=False)).alias("idle_without_tools"))


def failed_criteria(spark, sf):
    return agent_rows(spark, sf).select(F.explode(G.failed_criteria(F.col("markers"))).alias("criterion")).groupBy("criterion").agg(F.count("*").alias("n"))


def truncated_rows(spark, sf):
    """By every sign, and by the text alone."""
    rows = agent_rows(spark, sf)
    n = lambda x: F.sum(x.cast("long"))
    return rows.groupBy("lang").agg(n(hygiene.is_truncated(rows.columns)).alias("cut"), n(hygiene.is_truncated(["final_text"])).alias("stops"), F.count("*").alias("n"))


def finished_replies(spark, sf):
    return agent_rows(spark, sf).select("doc_id", looks_finished(F.col("final_text")).alias("finished"))


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_Q = lambda p: "'" + p.replace("'", "''") + "'"
_RUN = "|".join(f"\\x{c:02x}{{30,}}" for c in range(32, 127))  # no back references here
_ROWS = f"""lab AS (SELECT doc_id, min(quality) AS quality, min(toxic) AS toxic FROM labels GROUP BY doc_id),
  agent AS (SELECT d.doc_id, d.doc_id AS k, lang, coalesce(text, '') AS text, CASE d.doc_id % 3 WHEN 0 THEN 'Please refund order #12 for me' WHEN 1 THEN 'ok?' ELSE 'Tell me about rain' END AS prompt,
    CASE d.doc_id % 20 WHEN 0 THEN '  ' WHEN 1 THEN '<Agent error: gone>' WHEN 2 THEN coalesce(text, '') || ' <tool_call>' WHEN 3 THEN repeat('a', 40) WHEN 4 THEN 'Shall I do that?' WHEN 5 THEN coalesce(text, '') || chr(10) || 'Best,' || chr(10) || 'Sam'
      WHEN 6 THEN coalesce(text, '') || ' ```x```' WHEN 7 THEN coalesce(text, '') || chr(10) || '#### 42' WHEN 8 THEN coalesce(text, '') || ' and so' ELSE coalesce(text, '') END AS final_text,
    CASE WHEN d.doc_id % 7 = 0 THEN 0.5::DOUBLE ELSE quality::DOUBLE END AS reward, CASE WHEN d.doc_id % 2 = 0 THEN toxic::DOUBLE END AS fb, toxic, d.doc_id % 5 IN (0, 1) AS trusted, d.doc_id % 4 = 0 AS tool, d.doc_id % 6 = 5 AS ends_on_user
    FROM documents d LEFT JOIN lab ON d.doc_id = lab.doc_id),
  f1 AS (SELECT *, {_STRIP.format('final_text')} AS f, regexp_replace(final_text, '\\s+$', '') AS body, CASE WHEN reward IN (0, 1) THEN reward WHEN fb IN (0, 1) THEN fb END AS label FROM agent),
  f2 AS (SELECT *, list_filter(list_transform(string_split_regex(body, '\\r\\n|\\r|\\n'), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS lines FROM f1),
  f3 AS (SELECT *, coalesce(lines[-1], '') AS last, coalesce(lines[-2], '') AS before FROM f2),
  f4 AS (SELECT *, len(string_split_regex(last, '\\s+')) AS n_last FROM f3),
  fin AS (SELECT *, CASE WHEN body = '' THEN false WHEN regexp_matches(body, {_Q(T.ENDING)}) THEN true WHEN ends_with(body, '```') THEN ((length(body) - length(replace(body, '```', ''))) // 3) % 2 = 0
    ELSE regexp_matches(last, {_Q(T.ANSWER_LINE)}) OR (n_last <= 6 AND regexp_matches(last, {_Q(T.SIGN_OFF)})) OR (len(lines) >= 2 AND n_last <= 5 AND regexp_matches(last, '^[\\p{{Lu}}—-]') AND (ends_with(before, ',') OR regexp_matches(before, {_Q(T.SIGN_OFF)}))) END AS finished FROM f4),
  told AS (SELECT *, f = '' OR starts_with(lower(f), '<agent error') OR (NOT tool AND regexp_matches(f, {_Q(G.INFRA_STUB)})) OR regexp_matches(f, '{_RUN}') OR regexp_matches(f, {_Q(G.HARNESS_LEAK)}) OR regexp_matches(final_text, {_Q(G.TOOL_MARKUP)}) OR regexp_matches(final_text, {_Q(G.SCHEMA_DUMP)})
      OR (length(f) > 600 AND NOT finished) OR ends_on_user OR (NOT tool AND regexp_matches(f, {_Q(G.QUESTION_END)}) AND k % 3 = 1) AS junk, k % 3 = 0 AND NOT tool AS idle, reward = 0 AND trusted AS zero FROM fin)"""
_WHY = "CASE WHEN coalesce(zero, false) AND (tool OR f <> '') THEN CASE WHEN {0} THEN 'kept_verified_zero' ELSE 'kept' END WHEN {1} THEN 'incomplete_junk' WHEN {2} THEN 'do_nothing' WHEN label IS NULL THEN 'unusable_label' ELSE 'kept' END"
_FULL = _WHY.format("junk OR idle", "junk", "label IS NULL AND idle")

QUERIES = {f.__name__: f for f in (drop_reasons, drop_reasons_by_label, kept_rows, reward_views, reward_ranges, lost_reasons, flawed_rows, failed_criteria, truncated_rows, finished_replies)}

ORACLES = {
    "drop_reasons": f"WITH {_ROWS} SELECT {_FULL} AS why, count(*) AS n FROM told GROUP BY 1",
    "drop_reasons_by_label": f"WITH {_ROWS} SELECT {_WHY.format('junk OR idle', 'false', 'false')} AS why, count(*) AS n FROM told GROUP BY 1",
    "kept_rows": f"WITH {_ROWS} SELECT doc_id, CAST(label AS INTEGER) AS label, coalesce(reward, fb) AS score FROM told WHERE {_FULL} IN ('kept', 'kept_verified_zero')",
    "reward_views": f"""WITH {_ROWS}, g AS (SELECT *, coalesce(reward, fb) AS graded FROM told) SELECT count(*) AS n, count(*) FILTER (WHERE reward = 1) AS passes, count(*) FILTER (WHERE reward = 0) AS failures, count(*) FILTER (WHERE reward > 0 AND reward < 1) AS partials,
        count(*) FILTER (WHERE graded IS NOT NULL AND label IS NULL) AS partial_only, count(*) FILTER (WHERE k % 9 = 0) AS unjudged, count(*) FILTER (WHERE k % 11 = 0) AS eval_sourced, count(graded) AS graded, count(graded) >= 2 AND min(graded) = max(graded) AS degenerate FROM g""",
    "reward_ranges": f"WITH {_ROWS} SELECT lang, count(*) FILTER (WHERE reward BETWEEN 0.5 AND 1) AS closed, count(*) FILTER (WHERE reward > 0 AND reward < 1) AS \"open\" FROM told GROUP BY lang",
    "lost_reasons": f"WITH {_ROWS} SELECT CASE WHEN starts_with(lower(f), '<agent error') THEN 'agent_error' WHEN f = '' THEN 'empty_reply' WHEN regexp_matches(final_text, {_Q(G.TOOL_MARKUP)}) OR regexp_matches(final_text, {_Q(G.SCHEMA_DUMP)}) THEN 'tool_markup' END AS why, count(*) AS n FROM told GROUP BY 1",
    "flawed_rows": f"WITH {_ROWS} SELECT lang, count(*) FILTER (WHERE k % 8 = 0) AS faulty, count(*) FILTER (WHERE k % 8 = 0 OR label = 0) AS flawed, count(*) FILTER (WHERE idle) AS idle, 0::BIGINT AS idle_without_tools FROM told GROUP BY lang",
    "failed_criteria": f"WITH {_ROWS} SELECT * FROM (SELECT 'brief' AS criterion, count(*) FILTER (WHERE length(text) >= 500) AS n FROM told UNION ALL SELECT 'civil', count(*) FILTER (WHERE toxic = 1) FROM told) WHERE n > 0",
    "truncated_rows": f"""WITH {_ROWS}, c AS (SELECT *, length(body) >= 200 AND NOT finished AS stops FROM told) SELECT lang, count(*) FILTER (WHERE stops OR k % 31 = 0 OR k % 37 = 0 OR k % 48 = 0) AS cut, count(*) FILTER (WHERE stops) AS stops, count(*) AS n FROM c GROUP BY lang""",
    "finished_replies": f"WITH {_ROWS} SELECT doc_id, finished FROM fin",
}
