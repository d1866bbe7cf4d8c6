"""Queries over sources, exports, mining and planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import flags, groups, mining, planning, trajectories
from gradeloom.plans.graded_queries import rounded
from gradeloom.plans.tables import STATS_SQL, graded, table
from gradeloom.sources import rows as R


def row_shapes(spark, sf):
    d = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 5 == 0, "1").alias("schema_version"), F.when(F.col("doc_id") % 7 == 0, "{}").alias("steps_json"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("scenario_id"), F.when(F.col("doc_id") % 2 == 0, "c").alias("conversation_id"))
    return d.groupBy(R.detect_shape(d.columns).alias("shape")).agg(F.count("*").alias("n"))


def row_problems(spark, sf):
    d = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 5 == 0, "9").otherwise("1").alias("schema_version"), F.when(F.col("doc_id") % 4 == 0, "high").otherwise("1").alias("reward"), F.when(F.col("doc_id") % 3 != 0, "a").alias("chosen"), F.lit("b").alias("rejected"))
    return d.select(F.explode(R.problems(d.columns, "preference")).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


def loaded_traces(spark, sf):
    k, none = F.col("doc_id"), F.lit(None).cast("string")
    call = F.array(F.struct(none.alias("user"), none.alias("text"), F.lit("find").alias("tool"), F.lit("{}").alias("arguments"), none.alias("result")))
    d = table(spark, sf, "documents").select("doc_id", F.when(k % 2 == 0, F.lit("")).otherwise(F.col("text")).alias("prompt"), F.when(k % 3 == 0, F.lit("q")).alias("question"), F.when(k % 5 == 0, F.lit("r")).alias("response"), F.when(k % 4 == 0, 0.5).otherwise(1.0).alias("reward"), F.when(k % 4 == 0, call).alias("tool_trace"))
    out = R.load_traces(d)
    return out.agg(F.count("*").alias("n"), F.count("reward").alias("graded"), F.sum((F.col("prompt") == "q").cast("long")).alias("by_alias"), F.sum((F.col("final_text") != "").cast("long")).alias("replies"), F.sum(F.size("steps")).cast("long").alias("steps"))


def message_steps(spark, sf):
    """Chats with a tool call in every agent turn and answers by id, by name or in order."""
    c = table(spark, sf, "conversations").where("role IN ('user', 'assistant')")
    none, turn = F.lit(None).cast("string"), F.col("turn")
    calls = F.array(F.struct(turn.cast("string").alias("id"), F.lit("find").alias("name"), F.lit("{}").alias("arguments")))
    message = lambda part, role, content, name, call_id, calls: F.struct(turn.alias("turn"), "text", F.lit(part).alias("part"), role.alias("role"), content.alias("content"), name.alias("name"), call_id.alias("tool_call_id"), calls.alias("tool_calls"))
    own = message(0, F.col("role"), F.col("text"), none, none, F.when(F.col("role") == "assistant", calls))
    answer = message(1, F.lit("tool"), F.lit('{"status": "ok"}'), F.when(turn % 3 == 1, "find"), F.when(turn % 3 == 2, turn.cast("string")), F.filter(calls, lambda _: F.lit(False)))
    each = c.select("conv_id", F.explode(F.when((F.col("role") == "assistant") & (turn % 5 != 4), F.array(own, answer)).otherwise(F.array(own))).alias("m"))
    chats = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("messages"))  # a conversation's turns
    steps = chats.select("conv_id", R.steps_from_messages("messages").alias("s"))
    n = lambda test: F.size(F.filter("s", test))
    return steps.select("conv_id", F.size("s").alias("steps"), n(lambda x: x["user"].isNotNull()).alias("asked"), n(lambda x: x["text"].isNotNull()).alias("said"), n(lambda x: x["tool"].isNotNull()).alias("calls"), n(lambda x: x["result"].isNotNull()).alias("answered"))


def bound_tool_results(spark, sf):
    e = table(spark, sf, "events")
    calls = e.where("event_type = 'click'").select(F.col("user_id").alias("conv"), F.col("event_id").alias("at"), (F.col("event_id") % 3).cast("string").alias("tool"), F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).alias("call_id"), F.col("props").alias("arguments"))
    results = e.where("event_type = 'view'").select(F.col("user_id").alias("conv"), F.col("event_id").alias("at"), (F.col("event_id") % 3).cast("string").alias("tool"), F.lit(None).cast("string").alias("call_id"), F.col("value").cast("string").alias("result"))
    out = R.bind_tool_results(calls, results)
    return out.groupBy("tool").agg(F.count("*").alias("steps"), F.count("arguments").alias("calls"), F.count("result").alias("results"), F.sum((F.col("arguments").isNotNull() & F.col("result").isNotNull()).cast("long")).alias("both"))


def training_export(spark, sf):
    chats = trajectories.as_messages(table(spark, sf, "conversations"), conv="conv_id", turn="turn", role="role", text="text")
    out = R.training_rows(chats, system_prompt="Be brief.", mask_mode="final")
    return out.select("conv_id", F.size("messages").alias("n_messages"), F.element_at("messages", 1)["role"].alias("first_role"), F.array_join("loss_mask", "").alias("mask"))


def exported_calls(spark, sf):
    e = table(spark, sf, "events").select(F.when(F.col("event_id") % 10 == 0, F.lit("[1]")).when(F.col("event_id") % 10 == 1, F.lit("oops")).otherwise(F.col("props")).alias("arguments"))
    return R.tool_call_roundtrip(e)


def traced_arguments(spark, sf):
    return mining.tool_arguments(table(spark, sf, "events"), tool="event_type", arguments="props")


def failed_steps(spark, sf):
    e = table(spark, sf, "events")
    r = F.when(F.col("event_type") == "error", F.lit('{"status": "Timeout"}')).when(F.col("event_id") % 6 == 0, F.lit("Error: no such file")).when(F.col("event_id") % 6 == 1, F.lit('{"exit_code": 2}')).otherwise(F.col("props"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(mining.step_failed(r).cast("long")).alias("failed"))


def result_exemplars(spark, sf):
    e = table(spark, sf, "events").withColumn("result", F.when(F.col("event_id") % 4 == 0, F.lit('{"a": 1, "b": 2}')).otherwise(F.col("props")))
    return mining.exemplars(e, tool="event_type", result="result", order=["event_id"]).select("tool", "shape", "result", "k")


def trace_regions(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 20).alias("region"), (F.col("event_type") == "error").alias("failed"), (F.dayofmonth("ts") > 15).alias("late"))
    return rounded(mining.regions(e, region="region", failed="failed", late="late"))


def grounded_arguments(spark, sf):
    d = table(spark, sf, "documents")
    values = F.array(F.substring("text", 5, 6), F.lit("zz-not there"), F.lit("x"))
    return d.groupBy("lang").agg(F.sum(F.size(mining.ungrounded(values, F.col("text")))).cast("long").alias("invented"), F.count("*").alias("n"))


def missing_copies(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return mining.copies_missing(counts, "n", 12)


def evaluation_power(spark, sf):
    return planning.set_power(groups.task_stats(graded(spark, sf)))


def saturation_fit(spark, sf):
    v = table(spark, sf, "embeddings")
    sizes = F.explode(F.array(*(F.lit(n) for n in (64, 128, 256, 512, 1024, 2048)))).alias("n")
    curve = v.select(F.col("label").alias("curve"), F.col("vec_id").alias("seed"), sizes).withColumn("score", 0.9 - 0.8 * F.pow("n", F.lit(-0.5)) * (1 + F.pmod(F.col("seed"), F.lit(40)) / 100) - F.col("curve") / 100).withColumn("item", F.lit(0))
    return rounded(planning.fit_saturation(curve, "curve"))


def comparison_self_check(spark, sf):
    return planning.self_check(spark, trials=80, draws=200)


def _trajectories(spark, sf):
    o = table(spark, sf, "orders")
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    fault = lambda test: F.when(test, '{"status": "denied"}').otherwise('{"status": "ok"}')
    command = F.when(k % 2 == 0, F.lit("pytest -q || true")).when(k % 3 == 0, F.lit("rm -rf build")).otherwise(F.lit("ls"))
    path = F.when(k % 7 == 0, F.lit("tests/test_a.py")).otherwise(F.lit("src/a.py"))
    steps = F.array(
        mining.called(F.lit("bash"), F.to_json(F.struct(command.alias("cmd"))), fault(k % 5 == 0)),
        mining.called(F.lit("str_replace_editor"), F.to_json(F.struct(path.alias("path"), F.when(k % 11 == 0, F.lit("x = 1  # noqa")).otherwise(F.lit("x = 1")).alias("new_string"))), fault(k % 13 == 0)),
    )
    final = F.when(k % 4 == 0, F.lit("All tests pass now.")).when(k % 4 == 1, F.lit("I fixed it. The tests will pass once merged.")).otherwise(F.lit("I checked it."))
    return o.select("o_orderkey", F.when(k % 17 == 0, F.filter(steps, lambda _: F.lit(False))).otherwise(steps).alias("steps"), final.alias("final_text"), F.when(k % 3 == 0, none.cast("double")).otherwise((k % 2).cast("double")).alias("reward"))


def trace_flag_counts(spark, sf):
    found = flags.trace_flags("steps", "final_text")
    return _trajectories(spark, sf).agg(*(F.sum(c.cast("long")).alias(k.replace(".", "_")) for k, c in found.items()), *(F.round(F.avg(c), 6).alias(k) for k, c in flags.trace_markers(found).items()))


def trace_flag_report(spark, sf):
    rows = _trajectories(spark, sf)
    out = flags.flag_report(rows, flags.trace_flags("steps", "final_text"), reward="reward", evidence="o_orderkey")
    return rounded(out.select("flag", "n", "rate", "reward_corr", "flagged", F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples")))


def step_kinds(spark, sf):
    calls = (("run_command", '{"command": "ls"}'), ("write_file", '{"path": "a.py", "content": "x"}'), ("read_file", '{"path": "a.py"}'), ("delete_file", '{"path": "a.py"}'), ("str_replace_editor", '{"path": "a.py", "new_string": "y"}'), ("lookup_order", '{"order_id": "ORD-1"}'), ("bash", '{"cmd": "pytest"}'), ("search", '{"q": " ", "cmd": " "}'))
    k = F.col("event_id") % len(calls)
    pick = lambda j: F.element_at(F.array(*(F.lit(c[j]) for c in calls)), (k + 1).cast("int"))
    e = table(spark, sf, "events").select(mining.step_kind(pick(0), pick(1)).alias("kind"), mining.step_kind(pick(0), pick(1), {"lookup_order": "read", "bash": "odd"}).alias("named"))
    return e.groupBy("kind", "named").agg(F.count("*").alias("n"))


def turn_taking_scores(spark, sf):
    chats = trajectories.as_messages(table(spark, sf, "conversations"), conv="conv_id", turn="turn", role="role", text="text")
    roles = F.filter(F.transform("messages", lambda m: m["role"]), lambda r: r != "system")
    return chats.select(flags.turn_taking(roles).alias("score")).groupBy("score").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    trace_flag_counts, trace_flag_report, step_kinds, message_steps, turn_taking_scores, row_shapes, row_problems, loaded_traces, bound_tool_results, training_export, exported_calls, traced_arguments, failed_steps, result_exemplars, trace_regions, grounded_arguments, missing_copies, evaluation_power, saturation_fit, comparison_self_check,
)}

_CLEAN = lambda x: f"round(avg(CASE WHEN {x} THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6)"
_FLAGGED = """o AS (SELECT o_orderkey AS k, o_orderkey % 17 = 0 AS bare FROM orders), f AS (SELECT k, bare,
          (k % 4 = 0) AND (bare OR k % 2 <> 0 OR k % 5 = 0) AS a, bare AND k % 4 IN (2, 3) AS b, bare AND k % 4 = 1 AS c, NOT bare AND k % 13 = 0 AS d,
          NOT bare AND k % 2 = 0 AS e, NOT bare AND k % 7 = 0 AS g, false AS h, NOT bare AND k % 11 = 0 AS i, NOT bare AND k % 2 <> 0 AND k % 3 = 0 AS j, false AS l FROM o)"""
_FAILED = "(event_type = 'error' OR event_id % 6 IN (0, 1))"
ORACLES = {
    "trace_flag_counts": f"""WITH {_FLAGGED}
        SELECT count(*) FILTER (WHERE a) AS lie_tests_claimed, count(*) FILTER (WHERE b) AS lie_unverified_claim, count(*) FILTER (WHERE c) AS lie_phantom_edit, count(*) FILTER (WHERE d) AS lie_ignored_failure, count(*) FILTER (WHERE e) AS hack_bypassed,
          count(*) FILTER (WHERE g) AS hack_test_edited, count(*) FILTER (WHERE h) AS hack_test_weakened, count(*) FILTER (WHERE i) AS hack_suppressed, count(*) FILTER (WHERE j) AS risk_destructive, count(*) FILTER (WHERE l) AS risk_secrets,
          {_CLEAN('a OR b OR c')} AS honest_claims, {_CLEAN('d')} AS reported_failure, {_CLEAN('g OR h')} AS no_test_tampering, {_CLEAN('i')} AS no_suppression, {_CLEAN('e')} AS no_bypass, {_CLEAN('j')} AS no_destructive, {_CLEAN('l')} AS no_secrets FROM f""",
    "trace_flag_report": f"""WITH {_FLAGGED}, w AS (SELECT k, CASE WHEN k % 3 <> 0 THEN (k % 2)::DOUBLE END AS r, unnest(['lie.tests_claimed', 'lie.unverified_claim', 'lie.phantom_edit', 'lie.ignored_failure', 'hack.bypassed', 'hack.test_edited', 'hack.test_weakened', 'hack.suppressed', 'risk.destructive', 'risk.secrets']) AS flag,
          unnest([a, b, c, d, e, g, h, i, j, l]) AS fired FROM f), x AS (SELECT *, fired::INT::DOUBLE AS v FROM w),
        s AS (SELECT flag, count(*) FILTER (WHERE fired) AS n, avg(v) AS rate, count(r)::DOUBLE AS m, coalesce(sum(v) FILTER (WHERE r IS NOT NULL), 0) AS sx, coalesce(sum(r), 0) AS sy, coalesce(sum(v * v) FILTER (WHERE r IS NOT NULL), 0) AS sxx, coalesce(sum(r * r), 0) AS syy, coalesce(sum(v * r), 0) AS sxy FROM x GROUP BY flag),
        z AS (SELECT *, CASE WHEN m >= 3 AND m*sxx-sx*sx > 1e-12 AND m*syy-sy*sy > 1e-12 THEN (m*sxy-sx*sy)/sqrt((m*sxx-sx*sx)*(m*syy-sy*sy)) END AS corr FROM s), p AS (SELECT flag, array_to_string(list_sort(list(k))[1:3], ',') AS examples FROM (SELECT DISTINCT flag, k FROM w WHERE fired) GROUP BY flag)
        SELECT z.flag, n, round(rate, 6) AS rate, round(corr, 6) AS reward_corr, coalesce(corr >= 0.3, false) AS flagged, examples FROM z LEFT JOIN p ON z.flag = p.flag""",
    "step_kinds": "WITH c AS (SELECT (event_id % 8) + 1 AS i FROM events) SELECT (['command', 'write', 'read', 'delete', 'write', NULL, 'command', NULL])[i] AS kind, (['command', 'write', 'read', 'delete', 'write', 'read', NULL, NULL])[i] AS named, count(*) AS n FROM c GROUP BY 1, 2",
    "message_steps": "SELECT conv_id, CAST(count(*) FILTER (WHERE role = 'user') + 2 * count(*) FILTER (WHERE role = 'assistant') - count(*) FILTER (WHERE role = 'assistant' AND text = '') AS INTEGER) AS steps, CAST(count(*) FILTER (WHERE role = 'user') AS INTEGER) AS asked, CAST(count(*) FILTER (WHERE role = 'assistant' AND text <> '') AS INTEGER) AS said, CAST(count(*) FILTER (WHERE role = 'assistant') AS INTEGER) AS calls, CAST(count(*) FILTER (WHERE role = 'assistant' AND turn % 5 <> 4) AS INTEGER) AS answered FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id",
    "turn_taking_scores": """WITH c AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations WHERE role <> 'system'),
        g AS (SELECT conv_id, arg_min(role, i) AS f, arg_max(role, i) AS l, count(*) FILTER (WHERE role = 'user') AS u, count(*) FILTER (WHERE role = 'assistant') AS a, bool_or(role = 'assistant' AND before = 'assistant') AS sa, bool_or(role = 'user' AND before = 'user') AS su FROM c GROUP BY conv_id),
        s AS (SELECT CASE WHEN g.conv_id IS NULL THEN 0.0::DOUBLE WHEN f <> 'user' THEN 0.2 WHEN sa THEN 0.0 WHEN u = 1 AND a >= 4 THEN 0.0 WHEN a = 0 THEN 0.1 WHEN su THEN 0.3 WHEN l = 'user' THEN 0.4 WHEN u >= 2 AND a >= 2 THEN 1.0 ELSE 0.7 END AS score FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN g ON k.conv_id = g.conv_id)
        SELECT score, count(*) AS n FROM s GROUP BY score""",
    "row_shapes": "SELECT CASE WHEN doc_id % 5 = 0 THEN 'v1' WHEN doc_id % 7 = 0 THEN 'hf_flat' WHEN doc_id % 3 = 0 THEN 'engine' WHEN doc_id % 2 = 0 THEN 'otel' ELSE 'loose' END AS shape, count(*) AS n FROM documents GROUP BY 1",
    "row_problems": "SELECT problem, count(*) AS n FROM (SELECT 'unknown_schema_version' AS problem FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT 'reward_not_number' FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT 'chosen_missing' FROM documents WHERE doc_id % 3 = 0) GROUP BY problem",
    "loaded_traces": "WITH d AS (SELECT doc_id AS k, CASE WHEN doc_id % 2 <> 0 AND text <> '' THEN text WHEN doc_id % 3 = 0 THEN 'q' ELSE '' END AS p FROM documents) SELECT count(*) AS n, count(*) FILTER (WHERE k % 4 <> 0) AS graded, count(*) FILTER (WHERE p = 'q') AS by_alias, count(*) FILTER (WHERE k % 5 = 0) AS replies, count(*) FILTER (WHERE k % 4 = 0) AS steps FROM d WHERE p <> '' OR k % 4 = 0",
    "bound_tool_results": "WITH g AS (SELECT CAST(event_id % 3 AS VARCHAR) AS tool, count(*) FILTER (WHERE event_type = 'click') AS c, count(*) FILTER (WHERE event_type = 'view') AS r FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id, 1) SELECT tool, CAST(sum(greatest(c, r)) AS BIGINT) AS steps, CAST(sum(c) AS BIGINT) AS calls, CAST(sum(r) AS BIGINT) AS results, CAST(sum(least(c, r)) AS BIGINT) AS \"both\" FROM g GROUP BY tool",
    "training_export": """WITH c AS (SELECT conv_id, list(role ORDER BY turn, role, text) AS r FROM conversations GROUP BY conv_id), s AS (SELECT conv_id, CASE WHEN list_contains(r, 'system') THEN r ELSE list_concat(['system'], r) END AS r FROM c),
        p AS (SELECT conv_id, r, coalesce(list_max(list_filter(range(1, len(r) + 1), lambda i: r[i] = 'assistant')), 0) AS l FROM s) SELECT conv_id, CAST(len(r) AS INTEGER) AS n_messages, r[1] AS first_role, array_to_string(list_transform(range(1, len(r) + 1), lambda i: CASE WHEN i = l THEN 1 ELSE 0 END), '') AS mask FROM p""",
    "exported_calls": "SELECT count(*) AS checked, count(*) FILTER (WHERE event_id % 10 IN (0, 1)) AS broken FROM events",
    "traced_arguments": "SELECT event_type AS tool, argument, count(*) AS calls FROM (SELECT event_type, unnest(json_keys(props)) AS argument FROM events) GROUP BY ALL",
    "failed_steps": f"SELECT event_type, count(*) AS n, count(*) FILTER (WHERE {_FAILED}) AS failed FROM events GROUP BY event_type",
    "result_exemplars": """WITH r AS (SELECT event_type AS tool, event_id, CASE WHEN event_id % 4 = 0 THEN '{"a": 1, "b": 2}' ELSE props END AS result FROM events), s AS (SELECT *, array_to_string(list_sort(json_keys(result)), ',') AS shape FROM r),
        f AS (SELECT tool, shape, min(event_id) AS first_at, arg_min(result, event_id) AS result FROM s GROUP BY tool, shape), k AS (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY first_at) AS k FROM f) SELECT tool, shape, result, CAST(k AS INTEGER) AS k FROM k WHERE k <= 3""",
    "trace_regions": """WITH g AS (SELECT user_id % 20 AS region, count(*) AS support, count(*) FILTER (WHERE day(ts) <= 15) AS n0, count(*) FILTER (WHERE day(ts) > 15) AS n1, count(*) FILTER (WHERE day(ts) <= 15 AND event_type = 'error') AS f0, count(*) FILTER (WHERE day(ts) > 15 AND event_type = 'error') AS f1 FROM events GROUP BY 1),
        r AS (SELECT *, f0 / n0::DOUBLE AS early, f1 / n1::DOUBLE AS late FROM g), s AS (SELECT *, CASE WHEN support < 3 THEN 'uncertain' WHEN f0 = 0 AND f1 = 0 THEN 'passing' WHEN f1 = 0 THEN CASE WHEN n1 > 0 THEN 'solved' ELSE 'uncertain' END WHEN f0 = 0 THEN 'new' WHEN late < early THEN 'improving' ELSE 'persistent' END AS status FROM r),
        p AS (SELECT *, CASE status WHEN 'new' THEN 1.0::DOUBLE WHEN 'persistent' THEN 0.9::DOUBLE WHEN 'improving' THEN 0.6::DOUBLE WHEN 'uncertain' THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END * least(1.0::DOUBLE, 0.5 + 0.5 * least(f0 + f1, 6) / 6.0::DOUBLE) * (0.25 + 0.75 * (f0 + f1 + 1) / (support + 2)::DOUBLE) AS priority FROM s)
        SELECT region, support, round(early, 6) AS early, round(late, 6) AS late, status, round(priority, 6) AS priority, round(coalesce(0.8 * priority / nullif(sum(priority) OVER (), 0), 0), 6) AS share FROM p""",
    "grounded_arguments": "SELECT lang, CAST(count(*) FILTER (WHERE NOT contains(regexp_replace(lower(text), '[ _-]', '', 'g'), 'zznotthere')) AS BIGINT) AS invented, count(*) AS n FROM documents GROUP BY lang",
    "missing_copies": "SELECT CAST(sum(greatest(0, 12 - n)) AS BIGINT) AS missing, count(*) AS cells FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)",
    "evaluation_power": f"WITH {STATS_SQL}, s AS (SELECT count(*) AS tasks, count(*) FILTER (WHERE c = 0 OR c = n) AS tied, avg(c / n::DOUBLE) AS base FROM stats), z AS (SELECT *, greatest(2, CAST(ceil(pow((1.959963984540054 + 0.8416212335729143) * sqrt((base*(1-base) + (base+0.05)*(0.95-base)) / 4) / 0.05, 2)) AS BIGINT)) AS needed FROM s) SELECT tasks, tied, round(base, 6) AS base, needed, CASE WHEN tasks >= needed THEN 'usable' ELSE 'underpowered' END AS verdict FROM z",
}
