"""Queries over vectors, hack scans, conversations, policy updates and verifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions.keys import hash_int
from gradeloom.operators import scanning, trajectories, vectors, verifying
from gradeloom.plans.graded_queries import rounded
from gradeloom.plans.tables import GRADED_SQL, ROLLOUTS_SQL, STATS_SQL, graded, rollouts, table
from gradeloom.operators import groups


def _vectors(spark, sf):
    return table(spark, sf, "embeddings")


def novelty_scores(spark, sf):
    v = _vectors(spark, sf)
    return vectors.novelty(v.where("vec_id % 10 <> 0"), v.where("vec_id % 10 = 0"), key="vec_id", vector="embedding").select("vec_id", F.round("novelty", 5).alias("novelty"))


def near_vector_pairs(spark, sf):
    out = vectors.near_pairs(_vectors(spark, sf), key="vec_id", vector="embedding", threshold=0.9)
    return out.select("a", "b", F.round("cosine", 5).alias("cosine"))


def lloyd_step(spark, sf):
    v = _vectors(spark, sf)
    centres = v.where("vec_id < 8").select(F.col("vec_id").alias("centre"), "embedding")
    assigned, _ = vectors.cluster_step(v, centres, key="vec_id", vector="embedding")
    return assigned.groupBy("centre").agg(F.count("*").alias("n"), F.round(F.sum("distance2"), 4).alias("inertia"))


def lloyd_centres(spark, sf):
    v = _vectors(spark, sf)
    centres = v.where("vec_id < 8").select(F.col("vec_id").alias("centre"), "embedding")
    _, moved = vectors.cluster_step(v, centres, key="vec_id", vector="embedding")
    return moved.select("centre", "dim", F.round("value", 6).alias("value"), "n")


def distinct_task_similarity(spark, sf):
    return vectors.distinct_task_similarity(_vectors(spark, sf), key="vec_id", vector="embedding", task="label")


def farthest_first(spark, sf):
    return vectors.farthest_first(_vectors(spark, sf), key="vec_id", vector="embedding", k=5)


_FEATURES = ["cheap", "big", "reply_length", "score", "size"]


def _scan_rows(spark, sf):
    return graded(spark, sf).withColumn("size", (F.col("reply_length") > 25).cast("double"))


def hack_scan(spark, sf):
    return rounded(scanning.within_rho(_scan_rows(spark, sf), _FEATURES, task="task_id", reward="reward"))


def hack_scan_aliases(spark, sf):
    rows = rollouts(spark, sf).withColumn("size", (F.col("reply_length") > 25).cast("double")).withColumn("key", F.concat_ws("-", "task_id", "rollout_index"))
    return scanning.aliases(rows, ["cheap", "big", "size"], key="key")


def hack_scan_support(spark, sf):
    return rounded(scanning.support(groups.task_stats(graded(spark, sf))))


def hack_scan_floor(spark, sf):
    rows = rollouts(spark, sf).select("task_id", "reward", "cheap", "big", F.concat_ws("-", "task_id", "rollout_index").alias("key"))
    return rounded(scanning.permutation_floor(rows, ["cheap", "big"], task="task_id", reward="reward", key="key", draws=20))


def _chats(spark, sf):
    return trajectories.as_messages(table(spark, sf, "conversations"), conv="conv_id", turn="turn", role="role", text="text")


def loss_masks(spark, sf):
    c = _chats(spark, sf)
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, y: s + y)
    return c.select("conv_id", F.size("messages").alias("n_messages"), total(trajectories.loss_mask()).alias("on"), total(trajectories.loss_mask(mode="final")).alias("on_final"), F.array_join(trajectories.loss_mask(), "").alias("mask"))


def unrolled_samples(spark, sf):
    return trajectories.unroll(_chats(spark, sf)).select("conv_id", "sample", F.size("messages").alias("n_messages"), F.md5(F.element_at("messages", -1)["content"].cast("binary")).alias("target"))


def conversation_shape(spark, sf):
    c = _chats(spark, sf)
    return c.select("conv_id", F.size("messages").alias("n_messages"), trajectories.spoken_beats().alias("beats"), F.element_at("messages", -1)["role"].alias("last_role"), F.md5(F.try_element_at(F.filter("messages", lambda m: m["role"] == "user"), F.lit(1))["content"].cast("binary")).alias("opening"))


def stage_leaks(spark, sf):
    rows = graded(spark, sf).withColumn("stage", F.when(hash_int(F.col("task_id")) % 10 == 0, F.when(F.col("arm") == "before", "eval").otherwise("rl")).otherwise("sft"))
    return trajectories.stage_report(rows, stage="stage", task="task_id")


def mean_kl(spark, sf):
    rows = rollouts(spark, sf).select(F.concat_ws("#", "task_id", "rollout_index").alias("key"), "arm", (-F.col("reply_length") * F.col("score") / 10).alias("logprob"), F.col("reply_length").alias("n_tokens"))
    ref = rows.where("n_tokens % 3 <> 0").select("key", (F.col("logprob") * 0.9 - 0.1).alias("ref_logprob"))
    return rounded(trajectories.mean_kl(rows, ref, "key", by=("arm",)))


def logprob_quantiles(spark, sf):
    rows = graded(spark, sf).select(F.round(F.col("score") / F.col("reply_length"), 6).alias("v"))
    return rounded(trajectories.nearest_rank(rows, "v", {"p10": 0.1, "p50": 0.5, "p90": 0.9}))


def _batch(spark, sf):
    v = _vectors(spark, sf)
    a = F.transform(F.slice("embedding", 1, 8), lambda x: -F.abs(x.cast("double")) - 0.05)
    b = F.transform(F.slice("embedding", 1, 8), lambda x: -F.abs(x.cast("double")) * 1.01 - 0.05)
    values = F.transform(F.slice("embedding", 9, 8), lambda x: x.cast("double") + 0.5)
    return v.select("vec_id", (F.col("label") % 2).cast("double").alias("reward"), a.alias("logprobs"), b.alias("behavior_logprobs"), values.alias("values"))


def _total(c):
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def flash_reinforce_update(spark, sf):
    out = trajectories.flash_reinforce(_batch(spark, sf))
    return out.select("vec_id", "admitted", F.round("advantage", 6).alias("advantage"), F.round("mean_kl", 6).alias("mean_kl"), F.round(_total("coefficients") * 1000, 5).alias("total"))


def single_rollout_update(spark, sf):
    out = trajectories.single_rollout(_batch(spark, sf))
    return out.select("vec_id", F.round(F.element_at("advantages", 1), 6).alias("first"), F.round(F.element_at("advantages", 8), 6).alias("last"), F.round(_total("coefficients") * 1000, 5).alias("total"))


def bounded_critic_update(spark, sf):
    out = trajectories.bounded_critic(_batch(spark, sf))
    return out.select("vec_id", F.round(F.element_at("advantages", 1), 6).alias("first"), F.round(_total("coefficients"), 5).alias("total"))


def verifier_scores(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("The answer is "), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).cast("string"), F.lit("\nB. ")).alias("candidate"), F.col("o_custkey").cast("string").alias("reference"), F.concat(F.lit('{"k": "'), "o_orderstatus", F.lit('"}')).alias("js"), "o_orderstatus")
    c, r = F.col("candidate"), F.col("reference")
    num, inc, rx, ch, js = verifying.numeric(c, r), verifying.includes(c, ["answer", "result"]), verifying.matches(c, r"is \d+5\b"), verifying.choice(c, F.lit("b")), verifying.json_field(F.col("js"), "$.k", F.lit("o"))
    both = {"numeric": (num, 2.0), "regex": (rx, 1.0), "json": (js, 1.0)}
    return d.select("o_orderkey", num.alias("numeric"), inc.alias("includes"), rx.alias("regex"), ch.alias("choice"), js.alias("json"), verifying.all_of(num, js).alias("all"), verifying.any_of(rx, js).alias("any"), F.round(verifying.weighted(both), 6).alias("weighted"), verifying.exact_match(r, F.concat(F.lit(" "), r, F.lit("."))).alias("exact"))


def rubric_scores(spark, sf):
    d = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("returned"), F.max((F.col("l_tax") > 0.05).cast("int")).alias("taxed"), F.min(F.col("l_quantity")).alias("q"), F.max("l_discount").alias("x"))
    item = lambda kind, w, met: F.struct(F.lit(kind).alias("kind"), F.lit(float(w)).alias("weight"), met.alias("met"))
    criteria = F.array(item("hard", 1, F.col("q") > 2), item("principle", 2, F.col("taxed") == 1), item("principle", 1, F.col("x") > 0.05), item("pitfall", 1, F.col("returned") == 1))
    return d.withColumn("criteria", criteria).select("l_orderkey", F.round(verifying.rubric("criteria"), 6).alias("score"))


def user_verifier_scores(spark, sf):
    def overlap(candidate: str, reference: str):
        a, b = set(candidate.lower().split()), set(reference.lower().split())
        return len(a & b) / len(b)

    score = verifying.user_verifier(overlap)
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("c"), F.element_at(F.split("text", "\n"), 1).alias("r"))
    return d.withColumn("v", score("c", "r")).select("doc_id", F.round("v.reward", 6).alias("reward"), "v.reason")


_E = "list_transform(embedding, lambda x: x::DOUBLE)"
_V = f"v AS (SELECT vec_id, label, {_E} AS e FROM embeddings)"
_COS = "list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))"
_D2 = "(list_dot_product(v.e, v.e) - 2 * list_dot_product(v.e, c.e) + list_dot_product(c.e, c.e))"
_NEAR = f"n AS (SELECT v.vec_id, v.e, c.vec_id AS centre, row_number() OVER (PARTITION BY v.vec_id ORDER BY {_D2}, c.vec_id) AS k, {_D2} AS d FROM v, v c WHERE c.vec_id < 8)"
_BATCH = """b AS (SELECT vec_id, (label % 2)::DOUBLE AS reward, list_transform(embedding[1:8], lambda x: -abs(x::DOUBLE) - 0.05) AS lp, list_transform(embedding[1:8], lambda x: -abs(x::DOUBLE) * 1.01 - 0.05) AS bp, list_transform(embedding[9:16], lambda x: x::DOUBLE + 0.5) AS v FROM embeddings)"""


def _gae_sql(alpha: float) -> str:
    lam = max(0.0, 1 - 1 / (alpha * 8))
    d = []
    for t in range(8):
        d.append(f"(v[{t + 2}] - v[{t + 1}])" if t < 7 else "(reward - v[8])")
    a = d[7]
    out = [a]
    for t in range(6, -1, -1):
        a = f"({d[t]} + {lam} * {out[0]})"
        out.insert(0, a)
    return "[" + ", ".join(out) + "]"


QUERIES = {f.__name__: f for f in (
    novelty_scores, near_vector_pairs, lloyd_step, lloyd_centres, distinct_task_similarity, farthest_first, hack_scan, hack_scan_aliases, hack_scan_support, hack_scan_floor, loss_masks, unrolled_samples, conversation_shape, stage_leaks,
    mean_kl, logprob_quantiles, flash_reinforce_update, single_rollout_update, bounded_critic_update, verifier_scores, rubric_scores, user_verifier_scores,
)}

ORACLES = {
    "novelty_scores": f"WITH {_V}, t AS (SELECT a.vec_id, max({_COS.format(a='a.e', b='b.e')}) AS c FROM v a, v b WHERE a.vec_id % 10 <> 0 AND b.vec_id % 10 = 0 GROUP BY a.vec_id) SELECT vec_id, round(greatest(0.0, 1 - c), 5) AS novelty FROM t",
    "near_vector_pairs": f"WITH {_V}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, {_COS.format(a='a.e', b='b.e')} AS c FROM v a, v b WHERE a.vec_id < b.vec_id) SELECT a, b, round(c, 5) AS cosine FROM p WHERE c >= 0.9",
    "lloyd_step": f"WITH {_V}, {_NEAR} SELECT centre, count(*) AS n, round(sum(d), 4) AS inertia FROM n WHERE k = 1 GROUP BY centre",
    "lloyd_centres": f"WITH {_V}, {_NEAR}, u AS (SELECT centre, unnest(range(len(e))) AS dim, unnest(e) AS x FROM n WHERE k = 1) SELECT centre, CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS value, count(*) AS n FROM u GROUP BY centre, dim",
    "distinct_task_similarity": f"WITH {_V}, p AS (SELECT round({_COS.format(a='a.e', b='b.e')}, 5) AS c FROM v a, v b WHERE a.label < b.label), k AS (SELECT c, row_number() OVER (ORDER BY c) AS i, count(*) OVER () AS n FROM p) SELECT min(c) AS cosine, min(n) AS pairs FROM k WHERE i >= ceil(0.99 * n)",
    "hack_scan": f"""WITH {GRADED_SQL}, l AS (SELECT task_id, reward, reward - avg(reward) OVER (PARTITION BY task_id) AS rc, unnest(['cheap', 'big', 'reply_length', 'score', 'size']) AS feature, unnest([cheap, big, reply_length::DOUBLE, score, CASE WHEN reply_length > 25 THEN 1.0 ELSE 0.0 END]) AS x FROM graded),
        c AS (SELECT *, x - avg(x) OVER (PARTITION BY feature, task_id) AS xc FROM l) SELECT feature, round(CASE WHEN sum(xc*xc) > 1e-9 AND sum(rc*rc) > 1e-9 THEN sum(xc*rc) / sqrt(sum(xc*xc) * sum(rc*rc)) END, 6) AS rho, count(*) FILTER (WHERE x <> 0) AS n_nonzero FROM c GROUP BY feature HAVING count(*) FILTER (WHERE x <> 0) >= 20""",
    "hack_scan_aliases": f"WITH {GRADED_SQL}, d AS (SELECT sum(abs(big - CASE WHEN reply_length > 25 THEN 1 ELSE 0 END)) AS off FROM graded) SELECT unnest(['cheap', 'big', 'size']) AS feature, unnest(['cheap', 'big', CASE WHEN off = 0 THEN 'big' ELSE 'size' END]) AS alias_of FROM d",
    "hack_scan_support": f"WITH {STATS_SQL} SELECT count(*) AS tasks, round(avg((c = n)::INT::DOUBLE), 6) AS sat, round(avg((c = 0)::INT::DOUBLE), 6) AS dead, round(avg((c > 0 AND c < n)::INT::DOUBLE), 6) AS mixed, round(avg((c / n::DOUBLE) * (1 - c / n::DOUBLE)) / 0.25, 6) AS capacity FROM stats",
    "hack_scan_floor": f"""WITH {ROLLOUTS_SQL}, r AS (SELECT task_id, reward, cheap, big, task_id || '-' || rollout_index AS key FROM rollouts), o AS (SELECT task_id, reward AS sr, row_number() OVER (PARTITION BY task_id ORDER BY key) AS p FROM r),
        d AS (SELECT draw, r.*, row_number() OVER (PARTITION BY draw, task_id ORDER BY CAST('0x' || substr(md5('r0:' || draw || ':' || key), 1, 8) AS BIGINT), key) AS p FROM r, (SELECT unnest(range(20)) AS draw)),
        m AS (SELECT d.draw, d.task_id, o.sr, d.cheap, d.big FROM d JOIN o ON d.task_id = o.task_id AND d.p = o.p), c AS (SELECT draw, sr - avg(sr) OVER w AS rc, cheap - avg(cheap) OVER w AS a, big - avg(big) OVER w AS b FROM m WINDOW w AS (PARTITION BY draw, task_id)),
        x AS (SELECT draw, greatest(abs(sum(a*rc)) / sqrt(sum(a*a) * sum(rc*rc)), abs(sum(b*rc)) / sqrt(sum(b*b) * sum(rc*rc))) AS m FROM c GROUP BY draw) SELECT round(list_sort(list(m))[19], 6) AS floor FROM x""",
    "loss_masks": "WITH c AS (SELECT conv_id, list(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END ORDER BY turn, role, text) AS m FROM conversations GROUP BY conv_id) SELECT conv_id, CAST(len(m) AS INTEGER) AS n_messages, CAST(list_sum(m) AS INTEGER) AS \"on\", CAST(CASE WHEN list_contains(m, 1) THEN 1 ELSE 0 END AS INTEGER) AS on_final, array_to_string(m, '') AS mask FROM c",
    "unrolled_samples": "WITH c AS (SELECT conv_id, role, text, row_number() OVER w AS i, count(*) FILTER (WHERE role = 'assistant') OVER w AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)) SELECT conv_id, CAST(s AS INTEGER) AS sample, CAST(i AS INTEGER) AS n_messages, md5(text) AS target FROM c WHERE role = 'assistant'",
    "conversation_shape": """WITH c AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations WHERE role <> 'system'), b AS (SELECT conv_id, count(*) FILTER (WHERE before IS NULL OR before <> role) AS beats FROM c GROUP BY conv_id),
        a AS (SELECT conv_id, count(*) AS n, list(role ORDER BY turn, role, text)[-1] AS last_role, md5((list(text ORDER BY turn, role, text) FILTER (WHERE role = 'user'))[1]) AS opening FROM conversations GROUP BY conv_id)
        SELECT a.conv_id, CAST(n AS INTEGER) AS n_messages, CAST(coalesce(beats, 0) AS INTEGER) AS beats, last_role, opening FROM a LEFT JOIN b ON a.conv_id = b.conv_id""",
    "stage_leaks": f"""WITH {GRADED_SQL}, s AS (SELECT task_id, CASE WHEN CAST('0x' || substr(md5(CAST(task_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 = 0 THEN CASE WHEN arm = 'before' THEN 'eval' ELSE 'rl' END ELSE 'sft' END AS stage FROM graded), p AS (SELECT stage, task_id, count(*) AS k FROM s GROUP BY ALL)
        SELECT stage, CAST(sum(k) AS BIGINT) AS row_count, count(*) AS tasks, count(*) FILTER (WHERE stage <> 'eval' AND task_id IN (SELECT task_id FROM p WHERE stage = 'eval')) AS leaks FROM p GROUP BY stage""",
    "mean_kl": f"WITH {GRADED_SQL}, r AS (SELECT arm, -reply_length * score / 10 AS lp, reply_length AS n FROM graded WHERE reply_length % 3 <> 0) SELECT arm, count(*) AS n, round(sum(lp - (lp * 0.9 - 0.1)) / sum(n), 6) AS mean_kl FROM r GROUP BY arm",
    "logprob_quantiles": f"WITH {GRADED_SQL}, s AS (SELECT list_sort(list(round(score / reply_length, 6))) AS v FROM graded) SELECT v[CAST(round_even(0.1 * (len(v) - 1), 0) AS BIGINT) + 1] AS p10, v[CAST(round_even(0.5 * (len(v) - 1), 0) AS BIGINT) + 1] AS p50, v[CAST(round_even(0.9 * (len(v) - 1), 0) AS BIGINT) + 1] AS p90 FROM s",
    "flash_reinforce_update": f"""WITH {_BATCH}, m AS (SELECT *, avg(reward) OVER () AS mean, count(*) OVER () AS n FROM b), k AS (SELECT *, list_sum(list_transform(range(1, 9), lambda i: exp(bp[i]) * (bp[i] - lp[i]) + (1 - exp(bp[i])) * ln((1 - exp(bp[i])) / (1 - exp(lp[i]))))) / 8 AS kl FROM m)
        SELECT vec_id, kl <= 0.003 AS admitted, round(reward - mean, 6) AS advantage, round(kl, 6) AS mean_kl, round(CASE WHEN kl <= 0.003 THEN list_sum(list_transform(range(1, 9), lambda i: (reward - mean) * exp(lp[i] - bp[i]) / (8 * n))) ELSE 0 END * 1000, 5) AS total FROM k""",
    "single_rollout_update": f"""WITH {_BATCH}, a AS (SELECT *, {_gae_sql(1.5)} AS a, 8 * count(*) OVER () AS t FROM b)
        SELECT vec_id, round(a[1], 6) AS first, round(a[8], 6) AS last, round(list_sum(list_transform(range(1, 9), lambda i: CASE WHEN exp(lp[i] - bp[i]) > 0.7 AND exp(lp[i] - bp[i]) < 6 THEN exp(lp[i] - bp[i]) * a[i] ELSE 0 END)) / t * 1000, 5) AS total FROM a""",
    "bounded_critic_update": f"""WITH {_BATCH}, a AS (SELECT *, {_gae_sql(0.4)} AS a FROM b)
        SELECT vec_id, round(a[1], 6) AS first, round(list_sum(list_transform(range(1, 9), lambda i: CASE WHEN a[i] >= 0 AND exp(lp[i] - bp[i]) <= 1 + 0.2 / exp(bp[i]) OR a[i] < 0 AND exp(lp[i] - bp[i]) >= 1 - 0.2 / exp(bp[i]) THEN exp(lp[i] - bp[i]) * a[i] ELSE 0 END)), 5) AS total FROM a""",
    "verifier_scores": r"""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS said, o_custkey AS ref, o_orderstatus AS s FROM orders), v AS (SELECT o_orderkey, CASE WHEN abs(said - ref) <= greatest(1e-6, 1e-6 * ref) THEN 1.0::DOUBLE ELSE 0.0 END AS num, CASE WHEN said % 10 = 5 AND said >= 10 THEN 1.0::DOUBLE ELSE 0.0 END AS rx, CASE WHEN lower(s) = 'o' THEN 1.0::DOUBLE ELSE 0.0 END AS js FROM o)
        SELECT o_orderkey, num AS numeric, 1.0::DOUBLE AS includes, rx AS regex, 1.0::DOUBLE AS choice, js AS json, least(num, js) AS "all", greatest(rx, js) AS "any", round((2 * num + rx + js) / 4, 6) AS weighted, 1.0::DOUBLE AS exact FROM v""",
    "rubric_scores": """WITH d AS (SELECT l_orderkey, max((l_returnflag = 'R')::INT) AS r, max((l_tax > 0.05)::INT) AS t, min(l_quantity) AS q, max(l_discount) AS x FROM lineitem GROUP BY l_orderkey)
        SELECT l_orderkey, round(CASE WHEN NOT q > 2 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (2.0 * t + CASE WHEN x > 0.05 THEN 1 ELSE 0 END - r) / 3.0::DOUBLE)) END, 6) AS score FROM d""",
}
