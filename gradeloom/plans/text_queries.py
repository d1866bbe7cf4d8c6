"""Queries over documents, labels, chats and events: hygiene, decontamination, markers, agreement, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions.keys import stable_key
from gradeloom.functions.text import any_phrase, bigrams, last_number, ngrams, normalised, phrase_hits, split_reasoning, stock_markers, style_markers, words
from gradeloom.functions import text as T
from gradeloom.operators import agreement, decontam, hygiene, selecting
from gradeloom.plans.graded_queries import rounded
from gradeloom.plans.tables import GRADED_SQL, ROLLOUTS_SQL, graded, rollouts, table


def docs(spark, sf):
    return table(spark, sf, "documents")


def duplicate_rows(spark, sf):
    d = docs(spark, sf).join(table(spark, sf, "labels").dropDuplicates(["doc_id"]), "doc_id", "left")
    out = hygiene.dedupe_first(d, [F.lit("p"), normalised(F.col("text"))], ["doc_id"], "quality")
    return out.select("doc_id", F.col("copy").cast("int").alias("copy"), "label_conflict")


def near_duplicate_prompts(spark, sf):
    prompts = table(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return rounded(hygiene.near_duplicate_pairs(prompts, key="id", text="text"))


def length_report(spark, sf):
    d = docs(spark, sf).select("source", F.length("text").alias("chars"))
    return rounded(hygiene.length_report(d, group="source", length="chars"))


def reward_correlations(spark, sf):
    d = docs(spark, sf).join(table(spark, sf, "labels").dropDuplicates(["doc_id"]), "doc_id")
    d = d.select("quality", F.length("text").alias("chars"), F.size(words(F.col("text"))).alias("words"), F.size(F.split("text", "\n")).alias("lines"), "toxic", F.lit(1).alias("constant"))
    return rounded(hygiene.correlations(d, "quality", ["chars", "words", "lines", "toxic", "constant"]))


def _calls(spark, sf):
    return table(spark, sf, "events").withColumn("tool", F.concat("event_type", F.lit("_"), F.pmod("user_id", F.lit(7)).cast("string")))


def tool_outcomes(spark, sf):
    return hygiene.tool_outcomes(_calls(spark, sf), tool="tool", failed=(F.col("event_type") == "error") | (F.col("value") < 10))


def dead_tools(spark, sf):
    return rounded(hygiene.dead_tools(tool_outcomes(spark, sf)))


def dataset_counts(spark, sf):
    return hygiene.coverage_counts(docs(spark, sf), ["text", "lang", "source"])


def decontam_exact(spark, sf):
    evals = table(spark, sf, "benchmark")
    train = docs(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return decontam.exact_hits(train, evals, key="doc_id", text="line", eval_text="text").distinct()


def decontam_ngrams(spark, sf):
    train = docs(spark, sf).select((F.col("doc_id")).alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line", "text")).select((F.col("doc_id") * 100_000 + F.col("line")).alias("line_id"), "text")
    return rounded(decontam.ngram_coverage(train, table(spark, sf, "benchmark"), key="line_id", text="text", eval_key="item_id", eval_text="text"))


def decontam_same_task(spark, sf):
    held = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return docs(spark, sf).select("doc_id", "lang").join(held, "doc_id", "left_semi")


def leaky_rows(spark, sf):
    """Rows left after those that match a source exactly or by cosine are taken out."""
    v = table(spark, sf, "embeddings")
    sources = v.where("vec_id % 5 = 0 AND label < 5").select(F.col("vec_id").alias("source_id"), "embedding")
    near = decontam.best_cosine(v.where("vec_id % 5 <> 0"), sources, key="vec_id", vector="embedding", source_key="source_id", source_vector="embedding")
    return v.where("vec_id % 5 <> 0").join(near.where("cosine >= 0.9"), "vec_id", "left_anti").select("vec_id", "label")


def nearest_source(spark, sf):
    v = table(spark, sf, "embeddings")
    sources = v.where("vec_id % 5 = 0").select(F.col("vec_id").alias("source_id"), "embedding")
    out = decontam.best_cosine(v.where("vec_id % 5 <> 0"), sources, key="vec_id", vector="embedding", source_key="source_id", source_vector="embedding")
    return out.select("vec_id", "source_id", F.round("cosine", 5).alias("cosine"))


def quoted_secret(spark, sf):
    d = docs(spark, sf).withColumn("needles", F.array(F.concat(F.substring("text", 21, 12)), F.lit("no such secret here")))
    return d.select("doc_id", F.md5(decontam.contained(d, "needles", "text").cast("binary")).alias("quoted"))


def style_report(spark, sf):
    m = style_markers(F.col("text"))
    return rounded(table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n"), *(F.avg(c).alias(k) for k, c in m.items())))


def stock_marker_rates(spark, sf):
    chat = table(spark, sf, "conversations").withColumn("said", F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" Certainly! I must decline. That said, you're right."))).otherwise(F.col("text")))
    m = stock_markers(F.col("said"))
    return rounded(chat.groupBy("role").agg(*(F.avg(c.cast("double")).alias(k) for k, c in m.items())))


def refusal_report(spark, sf):
    d = docs(spark, sf).withColumn("said", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(" I cannot assist with that."))).otherwise(F.col("text")))
    d = d.withColumn("refused", any_phrase(F.col("said"), T.REFUSAL).cast("long"))
    from gradeloom.functions.stats import wilson

    out = d.groupBy("lang").agg(F.count("*").alias("n"), F.sum("refused").alias("refused"))
    lo, hi = wilson(F.col("refused"), F.col("n"))
    return rounded(out.withColumns({"rate": F.col("refused") / F.col("n"), "ci_lo": lo, "ci_hi": hi}))


def phrase_counts(spark, sf):
    d = docs(spark, sf).withColumn("said", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" It depends. Keep in mind that generally speaking."))).otherwise(F.col("text")))
    return d.select(F.explode(phrase_hits(F.col("said"), T.HEDGING)).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("hits"))


def think_split(spark, sf):
    d = docs(spark, sf).select("doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("<think>a b</think>")).otherwise(F.lit("")), F.col("text"), F.when(F.col("doc_id") % 5 == 0, F.lit("<think>open tail")).otherwise(F.lit(""))).alias("said"))
    spoken, blocks, tail = split_reasoning(F.col("said"))
    return d.select("doc_id", F.length(spoken).alias("spoken_chars"), F.size(blocks).alias("closed_blocks"), tail.isNotNull().alias("unclosed"))


def vocabulary(spark, sf):
    """The 200 words that most documents have, of those in 20 or more but not all; ties by word."""
    w = docs(spark, sf).select(F.explode(F.array_distinct(words(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = docs(spark, sf).count()
    return w.where((F.col("df") >= 20) & (F.col("df") < n)).orderBy(F.desc("df"), "term").limit(200)


def bigram_counts(spark, sf):
    chat = table(spark, sf, "conversations").where("role = 'user'")
    return chat.select("conv_id", "turn", F.size(bigrams(words(F.col("text")))).alias("bigrams"), F.size(ngrams(words(F.col("text")), 8)).alias("grams8"))


def numbers_in_text(spark, sf):
    return rounded(docs(spark, sf).select("doc_id", last_number(F.col("text")).alias("answer")))


def _judged(spark, sf):
    d = docs(spark, sf).join(table(spark, sf, "labels").dropDuplicates(["doc_id"]), "doc_id")
    n = F.size(words(F.col("text")))
    return d.select("doc_id", F.length("text").alias("chars"), F.col("quality").alias("gold_reward"), F.col("toxic"), F.when(F.size(F.array_distinct(words(F.col("text")))) > 0.4 * n, 1).otherwise(0).alias("varied"), F.when(n > 150, 1).otherwise(0).alias("long"), (1 - F.col("toxic")).alias("civil"))


def judge_agreement(spark, sf):
    return rounded(agreement.agreement(_judged(spark, sf), judged="varied"))


def judge_ranking(spark, sf):
    long = _judged(spark, sf).select("gold_reward", F.explode(F.array(*(F.struct(F.lit(j).alias("judge"), F.col(j).alias("reward")) for j in ("varied", "long", "civil")))).alias("e")).select("gold_reward", "e.*")
    return rounded(agreement.rank_judges(agreement.agreement(long, by=("judge",)), "judge"))


def length_sensitivity(spark, sf):
    return rounded(agreement.length_sensitivity(_judged(spark, sf), judged="varied", gold="gold_reward", length="chars"))


def _votes(spark, sf):
    l = table(spark, sf, "labels").dropDuplicates(["doc_id"])
    return l.select(F.col("doc_id").alias("row_key"), F.explode(F.array(F.struct(F.lit("ann").alias("annotator"), F.col("quality").alias("label")), F.struct(F.lit("bob").alias("annotator"), (1 - F.col("toxic")).alias("label")), F.struct(F.lit("cyd").alias("annotator"), F.when(F.col("doc_id") % 7 == 0, 0).otherwise(F.col("quality")).alias("label")))).alias("e")).select("row_key", "e.*", F.col("row_key").alias("ts"))


def annotator_agreement(spark, sf):
    return rounded(agreement.annotator_agreement(_votes(spark, sf)))


def attached_labels(spark, sf):
    rows = docs(spark, sf).select(F.col("doc_id").alias("row_key"), "source")
    labels = _votes(spark, sf).select(F.concat(F.lit("d"), "row_key").alias("name"), "label").unionByName(table(spark, sf, "region").select(F.concat(F.lit("src"), "r_regionkey").alias("name"), F.lit(1).alias("label")))
    out = agreement.attach_labels(rows, labels, [F.concat(F.lit("d"), "row_key"), F.col("source")])
    return out.select("row_key", "yes", "no", "ambiguous", "unmatched", "gold_reward")


def sft_selection(spark, sf):
    rows = rollouts(spark, sf).withColumn("signature", F.concat("harness", "model"))
    best = selecting.best_per_prompt(rows, prompt="task_id", reward="reward", signature="signature", order=["rollout_index"])
    out = selecting.round_robin(best.select("task_id", "rollout_index", "signature"), "signature", [stable_key(F.col("task_id"), "sft"), "task_id"], 500)
    return out.select("task_id", "rollout_index", "signature", "turn", "bucket_size", "pick")


def rl_selection(spark, sf):
    stats = graded(spark, sf).groupBy("task_id").agg(F.count("*").alias("n"), F.sum("reward").cast("long").alias("c"), F.min("harness").alias("bucket"))
    stats = stats.where("n >= 2 AND c > 0 AND c < n")
    return rounded(selecting.whole_groups(stats, task="task_id", bucket="bucket", target=1000).select("task_id", "n", "c", "bucket", "pick", "before"))


def preference_pairs(spark, sf):
    return selecting.preference_pairs(rollouts(spark, sf), task="task_id", score="reward", length="reply_length", key="rollout_index", order=["rollout_index"])


def preference_sets(spark, sf):
    """Two pairs a task."""
    return selecting.preference_sets(rollouts(spark, sf), task="task_id", score="reward", length="reply_length", key="rollout_index", order=["rollout_index"], pairs=2)


def length_confound(spark, sf):
    return selecting.length_confound(preference_sets(spark, sf))


def spread_order(spark, sf):
    s = graded(spark, sf).groupBy("task_id").agg(F.avg("reward").alias("rate"))
    return selecting.spread_by(s, F.col("rate"), ["task_id"]).select("task_id", "value", "lap")


def balanced_sampling(spark, sf):
    out = selecting.balanced_pick(rollouts(spark, sf), prompt="task_id", reward="reward", order=["rollout_index"], keep=4)
    return rounded(out.select("task_id", "rollout_index", "reward", "pool_rate", "advantage"))


def shaped_advantages(spark, sf):
    rows = selecting.rank_factors(rollouts(spark, sf), group="task_id", score="score")
    out = selecting.redistribute(rows, group="task_id", reward="reward", factor="factor")
    return rounded(out.select("task_id", "rollout_index", "factor", (F.col("advantage") + 1e-10).alias("advantage")))  # off the ties of rounding


def pairwise_coverage(spark, sf):
    """Planned pairs of attribute values that orders have, of all that their values could form."""
    o = table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus")
    planned = o.select("o_orderpriority").distinct().join(o.select("o_orderstatus").distinct())  # a grid of a few axis values
    seen = o.where("o_orderstatus <> 'P' OR o_orderpriority <> '1-URGENT'").distinct()
    got = planned.join(seen, ["o_orderpriority", "o_orderstatus"], "left_semi")
    return planned.agg(F.count("*").alias("planned")).join(got.agg(F.count("*").alias("observed"))).select("planned", "observed", F.round(F.col("observed") / F.col("planned"), 6).alias("share"))


_W = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_NORM = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
_LAB = "lab AS (SELECT doc_id, min(quality) AS quality, min(toxic) AS toxic FROM labels GROUP BY doc_id)"
_PHRASE = lambda t, ps: "(" + " OR ".join(f"contains(lower({t}), '{p.replace(chr(39), chr(39) * 2)}')" for p in ps) + ")"
_STOCK = lambda t, ps: "avg(CASE WHEN regexp_matches(" + t + ", '" + "|".join(f"(?:{p})" for p in ps).replace("'", "''") + "', 'i') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
_JUDGED = f"""{_LAB}, jw AS (SELECT d.doc_id, length(text) AS chars, quality AS gold, toxic, {_W.format('text')} AS w FROM documents d JOIN lab ON d.doc_id = lab.doc_id),
  judged AS (SELECT doc_id, chars, gold, CASE WHEN len(list_distinct(w)) > 0.4 * len(w) THEN 1 ELSE 0 END AS varied, CASE WHEN len(w) > 150 THEN 1 ELSE 0 END AS long, 1 - toxic AS civil FROM jw)"""
_CONF = "count(*) FILTER (WHERE j = 1 AND g = 1) AS tp, count(*) FILTER (WHERE j = 1 AND g = 0) AS fp, count(*) FILTER (WHERE j = 0 AND g = 1) AS fn, count(*) FILTER (WHERE j = 0 AND g = 0) AS tn"
_MORE = """(tp + tn) / (tp + fp + fn + tn)::DOUBLE AS agreement,
  greatest(0.0, (((tp+tn)/n::DOUBLE) + 3.8416/(2*n)) / (1 + 3.8416/n) - 1.96*sqrt(((tp+tn)/n::DOUBLE)*(1-(tp+tn)/n::DOUBLE)/n + 3.8416/(4.0*n*n)) / (1 + 3.8416/n)) AS agreement_lo,
  CASE WHEN pe >= 1 THEN CASE WHEN tp + tn = n THEN 1.0 ELSE 0.0 END ELSE round(((tp + tn) / n::DOUBLE - pe) / (1 - pe), 4) END AS kappa,
  CASE WHEN fp + tn > 0 THEN fp / (fp + tn)::DOUBLE END AS leak_rate, CASE WHEN fn + tp > 0 THEN fn / (fn + tp)::DOUBLE END AS miss_rate"""
_PE = "*, tp + fp + fn + tn AS n, ((tp+fp)/(tp+fp+fn+tn)::DOUBLE)*((tp+fn)/(tp+fp+fn+tn)::DOUBLE) + ((fn+tn)/(tp+fp+fn+tn)::DOUBLE)*((fp+tn)/(tp+fp+fn+tn)::DOUBLE) AS pe"
_SIX = "round(agreement, 6) AS agreement, round(agreement_lo, 6) AS agreement_lo, kappa, round(leak_rate, 6) AS leak_rate, round(miss_rate, 6) AS miss_rate"
_CALLS = "SELECT event_type || '_' || (user_id % 7) AS tool, count(*) AS calls, count(*) FILTER (WHERE NOT (event_type = 'error' OR value < 10)) AS ok, count(*) FILTER (WHERE event_type = 'error' OR value < 10) AS faults, 0::BIGINT AS injected FROM events GROUP BY 1"
_VOTES = f"{_LAB}, votes AS (SELECT doc_id AS row_key, unnest(['ann', 'bob', 'cyd']) AS annotator, unnest([quality, 1 - toxic, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE quality END]) AS label FROM lab)"
_UNIT = "list_transform({0}, lambda x: x::DOUBLE)"

_ROUND = lambda rows: f"""(SELECT task_id, chosen, rejected, margin, chosen_length, rejected_length FROM (SELECT r.task_id, b.rollout_index AS chosen, r.rollout_index AS rejected, b.reward - r.reward AS margin, b.reply_length AS chosen_length, r.reply_length AS rejected_length,
        row_number() OVER (PARTITION BY r.task_id ORDER BY abs(r.reply_length - b.reply_length), r.reward DESC, r.rollout_index) AS k FROM {rows} r JOIN (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY reward DESC, rollout_index) AS k FROM {rows}) b ON r.task_id = b.task_id AND b.k = 1 WHERE b.reward - r.reward >= 1) WHERE k = 1)"""  # noqa: E731
_SETS = f"""{ROLLOUTS_SQL}, one AS {_ROUND('rollouts')}, rest AS (SELECT r.* FROM rollouts r LEFT JOIN one ON r.task_id = one.task_id WHERE one.task_id IS NULL OR r.rollout_index NOT IN (chosen, rejected)), two AS {_ROUND('rest')},
  sets AS (SELECT *, 1 AS pair FROM one UNION ALL SELECT *, 2 FROM two)"""

QUERIES = {f.__name__: f for f in (
    duplicate_rows, near_duplicate_prompts, length_report, reward_correlations, tool_outcomes, dead_tools, dataset_counts, decontam_exact, decontam_ngrams, decontam_same_task, leaky_rows, nearest_source, quoted_secret,
    style_report, stock_marker_rates, refusal_report, phrase_counts, think_split, vocabulary, bigram_counts, numbers_in_text, judge_agreement, judge_ranking, length_sensitivity, annotator_agreement,
    attached_labels, sft_selection, rl_selection, preference_pairs, preference_sets, length_confound, spread_order, balanced_sampling, shaped_advantages, pairwise_coverage,
)}

ORACLES = {
    "duplicate_rows": f"""WITH {_LAB}, d AS (SELECT d.doc_id, md5({_NORM.format('text')}) AS k, quality FROM documents d LEFT JOIN lab ON d.doc_id = lab.doc_id), w AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS copy, first_value(quality) OVER (PARTITION BY k ORDER BY doc_id) AS q1 FROM d)
        SELECT doc_id, CAST(copy AS INTEGER) AS copy, copy > 1 AND quality IS DISTINCT FROM q1 AS label_conflict FROM w""",
    "near_duplicate_prompts": f"""WITH p AS (SELECT conv_id * 1000 + turn AS id, list_sort(list_distinct({_W.format('text')})) AS s FROM conversations WHERE role = 'user'), r AS (SELECT s, min(id) AS id FROM p WHERE len(s) > 0 GROUP BY s),
        t AS (SELECT id, len(s) AS n, unnest(s) AS t FROM r), c AS (SELECT x.id AS a, y.id AS b, count(*) AS k, any_value(x.n) AS na, any_value(y.n) AS nb FROM t x JOIN t y ON x.t = y.t AND x.id < y.id GROUP BY x.id, y.id)
        SELECT a, b, round(k / (na + nb - k)::DOUBLE, 6) AS jaccard FROM c WHERE k / (na + nb - k)::DOUBLE >= 0.8 UNION ALL SELECT r.id, p.id, 1.0::DOUBLE FROM p JOIN r ON p.s = r.s WHERE p.id <> r.id""",
    "length_report": """WITH d AS (SELECT source, length(text) AS v FROM documents), g AS (SELECT source, quantile_cont(v, 0.5) AS m, max(v) AS x, count(*) AS k FROM d GROUP BY source)
        SELECT CAST(count(*) FILTER (WHERE k >= 2 AND m > 0 AND x > 4 * m) AS BIGINT) AS wide_groups, count(*) AS n_groups, (SELECT round(quantile_cont(v, 0.5)::DOUBLE, 6) FROM d) AS median_length, (SELECT CAST(max(v) AS INTEGER) FROM d) AS max_length FROM g""",
    "reward_correlations": f"""WITH {_LAB}, d AS (SELECT quality AS y, length(text) AS chars, len({_W.format('text')}) AS words, len(string_split(text, chr(10))) AS lines, toxic FROM documents d JOIN lab ON d.doc_id = lab.doc_id),
        l AS (SELECT y::DOUBLE AS y, unnest(['chars', 'words', 'lines', 'toxic', 'constant']) AS feature, unnest([chars, words, lines, toxic, 1])::DOUBLE AS x FROM d),
        s AS (SELECT feature, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x*x) AS sxx, sum(y*y) AS syy, sum(x*y) AS sxy FROM l GROUP BY feature), r AS (SELECT feature, CASE WHEN n*sxx-sx*sx > 1e-12 AND n*syy-sy*sy > 1e-12 THEN (n*sxy-sx*sy)/sqrt((n*sxx-sx*sx)*(n*syy-sy*sy)) END AS r FROM s)
        SELECT feature, round(r, 6) AS r, coalesce(abs(r) >= 0.3, false) AS flagged FROM r""",
    "tool_outcomes": _CALLS,
    "dead_tools": f"WITH t AS ({_CALLS}), h AS (SELECT *, least(1.0, ((ok/calls::DOUBLE) + 3.8416/(2*calls)) / (1 + 3.8416/calls) + 1.96*sqrt((ok/calls::DOUBLE)*(1-ok/calls::DOUBLE)/calls + 3.8416/(4.0*calls*calls)) / (1 + 3.8416/calls)) AS ok_hi FROM t) SELECT tool, calls, ok, faults, injected, round(ok_hi, 6) AS ok_hi FROM h WHERE calls >= 3 AND ok_hi < 0.3 AND injected < faults",
    "dataset_counts": "SELECT count(*) AS row_count, count(DISTINCT text) AS distinct_text, count(DISTINCT lang) AS distinct_lang, count(DISTINCT source) AS distinct_source FROM documents",
    "decontam_exact": f"WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT DISTINCT doc_id FROM t WHERE {_NORM.format('line')} IN (SELECT {_NORM.format('text')} FROM benchmark WHERE {_NORM.format('text')} <> '')",
    "decontam_ngrams": f"""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), w AS (SELECT doc_id * 100000 + i AS k, {_W.format('line')} AS w FROM l),
        g AS (SELECT k, len(w) AS n, p, array_to_string(w[p:p+7], ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS p FROM w WHERE len(w) >= 8)),
        b AS (SELECT DISTINCT item_id, array_to_string(w[p:p+7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS p FROM (SELECT item_id, {_W.format('text')} AS w FROM benchmark) WHERE len(w) >= 8)),
        h AS (SELECT DISTINCT k, n, item_id, unnest(range(p, p + 8)) AS at FROM g JOIN b ON g.g = b.g), s AS (SELECT k, item_id, count(*) / any_value(n)::DOUBLE AS c FROM h GROUP BY k, item_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c DESC, item_id) AS i FROM s) SELECT k AS line_id, item_id, round(c, 6) AS coverage FROM r WHERE i = 1 AND c >= 0.8""",
    "decontam_same_task": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "leaky_rows": f"""WITH v AS (SELECT vec_id, label, {_UNIT.format('embedding')} AS e FROM embeddings), x AS (SELECT a.vec_id, max(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e))) AS c FROM v a, v b WHERE a.vec_id % 5 <> 0 AND b.vec_id % 5 = 0 AND b.label < 5 GROUP BY a.vec_id)
        SELECT v.vec_id, label FROM v JOIN x ON v.vec_id = x.vec_id WHERE c < 0.9""",
    "nearest_source": f"""WITH v AS (SELECT vec_id, {_UNIT.format('embedding')} AS e FROM embeddings), x AS (SELECT a.vec_id, b.vec_id AS source_id, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) AS c FROM v a, v b WHERE a.vec_id % 5 <> 0 AND b.vec_id % 5 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, source_id) AS k FROM x) SELECT vec_id, source_id, round(c, 5) AS cosine FROM r WHERE k = 1""",
    "quoted_secret": "SELECT doc_id, CASE WHEN length(substr(text, 21, 12)) >= 12 THEN md5(substr(text, 21, 12)) END AS quoted FROM documents",
    "style_report": "SELECT role, count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN {_PHRASE('text', p)} THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS {k}" for k, p in T.STYLE.items()) + " FROM conversations GROUP BY role",
    "stock_marker_rates": "WITH c AS (SELECT role, CASE WHEN turn % 3 = 0 THEN text || ' Certainly! I must decline. That said, you''re right.' ELSE text END AS said FROM conversations) SELECT role, " + ", ".join(f"round({_STOCK('said', p)}, 6) AS {k}" for k, p in T.STOCK.items()) + " FROM c GROUP BY role",
    "refusal_report": f"""WITH d AS (SELECT lang, CASE WHEN doc_id % 4 = 0 THEN text || ' I cannot assist with that.' ELSE text END AS said FROM documents), s AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE {_PHRASE('said', T.REFUSAL)}) AS c FROM d GROUP BY lang)
        SELECT lang, n, c AS refused, round(c / n::DOUBLE, 6) AS rate, round(greatest(0.0, ((c/n::DOUBLE) + 3.8416/(2*n)) / (1 + 3.8416/n) - 1.96*sqrt((c/n::DOUBLE)*(1-c/n::DOUBLE)/n + 3.8416/(4.0*n*n)) / (1 + 3.8416/n)), 6) AS ci_lo, round(least(1.0, ((c/n::DOUBLE) + 3.8416/(2*n)) / (1 + 3.8416/n) + 1.96*sqrt((c/n::DOUBLE)*(1-c/n::DOUBLE)/n + 3.8416/(4.0*n*n)) / (1 + 3.8416/n)), 6) AS ci_hi FROM s""",
    "phrase_counts": "WITH d AS (SELECT lower(CASE WHEN doc_id % 3 = 0 THEN text || ' It depends. Keep in mind that generally speaking.' ELSE text END) AS said FROM documents), p AS (SELECT unnest([" + ", ".join("'" + p.replace("'", "''") + "'" for p in T.HEDGING) + "]) AS phrase) SELECT phrase, count(*) AS hits FROM d JOIN p ON contains(said, phrase) GROUP BY phrase",
    "think_split": """SELECT doc_id, CAST(length(trim(text, ' ')) AS INTEGER) AS spoken_chars, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS closed_blocks, doc_id % 5 = 0 AS unclosed FROM documents""",
    "vocabulary": f"WITH w AS (SELECT unnest(list_distinct({_W.format('text')})) AS term FROM documents), f AS (SELECT term, count(*) AS df FROM w GROUP BY term) SELECT term, df FROM f WHERE df >= 20 AND df < (SELECT count(*) FROM documents) ORDER BY df DESC, term LIMIT 200",
    "bigram_counts": f"WITH c AS (SELECT conv_id, turn, {_W.format('text')} AS w FROM conversations WHERE role = 'user') SELECT conv_id, turn, CAST(CASE WHEN len(w) = 1 THEN 1 WHEN len(w) = 0 THEN 0 ELSE len(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS INTEGER) AS bigrams, CAST(greatest(len(w) - 7, 0) AS INTEGER) AS grams8 FROM c",
    "numbers_in_text": r"WITH d AS (SELECT doc_id, list_last(regexp_extract_all(text, '-?\$?\d[\d,]*(?:\.\d+)?%?')) AS x FROM documents), y AS (SELECT doc_id, x, try_cast(regexp_replace(x, '[$,%]', '', 'g') AS DOUBLE) AS v FROM d) SELECT doc_id, round(CASE WHEN ends_with(x, '%') THEN v / 100 ELSE v END, 6) AS answer FROM y",
    "judge_agreement": f"WITH {_JUDGED}, c AS (SELECT {_CONF} FROM (SELECT varied AS j, gold AS g FROM judged)), p AS (SELECT {_PE} FROM c), m AS (SELECT tp, fp, fn, tn, {_MORE} FROM p) SELECT tp, fp, fn, tn, {_SIX} FROM m",
    "judge_ranking": f"""WITH {_JUDGED}, l AS (SELECT gold AS g, unnest(['varied', 'long', 'civil']) AS judge, unnest([varied, long, civil]) AS j FROM judged), c AS (SELECT judge, {_CONF} FROM l GROUP BY judge), p AS (SELECT {_PE} FROM c), m AS (SELECT judge, tp, fp, fn, tn, {_MORE} FROM p),
        o AS (SELECT *, coalesce(agreement_lo >= 0.8 AND kappa >= 0.6, false) AS ok, row_number() OVER (ORDER BY kappa DESC NULLS LAST, agreement DESC NULLS LAST, judge) AS rank FROM m)
        SELECT judge, tp, fp, fn, tn, {_SIX}, ok, CAST(rank AS INTEGER) AS rank, rank = coalesce((SELECT min(rank) FROM o WHERE ok), 1) AS best FROM o""",
    "length_sensitivity": f"""WITH {_JUDGED}, k AS (SELECT *, row_number() OVER (PARTITION BY gold ORDER BY chars) AS i, count(*) OVER (PARTITION BY gold) AS n FROM judged), m AS (SELECT gold, min(chars) AS median_length FROM k WHERE i > n // 2 GROUP BY gold),
        s AS (SELECT j.gold, median_length, avg(varied::DOUBLE) FILTER (WHERE chars <= median_length) AS a, avg(varied::DOUBLE) FILTER (WHERE chars > median_length) AS b, count(*) AS n FROM judged j JOIN m ON j.gold = m.gold GROUP BY j.gold, median_length)
        SELECT gold AS gold_reward, CAST(median_length AS INTEGER) AS median_length, round(a, 6) AS short_rate, round(b, 6) AS long_rate, n, round(b - a, 6) AS gap FROM s""",
    "annotator_agreement": f"WITH {_VOTES}, c AS (SELECT x.annotator AS a, y.annotator AS b, {_CONF.replace('j =', 'x.label =').replace('g =', 'y.label =')} FROM votes x JOIN votes y ON x.row_key = y.row_key AND x.annotator < y.annotator GROUP BY x.annotator, y.annotator), p AS (SELECT {_PE} FROM c), m AS (SELECT a, b, n, {_MORE} FROM p) SELECT a, b, n, round(agreement, 6) AS agreement, kappa FROM m",
    "attached_labels": f"""WITH {_VOTES}, s AS (SELECT r_regionkey, (SELECT count(*) FROM documents WHERE source = 'src' || r_regionkey) AS fits FROM region), v AS (SELECT row_key, count(*) FILTER (WHERE label = 1) AS yes, count(*) FILTER (WHERE label = 0) AS no FROM votes GROUP BY row_key)
        SELECT row_key, yes, no, 0::BIGINT AS ambiguous, 0::BIGINT AS unmatched, CASE WHEN yes > no THEN 1 WHEN yes < no THEN 0 END AS gold_reward FROM v
        UNION ALL SELECT NULL, count(*), 0::BIGINT, count(*) FILTER (WHERE fits > 1), count(*) FILTER (WHERE fits = 0), NULL FROM s WHERE fits <> 1""",
    "sft_selection": f"""WITH {ROLLOUTS_SQL}, b AS (SELECT task_id, rollout_index, harness || model AS signature, row_number() OVER (PARTITION BY task_id ORDER BY reward DESC, sha256('sft:' || task_id || '|' || harness || model), rollout_index) AS k FROM rollouts WHERE reward >= 1),
        t AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY sha256('sft:' || task_id), task_id) AS turn, count(*) OVER (PARTITION BY signature) AS bucket_size FROM b WHERE k = 1), p AS (SELECT *, row_number() OVER (ORDER BY turn, bucket_size DESC, signature) AS pick FROM t)
        SELECT task_id, CAST(rollout_index AS INTEGER) AS rollout_index, signature, CAST(turn AS INTEGER) AS turn, bucket_size, CAST(pick AS INTEGER) AS pick FROM p WHERE pick <= 500""",
    "rl_selection": f"""WITH {GRADED_SQL}, s AS (SELECT task_id, count(*) AS n, CAST(sum(reward) AS BIGINT) AS c, min(harness) AS bucket FROM graded GROUP BY task_id), m AS (SELECT *, round(c / n::DOUBLE, 4) AS rate, c / n::DOUBLE BETWEEN 0.2 AND 0.8 AS in_band, sha256('rl:' || task_id) AS tie FROM s WHERE n >= 2 AND c > 0 AND c < n),
        l AS (SELECT *, row_number() OVER (PARTITION BY bucket, in_band, rate ORDER BY tie, task_id) AS lap FROM m), t AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY in_band DESC, lap, rate, tie, task_id) AS turn, count(*) OVER (PARTITION BY bucket) AS size FROM l),
        p AS (SELECT *, row_number() OVER (ORDER BY turn, size DESC, bucket) AS pick FROM t), f AS (SELECT *, coalesce(sum(n) OVER (ORDER BY pick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
        SELECT task_id, n, c, bucket, CAST(pick AS INTEGER) AS pick, CAST(before AS BIGINT) AS before FROM f WHERE before < 1000""",
    "preference_pairs": f"""WITH {ROLLOUTS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY reward DESC, rollout_index) AS k FROM rollouts), m AS (SELECT r.task_id, b.rollout_index AS chosen, r.rollout_index AS rejected, b.reward - r.reward AS margin, b.reply_length AS chosen_length, r.reply_length AS rejected_length,
        row_number() OVER (PARTITION BY r.task_id ORDER BY abs(r.reply_length - b.reply_length), r.reward DESC, r.rollout_index) AS k FROM rollouts r JOIN b ON r.task_id = b.task_id AND b.k = 1 WHERE b.reward - r.reward >= 0.5)
        SELECT task_id, CAST(chosen AS INTEGER) AS chosen, CAST(rejected AS INTEGER) AS rejected, margin, chosen_length, rejected_length FROM m WHERE k = 1""",
    "preference_sets": f"WITH {_SETS} SELECT task_id, CAST(chosen AS INTEGER) AS chosen, CAST(rejected AS INTEGER) AS rejected, margin, chosen_length, rejected_length, pair FROM sets",
    "length_confound": f"WITH {_SETS}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE chosen_length > rejected_length) AS chosen_longer FROM sets) SELECT n, chosen_longer, coalesce((n >= 8 AND chosen_longer / n::DOUBLE >= 0.75) OR (n >= 3 AND n = chosen_longer), false) AS confounded FROM c",
    "spread_order": f"WITH {GRADED_SQL}, s AS (SELECT task_id, round(avg(reward), 4) AS value FROM graded GROUP BY task_id), l AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY task_id) AS lap FROM s) SELECT task_id, value, CAST(lap AS INTEGER) AS lap FROM l",
    "balanced_sampling": f"""WITH {ROLLOUTS_SQL}, w AS (SELECT *, avg(reward) OVER (PARTITION BY task_id) AS pool, sum(reward) OVER (PARTITION BY task_id) AS np, count(*) OVER (PARTITION BY task_id) AS n, row_number() OVER (PARTITION BY task_id, reward ORDER BY rollout_index) AS k FROM rollouts)
        SELECT task_id, CAST(rollout_index AS INTEGER) AS rollout_index, reward, round(pool, 6) AS pool_rate, round(reward - pool, 6) AS advantage FROM w WHERE CASE WHEN reward = 1 THEN k <= least(np, greatest(2, 4 - (n - np))) ELSE k <= least(n - np, 4 - least(np, 2)) END""",
    "shaped_advantages": f"""WITH {ROLLOUTS_SQL}, f AS (SELECT *, count(*) OVER (PARTITION BY task_id) AS n, rank() OVER (PARTITION BY task_id ORDER BY score DESC) - 1 + (count(*) OVER (PARTITION BY task_id, score) - 1) / 2.0::DOUBLE AS k, reward - avg(reward) OVER (PARTITION BY task_id) AS a FROM rollouts),
        g AS (SELECT *, CASE WHEN n > 1 THEN 1 - 0.5 * k / (n - 1) ELSE 1.0 END AS factor FROM f), h AS (SELECT *, sum(CASE WHEN reward >= 0.5 THEN a END) OVER (PARTITION BY task_id) AS t, sum(CASE WHEN reward >= 0.5 THEN a * factor END) OVER (PARTITION BY task_id) AS s FROM g),
        b AS (SELECT *, CASE WHEN reward >= 0.5 AND s <> 0 THEN least(t / s, 3.0::DOUBLE) * factor * a ELSE a END AS b FROM h) SELECT task_id, CAST(rollout_index AS INTEGER) AS rollout_index, round(factor, 6) AS factor, round(b - avg(b) OVER (PARTITION BY task_id) + 1e-10, 6) AS advantage FROM b""",
    "pairwise_coverage": "WITH o AS (SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders), p AS (SELECT * FROM (SELECT DISTINCT o_orderpriority FROM orders), (SELECT DISTINCT o_orderstatus FROM orders)), s AS (SELECT count(*) AS k FROM o WHERE o_orderstatus <> 'P' OR o_orderpriority <> '1-URGENT') SELECT count(*) AS planned, (SELECT k FROM s) AS observed, round((SELECT k FROM s) / count(*)::DOUBLE, 6) AS share FROM p",
}
