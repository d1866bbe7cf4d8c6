"""Operators on literal rows, against closed forms and by hand."""

import math
from itertools import combinations

import pytest
from gradeloom.functions import keys, stats, text
from gradeloom.operators import agreement, compare, decontam, groups, hygiene, scanning, selecting, trajectories, vectors, verifying
from pyspark.sql import functions as F


def value(spark, column, **row):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in row.items()))
    return df.select(column.alias("x")).first().x


def graded(spark, tasks):
    rows = [(t, float(r), i) for t, labels in tasks.items() for i, r in enumerate(labels)]
    return spark.createDataFrame(rows, "task_id string, reward double, i int")


@pytest.mark.parametrize(("n", "c", "k"), [(6, 2, 4), (4, 4, 4), (5, 0, 2), (7, 3, 3)])
def test_pass_at_k_is_the_binomial_ratio(spark, n, c, k):
    both = value(spark, F.struct(stats.all_of_k(F.col("n"), F.col("c"), k).alias("p"), stats.any_of_k(F.col("n"), F.col("c"), k).alias("a")), n=n, c=c)
    assert both.p == pytest.approx(math.comb(c, k) / math.comb(n, k)) and both.a == pytest.approx(1 - math.comb(n - c, k) / math.comb(n, k))


def test_pass_at_is_macro_and_needs_k(spark):
    rows = graded(spark, {"a": [1, 1, 1, 1], "b": [0] * 8, "c": [1], "d": [0.5, 1, 0]})
    got = groups.pass_at(groups.task_stats(rows), 4).first()
    assert (got.n_tasks, got.n_rows, got.n_eligible) == (4, 15, 2)
    assert got.pass_at_1 == pytest.approx((1 + 0 + 1 + 0.5) / 4) and got.pass_pow_k == 0.5


def test_trims_keep_singles_and_unanimous(spark):
    rows = graded(spark, {"one": [1], "all": [1, 1], "none": [0, 0], "mixed": [1, 0], "hard": [1] + [0] * 9})
    left = lambda df: {r.task_id for r in df.select("task_id").distinct().collect()}
    assert left(groups.trim_unanimous(rows)) == {"one", "mixed", "hard"}
    assert left(groups.trim_out_of_band(rows)) == {"one", "all", "none", "mixed"}
    assert left(groups.retire_solved(rows)) == {"one", "none", "mixed", "hard"}


def test_curriculum_tiers_by_rank(spark):
    found = groups.task_stats(graded(spark, {f"t{k}": [1] * k + [0] * (10 - k) for k in range(11)} | {"thin": [1]}))
    got = {r.task_id: (r.state, r.tier) for r in groups.curriculum(found).collect()}
    assert got["thin"] == ("thin", None) and got["t10"] == ("retired", None) and got["t1"] == ("not_ready", None)
    assert [got[f"t{k}"][1] for k in (8, 7, 6, 5, 4, 3, 2)] == [0, 0, 0, 1, 1, 2, 2]


def test_wilson_and_kappa(spark):
    lo, hi = stats.wilson(F.col("c"), F.col("n"))
    got = value(spark, F.struct(lo.alias("lo"), hi.alias("hi")), c=8, n=10)
    assert got.lo == pytest.approx(0.4902, abs=1e-3) and got.hi == pytest.approx(0.9433, abs=1e-3)
    assert value(spark, stats.wilson(F.col("c"), F.col("n"))[0], c=0, n=0) is None
    k = lambda **x: value(spark, stats.kappa(*(F.col(c) for c in ("tp", "fp", "fn", "tn"))), **x)
    assert k(tp=20, fp=5, fn=10, tn=15) == 0.4 and k(tp=9, fp=0, fn=0, tn=0) == 1.0


def test_quantiles_and_sizes():
    assert stats.t_quantile(10) == pytest.approx(2.2281, abs=1e-3) and stats.t_quantile(2) == pytest.approx(4.3027, abs=1e-3)
    assert stats.two_proportion_p(10, 100, 25, 100) == pytest.approx(0.0053, abs=3e-4) and stats.two_proportion_p(0, 5, 0, 5) is None
    n = stats.holdout_size(0.1)
    assert abs(stats.detectable_effect(n) - 0.1) < 0.005
    assert stats.noise_band(0.1, 3, 3) == pytest.approx(1.96 * 0.1 * math.sqrt(2 / 3), abs=1e-3)


def test_paired_comparison(spark):
    rows = spark.createDataFrame([("a", "before", 0.0), ("a", "after", 1.0), ("a", "after", 0.0), ("b", "before", 1.0), ("c", "after", 1.0), ("d", "before", 1.0), ("d", "after", 1.0)], "task_id string, arm string, reward double")
    pairs = compare.paired(rows)
    got = compare.compare_runs(pairs).first()
    assert (got.n_shared, got.only_before, got.only_after) == (2, 1, 1) and got.delta == 0.25 and got.paired_share == 0.5
    flips = compare.sign_flips(pairs, "task_id", 50, 1).first()
    assert flips.delta == 0.25 and 0 < flips.p <= 1
    means = compare.resampled_means(pairs.select("task_id", (F.col("mean_after") - F.col("mean_before")).alias("d")), "d", "task_id", 50, 1)
    assert means.count() == 50


def test_balance_cuts_to_the_smaller_side(spark):
    rows = spark.createDataFrame([("a", "before", k) for k in range(5)] + [("a", "after", 9)] + [("b", "after", k) for k in range(3)], "task_id string, arm string, row_key int")
    got = {(r.task_id, r.arm): r["count"] for r in compare.balance(rows).groupBy("task_id", "arm").count().collect()}
    assert got == {("a", "before"): 1, ("a", "after"): 1, ("b", "after"): 3}


def test_near_duplicates_against_all_pairs(spark):
    texts = {1: "a b c d e", 2: "a b c d e f", 3: "a b x y", 4: "", 5: "E D C B A", 6: "q r s t u v w x y z", 7: "q r s t u v w x y"}
    sets = {k: set(v.lower().split()) for k, v in texts.items()}
    want = {(a, b) for a, b in combinations(texts, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    # 5 has the words of 1, which stands for both: 5 is paired with 1 only, and links of 1 are links of 5
    want = {(a, b) for a, b in want if 5 not in (a, b)} | {(1, 5)}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    assert {(r.a, r.b) for r in hygiene.near_duplicate_pairs(df, key="id", text="text").collect()} == want


def test_first_copy_is_kept_and_conflicts_counted(spark):
    df = spark.createDataFrame([(1, "p", "Hi  there", 1), (2, "p", "hi there", 0), (3, "q", "hi there", 1)], "id int, prompt string, text string, reward int")
    got = hygiene.dedupe_first(df, [F.col("prompt"), text.normalised(F.col("text"))], ["id"], "reward")
    assert {(r.id, r.copy, r.label_conflict) for r in got.collect()} == {(1, 1, False), (2, 2, True), (3, 1, False)}


def test_correlations_without_variance_are_null(spark):
    df = spark.createDataFrame([(float(k), float(2 * k), 1.0) for k in range(5)], "reward double, x double, c double")
    got = {r.feature: (r.r, r.flagged) for r in hygiene.correlations(df, "reward", ["x", "c"]).collect()}
    assert got["x"] == (pytest.approx(1.0), True) and got["c"] == (None, False)


def test_ngram_coverage_takes_the_best_text_and_smallest_key(spark):
    evals = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, "one two three four five six seven eight nine")], "item_id int, text string")
    train = spark.createDataFrame([(10, "One two three four five six seven eight nine"), (11, "x " * 30 + "one two three four five six seven eight"), (12, "short text")], "doc int, text string")
    got = decontam.ngram_coverage(train, evals, key="doc", text="text", eval_key="item_id", eval_text="text").collect()
    assert [tuple(r) for r in got] == [(10, 1, 1.0)]


def test_best_cosine_in_blocks(spark):
    a = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0])], "k int, v array<double>")
    b = spark.createDataFrame([(7, [1.0, 1.0]), (8, [0.0, 1.0]), (9, [2.0, 2.0])], "s int, w array<double>")
    got = lambda n: sorted(tuple(r) for r in decontam.best_cosine(a, b, key="k", vector="v", source_key="s", source_vector="w", max_block=n).select("k", "s", F.round("cosine", 6)).collect())
    assert got(100) == got(1) == [(1, 7, round(math.sqrt(0.5), 6)), (2, 8, 1.0), (3, 7, 0.0)]


def test_labels_attach_by_any_key_and_ambiguous_ones_do_not(spark):
    rows = spark.createDataFrame([("r1", "s"), ("r2", "s")], "row_key string, scenario string")
    labels = spark.createDataFrame([("r1", 1), ("r1", 1), ("r1", 0), ("r2", 1), ("r2", 0), ("s", 1), ("nope", 1)], "name string, label int")
    got = {r.row_key: (r.gold_reward, r.ambiguous, r.unmatched) for r in agreement.attach_labels(rows, labels, [F.col("row_key"), F.col("scenario")]).collect()}
    assert got == {"r1": (1, 0, 0), "r2": (None, 0, 0), None: (None, 1, 1)}


def test_preference_pair_is_closest_in_length(spark):
    rows = spark.createDataFrame([("t", 0, 1.0, 100), ("t", 1, 0.0, 10), ("t", 2, 0.0, 95), ("t", 3, 0.8, 100), ("u", 0, 1.0, 5)], "task string, i int, score double, length int")
    got = selecting.preference_pairs(rows, task="task", score="score", length="length", key="i", order=["i"]).collect()
    assert [(r.task, r.chosen, r.rejected, r.margin) for r in got] == [("t", 0, 2, 1.0)]


def test_round_robin_and_whole_groups(spark):
    rows = spark.createDataFrame([("a", k) for k in range(6)] + [("b", k) for k in range(2)], "bucket string, k int")
    got = [(r.bucket, r.k) for r in selecting.round_robin(rows, "bucket", ["k"], 5).orderBy("pick").collect()]
    assert got == [("a", 0), ("b", 0), ("a", 1), ("b", 1), ("a", 2)]
    found = spark.createDataFrame([(f"t{k}", "x", 4, 2) for k in range(5)], "task string, bucket string, n long, c long")
    assert selecting.whole_groups(found, task="task", bucket="bucket", target=10).agg(F.sum("n")).first()[0] == 12


def test_redistribution_keeps_a_zero_mean(spark):
    rows = spark.createDataFrame([("g", 1.0, 1.0), ("g", 1.0, 0.5), ("g", 0.0, 1.0), ("h", 1.0, 1.0), ("h", 1.0, 0.5)], "g string, reward double, factor double")
    got = selecting.redistribute(rows, group="g", reward="reward", factor="factor").collect()
    assert sum(r.advantage for r in got if r.g == "g") == pytest.approx(0) and all(r.advantage == 0 for r in got if r.g == "h")


def test_within_rho_ignores_task_levels(spark):
    rows = spark.createDataFrame([("a", 1.0, 5.0), ("a", 0.0, 4.0), ("b", 1.0, 1.0), ("b", 0.0, 0.5)] * 10, "task string, reward double, f double")
    got = scanning.within_rho(rows, ["f"], task="task", reward="reward").first()
    assert 0.9 < got.rho <= 1.0 and got.n_nonzero == 40
    assert scanning.permutation_floor(rows.withColumn("key", F.monotonically_increasing_id()), ["f"], task="task", reward="reward", key="key", draws=10).first().floor > 0


def test_loss_masks_and_unrolling(spark):
    turns = spark.createDataFrame([(1, k, r, r[0] + str(k)) for k, r in enumerate(["system", "user", "assistant", "user", "assistant"])] + [(2, 0, "user", "x")], "c int, t int, role string, text string")
    chats = trajectories.as_messages(turns, conv="c", turn="t", role="role", text="text")
    masks = {r.c: (r.a, r.f) for r in chats.select("c", trajectories.loss_mask().alias("a"), trajectories.loss_mask(mode="final").alias("f")).collect()}
    assert masks == {1: ([0, 0, 1, 0, 1], [0, 0, 0, 0, 1]), 2: ([0], [0])}
    assert sorted((r.sample, len(r.messages)) for r in trajectories.unroll(chats).collect()) == [(1, 3), (2, 5)]


def test_policy_updates_by_hand(spark):
    batch = spark.createDataFrame([(1.0, [-0.5, -0.5], [-0.5, -0.5], [0.2, 0.4]), (0.0, [-0.1, -3.0], [-2.0, -0.1], [0.5, 0.5])], "reward double, logprobs array<double>, behavior_logprobs array<double>, values array<double>")
    flash = trajectories.flash_reinforce(batch).orderBy(F.desc("reward")).collect()
    assert flash[0].admitted and not flash[1].admitted and flash[0].coefficients == [pytest.approx(0.5 / 4)] * 2 and flash[1].coefficients == [0.0, 0.0]
    sao = trajectories.single_rollout(batch).orderBy(F.desc("reward")).first()
    lam = 1 - 1 / (1.5 * 2)
    assert sao.advantages == [pytest.approx(0.2 + lam * 0.6), pytest.approx(0.6)]
    assert trajectories.bounded_critic(batch).orderBy(F.desc("reward")).first().coefficients[1] == pytest.approx(0.6)


def test_verifiers(spark):
    c = lambda x: F.lit(x)
    got = lambda col: value(spark, col, z=1)
    assert got(verifying.exact_match(c("blah\nParis."), c(" paris"))) == 1.0
    assert got(verifying.numeric(c("about 1,234.50 or 12%"), c("0.12"))) == 1.0 and got(verifying.numeric(c("none"), c("3"))) == 0.0
    assert got(verifying.choice(c("I pick (C), no: B"), c("b"))) == 1.0
    assert got(verifying.json_field(c('{"a": {"b": "Yes"}}'), "$.a.b", c("yes"))) == 1.0 and got(verifying.json_valid(c("{"))) == 0.0
    assert got(verifying.weighted({"x": (c(1.0), 3.0), "y": (c(0.0), 1.0)})) == 0.75
    score = verifying.user_verifier(lambda a, b: (1.0 / int(a), "ok"))
    rows = spark.createDataFrame([("2", ""), ("0", "")], "a string, b string").select(score("a", "b").alias("v")).collect()
    assert rows[0].v.reward == 0.5 and rows[1].v.reward is None and "ZeroDivisionError" in rows[1].v.reason


def test_keys(spark):
    df = spark.createDataFrame([("", "t", "p"), (None, "", "p"), (None, None, None)], "scenario_id string, task_id string, prompt string")
    assert [r[0] for r in df.select(keys.task_key(df.columns)).collect()] == ["t", "p", ""]
    assert 0 <= value(spark, keys.keyed_unit(1, 2, F.col("k"), "s"), k="x") < 1


def test_reasoning_and_endings(spark):
    said, blocks, tail = text.split_reasoning(F.col("t"))
    got = value(spark, F.struct(said.alias("s"), F.size(blocks).alias("b"), tail.alias("t")), t="a <think>x</think>b <think>open")
    assert (got.s, got.b, got.t) == ("a b", 1, "open")
    ends = {"Done.": True, "It stops": False, "Best,\nAlex": True, "```sql\nx\n```": True, "```x": False, "#### 42": True, "": False}
    assert {t: value(spark, text.looks_finished(F.col("t")), t=t) for t in ends} == ends


def test_near_vectors_against_all_pairs(spark):
    import random

    draw = random.Random(3)
    v = [(k, [draw.gauss(0, 1) for _ in range(6)]) for k in range(80)]
    v += [(100 + k, [x + draw.gauss(0, 0.05) for x in v[k][1]]) for k in range(40)]
    norm = lambda x: math.sqrt(sum(y * y for y in x))
    want = {(a, b) for (a, x), (b, y) in combinations(v, 2) if sum(p * q for p, q in zip(x, y)) / norm(x) / norm(y) >= 0.95}
    df = spark.createDataFrame(v, "id int, v array<double>")
    assert {(r.a, r.b) for r in vectors.near_pairs(df, key="id", vector="v", threshold=0.95).collect()} == want
    assert {(r.a, r.b) for r in vectors.near_pairs(df, key="id", vector="v", threshold=0.95, max_block=1000).collect()} == want
