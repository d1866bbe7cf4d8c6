"""Audits, readers of replies and export shapes on literal rows."""

import pytest
from gradeloom.functions import parsing as P
from gradeloom.operators import audits as A
from gradeloom.operators import blocks, groups, vectors
from pyspark.sql import functions as F


@pytest.mark.parametrize(("text", "want"), [("```json\n[1, 2]\n```", "[1,2]"), ('x {"b": 1, "a": [2]} y', '{"a":[2],"b":1}'), ("{broken", None), (None, None), ("7", "7"), ("null", None)])
def test_json_in_prose(text, want):
    assert P._json_text(text) == want


def test_scores_outside_the_unit_are_not_clamped():
    assert P.read_score('{"score": 2}') == (None, None) and P.read_score('{"score": true}') == (None, None)
    assert P.read_score('```json{"reward": 0.25, "reason": " ok "}```') == (0.25, "ok")
    assert P.read_score('... "score": 0.5} "reason": "so"') == (0.5, "so") and P.read_score('"score": 1.5,') == (None, None) and P.read_score(None) == (None, None)
    assert P.read_result("0.5") == (0.5, "ok") and P.read_result("7", (0, 10)) == (0.7, "ok") and P.read_result("true", (0, 10)) == (None, "invalid_result") and P.read_result('{"x": 1}') == (None, "missing_reward")
    assert [P.read_winner(t) for t in ('{"winner": "TIE"}', 'winner: a', "none", None)] == ["tie", "A", None, None]


def test_schema_subset():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}}
    assert [P.schema_problem(v, schema) for v in ({"a": 1}, {}, {"a": "x"}, [])] == [None, "required a", "property a", "type object"]


def test_readers_as_columns(spark):
    df = spark.createDataFrame([('note {"score": 0}',), (None,)], "t string")
    got = df.select(P.payload_of(F.col("t")).alias("p"), P.rubric_words(F.lit("clear answer clear words words apples")).alias("w"), P.embedded(F.lit("refund order 12"), 16).alias("v")).collect()
    assert (got[0].p.note, got[0].p.record, got[1].p.note) == ("note", '{"score": 0}', "") and got[0].w == ["clear", "words", "apples"]
    assert abs(sum(x * x for x in got[0].v) - 1) < 1e-9 and got[0].v == P.word_vector("REFUND  order 99", 16)
    assert P.judge_version("m", " x ") == P.judge_version("m", "x") != P.judge_version("m", "y")


def test_score_spread_wants_deviation_and_no_cluster(spark):
    rows = spark.createDataFrame([("a", x / 10) for x in range(10)] + [("b", 0.93)] * 19 + [("b", 0.1)] + [("c", 0.5)], "g string, s double")
    got = {r.g: r for r in A.score_spread(rows, "s", by=("g",)).collect()}
    assert got["a"].ok and not got["b"].ok and not got["c"].ok and abs(got["a"].median - 0.45) < 1e-9 and got["b"].within_band == 0.95


def test_publish_gate_refuses_in_order(spark):
    gate = lambda rows, **k: A.publish_gate(spark.createDataFrame(rows, "task_id string, reward double"), **k).first()
    assert gate([("a", None), ("a", 0.5)]).refusal == "ungraded_rl_rows" and gate([("a", 1.0), ("a", 1.0)]).refusal == "no_mixed_groups"
    good = gate([("a", 1.0), ("a", 0.0), ("b", 1.0)])
    assert good.refusal is None and (good.mixed, good.unanimous, good.graded) == (1, 0, 3)
    assert not gate([("a", 1.0), ("b", 0.0)]).rl_shaped and gate([("a", 1.0)], mode="rl").refusal == "no_mixed_groups"
    assert not gate([]).rl_shaped and gate([]).refusal is None


def test_hollow_runs(spark):
    kind = "steps array<struct<tool:string>>"
    told = lambda rows, tools: A.hollow_run(spark.createDataFrame([(r,) for r in rows], kind), "steps", tools).first()
    assert told([[], None], ["x"]).hollow and not told([[], []], []).hollow
    part = told([[("x",)], [], []], ["x", "y"])
    assert part.partly_hollow and part.never_called == ["y"] and not told([[("x",)]] * 30 + [[]], ["x"]).partly_hollow


def test_newest_scores_and_winners(spark):
    evals = spark.createDataFrame([("v1", "b", "2020", 0.5, 0.1), ("v1", "b", "2021", 0.6, 0.1), ("v2", "b", "2021", 0.9, 0.1), ("v2", "b", "2022", None, 0.1), ("v3", "b", "2021", 0.7, 0.1), ("v4", "b", "2021", 0.95, None)], "version string, behavior string, at string, score double, ci double")
    newest = A.newest_scores(evals)
    assert {r.version: r.score for r in newest.collect()} == {"v1": 0.6, "v2": 0.9, "v3": 0.7, "v4": 0.95}
    assert [r.version for r in A.winners(newest, "v1").collect()] == ["v2"]
    assert not A.winners(newest, "v1", floors=spark.createDataFrame([("b", 0.4)], "behavior string, noise_floor double")).collect() and not A.winners(newest, "v9").collect()


def test_variance_parts_and_sizes(spark):
    sure = A.variance_parts(spark.createDataFrame([("a", 4, 4), ("b", 4, 0)], "task_id string, n long, c long")).first()
    assert sure.independence_ratio is None and sure.base == 0.5 and sure.k == 4
    some = A.variance_parts(spark.createDataFrame([("a", 10, 7), ("b", 20, 6)], "task_id string, n long, c long")).first()
    assert abs(some.independence_ratio - 0.25 / (0.25 - 0.04)) < 1e-9
    assert A.recommend(100, mode="sft") == {"budget": 2400, "target": 800} and A.recommend(1000, mode="sft")["budget"] == 5000
    assert A.recommend(10, mixed_rate=0.0)["situations"] == 5000 and A.recommend(500, mixed_rate=1.0)["budget"] == 8000


def test_results_are_equal_in_any_order(spark):
    a = spark.createDataFrame([(1, "x ", 1.001), (2, "$3", None), (2, "$3", None)], "a int, b string, c double")
    b = spark.createDataFrame([("3.0", None, 2), ("X", 1.0, 1), ("3", None, 2)], "b string, c double, a int")
    assert A.same_result(a, b) and not A.same_result(a, b.limit(2)) and not A.same_result(a, b.select("a", "b")) and not A.same_result(a.distinct().union(a.limit(1)), b)
    assert A.same_result(a.limit(0), b.limit(0))


def test_failure_class_and_speech(spark):
    rows = spark.createDataFrame([(0.0, "it halluCinated", "x"), (0.0, None, " "), (1.0, "invented", "x"), (0.0, "odd", "x"), (None, "invented", "x")], "r double, why string, final string")
    assert [x[0] for x in rows.select(A.failure_class(F.col("r"), F.col("why"), F.col("final"))).collect()] == ["fabrication", "junk_output", None, None, None]
    said = spark.createDataFrame([("End", [("user", "q"), ("assistant", "Hi"), ("assistant", "End"), ("assistant", None)]), (None, None)], "final_text string, messages array<struct<role:string,content:string>>")
    assert [x[0] for x in said.select(A.said(said)).collect()] == ["End\nHi", ""]


def test_blocks_in_several_passes_agree(spark):
    rows = spark.createDataFrame([(k, [float(k % 7 - 3), float(k % 5 - 2), 1.0]) for k in range(60)] + [(100, None), (101, [0.0, 0.0, 0.0])], "id long, v array<double>")
    near = lambda **o: sorted((r.id, round(r.novelty, 9)) for r in vectors.novelty(rows.where("id >= 10"), rows.where("id < 10"), key="id", vector="v", **o).collect())
    assert near() == near(max_block=100) and dict(near())[101] == 1.0
    assert vectors.near_pairs(rows.limit(0), key="id", vector="v").count() == 0 and blocks.MAX_BLOCK > 0


def test_gated_rows_of_mixed_tasks(spark):
    schema = "task_id string, prompt string, final_text string, reward double, label_source string"
    rows = spark.createDataFrame([("a", "tell me more", "Yes.", 1.0, None), ("a", "tell me more", "No.", 0.0, None), ("b", "tell me more", "Yes.", 1.0, None), ("b", "tell me more", "Yes.", 1.0, None), ("c", "tell me more", "", 1.0, None)], schema)
    assert {r.task_id for r in A.rl_ready(rows).collect()} == {"a"} and {r.task_id for r in A.rl_ready(rows, trim_unanimous=False).collect()} == {"a", "b"}
    assert groups.MIN_K == 4
