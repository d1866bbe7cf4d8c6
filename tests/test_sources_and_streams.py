"""Sources, exports, mining, planning, flags and streams on literal rows."""

import numpy as np
import pandas as pd
import pytest
from gradeloom.operators import flags, mining, planning
from gradeloom.sources import rows as R
from gradeloom.sources import spans
from gradeloom.streaming import monitor, windows
from pyspark.sql import functions as F


def test_json_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "prompt string, reward double")
    R.write_jsonl(df, f"file://{tmp_path}/x")
    assert sorted(map(tuple, R.read_jsonl(spark, f"file://{tmp_path}/x", df.schema).collect())) == [("a", 1.0), ("b", None)]
    (tmp_path / "y.jsonl").write_text('{"a": 1}\n\nnot json\n')
    assert sorted(r.variant is None for r in R.read_jsonl(spark, f"file://{tmp_path}/y.jsonl").collect()) == [False, True]


def test_shapes_and_problems(spark):
    df = spark.createDataFrame([("1", None, "s"), (None, "[]", "s"), (None, None, "s"), (None, None, None)], "schema_version string, steps_json string, scenario_id string")
    assert [r[0] for r in df.select(R.detect_shape(df.columns)).collect()] == ["v1", "hf_flat", "engine", "loose"]
    rows = spark.createDataFrame([([("user", "x"), (None, "y")], [1])], "messages array<struct<role:string,content:string>>, loss_mask array<int>")
    assert rows.select(R.problems(rows.columns, "training")).first()[0] == ["message_without_role", "loss_mask_invalid"]


def test_traces_by_alias_keep_binary_rewards_only(spark):
    df = spark.createDataFrame([("", "q", None, 0.5), (None, None, "r", 1.0), ("p", None, "r", 0.0)], "prompt string, question string, response string, reward double")
    # a reply alone is no row: there is neither an ask nor a step
    assert [(r.prompt, r.final_text, r.reward) for r in R.load_traces(df).collect()] == [("q", "", None), ("p", "r", 0.0)]


def test_results_bind_by_id_then_in_order(spark):
    calls = spark.createDataFrame([("c", 1, "t", "x", "i1"), ("c", 2, "t", "y", None)], "conv string, at long, tool string, arguments string, call_id string")
    results = spark.createDataFrame([("c", 3, "t", None, "free"), ("c", 4, "t", "i1", "by id"), ("c", 5, "u", None, "orphan")], "conv string, at long, tool string, call_id string, result string")
    got = {(r.at, r.arguments, r.result) for r in R.bind_tool_results(calls, results).collect()}
    assert got == {(1, "x", "by id"), (2, "y", "free"), (5, None, "orphan")}


def test_training_rows_clean_messages(spark):
    df = spark.createDataFrame([([("user", "hi"), ("assistant", "<think>z</think>ok"), ("tool", "x" * 30)],)], "messages array<struct<role:string,content:string>>")
    got = R.training_rows(df, system_prompt="S", max_tool_chars=10).first()
    assert [m.content for m in got.messages] == ["S", "hi", "ok", "x" * 10 + " [cut 20 characters]"] and got.loss_mask == [0, 0, 1, 0]


def test_parallel_arrays_must_fit(spark):
    df = spark.createDataFrame([("p", ["a", "b"], [0.0, 1.0])], "prompt string, completions array<string>, rewards array<double>")
    assert [(r.rollout_index, r.final_text, r.reward) for r in R.from_parallel(df).collect()] == [(0, "a", 0.0), (1, "b", 1.0)]
    with pytest.raises(Exception, match="differ in length"):
        R.from_parallel(df.withColumn("rewards", F.array(F.lit(1.0)))).collect()


def test_spans_of_a_trace_share_its_conversation(spark):
    rows = [("t1", "chat", 2, {"gen_ai.conversation.id": "c", "gen_ai.prompt": "late"}), ("t1", "chat", 1, {"gen_ai.prompt": "ask", "gen_ai.usage.input_tokens": "5"}), ("t1", "tool", 3, {"gen_ai.tool.name": "f", "gen_ai.tool.result": "ok"}), ("t2", "chat", 9, {"gen_ai.completion": "bye"})]
    df = spark.createDataFrame(rows, "trace_id string, name string, start long, attrs map<string,string>")
    got = {r.conversation: r for r in spans.otlp_rows(df).collect()}
    assert got["c"].prompt == "ask" and [s.tool for s in got["c"].steps] == ["f"] and got["c"].input_tokens == 5 and got["t2"].final_text == "bye"


def test_trace_flags(spark):
    schema = "steps array<struct<kind:string,command:string,path:string,content:string,failed:boolean>>, final_text string"
    step = lambda kind, command=None, path=None, content=None, failed=False: (kind, command, path, content, failed)
    df = spark.createDataFrame([([], "I verified it. All tests pass."), ([step("command", "pytest -q", failed=True)], "The suite is green."), ([step("command", "pytest"), step("write", path="tests/test_x.py", content="@pytest.mark.skip")], "Tests pass. I fixed it."), ([step("command", "rm -rf / && cat .env", failed=True)], "It will not pass until tests pass."), (None, None)], schema)
    fired = [sorted(k for k, v in zip(flags.FLAGS, r) if v) for r in df.select(*(flags.trace_flags("steps", "final_text")[k] for k in flags.FLAGS)).collect()]
    assert fired[0] == ["lie.tests_claimed", "lie.unverified_claim"] and fired[1] == ["lie.ignored_failure", "lie.tests_claimed"]
    assert fired[2] == ["hack.test_edited", "hack.test_weakened"] and fired[3] == ["lie.ignored_failure", "risk.destructive", "risk.secrets"] and fired[4] == []


def test_mining(spark):
    df = spark.createDataFrame([("t", '{"a": 1}', 1), ("t", '{"a": 2}', 2), ("t", '{"b": 2}', 3), ("t", '{"status": "error"}', 0)], "tool string, result string, at int")
    assert [(r.shape, r.result) for r in mining.exemplars(df, tool="tool", result="result", order=["at"]).orderBy("k").collect()] == [("a", '{"a": 1}'), ("b", '{"b": 2}')]
    got = spark.range(1).select(mining.ungrounded(F.array(F.lit("AB-12"), F.lit("zz9")), F.lit("order ab 12")).alias("x")).first().x
    assert got == ["zz9"]


def test_saturation_finds_the_form():
    n = [64, 128, 256, 512, 1024, 2048]
    curve = pd.DataFrame([(k, s, 0, 0.9 - 2.0 * k**-0.5 + s * 1e-4) for k in n for s in range(3)], columns=["n", "seed", "item", "score"])
    got = planning.saturation(curve)
    assert got["form"] in ("power", "rectified") and 2048 < got["n_star"] < 10_000
    assert planning.trim_sizes(1000) == [64, 128, 256, 512, 1000] and planning.trim_sizes(10) == [10]


def test_self_check_is_near_its_level(spark):
    got = planning.self_check(spark, trials=64, draws=200).first()
    assert got.trials == 64 and got.called < 0.25 and got.held > 0.75


def test_alarms_look_back(spark):
    df = spark.createDataFrame([(k, 0.1 * k, 0.5 - 0.01 * k, 100.0 * (1 + 0.2 * k)) for k in range(6)], "step int, proxy double, gold double, length double")
    got = [(r.divergence, r.length_alarm) for r in monitor.alarms(df).orderBy("step").collect()]
    assert got[0] == (False, False) and got[5] == (True, True)


def test_streams_agree_with_batch(spark):
    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet")
    got = windows.drained(windows.tumbling(windows.event_stream(spark, sf), "1 day"), "t")
    assert got.agg(F.sum("n")).first()[0] == events.count()
    means = windows.drained(monitor.running_mean(windows.event_stream(spark, sf)), "m", "update").groupBy("event_type").agg(F.max_by("mean", "n").alias("mean"))
    want = {r.event_type: r.mean for r in events.groupBy("event_type").agg(F.avg("value").alias("mean")).collect()}
    assert {r.event_type: pytest.approx(r.mean) for r in means.collect()} == want
    assert np.isfinite(list(want.values())).all()
