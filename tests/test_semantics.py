"""Gates, kinds of calls, markers, steps and deltas on literal rows, with the values that users expect of them."""

import pytest
from gradeloom.functions.text import looks_finished
from gradeloom.operators import delta, flags, gates, groups, hygiene, mining, selecting
from gradeloom.sources import rows as R
from pyspark.sql import functions as F


@pytest.mark.parametrize(("tool", "arguments", "kinds", "want"), [
    ("run_command", '{"command": "ls"}', None, "command"), ("write_file", '{"path": "a.py", "content": "x"}', None, "write"), ("read_file", '{"path": "a.py"}', None, "read"),
    ("delete_file", '{"path": "a.py"}', None, "delete"), ("str_replace_editor", '{"path": "a.py", "new_string": "y"}', None, "write"), ("lookup_order", '{"order_id": "ORD-1"}', None, None),
    ("lookup_order", '{"order_id": "ORD-1"}', {"lookup_order": "read"}, "read"), ("bash", '{"cmd": "pytest"}', None, "command"),
])
def test_kind_of_a_call(spark, tool, arguments, kinds, want):
    assert spark.range(1).select(mining.step_kind(F.lit(tool), F.lit(arguments), kinds)).first()[0] == want


def test_failed_steps_in_every_shape(spark):
    bad = ['{"status": "timeout", "error": "request timed out"}', '{"status": "permission_denied"}', '{"status": "not_found", "missing": ["x"]}', '{"status": "ok", "exit_code": 2}', "Error: no such file", "denied"]
    good = ['{"status": "ok"}', "all 12 tests passed", None, '{"exit_code": 0, "code": 3}', '{"error": ""}', "fatal"]
    df = spark.createDataFrame([(x,) for x in bad + good], "r string")
    assert [r[0] for r in df.select(mining.step_failed(F.col("r"))).collect()] == [True] * len(bad) + [False] * len(good)
    assert spark.range(1).select(mining.step_failed(F.lit(None).cast("string"), failed=F.lit(True))).first()[0]


def test_markers_are_zeroed_by_their_own_flags(spark):
    call = "struct<kind:string,command:string,path:string,content:string,failed:boolean>"
    rows = [([], "Done. All tests pass now."), ([("write", None, "tests/test_a.py", "x", False)], "ok"), ([("command", "git push --no-verify", None, None, True)], "ok"), ([("read", None, ".env", None, False)], "done")]
    df = spark.createDataFrame(rows, f"steps array<{call}>, final_text string")
    m = flags.trace_markers(flags.trace_flags("steps", "final_text"))
    assert list(m) == ["honest_claims", "reported_failure", "no_test_tampering", "no_suppression", "no_bypass", "no_destructive", "no_secrets"]
    got = [{k for k, v in r.asDict().items() if v == 0} for r in df.select(*(c.alias(k) for k, c in m.items())).collect()]
    assert got == [{"honest_claims"}, {"no_test_tampering"}, {"reported_failure", "no_bypass"}, {"no_secrets"}]


MESSAGES = "messages array<struct<role:string,content:string,name:string,tool_call_id:string,tool_calls:array<struct<id:string,name:string,arguments:string>>>>"


def test_results_bind_by_id_then_name_then_in_order(spark):
    chat = [
        ("user", "go", None, None, None), ("assistant", "", None, None, [("1", "a", "{}"), ("2", "b", "{}"), ("", "c", "{}")]), ("tool", "for b", None, "2", None), ("tool", "for c", "c", None, None),
        ("tool", "left", "zz", "9", None), ("tool", "orphan", "a", None, None), ("assistant", "bye", None, None, []),
    ]
    df = spark.createDataFrame([(chat, "x", None)], f"{MESSAGES}, other string, prompt string")
    row = R.load_traces(df).first()
    assert [(s.user or s.text or s.tool, s.result) for s in row.steps] == [("go", None), ("a", "left"), ("b", "for b"), ("c", "for c"), ("a", "orphan"), ("bye", None)]
    assert (row.prompt, row.final_text, row.reward, row.other) == ("go", "bye", None, "x")


def test_replies_that_are_finished(spark):
    ends = {"Shipped": False, "Sure:": True, "ok!  ": True, "x\nCheers": True, "Regards\nThe Team": True, "Best,\nsam": False, "-- Sam": False, "Bye,\n-- Sam": True, "42%": True, "## 42": True, "# 42": False, "a\n\nThanks,\nAlex": True, "```\nx\n```": True, "```": False}
    df = spark.createDataFrame([(t,) for t in ends], "t string")
    assert dict(zip(ends, (r[0] for r in df.select(looks_finished(F.col("t"))).collect()), strict=True)) == ends


def test_truncation_reads_the_stamp_then_the_verdict_then_the_text(spark):
    rows = [("Done.", "length", None, []), ("Done.", "stop", "was CUT  off", []), ("Done.", None, None, [(True,)]), ("w " * 150, None, None, []), ("w " * 150 + ".", None, None, [(None,)]), ("short", None, None, None)]
    df = spark.createDataFrame(rows, "final_text string, finish_reason string, reason string, steps array<struct<truncated:boolean>>")
    assert [r[0] for r in df.select(hygiene.is_truncated(df.columns)).collect()] == [True, True, True, True, False, False]


def test_drop_reasons_in_order(spark):
    step, no = [("t", None, None, False)], []
    say = lambda *roles: [(r, "x") for r in roles]
    rows = [
        ("hi there you", "", 0.0, "gold", step, say("user", "assistant")), ("hi there you", "", 0.0, "gold", no, []), ("please refund it", "Done.", None, None, no, say("user", "assistant")), ("please refund it", "Done.", 1.0, None, no, say("user", "assistant")),
        ("tell me more", "Rain.", 0.5, None, no, say("user", "assistant")), ("tell me more", "Rain.", 1.0, None, no, say("user", "assistant", "user")), ("ok then", "What?", 1.0, None, no, say("user", "assistant")), ("tell me more", "a" * 30, 1.0, None, no, say("user", "assistant")),
        ("tell me more", "returned 503 now", 1.0, None, no, say("user", "assistant")), ("tell me more", "returned 503 now", 1.0, None, step, say("user", "assistant")),
    ]
    df = spark.createDataFrame(rows, "prompt string, final_text string, reward double, label_source string, steps array<struct<tool:string,result:string,text:string,truncated:boolean>>, messages array<struct<role:string,content:string>>")
    junk = "incomplete_junk"
    assert [r[0] for r in df.select(gates.drop_reason(df.columns)).collect()] == [None, junk, "do_nothing", None, "unusable_label", junk, junk, junk, junk, None]
    assert [r[0] for r in df.select(gates.drop_reason(df.columns, text_gates=False)).collect()] == [None, None, "unusable_label", None, "unusable_label", None, None, None, None, None]
    kept, report = gates.filter_rows(df)
    assert kept.columns == df.columns and {r.why: r.n for r in report.collect()} == {"kept_verified_zero": 1, junk: 5, "do_nothing": 1, "unusable_label": 1, "kept": 2}
    assert gates.filter_rows(df.limit(0))[0].count() == 0


def test_pass_rates_at_the_least_k(spark):
    stats = spark.createDataFrame([("a", 4, 2), ("b", 4, 4), ("c", 1, 1), ("d", 1, 0)], "task_id string, n long, c long")
    got = groups.pass_at_default(stats).first()
    assert (got.k, got.n_eligible, got.n_imputed) == (4, 2, 0) and got.pass_at_k == 1.0 and got.pass_pow_k == 0.5 and got.pass_at_1 == 0.625
    assert groups.pass_at_default(stats, unanimous_short=True).first().pass_pow_k == 0.5
    few = groups.pass_at_default(spark.createDataFrame([("a", 2, 1), ("b", 3, 3)], "task_id string, n long, c long")).first()
    assert few.k == 2 and few.pass_at_k is None and few.pass_at_1 == 0.75


def test_several_pairs_use_each_row_once(spark):
    rows = spark.createDataFrame([("t", 0, 1.0, 10), ("t", 1, 1.0, 50), ("t", 2, 0.0, 48), ("t", 3, 0.0, 12), ("t", 4, 0.0, 300), ("u", 0, 1.0, 5), ("u", 1, 0.5, 5), ("v", 0, 7.0, 1), ("v", 1, 0.0, 1)], "task string, i int, score double, length int")
    pairs = lambda **k: sorted((r.task, r.pair, r.chosen, r.rejected) for r in selecting.preference_sets(rows, task="task", score="score", length="length", key="i", order=["i"], **k).collect())
    assert pairs(pairs=3) == [("t", 1, 0, 3), ("t", 2, 1, 2)]
    assert pairs(pairs=1, min_margin=0.5) == [("t", 1, 0, 3), ("u", 1, 0, 1)]
    with pytest.raises(ValueError, match="no preference"):
        pairs(min_margin=0)
    told = spark.createDataFrame([(9, 1)] * 6 + [(1, 9)] * 2, "chosen_length int, rejected_length int")
    assert selecting.length_confound(told).first().confounded and not selecting.length_confound(told.limit(2)).first().confounded


def arms(spark, after, guard=0.0):
    rows = []
    for t in range(40):
        for run in range(3):
            base = 1.0 if (t + run) % 2 else 0.0
            rows += [(t, "before", run, base, 0.5, 10.0), (t, "after", run, min(1.0, base + after if t % 2 else base), 0.5 - guard, 8.0)]
    return spark.createDataFrame(rows, "task_id int, arm string, eval_run int, reward double, guard double, words double")


def test_delta_report_names_gains_losses_and_noise(spark):
    report = lambda df: delta.delta_report(df, ["reward", "guard", "words"], lower_is_better=("words",))
    head = lambda df, **k: delta.delta_headline(report(df), target="reward", **k).first()
    up = {r.metric: r for r in report(arms(spark, 1.0)).collect()}
    assert up["reward"].verdict == "b_better" and up["words"].verdict == "a_better" and up["words"].gain_verdict == "b_better" and up["guard"].verdict == "no_difference"
    assert up["words"].delta == -2 and up["reward"].n_paired == 40 and up["reward"].ci_lo > 0
    assert head(arms(spark, 1.0)).headline in ("PASS", "NO DIFFERENCE") and not head(arms(spark, 1.0)).regressions
    flat = head(arms(spark, 0.0), proxy="words")
    assert flat.target_verdict == "no_change_detected" and flat.over_optimized and flat.headline == "FAIL"
    worse = head(arms(spark, 1.0, guard=0.3), guards=("guard",))
    assert worse.regressions == ["guard"] and not worse.ok and worse.headline == "FAIL"
    apart = arms(spark, 1.0).where("arm = 'before' OR task_id > 30")
    assert head(apart).not_comparable and head(apart).headline == "NOT COMPARABLE"
    assert head(arms(spark, 1.0).where("task_id < 2")).target_verdict == "insufficient_data"
