"""Reports, task building and splits on literal rows."""

from gradeloom.operators import reports
from pyspark.sql import functions as F


def test_settings_are_constant_or_mixed(spark):
    df = spark.createDataFrame([(0.7, "m"), (0.7, "n")], "temperature double, model string")
    assert {r.setting: (r.value, r.mixed) for r in reports.run_config(df, ["temperature", "model"]).collect()} == {"temperature": ("0.7", False), "model": (None, True)}


def test_equal_behaviour_shares_a_signature(spark):
    schema = "prompt string, steps array<struct<tool:string,arguments:map<string,string>,result:string>>, final_text string"
    found = lambda x, y="id1", final="done", status="ok", prompt="about x": (prompt, [("f", {"q": x}, f'{{"id": "id1", "status": "{status}"}}'), ("g", {"k": y, "a": " "}, None)], final)
    rows = [found("x"), found("y", prompt="about y", final="fine"), found("z"), found("x", final="I can't do that."), found("x", y="id9"), found("x", status="not_found"), found("x", final="w " * 30)]
    a, b, *others = (r[0] for r in spark.createDataFrame(rows, schema).select(reports.signature("steps", "final_text")).collect())
    assert a == b and len({a, *others}) == 6 and len(a) == 12
    import hashlib

    payload = ((("f", (("q", "user"),), "ok"), ("g", (("a", "absent"), ("k", "derived")), "")), False, 0)
    assert a == hashlib.sha256(repr(payload).encode()).hexdigest()[:12]


def test_pseudo_production_takes_whole_tasks_and_all_flaws(spark):
    rows = spark.createDataFrame([(f"t{k}", k, "flaw" if k == 7 else None) for k in range(50) for _ in range(2)], "task string, at int, flaw string")
    got = reports.split_pseudo_production(rows, task="task", flaw=F.col("flaw"), order="at", fraction=0.2).collect()
    chosen = {r.task for r in got if r.chosen}
    assert "t7" in chosen and sum(r.n for r in got if r.chosen) == 20


def test_scan_diff_counts_missing_features_as_zero(spark):
    a = spark.createDataFrame([("x", 0.5), ("y", -0.3)], "feature string, rho double")
    b = spark.createDataFrame([("x", 0.1), ("z", -0.4)], "feature string, rho double")
    assert {r.feature: r.change for r in reports.scan_diff(a, b, 0.2).collect()} == {"x": "lost", "y": "lost", "z": "gained"}
