"""Variants of texts, covering arrays, greedy orders."""

from itertools import combinations

import pytest
from gradeloom.operators import generating
from pyspark.sql import functions as F


def test_mutations(spark):
    df = spark.createDataFrame([("one two three four",), ("",), ("x",)], "text string")
    got = [{m.kind: m.text for m in r[0]} for r in df.select(generating.mutations("text")).collect()]
    assert got[0] == {"halved": "one two", "shorter": "one two four", "swapped": "two one three four", "typo": "oen two three four", "marked": "one two three four!!"}
    assert got[2] == {"marked": "x!!"}
    assert spark.range(1).select(generating.crossover(F.lit("a b c d"), F.lit("w x y z")).alias("x")).first().x == "a b y z"


@pytest.mark.parametrize("strength", [2, 3])
def test_covering_rows_show_every_combination(strength):
    axes = {"a": ["1", "2", "3"], "b": ["x", "y"], "c": ["p", "q"], "d": ["u", "v"]}
    rows = generating.covering_rows(axes, strength)
    for group in combinations(sorted(axes), strength):
        assert {tuple(r[g] for g in group) for r in rows} == set(generating._product([axes[g] for g in group]))
    assert len(rows) < 24 and rows == generating.covering_rows(axes, strength)


def test_greedy_order_prefers_new_features(spark):
    df = spark.createDataFrame([(1, ["a", "b"], 1), (2, ["a"], 1), (3, ["c", "d", "e"], 1), (4, ["a", "b", "f"], 2)], "k int, f array<string>, c int")
    assert [r.k for r in generating.greedy_order(df, key="k", features="f", cost="c").orderBy("place").collect()] == [3, 1, 4, 2]
