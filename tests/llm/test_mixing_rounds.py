"""The fit as DataFrames ends where the fit at the driver does."""

import numpy as np
from gradeloom.llm import mixing


def test_a_fit_of_more_than_twenty_rounds_is_the_same_both_ways(spark):
    cells = [(s, g, 0) for s in ("a", "b", None) for g in ("de", "en")]
    tokens = np.array([2727.0, 45, 4532, 1476, 20, 6905])
    want = [{"a": 0.73, "b": 0.06, None: 0.21}, {"de": 0.86, "en": 0.14}, {0: 1.0}]
    fit = mixing.rake(cells, tokens, want, 0.01)
    assert np.abs(mixing.rake(cells, tokens, want, 0.01, rounds=20) - fit).max() > 1e-3
    df = spark.createDataFrame([(*c, int(n)) for c, n in zip(cells, tokens, strict=True)], "source string, lang string, topic int, tokens long")
    got = {tuple(r)[:3]: r.probability for r in mixing._raked_large(df, dict(zip(mixing.MARGINS, want, strict=True)), 1.0, 0.01).collect()}
    assert np.abs(np.array([got[c] for c in cells]) - fit).max() < 1e-8
