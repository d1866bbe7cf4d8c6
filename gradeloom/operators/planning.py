"""Small numerics on task-level results: learning curves, self-checks of the comparison, set power."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.stats import holdout_size

EXPONENTS = np.linspace(0.05, 3.0, 60)
HALF_SIZES = np.logspace(0, 6, 31)


def trim_sizes(n_rows: int, first: int = 64, growth: float = 2.0) -> list[int]:
    """Nested sizes that grow by ``growth`` up to ``n_rows``."""
    count = max(0, math.ceil(math.log(max(1.0, n_rows / min(first, n_rows)), growth) - 1e-12))
    return sorted({min(n_rows, round(min(first, n_rows) * growth**k)) for k in range(count)} | {n_rows})


def _line(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted least squares of y on each row of x: (intercepts, slopes, squared errors)."""
    w = w / w.sum()
    mx, my = x @ w, y @ w
    dx, dy = x - mx[:, None], y - my
    slope = np.divide((dx * dy) @ w, (dx * dx) @ w, out=np.zeros(len(x)), where=(dx * dx) @ w > 0)
    return my - slope * mx, slope, ((dy - slope[:, None] * dx) ** 2) @ w


def fit_curve(form: str, n: np.ndarray, y: np.ndarray, w: np.ndarray):
    """The best curve of a form as a function of n, or None: power a - b n^-c, rectified a + b n^c / (d + n^c), logit."""
    if form == "logit":
        q = np.clip(y, 1e-3, 1 - 1e-3)
        (a,), (b,), _ = _line(np.log(n)[None], np.log(q / (1 - q)), w * (q * (1 - q)) ** 2)
        return (lambda m: 1 / (1 + np.exp(-(a + b * np.log(m))))) if b > 0 else None
    if form == "power":
        c, d = EXPONENTS, np.ones(len(EXPONENTS))
        basis = lambda m: -(np.asarray(m, float)[None] ** -c[:, None])
    else:
        c, d = (g.ravel() for g in np.meshgrid(EXPONENTS, HALF_SIZES))
        basis = lambda m: (p := np.asarray(m, float)[None] ** c[:, None]) / (d[:, None] + p)
    a, b, off = _line(basis(n), y, w)
    fine = (b > 0) & (a + (b if form == "rectified" else 0) <= 1)
    if not fine.any():
        return None
    k = int(np.argmin(np.where(fine, off, np.inf)))
    return lambda m: a[k] + b[k] * basis(np.atleast_1d(m))[k]


def saturation(curve: pd.DataFrame, min_gain: float = 0.01) -> dict:
    """Form, N* (smallest size past which a doubling gains under ``min_gain``) and the score there, of a curve (n, seed, item, score).

    The form is the one that, fitted without the largest size, misses its score least.
    """
    seeds = curve.groupby(["n", "seed"])["score"].mean().groupby("n").agg(["mean", "var", "count"])
    n, y = seeds.index.to_numpy(float), seeds["mean"].to_numpy()
    var = (seeds["var"] / seeds["count"]).fillna(1e-4).clip(lower=1e-6).to_numpy()
    best = None
    for form in ("rectified", "power", "logit"):
        if len(n) >= 4 and (f := fit_curve(form, n[:-1], y[:-1], 1 / var[:-1])) is not None:
            miss = float(abs(np.atleast_1d(f(n[-1:]))[0] - y[-1]))
            if (whole := fit_curve(form, n, y, 1 / var)) is not None and (best is None or miss < best[0] - 1e-12):
                best = (miss, form, whole)
    if best is None:
        return {"form": None, "n_star": None, "score": None, "miss": None}
    grid = np.logspace(np.log10(n.min()), 9, 400)
    gain = np.array([np.atleast_1d(best[2](2 * m))[0] - np.atleast_1d(best[2](m))[0] for m in grid])
    past = np.flatnonzero(gain > min_gain)
    star = n.min() if not len(past) else math.inf if past[-1] == len(grid) - 1 else math.ceil(grid[past[-1] + 1])
    return {"form": best[1], "n_star": float(star), "score": float(np.atleast_1d(best[2](min(star, 1e9)))[0]), "miss": best[0]}


def fit_saturation(curves: DataFrame, by: str, min_gain: float = 0.01) -> DataFrame:
    """``saturation`` of each curve; a curve is sizes x seeds x items of one experiment."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{by: rows[by].iloc[0], **saturation(rows, min_gain)}])

    return curves.groupBy(by).applyInPandas(one, f"{by} {curves.schema[by].dataType.simpleString()}, form string, n_star double, score double, miss double")


def self_check(spark, *, trials: int = 200, tasks: int = 30, k: int = 4, base: float = 0.6, effect: float = 0.0, draws: int = 300, seed: int = 0) -> DataFrame:
    """How often the paired bootstrap calls a gain over simulated runs with a known effect, and how often its range holds the effect."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for t in batch["id"]:
            rng = np.random.default_rng([seed, int(t)])
            p = np.clip(rng.beta(base * 3, (1 - base) * 3, tasks), 0, 1)
            a, b = rng.binomial(k, p) / k, rng.binomial(k, np.clip(p + effect, 0, 1)) / k
            truth = float((np.clip(p + effect, 0, 1) - p).mean())
            d = b - a
            means = np.sort(d[rng.integers(0, tasks, (draws, tasks))].mean(1))
            lo, hi = means[int(0.025 * draws)], means[int(0.975 * draws) - 1]
            rows.append((bool(lo > 0 or hi < 0), bool(lo <= truth <= hi)))
        return pd.DataFrame(rows, columns=["called", "held"])

    done = spark.range(trials).repartition(8).groupBy(F.col("id") % 8).applyInPandas(lambda g: run(g), "called boolean, held boolean")
    return done.agg(F.count("*").alias("trials"), F.avg(F.col("called").cast("double")).alias("called"), F.avg(F.col("held").cast("double")).alias("held"))


def set_power(stats: DataFrame, effect: float = 0.05, k: int = 4) -> DataFrame:
    """Whether an evaluation set can resolve ``effect``: tasks, tied ones, base rate, tasks needed and the verdict."""
    n, c = F.col("n"), F.col("c")
    got = stats.agg(F.count("*").alias("tasks"), F.coalesce(F.sum(((c == 0) | (c == n)).cast("long")), F.lit(0)).alias("tied"), F.avg(c / n).alias("base")).first()
    base = got.base if got.base is not None else 0.0
    need = holdout_size(effect, base=min(max(base, 0.05), 0.95), k=k)
    verdict = "empty" if not got.tasks else "floored" if base < 0.05 else "saturated" if base > 0.95 else "usable" if got.tasks >= need else "underpowered"
    return stats.sparkSession.createDataFrame([(got.tasks, got.tied, round(base, 6), need, verdict)], "tasks long, tied long, base double, needed long, verdict string")
