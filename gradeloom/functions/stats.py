"""Closed forms: as Columns where rows need them, as plain functions where one report does."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_95 = 1.96
ALPHA, POWER = 0.05, 0.8


def wilson(successes: Column, n: Column, z: float = Z_95) -> tuple[Column, Column]:
    """Wilson score interval, null where n is 0."""
    count = F.when(n > 0, n.cast("double"))
    p = successes.cast("double") / count
    scale = 1 + z * z / count
    centre = (p + z * z / (2 * count)) / scale
    half = z * F.sqrt(p * (1 - p) / count + z * z / (4 * count * count)) / scale
    # greatest and least skip nulls
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)), F.when(n > 0, F.least(F.lit(1.0), centre + half))


def all_of_k(n: Column, c: Column, k: int) -> Column:
    """Chance that k draws without replacement from n, c of them passing, all pass; null where n < k."""
    part = F.lit(1.0)
    for i in range(k):
        part = part * F.greatest(c - i, F.lit(0)).cast("double") / F.greatest(n - i, F.lit(1)).cast("double")
    return F.when(n >= k, part)


def any_of_k(n: Column, c: Column, k: int) -> Column:
    """Chance that at least one of k draws passes; null where n < k."""
    return 1 - all_of_k(n, n - c, k)


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from sums; null with fewer than three points or without variance."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((n >= 3) & (vx > 1e-12) & (vy > 1e-12), (n * sxy - sx * sy) / F.sqrt(vx * vy))


def kappa(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Cohen's kappa to four places; where chance agreement is certain, 1 if all agree and else 0."""
    n = F.when(tp + fp + fn + tn > 0, (tp + fp + fn + tn).cast("double"))
    seen = (tp + tn) / n
    chance = ((tp + fp) / n) * ((tp + fn) / n) + ((fn + tn) / n) * ((fp + tn) / n)
    return F.when(chance >= 1, F.when(seen >= 1, 1.0).otherwise(0.0)).otherwise(F.round((seen - chance) / F.nullif(1 - chance, F.lit(0.0)), 4))


def two_proportion_p(x_a: int, n_a: int, x_b: int, n_b: int) -> float | None:
    """Two-sided p of a pooled two-proportion z test; None where the pooled share is 0 or 1."""
    if not n_a or not n_b or (pooled := (x_a + x_b) / (n_a + n_b)) in (0, 1):
        return None
    z = (x_a / n_a - x_b / n_b) / math.sqrt(pooled * (1 - pooled) * (1 / n_a + 1 / n_b))
    return math.erfc(abs(z) / math.sqrt(2))


def t_cdf(t: float, df: float) -> float:
    """Student's t distribution by numerical integration of its density (Simpson's rule over a bounded angle)."""
    # with t = sqrt(df) tan(a) the density becomes cos(a) ** (df - 1), smooth on (-pi/2, pi/2)
    end, steps = math.atan(t / math.sqrt(df)), 4000
    h = end / steps
    f = lambda a: math.cos(a) ** (df - 1)
    area = h / 3 * (f(0) + f(end) + sum((4 if k % 2 else 2) * f(k * h) for k in range(1, steps)))
    return 0.5 + area * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)


def t_quantile(df: float, level: float = 1 - ALPHA) -> float:
    """Two-sided quantile by bisection."""
    want, low, high = (1 + level) / 2, 0.0, 1e3
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if t_cdf(middle, df) < want else (low, middle)
    return (low + high) / 2


def noise_band(run_std: float, n_a: int, n_b: int, df: int | None = None, level: float = 1 - ALPHA) -> float:
    """Largest difference of two arms that re-runs alone explain; a t quantile where the std was estimated with df."""
    q = t_quantile(df, level) if df else NormalDist().inv_cdf((1 + level) / 2)
    return q * run_std * math.sqrt(1 / n_a + 1 / n_b)


def holdout_size(effect: float, *, base: float = 0.6, k: int = 4, power: float = POWER, alpha: float = ALPHA, sd: float | None = None) -> int:
    """Tasks that a paired comparison needs to see ``effect``; sd modelled from the base rate unless measured."""
    after = min(1.0, base + effect)
    sd = sd if sd is not None else math.sqrt((base * (1 - base) + after * (1 - after)) / k)
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return max(2, math.ceil((z * sd / effect) ** 2))


def detectable_effect(n_tasks: int, *, base: float = 0.6, k: int = 4, power: float = POWER, alpha: float = ALPHA, steps: int = 12) -> float:
    """The effect that ``n_tasks`` can see: fixed point of the size formula."""
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    effect = 0.1
    for _ in range(steps):
        after = min(1.0, base + effect)
        effect = z * math.sqrt((base * (1 - base) + after * (1 - after)) / k) / math.sqrt(n_tasks)
    return effect


def laplace(successes: Column, trials: Column, alpha: float = 1.0) -> Column:
    return (successes + alpha) / (trials + 2 * alpha)
