"""Verifiers of a candidate against a reference, as Columns in [0, 1], and how to combine them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.functions.text import last_number


def _plain(x: Column) -> Column:
    stripped = F.translate(F.lower(F.coalesce(x, F.lit(""))), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "")
    return F.trim(F.regexp_replace(stripped, r"(?U)\s+", " "))


def exact_match(candidate: Column, reference: Column) -> Column:
    """Equal in full or on the last line, after lower case, punctuation and white space are levelled."""
    last = F.try_element_at(F.split(F.rtrim(candidate), "\n"), F.lit(-1))
    return ((_plain(candidate) == _plain(reference)) | (_plain(last) == _plain(reference))).cast("double")


def includes(candidate: Column, needles: list[str], need_all: bool = False) -> Column:
    low = F.lower(F.coalesce(candidate, F.lit("")))
    hits = [F.contains(low, F.lit(n.lower())) for n in needles]
    out = hits[0]
    for h in hits[1:]:
        out = (out & h) if need_all else (out | h)
    return out.cast("double")


def matches(candidate: Column, pattern: str) -> Column:
    return F.coalesce(F.rlike(candidate, F.lit(pattern)), F.lit(False)).cast("double")


def choice(candidate: Column, reference: Column) -> Column:
    """The last single letter A to E that the candidate names."""
    letters = F.regexp_extract_all(F.upper(F.coalesce(candidate, F.lit(""))), F.lit(r"\b([A-E])\b"), F.lit(1))
    return F.coalesce(F.try_element_at(letters, F.lit(-1)) == F.upper(F.trim(reference)), F.lit(False)).cast("double")


def numeric(candidate: Column, reference: Column, *, absolute: float = 1e-6, relative: float = 1e-6) -> Column:
    """The last number of each, within the larger of both tolerances."""
    a, b = last_number(candidate), last_number(reference)
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(absolute), F.lit(relative) * F.abs(b)), F.lit(False)).cast("double")


def json_field(candidate: Column, path: str, reference: Column) -> Column:
    got = F.get_json_object(candidate, path)
    return F.coalesce(F.lower(F.trim(got)) == F.lower(F.trim(reference)), F.lit(False)).cast("double")


def json_valid(candidate: Column) -> Column:
    return F.try_parse_json(candidate).isNotNull().cast("double")


def all_of(*scores: Column) -> Column:
    return F.least(*scores)


def any_of(*scores: Column) -> Column:
    return F.greatest(*scores)


def weighted(scores: dict[str, tuple[Column, float]]) -> Column:
    total = sum(w for _, w in scores.values())
    out = F.lit(0.0)
    for s, w in scores.values():
        out = out + s * w
    return out / total


def rubric(criteria: str) -> Column:
    """Score of an array of (kind, weight, met): a failed hard rule gives 0, else met principles less hit pitfalls over the
    principles' weight, in [0, 1]; with pitfalls only, 1 less their share. Unanswered is not met."""
    met = lambda c: F.coalesce(c["met"], F.lit(False))
    part = lambda kind, only: F.aggregate(F.filter(criteria, lambda c: (c["kind"] == kind) & (met(c) if only else F.lit(True))), F.lit(0.0), lambda s, c: s + c["weight"])
    failed = F.exists(criteria, lambda c: (c["kind"] == "hard") & ~met(c))
    principle, pitfall = part("principle", False), part("pitfall", False)
    share = F.when(principle > 0, (part("principle", True) - part("pitfall", True)) / principle).when(pitfall > 0, 1 - part("pitfall", True) / pitfall).otherwise(1.0)
    return F.when(failed, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def user_verifier(fn: Callable[[str, str], float | tuple[float, str]]) -> Callable[[Column, Column], Column]:
    """A user's function as an Arrow-batched UDF of struct<reward, reason>; an exception gives a null reward and its message."""

    @F.pandas_udf("reward double, reason string")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for candidates, references in batches:
            rows = []
            for c, r in zip(candidates, references, strict=True):
                try:
                    got = fn(c, r)
                    reward, reason = got if isinstance(got, tuple) else (got, None)
                    rows.append((float(reward), reason))
                except Exception as error:  # noqa: BLE001 - a verifier's failure is a result
                    rows.append((None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["reward", "reason"])

    return scored
