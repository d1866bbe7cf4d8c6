"""Generation of variants: text mutations, covering arrays of attribute values, greedy orders by new word pairs."""

from __future__ import annotations

import heapq
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The greedy order looks at all rows' word pairs at the driver: so many at most.
MAX_GREEDY_ROWS = 50_000


def mutations(text: str) -> Column:
    """Variants of a text as an array of (kind, text): halved, without its middle word, first two words swapped, a typo, doubled end mark."""
    words = F.split(F.trim(F.col(text)), r"\s+")
    n = F.size(words)
    middle = F.floor(n / 2).cast("int")
    half = F.array_join(F.slice(words, F.lit(1), F.greatest(middle, F.lit(1))), " ")
    shorter = F.array_join(F.filter(words, lambda _, i: i != middle), " ")
    swapped = F.array_join(F.concat(F.slice(words, F.lit(2), F.lit(1)), F.slice(words, F.lit(1), F.lit(1)), F.slice(words, F.lit(3), F.greatest(n, F.lit(1)))), " ")
    typo = F.regexp_replace(F.col(text), r"^(\s*\S)(\S)(\S)", "$1$3$2")
    made = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("text")) for k, v in (("halved", half), ("shorter", shorter), ("swapped", swapped), ("typo", typo), ("marked", F.concat(F.col(text), F.lit("!!"))))))
    return F.filter(made, lambda m: (m["text"] != "") & (m["text"] != F.col(text)))


def crossover(a: Column, b: Column) -> Column:
    """The first half of a's words and the second half of b's."""
    x, y = F.split(F.trim(a), r"\s+"), F.split(F.trim(b), r"\s+")
    head = F.slice(x, F.lit(1), F.ceil(F.size(x) / 2).cast("int"))
    tail = F.slice(y, (F.floor(F.size(y) / 2) + 1).cast("int"), F.size(y))
    return F.array_join(F.concat(head, tail), " ")


def covering_rows(axes: dict[str, list[str]], strength: int = 2) -> list[dict[str, str]]:
    """Few rows that show every combination of values of any ``strength`` axes, built greedily; the same axes give the same rows."""
    names = sorted(axes)
    strength = min(strength, len(names))
    missing = {tuple(zip(group, values, strict=True)) for group in combinations(names, strength) for values in _product([axes[n] for n in group])}
    out = []
    while missing:
        row = dict(min(missing))
        for name in names:
            if name not in row:
                gain = {v: sum(1 for m in missing if (name, v) in m and all(row.get(k, w) == w for k, w in m if k != name)) for v in axes[name]}
                row[name] = min(axes[name], key=lambda v: (-gain[v], axes[name].index(v)))
        missing -= {m for m in missing if all(row[k] == w for k, w in m)}
        out.append({n: row[n] for n in names})
    return out


def _product(lists: list[list[str]]) -> list[tuple]:
    rows: list[tuple] = [()]
    for values in lists:
        rows = [(*r, v) for r in rows for v in values]
    return rows


def greedy_order(rows: DataFrame, *, key: str, features: str, cost: str) -> DataFrame:
    """(key, place): by new features per cost, lazily re-evaluated; ties to the smaller key.

    Each pick depends on all before it, so this runs at the driver, on at most ``MAX_GREEDY_ROWS`` rows;
    more raise an error and should be clustered first.
    """
    found = rows.select(key, features, cost).limit(MAX_GREEDY_ROWS + 1).collect()
    if len(found) > MAX_GREEDY_ROWS:
        raise ValueError(f"greedy_order takes at most {MAX_GREEDY_ROWS} rows")
    sets = {r[0]: set(r[1] or ()) for r in found}
    price = {r[0]: max(1.0, float(r[2] or 1)) for r in found}
    heap = [(-len(s) / price[k], k) for k, s in sets.items()]
    heapq.heapify(heap)
    seen: set = set()
    order = []
    while heap:
        _, k = heapq.heappop(heap)
        now = (-len(sets[k] - seen) / price[k], k)
        if heap and now > heap[0]:
            heapq.heappush(heap, now)
            continue
        seen |= sets[k]
        order.append((k, len(order) + 1))
    return rows.sparkSession.createDataFrame(order, f"{key} {rows.schema[key].dataType.simpleString()}, place int")
