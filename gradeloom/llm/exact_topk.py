"""Exact top-k inner products without random access: sorted lists are read in step, bounds decide when to stop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm.cluster import ready, table

#: Queries in one broadcast, and candidates in one block of sorted lists.
QUERIES_PER_PASS, BLOCK = 32_768, 4096
#: Shares of the lists that are read before bounds are compared.
SHARES = (0.55, 0.7, 0.85, 1.0)
SCALE = 1024.0


def scaled(ids: pa.Array, vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: ids, and floor(``SCALE`` * x) of the vectors; null ids, null vectors and null or non-finite components are left out."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    keep = ids.is_valid().to_numpy(zero_copy_only=False) & vectors.is_valid().to_numpy(zero_copy_only=False)
    offsets = vectors.offsets.to_numpy()
    values = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    keep &= bad[offsets[1:]] == bad[offsets[:-1]]
    sizes = np.diff(offsets)
    names = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = {}
    for d in np.unique(sizes[keep]).tolist():
        rows = np.flatnonzero(keep & (sizes == d))
        out[d] = names[rows], np.floor(values[offsets[rows][:, None] + np.arange(d)] * SCALE)
    return out


class Lists:
    """A block of candidates as one list for each component, sorted by value; read from the end that a query's sign asks for."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        order = np.argsort(rows, axis=0, kind="stable")
        self.values = np.ascontiguousarray(np.take_along_axis(rows, order, 0).T)
        self.order = np.ascontiguousarray(order.T)
        self.most = np.abs(self.values[:, [0, -1]]).max(1)

    def depths(self, query: np.ndarray, share: float) -> np.ndarray:
        """Entries of each list to read for a mean of about ``share`` of all: the more, the larger the query's component is."""
        weight = np.sqrt(np.abs(query))
        n = len(self.ids)
        if share >= 1:
            return np.full(len(query), n)
        return np.minimum(n, np.ceil(share * n * weight / max(weight.mean(), 1e-300))).astype(np.int64)

    def bounds(self, query: np.ndarray, depths: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(most, least) that each score can be after ``depths`` entries of the lists are read.

        A component that was seen counts as it is. One that wasn't is at most what was read last
        of its list, and at least the list's other end. Nothing is looked up by candidate.
        """
        n = len(self.ids)
        seen, above, below = [], [], []
        top = low = 0.0
        for values, order, x, depth in zip(self.values, self.order, query, depths, strict=True):
            if x > 0:
                read, last, other = slice(n - depth, n), values[n - max(depth, 1)], values[0]
            elif x < 0:
                read, last, other = slice(0, depth), values[max(depth, 1) - 1], values[-1]
            else:
                continue
            top += x * last
            low += x * other
            seen.append(order[read])
            above.append(x * (values[read] - last))
            if lower:
                below.append(x * (values[read] - other))
        if not seen:
            return np.full(n, top), np.full(n, low)
        seen = np.concatenate(seen)
        return top + np.bincount(seen, np.concatenate(above), n), low + np.bincount(seen, np.concatenate(below), n) if lower else None


def exact(queries: np.ndarray, rows: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs (q, c)."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    if most < 2**53:
        return np.concatenate([np.einsum("ij,ij->i", queries[q[k:k + 65536]], rows[c[k:k + 65536]]) for k in range(0, len(q), 65536)] or [np.empty(0)]).astype(np.int64)
    whole = [sum(int(x) * int(y) for x, y in zip(queries[a], rows[b], strict=True)) for a, b in zip(q, c, strict=True)]
    return np.array(whole, np.int64)  # raises if a score doesn't fit


class Searcher:
    """Keeps the ``k`` best of each query while blocks pass by."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]  # (scores, candidates)
        self.entries = self.read_entries = self.resolved = self.pairs = 0

    def read(self, block: Lists) -> None:
        for q in range(len(self.ids)):
            self._read(block, q)

    def _read(self, block: Lists, q: int) -> None:
        query, n, (scores, ids) = self.queries[q], len(block.ids), self.best[q]
        other = block.ids != self.ids[q]
        floor = float(scores[-1]) if len(scores) == self.k else -np.inf  # the k-th best score so far
        slack = 1 + float(np.abs(query) @ block.most) * 2.0**-40  # keeps rounding of the bounds on the safe side
        alive = other
        for share in SHARES if np.isfinite(floor) else SHARES[-2:]:
            depths = block.depths(query, share)
            upper, lower = block.bounds(query, depths, lower=np.isinf(floor))
            if lower is not None and other.sum() >= self.k:
                floor = np.partition(lower[other], -self.k)[-self.k] - slack
            alive = other & (upper + slack >= floor)
            if alive.sum() <= max(8 * self.k, n // 32):
                break  # outsiders can't qualify; what is left is resolved
        c = np.flatnonzero(alive)
        self.pairs, self.resolved = self.pairs + n, self.resolved + len(c)
        self.entries, self.read_entries = self.entries + n * len(query), self.read_entries + int(depths.sum())
        new = exact(query[None], block.rows, np.zeros(len(c), np.int64), c)
        both, names = np.concatenate([scores, new]), np.concatenate([ids, block.ids[c]])
        top = np.lexsort((names, -both))[: self.k]
        self.best[q] = both[top], names[top]

    def found(self) -> pa.RecordBatch:
        sizes = [len(s) for s, _ in self.best]
        cat = lambda xs: np.concatenate([*xs, np.empty(0, np.int64)])
        columns = np.repeat(self.ids, sizes), cat([i for _, i in self.best]), cat([s for s, _ in self.best])
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, *, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding", per_pass: int = QUERIES_PER_PASS) -> DataFrame:
    """query_id, rank, vec_id, score (long): each query's ``k`` best other rows by the inner product of floor(1024 x).

    Queries are the rows whose key is divisible by ``every``, candidates all rows; ties go to the smaller
    key. Rows with a null key, a null vector or a null or non-finite component take no part; vectors of
    another dimension are no candidates of a query. Rows that share a query's key are its own row and no
    candidates; a key's query is its smallest vector; other repeated rows rank one by one. Fewer
    candidates than ``k`` are all returned, an empty table gives none; other columns are ignored.

    Queries are broadcast, at most about ``per_pass`` at a time; every pass reads the candidates once,
    in blocks of sorted lists, and each task returns ``k`` rows a query at most. Lists are read in
    order only; a candidate is looked up at last, if its upper bound reaches the ``k``-th best score or lower bound.
    """
    spark = vectors.sparkSession
    ready(spark)
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("_key"), F.col(f"`{vector}`").cast("array<double>").alias("_vector"))
    rows = rows.where("_key IS NOT NULL AND _vector IS NOT NULL AND NOT exists(_vector, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))")
    queries = rows.where(F.col("_key") % every == 0).groupBy("_key").agg(F.min("_vector").alias("_vector"))
    total, asked = rows.count(), rows.where(F.col("_key") % every == 0).select("_key").distinct().count()
    parts = rows.coalesce(max(spark.sparkContext.defaultParallelism, total // 65_536 + 1))
    passes = -(-asked // per_pass)
    out = None
    for p in range(max(1, passes)):
        some = queries.where(F.pmod(F.xxhash64("_key"), F.lit(max(1, passes))) == p).orderBy("_key").toArrow()
        held = spark.sparkContext.broadcast(scaled(some.column(0), some.column(1)) if some.num_rows else {})

        def searched(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            searchers = {d: Searcher(ids, q, k) for d, (ids, q) in held.value.items()}
            waiting: dict[int, list] = {d: [] for d in searchers}

            def flush(d: int) -> None:
                if waiting[d]:
                    ids, own = (np.concatenate(x) for x in zip(*waiting[d], strict=True))
                    waiting[d] = []
                    for a in range(0, len(ids), BLOCK):
                        searchers[d].read(Lists(ids[a:a + BLOCK], own[a:a + BLOCK]))

            for batch in batches:
                for d, block in scaled(batch.column(0), batch.column(1)).items():
                    if d in searchers:
                        waiting[d].append(block)
                        if sum(len(x) for x, _ in waiting[d]) >= BLOCK:
                            flush(d)
            for d, s in searchers.items():
                flush(d)
                yield s.found()

        part = parts.mapInArrow(searched, "query_id long, vec_id long, score long")
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
