"""Vectors against vectors in blocks: matrix products of Arrow batches with a broadcast block of the other side."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one broadcast block of vectors; more vectors are taken in as many passes over the rows as it needs.
MAX_BLOCK = 64 << 20
#: Rows whose products with a block are held at a time.
ROWS = 512
ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver was started."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def unit_rows(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors) of those with the most frequent length; nulls inside count as 0, a zero vector stays."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    offsets = vectors.offsets.to_numpy()
    sizes = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    dim = int(np.bincount(sizes[sizes > 0]).argmax()) if (sizes > 0).any() else 0
    at = np.flatnonzero(sizes == dim) if dim else np.empty(0, np.int64)
    values = np.nan_to_num(vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False))
    rows = values[offsets[at][:, None] + np.arange(dim)].reshape(len(at), dim)
    length = np.sqrt((rows * rows).sum(1, keepdims=True))
    return at, np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def against(rows: DataFrame, others: DataFrame, emit: Callable, schema: str, *, max_block: int = MAX_BLOCK) -> DataFrame:
    """What ``emit`` makes of all products of ``rows`` with ``others``: both have a key and a vector, and any columns after those.

    ``emit(products, own, other)`` gets a matrix of at most ``ROWS`` rows' cosines with a block of the others, and the two sides'
    columns as lists of NumPy arrays (without the vectors); it returns columns by name. The others come to the driver one
    block of at most ``max_block`` bytes at a time and are broadcast; each block is a pass over the rows, which stay where they are.
    """
    spark = rows.sparkSession
    ready(spark)
    key, vector = others.columns[:2]
    total = others.select(F.sum(F.size(vector).cast("long") * 8 + 32)).first()[0] or 0
    passes = max(1, -(-total // max_block))
    names = schema.replace(",", " ").split()[::2]
    out = None
    for p in range(passes):
        part = others if passes == 1 else others.where(F.pmod(F.xxhash64(key), F.lit(passes)) == p)
        table = part.orderBy(key).toArrow()
        at, block = unit_rows(table.column(1)) if table.num_rows else (np.empty(0, np.int64), np.empty((0, 0)))
        held = spark.sparkContext.broadcast((block, [table.column(k).to_numpy()[at] for k in range(table.num_columns) if k != 1]))

        def made(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            block, other = held.value
            for batch in batches:
                for first in range(0, batch.num_rows, ROWS):
                    some = batch.slice(first, ROWS)
                    at, own = unit_rows(some.column(1))
                    fits = own.shape[1] == block.shape[1] and len(block)
                    columns = emit(own @ block.T if fits else np.zeros((len(at), len(block))), [some.column(k).to_numpy(zero_copy_only=False)[at] for k in range(some.num_columns) if k != 1], other)
                    yield pa.RecordBatch.from_pydict({n: columns[n] for n in names})

        found = rows.mapInArrow(made, schema)
        out = found if out is None else out.unionByName(found)
    return out
