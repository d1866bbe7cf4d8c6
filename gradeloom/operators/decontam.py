"""Decontamination: training texts against evaluation texts by task, exact text, n-gram coverage and cosine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.text import ngrams, normalised, words
from gradeloom.operators.blocks import MAX_BLOCK, against

NGRAM, OVERLAP, SIMILARITY = 8, 0.8, 0.85


def exact_hits(train: DataFrame, evals: DataFrame, *, key: str, text: str, eval_text: str) -> DataFrame:
    """Keys whose normalised text is an evaluation text; digests meet, not texts."""
    side = lambda df, t: F.sha2(normalised(F.col(t)), 256)
    known = evals.where(normalised(F.col(eval_text)) != "").select(side(evals, eval_text).alias("_h")).distinct()
    return train.select(key, side(train, text).alias("_h")).join(known, "_h", "left_semi").select(key)


def ngram_coverage(train: DataFrame, evals: DataFrame, *, key: str, text: str, eval_key: str, eval_text: str, n: int = NGRAM, overlap: float = OVERLAP) -> DataFrame:
    """(key, eval_key, coverage): the largest share of a training text's words that n-grams of one evaluation text cover.

    Only grams that some evaluation text has leave the training side: its distinct grams are joined first,
    by hash, and the rest of the text never travels. Ties go to the smaller evaluation key; texts shorter
    than n words have no grams. Returned where the share is at least ``overlap``.
    """
    w = words(F.col(eval_text))
    grams = evals.select(F.col(eval_key).alias("_e"), F.explode(F.array_distinct(ngrams(w, n))).alias("_g")).select("_e", F.xxhash64("_g").alias("_h"), "_g")
    tokens = train.select(F.col(key).alias("_k"), words(F.col(text)).alias("_w"))
    placed = tokens.select("_k", F.size("_w").alias("_n"), F.posexplode(ngrams(F.col("_w"), n)).alias("_p", "_g")).select("_k", "_n", "_p", F.xxhash64("_g").alias("_h"), "_g")
    hits = placed.join(grams, ["_h", "_g"]).select("_k", "_n", "_e", F.explode(F.sequence("_p", F.col("_p") + n - 1)).alias("_at"))
    share = hits.groupBy("_k", "_n", "_e").agg((F.countDistinct("_at")).alias("_c")).withColumn("coverage", F.col("_c") / F.col("_n"))
    best = share.groupBy("_k").agg(F.max(F.struct("coverage", (-F.col("_e")).alias("e"))).alias("b"))
    return best.select(F.col("_k").alias(key), (-F.col("b.e")).alias(eval_key), F.col("b.coverage").alias("coverage")).where(F.col("coverage") >= overlap)


def dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: str):
    """The vector over its length; a zero vector stays."""
    length = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(F.col(vector), lambda x: F.when(length > 0, x.cast("double") / length).otherwise(0.0))


def best_cosine(rows: DataFrame, sources: DataFrame, *, key: str, vector: str, source_key: str, source_vector: str, max_block: int = MAX_BLOCK) -> DataFrame:
    """(key, source_key, cosine): the nearest source of every row, ties (to twelve places) to the smaller key.

    A stated set of sources against all rows, by matrix products of Arrow batches with blocks of sources (see
    ``blocks.against``). Each row leaves a block with one candidate. Zero vectors have cosine 0; keys are whole numbers.
    """

    def emit(products: np.ndarray, own: list, other: list) -> dict:
        if not products.shape[1]:
            return {"_k": np.empty(0, np.int64), "_s": np.empty(0, np.int64), "c": np.empty(0)}
        best = np.round(products, 12).argmax(1)  # others are in the order of their keys
        return {"_k": own[0].astype(np.int64), "_s": other[0][best].astype(np.int64), "c": products[np.arange(len(best)), best]}

    met = against(rows.select(key, vector), sources.select(source_key, source_vector), emit, "_k long, _s long, c double", max_block=max_block)
    best = met.groupBy("_k").agg(F.max(F.struct(F.round("c", 12), (-F.col("_s")).alias("s"), "c")).alias("b"))
    kind = lambda df, c: df.schema[c].dataType
    return best.select(F.col("_k").cast(kind(rows, key)).alias(key), (-F.col("b.s")).cast(kind(sources, source_key)).alias(source_key), F.col("b.c").alias("cosine"))


def contained(rows: DataFrame, needles: str, text: str, least: int = 12):
    """The first needle of at least ``least`` characters that the row's own text quotes, else null."""
    quoted = F.filter(F.col(needles), lambda x: (F.length(x) >= least) & F.contains(F.lower(F.col(text)), F.lower(x)))
    return F.try_element_at(quoted, F.lit(1))
