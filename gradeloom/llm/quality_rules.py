"""Quality rules as weak supervision: rules vote or abstain, EM estimates how far to trust each, the posterior decides."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.cluster import ready, table, written
from gradeloom.llm.wordhash import spans, windows, word_hashes

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_letters", "n_pipes", "n_distinct", "n_lines")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def text_counts(text: bytes | None) -> tuple[int, ...]:
    """The counts named in ``BASE`` and ``MORE``, over the whole text (null: none)."""
    data = np.frombuffer(text or b"", np.uint8)
    starts, ends = spans(data)
    n = len(starts)
    if not n:
        return (0, 0, int(_SYMBOL[data].sum()), 0, 0, 0, 0, 0, 0, 0)
    head = (data & 0xC0) != 0x80  # the first byte of each code point
    blank = int(((data >= 9) & (data <= 13) | (data == 32)).sum())
    words = word_hashes(text)
    keys = windows(words, 5)
    covered = 0
    if len(keys):
        _, where, times = np.unique(keys, return_inverse=True, return_counts=True)
        if (often := times[where] > 1).any():
            edge = np.zeros(n + 1, np.int32)
            edge[:-5] += often
            edge[5:] -= often
            covered = int((np.cumsum(edge) > 0).sum())
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return (
        n, int(head.sum()) - blank, int(_SYMBOL[data].sum()), len(lines) - len(set(lines)), covered,
        int(((data >= 65) & (data <= 90)).sum()), int(_LETTER[data].sum()), int((data == 124).sum()), len(np.unique(words)), len(lines),
    )


def with_counts(docs: DataFrame, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``carry`` and the counts, as long, for every row."""
    ready(docs.sparkSession)
    docs = docs.select(*(F.col(f"`{c}`") for c in carry), F.col(f"`{text}`").cast("string").alias("_text"))
    names = [*BASE, *MORE]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_counts(x.as_buffer().to_pybytes() if x.is_valid else None) for x in batch.column(len(carry))]
            counts = np.array(found, np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(counts[:, k]) for k in range(len(names)))], names=[*carry, *names])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.mapInArrow(counted, f"{schema}, {', '.join(f'{x} long' for x in names)}")


def votes() -> dict[str, F.Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains."""
    c = F.col
    n, chars, letters = c("n_words"), F.greatest(c("word_chars"), F.lit(1)), F.greatest(c("n_letters"), F.lit(1))
    other = c("n_symbols") - c("n_pipes")
    # distinct words grow slower than words, by about a square root in long texts
    distinct = c("n_distinct") * F.sqrt(F.greatest(n, F.lit(400)).cast("double") / 400)
    enough = n >= 10
    bad = {
        "word_length": enough & ((chars > 12 * n) | (2 * chars < 5 * n)),
        "symbols": 10 * other > n,
        "pipes": 10 * c("n_pipes") > n,
        "capitals": (letters >= 20) & (2 * c("n_upper") > letters),
        "repeated_words": enough & (5 * c("n_repeat_words") > n),
        "few_distinct_words": enough & (distinct < 0.3 * n),
        "repeated_lines": (c("n_lines") >= 4) & (10 * c("n_dup_lines") > 3 * c("n_lines")),
    }
    clean = (50 * c("n_symbols") <= n) & (5 * c("n_upper") <= letters) & (chars <= 9 * n)
    good = {
        "prose": clean & (letters >= 20) & (chars >= 3 * n),
        "varied_prose": clean & enough & (10 * c("n_repeat_words") <= n) & (distinct >= 0.4 * n),
    }
    return {k: F.when(x, -1).otherwise(0) for k, x in bad.items()} | {k: F.when(x, 1).otherwise(0) for k, x in good.items()}


@dataclass(frozen=True)
class LabelModel:
    """What EM found: the share of good documents, and for each rule P(vote | class) with classes bad, good and votes -1, 0, 1."""

    prior: float
    table: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        score = np.log([1 - self.prior, self.prior]) + np.log(self.table)[np.arange(patterns.shape[1]), :, patterns + 1].sum(1)
        good = 1 / (1 + np.exp(score[:, 0] - score[:, 1]))
        return np.where(patterns.any(1), good, self.prior)  # where all abstain nothing is known


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, *, prior: float = 0.7, accuracy: float = 0.9, pseudo: float = 2.0, rounds: int = 200) -> LabelModel:
    """EM over distinct vote patterns and their numbers of documents.

    Rules are taken as independent given the class. A rule that votes is held to be right more
    often than wrong: its chance to vote for a class is kept at least as high in that class as in
    the other, so the classes can't change places. ``pseudo`` counts smooth every estimate.
    """
    rules = patterns.shape[1]
    start = np.array([[accuracy, 0, 1 - accuracy], [1 - accuracy, 0, accuracy]])
    seen = np.stack([(counts[:, None] * (patterns == v)).sum(0) for v in (-1, 0, 1)], 1) + pseudo
    share = seen / seen.sum(1, keepdims=True)
    made = start[None] * (1 - share[:, None, 1:2])
    made[:, :, 1] = share[:, None, 1]
    model = LabelModel(prior, np.clip(made, 1e-6, 1) / np.clip(made, 1e-6, 1).sum(2, keepdims=True))
    for _ in range(rounds):
        good = model.posterior(patterns)
        weight = np.stack([counts * (1 - good), counts * good], 1)
        made = np.stack([(weight[:, None, :] * (patterns == v)[:, :, None]).sum(0) for v in (-1, 0, 1)], 2)
        made = made + pseudo * share[:, None, :]
        made /= made.sum(2, keepdims=True)
        for k in range(rules):  # keep each vote's meaning
            for v, cls in ((0, 0), (2, 1)):
                if made[k, cls, v] < made[k, 1 - cls, v]:
                    made[k, :, v] = made[k, :, v].mean()
        made /= made.sum(2, keepdims=True)
        new = LabelModel(float(np.clip((weight[:, 1].sum() + pseudo * prior) / (counts.sum() + pseudo), 1e-3, 1 - 1e-3)), np.clip(made, 1e-6, 1))
        done = abs(new.prior - model.prior) < 1e-9 and np.abs(new.table - model.table).max() < 1e-9
        model = new
        if done:
            break
    return model


def judge_quality(docs: DataFrame, *, text: str = "text", key: str = "doc_id", min_words: int = 10, max_repeat_percent: int = 20, threshold: float = 0.5) -> DataFrame:
    """For every row: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_percent`` % of them in
    five-word windows found twice or more. ``posterior`` is the probability of being good
    under the label model fitted by EM on the votes of all documents; kept means no base failure
    and at least ``threshold``. EM needs the number of documents of each distinct vote pattern only:
    at most 3 to the power of the number of rules, whatever the input's size.

    Null and empty texts have no words: counts 0, base_failed true, kept false. Repeated rows are
    judged alike; a null key is returned as it is; an empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    counts = written(with_counts(docs, text=text, carry=(key,)), "quality-counts")
    rules = votes()
    voted = counts.select("*", *(v.cast("int").alias(f"_vote_{k}") for k, v in rules.items()))
    columns = [f"_vote_{k}" for k in rules]
    seen = voted.groupBy(*columns).count().toPandas()
    n, repeats = F.col("n_words"), F.col("n_repeat_words")
    failed = (n < min_words) | (100 * repeats > max_repeat_percent * n)
    if len(seen):
        patterns = seen[columns].to_numpy(np.int64)
        model = fit_label_model(patterns, seen["count"].to_numpy(np.float64))
        known = spark.createDataFrame(pa.table({c: pa.array(patterns[:, k], pa.int32()) for k, c in enumerate(columns)} | {"posterior": pa.array(model.posterior(patterns))}))
        voted = voted.join(F.broadcast(known), columns, "left")  # at most 3 ** len(rules) rows
    else:
        voted = voted.withColumn("posterior", F.lit(None).cast("double"))
    return voted.select(F.col(f"`{key}`"), *BASE, failed.alias("base_failed"), (~failed & (F.coalesce("posterior", F.lit(0.0)) >= threshold)).alias("kept"), "posterior")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))
