"""Quality by positive-unlabelled learning: non-negative unbiased risk, trusted positives, unlabelled web text, estimated prior."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.cluster import least_hashes, ready, table
from gradeloom.llm.toxicity import held_out
from gradeloom.llm.wordhash import mixed, windows, word_hashes

#: At most so many positives, and so many unlabelled texts, are trained on.
MAX_POSITIVES = 2000
MAX_UNLABELLED = 4000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def packed_size(text: str) -> int:
    """Bytes of the whole text after compression, a piece at a time."""
    packer, total = zlib.compressobj(1), 0
    for at in range(0, len(text), 1 << 20):
        total += len(packer.compress(text[at:at + (1 << 20)].encode("utf-8", "replace")))
    return total + len(packer.flush())


def describe(text: str | None) -> list[float]:
    """What a whole text looks like: lengths, character classes, repetition of words, pairs and lines."""
    text = text or ""
    words = _WORD.findall(text)
    n, size = len(words), max(1, len(text))
    m = max(1, n)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    twice = sum(a == b for a, b in zip(words, words[1:], strict=False))
    letters = sum(map(len, re.findall(r"[^\W\d_]+", text)))
    upper = sum(map(str.isupper, words))
    lines = [x for x in text.split("\n") if x.strip()]
    top = sum(k for _, k in counts.most_common(3))
    symbols = sum(map(text.count, "#*$%&|<>{}[]=_~^@\\/"))
    return [
        np.log1p(n), letters / size, symbols / m, text.count("|") / m, text.count("!") / m, upper / m,
        len(counts) / m, pairs / max(1, n - 1), twice / max(1, n - 1), top / m,
        sum(map(len, words)) / m, 1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)),
        sum(text.count(x) for x in ".?") / m, len(re.findall(r"\d", text)) / size,
        packed_size(text) / size,
    ]


#: Classes that words, pairs of words and runs of three bytes are hashed to.
CLASSES = 1 << 11
_KINDS = np.arange(1, 4, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a long text that are cut into runs at a time.
PIECE = 1 << 21


def hashed(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(classes, weights) of a whole text's words, neighbouring words and runs of three bytes: 1 + ln of the count, of length 1 for each of the three kinds."""
    raw = (text or "").encode("utf-8", "replace")
    words = word_hashes(raw, fold=True) if raw else np.empty(0, np.uint64)
    data = np.frombuffer(raw, np.uint8)
    runs = np.zeros(1 << 24 >> 8, np.int64)  # a run is told by a 16-bit hash
    for at in range(0, max(0, len(data) - 2), PIECE):
        piece = data[at:at + PIECE + 2].astype(np.uint32)
        told = (piece[:-2] << 16 | piece[1:-1] << 8 | piece[2:]) * np.uint32(0x9E3779B1) >> np.uint32(16)
        runs += np.bincount(told, minlength=len(runs))
    there = np.flatnonzero(runs)
    found = []
    for kind, keys, times in ((0, *np.unique(words, return_counts=True)), (1, *np.unique(windows(words, 2), return_counts=True)), (2, there.astype(np.uint64), runs[there])):
        if len(keys):
            weight = 1 + np.log(times)
            found.append(((mixed(keys + _KINDS[kind]) % np.uint64(CLASSES)).astype(np.int64), weight / np.sqrt((weight**2).sum())))
    if not found:
        return np.empty(0, np.int64), np.empty(0)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


@dataclass(frozen=True)
class Texts:
    """Measures of some texts, and the weights of their hashed words."""

    measures: np.ndarray
    words: np.ndarray

    @classmethod
    def of(cls, measures: list, sparse: list[tuple[np.ndarray, np.ndarray]]) -> Texts:
        words = np.zeros((len(sparse), CLASSES), np.float32)
        for row, (at, value) in zip(words, sparse, strict=True):
            np.add.at(row, at, value)
        return cls(np.array(measures, np.float64).reshape(len(sparse), len(measures[0]) if measures else len(describe(""))), words)

    def __len__(self) -> int:
        return len(self.words)

    def every(self, step: int, first: int) -> Texts:
        return Texts(self.measures[first::step], self.words[first::step])


#: Quantiles of each measure, denser in the tails, where poor texts sit.
QUANTILES = (0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98, 0.995)
EDGES = len(QUANTILES)
#: Weight of an edge that is reached; ridge; steps of the fit.
EDGE, L2, STEPS = 0.2, 3e-4, 400


@dataclass(frozen=True)
class QualityModel:
    edges: np.ndarray  # measure x EDGES, quantiles of the texts trained on
    weights: np.ndarray  # of the edges, of the classes, and the bias
    prior: float

    def spread(self, texts: Texts) -> np.ndarray:
        """One row a text: which edges each measure reaches, hashed words, 1."""
        reached = (texts.measures[:, :, None] >= self.edges).reshape(len(texts), -1) * np.float32(EDGE)
        return np.concatenate([reached.astype(np.float32), texts.words, np.ones((len(texts), 1), np.float32)], 1)

    def score(self, texts: Texts) -> np.ndarray:
        return sigma(self.spread(texts) @ self.weights).astype(np.float64)


def sigma(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from scores that weren't fitted on them.

    Below any score c the unlabelled hold at least prior * P(score >= c | positive) above it; the least
    ratio of the two tail shares is the estimate (best-bin estimation), lowered by
    three standard errors: too high a prior would make the risk unbounded below.
    """
    cuts = np.unique(np.quantile(positive, np.linspace(0.01, 0.5, 50)))
    best = min(((unlabelled >= c).mean() / (positive >= c).mean() for c in cuts), default=1.0)
    return float(np.clip(best - 3 * np.sqrt(max(0.0, best * (1 - best)) / len(unlabelled)), 0.01, 0.99))


def minimise(x_p: np.ndarray, x_u: np.ndarray, prior: float, *, l2: float = L2, steps: int = STEPS, rate: float = 0.1) -> np.ndarray:
    """Minimises the non-negative risk prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) + l2 |w|^2 with the logistic loss.

    R_u(-) - prior * R_p(-) estimates the risk of negatives, which is never below 0. While it is above, the step goes down the whole risk;
    where it is below, what was fitted is noise, and the step goes up that term instead, until it is 0 again. Steps are
    scaled by running means of the slopes and their squares, and shrink in the second half, whose points are averaged:
    one of them alone may lie on either side of 0.
    """
    w, mean, square = (np.zeros(x_p.shape[1]) for _ in range(3))
    total = np.zeros(len(w))
    ridge = np.append(np.full(len(w) - 1, 2 * l2), 0)
    for t in range(1, steps + 1):
        z_p, z_u = x_p @ w.astype(np.float32), x_u @ w.astype(np.float32)
        negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        rise = 1.0 if negative >= 0 else -1.0
        # slopes of the losses: of + sigma - 1, of - sigma
        e_p = (prior * (sigma(z_p) - 1) if negative >= 0 else 0) - rise * prior * sigma(z_p)
        slope = e_p.astype(np.float32) @ x_p / len(x_p) + (rise * sigma(z_u)).astype(np.float32) @ x_u / len(x_u) + ridge * w
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        w = w - rate * min(1.0, 2 * (1 - t / steps) + 0.02) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
        total += w * (2 * t > steps)
    return total / max(1, steps - steps // 2)


def fit(positive: Texts, unlabelled: Texts) -> QualityModel:
    """Two passes: with even odds, one half of the texts gives scores to the other, from which the class prior is
    estimated; then the non-negative risk is minimised with that prior on all."""
    wide = len(describe(""))
    if not len(positive) or not len(unlabelled):
        return QualityModel(np.zeros((wide, EDGES)), np.zeros(wide * EDGES + CLASSES + 1), 0.5)
    edges = np.quantile(np.concatenate([positive.measures, unlabelled.measures]), QUANTILES, axis=0).T
    edges = edges + 1e-9 * (1 + np.abs(edges))  # a measure that most texts have exactly doesn't reach its edge
    blank = QualityModel(edges, np.zeros(0), 0.5)
    x_p, x_u = blank.spread(positive), blank.spread(unlabelled)
    halves = []
    for k in (0, 1):
        if len(x_p) > 3 and len(x_u) > 3:
            w = minimise(x_p[k::2], x_u[k::2], 0.5, l2=2 * L2, steps=STEPS // 2)
            halves.append((x_p[1 - k::2] @ w, x_u[1 - k::2] @ w))
    prior = float(np.mean([estimate_prior(p, u) for p, u in halves] or [0.5]))
    return QualityModel(edges, minimise(x_p, x_u, prior), prior)


def _described(rows: DataFrame) -> Texts:
    """Measures and hashed words of ``_text`` of a bounded number of rows, in a fixed order, at the driver, as bytes of fixed length a row."""
    ready(rows.sparkSession)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = Texts.of([describe(x) for x in part.column(1).to_pylist()], [hashed(x) for x in part.column(1).to_pylist()])
                columns = [pa.array([x.tobytes() for x in m], pa.binary()) for m in (found.measures, found.words)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["_order", "measures", "words"])

    found = rows.select("_order", "_text").mapInArrow(measured, "_order long, measures binary, words binary").toArrow().sort_by("_order")
    matrix = lambda c, kind, wide: np.frombuffer(b"".join(x.as_py() for x in found.column(c)), kind).reshape(found.num_rows, wide)
    return Texts(matrix("measures", np.float64, len(describe(""))), matrix("words", np.float32, CLASSES))


def train(docs: DataFrame, labels: DataFrame, *, positives: int = MAX_POSITIVES, unlabelled: int = MAX_UNLABELLED, key: str = "doc_id", text: str = "text") -> QualityModel:
    """Positives are rows labelled 1 that aren't held out; the unlabelled are any of ``docs`` that aren't. Both bounded, by the order of a hash; a key with both labels has none."""
    known = labels.where(F.col(f"`{key}`").isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col(f"`{key}`").alias("_key")).agg(F.min("quality").alias("_least"))
    known = known.where(~held_out("_key") & (F.col("_least") == 1))
    known = known.select("_key", F.xxhash64(F.col("_key").cast("string"), F.lit(3)).alias("_order"))
    edge = least_hashes(known, "_order", positives)
    texts = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"))
    some_p = F.broadcast(known.where(F.col("_order") <= F.lit(edge)).select("_key") if edge is not None else known.select("_key").limit(0))  # a bounded number of keys
    p = texts.join(some_p, "_key").select(F.xxhash64("_key", "_text").alias("_order"), "_text").dropDuplicates(["_order"])  # repeated rows count once
    u = texts.where(~held_out("_key")).select(F.xxhash64("_key", "_text", F.lit(5)).alias("_order"), "_text")
    edge = least_hashes(u, "_order", unlabelled)
    u = u.where(F.col("_order") <= F.lit(edge)).dropDuplicates(["_order"]) if edge is not None else u.limit(0)
    return fit(_described(p), _described(u))


def score_documents(docs: DataFrame, model: QualityModel, *, text: str = "text", score: str = "score") -> DataFrame:
    """All columns of ``docs`` and the double ``score`` (replacing one of that name)."""
    ready(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for at in range(0, len(texts), 256):
                part = texts.iloc[at:at + 256]
                out.append(held.value.score(Texts.of([describe(x) for x in part], [hashed(x) for x in part])))
            yield pd.Series(np.concatenate(out) if out else [], dtype="float64")

    return docs.withColumn(score, scored(F.col(f"`{text}`").cast("string")))


def judge_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, positives: int = MAX_POSITIVES, unlabelled: int = MAX_UNLABELLED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: key, held_out, score, predicted (score >= ``threshold``).

    Null texts count as empty ones; a null key isn't held out and has no label; without positives every
    score is 0.5. Repeated rows are scored alike, an empty table gives none, other columns are ignored.
    """
    model = train(docs, labels, positives=positives, unlabelled=unlabelled, key=key, text=text)
    found = score_documents(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("_text")), model, text="_text")
    return found.select(F.col(f"`{key}`"), held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
