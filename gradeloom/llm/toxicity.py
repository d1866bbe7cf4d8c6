"""Toxicity: a linear classifier whose training penalises score changes under swapped identity terms."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.cluster import least_hashes, ready, table, written

#: Identity terms that are known beforehand, by category; the terms of a category are swapped for each other. More
#: are found in the labelled texts (see ``found_terms``).
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "transgender"),
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("girls", "boys"), ("female", "male"),
    ("deaf", "blind", "disabled", "autistic"), ("old", "young", "elderly"),
    ("mexican", "german", "french", "spanish", "chinese", "indian", "american", "russian", "turkish"),
    ("frauen", "männer"), ("frau", "mann"), ("christen", "muslime", "juden", "hindus"),
    ("femmes", "hommes"), ("femme", "homme"), ("chrétiens", "musulmans", "juifs"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("cristianos", "musulmanes", "judíos"),
)
#: At most so many labelled documents of each class are trained on.
MAX_PER_CLASS = 3000
#: Features that the classifier may use, and words that may turn out to be swapped, at most; the most telling, the most frequent.
MAX_FEATURES, MAX_TERMS = 20_000, 20_000
#: A word can be swapped if the clean texts have it at least this often relative to the toxic ones, both in ``MIN_TEXTS`` or more.
LEAST_CLEAN, MIN_TEXTS, MIN_SLOTS = 0.1, 2, 2
PREFIXES = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def features(words: Iterable[str]) -> set[str]:
    """The distinct words, and their first letters (``4:``, ``5:``, ``6:``) where a word is longer."""
    found = set(words)
    for n in PREFIXES:
        found.update([f"{n}:{w[:n]}" for w in found if len(w) > n and w[1:2] != ":"])
    return found


@dataclass(frozen=True)
class ToxicityModel:
    bias: float
    weights: dict[str, float]
    swapped: int = 0  # training texts that were also seen with terms swapped
    terms: int = 0  # terms that were swapped
    by_length: dict[int, dict[str, float]] = field(init=False)

    def __post_init__(self) -> None:
        split = {n: {k[2:]: w for k, w in self.weights.items() if k[:2] == f"{n}:"} for n in PREFIXES}
        split[0] = {k: w for k, w in self.weights.items() if ":" not in k}
        object.__setattr__(self, "by_length", split)

    def logit(self, text: str | None) -> float:
        words = set(words_of(text))
        found = [self.bias, *map(self.by_length[0].get, words & self.by_length[0].keys())]
        for n in PREFIXES:
            if (known := self.by_length[n]) and (hit := known.keys() & {w[:n] for w in words if len(w) > n}):
                found += map(known.get, hit)
        return math.fsum(found)  # the same in any order

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -40, 40))))


def partners(terms: Iterable[tuple[str, ...]] = IDENTITY_TERMS, found: Mapping[str, str] | None = None) -> dict[str, str]:
    """The word that each term is swapped for: the next of its category; terms found in texts come after those."""
    known = {a: b for group in terms for a, b in zip(group, (*group[1:], group[0]), strict=True)}
    return {**(found or {}), **known}


def z_score(n1: float, n0: float, all_1: int, all_0: int) -> float:
    """How much more often the toxic class has a feature, in standard errors."""
    p = (n1 + n0 + 1) / (all_1 + all_0 + 2)
    return (n1 / all_1 - n0 / all_0) / np.sqrt(p * (1 - p) * (1 / all_1 + 1 / all_0))


Sparse = tuple[np.ndarray, np.ndarray, int]  # (row, column) of the features that are there, number of rows


def sparse(rows: Iterable[Iterable[int]]) -> Sparse:
    at, cols, n = [], [], 0
    for hit in rows:
        hit = sorted(hit)
        at += [n] * len(hit)
        cols += hit
        n += 1
    return np.array(at, np.int64), np.array(cols, np.int64), n


def minimise(texts: Sparse, y: np.ndarray, before: Sparse, after: Sparse, size: int, *, share: float, counterfactual: float = 4.0, l2: float = 3e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """(weights, bias): log loss with toxic texts weighing ``share`` in all + ``counterfactual`` times the mean squared change
    of the score from ``before`` to ``after`` a swap of terms + ``l2`` |w|^2."""
    (at, cols, n), (a_at, a_cols, m), (b_at, b_cols, _) = texts, before, after
    weight = np.where(y > 0, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum()))
    w, b = np.zeros(size), float(np.log(share / (1 - share)))
    square_w, square_b = np.full(size, 1e-8), 1e-8
    sigma = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    logits = lambda at, cols, n: np.bincount(at, w[cols], n) + b if len(at) else np.full(n, b)
    for _ in range(steps):
        error = (sigma(logits(at, cols, n)) - y) * weight
        grad, grad_b = np.bincount(cols, error[at], size) + 2 * l2 * w if size else w, error.sum()
        if m:
            p, q = sigma(logits(a_at, a_cols, m)), sigma(logits(b_at, b_cols, m))
            pull = 2 * counterfactual * (p - q) / m
            dp, dq = pull * p * (1 - p), -pull * q * (1 - q)
            grad = grad + (np.bincount(a_cols, dp[a_at], size) if len(a_at) else 0) + (np.bincount(b_cols, dq[b_at], size) if len(b_at) else 0)
            grad_b += (dp + dq).sum()
        square_w += grad**2
        square_b += grad_b**2
        w = np.maximum(w - 0.3 * grad / np.sqrt(square_w), 0)  # a feature of the toxic class can't speak against it
        b -= 0.3 * grad_b / np.sqrt(square_b)
    return w, float(b)


def solved(rows: list[tuple[int, Iterable[int], Iterable[int] | None]], chosen: list[str], share: float | None, partner: Mapping[str, str], **options: float) -> ToxicityModel:
    """The model of (label, features, features after the swap or None) rows; without both classes it knows no feature."""
    y = np.array([r[0] for r in rows], np.float64)
    if not y.any() or y.all():
        return ToxicityModel(4.0 if len(y) and y.all() else -4.0, {})
    pairs = [r for r in rows if r[2] is not None]
    share = min(0.5, float(y.mean()) if share is None else share)
    w, b = minimise(sparse(r[1] for r in rows), y, sparse(r[1] for r in pairs), sparse(r[2] for r in pairs), len(chosen), share=share, **options)
    return ToxicityModel(b, {k: float(x) for k, x in zip(chosen, w, strict=True) if x > 1e-3}, len(pairs), len(partner))


def hits(words: list[str], column: Mapping[str, int], partner: Mapping[str, str]) -> tuple[list[int], list[int] | None]:
    """Columns of a text's features, and of the features after each term is swapped for its partner; None if there is no term."""
    known = column.keys()
    own = [column[k] for k in features(words) & known]
    distinct = set(words)
    if distinct.isdisjoint(partner):
        return own, None
    return own, [column[k] for k in features({partner.get(w, w) for w in distinct}) & known]


def fit(texts: list[str], labels: list[int], *, share: float | None = None, min_df: int = 2, min_z: float = 4.0, partner: Mapping[str, str] | None = None, **options: float) -> ToxicityModel:
    """Of texts in memory: logistic regression over features that the toxic class has significantly more often (see ``minimise``).

    Toxic texts weigh ``share`` in all, by default their share of ``texts``; of a stratified sample, that of what it was drawn from, but half at most.
    """
    partner = partners() if partner is None else partner
    all_1, all_0 = sum(labels), len(labels) - sum(labels)
    seen = {1: Counter(), 0: Counter()}
    for text, label in zip(texts, labels, strict=True):
        seen[label].update(features(words_of(text)))
    chosen = sorted(k for k, n in seen[1].items() if n >= min_df and all_0 and z_score(n, seen[0][k], all_1, all_0) >= min_z)
    column = {k: i for i, k in enumerate(chosen)}
    return solved([(y, *hits(words_of(t), column, partner)) for t, y in zip(texts, labels, strict=True)], chosen, share, partner, **options)


def held_out(key: str | F.Column = "doc_id") -> F.Column:
    """Whether crc32 of the key as text leaves 2 on division by 4 (a null key: no)."""
    column = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, target: str, *, per_class: int, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, float | None]:
    """(_order, _text, _label) of the texts of at most ``per_class`` labelled keys of each class that aren't held out, by the order of
    a hash of the key, written; and the share of label 1. A key with both labels has none; repeated rows count once."""
    known = labels.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{target}`").alias("_label")).where(F.col("_key").isNotNull() & F.col("_label").isin(0, 1))
    known = known.where(~held_out("_key")).groupBy("_key").agg(F.min("_label").alias("_label"), F.max("_label").alias("_most")).where("_label = _most")
    known = known.select("_key", "_label", F.xxhash64(F.col("_key").cast("string"), F.lit(17)).alias("_hash"))
    share = known.agg(F.avg(F.col("_label").cast("double"))).first()[0]
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("_label") == label)
        edge = least_hashes(part, "_hash", per_class)
        part = part.where(F.col("_hash") <= F.lit(edge)).drop("_hash") if edge is not None else part.limit(0).drop("_hash")
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = F.broadcast(chosen)  # at most 2 * per_class keys
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text")).join(chosen, "_key")
    rows = rows.select(F.xxhash64("_key", "_text").alias("_order"), "_text", F.col("_label").cast("int").alias("_label")).dropDuplicates(["_order"])
    return written(rows, "labelled"), share


def found_terms(rows: DataFrame, counts: DataFrame, all_1: int, all_0: int) -> dict[str, str]:
    """Terms of the labelled texts that are swapped for each other: words that stand in the same slots in both classes.

    A slot is the word before and the word after. Words can be swapped that both classes have, the clean one
    not much more seldom (``LEAST_CLEAN``): what only toxic texts say is what the classifier is to learn. Within a slot that both classes
    have, each word is paired with the slot's most frequent one; a word's partner is the one it shares most slots with, ``MIN_SLOTS`` at least.
    """
    often = (F.col("n1") >= MIN_TEXTS) & (F.col("n0") >= MIN_TEXTS) & (F.col("n0") / all_0 >= LEAST_CLEAN * F.col("n1") / all_1)
    able = counts.where(often & ~F.col("feature").contains(":")).orderBy(F.desc(F.col("n1") + F.col("n0")), "feature").limit(MAX_TERMS)
    held = rows.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in able.select("feature").collect()))

    def slotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        able = held.value
        for batch in batches:
            seen: Counter = Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = ["", *words_of(text), ""]
                seen.update({(f"{a} {b}", w, label) for a, w, b in zip(words, words[1:], words[2:], strict=False) if w in able})
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] * k[2] for k in keys], pa.int64()), pa.array([seen[k] * (1 - k[2]) for k in keys], pa.int64())], names=["slot", "word", "n1", "n0"])

    slots = rows.select("_text", "_label").mapInArrow(slotted, "slot string, word string, n1 long, n0 long")
    slots = written(slots.groupBy("slot", "word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")), "slots")
    heads = slots.groupBy("slot").agg(F.max(F.struct(F.col("n1") + F.col("n0"), "word")).alias("_h"), F.sum("n1").alias("_1"), F.sum("n0").alias("_0"))
    pairs = slots.join(heads.where("_1 > 0 AND _0 > 0").select("slot", F.col("_h.word").alias("head")), "slot").where("word <> head")
    pairs = pairs.groupBy("word", "head").agg(F.count("*").alias("m")).where(F.col("m") >= MIN_SLOTS)
    both = pairs.unionByName(pairs.select(F.col("head").alias("word"), F.col("word").alias("head"), "m"))
    best = both.groupBy("word").agg(F.max(F.struct("m", "head")).alias("_b")).select("word", "_b.head")  # at most MAX_TERMS
    return {r["word"]: r["head"] for r in best.collect()}


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = MAX_PER_CLASS, key: str = "doc_id", text: str = "text", min_df: int = 2, min_z: float = 4.0, terms: Iterable[tuple[str, ...]] = IDENTITY_TERMS, counterfactual: float = 4.0) -> ToxicityModel:
    """The model of the labelled documents that aren't held out. Texts stay with the executors; the driver gets counts of features and which text has which."""
    ready(docs.sparkSession)
    rows, share = training_sample(docs, labels, "toxic", per_class=per_class, key=key, text=text)
    all_1, all_0 = rows.agg(F.coalesce(F.sum("_label"), F.lit(0)), F.coalesce(F.sum(1 - F.col("_label")), F.lit(0))).first()
    if not all_1 or not all_0:
        return solved([(y, (), None) for y, n in ((1, all_1), (0, all_0)) if n], [], share, {})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for x, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[label].update(features(words_of(x)))
            keys = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([s[k] for k in keys], pa.int64()) for s in (seen[1], seen[0]))], names=["feature", "n1", "n0"])

    counts = rows.select("_text", "_label").mapInArrow(counted, "feature string, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    counts = written(counts, "features")
    p = (F.col("n1") + F.col("n0") + 1) / F.lit(float(all_1 + all_0 + 2))
    z = (F.col("n1") / float(all_1) - F.col("n0") / float(all_0)) / F.sqrt(p * (1 - p) * F.lit(1 / all_1 + 1 / all_0))  # as z_score
    chosen = counts.where(F.col("n1") >= min_df).select("feature", z.alias("z")).where(F.col("z") >= min_z).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES)
    chosen = sorted(r[0] for r in chosen.collect())
    partner = partners(terms, found_terms(rows, counts, all_1, all_0))
    held = docs.sparkSession.sparkContext.broadcast(({k: i for i, k in enumerate(chosen)}, partner))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, partner = held.value
        for batch in batches:
            found = [hits(words_of(x), column, partner) for x in batch.column(1).to_pylist()]
            lists = [pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lists], names=["_order", "_label", "own", "after"])

    got = rows.select("_order", "_text", "_label").mapInArrow(told, "_order long, _label int, own array<int>, after array<int>").collect()
    got.sort(key=lambda r: r["_order"])
    return solved([(r["_label"], r["own"], r["after"]) for r in got], chosen, share, partner, counterfactual=counterfactual)


def score_documents(docs: DataFrame, model: ToxicityModel, *, text: str = "text", score: str = "score") -> DataFrame:
    """All columns of ``docs`` and the double ``score`` (replacing one of that name); empty and null texts get the model's bias."""
    ready(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = held.value
        for texts in batches:
            yield pd.Series([model.score(x) for x in texts], dtype="float64")

    return docs.withColumn(score, scored(F.col(f"`{text}`").cast("string")))


def judge_toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, per_class: int = MAX_PER_CLASS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: key, held_out, score, predicted (score >= ``threshold``).

    Trained on at most ``per_class`` labelled keys of each class that aren't held out; the score
    depends on the text alone. Null and empty texts get the bias of the model; a null key isn't held
    out and has no label; without labels of both classes every score is the same. Repeated rows are
    scored alike, an empty table gives none, other columns are ignored.
    """
    model = train(docs, labels, per_class=per_class, key=key, text=text)
    found = score_documents(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("_text")), model, text="_text")
    return found.select(F.col(f"`{key}`"), held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
