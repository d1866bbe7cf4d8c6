"""Mixing sources to target weights: token weights are raked to source, language and topic marginals, then documents sampled."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.cluster import discard, ready, table, written
from gradeloom.llm.wordhash import hashes_of_texts, mixed

MARGINS = ("source", "lang", "topic")
#: Topics, classes that words are hashed to, and rounds of the clusters' fit.
TOPICS, CLASSES, ROUNDS = 8, 1024, 12
#: Texts, and share of all texts, from which on a language has a mean of its own: so there are 10,000 means at most.
LEAST_TEXTS, LANG_SHARE = 5, 1e-4
#: What is 1 in whole numbers; the length below which a text less its mean isn't drawn out to length 1.
UNIT, LEAST_LENGTH = float(1 << 20), 1 / 64
#: Texts compared at a time, as rows of ``CLASSES`` numbers each; sums up to this many are added in a task before they are passed on.
BLOCK, MAX_HELD_SUMS = 256, 1 << 18
#: Cells up to this many are raked at the driver, more of them as DataFrames.
MAX_DRIVER_CELLS = 500_000
MAX_BROADCAST_CELLS = 500_000
TEMPERATURE = 0.7
#: Share of the tokens that the sample is expected to hold.
FRACTION = 0.5


def hashed_words(text: bytes | None) -> tuple[int, np.ndarray, np.ndarray]:
    """(words, classes of distinct words, how much each weighs): a word's class is its hash modulo ``CLASSES``, its weight 1 + ln of its count; of length 1 in all."""
    n, at, times = counted_words(text)
    weight = 1 + np.log(times)
    return n, at, weight / np.sqrt((weight**2).sum()) if n else weight


def counted_words(text: bytes | None) -> tuple[int, np.ndarray, np.ndarray]:
    """(words, classes of distinct words, how often each occurs)."""
    n, _, at, times = counted_texts([text or b""])
    return int(n[0]), at, times


def counted_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, how many classes each has; one text after the other, the classes of the distinct words and how often each occurs)."""
    words, n = hashes_of_texts(texts, fold=True)
    at = np.repeat(np.arange(len(texts)) * CLASSES, n) + (mixed(words) % np.uint64(CLASSES)).astype(np.int64)
    times = np.bincount(at, minlength=len(texts) * CLASSES)
    at = np.flatnonzero(times)
    return n, np.bincount(at // CLASSES, minlength=len(texts)), at % CLASSES, times[at]


@dataclass(frozen=True)
class TopicModel:
    """Clusters of hashed words. The mean of a text's language is taken off first, so that topics don't repeat the languages.

    Means and centres are whole numbers of 1 / ``UNIT``. So are texts when they are compared, and the sums of products
    are exact: they don't depend on the order of texts, on files or on partitions.
    """

    weight: np.ndarray  # of each class: rare ones tell more
    langs: dict[str | None, int]  # rows of means; the last row is the mean of all texts, for other languages
    means: np.ndarray
    centres: np.ndarray

    def own(self, langs: list[str | None]) -> np.ndarray:
        """The row of ``means`` for each language."""
        return np.array([self.langs.get(g, len(self.langs)) for g in langs], np.int64)

    def topic(self, at: np.ndarray, value: np.ndarray, offset: np.ndarray) -> int:
        """The nearest centre, with the ``offset`` of the text's language; 0 for a text without words."""
        if not len(at):
            return 0
        return int((self.centres[:, at] @ _scaled(at, value, np.zeros(1, np.int64), self.weight) - offset).argmax())

    def offset(self, lang: str | None) -> np.ndarray:
        """What the mean of the language adds to each centre's product."""
        return self.centres @ self.means[self.langs.get(lang, len(self.langs))]


def _scaled(at: np.ndarray, value: np.ndarray, starts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Texts as vectors of length 1, in whole numbers of 1 / ``UNIT``; each text's entries begin at one of ``starts``."""
    x = value * weight[at]
    length = np.maximum(1e-12, np.sqrt(np.add.reduceat(x * x, starts)))
    return np.rint(x / np.repeat(length, np.diff(starts, append=len(at))) * UNIT)


@dataclass(frozen=True)
class _Block:
    """Some texts, each with words: their languages, hashes that order them, and entries (class, value) from ``starts`` on."""

    langs: list
    order: np.ndarray
    starts: np.ndarray
    at: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(langs: list, order: np.ndarray, classes: list[bytes], times: list[bytes]) -> _Block:
        ends = np.cumsum([len(x) // 2 for x in classes])
        return _Block(langs, order, np.concatenate([[0], ends[:-1]]), np.frombuffer(b"".join(classes), "<u2").astype(np.int64), 1 + np.log(np.frombuffer(b"".join(times), "<u4")))

    def rows(self) -> np.ndarray:
        return _rows(self.starts, len(self.at))


@dataclass(frozen=True)
class _Measured:
    """The texts of a block once the means are known: the rows of their means, their entries in whole numbers, their lengths less their mean."""

    own: np.ndarray
    order: np.ndarray
    starts: np.ndarray
    at: np.ndarray
    x: np.ndarray
    length: np.ndarray

    def dense(self) -> np.ndarray:
        """The entries as one row of ``CLASSES`` for each text."""
        out = np.zeros((len(self.own), CLASSES))
        out.ravel()[_rows(self.starts, len(self.at)) * CLASSES + self.at] = self.x
        return out


def _rows(starts: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(np.arange(len(starts)), np.diff(starts, append=n))


def _measured(model: TopicModel) -> Callable[[_Block | _Measured], _Measured]:
    """For blocks what the model's means say of them; a block that is measured already stays."""
    squares = (model.means**2).sum(1)

    def measured(block: _Block | _Measured) -> _Measured:
        if isinstance(block, _Measured):
            return block
        own, x = model.own(block.langs), _scaled(block.at, block.value, block.starts, model.weight)
        square = np.add.reduceat(x * (x - 2 * model.means[own[block.rows()], block.at]), block.starts) + squares[own]
        return _Measured(own, block.order, block.starts, block.at, x, np.sqrt(np.maximum(square, 0.0)) / UNIT)

    return measured


class _Near:
    """Compares blocks with the means and centres of one model. Products are sums of whole numbers below 2 to the power 53, exact in any order."""

    def __init__(self, model: TopicModel) -> None:
        self.model, self.offsets, self.measured = model, model.centres @ model.means.T, _measured(model)

    def __call__(self, block: _Block | _Measured) -> tuple[_Measured, np.ndarray, np.ndarray]:
        """(measured block, its dense rows, products with the centres): the products of the texts less their mean."""
        found = self.measured(block)
        dense = found.dense()
        return found, dense, self.model.centres @ dense.T - self.offsets[:, found.own]

    def topics(self, block: _Block) -> np.ndarray:
        m, own = self.model, self.model.own(block.langs)
        x = _scaled(block.at, block.value, block.starts, m.weight)
        dense = _Measured(own, block.order, block.starts, block.at, x, x).dense()
        return (m.centres @ dense.T - self.offsets[:, own]).argmax(0)


# Steps of the fit. Each takes a model and gives a function of blocks: of keys and whole numbers to be added, or of the least candidate.


def _texts_with_class(model: TopicModel):
    return lambda block: (np.arange(CLASSES), np.bincount(block.at, minlength=CLASSES))


def _sums_of_languages(model: TopicModel):
    def sums(block: _Block) -> tuple[np.ndarray, np.ndarray]:
        x = _scaled(block.at, block.value, block.starts, model.weight)
        key, place = np.unique(model.own(block.langs)[block.rows()] * CLASSES + block.at, return_inverse=True)
        return key, np.bincount(place, x).astype(np.int64)

    return sums


def _sums_of_topics(model: TopicModel):
    """For each topic the sum of its texts over their lengths, before the means are taken off; then how much of each mean that is."""
    near, topics, means = _Near(model), len(model.centres), len(model.means)
    keys = np.arange(topics * (CLASSES + means))

    def sums(block: _Block | _Measured) -> tuple[np.ndarray, np.ndarray]:
        found, dense, product = near(block)
        topic, factor = product.argmax(0), np.rint(65536 / np.maximum(found.length, LEAST_LENGTH))
        share = np.zeros_like(product)
        share[topic, np.arange(len(topic))] = factor
        taken = np.bincount(topic * means + found.own, factor, topics * means)
        return keys, np.concatenate([(share @ dense).ravel(), taken]).astype(np.int64)

    return sums


def _farthest(model: TopicModel):
    """The text whose nearest centre is farthest; of equal ones the first by hash. Texts that are their language's mean don't count."""
    near = _Near(model)

    def least(block: _Block | _Measured) -> tuple | None:
        found, _, product = near(block)
        score = (product / UNIT**2 / np.maximum(found.length, LEAST_LENGTH)).max(0) if len(product) else np.full(len(found.own), -1.0)
        score[found.length == 0] = np.inf
        k = np.lexsort((found.order, score))[0]
        if score[k] == np.inf:
            return None
        part = slice(found.starts[k], found.starts[k + 1] if k + 1 < len(found.starts) else None)
        return float(score[k]), int(found.order[k]), found.at[part].astype("<u2").tobytes(), found.x[part].astype("<i4").tobytes(), int(found.own[k])

    return least


class _HeldTexts:
    """Texts in memory, in the order given."""

    def __init__(self, texts: list[tuple[str | None, np.ndarray, np.ndarray]]) -> None:
        self.blocks = []
        for k in range(0, len(texts), BLOCK):
            some = texts[k : k + BLOCK]
            starts = np.cumsum([0] + [len(at) for _, at, _ in some[:-1]])
            self.blocks.append(_Block([g for g, *_ in some], np.arange(k, k + len(some)), starts, np.concatenate([at for _, at, _ in some]), np.concatenate([value for *_, value in some])))

    def languages(self, share: float) -> tuple[int, dict[str | None, int]]:
        found = Counter(g for block in self.blocks for g in block.langs)
        return found.total(), {g: n for g, n in found.items() if n >= max(LEAST_TEXTS, found.total() * share)}

    def measure(self, model: TopicModel) -> None:
        self.blocks = list(map(_measured(model), self.blocks))

    def added(self, step: Callable, model: TopicModel, size: int) -> np.ndarray:
        total, made = np.zeros(size), step(model)
        for block in self.blocks:
            key, value = made(block)
            total[key] += value
        return total

    def least(self, step: Callable, model: TopicModel) -> tuple | None:
        return min((x for x in map(step(model), self.blocks) if x is not None), default=None)


def _numbers(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """(where each value starts, all of the numbers) of binary values, without a copy."""
    ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    found = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(dtype)
    return (ends[:-1] - ends[0]) // found.itemsize, found


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block | _Measured]:
    """Blocks of lang, order, classes and times, or of what was measured."""
    for batch in batches:
        for k in range(0, len(batch), BLOCK):
            some = batch.slice(k, BLOCK)
            starts, at = _numbers(some.column(2), "<u2")
            if batch.num_columns == 4:
                yield _Block(some.column(0).to_pylist(), some.column(1).to_numpy(), starts, at.astype(np.int64), 1 + np.log(_numbers(some.column(3), "<u4")[1]))
            else:
                yield _Measured(some.column(0).to_numpy(), some.column(1).to_numpy(), starts, at.astype(np.int64), _numbers(some.column(3), "<i4")[1].astype(np.float64), some.column(4).to_numpy())


class _WrittenTexts:
    """Texts of a DataFrame of lang, order, classes and times: every step reads all of them where they are."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows, self.context, self.made = rows, rows.sparkSession.sparkContext, []

    def measure(self, model: TopicModel) -> None:
        """From now on the steps read texts that are measured already."""
        held = self.context.broadcast(model)

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for m in map(_measured(held.value), _read(batches)):
                parts = [x.tobytes() for x in (m.at.astype("<u2"), m.x.astype("<i4"))]
                ends = np.append(m.starts, len(m.at))
                lists = [pa.Array.from_buffers(pa.binary(), len(m.own), [None, pa.py_buffer((ends * n).astype(np.int32)), pa.py_buffer(x)]) for n, x in zip((2, 4), parts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(m.own), pa.array(m.order), *lists, pa.array(m.length)], names=["own", "order", "classes", "entries", "length"])

        self.rows = written(self.rows.mapInArrow(found, "own long, order long, classes binary, entries binary, length double"), "measured")
        self.made.append(self.rows)
        held.destroy()

    def languages(self, share: float) -> tuple[int, dict[str | None, int]]:
        found = self.rows.groupBy("lang").agg(F.count("*").alias("n"))
        total = found.agg(F.sum("n")).first()[0] or 0
        return total, dict(map(tuple, found.where(F.col("n") >= max(LEAST_TEXTS, total * share)).collect()))

    def added(self, step: Callable, model: TopicModel, size: int) -> np.ndarray:
        held = self.context.broadcast(model)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made, total = step(held.value), np.zeros(size if size <= MAX_HELD_SUMS else 0, np.int64)
            for block in _read(batches):
                key, value = made(block)
                if not len(total):
                    yield _parts(key, value)
                    continue
                total[key] += value
                if np.abs(total).max() > 1 << 61:  # a block adds less than 2 to the power 53
                    yield _parts(np.arange(size), total)
                    total[:] = 0
            yield _parts(np.arange(len(total)), total)

        found = self.rows.mapInArrow(sums, "key long, high long, low long").groupBy("key").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).toArrow()
        held.destroy()
        total = np.zeros(size)
        total[found.column("key").to_numpy()] = found.column("high").to_numpy() * 2.0**32 + found.column("low").to_numpy()
        return total

    def least(self, step: Callable, model: TopicModel) -> tuple | None:
        held = self.context.broadcast(model)
        names = ("score", "order", "classes", "entries", "own")

        def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = min((x for x in map(step(held.value), _read(batches)) if x is not None), default=None)
            if best is not None:
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in best], names=names)

        found = self.rows.mapInArrow(least, "score double, order long, classes binary, entries binary, own long").agg(F.min(F.struct(*names))).first()[0]
        held.destroy()
        return None if found is None else (*found[:2], bytes(found[2]), bytes(found[3]), found[4])


def _parts(key: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    """Sums other than 0, each in two parts that can be added further without overflow."""
    some = value != 0
    return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (key, value >> 32, value & 0xFFFFFFFF)], names=["key", "high", "low"])


def _fit(texts: _HeldTexts | _WrittenTexts, topics: int, rounds: int) -> TopicModel:
    """Spherical k-means over all of the texts, without the mean of their language; starts from the text farthest from those taken.

    A language has a mean of its own if it has ``LEAST_TEXTS`` texts and ``LANG_SHARE`` of all texts. The rounds end once no centre changes.
    """
    total, counts = texts.languages(LANG_SHARE)
    langs = {g: k for k, g in enumerate(sorted(counts, key=lambda g: (g is None, g or "")))}
    model = TopicModel(np.zeros(CLASSES), langs, np.zeros((len(langs) + 1, CLASSES)), np.zeros((0, CLASSES)))
    if total:
        model = replace(model, weight=np.log((1 + total) / (1 + texts.added(_texts_with_class, model, CLASSES))))
        means = texts.added(_sums_of_languages, model, model.means.size).reshape(model.means.shape)
        means[-1] = means.sum(0)
        model = replace(model, means=np.rint(means / np.array([*(counts[g] for g in langs), total])[:, None]))
        texts.measure(model)
    while len(model.centres) < topics and total and (taken := texts.least(_farthest, model)):
        centre = -model.means[taken[4]]
        centre[np.frombuffer(taken[2], "<u2")] += np.frombuffer(taken[3], "<i4")
        model = replace(model, centres=np.vstack([model.centres, _unit(centre)]))
    found = len(model.centres)
    model = replace(model, centres=np.vstack([model.centres, np.zeros((topics - found, CLASSES))]))
    for _ in range(rounds if found else 0):
        sums = texts.added(_sums_of_topics, model, topics * (CLASSES + len(model.means)))
        whole, taken = sums[: topics * CLASSES].reshape(topics, CLASSES), sums[topics * CLASSES :].reshape(topics, -1)
        moved = whole - taken @ model.means
        centres = np.array([_unit(x) if t.any() and x.any() else was for x, t, was in zip(moved, taken, model.centres, strict=True)])
        if (centres == model.centres).all():
            break
        model = replace(model, centres=centres)
    return model


def _unit(x: np.ndarray) -> np.ndarray:
    return np.rint(x / max(1e-12, np.linalg.norm(x)) * UNIT)


def fit_topics(sample: list[tuple[str | None, np.ndarray, np.ndarray]], topics: int = TOPICS, rounds: int = ROUNDS) -> TopicModel:
    """Topics of texts in memory, as (language, classes, values) of ``hashed_words``; the fit is that of ``learn_topics``."""
    return _fit(_HeldTexts([x for x in sample if len(x[1])]), topics, rounds)


def learn_topics(words: DataFrame, *, lang: str = "lang", order: str = "_order", counts: str = "_words", topics: int = TOPICS, rounds: int = ROUNDS) -> TopicModel:
    """Topics of all texts with words, of their ``word_counts``. Every step of the fit reads all of them; only sums and one text for each start come to the driver.

    ``order`` says which of equally far texts is a start; a hash of key and text does, as texts equal in both are the same start.
    """
    ready(words.sparkSession)
    rows = words.where(F.col(f"{counts}.n_tokens") > 0)
    texts = _WrittenTexts(rows.select(F.col(lang).alias("lang"), F.col(order).alias("order"), F.col(f"{counts}.classes"), F.col(f"{counts}.times")))
    model = _fit(texts, topics, rounds)
    discard(*texts.made)
    return model


def word_counts(text: Column) -> Column:
    """The struct of n_tokens, the classes of the distinct words and how often each occurs, as bytes of 16 and 32 bits each."""

    @F.pandas_udf("n_tokens long, classes binary, times binary")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            counts, classes, times = [np.empty(0, np.int64)], [], []
            for k in range(0, len(texts), BLOCK):
                n, sizes, at, often = counted_texts([x.encode() if isinstance(x, str) else b"" for x in texts.iloc[k : k + BLOCK]])
                ends = np.cumsum(sizes).tolist()
                for kept, part in ((classes, at.astype("<u2").tobytes()), (times, often.astype("<u4").tobytes())):
                    width = len(part) // max(1, len(at))
                    kept += [part[a * width : b * width] for a, b in zip([0, *ends], ends, strict=False)]
                counts.append(n)
            yield pd.DataFrame({"n_tokens": np.concatenate(counts), "classes": classes, "times": times})

    return found(text)


def topic_of(session: SparkSession, model: TopicModel, lang: Column, classes: Column, times: Column) -> Column:
    """The nearest topic of each text, from its ``word_counts``; 0 without words."""
    held = session.sparkContext.broadcast(model)

    @F.pandas_udf("int")
    def found(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        near = _Near(held.value)
        for langs, classes, times in batches:
            topic = np.zeros(len(langs), np.int32)
            some = np.flatnonzero(classes.str.len().to_numpy())
            for k in range(0, len(some), BLOCK):
                at = some[k : k + BLOCK]
                topic[at] = near.topics(_Block.of([g if isinstance(g, str) else None for g in langs.iloc[at]], at, list(classes.iloc[at]), list(times.iloc[at])))
            yield pd.Series(topic)

    return found(lang, classes, times)


def tempered(totals: Mapping, temperature: float) -> dict:
    """Target shares proportional to the shares to the power ``temperature``: 1 keeps them, 0 makes them equal."""
    raised = {k: float(n) ** temperature for k, n in totals.items() if n > 0}
    whole = sum(raised.values())
    return {k: x / whole for k, x in raised.items()}


def rake(cells: list[tuple], tokens: np.ndarray, targets: list[dict], fraction: float, *, rounds: int = 500, close: float = 1e-12) -> np.ndarray:
    """Iterative proportional fitting: each cell's probability, so that tokens * probability is ``fraction`` of all tokens and
    has the target shares of every margin, as far as probabilities of at most 1 can.

    A category without target gets none; the target of one without tokens is spread over the others. It ends after
    ``rounds``, or once a round changes no probability by more than ``close``.
    """
    total = tokens.sum()
    if not total:
        return np.ones(len(tokens))
    places, wanted = [], []
    for m, target in enumerate(targets):
        names = {k: i for i, k in enumerate(dict.fromkeys(c[m] for c in cells))}
        place = np.array([names[c[m]] for c in cells])
        want = np.array([target.get(k, 0.0) for k in names]) * (np.bincount(place, tokens, len(names)) > 0)
        places.append(place)
        wanted.append(want / want.sum() * fraction if want.sum() else np.full(len(names), fraction / len(names)))
    share = tokens / total
    chance = np.where(tokens > 0, fraction, 0.0)
    for _ in range(rounds):
        was = chance
        for place, want in zip(places, wanted, strict=True):
            have = np.bincount(place, share * chance, len(want))
            chance = np.minimum(1.0, chance * np.divide(want, have, out=np.zeros_like(want), where=have > 0)[place])
        if np.abs(chance - was).max() <= close:
            break
    return chance


def _raked_large(cells: DataFrame, targets: Mapping[str, Mapping], temperature: float, fraction: float, *, rounds: int = 500, close: float = 1e-12) -> DataFrame:
    """The same fit as DataFrames, for more cells than the driver should hold: each margin a pre-aggregated sum.

    It ends where ``rake`` does: once a round changes no probability by more than ``close`` the
    margins are met, or can't all be met and further rounds would only repeat it.
    """
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    state = written(cells.withColumn("_p", F.when(F.col("tokens") > 0, fraction).otherwise(0.0)), "cells")
    want = {}
    for m in MARGINS:
        if m in targets:
            share = spark.createDataFrame(pd.DataFrame({m: list(targets[m]), "_t": list(targets[m].values())}), f"{m} {cells.schema[m].dataType.simpleString()}, _t double")
        else:
            share = state.groupBy(m).agg(F.sum("tokens").alias("_n")).where("_n > 0").select(m, F.pow(F.col("_n").cast("double"), F.lit(temperature)).alias("_t"))
        there = share.join(state.where("tokens > 0").select(F.col(m).alias("_m")).distinct(), F.col(m).eqNullSafe(F.col("_m")), "left_semi")
        whole = there.agg(F.sum("_t")).first()[0] or 1.0
        want[m] = written(there.select(F.col(m).alias("_m2"), (F.col("_t") / whole * fraction * total).alias("_t")), "targets")
    for _ in range(rounds):
        was, state = state, state.withColumn("_was", F.col("_p"))
        for m in MARGINS:  # one margin after the other, in one plan: a sum of each category and a join
            have = state.groupBy(F.col(m).alias("_m")).agg(F.sum(F.col("tokens") * F.col("_p")).alias("_h"))
            ratio = have.join(want[m], F.col("_m").eqNullSafe(F.col("_m2")), "left").select("_m", F.when(F.col("_h") > 0, F.coalesce("_t", F.lit(0.0)) / F.col("_h")).otherwise(0.0).alias("_r"))
            state = state.join(ratio, F.col(m).eqNullSafe(F.col("_m")), "left").select(*MARGINS, "tokens", "_was", F.least(F.lit(1.0), F.col("_p") * F.coalesce("_r", F.lit(0.0))).alias("_p"))
        state = written(state, "cells")
        discard(was)
        if (state.agg(F.max(F.abs(F.col("_p") - F.col("_was")))).first()[0] or 0.0) <= close:
            break
    return state.select(*MARGINS, F.col("_p").alias("probability"))


def mix(docs: DataFrame, *, targets: Mapping[str, Mapping] | None = None, temperature: float = TEMPERATURE, fraction: float = FRACTION, seed: int = 11, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", keep: tuple[str, ...] | None = None, rounds: int = 500, max_driver_cells: int = MAX_DRIVER_CELLS) -> DataFrame:
    """All columns of ``docs``, or those of ``keep``, and the struct ``_mix``: topic, n_tokens, weight, probability, sampled.

    The tokens of every (source, lang, topic) cell are counted over all documents and raked to the target
    shares of the three margins, by default the shares tempered by ``temperature``; the sample is expected
    to hold ``fraction`` of the tokens. ``probability`` is the cell's, at most 1; where a margin would need
    more than all tokens of some cells, their probability stays 1 and the others of the margin make up for
    it as far as they can. The fit ends after ``rounds`` at most. ``weight`` is the probability over ``fraction``: the factor by which a token's
    share grows. ``sampled`` compares the probability with a hash of key, text and ``seed``.

    ``topic``: the nearest of ``TOPICS`` clusters of hashed words, learnt from all texts less the mean of their
    language. Texts are read once for it and written with the counts of their words; the fit writes those once more, scaled, and reads them in each round.

    Null sources and languages are categories of their own. Null and empty texts have no tokens; a cell
    without tokens has probability 0, unless no document has any tokens: then all are sampled. Repeated rows are sampled alike; an empty table gives none; a column named _mix is replaced.
    """
    spark = docs.sparkSession
    stay = [c for c in (docs.columns if keep is None else keep) if c != "_mix"]
    draw = F.shiftrightunsigned(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"), F.lit(seed)), 11) / F.lit(float(1 << 53))
    order = F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"), F.lit(5))
    whole = F.struct(*(F.col(f"`{c}`") for c in stay)).alias("_row")  # no name of docs can clash
    ready(spark)
    mixed = docs.select(whole, draw.alias("_draw"), order.alias("_order"), F.col(f"`{source}`").cast("string").alias("_source"), F.col(f"`{lang}`").cast("string").alias("_lang"), word_counts(F.col(f"`{text}`").cast("string")).alias("_words"))
    mixed = written(mixed, "words")
    topic = topic_of(spark, learn_topics(mixed, lang="_lang"), F.col("_lang"), F.col("_words.classes"), F.col("_words.times"))
    mixed = mixed.select("_row", "_draw", "_source", "_lang", F.col("_words.n_tokens").alias("_n"), topic.alias("_topic"))
    cell = [F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic")]
    cells = mixed.select(*cell, "_n").groupBy(*MARGINS).agg(F.sum("_n").alias("tokens"))
    cells = written(cells, "cells")
    count = cells.count()
    if count <= max_driver_cells:
        found = cells.orderBy(*MARGINS).toPandas()
        names = [tuple(None if pd.isna(x) else x for x in row) for row in found[list(MARGINS)].itertuples(index=False)]
        tokens = found["tokens"].to_numpy(np.float64)
        if targets is None:
            targets = {}
        want = []
        for m, name in enumerate(MARGINS):
            totals: dict = {}
            for c, n in zip(names, tokens, strict=True):
                totals[c[m]] = totals.get(c[m], 0) + n
            want.append(dict(targets[name]) if name in targets else tempered(totals, temperature))
        weights = spark.createDataFrame(pa.table({
            "source": pa.array([c[0] for c in names], pa.string()), "lang": pa.array([c[1] for c in names], pa.string()),
            "topic": pa.array([c[2] for c in names], pa.int32()), "probability": pa.array(rake(names, tokens, want, fraction, rounds=rounds), pa.float64()),
        }))
    else:
        weights = written(_raked_large(cells, targets or {}, temperature, fraction, rounds=rounds), "weights")
    weights = weights.select(F.col("source").alias("_s"), F.col("lang").alias("_l"), F.col("topic").alias("_t"), F.col("probability").alias("_p"))
    if count <= MAX_BROADCAST_CELLS:
        weights = F.broadcast(weights)
    met = mixed.join(weights, F.col("_source").eqNullSafe(F.col("_s")) & F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_topic").eqNullSafe(F.col("_t")), "left")
    chance = F.coalesce("_p", F.lit(0.0))
    into = F.struct(F.col("_topic").alias("topic"), F.col("_n").alias("n_tokens"), (chance / fraction).alias("weight"), chance.alias("probability"), (F.col("_draw") < chance).alias("sampled"))
    return met.select(*(F.col(f"_row.`{c}`") for c in stay), into.alias("_mix"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), keep=("doc_id", "source", "lang")).select("doc_id", "source", "lang", "_mix.*")
