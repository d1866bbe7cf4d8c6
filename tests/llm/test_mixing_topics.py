"""Topics are learnt from all texts, however they are dealt out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import mixing


def texts(n):
    rng = np.random.default_rng(5)
    for k in range(n):
        lang = ("de", "en", None)[k % 3] if k > 3 else "rare"
        yield k, " ".join([f"{lang}{j}" for j in rng.integers(0, 40, 6)] + [f"topic{k % 11}_{j}" for j in rng.integers(0, 60, 8)] + [f"w{j}" for j in rng.integers(0, 900, 4)]), lang, f"s{k % 2}"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*texts(9000), (9000, None, "en", "s0"), (9001, " \n", "de", "s0")], "doc_id long, text string, lang string, source string")


def test_topics_are_those_of_all_texts(docs):
    rows = [r for r in docs.withColumn("o", F.xxhash64("doc_id", "text", F.lit(5))).orderBy("o").collect() if (r.text or "").split()]
    sample = [(r.lang, *mixing.hashed_words(r.text.encode())[1:]) for r in rows]
    model = mixing.fit_topics(sample)
    df = np.zeros(mixing.CLASSES)
    for _, at, _ in sample:
        df[at] += 1
    assert len(rows) == 9000 and np.allclose(model.weight, np.log(9001 / (1 + df)))
    want = {r.doc_id: model.topic(at, value, model.offset(g)) for r, (g, at, value) in zip(rows, sample, strict=True)} | {9000: 0, 9001: 0}
    assert len(set(want.values())) == mixing.TOPICS
    for dealt in (docs, docs.repartition(7, "source", "lang"), docs.coalesce(1)):
        assert {r.doc_id: r._mix.topic for r in mixing.mix(dealt).collect()} == want


def test_sums_that_are_not_held_are_the_same(docs, monkeypatch):
    words = docs.select("lang", F.xxhash64("doc_id", "text").alias("_order"), mixing.word_counts(F.col("text")).alias("_words")).where("doc_id < 700")
    model = mixing.learn_topics(words)
    monkeypatch.setattr(mixing, "MAX_HELD_SUMS", 0)
    again = mixing.learn_topics(words)
    assert all(np.array_equal(getattr(model, x), getattr(again, x)) for x in ("weight", "means", "centres")) and model.langs == again.langs == {"de": 0, "en": 1, None: 2}


def test_texts_that_are_all_the_same(spark):
    docs = spark.createDataFrame([(k, "one and the same text", "en", "s") for k in range(50)], "doc_id long, text string, lang string, source string")
    assert {r._mix.topic for r in mixing.mix(docs).collect()} == {0}


def test_each_step_adds_what_a_text_at_a_time_gives():
    """The sums of a block against plain floats, for each text less the mean of its language."""
    sample = [(g, *mixing.hashed_words(t.encode())[1:]) for _, t, g, _ in texts(300)]
    model = mixing.fit_topics(sample)
    held = mixing._HeldTexts(sample)
    sums = held.added(mixing._sums_of_topics, model, mixing.TOPICS * (mixing.CLASSES + len(model.means)))
    got = sums[: mixing.TOPICS * mixing.CLASSES].reshape(mixing.TOPICS, -1) - sums[mixing.TOPICS * mixing.CLASSES :].reshape(mixing.TOPICS, -1) @ model.means
    want = np.zeros_like(got)
    for g, at, value in sample:
        row = np.zeros(mixing.CLASSES)
        row[at] = value
        row *= model.weight
        row = row / np.linalg.norm(row) - model.means[model.langs.get(g, -1)] / mixing.UNIT
        want[(model.centres @ row).argmax()] += row / max(np.linalg.norm(row), mixing.LEAST_LENGTH)
    assert np.abs(got / mixing.UNIT / 65536 - want).max() < 1e-3


def test_the_pipeline_s_sample_follows_topics_of_all_texts(spark, docs):
    import corpus_pipeline

    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(11)), 11) / F.lit(float(1 << 53))
    rows = docs.select("*", draw.alias("draw"), F.xxhash64("doc_id", "text", F.lit(5)).alias("o")).where("doc_id < 9000").orderBy("o").collect()
    found = [mixing.hashed_words(r.text.encode()) for r in rows]
    model = mixing.fit_topics([(r.lang, at, value) for r, (_, at, value) in zip(rows, found, strict=True)])
    cell = [(r.source, r.lang, model.topic(at, value, model.offset(r.lang))) for r, (_, at, value) in zip(rows, found, strict=True)]
    tokens = {c: 0.0 for c in cell}
    for c, (n, *_) in zip(cell, found, strict=True):
        tokens[c] += n
    names = sorted(tokens, key=str)
    counts = np.array([tokens[c] for c in names])
    want = [mixing.tempered({v: sum(n for c, n in tokens.items() if c[k] == v) for v in {c[k] for c in names}}, mixing.TEMPERATURE) for k in range(3)]
    chance = dict(zip(names, mixing.rake(names, counts, want, mixing.FRACTION), strict=True))
    got = {r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, "").collect()}
    assert got == {r.doc_id for r, c in zip(rows, cell, strict=True) if r.draw < chance[c]} and 4000 < len(got) < 5000
