"""What the fit of the topics does with a text, and how often."""

import numpy as np
from gradeloom.llm import mixing, wordhash

TEXTS = [b"", b" \n", b"One one\x0btwo", b"  alpha ", bytes(range(256)), "é ü x y".encode(), b"w" * 90, b" ".join(b"w%d" % (k % 7) for k in range(50)), b""]


def test_texts_hashed_together_have_the_words_of_each(monkeypatch):
    for together in (0, 1, 16, 100, 1 << 18):
        monkeypatch.setattr(wordhash, "TOGETHER", together)
        for fold in (False, True):
            hashes, counts = wordhash.hashes_of_texts(TEXTS, fold)
            alone = [wordhash.word_hashes(x, fold) for x in TEXTS]
            assert counts.tolist() == [len(x) for x in alone] and (hashes == np.concatenate(alone)).all()
    assert [len(x) for x in wordhash.hashes_of_texts([])] == [0, 0]


def test_texts_counted_together_have_the_classes_of_each():
    n, sizes, at, times = mixing.counted_texts(TEXTS)
    for k, text in enumerate(TEXTS):
        words = wordhash.mixed(wordhash.word_hashes(text, fold=True)) % np.uint64(mixing.CLASSES)
        want = np.unique(words, return_counts=True)
        part = slice(sizes[:k].sum(), sizes[: k + 1].sum())
        assert n[k] == len(words) and np.array_equal(at[part], want[0]) and np.array_equal(times[part], want[1])


def test_spans_are_runs_without_white_space():
    data = np.frombuffer(bytes(range(256)) + b" a", np.uint8)
    starts, ends = wordhash.spans(data)
    assert [(int(a), int(b)) for a, b in zip(starts, ends, strict=True)] == [(0, 9), (14, 32), (33, 256), (257, 258)]


def test_a_fit_measures_each_text_twice(monkeypatch):
    """Once for the means, once for all of the rounds: not in every round."""
    rng = np.random.default_rng(3)
    sample = [("de", *mixing.hashed_words(" ".join(f"t{k % 9}_{j}" for j in rng.integers(0, 40, 12)).encode())[1:]) for k in range(700)]
    seen, scaled = [], mixing._scaled
    monkeypatch.setattr(mixing, "_scaled", lambda at, value, starts, weight: seen.append(len(starts)) or scaled(at, value, starts, weight))
    model = mixing.fit_topics(sample)
    assert sum(seen) == 2 * len(sample) and len(model.centres) == mixing.TOPICS and model.centres.any(axis=1).all()


def test_written_texts_are_those_in_memory(spark):
    """The texts that the rounds read, written in blocks of several batches, against those measured in memory."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    rows = [(k, " ".join(f"t{j}" for j in rng.integers(0, 60, k % 13)), ("de", "en", None)[k % 3]) for k in range(1500)]
    words = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("lang", F.col("doc_id").alias("_order"), mixing.word_counts(F.col("text")).alias("_words"))
    held = mixing._HeldTexts([(g, *mixing.hashed_words(t.encode())[1:]) for _, t, g in rows if t])
    model = mixing.fit_topics([(g, *mixing.hashed_words(t.encode())[1:]) for _, t, g in rows if t])
    texts = mixing._WrittenTexts(words.where("_words.n_tokens > 0").select("lang", "_order", "_words.classes", "_words.times"))
    texts.measure(model)
    held.measure(model)
    got = {r.order: r for r in texts.rows.collect()}
    keys = iter(k for k, t, _ in rows if t)
    for block in held.blocks:
        for k, (own, length) in enumerate(zip(block.own, block.length, strict=True)):
            r, part = got.pop(next(keys)), slice(block.starts[k], block.starts[k + 1] if k + 1 < len(block.starts) else None)
            assert (r.own, r.length) == (own, length)
            assert np.array_equal(np.frombuffer(r.classes, "<u2"), block.at[part]) and np.array_equal(np.frombuffer(r.entries, "<i4"), block.x[part])
    assert not got
