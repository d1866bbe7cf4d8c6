"""Very long texts, empty and clashing tables, ties, recall of the filters, and stages of the pipeline against brute force."""

import collections
import hashlib

import corpus_pipeline
import numpy as np
import pytest
from gradeloom.llm import bpe_chunks, mixing, near_dedup, pu_quality, quality_rules, toxicity, url_filter, wordhash
from test_llm_operators import brute_components, brute_counts, brute_lines, documents

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def long_text():
    rng = np.random.default_rng(12)
    return " ".join(f"word{k}" for k in rng.integers(0, 5000, 300_000)) + " END"  # beyond every piece that is read at a time


def test_very_long_texts_are_read_whole(spark, long_text):
    other = long_text[:-3] + "FIN"  # differs in the last word only
    docs = documents(spark, [(1, long_text, "en", "a"), (2, other, "en", "a"), (3, long_text, "en", "b")])
    counts = {r.doc_id: r for r in quality_rules.judge_quality(docs).collect()}
    assert tuple(counts[1])[1:6] == brute_counts(long_text)
    found = {r.doc_id: r for r in near_dedup.near_groups(docs).collect()}
    assert found[1].component_id == found[2].component_id == 1 and found[1].n_shingles == len({tuple(x) for x in zip(*(long_text.lower().split()[k:] for k in range(5)), strict=False)})
    import public_tokenizers
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(long_text, add_special_tokens=False).ids
    coded = {r.doc_id: r for r in bpe_chunks.encode_documents(docs, with_ids=False).collect()}
    assert coded[1].n_tokens == len(want) and coded[1].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest() != coded[2].ids_sha256
    assert coded[1].decoded_sha256 == hashlib.sha256(long_text.encode()).hexdigest()
    mixed = {r.doc_id: r._mix for r in mixing.mix(docs).collect()}
    assert mixed[1].n_tokens == 300_001 and mixed[1].topic == mixed[3].topic
    model = toxicity.ToxicityModel(-3.0, {"fin": 5.0})
    assert model.score(long_text) < 0.1 < 0.8 < model.score(other)
    a, b = pu_quality.hashed(long_text), pu_quality.hashed(other)
    assert len(a[0]) == len(b[0]) and (a[0] != b[0]).any()
    url = "http://a.example.com/en/" + "x" * 200_000
    assert [r.rule for r in url_filter.judge_urls(spark.createDataFrame([(1, url)], "page_id long, url string")).collect()] == ["com/en/"]


def test_no_linked_pair_is_given_up_by_the_marks(spark):
    rng = np.random.default_rng(13)
    rows, linked = [], 0
    for k in range(1500):
        n = int(rng.integers(6, 900))
        words = [f"w{j}" for j in rng.integers(0, 10**6, n)]
        other = list(words)
        for at in rng.integers(0, n, int(rng.integers(0, max(1, n // 40) + 1))):
            other[at] = f"x{k}_{at}"
        a, b = (wordhash.shingle_set(" ".join(w).encode()) for w in (words, other))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 80 * (len(a) + len(b) - common):
            linked += 1
            rows.append((100 * common >= 85 * (len(a) + len(b) - common), len(a), len(b), near_dedup.marks(a).tolist(), near_dedup.marks(b).tolist()))
    df = spark.createDataFrame(rows, "at85 boolean, n long, hub_n long, marks array<long>, hub_marks array<long>")
    assert linked > 800 and df.where(near_dedup.may_link(80)).count() == linked
    assert df.where("at85").where(near_dedup.may_link(85)).count() == df.where("at85").count()
    apart = spark.createDataFrame([(500, 500, near_dedup.marks(wordhash.shingle_set(" ".join(f"a{j}" for j in range(504)).encode())).tolist(), near_dedup.marks(wordhash.shingle_set(" ".join(f"b{j}" for j in range(504)).encode())).tolist())], "n long, hub_n long, marks array<long>, hub_marks array<long>")
    assert not apart.where(near_dedup.may_link(80)).count()


def test_rows_that_share_a_key_join_their_groups(spark):
    rng = np.random.default_rng(14)
    a, b = (" ".join(f"w{j}" for j in rng.integers(0, 10**6, 40)) for _ in range(2))
    docs = documents(spark, [(5, a), (5, b), (7, a), (9, b), (2, "quite another text that stands alone")])
    found = sorted((r.doc_id, r.component_id) for r in near_dedup.near_groups(docs).collect())
    assert found == [(2, 2), (5, 5), (5, 5), (7, 5), (9, 5)]


def brute_em(patterns, counts, prior, rounds):
    """The label model fitted document by document with plain loops."""
    rows = [p for p, n in zip(patterns, counts, strict=True) for _ in range(n)]
    votes, share = (-1, 0, 1), []
    for k in range(len(rows[0])):
        seen = [sum(r[k] == v for r in rows) + 2.0 for v in votes]
        share.append([x / sum(seen) for x in seen])
    table = [[[max(1e-6, x) for x in (a * (1 - s[1]), s[1], b * (1 - s[1]))] for a, b in ((0.9, 0.1), (0.1, 0.9))] for s in share]
    table = [[[x / sum(c) for x in c] for c in t] for t in table]
    good = []
    for _ in range(rounds):
        good = []
        for r in rows:
            p = [1 - prior, prior]
            for k, v in enumerate(r):
                p = [p[c] * table[k][c][v + 1] for c in (0, 1)]
            good.append(p[1] / sum(p) if any(r) else prior)
        new = []
        for k, s in enumerate(share):
            t = [[sum(w for w, r in zip(ws, rows, strict=True) if r[k] == v) + 2.0 * s[j] for j, v in enumerate(votes)] for ws in ([1 - g for g in good], good)]
            t = [[x / sum(c) for x in c] for c in t]
            for v, c in ((0, 0), (2, 1)):
                if t[c][v] < t[1 - c][v]:
                    t[0][v] = t[1][v] = (t[0][v] + t[1][v]) / 2
            new.append([[max(1e-6, x / sum(c)) for x in c] for c in t])
        prior, table = (sum(good) + 2.0 * prior_0) / (len(rows) + 2.0) if (prior_0 := 0.7) else prior, new
    return prior, table


def test_label_model_against_plain_em():
    patterns = np.array([[1, 0, 1], [1, 1, 0], [-1, 0, 0], [-1, -1, 0], [0, 0, 0], [0, 1, 1], [-1, 0, 1]])
    counts = np.array([30, 25, 8, 12, 5, 20, 3])
    model = quality_rules.fit_label_model(patterns, counts.astype(float), rounds=7)
    prior, table = brute_em([tuple(p) for p in patterns.tolist()], counts.tolist(), 0.7, 7)
    assert abs(model.prior - prior) < 1e-9 and np.abs(model.table - np.array(table)).max() < 1e-9
    post = model.posterior(patterns)
    for p, got in zip(patterns.tolist(), post, strict=True):
        good, bad = prior, 1 - prior
        for k, v in enumerate(p):
            good, bad = good * table[k][1][v + 1], bad * table[k][0][v + 1]
        assert abs(got - (good / (good + bad) if any(p) else prior)) < 1e-9


# -- stages of the pipeline ---------------------------------------------------------------------------


@pytest.fixture
def folder(spark, tmp_path):
    """A folder of tables with labels for toxic words."""
    rows = [(k, int(k % 3 == 0), 1) for k in range(400)] + [(3, 0, 1), (None, 1, 1)]
    spark.createDataFrame(rows, "doc_id long, toxic int, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(f"file://{tmp_path}/none/labels.parquet")
    return f"file://{tmp_path}"


def corpus(spark):
    rng = np.random.default_rng(15)
    say = lambda n: " ".join(f"w{j}" for j in rng.integers(0, 3000, n))
    rows = [(k, say(40) + (f" you scumbag liar{k % 2}" if k % 3 == 0 else ""), "en" if k % 2 else "de", f"s{k % 3}", 1) for k in range(400)]
    shared = "one line here\nand another line\nand a third line"
    rows += [(1000, shared + "\n" + say(30), "en", "s0", 1), (1001, shared + "\n" + say(30), "en", "s1", 1), (1002, rows[1][1], "de", "s2", 1), (1003, rows[1][1] + " more", "de", "s2", 1)]
    return [*rows, (2000, None, None, None, None), (2001, "", "en", "s0", 0), (2002, " \n\t", "en", "s0", 3), (None, "text without id", "en", "s0", 5), (1000, rows[400][1], "en", "s0", 1), (1001, "the same id with another text entirely", "fr", "s9", 7)]


def test_stages_against_brute_force(spark, folder):
    rows = corpus(spark)
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], COLUMNS + ", _mix int, n_tokens string")
    clean = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert clean.columns == docs.columns
    toxic = lambda t: "scumbag" in (t or "")
    assert collections.Counter((r.doc_id, r.text) for r in clean.collect()) == collections.Counter((r[0], r[1]) for r in rows if not toxic(r[1]))
    lines = corpus_pipeline.drop_repeated_lines(spark, clean, folder)
    unique = {(r.doc_id, r.text) for r in clean.collect()}
    keyed = {k: t for k, t in unique if k is not None and k not in (1001,)}
    want = brute_lines([*keyed.items(), (1001, rows[401][1])])
    got = {(r.doc_id, r.text, r.n_chars) for r in lines.collect() if r.doc_id in keyed or (r.doc_id == 1001 and "same id" not in (r.text or ""))}
    assert got == {(k, t, None if t is None else len(t)) for k, t in want.items()} and lines.columns == docs.columns
    near = corpus_pipeline.drop_near_duplicates(spark, lines, folder)
    kept = collections.Counter((r.doc_id, r.text) for r in near.collect())
    once = {r.doc_id: r.text for r in lines.collect() if r.doc_id is not None and r.doc_id != 1001}
    groups = brute_components(list(once.items()), 80)
    assert {k for k, _ in kept if k is not None and k != 1001} == {k for k, (_, c) in groups.items() if k == c}
    assert kept[None, "text without id"] == 1 and sum(n for (k, _), n in kept.items() if k == 1001) == 2 and max(kept.values()) == 1
    mixed = corpus_pipeline.mix_sources(spark, near, folder)
    full = {(r.doc_id, r.text): r._mix for r in mixing.mix(near.drop("_mix", "n_tokens")).collect()}
    assert {(r.doc_id, r.text) for r in mixed.collect()} == {k for k, m in full.items() if m.sampled} and mixed.columns == docs.columns
    cells = collections.defaultdict(float)
    for r in near.collect():
        m = full[r.doc_id, r.text]
        cells[r.source, r.lang, m.topic] += len((r.text or "").split())
        assert m.n_tokens == len((r.text or "").split())
    names = sorted(cells, key=str)
    tokens = np.array([cells[c] for c in names])
    want = [mixing.tempered({v: sum(n for c, n in cells.items() if c[k] == v) for v in {c[k] for c in cells}}, mixing.TEMPERATURE) for k in range(3)]
    chance = dict(zip(names, mixing.rake(names, tokens, want, mixing.FRACTION), strict=True))
    assert all(abs(chance[r.source, r.lang, full[r.doc_id, r.text].topic] - full[r.doc_id, r.text].probability) < 1e-9 for r in near.collect())
    coded = corpus_pipeline.tokenize(spark, mixed, folder)
    assert all(r.n_tokens == len(r.ids) for r in coded.collect()) and coded.count() == mixed.count()


def test_stages_on_empty_tables(spark, folder):
    docs = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, folder)
        assert found.count() == 0 and (name == "bpe" or found.columns == docs.columns)
    some = spark.createDataFrame([(1, "a b c", "en", "s", 5)], COLUMNS)
    assert corpus_pipeline.drop_toxic(spark, some, f"{folder}/none").count() == 1  # without labels nothing is rejected


def test_topics_are_not_the_languages():
    rng = np.random.default_rng(16)
    rows = []
    for k in range(600):
        lang, topic = ("de", "en")[k % 2], (k // 2) % 3
        text = " ".join([f"{lang}{j}" for j in rng.integers(0, 30, 20)] + [f"topic{topic}_{j}" for j in rng.integers(0, 30, 40)])
        rows.append((lang, topic, *mixing.hashed_words(text.encode())[1:]))
    model = mixing.fit_topics([(r[0], r[2], r[3]) for r in rows], topics=3)
    found = collections.Counter((r[1], model.topic(r[2], r[3], model.offset(r[0]))) for r in rows)
    assert sum(sorted(found.values())[-3:]) > 0.95 * len(rows) and len({t for _, t in sorted(found, key=found.get)[-3:]}) == 3
    assert model.topic(np.empty(0, np.int64), np.empty(0), model.offset(None)) == 0


def test_repeated_short_texts_are_reused():
    bpe = bpe_chunks.ChunkedBPE(*bpe_chunks.vocabulary())
    for _ in range(3):
        assert bpe.decode(bpe.encode_whole("A short text without any cut.")) == "A short text without any cut."
    assert bpe.encoded == 1 and bpe.reused == 2 and 3 * bpe.bytes_reused == 2 * bpe.bytes_in


def test_keys_with_both_labels_have_none(spark):
    docs = documents(spark, [(k, f"plain words number {k} of many") for k in range(60)] + [(100 + k, f"awful scum text {k}") for k in range(60)])
    labels = [(k, 0) for k in range(60)] + [(100 + k, 1) for k in range(60)]
    twice = labels + [(k, 1) for k in range(0, 60, 4)]
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    scores = lambda rows: {r.doc_id: r.score for r in toxicity.judge_toxicity(docs, make(rows)).collect()}
    assert scores(twice * 2) == scores([x for x in labels if x[0] % 4 or x[0] >= 100])
