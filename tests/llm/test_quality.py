"""Language mixtures and toxicity, on small texts of known make."""

import random
import zlib
from functools import partial

import numpy as np
import pytest

from marlstone.llm import language_mix as L
from marlstone.llm import toxicity as T

WORDS = {
    "en": "the of and to in is with this that have which from their would there about other people water sound".split(),
    "de": "der die und das nicht eine auch werden zwischen haben schule straße übung natürlich möglich arbeit zeit".split(),
    "fr": "le la les des une est que pour dans avec être où déjà garçon très même ils nous toujours maison".split(),
}


def say(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    return [(i, say(lang, 30, rng), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]


def test_languages(spark, corpus):
    rng = random.Random(6)
    odd = [
        (1000, None, "en"), (1001, "", "de"), (1002, "123 ... !!!", "fr"), (1003, "日本語", None), (None, say("en", 20, rng), "en"), (0, say("fr", 20, rng), None),
        (1004, say("en", 300, rng) + ". " + say("de", 150, rng), None), (1005, say("de", 4000, rng), None), (1006, "straße", None),
    ]
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in corpus + odd], "doc_id long, text string, lang string, score double, lang_pred string")
    rows = L.identify(docs).collect()
    assert len(rows) == len(corpus) + len(odd)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    assert all(any(r.lang_pred == lang for r in by[i]) for i, _, lang in corpus)
    assert [by[i][0].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000][0].score == 0
    assert by[1003][0].lang_pred in WORDS
    mixture = {m.lang: m.share for m in by[1004][0].mixture}
    assert set(mixture) == {"en", "de"} and abs(mixture["en"] - 2 / 3) < 0.05 and by[1004][0].lang_pred == "en"
    assert by[1005][0].lang_pred == by[1006][0].lang_pred == "de"
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(rows) - 3
    assert L.identify(docs.limit(0)).count() == 0
    unlabelled = L.identify(docs.withColumn("lang", docs.lang.substr(1, 0)).selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {(r.lang_pred, r.score) for r in unlabelled.collect()} == {("und", 0.0)}


def test_proportions_against_plain_em():
    rng = np.random.default_rng(1)
    ll = np.log(rng.dirichlet(np.ones(3), 60))
    p = np.exp(ll - ll.max(axis=1, keepdims=True))
    share = np.ones(3) / 3
    for _ in range(L.ROUNDS):
        share = (p * share / (p * share).sum(axis=1, keepdims=True)).mean(axis=0)
    got, like = L._fit(p, np.array([0]), np.array([60]), np.ones((1, 3)))
    assert np.allclose(got[0], share)
    assert np.isclose(like[0], np.log((p * share).sum(axis=1)).sum())


def test_trigrams_do_not_cross_texts():
    a, b = "une été".encode(), "weiß".encode()
    alone = [L.trigrams(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0] for x in (a, b)]
    both = L.trigrams(np.frombuffer(a + b, np.uint8), np.array([0, len(a), len(a + b)]))
    assert (both[0] == np.concatenate(alone)).all() and both[2].tolist() == [0, 0, 1]


def test_toxicity(spark, corpus):
    rng = random.Random(8)
    bad = ["idiot", "moron", "worthless", "clown"]
    rows, labels = [], []
    for i, text, _ in corpus * 3:
        doc = len(rows)
        toxic = rng.random() < 0.3
        if toxic:
            words = text.split()
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
            text = " ".join(words)
        rows.append((doc, text))
        labels.append((doc, 1, int(toxic)))
    extra = [(9000, None), (9001, ""), (9002, "you worthless idiot moron clown " * 500), (None, "an idiot"), (0, rows[0][1])]
    docs = spark.createDataFrame([(*r, 1.0, 1) for r in rows + extra], "doc_id long, text string, score double, toxic int")
    marks = spark.createDataFrame([*labels, (5, 0, None), (None, 1, 1), (7, 1, labels[7][2])], "doc_id long, quality int, toxic int")
    got = T.classify(docs, marks).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    want = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert len(held) > 50 and np.mean([r.predicted == want[r.doc_id] for r in held]) > 0.97
    assert by[9000].score == by[9001].score and by[9000].predicted == 0 and by[9002].predicted == 1
    assert all(r.predicted == (r.score >= 0.3) for r in got)
    clean = T.keep_clean(docs, marks)
    assert clean.columns == docs.columns and clean.count() == sum(not r.predicted for r in got)
    assert T.classify(docs.limit(0), marks).count() == 0
    assert {r.score < 1e-9 for r in T.classify(docs, marks.limit(0)).collect()} == {True}
    assert {r.predicted for r in T.classify(docs, marks.filter("toxic = 1")).collect()} == {1}


def test_regression_reaches_the_optimum():
    rng = np.random.default_rng(2)
    n, m = 300, 12
    x = rng.random((n, m)) < 0.3
    r = rng.normal(size=m)
    y = (x @ r + rng.normal(size=n) > 0).astype(float)
    row, feature = np.nonzero(x)
    w = T.fit(np.searchsorted(row, np.arange(n + 1)), feature, y, r, steps=200)
    z = x * r
    p = 1 / (1 + np.exp(-(z @ w[:-1] + w[-1])))
    grad = np.append(z.T @ (p - y) + T.L2 * w[:-1], (p - y).sum())
    assert np.abs(grad).max() < 0.05


def test_gram_bins_do_not_cross_texts():
    a, b = b"idiot x", b"clown"
    at = np.array([0, len(a), len(a + b)])
    both = [np.sort(bins) for bins, _ in T.gram_bins(np.frombuffer(a + b, np.uint8), at)]
    alone = [[bins for bins, _ in T.gram_bins(np.frombuffer(x, np.uint8), np.array([0, len(x)]))] for x in (a, b)]
    for k in range(3):
        assert (both[k] == np.sort(np.concatenate([alone[0][k], alone[1][k]]))).all()


def test_selected_sets_against_all_subsets():
    from itertools import combinations

    rng = np.random.default_rng(5)
    langs, same = 4, 0
    for _ in range(60):
        n = int(rng.integers(5, 60))
        true = rng.choice(langs, size=rng.integers(1, 4), replace=False)
        of = rng.choice(true, size=n)
        ll = np.full((n, langs), -6.0) + rng.normal(0, 1.0, (n, langs))
        ll[np.arange(n), of] = -1.0
        got = L.mixtures(ll, np.zeros(n, np.int64), 1)[0]
        p, begin, count = np.exp(ll - ll.max(1, keepdims=True)), np.zeros(1, np.int64), np.array([n])
        values = {}
        for k in range(1, langs + 1):
            for s in combinations(range(langs), k):
                active = np.zeros((1, langs))
                active[0, list(s)] = 1
                values[s] = float(L._fit(p, begin, count, active, 200)[1][0]) - L.PENALTY * np.log(n + 1.0) * (k - 1)
        same += tuple(np.flatnonzero(got > 0)) == max(values, key=values.get)
    assert same >= 57


def test_too_many_languages_raise(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_LANGUAGES", 3)
    docs = spark.createDataFrame([(f"some words {k}", f"l{k}") for k in range(5)], "text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        L.learn(docs)


def test_toxicity_ratios_and_scores_against_plain_ones(spark):
    rows = [(k, t) for k, t in enumerate(["you idiot", "good day", "an IDIOT again", "a good text", "such a clown", "nice clown fish", "day by day", "", "idiot idiot", "good idea"])]
    labels = [(k, int("idiot" in t.lower() or k == 4)) for k, t in rows]
    train = [(k, t.lower().encode(), y) for (k, t), (_, y) in zip(rows, labels) if zlib.crc32(str(k).encode()) % 4 != 2]
    bins = {k: {int(b) for part, _ in T.gram_bins(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for b in part} for k, t, _ in train}
    n = [sum(y == v for *_, y in train) for v in (0, 1)]
    every = sorted(set().union(*bins.values()))
    count = lambda b, v: sum(b in bins[k] for k, _, y in train if y == v)
    r = {b: np.log((count(b, 1) + 1) / (n[1] + 2)) - np.log((count(b, 0) + 1) / (n[0] + 2)) for b in every}
    z = {b: r[b] ** 2 / (1 / (count(b, 1) + 1) + 1 / (count(b, 0) + 1)) for b in every}
    r = {b: r[b] * z[b] / (z[b] + T.SHRINK**2) for b in every}
    x = np.array([[r[b] if b in bins[k] else 0.0 for b in every] for k, *_ in train])
    y = np.array([v for *_, v in train], float)
    w = np.zeros(len(every) + 1)
    for _ in range(20000):  # plain gradient descent on the same loss
        p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
        w -= 0.02 * np.append(x.T @ (p - y) + T.L2 * w[:-1], (p - y).sum())
    got = {q.doc_id: q.score for q in T.classify(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    for (k, *_), want in zip(train, 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))):
        assert abs(got[k] - want) < 0.01


def test_sample_holds_its_bytes_and_only_ids_with_texts(spark):
    docs = spark.createDataFrame([(k, "x" * 100) for k in range(200)] + [(7, "y" * 5000)] * 40, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 100000, 1)], "doc_id long, toxic int")
    took = T._sample(docs, labels, 6000).collect()
    assert 0 < sum(100 for r in took) <= 6000 and all(r.doc_id < 200 and r.doc_id != 7 for r in took)


def labelled(spark, n=3000, toxic=0.04):
    """Documents in which a bad word stands in all of label 1 and in a few others."""
    rng = random.Random(4)
    rows = [(k, rng.random() < toxic, say("en", 30, rng)) for k in range(n)]
    docs = spark.createDataFrame([(k, f"{t} idiot moron {t}" if bad else t) for k, bad, t in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(k, int(bad)) for k, bad, _ in rows], "doc_id long, toxic int"), {k: bad for k, bad, _ in rows}


def recall(got, want):
    found = [r for r in got if r.held_out]
    return np.mean([r.predicted for r in found if want[r.doc_id]]), np.mean([r.predicted for r in found if not want[r.doc_id]])


def test_small_samples_score_as_large_ones(spark, monkeypatch):
    """However much smaller the sample is than the labelled texts, it holds both labels and isn't empty."""
    docs, labels, want = labelled(spark)
    for limit in (T.SAMPLE_BYTES, 90_000, 45_000):
        took = T._sample(docs, labels, limit).join(docs, "doc_id").selectExpr("toxic", "length(text) as n").collect()
        assert {r.toxic for r in took} == {0, 1} and 0.5 * min(limit, 500_000) < sum(r.n for r in took) <= limit
        monkeypatch.setattr(T, "learn", partial(T_LEARN, sample_bytes=limit))
        found, wrong = recall(T.classify(docs, labels).collect(), want)
        assert found > 0.95 and wrong < 0.02


def test_a_sample_without_a_label_leaves_the_ratios(spark, monkeypatch):
    docs, labels, want = labelled(spark, 400, 0.3)
    monkeypatch.setattr(T, "learn", partial(T_LEARN, sample_bytes=300))
    got = T.classify(docs, labels).collect()
    bad, good = ([r.score for r in got if r.held_out and want[r.doc_id] == v] for v in (True, False))
    assert len({r.score for r in got}) > 100 and np.mean([b > g for b in bad for g in good]) > 0.95


T_LEARN = T.learn


def test_long_texts_piece_by_piece(monkeypatch):
    text = np.frombuffer(b"".join(b"word%d idiot " % k for k in range(3000)), np.uint8)
    whole = next(T._present(text, np.array([0, len(text)])))
    monkeypatch.setattr(T, "PIECE", 1000)
    assert sorted(whole.tolist()) == next(T._present(text, np.array([0, len(text)]))).tolist()


def test_packed_rows_give_what_was_put_in(monkeypatch):
    monkeypatch.setattr(T, "STRIDE", 7)
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(T.BUCKETS, size=n, replace=False)) for n in (0, 3, 9, 0, 0, 1, 20, 0)]
    at = np.append(0, np.cumsum([len(x) for x in rows]))
    packed, whole = T.Rows(at), np.concatenate(rows)
    for span in packed.spans():
        packed[span] = whole[span]
    assert np.concatenate([packed[s] for s in packed.spans()]).tolist() == whole.tolist()
    assert packed[slice(0, int(at[-1]))].tolist() == whole.tolist()
    assert T.Rows(np.array([0])).spans() == []
