"""The pipeline's near-duplicate stage against a brute force over shingles of 5 words and 0.8."""

import random

import corpus_pipeline as C
from marlstone.llm import jaccard_join as J

from .test_joins import brute, corpus


def words5(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {("#", *w)} if w else set()


def components(rows):
    rows = [(i, words5(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


def test_two_substitutions_in_a_hundred_words_are_a_near_copy(spark):
    words = [f"w{k}" for k in range(100)]
    near = [{30: "x", 70: "y"}.get(k, w) for k, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near))], "doc_id long, text string")
    assert [r.doc_id for r in C.drop_near_duplicates(spark, docs, "").collect()] == [1]
    assert J.keep_one(docs).count() == 2  # op5's own values: three words and 0.9


def test_stage_against_all_pairs(spark):
    rng = random.Random(21)
    rows = [(i, t) for i, t in corpus() if t is None or t.isascii()]
    for base in range(10):  # copies with one to four words replaced in 100
        words = [f"v{rng.randrange(400)}" for _ in range(100)]
        for n in range(5):
            near = list(words)
            for at in rng.sample(range(100), n):
                near[at] = f"v{rng.randrange(400)}"
            rows.append((1000 + 10 * base + n, " ".join(near)))
    want = sorted({c for c in components(rows).values()})
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(r.doc_id for r in C.drop_near_duplicates(spark, docs, "").collect() if r.doc_id is not None) == want
    assert want != sorted({c for none, _, _, c in brute(rows) if not none})
