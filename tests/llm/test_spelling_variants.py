import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import spelling_variants as S

LOWER = str.maketrans(S._UPPER, S._UPPER.lower())


def plain_words(docs):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    near = {w: [v for v in n if is_near(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: b if b and n[b] >= 10 * n[w] else None for w, b in best.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


def some_docs(seed=3):
    rng = random.Random(seed)
    base = ["parliament", "aaaaaaa", "straßenbahn", "Économiques", "necessary", "abababab", "committee", "×÷×÷×÷×", "z" * 400]
    docs = []
    for i in range(400):
        words = []
        for _ in range(rng.randint(0, 30)):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abé") + w[k:], w[:k] + rng.choice("abz") + w[k + 1 :]])
            words.append(rng.choice([w, w, w.upper() if w.isascii() else w]))
        docs.append((i % 390 if i % 50 else None, rng.choice([" ", "-", "\n", "1"]).join(words) if i % 37 else None))
    return docs + docs[:5]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "x", 3) for d, t in some_docs()], "doc_id long, text string, word string, n int")


def test_words_equal_the_plain_version(spark, docs):
    assert {r.word: r.n for r in S.words(docs).collect()} == plain_words(some_docs())


def test_variants_equal_the_plain_version(spark, docs):
    want = plain_variants(plain_words(some_docs()))
    got = sorted((tuple(r) for r in S.variants(S.words(docs)).collect()), key=lambda r: r[0])
    assert any(r[1] for r in want)
    assert got == want
    assert S.variants(S.words(docs.limit(0))).count() == 0


def test_chains_of_forms_end_at_their_last_word(spark):
    words = ["aaaaaaaa" + "b" * k for k in range(7)]
    counted = [(w, 3 * 10**k) for k, w in enumerate(words)] + [("unlike1", 5), ("tied-aaaa", 40), ("tied-aaab", 40), ("tied-aaax", 4)]
    got = {r.word: r for r in S.variants(spark.createDataFrame(counted, "word string, n long")).collect()}
    assert all(got[w].root == words[-1] for w in words)
    assert [got[w].form for w in words[:-1]] == words[1:] and got[words[-1]].form is None
    assert (got["tied-aaax"].form, got["tied-aaax"].n_near, got["unlike1"].root, got["unlike1"].n_near) == ("tied-aaaa", 2, "unlike1", 0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=9), min_size=1, max_size=12, unique=True))
def test_words_meet_at_a_key_if_they_are_near(words):
    data = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    keys, of = S.deletions(data, np.append(0, np.cumsum([*map(len, words)])))
    met = {}
    for k, w in zip(keys.tolist(), of.tolist(), strict=True):
        met.setdefault(k, []).append(w)
    assert all(len(x) == len(set(x)) for x in met.values())
    shared = Counter((a, b) for x in met.values() for a in x for b in x if a < b)
    for i, a in enumerate(words):
        for j in range(i + 1, len(words)):
            assert not is_near(a, words[j]) or shared[(i, j)] == 1
    texts = {}
    for i, w in enumerate(words):
        for s in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            texts.setdefault(s, set()).add(i)
    assert sorted(map(sorted, met.values())) == sorted(map(sorted, texts.values()))
