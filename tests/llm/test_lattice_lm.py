import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from marlstone.llm import lattice_lm as L

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def all_segmentations(word, pieces, logq):
    """The sum over every segmentation, one after another."""
    if not word:
        return math.exp(logq[-1])
    return sum(math.exp(logq[pieces.at[word[:k]]]) * all_segmentations(word[k:], pieces, logq) for k in range(1, len(word) + 1) if word[:k] in pieces.at)


def test_forward_equals_the_sum_over_all_segmentations():
    pieces = L.pieces_of(PATH)
    logq = L.start_scores(pieces)
    words = [b"the", b"tionable", "éa".encode(), b"x", b"12", b"erth,", b"a" * 9, b"\x00\xff"]
    got = L.spelled(words, pieces, logq)
    assert np.allclose(got, [math.log(all_segmentations(w, pieces, logq)) for w in words])
    e = L.expected(words, pieces, logq)
    assert e[-1] == len(words)
    assert np.isclose(sum(len(p) * e[i] for i, p in enumerate(pieces.pieces)), sum(map(len, words)))


def test_long_word_and_spelled_mass():
    pieces = L.pieces_of(PATH)
    logq = L.start_scores(pieces)
    assert np.isfinite(L.spelled([b"z" * 3000], pieces, logq)).all()
    two = [bytes([a, b]) for a in range(97, 123) for b in range(97, 123)]
    assert np.exp(L.spelled(two, pieces, logq)).sum() < 1


ROWS = [(i, f"The cat sat on mat {i % 3} thinking tionable") for i in range(40)] + [(100, None), (101, ""), (102, "zzyzx qwerty THE"), (5, "twice twice"), (None, "the null"), (103, "w " * 4000)]


@pytest.mark.parametrize("head", [1 << 16, 4, 0])
def test_counts_and_base_against_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(L, "HEAD", head)
    docs = spark.createDataFrame([(*r, 1.0, True) for r in ROWS], "doc_id long, text string, score double, held_out boolean")
    got = sorted(L.score(docs, PATH).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens))
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in ROWS]
    tokens = [[*(t or "").lower().split(), None] for _, t in ROWS]
    c = Counter(w for x, h in zip(tokens, held) if not h for w in x)
    n, v = sum(c.values()), len(c)
    want = sorted(
        ((i, h, len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)) for (i, _), h, x in zip(ROWS, held, tokens)),
        key=lambda r: (r[0] is None, r[0] or 0, r[2]),
    )
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:5]
        assert math.isclose(g.base_score, w[5], rel_tol=1e-9)
        assert -1e6 < g.score < 0


def test_scores_do_not_depend_on_the_head(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    get = lambda: sorted((r.n_tokens, round(r.score, 6)) for r in L.score(docs, PATH).collect())
    first = get()
    monkeypatch.setattr(L, "HEAD", 3)
    assert get() == first


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert L.score(docs.limit(0), PATH).count() == 0
    only = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    r = L.score(only, PATH).first()
    assert r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score < 0


def test_every_piece_of_the_vocabulary_counts():
    import base64

    pieces = L.pieces_of(PATH)
    with open(PATH, "rb") as f:
        whole = [base64.b64decode(line.split()[0]).removeprefix(b" ").lower() for line in f]
    assert all(p in pieces.at for p in whole if p and not any(x in b" \t\n\x0b\x0c\r" for x in p))
    assert pieces.lengths[0] == max(map(len, pieces.pieces)) > 16
    longest = max(pieces.pieces, key=len)
    logq = np.full(len(pieces.pieces) + 1, -1.0)
    logq[pieces.at[longest]] = 50.0  # so heavy that the sum is next to that one segmentation's
    assert math.isclose(L.spelled([longest], pieces, logq)[0], 50.0 + logq[-1], rel_tol=1e-6)


def by_hand(word, pieces, logq):
    """The sum over all segmentations, and each piece's share of it."""
    total, counts = 0.0, Counter()

    def go(rest, p, used):
        nonlocal total
        if not rest:
            total += p
            for u in used:
                counts[u] += p
            return
        for k in range(1, len(rest) + 1):
            if (i := pieces.at.get(rest[:k])) is not None:
                go(rest[k:], p * math.exp(logq[i]), [*used, i])

    go(word, 1.0, [])
    return total * math.exp(logq[-1]), {k: v / total for k, v in counts.items()}


def test_whole_documents_against_a_sum_by_hand(spark):
    """Known and unknown words apart: a known word has its unit and its spellings, an unknown one these alone."""
    rows = [(i, t) for i, t in enumerate(["a cat sat", "the cat", "hats sat on", "a bat", "The mat", "cats", "on on a", "mash", "that cat", "sat", "at bat tea", "zap cab"] * 2)]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    assert any(held) and not all(held)
    pieces, tokens = L.pieces_of(PATH), [[*t.lower().encode().split(), None] for _, t in rows]
    c = Counter(w for x, h in zip(tokens, held) if not h for w in x)
    n, v = sum(c.values()), len(c)
    logq = L.start_scores(pieces)
    for _ in range(L.EM_ROUNDS):
        q = np.full(len(logq), L._FLOOR)
        for w in c:
            if w is not None:
                q[-1] += 1
                for i, x in by_hand(w, pieces, logq)[1].items():
                    q[i] += x
        logq = np.log(q / q.sum())
    n1, n2 = (sum(x == k for w, x in c.items() if w is not None) for k in (1, 2))
    d = min(0.95, max(0.05, n1 / (n1 + 2 * n2)))

    def p(w):
        unit = max(0.0, c[w] - d) / n if c[w] else 0.0
        return unit if w is None else unit + d * v / n * by_hand(w, pieces, logq)[0]

    got = {r.doc_id: r for r in L.score(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()}
    for (i, _), x in zip(rows, tokens):
        assert math.isclose(got[i].score, sum(math.log10(p(w)) for w in x), rel_tol=1e-9)
