import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import byte_words, rank_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None, "", " ", "  two  spaces ", "Hello, World's end\n\ttwo", "é É é ́x a b  c　d", "x" * 5000, "word " * 3000, "<|endoftext|>tail",
    "ΑΣ ΣΑΣ İstanbul ǅ", "a\u0085b c\x1cd \x1c e", "日本語テキスト 123456", "\n\n  lead", "I'll we've 'S don't", "🙂👍🏽 ok", "a\n b\n  c \n d", "x' y'' z's",
]


def plain():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i != 7 else None, t, 5, "x") for i, t in enumerate(TEXTS)] + [(3, "twice", 0, "y")] * 2, "doc_id long, text string, n_tokens int, ids string")


def test_round_trip_equals_the_other_library(spark, docs):
    enc = plain()
    want = []
    for r in docs.collect():
        ids = enc.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = [tuple(r) for r in rank_bpe.round_trip(docs, PATH, P.PATTERN).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert rank_bpe.round_trip(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_offsets_and_what_each_id_adds(spark, docs):
    tokens = rank_bpe.encode(docs, PATH, P.PATTERN)
    texts = {r.doc_id: r.text or "" for r in docs.filter("text != 'twice' or text is null").collect()}
    t = rank_bpe.vocabulary(PATH, P.PATTERN).tokenizer
    for r in tokens.collect():
        text = texts[r.doc_id] if r.ids != rank_bpe.vocabulary(PATH, P.PATTERN).tokenizer.encode("twice").ids else "twice"
        assert [*zip(r.starts, r.ends, strict=True)] == t.encode(text, add_special_tokens=False).offsets
    back = rank_bpe.decode(tokens, PATH, P.PATTERN).collect()
    assert sorted(r.text for r in back) == sorted(r.text or "" for r in docs.collect())
    assert all("".join(r.added) == r.text for r in back)


def test_split_characters_come_with_the_id_that_completes_them(spark):
    enc = plain()
    ids = enc.encode_ordinary("x𓂀")
    assert len(ids) > 2
    rows = spark.createDataFrame([(1, ids), (2, ids[:-1]), (3, ids[2:]), (4, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r for r in rank_bpe.decode(rows, PATH, P.PATTERN).collect()}
    assert got[1].added == ["x"] + [""] * (len(ids) - 2) + ["𓂀"]
    assert got[2].text == enc.decode(ids[:-1]) == "x�" and got[3].text.startswith("�") and got[4].text == ""


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n 'ae thés1!")), max_size=60))
def test_any_text(text):
    bpe = rank_bpe.vocabulary(PATH, P.PATTERN)
    (got,) = bpe.encode([text])
    assert np.frombuffer(got, "<u4").tolist() == known_plain().encode_ordinary(text)


def test_units_are_forgotten_when_there_are_too_many():
    r = byte_words.Remembered(lambda words: [w.upper() for w in words], most=3)
    for words in ({"a", "b", "c"}, {"d", "a"}, {"e", "f", "g", "h", "x" * 99}):
        got = r(words)
        assert all(got[w] == w.upper() for w in words)
    assert "x" * 99 not in r.known


_cached = []


def known_plain():
    if not _cached:
        _cached.append(plain())
    return _cached[0]
