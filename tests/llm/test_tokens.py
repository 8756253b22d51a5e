import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marlstone.llm import bpe_tree, token_files

TEXTS = [
    None, "", " ", "Hello, World's end\n\ttwo  spaces", "é É é ́x a b  c　d", "x" * 5000, "word " * 3000, "<|endoftext|>tail<|startoftext|> mid",
    "ΑΣ ΣΑΣ İstanbul ǅ", "a\u0085b c\x1cd", "日本語テキスト 123456", "<|endoftext|>", "\n\n  lead", "Hello, World's end\n\ttwo  spaces", "I'll we've 'S don't", "🙂👍🏽 ok",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i != 7 else None, t, 5, "x") for i, t in enumerate(TEXTS)] + [(3, "twice", 0, "y")], "doc_id long, text string, n_tokens int, ids string")


def library(name):
    out = Tokenizer.from_file(P.path(name))
    out.no_truncation()
    return out


def test_token_files_hold_what_the_library_gives(spark, docs, tmp_path):
    path = str(tmp_path / "orc")
    token_files.write_tokens(docs, path, P.path("word_bpe_49k.json"), 2, files=3)
    stored = token_files.read_tokens(spark, path)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_digests(stored).collect())
    t, want, start = library("word_bpe_49k.json"), [], 0
    for doc_id, text in sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id is not None, doc_id or 0, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)
    assert stored.filter("doc_id = 9").count() == 1
    assert "EqualTo(doc_id,9)" in stored.filter("doc_id = 9")._jdf.queryExecution().toString()
    order = [r.doc_id for r in spark.read.orc(path).select("doc_id", F.col("_metadata.file_name").alias("f"), "start_in_part").orderBy("f", "start_in_part").collect()]
    assert order[0] is None and order[1:] == sorted(order[1:])


def test_empty_table(spark, docs, tmp_path):
    path = str(tmp_path / "orc")
    token_files.write_tokens(docs.limit(0), path, P.path("word_bpe_49k.json"), 2, files=3)
    assert token_files.token_digests(token_files.read_tokens(spark, path)).count() == 0
    assert bpe_tree.round_trip(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_words_are_forgotten_when_there_are_too_many(monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN_WORDS", 3)
    path = P.path("word_bpe_49k.json")
    for words in ([b"a", b"b", b"c"], [b"d", b"a"], [b"e", b"f", b"g", b"h"]):
        got = token_files.encoded(words, path)
        assert all(np.frombuffer(got[w], "<u4").tolist() == library("word_bpe_49k.json").encode(w.decode(), add_special_tokens=False).ids for w in words)


def test_words_at_hand_are_not_forgotten_and_marks_are_known_apart(monkeypatch):
    asked, path, ids = [], P.path("word_bpe_49k.json"), token_files._ids
    monkeypatch.setattr(token_files, "_ids", lambda model, part: asked.append(part) or ids(model, part))
    monkeypatch.setattr(token_files, "KNOWN_WORDS", 3)
    monkeypatch.setattr(token_files, "_known", {})
    for words in ([b"ab", b"cd", b"ef,", b"gh"], [b"ab", b"\xc3\xa0b,", b"ab,", b"4.5,", b"cd.,"], [b"ab.,"]):
        got = token_files.encoded(words, path)
        assert list(got) == words
        assert all(np.frombuffer(got[w], "<u4").tolist() == library("word_bpe_49k.json").encode(w.decode(), add_special_tokens=False).ids for w in words)
    assert sorted(asked) == sorted(["ab", "cd", "ef", ",", "gh", "àb", ".,"])


def test_segment_tree_equals_the_library(spark, docs):
    import hashlib

    t = library("byte_bpe_50k.json")
    path = P.path("byte_bpe_50k.json")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_tree.round_trip(docs, path).collect()}
    want = set()
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want
    tokens = bpe_tree.encode(docs, path)
    assert sorted(r.text for r in bpe_tree.decode(tokens, path).collect()) == sorted(r.text or "" for r in docs.collect())


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_segment_tree_on_any_text(text):
    path = P.path("byte_bpe_50k.json")
    bpe, t = bpe_tree.vocabulary(path), library_cached()
    ids = t.encode(text, add_special_tokens=False).ids
    assert bpe.encode(text) == ids
    assert bpe.decode(ids) == t.decode(ids, skip_special_tokens=False)


_cached = []


def library_cached():
    if not _cached:
        _cached.append(library("byte_bpe_50k.json"))
    return _cached[0]
