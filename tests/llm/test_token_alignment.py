import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from marlstone.llm import token_alignment as T

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  two  spaces ", "Hello, World's end\n\ttwo", "é É é ́x a b  c　d", "x" * 3000, "word " * 9000 + "end", "<|endoftext|>tail <s> </s><0x41>",
    "has▁mark", "日本語テキスト 123456 🙂👍🏽", "a\n b\n  c \n d", "tail ", "nul\x00byte <unk>", "The quick brown fox jumps over the lazy dog. " * 40,
]


class Plain:
    """The contract, token by token."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=B)
        self.bytes_a, self.bytes_b = T.aligner(A, B).bytes_a, T.aligner(A, B).bytes_b

    def tokens(self, text):
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        whole = (" " + text).encode()
        same = b"".join(self.bytes_a[i] for i in a) == whole == b"".join(self.bytes_b[i] for i in b)
        return (a, b) if text and same else ([], [])

    def aligned(self, text):
        a, b = self.tokens(text)
        ends_a, ends_b, at = [], [], 0
        for i in a:
            ends_a.append(at := at + len(self.bytes_a[i]))
        at = 0
        for i in b:
            ends_b.append(at := at + len(self.bytes_b[i]))
        groups, links, j0, i0 = [], [], 0, 0
        for i, e in enumerate(ends_a):
            if e in ends_b:
                j = ends_b.index(e)
                groups.append((a[i0 : i + 1], b[j0 : j + 1]))
                i0, j0 = i + 1, j + 1
        start_b = [0, *ends_b]
        j = 0
        for i, e in enumerate(ends_a):
            s = ends_a[i - 1] if i else 0
            while ends_b[j] <= s:
                j += 1
            k = j
            while k < len(b) and start_b[k] < e:
                links.append((a[i], b[k]))
                k += 1
        return a, b, groups, links

    def rows(self, docs):
        found = [(d, *self.aligned(t or "")) for d, t in docs]
        counts = Counter(x for *_, links in found for x in links)
        most = Counter()
        for (_, b), n in counts.items():
            most[b] = max(most[b], n)
        out = []
        for d, a, b, groups, links in found:
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            out.append((d, len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
        return sorted(out, key=repr)


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 4 else None, t) for i, t in enumerate(TEXTS)] + [(14, "twice is twice")] * 3 + [(2, None), (None, TEXTS[4]), (7, TEXTS[7])]
    return spark.createDataFrame([(d, t, 5, "x") for d, t in rows], "doc_id long, text string, n_links int, pairs string").repartition(5)


@pytest.mark.parametrize("heavy", [T.HEAVY, 50, 0])
def test_alignment_equals_the_plain_version(spark, docs, plain, heavy):
    want = plain.rows([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((tuple(r) for r in T.align(docs, A, B, heavy=heavy).collect()), key=repr) == want


def test_small_sweeps_and_segments(spark, docs, plain, monkeypatch):
    both = T.aligner(A, B)
    monkeypatch.setattr(T, "SEGMENT", 2)
    monkeypatch.setattr(T, "SWEEP", 3)
    texts = [t for t in TEXTS if t and len(t) < 4000]
    rows = []
    for d, (t, parts) in enumerate(zip(texts, both.segments(texts), strict=True)):
        rows += [(d, bytes([d]), 0, -1, 1, b"")] if not parts else [(d, bytes([d]), o, side, 2, ids) for o, *ids_ in parts for side, ids in enumerate(ids_)]
    halves = [T._batch(rows[k : k + 5], T.EVENTS) for k in range(0, len(rows), 5)]
    got = {}
    for batch in T._swept(iter(halves), (A, B)):
        for r in batch.to_pylist():
            if r["pairs"] is None:
                got[r["doc_id"]] = r
    for d, t in enumerate(texts):
        a, b, groups, links = plain.aligned(t)
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        r = got[d]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (len(a), len(b), len(groups), len(links))
        assert r["groups_sha256"] == (hashlib.sha256(text.encode()).hexdigest() if a else "")


def test_segments_begin_where_both_sides_end(plain):
    both = T.aligner(A, B)
    for t in TEXTS:
        for offset, _, _ in next(both.segments([t])) if t else []:
            assert offset == 0 or (" " + t).encode()[offset : offset + 1] == b" "


def test_empty_table(spark, docs):
    assert T.align(docs.limit(0), A, B).count() == 0


def test_pairs_are_kept_as_they_are():
    import numpy as np

    for kind in ("<u4", "<u8"):
        for x in ([], [5], [1, 2, 1 << 31]):
            assert T._unpacked(T._packed(np.array(x, kind)), np.dtype(kind)).tolist() == x


def test_no_piece_goes_on_over_a_space():
    sp = SentencePieceProcessor(model_file=B)
    assert not any(T.SPACE in sp.id_to_piece(i).lstrip(T.SPACE) for i in range(sp.get_piece_size()))


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n 'ae thés1!▁")), min_size=1, max_size=60))
def test_any_text(text):
    p = known_plain()
    both = T.aligner(A, B)
    (parts,) = both.segments([text])
    import numpy as np

    a, b = p.tokens(text)
    assert [np.frombuffer(b"".join(x[k] for x in parts), both.kind).tolist() for k in (1, 2)] == [a, b]


_cached = []


def known_plain():
    if not _cached:
        _cached.append(Plain())
    return _cached[0]
