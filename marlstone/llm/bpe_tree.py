"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token's symbols form a linked list. Leaf i of the tree holds (rank, i) of the pair that starts
at symbol i, or nothing; an inner node holds the least of its two children. The root is the leftmost
pair of the lowest rank: it is merged, and the three leaves that this touches are set again, each in
a logarithmic number of steps. When the root is empty, no pair can merge any more.

Defined results: a null text counts as empty (no ids); strings of added tokens in a text become
their ids, as the tokenizers library does by default; repeated rows each get a row; an empty table
gives an empty result; columns other than the id and the text are left out.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache, partial

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import chunks, keeps, table

#: Pre-tokens whose ids a Python worker remembers at most.
KNOWN_PIECES = 400_000
#: Fixed values of the byte-level vocabulary: its split pattern, and the bytes that stand for themselves.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

_NONE = 1 << 62


class SegmentTreeBpe:
    """The vocabulary of a byte-level BPE file, with its merges as ranks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(PRINTABLE))}
        byte_of = {c: b for b, c in letters.items()}
        self.byte_ids = [vocab[letters[b]] for b in range(256)]
        self.bytes_of = {i: bytes(byte_of[c] for c in piece) for piece, i in vocab.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.split = regex.compile(PATTERN).findall
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known: dict[str, tuple[str, bytes]] = {}

    def piece(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        ids = [self.byte_ids[b] for b in data]
        n = len(ids) - 1
        if n < 1:
            return ids
        get, width = self.merges.get, 1 << (n - 1).bit_length()
        tree = [_NONE] * (2 * width)
        for i in range(n):
            if pair := get((ids[i], ids[i + 1])):
                tree[width + i] = pair[0] << 32 | i
        for node in range(width - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b

        def put(i: int, value: int) -> None:
            node = width + i
            if tree[node] == value:
                return
            tree[node] = value
            while node > 1:
                a, b = tree[node], tree[node ^ 1]
                node >>= 1
                if a > b:
                    a = b
                if tree[node] == a:
                    return
                tree[node] = a

        after, before = list(range(1, n + 2)), list(range(-1, n))
        while (key := tree[1]) < _NONE:
            i = key & 0xFFFFFFFF
            j = after[i]
            ids[i] = get((ids[i], ids[j]))[1]
            ids[j] = -1
            k = after[i] = after[j]
            if j < n:
                put(j, _NONE)
            if k <= n:
                before[k] = i
                put(i, pair[0] << 32 | i if (pair := get((ids[i], ids[k]))) else _NONE)
            else:
                put(i, _NONE)
            if (h := before[i]) >= 0:
                put(h, pair[0] << 32 | h if (pair := get((ids[h], ids[i]))) else _NONE)
        return [i for i in ids if i >= 0]

    def learn(self, pieces: list[str]) -> None:
        """Hold the ids (as decimal text) and the decoded bytes of pre-tokens."""
        known = self.known
        new = set(pieces).difference(known)
        if len(known) + len(new) > KNOWN_PIECES:
            known.clear()
            new = set(pieces)
        for p in new:
            ids = self.piece(p.encode())
            known[p] = (",".join(map(str, ids)), self.decode_bytes(ids))

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def pieces(self, text: str) -> list[str]:
        if self.added_split is None or not any(s in text for s in self.added):
            return self.split(text)
        out: list[str] = []
        for x in self.added_split.split(text):
            if x in self.added:
                self.known[x] = (str(self.added[x]), x.encode())
                out.append(x)
            elif x:
                out += self.split(x)
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for x in self.added_split.split(text) if self.added_split else [text]:
            out += [self.added[x]] if x in self.added else [i for p in self.split(x) for i in self.piece(p.encode())]
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@cache
def vocabulary(path: str) -> SegmentTreeBpe:
    return SegmentTreeBpe(path)


keeps(__name__, vocabulary.cache_clear)


def _round_trip(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = vocabulary(path)
    for batch, data, at in chunks(batches, user=__name__):
        raw = data.tobytes()
        split = [bpe.pieces(raw[a:b].decode()) for a, b in zip(at[:-1], at[1:], strict=True)]
        bpe.learn([p for x in split for p in x if p not in bpe.added])
        for s, i in bpe.added.items():
            bpe.known[s] = (str(i), s.encode())
        n, ids_hash, text_hash, get = [], [], [], bpe.known.__getitem__
        for x in split:
            rows = [*map(get, x)]
            ids = ",".join([r[0] for r in rows])
            n.append(ids.count(",") + 1 if ids else 0)
            ids_hash.append(hashlib.sha256(ids.encode()).hexdigest())
            text_hash.append(hashlib.sha256(b"".join([r[1] for r in rows]).decode("utf-8", "replace").encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _ids(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = vocabulary(path)
    for batch, data, at in chunks(batches, user=__name__):
        raw = data.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([bpe.encode(raw[a:b].decode()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.list_(pa.int32()))], ["doc_id", "ids"])


def _texts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = vocabulary(path)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([bpe.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])


def _two(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of each document."""
    return _two(docs, id_col, text_col).mapInArrow(partial(_ids, path=path), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; bytes that are no UTF-8 become U+FFFD."""
    return tokens.select("doc_id", "ids").mapInArrow(partial(_texts, path=path), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them."""
    return _two(docs, id_col, text_col).mapInArrow(partial(_round_trip, path=path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op9_bpe_tree": op9_bpe_tree}
ORACLES: dict[str, str] = {}
