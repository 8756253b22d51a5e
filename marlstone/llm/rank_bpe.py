"""Byte-level BPE by a file of ranks, with the tokenizers library over Arrow batches.

A rank file lists byte strings; whichever adjacent pair joins to the lowest-ranked one merges first. The
library wants pairs instead: a string's pair is the two parts that it falls into when lower ranks alone
merge it. No other pair of parts can ever meet, as what happens within a string's bytes before it forms
is what would happen to them alone. Bytes go to the library as characters (byte-to-character mapping)
and come back by the reversed table. Each match of the split pattern is encoded by itself; one that is a
listed string is one token.

`encode` gives ids with the character offsets of each token (one that holds a part of a character
covers all of it); `decode` gives the text, with U+FFFD for bytes that are no UTF-8, and what each id
adds to it: a character split between ids comes with the id that completes it.

Defined results: a null text counts as empty (no ids); no string is special; an id that the file lacks is
an error; repeated rows each get a row; null doc_ids stay; an empty table gives an empty result; columns
other than the id and the text are left out. A text is encoded unit by unit (byte_words), so beside the
text itself memory holds its ids alone, however long it is.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.byte_words import Remembered, byte_level, bytes_of, letters_of, units
from marlstone.llm.common import chunks, keeps, table


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pair_of(token: bytes, rank: int, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts that token falls into when only lower ranks than its own merge."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        joined = [ranks.get(a + b, rank) for a, b in zip(parts[:-1], parts[1:], strict=True)]
        if (low := min(joined)) >= rank:
            break
        i = joined.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def tokenizer_of(ranks: dict[bytes, int], pattern: str):
    """A tokenizer of the library that gives what the ranks give."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    pairs = (pair_of(t, r, ranks) for t, r in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1)
    merges = [(letters_of(p[0]), letters_of(p[1])) for p in pairs if len(p) == 2]
    out = Tokenizer(models.BPE(vocab={letters_of(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    out.decoder = decoders.ByteLevel()
    return out


class RankBpe:
    def __init__(self, path: str, pattern: str):
        self.tokenizer = tokenizer_of(ranks_of(path), pattern)
        vocab = self.tokenizer.get_vocab()
        self.bytes_of = {i: bytes_of(letters) for letters, i in vocab.items()}
        self.widths = np.zeros(max(vocab.values()) + 1, np.int64)
        for i, b in self.bytes_of.items():
            self.widths[i] = len(b)
        packed = lambda encode: lambda words: [np.array(x, "<u4").tobytes() for x in encode(words)]
        self.led, self.first = Remembered(packed(byte_level(self.tokenizer))), Remembered(packed(byte_level(self.tokenizer, "")))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of texts, each as little-endian unsigned 32-bit integers."""
        split = [units(t) for t in texts]
        first, led = self.first({x[0] for x in split}), self.led({u for x in split for u in x[1:]})
        get = led.__getitem__
        return [first[x[0]] + b"".join(map(get, x[1:])) for x in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The characters at which each token begins and ends."""
        ends = np.cumsum(self.widths[ids])
        # the number of characters that begin at or before a byte
        begun = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
        return begun[ends - self.widths[ids]] - 1 if len(ids) else ends, begun[ends - 1] if len(ids) else ends


@cache
def vocabulary(path: str, pattern: str) -> RankBpe:
    return RankBpe(path, pattern)


keeps(__name__, vocabulary.cache_clear)


def _texts(data: np.ndarray, at: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe, ints = vocabulary(path, pattern), pa.list_(pa.int32())
    for batch, data, at in chunks(batches, user=__name__):
        texts = _texts(data, at)
        ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.encode([t.decode() for t in texts])]
        places = [bpe.offsets(t, x) for t, x in zip(texts, ids, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, ints), pa.array([p[0].astype(np.int32) for p in places], ints), pa.array([p[1].astype(np.int32) for p in places], ints)], ["doc_id", "ids", "starts", "ends"])


def _decode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = vocabulary(path, pattern)
    for batch in batches:
        texts, added = [], []
        for ids in batch.column("ids").to_pylist():
            reader = codecs.getincrementaldecoder("utf-8")("replace")
            steps = [reader.decode(bpe.bytes_of[i]) for i in ids or []]
            rest = reader.decode(b"", True)
            if rest:
                steps[-1] += rest
            texts.append("".join(steps))
            added.append(steps)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(added, pa.list_(pa.string()))], ["doc_id", "text", "added"])


def _round_trip(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = vocabulary(path, pattern)
    for batch, data, at in chunks(batches, user=__name__):
        ids = bpe.encode([t.decode() for t in _texts(data, at)])
        n = [len(x) // 4 for x in ids]
        ids_hash = [hashlib.sha256(x).hexdigest() for x in ids]
        text_hash = [hashlib.sha256(bpe.decode(memoryview(x).cast("I").tolist())).hexdigest() for x in ids]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _two(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, and the characters at which each token starts and ends (array<int> each)."""
    return _two(docs, id_col, text_col).mapInArrow(partial(_encode, path=path, pattern=pattern), "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text and added (what each id adds to it) of rows of doc_id and ids."""
    return tokens.select("doc_id", "ids").mapInArrow(partial(_decode, path=path, pattern=pattern), "doc_id long, text string, added array<string>")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and digests of the ids (little-endian, 32 bits each) and of the bytes decoded from them."""
    return _two(docs, id_col, text_col).mapInArrow(partial(_round_trip, path=path, pattern=pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op12_rank_bpe": op12_rank_bpe}
ORACLES: dict[str, str] = {}
