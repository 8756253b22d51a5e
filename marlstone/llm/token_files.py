"""Token-ID output: documents encoded by a public tokenizer and kept as ORC.

The files hold ascending document ids; each row is (doc_id, part, start_in_part, n_tokens, ids). ORC
writes the id runs with its integer run-length encoding, a row index every `row_index_stride` rows
with minimum and maximum of each column, and a Bloom filter on doc_id for each such group, so that

* a reader takes any stripe by itself (Spark splits ORC files at stripes), and
* a lookup by doc_id prunes files and stripes by the footers' minima and maxima and row groups by
  the Bloom filters, before it reads any token.

Defined results: a null text counts as empty and has the end id alone; null doc_ids come first;
repeated rows each get a row of their own (ties go by text); an empty table gives an empty result;
columns other than the id and the text are left out.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import chunks, keeps, shared_path, table

STRIPE_BYTES = 16 << 20
ROW_INDEX_STRIDE = 1000
BLOOM_FPP = 0.01
#: A file for about so many bytes of text on average.
FILE_BYTES = 64 << 20
#: Text that a task works on at a time: of more text, fewer words are distinct.
CHUNK_BYTES = 4 << 20
#: When a Python worker remembers the ids of more words than these (about 200 bytes each), it forgets.
KNOWN_WORDS = 450_000

_known: dict[str, dict[bytes, bytes]] = {}


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


#: A run of these letters is one pre-token of the model, and so are the marks after it.
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
_MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
#: Byte-level models write a byte as the character of its number, where that is printable.
_BYTE_LETTERS = {b: chr(b) for b in (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))}
_BYTE_LETTERS |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _BYTE_LETTERS)}
#: Those of the bytes of such letters that are not their own.
_ODD = [(chr(b), x) for b, x in _BYTE_LETTERS.items() if b in set("".join(map(chr, range(0xDF, 0x100))).encode()) and x != chr(b)]


def _plain(tokenizer) -> bool:
    """Whether a plain word goes to the model as it is, but for its bytes' letters."""
    try:
        return all(tokenizer.pre_tokenizer.pre_tokenize_str(w) and len(tokenizer.pre_tokenizer.pre_tokenize_str(w)) == 1 and tokenizer.normalizer.normalize_str(w) == w for w in ("abcz", "ßöøÿé")) and len(tokenizer.pre_tokenizer.pre_tokenize_str("ab,")) == 2
    except AttributeError:
        return False


@cache
def _model(path: str):
    """The library's model behind the tokenizer, where plain words can go to it directly."""
    return _tokenizer(path).model if _plain(_tokenizer(path)) else None


_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


def _ids(model, part: str) -> bytes:
    if not part.isascii():
        part = part.encode().decode("latin-1")
        for letter, by in _ODD:
            part = part.replace(letter, by)
    got = [x.id for x in model.tokenize(part)]
    return _PACK[len(got)](*got) if len(got) < 64 else struct.pack(f"<{len(got)}I", *got)


def encoded(words: list[bytes], path: str) -> dict[bytes, bytes]:
    """The ids of distinct words in their order, each as little-endian unsigned 32-bit integers.

    Most new words are plain letters, with marks after them at times: the library's model takes both
    as they are, which spares its pipeline for each; the pipeline takes all others. Letters and marks are
    known apart from each other. When too many are known, only those of the words at hand stay."""
    known, model = _known.setdefault(path, {}), _model(path)
    if len(known) > KNOWN_WORDS:
        here = {x for w in words for base in (w.rstrip(_MARKS),) for x in (w, base, w[len(base) :])}
        known = _known[path] = {x: known[x] for x in here if x in known}
    out: dict[bytes, bytes] = {}
    others, get = [], known.get
    for w in words:
        if (ids := get(w)) is None:
            base = w.rstrip(_MARKS)
            if (ids := get(base)) is None:
                letters = base.decode().lower() if model else ""
                if not (base.isalpha() and letters) and not _LETTERS.fullmatch(letters):
                    others.append(w)
                    out[w] = b""  # its place
                    continue
                ids = known[base] = _ids(model, letters)
            if len(base) < len(w):
                marks = w[len(base) :]
                if (more := get(marks)) is None:
                    more = known[marks] = _ids(model, marks.decode())
                ids += more
        out[w] = ids
    if others:
        new = dict(zip(others, (struct.pack(f"<{len(e.ids)}I", *e.ids) for e in _tokenizer(path).encode_batch([w.decode() for w in others], add_special_tokens=False)), strict=True))
        known.update(new)
        out.update(new)
    return out


keeps(__name__, _known.clear)


def lowered(texts: bytes) -> bytes:
    """A-Z lowered, as the model does anyway, so that fewer words are new; not where that could change ids: a
    letter with a combining mark composes before it is lowered, and names of special tokens are as they are."""
    return texts if b"\xcc" in texts or b"\xcd" in texts or b"<|" in texts else texts.lower()


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """The tokenizer splits at white space first and keeps none of it, so that the ids of a text are
    those of its words one after another, and a word needs encoding only once."""
    part, total, end = pyspark.TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
    for batch, data, at in chunks(batches, limit=CHUNK_BYTES, user=__name__):
        texts = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(lowered(data.tobytes())))
        words = pc.ascii_split_whitespace(texts)
        after, words = words.offsets.to_numpy()[1:], words.values.dictionary_encode()
        ids = [*encoded(words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist(), path).values(), end]
        # of each word of the texts, and of the end after each text: which it is, how many ids it has, where they begin
        which = np.insert(words.indices.to_numpy(), after, len(ids) - 1)
        lengths, flat = np.fromiter(map(len, ids), np.int64, len(ids)) // 4, np.frombuffer(b"".join(ids), "<i4")
        begins, n = (np.cumsum(lengths) - lengths)[which], lengths[which]
        ends = np.cumsum(n)
        flat = flat[np.repeat(begins - (ends - n), n) + np.arange(ends[-1])]
        ends = np.append(0, ends[after + np.arange(len(after))])
        n = np.diff(ends)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.full(len(n), part, np.int32)),
                pa.array(total + ends[:-1]),
                pa.array(n),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)),
            ],
            ["doc_id", "part", "start_in_part", "n_tokens", "ids"],
        )
        total += int(ends[-1])


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, files: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the encoded documents as ORC files of ascending ids in the folder `path`."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    (
        docs.repartitionByRange(files, "doc_id")
        .sortWithinPartitions("doc_id", F.coalesce("text", F.lit("")))
        .mapInArrow(partial(_encode, path=tokenizer_path, end_id=end_id), "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>")
        .write.option("compression", "zstd")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(ROW_INDEX_STRIDE))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(BLOOM_FPP))
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """What write_tokens() wrote. Filters on doc_id reach the stripes' statistics and Bloom filters."""
    return spark.read.schema("doc_id long, part int, start_in_part long, n_tokens long, ids array<int>").orc(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        at, flat = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("start_in_part"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of stored documents. A part's start is the number of ids
    in the parts before it: a running sum over one row a file."""
    parts = tokens.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    parts = parts.select("part", (F.sum("part_tokens").over(Window.orderBy("part")) - F.col("part_tokens")).alias("part_start"))
    rows = tokens.select("doc_id", "part", "start_in_part", "ids").mapInArrow(_digests, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return rows.join(parts, "part").select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, path = table(spark, sf_dir, "documents"), shared_path(spark, "tokens")
    files = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE_BYTES))
    write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), 2, max(files, spark.sparkContext.defaultParallelism))
    return token_digests(read_tokens(spark, path))


QUERIES = {"op1_token_orc": op1_token_orc}
ORACLES: dict[str, str] = {}
