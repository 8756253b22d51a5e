"""What the training-data operators share: shared-folder tables, Arrow text access, word hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.shared import drop, shared_dir, shared_path, written

__all__ = ["bucket_of", "chunks", "distinct", "drop", "give_back", "handed_back", "keeps", "mixed", "numbered", "shared_dir", "shared_path", "table", "word_hashes", "written"]

#: Text that a Python worker works on at a time; bounds its memory whatever the batch size.
CHUNK_BYTES = 1 << 19
#: A word is a run of anything but these bytes.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def bucket_of(col: str | Column, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo modulus; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")) % modulus, F.lit(0))


#: What operators keep in a worker from task to task, by operator, and how it is let go.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(user: str, let_go: Callable[[], None]) -> None:
    """An operator keeps something in its workers; it is let go when another operator's work begins there."""
    _KEPT[user] = let_go


def give_back(user: str = "") -> None:
    """Hand memory that this worker holds but doesn't use back to the machine. Workers go on from stage to
    stage, and what one stage needed at most, or another operator keeps, would else stay with them."""
    for other, let_go in _KEPT.items():
        if other != user:
            let_go()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _then_back(batches: Iterator[pa.RecordBatch], run: Callable) -> Iterator[pa.RecordBatch]:
    give_back()
    try:
        yield from run(batches)
    finally:
        give_back()


def handed_back(run: Callable) -> Callable:
    """run over a task's batches, with memory handed back before and after."""
    return partial(_then_back, run=run)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES, user: str = "") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about limit bytes of text (one text at least), each with the UTF-8
    bytes of its texts and the n + 1 places where they begin and end. A null text is empty. user names the
    operator whose work this is (see keeps)."""
    give_back(user)
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
        n = len(texts)
        if not n:
            continue
        _, at, data = texts.buffers()
        at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j
        del batch, texts, at, data
    if not user:  # who keeps something needs the memory again at once
        give_back()


def numbered(docs: DataFrame, *more: Column) -> DataFrame:
    """docs' columns under the names _0, _1, ... so that more columns can't clash with them."""
    return docs.select(*(F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(docs.columns)), *more)


_MIX = np.random.Generator(np.random.PCG64(20240131)).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-known 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(1 << 16)
_WHITE = np.isin(np.arange(256), np.frombuffer(WHITE.encode(), np.uint8))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lowered) of the texts in data, and the n + 1 places in them
    where each text's words begin and end. Equal words have equal hashes, wherever they stand."""
    solid = ~_WHITE[data]
    marks = np.zeros(len(data) + 1, bool)
    marks[1:-1] = solid[1:] != solid[:-1]
    marks[at] = True
    cuts = np.flatnonzero(marks)
    begin = cuts[:-1][solid[cuts[:-1]]] if len(cuts) > 1 else cuts[:0]
    end = cuts[np.searchsorted(cuts, begin, "right")] if len(begin) else begin
    values = _MIX[_LOWER[data]]
    # sum of value * base^(place in the word), word after word; long words go on in blocks of the powers
    place = _places(begin, len(data))
    terms = values * _POWERS[place & 0xFFFF] + (place >> 16).astype(np.uint64) * _BASE
    terms[~solid] = 0
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    hashes = mixed(total[end] - total[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(begin, at)


def _places(begin: np.ndarray, n: int) -> np.ndarray:
    starts = np.zeros(n, np.int64)
    starts[begin] = begin
    return np.arange(n) - np.maximum.accumulate(starts)
