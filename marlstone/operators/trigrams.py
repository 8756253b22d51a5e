"""An index of texts by their runs of three characters, for substring search without reading the texts.

A text belongs to a chunk of neighbours; of each chunk and each run of three folded characters (gram) that
occurs in it, one row holds the places. Rows lie in Parquet files range-partitioned and sorted by gram and
chunk, so that a query's filter on its grams prunes files and row groups by their statistics, and a frequent
gram spreads over many files. A query takes the grams that cover it; where all stand in a text at fitting
places, the text holds the query there. Documents' keys, lengths and kept columns lie in a second table
sorted by chunk, of which only the chunks that were hit are read where they are few.

Two characters are searched by the range of the grams that begin with them; the ends of texts are padded.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.shared import shared_path

#: Characters of a chunk's texts (a longer text is a chunk of its own), and bytes of a row group.
CHUNK, ROW_GROUP = 2 << 20, 4 << 20
#: Chunks that a filter names one by one.
FEW_CHUNKS = 1000
#: Bytes of postings that a file is to have, characters of the sample that says where files begin.
FILE_BYTES, SAMPLE_CHARS = 64 << 20, 8 << 20
POSTINGS = "gram long, chunk long, blob binary"
_DOCS = -1


def gram(text: str) -> int:
    """Three characters as a number that sorts as they do."""
    a, b, c = map(ord, text)
    return a << 42 | b << 21 | c


def grams_of(query: str) -> list[tuple[int, int]]:
    """Grams that cover a query of three characters and more, and where they begin in it."""
    last = len(query) - 3
    return [(gram(query[k : k + 3]), k) for k in sorted({*range(0, last, 3), last})]


def packed(x: np.ndarray) -> bytes:
    """Ascending numbers as zstd of the planes of their differences' bytes, after their count."""
    steps = np.diff(x, prepend=0).astype("<i8")
    return len(x).to_bytes(8, "little") + pa.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], n * 8, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view("<i8").ravel())


def postings(texts: list[str]) -> Iterator[tuple[int, bytes]]:
    """Each gram of the texts with its places: the text's number and, in the low 32 bits, the character's."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(t + "\0\0" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    begin = np.cumsum(sizes + 2) - sizes - 2
    number = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = begin[number] + place
    grams = points[at] << 42 | points[at + 1] << 21 | points[at + 2]
    order = np.argsort(grams, kind="stable")
    grams, codes = grams[order], (number << 32 | place)[order]
    cuts = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.empty(0, np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(grams)], strict=False):
        yield int(grams[a]), packed(codes[a:b])


def _segments(batches: Iterator[pa.RecordBatch], fields: int, most: int, bounds: np.ndarray, files: int) -> Iterator[pa.RecordBatch]:
    """Postings of chunk after chunk, and under _DOCS each chunk's other columns as an Arrow stream. part: the
    file of a row, by the bounds between the files of postings (a gram that is a bound spreads over the files
    on its sides), behind which `files` more take the other columns."""
    import pyspark

    task, count = pyspark.TaskContext.get().partitionId(), 0

    def rows(found: list[tuple]) -> pa.RecordBatch:
        grams, chunks, blobs = zip(*found, strict=True)
        g, c = np.array(grams, np.int64), np.array(chunks, np.int64)
        mixed = (c >> 32) * 7919 + (c & 0xFFFFFFFF)
        low = np.searchsorted(bounds, g, "left")
        spread = low + mixed % (np.searchsorted(bounds, g, "right") - low + 1)
        part = np.where(g == _DOCS, len(bounds) + 1 + mixed % files, spread).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(g), pa.array(c), pa.array(blobs, pa.binary()), pa.array(part)], ["gram", "chunk", "blob", "part"])

    def chunk(part: pa.RecordBatch, texts: list[list[str]]) -> Iterator[pa.RecordBatch]:
        nonlocal count
        name, count = task << 32 | count, count + 1
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(part)
        found = [(_DOCS, name, sink.getvalue())]
        for g, blob in postings([t[k] for k in range(len(texts[0])) for t in texts]):
            found.append((g, name, blob))
            if len(found) == 20_000:
                yield rows(found)
                found = []
        if found:
            yield rows(found)

    for batch in batches:
        texts = [[x or "" for x in batch.column(k).to_pylist()] for k in range(fields)]
        rest = batch.select(list(range(fields, batch.num_columns)))
        i = 0
        while i < batch.num_rows:
            j, size = i, 0
            while j < batch.num_rows and (j == i or size + sum(len(t[j]) for t in texts) <= most):
                size += sum(len(t[j]) for t in texts)
                j += 1
            yield from chunk(rest.slice(i, j - i), [t[i:j] for t in texts])
            i = j


def _documents(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            for part in pa.ipc.open_stream(blob):
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, name)), pa.array(np.arange(n)), *part.columns], ["chunk", "n", *names])


def _found(batches: Iterator[pa.RecordBatch], plans: list[tuple[str, list]], fields: int) -> Iterator[pa.RecordBatch]:
    """Of each chunk, the documents with a hit and how many hits each query has in them."""
    for batch in batches:
        out: list[tuple] = []
        for name, held in zip(batch.column("chunk").to_pylist(), batch.column("held").to_pylist(), strict=True):
            places = {x["gram"]: unpacked(x["blob"]) for x in held}
            hits = []
            for route, parts in plans:
                if route == "plain":
                    low, high = parts
                    docs = [np.unique((p >> 32) // fields) for g, p in places.items() if low <= g < high]
                    hits.append(np.unique(np.concatenate([*docs, np.empty(0, np.int64)])))
                    continue
                begins = None
                for p, k in sorted(((places.get(g), k) for g, k in parts), key=lambda x: -1 if x[0] is None else len(x[0])):
                    p = np.empty(0, np.int64) if p is None else p - k
                    begins = p if begins is None else np.intersect1d(begins, p, assume_unique=True)
                hits.append((begins if begins is not None else np.empty(0, np.int64)) >> 32)
                hits[-1] //= fields
            docs = np.unique(np.concatenate([*hits, np.empty(0, np.int64)]))
            counts = np.array([np.bincount(np.searchsorted(docs, h), minlength=len(docs)) for h in hits]).T
            out += [(name, d, c) for d, c in zip(docs.tolist(), counts.tolist(), strict=True)]
        columns = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["chunk", "n", "hits"])


@dataclass(frozen=True)
class Index:
    """An index in a folder: of how many fields of texts, how many documents, their average length."""

    spark: SparkSession
    path: str
    key: str
    fields: int
    rows: int
    average: float

    def documents(self) -> DataFrame:
        """chunk, n, the key, the kept columns and size (runs of three characters) of each document."""
        return self.spark.read.parquet(f"{self.path}/documents")

    def postings(self) -> DataFrame:
        return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")

    def selected(self, plans: list[tuple[str, list]]) -> DataFrame:
        """The postings that the queries need."""
        grams = sorted({g for route, parts in plans if route == "bm25" for g, _ in parts})
        needed: Column = F.col("gram").isin(grams)
        for route, parts in plans:
            if route == "plain":
                needed = needed | ((F.col("gram") >= parts[0]) & (F.col("gram") < parts[1]))
        return self.postings().filter(needed)

    def hits(self, routes: list[tuple[str, str]]) -> DataFrame:
        """chunk, n and hits (of each query, in order) of the documents with any. routes: folded query and
        how it is searched: bm25 (occurrences), plain (two characters: 1 if they are there), none."""
        plans = [(how, grams_of(q) if how == "bm25" else [gram(q + "\0"), gram(q + "\0") + (1 << 21)] if how == "plain" else []) for q, how in routes]
        grouped = self.selected(plans).groupBy("chunk").agg(F.collect_list(F.struct("gram", "blob")).alias("held"))  # a chunk's rows are bounded by its size
        return grouped.mapInArrow(partial(_found, plans=plans, fields=self.fields), "chunk long, n long, hits array<long>")

    def facts(self, found: DataFrame, *columns: str) -> DataFrame:
        """found (chunk, n and more) with columns of the documents."""
        chunks = [r.chunk for r in found.select("chunk").distinct().limit(FEW_CHUNKS + 1).collect()]
        docs = self.documents().select("chunk", "n", *columns)
        if len(chunks) <= FEW_CHUNKS:
            docs = docs.filter(F.col("chunk").isin(chunks))
        return found.join(docs, ["chunk", "n"])


def build(rows: DataFrame, key: str, fields: tuple[str, ...], keep: tuple[str, ...] = (), path: str | None = None, chunk: int = CHUNK) -> Index:
    """Index the fields of rows; keep names columns that the index gives back besides the key."""
    spark = rows.sparkSession
    path = path or shared_path(spark, "trigrams")
    length = F.greatest(F.coalesce(F.char_length(fields[0]), F.lit(0)) - 2, F.lit(0))
    for f in fields[1:]:
        length = length + F.greatest(F.coalesce(F.char_length(f), F.lit(0)) - 2, F.lit(0))
    names = [key, *keep, "size"]
    plain = rows.select(*(T.fold(F.col(f)).alias(f"_{k}") for k, f in enumerate(fields)), key, *keep, length.cast("long").alias("size"))
    n, total = rows.select(length.cast("long").alias("size")).agg(F.count("*"), F.sum("size")).first()
    total = total or 0
    segments = lambda df, bounds, files: df.mapInArrow(partial(_segments, fields=len(fields), most=chunk, bounds=bounds, files=files), POSTINGS + ", part int")
    bounds = _bounds(segments(plain.sample(min(1.0, SAMPLE_CHARS / max(total, 1)), 1), np.empty(0, np.int64), 1), total)
    files = len(bounds) // 4 + 1
    # one shuffle makes postings and documents: both see one and the same run of a chunk's task
    (
        segments(plain, bounds, files).repartitionById(len(bounds) + 1 + files, F.col("part")).drop("part").sortWithinPartitions("gram", "chunk")
        .write.option("parquet.block.size", str(ROW_GROUP)).option("compression", "uncompressed").parquet(f"{path}/postings")
    )
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.select(*names).schema)
    stored = spark.read.schema(POSTINGS).parquet(f"{path}/postings").filter(F.col("gram") == _DOCS)
    stored.select("chunk", "blob").mapInArrow(partial(_documents, names=names), f"chunk long, n long, {kinds}").write.option("parquet.block.size", str(ROW_GROUP)).parquet(f"{path}/documents")
    return Index(spark, path, key, len(fields), n, total / n if n else 0.0)


def _bounds(sample: DataFrame, total: int) -> np.ndarray:
    """Grams at which files of postings end, so that they are about equal by bytes: from a sample's postings,
    as Spark's own ranges are but for their being equal by rows, of which those of frequent grams are large."""
    files = -(-total * 4 // FILE_BYTES)
    if files < 2:
        return np.empty(0, np.int64)
    seen = sample.filter(F.col("gram") != _DOCS).groupBy("gram").agg(F.sum(F.length("blob") + 32).alias("bytes")).orderBy("gram").toArrow()
    ends = np.cumsum(seen.column("bytes").to_numpy())
    if not len(ends):
        return np.empty(0, np.int64)
    return seen.column("gram").to_numpy()[np.searchsorted(ends, ends[-1] * np.arange(1, files) / files)].astype(np.int64)


#: Indexes that a session has built, by what they are of.
_BUILT: dict[tuple, Index] = {}


def fingerprint(rows: DataFrame) -> tuple:
    """Names, sizes and times of the files that rows are read from."""
    spark = rows.sparkSession
    out = []
    for name in rows.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(sorted(out))


def index_of(rows: DataFrame, name: str, key: str, fields: tuple[str, ...], keep: tuple[str, ...] = ()) -> Index:
    """The index of rows that this session has, built where there is none or the files have changed.
    name says how rows are made of their files."""
    mark = (rows.sparkSession.sparkContext.applicationId, name, key, fields, keep, fingerprint(rows))
    if mark not in _BUILT:
        _BUILT[mark] = build(rows, key, fields, keep)
    return _BUILT[mark]
