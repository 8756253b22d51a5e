"""Maximum inner product search with score-aware (anisotropic) quantisation.

Vectors are cut into pairs of components; each pair has a codebook of 16 centroids, so a code takes
four bits. Codebooks and codes minimise, for a vector x and its residual r,

    |r|^2 + (eta - 1) <r, x / |x|>^2,   eta = (d - 1) T^2 / (1 - T^2),

which punishes the part of the residual that is parallel to x, as that part moves the largest inner
products. Codes are found by coordinate descent over the pairs, codebooks by weighted least squares,
on SAMPLE vectors at most (the smallest hashes of their ids); every vector is indexed.

A search goes block by block: all queries pass by each block of vectors, which is read once. Queries
travel as matrices of MATRIX rows, blocks are placed by ranges of their numbers, so that tasks get
like shares. A query's table of products with the centroids, two pairs to a byte, scores the block's
codes; the best RERANK of each block (at least one in RERANK_PART) get their exact product in double precision (of equal
approximations at the cut any stay), and the best K over all blocks stay.

Equal vectors are indexed once, with their K + 1 least ids, which is as many as any result can hold.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no
part, nor do vectors of another length than the commonest (the longer of ties), nor null ids; rows
that share an id count once, with the least vector; an empty table gives an empty result; other
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import table, written

K = 20
SAMPLE = 20_000
THRESHOLD = 0.2
#: Vectors of a block that are reranked for a query: so many, or a part of the block if that is more.
RERANK, RERANK_PART = 256, 64
BLOCK, BLOCKS, LARGEST_BLOCK = 4096, 128, 65536
CENTROIDS = 16
MATRIX = 256
_ROUNDS, _SWEEPS = 6, 2
#: Approximate products that a task holds at a time.
_SCORES = 1 << 22


def _pairs(x: np.ndarray) -> np.ndarray:
    """(n, d) as (n, pairs, 2), an even number of pairs, filled up with zeros."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % 4))).reshape(len(x), -1, 2)


def _eta(d: int, threshold: float) -> float:
    return max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))


def encode(x: np.ndarray, books: np.ndarray, eta: float, codes: np.ndarray | None = None, sweeps: int = _SWEEPS) -> np.ndarray:
    """Codes (n, pairs) of the vectors x under the codebooks (pairs, CENTROIDS, 2)."""
    p, unit = _pairs(x), _pairs(x / np.linalg.norm(x, axis=1, keepdims=True))
    n, pairs, _ = p.shape
    if codes is None:
        codes = np.stack([((p[:, m, None] - books[m]) ** 2).sum(2).argmin(1) for m in range(pairs)], axis=1)
    along = np.stack([((p[:, m] - books[m][codes[:, m]]) * unit[:, m]).sum(1) for m in range(pairs)], axis=1)
    total = along.sum(1)
    for _ in range(sweeps):
        for m in range(pairs):
            r = p[:, m, None] - books[m]
            par = (r * unit[:, m, None]).sum(2)
            rest = total - along[:, m]
            codes[:, m] = ((r**2).sum(2) + (eta - 1) * (rest[:, None] + par) ** 2).argmin(1)
            along[:, m] = par[np.arange(n), codes[:, m]]
            total = rest + along[:, m]
    return codes


def train(x: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Codebooks (pairs, CENTROIDS, 2) for the sample x."""
    p, unit = _pairs(x), _pairs(x / np.linalg.norm(x, axis=1, keepdims=True))
    n, pairs, _ = p.shape
    eta, rng = _eta(x.shape[1], threshold), np.random.Generator(np.random.PCG64(11))
    books = p[rng.integers(0, n, CENTROIDS)].transpose(1, 0, 2).copy()
    codes = None
    for turn in range(2 * _ROUNDS):
        e = eta if turn >= _ROUNDS else 1.0
        codes = encode(x, books, e, codes if turn >= _ROUNDS else None, 1 if turn >= _ROUNDS else 0)
        along = np.stack([((p[:, m] - books[m][codes[:, m]]) * unit[:, m]).sum(1) for m in range(pairs)], axis=1)
        total = along.sum(1)
        for m in range(pairs):
            u, c = unit[:, m], codes[:, m]
            want = total - along[:, m] + (p[:, m] * u).sum(1)
            left = np.zeros((CENTROIDS, 2, 2))
            right = np.zeros((CENTROIDS, 2))
            count = np.bincount(c, minlength=CENTROIDS)
            for i in range(2):
                right[:, i] = np.bincount(c, p[:, m, i] + (e - 1) * want * u[:, i], CENTROIDS)
                for j in range(2):
                    left[:, i, j] = np.bincount(c, (e - 1) * u[:, i] * u[:, j], CENTROIDS) + (count if i == j else 0)
            full = count > 0
            books[m][full] = np.linalg.solve(left[full], right[full][..., None])[..., 0]
            new = ((p[:, m] - books[m][c]) * u).sum(1)
            total += new - along[:, m]
            along[:, m] = new
    return books


def _array(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


#: A block of vectors (kind 0), or queries that pass by it (kind 1); members: where each vector's ids begin.
_ROW = "block int, kind int, ids binary, members binary, vectors binary, codes binary"
_NAMES = ["block", "kind", "ids", "members", "vectors", "codes"]


def _pack(batches: Iterator[pa.RecordBatch], d: int, books: np.ndarray, eta: float) -> Iterator[pa.RecordBatch]:
    """A row for each block: its vectors, their ids (members of all, one after another) and codes."""
    found: dict[int, list[tuple]] = {}
    for batch in batches:
        x, members = _array(batch.column("vector"), d), batch.column("members").to_pylist()
        for i, b in enumerate(batch.column("block").to_pylist()):
            found.setdefault(b, []).append((members[i], x[i]))
    for b, rows in found.items():
        x = np.stack([r[1] for r in rows])
        codes = encode(x, books, eta).astype(np.uint8)
        packed = codes[:, ::2] << 4 | codes[:, 1::2]
        values = [[b], [0], [np.concatenate([np.array(r[0], "<i8") for r in rows]).tobytes()], [np.cumsum([0, *(len(r[0]) for r in rows)]).astype("<i8").tobytes()], [x.tobytes()], [np.ascontiguousarray(packed.T).tobytes()]]
        types = (pa.int32(), pa.int32(), *(pa.binary(),) * 4)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], _NAMES)


def _bundle(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """Queries as matrices: a row for MATRIX of them at most."""
    for batch in batches:
        for k in range(0, batch.num_rows, MATRIX):
            part = batch.slice(k, MATRIX)
            yield pa.RecordBatch.from_arrays([pa.array([part.column("id").to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([_array(part.column("vector"), d).tobytes()], pa.binary())], ["ids", "vectors"])


def scan(q: np.ndarray, books: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Approximate products of queries (n, d) with all vectors of a block; packed: (bytes, vectors)."""
    products = np.einsum("nmk,mck->nmc", _pairs(q), books)
    two = (products[:, ::2, :, None] + products[:, 1::2, None, :]).reshape(len(q), len(packed), -1).astype(np.float32)
    out = two[:, 0][:, packed[0]]
    for k in range(1, len(packed)):
        out += two[:, k][:, packed[k]]
    return out


def _search(batches: Iterator[pa.RecordBatch], d: int, books: np.ndarray, k: int, rerank: int) -> Iterator[pa.RecordBatch]:
    x = packed = ids = at = None
    for batch in batches:
        kinds, columns = batch.column("kind").to_pylist(), {c: batch.column(c) for c in ("ids", "members", "vectors", "codes")}
        for i, kind in enumerate(kinds):
            own, vectors = np.frombuffer(columns["ids"][i].as_py(), "<i8"), np.frombuffer(columns["vectors"][i].as_py()).reshape(-1, d)
            if kind == 0:
                x, ids = vectors, own
                packed = np.frombuffer(columns["codes"][i].as_py(), np.uint8).reshape(-1, len(x))
                at = np.frombuffer(columns["members"][i].as_py(), "<i8")
            elif x is not None:
                step = max(1, _SCORES // len(x))
                yield _results([_nearest(q, v, a, x, ids, at, k, rerank) for s in range(0, len(own), step) for q, v, a in zip(own[s : s + step], vectors[s : s + step], scan(vectors[s : s + step], books, packed), strict=True)])


def _nearest(query: int, q: np.ndarray, approx: np.ndarray, x: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int, rerank: int) -> tuple:
    rerank = max(rerank, len(approx) // RERANK_PART)
    best = np.argpartition(-approx, rerank)[:rerank] if len(approx) > rerank else np.arange(len(approx))
    score, n = (x[best] * q).sum(1), at[best + 1] - at[best]
    owners = np.repeat(score, n)
    got = ids[np.repeat(at[best] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(len(owners))]
    keep = got != query
    got, owners = got[keep], owners[keep]
    order = np.lexsort((got, -owners))[:k]
    return np.full(len(order), query), got[order], owners[order]


def _results(found: list[tuple]) -> pa.RecordBatch:
    q, v, s = (np.concatenate(c) for c in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])


def search(vectors: DataFrame, every: int = 20, k: int = K, rerank: int = RERANK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each vector whose id `every` divides."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter("id is not null and vector is not null")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    v = v.filter(F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))
    v = v.groupBy("id").agg(F.min("vector").alias("vector"))
    counted = v.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if counted is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = counted["d"]
    v = written(v.filter(F.size("vector") == d), "vectors")
    order = Window.partitionBy("vector").orderBy("id")
    unique = v.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("members"))
    n = counted["count"]
    blocks = -(-n // min(LARGEST_BLOCK, max(BLOCK, n // BLOCKS)))
    sample = v.orderBy(F.crc32(F.col("id").cast("string")), "id").limit(SAMPLE).select("vector").toArrow().column("vector").combine_chunks()
    books = train(_array(sample, d))
    placed = unique.withColumn("block", F.pmod(F.xxhash64(F.element_at("members", 1)), F.lit(blocks)).cast("int"))
    packed = written(placed.repartitionByRange(blocks, "block").mapInArrow(partial(_pack, d=d, books=books, eta=_eta(d, THRESHOLD)), _ROW), "blocks")
    none = F.lit(None).cast("binary")
    bundles = v.filter(F.pmod("id", F.lit(every)) == 0).mapInArrow(partial(_bundle, d=d), "ids binary, vectors binary")
    queries = bundles.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "ids", none.alias("members"), "vectors", none.alias("codes"))
    found = packed.unionByName(queries).repartitionByRange(blocks, "block").sortWithinPartitions("block", "kind").mapInArrow(partial(_search, d=d, books=books, k=k, rerank=rerank), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


QUERIES = {"op7_anisotropic_search": op7_anisotropic_search}
ORACLES: dict[str, str] = {}
