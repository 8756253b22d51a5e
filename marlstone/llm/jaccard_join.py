"""N-gram Jaccard self-join by prefix filters under several global token orders, and its components.

A document's set holds its distinct SHINGLE-word shingles (A-Z lowered) as 64-bit hashes. Documents
with equal sets form one class; only classes are compared.

Under any global order of the shingles, two sets of Jaccard similarity t or more share one of the
first n - ceil(t n) + 1 shingles of each, their prefixes. The first order puts a fixed share of all
shingles, chosen by their hashes, before the others, and sorts that share by how many classes hold a
shingle. Those counts are exact and made where the shingles meet, in slices as many as the data needs:
a shingle that no other class holds goes no further, so only shared ones travel back to their classes,
and a class whose prefix holds none of them can link with nothing and is done. The other orders put
shingles of rarer bins first (a table of bins of fixed size) and break ties by hashes of their own; so
do the places after the counted share. The table only saves work: results don't depend on it. A
shingle of a crowded bin stands last in every order and is not counted, so that slices stay small.

Classes that share a prefix shingle under the first order, and whose sizes allow the similarity, are
candidates; they must also share one under each other order before their sets are fetched and compared
exactly.

From their first common shingle on, two sets share no more than what is left of either; with rare
shingles first, that bound leaves out copies that have gone too far from what they were copied from.

Copies need no pair each. First every class meets only the pivot of each list (of the classes with a
shingle in their prefix and sizes near each other): the class in which the shingle stands earliest,
which has the fewest shingles of its own. Links found so make components; after that a list whose
classes lie in one component holds nothing new, and only pairs of classes of different components
meet. So no link between components is missed, and a group of near copies costs a few pairs a member.

Defined results: a null or empty text has the empty set, n_shingles 0, and links with nothing; with
fewer words than a shingle has, the whole sequence is one shingle; rows that share a doc_id are one
node; a row without doc_id links with nothing and has no component; repeated rows each get a row; an
empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import chunks, distinct, drop, give_back, handed_back, mixed, numbered, table, word_hashes, written
from marlstone.operators.graph import components

SHINGLE = 3
#: Least similarity, as a whole number of hundredths.
PERCENT = 90
ORDERS = 3
#: Bins of the table of rarity (a power of two), and the slices in which they are summed.
BIN_BITS, SLICES = 22, 64
#: Shingles that a slice of the exact counts holds, about; a worker holds one slice at a time.
SLICE_TOKENS = 1_000_000
#: Shingles that a task holds before it sends them to their slices.
FLUSH = 1_000_000
#: Sets that a task remembers so as not to send a copy's prefix again.
SEEN = 500_000
#: Bits of the table that keeps most texts that need no comparison out of a shuffle.
FILTER_BITS = 24
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, cut = word_hashes(data, at)
    grams = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size if len(grams) else 0):
        grams += mixed(words[k : k + len(grams)] * _FACTORS[k % 8] + np.uint64(k))
    grams, out = mixed(grams), []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b - a >= size:
            out.append(distinct(grams[a : b - size + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for w in words[a:b]:
                short = mixed(np.array([short * _FACTORS[3] ^ w]))[0]
            out.append(np.array([short]))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    x = s * _FACTORS[4]
    return int(x.sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(mixed(s ^ _FACTORS[5]), initial=np.uint64(len(s))).astype(np.int64))


def _errs():
    return np.errstate(over="ignore")


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def counted_share(percent: int) -> int:
    """How many in 1024 shingles are counted: over twice a prefix's share, all at most."""
    return min(1024, (100 - percent) * 23)


def _bin(s: np.ndarray, bits: int) -> np.ndarray:
    return (s >> np.uint64(64 - bits)).astype(np.int64)


def _pack(counts: np.ndarray) -> bytes:
    """A task's counts: a byte for each bin, and what goes beyond a byte as (bin, rest)."""
    far = np.flatnonzero(counts > 255)
    low = zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes(), 1)
    return len(low).to_bytes(8, "little") + low + np.stack([far, counts[far] - 255]).astype("<i8").tobytes()


def _unpack(packed: bytes, into: np.ndarray) -> None:
    """Add packed counts."""
    cut = 8 + int.from_bytes(packed[:8], "little")
    into += np.frombuffer(zlib.decompress(packed[8:cut]), np.uint8)
    far, rest = np.frombuffer(packed[cut:], "<i8").reshape(2, -1)
    into[far] += rest


def _summaries(batches: Iterator[pa.RecordBatch], size: int, bits: int) -> Iterator[pa.RecordBatch]:
    """A row for each document with its set's size and digest; then the task's shingle counts."""
    names = ["doc_id", "n", "d1", "d2", "slice", "counts"]
    bins = np.zeros(1 << bits, np.int32)
    with _errs():
        for batch, data, at in chunks(batches):
            sets = shingle_sets(data, at, size)
            np.add.at(bins, _bin(np.concatenate(sets), bits), 1)
            d = [_digest(s) for s in sets]
            m = len(d)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
    if bins.any():
        counts = [_pack(x) for x in bins.reshape(SLICES, -1)]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(SLICES, pa.int64()) for _ in range(4)), pa.array(range(SLICES), pa.int32()), pa.array(counts, pa.binary())], names)


def _levels(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The summed counts of the slices that arrive, as levels: four to a doubling."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            x = sums.setdefault(k, np.zeros((1 << bits) // SLICES, np.int64))
            _unpack(counts, x)
    if sums:
        levels = [np.floor(np.log2(np.maximum(x, 1)) * 4).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["slice", "levels"])


def _order(s: np.ndarray, order: int, levels: np.ndarray) -> np.ndarray:
    """Sort keys of shingles under one of the orders by levels."""
    return levels[_bin(s, len(levels).bit_length() - 1)].astype(np.uint64) << np.uint64(56) | mixed(s ^ _FACTORS[order]) >> np.uint64(8)


def _first(s: np.ndarray, key: np.ndarray, m: int) -> np.ndarray:
    """The m shingles of the least keys, in their order."""
    first = np.argpartition(key, m - 1)[:m] if len(s) > m else np.arange(len(s))
    return s[first[np.argsort(key[first])]]


def _prefix(s: np.ndarray, order: int, levels: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set under one of the orders by levels, in that order."""
    return _first(s, _order(s, order, levels), prefix_length(len(s), percent))


#: Rows of three kinds: shingles to count (slice, task, blob); sets (owner, class, size, counted
#: shingles); prefix shingles that are not counted (owner, shingle, place).
_EMITTED = "kind int, x long, y long, z long, w long, blob binary"
_TOKENS, _CLASS, _PLACED = range(3)


def _emitted(kind: int, *columns: np.ndarray, blobs: list[bytes] | None = None) -> pa.RecordBatch:
    n = len(columns[0])
    longs = [pa.array(np.asarray(c).astype(np.int64)) for c in columns] + [pa.nulls(n, pa.int64())] * (4 - len(columns))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *longs, pa.array(blobs, pa.binary()) if blobs else pa.nulls(n, pa.binary())], ["kind", "x", "y", "z", "w", "blob"])


def _sliced(tokens: list[np.ndarray], owners: list[np.ndarray], slices: int, task: int) -> pa.RecordBatch:
    """The shingles held, a row for each slice: count, deflated steps between owners, shingles."""
    s, o = np.concatenate(tokens), np.concatenate(owners)
    k = ((s >> np.uint64(11) & np.uint64(0xFFFFFFFF)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)
    by = np.argsort(k, kind="stable")
    s, o, k = s[by], o[by], k[by]
    cuts = np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])), len(k))
    blobs = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        steps = zlib.compress(np.diff(o[a:b], prepend=0).astype("<u4").tobytes(), 1)
        blobs.append(int(b - a).to_bytes(8, "little") + s[a:b].astype("<u8").tobytes() + steps)
    return _emitted(_TOKENS, k[cuts[:-1]], np.full(len(blobs), task), blobs=blobs)


def _emit(batches: Iterator[pa.RecordBatch], levels: np.ndarray, size: int, percent: int, crowded: int, slices: int) -> Iterator[pa.RecordBatch]:
    """What the sets of a task's documents send on; a set of which the task has sent a copy sends nothing."""
    task, owner, held = TaskContext.get().partitionId(), 0, 0
    seen: set[int] = set()
    tokens: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    share, bits = np.uint64(counted_share(percent)), len(levels).bit_length() - 1
    with _errs():
        for _, data, at in chunks(batches):
            sets, c = [], []
            for s in shingle_sets(data, at, size):
                if not len(s) or (d := _digest(s)[0]) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(d)
                sets.append(s)
                c.append(d)
            if not sets:
                continue
            n = np.array([len(s) for s in sets])
            begin = np.append(0, np.cumsum(n))
            every = np.concatenate(sets)
            counted = ((every & np.uint64(1023)) < share) & (levels[_bin(every, bits)] < crowded)
            a = np.add.reduceat(counted.astype(np.int64), begin[:-1])
            ids = owner + np.arange(len(sets))
            tokens.append(every[counted])
            owners.append(np.repeat(ids, n)[counted])
            held += len(tokens[-1])
            placed = []
            for k in np.flatnonzero(a < [prefix_length(x, percent) for x in n]):
                rest = sets[k][~counted[begin[k] : begin[k + 1]]]
                more = _first(rest, _order(rest, 0, levels), prefix_length(int(n[k]), percent) - int(a[k]))
                placed.append((np.full(len(more), ids[k]), more.astype(np.int64), a[k] + np.arange(len(more))))
            base = task << 32
            yield _emitted(_CLASS, base + ids, np.array(c, np.int64), n, a)
            if placed:
                o, t, p = (np.concatenate(x) for x in zip(*placed, strict=True))
                yield _emitted(_PLACED, base + o, t, p)
            owner += len(sets)
            if held >= FLUSH:
                yield _sliced(tokens, owners, slices, task)
                tokens, owners, held = [], [], 0
    if held:
        yield _sliced(tokens, owners, slices, task)


def _held_by_more(parts: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Of a slice's shingles those with more than one owner, with their owners and how many they are."""
    tokens, owners = [], []
    for task, blob in parts:
        n = int.from_bytes(blob[:8], "little")
        tokens.append(np.frombuffer(blob, "<u8", n, 8))
        owners.append((task << 32) + np.cumsum(np.frombuffer(zlib.decompress(blob[8 + 8 * n :]), "<u4").astype(np.int64)))
    s, o = np.concatenate(tokens), np.concatenate(owners)
    by = np.argsort(s)
    s, o = s[by], o[by]
    count = np.diff(np.append(np.flatnonzero(np.append(True, s[1:] != s[:-1])), len(s)))
    count = np.repeat(count, count)
    keep = np.flatnonzero(count > 1)
    for k in range(0, len(keep), 100_000):
        at = keep[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(o[at]), pa.array(s[at].astype(np.int64)), pa.array(count[at])], ["owner", "token", "held"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by slice; a slice at a time is held."""
    parts: list[tuple[int, bytes]] = []
    at = None
    give_back()
    for batch in batches:
        for k, task, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if k != at and parts:
                yield from _held_by_more(parts)
                parts = []
            at = k
            parts.append((task, blob))
    if parts:
        yield from _held_by_more(parts)


def _postings(docs: DataFrame, levels, size: int, percent: int, total: int, bits: int, slice_tokens: int) -> DataFrame:
    """token, c, n and place: the prefixes of the classes under the first order, without shingles that
    no other class holds. What is left out before a place is counted, so places are those of whole sets."""
    slices = max(1, total * counted_share(percent) // 1024 // slice_tokens)
    crowded = math.ceil(math.log2(4 * total / (1 << bits) + 64) * 4)
    emitted = written(docs.mapInArrow(_with(_emit, levels, size=size, percent=percent, crowded=crowded, slices=slices), _EMITTED), "emitted")
    sets = emitted.filter(f"kind = {_CLASS}").groupBy(F.col("y").alias("c")).agg(F.min("x").alias("owner"), F.min("z").alias("n"), F.min("w").alias("counted"))
    counts = emitted.filter(f"kind = {_TOKENS}").select("x", "y", "blob").repartition(slices, "x").sortWithinPartitions("x").mapInArrow(handed_back(_shared), "owner long, token long, held long")
    w = Window.partitionBy("owner")
    place = F.col("counted") - F.count("*").over(w) + F.row_number().over(w.orderBy("held", "token")) - 1
    prefix = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1
    first = counts.join(sets, "owner").withColumn("place", place).filter(F.col("place") < prefix)
    rest = emitted.filter(f"kind = {_PLACED}").select(F.col("x").alias("owner"), F.col("y").alias("token"), F.col("z").alias("place")).join(sets, "owner")
    out = written(first.select("token", "c", "n", "place").unionByName(rest.select("token", "c", "n", "place")), "postings")
    drop(emitted)
    return out


def _sets(batches: Iterator[pa.RecordBatch], levels: np.ndarray, size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The sets of class representatives. Rows come sorted by (doc_id, c); a row whose set is not the
    class's (another row of that doc_id) goes, and so does a repeated one."""
    last = None
    with _errs():
        for batch, data, at in chunks(batches):
            out: list[tuple] = []
            for s, rep, c in zip(shingle_sets(data, at, size), batch.column("doc_id").to_pylist(), batch.column("c").to_pylist(), strict=True):
                if (rep, c) != last and _digest(s)[0] == c:
                    out.append((c, rep, b"".join(np.sort(_prefix(s, k, levels, percent)).tobytes() for k in range(1, ORDERS)), s.tobytes()))
                    last = rep, c
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["c", "rep", "prefixes", "grams"])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers two sorted arrays of distinct numbers share."""
    if not len(a) or not len(b):
        return 0
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates that share a prefix shingle under every other order too."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64).reshape(ORDERS - 1, -1), np.frombuffer(y, np.uint64).reshape(ORDERS - 1, -1)
            keep.append(all(_common(p, q) for p, q in zip(x, y, strict=True)))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("ga").to_pylist(), batch.column("gb").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = _common(x, y)
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("ra"), batch.column("rb")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs of classes, the links between their representatives."""
    p = sets.select("c", "prefixes")
    pairs = (
        pairs.join(p.select(F.col("c").alias("a"), F.col("prefixes").alias("pa")), "a")
        .join(p.select(F.col("c").alias("b"), F.col("prefixes").alias("pb")), "b")
        .select("a", "b", "pa", "pb")
        .mapInArrow(handed_back(_share), "a long, b long")
    )
    g = sets.select("c", "rep", "grams")
    return (
        pairs.join(g.select(F.col("c").alias("a"), F.col("rep").alias("ra"), F.col("grams").alias("ga")), "a")
        .join(g.select(F.col("c").alias("b"), F.col("rep").alias("rb"), F.col("grams").alias("gb")), "b")
        .select("ra", "rb", "ga", "gb")
        .mapInArrow(handed_back(partial(_verify, percent=percent)), "a long, b long")
        .filter("a <> b")
        .distinct()
    )


def _likely(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """docs without most of those whose doc_id is not needed, so that their texts need no shuffle: a
    table of 2 ** FILTER_BITS bits, at most 2 ** (FILTER_BITS - 6) rows to broadcast, says which may be."""
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    words = needed.select(h.alias("h")).groupBy(F.shiftright("h", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(h & 63)))").alias("bits"))
    placed = docs.withColumn("h", h).withColumn("w", F.shiftright("h", 6))
    return placed.join(F.broadcast(words), "w").filter("(shiftright(bits, int(h & 63)) & 1) = 1").select(*docs.columns)


def _possible(m: str, p: str, n: str, q: str, percent: int) -> Column:
    """Whether sets of sizes m and n whose first common shingle stands at places p and q can be similar
    enough: what they share is at most what is left from there in either."""
    return (F.least(F.col(m) - F.col(p), F.col(n) - F.col(q)) * (100 + percent)) >= ((F.col(m) + F.col(n)) * percent)


def join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", bits: int = BIN_BITS, slice_tokens: int = SLICE_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, component_id) of each document, and the links found between the
    representatives (least doc_ids) of classes of equal sets. bits and slice_tokens only change the work."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    summaries = written(docs.mapInArrow(partial(_summaries, size=size, bits=bits), "doc_id long, n long, d1 long, d2 long, slice int, counts binary"), "summaries")
    got = summaries.filter("slice is not null").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(handed_back(partial(_levels, bits=bits)), "slice int, levels binary").toPandas()
    levels = np.zeros((SLICES, (1 << bits) // SLICES), np.uint8)
    for k, x in got.itertuples(index=False):
        levels[k] = np.frombuffer(x, np.uint8)
    levels = docs.sparkSession.sparkContext.broadcast(levels.ravel())
    rows = written(summaries.filter("slice is null").select("doc_id", "n", "d1", "d2"), "rows")
    drop(summaries)
    classes = written(rows.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")).filter("rep is not null"), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0

    postings = _postings(docs.filter("doc_id is not null"), levels, size, percent, total, bits, slice_tokens)
    # sets of a similarity that allows a link lie in one size class or in neighbours, so share one of two
    width = -math.log(percent / 100) * (1 + 1e-9) if percent < 100 else 1e-9
    size_class = F.floor(F.log("n") / width)
    keyed = postings.select("token", "c", "n", "place", F.explode(F.array(size_class, size_class + 1)).alias("k"))
    pivot = F.min(F.struct("place", "c", "n"))
    lists = keyed.groupBy("token", "k").agg(F.min("c").alias("least"), F.max("c").alias("most"), pivot.alias("pivot")).filter("least <> most").select("token", "k", "pivot")
    shared = written(keyed.join(lists, ["token", "k"]), "shared")
    drop(postings)
    needed = written(shared.select("c").distinct().join(classes.select(F.col("d1").alias("c"), "rep"), "c").select(F.col("rep").alias("doc_id"), "c").distinct(), "needed")
    sets = written(_likely(docs, needed).join(needed, "doc_id").sortWithinPartitions("doc_id", "c").mapInArrow(_with(_sets, levels, size=size, percent=percent), "c long, rep long, prefixes binary, grams binary"), "sets")
    drop(needed)

    met = shared.select("c", "n", "place", F.col("pivot.c").alias("d"), F.col("pivot.n").alias("m"), F.col("pivot.place").alias("q"))
    first = written(met.filter((F.col("c") != F.col("d")) & _possible("n", "place", "m", "q", percent)).select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct(), "candidates")
    # a doc_id whose rows have different texts is one node: it joins their classes
    several = rows.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("d1").alias("least"), F.max("d1").alias("most")).filter("least <> most").select("doc_id")
    same = rows.join(several, "doc_id").join(classes, ["n", "d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b").distinct()
    near = written(_links(first, sets, percent), "links")
    found = components(near.unionByName(same))

    reps = sets.select("c", "rep").distinct()
    where = shared.select("token", "k", "c", "n", "place").join(reps, "c").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("token", "k", "c", "n", "place", F.coalesce("component", "rep").alias("comp"))
    apart = where.groupBy("token", "k").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("token", "k")
    open_ = written(where.join(apart, ["token", "k"]), "open")
    drop(shared)
    other = open_.select("token", "k", F.col("c").alias("b"), F.col("n").alias("nb"), F.col("place").alias("q"), F.col("comp").alias("compb"))
    rest = open_.select("token", "k", F.col("c").alias("a"), F.col("n").alias("na"), F.col("place").alias("p"), F.col("comp").alias("compa")).join(other, ["token", "k"])
    rest = rest.filter((F.col("a") < F.col("b")) & (F.col("compa") != F.col("compb")) & _possible("na", "p", "nb", "q", percent)).select("a", "b").distinct()
    rest = written(rest.join(first, ["a", "b"], "left_anti"), "candidates")
    drop(open_)
    drop(first)
    links, joined = near, found
    if not rest.isEmpty():
        links = written(near.unionByName(_links(rest, sets, percent)), "links")
        joined = components(links.unionByName(same))
        drop(near)
        drop(found)
    drop(rest)
    drop(sets)

    # rows meet their classes in one join of two tables, which Spark splits where many rows have one class
    placed = written(classes.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component")), "placed")
    drop(classes)
    drop(joined)
    out = rows.join(placed, ["n", "d1", "d2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out, links


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component (the least doc_id's) and every document without id."""
    found = join(docs, size, percent, id_col, text_col)[0]
    gone = found.filter("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct()
    rows, key = numbered(docs), f"_{docs.columns.index(id_col)}"
    named = rows.filter(F.col(key).isNotNull()).join(gone, F.col(key) == F.col("gone"), "left_anti")
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*rows.columns)))
    return named.withColumn("nth", nth).filter("nth = 1").drop("nth").unionByName(rows.filter(F.col(key).isNull())).toDF(*docs.columns)


def _with(f, levels, **more):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return f(batches, levels=levels.value, **more)

    return run


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))[0]


#: Brute force over all pairs of documents that share a shingle; quick enough on the whole small tables.
ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])) WHEN len(w) > 0 THEN [concat_ws(' ', array_to_string(w, ' '), '#')] ELSE [] END) AS s
    FROM words)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.node)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT doc_id, min(node) AS c FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""

QUERIES = {"op5_jaccard_join": op5_jaccard_join}
ORACLES = {"op5_jaccard_join": ORACLE}
