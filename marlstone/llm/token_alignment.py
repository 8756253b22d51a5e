"""Alignment of two tokenizers over the same bytes, by a sweep over the ends of their tokens.

A (byte-level BPE) encodes a space and the text, B (pieces with byte fallback) the text, to which it adds
that space itself; the bytes of both must be those of the space and the text, else a document has no
tokens. Every token is an event at the byte where it ends.

* Events travel packed, a row for each side and segment (SEGMENT units at most) of a document: its byte
  offset and the ids, whose lengths lead from one end to the next. Both sides' rows are one stream,
  partitioned by document and sorted within partitions on offset and side.
* The sweep goes through that stream with the state of one document: what it counted so far and the
  digest of its groups. An end that both sides share closes a group. Between any two neighbouring ends
  lie one A and one B token, which that stretch links.
* A document's pairs of linked ids go to a table, their counts are summed by task before they meet.
* The most frequent pairs (HEAVY at most, by classes of counts) go to all tasks as arrays; occurrences of
  rarer pairs meet their counts in a join, where no pair can be hot.

Segments end where a space follows anything but white space: tokens of both sides end there.

Defined results: texts null, empty, or of other bytes than their tokens have counts 0 and an empty
digest; repeated rows each get a row and count as often as they are; null doc_ids are ids; an empty table
gives an empty result; columns other than the id and the text are left out. A text of any length is gone
through segment by segment; the ids of one text are held while its bytes are compared.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.byte_words import Remembered, byte_level, bytes_of, units
from marlstone.llm.common import chunks, give_back, keeps, table, written

#: Space-led units of a segment, tokens that a sweep takes at a time, and pairs that a task sums at a time.
SEGMENT, SWEEP, SUMMED = 4096, 1 << 18, 1 << 21
#: Pairs whose counts every task holds (13 bytes each).
HEAVY = 1 << 20
#: Classes of counts: about so many to a doubling.
CLASSES = 8
#: The piece that marks a space, and those that stand for a byte.
SPACE = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")

EVENTS = "doc_id long, digest binary, offset long, side int, copies long, ids binary"
SWEPT = "doc_id long, digest binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


@cache
def _side_a(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pieces = {i: bytes_of(s) for s, i in spec["model"]["vocab"].items()}
    for x in spec["added_tokens"]:
        pieces.setdefault(x["id"], x["content"].encode())
    return byte_level(t), _in_order(pieces)


@cache
def _side_b(path: str):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    pieces = {}
    for i in range(sp.get_piece_size()):
        s = sp.id_to_piece(i)
        pieces[i] = bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(s)) else s.replace(SPACE, " ").encode()
    alone = [sp.piece_to_id(SPACE)]  # at a text's end; the library adds no space to nothing
    return lambda words: [x or alone for x in sp.encode(words, num_threads=1)] if words else [], _in_order(pieces)


def _in_order(pieces: dict[int, bytes]) -> list[bytes]:
    return [pieces.get(i, b"") for i in range(max(pieces) + 1)]


class Aligner:
    """Both vocabularies. Ids go packed as unsigned integers of 32 bits, or of 16 where those are enough."""

    def __init__(self, path_a: str, path_b: str):
        (encode_a, self.bytes_a), (encode_b, self.bytes_b) = _side_a(path_a), _side_b(path_b)
        self.kind = np.dtype("<u2" if max(len(self.bytes_a), len(self.bytes_b)) <= 1 << 16 else "<u4")
        self.code = np.dtype("<u4" if len(self.bytes_a) * len(self.bytes_b) < 1 << 32 else "<u8")
        self.width_a, self.width_b = (np.array([*map(len, x)], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.known = Remembered(lambda words: self._both(words, encode_a, encode_b))
        most = max(len(self.bytes_a), len(self.bytes_b))
        longest = len(str(most)) + 1
        self.decimal = np.zeros((3, most, longest), np.uint8)
        for k, mark in enumerate(b",|;"):
            for i in range(most):
                s = str(i).encode() + bytes([mark])
                self.decimal[k, i, : len(s)] = np.frombuffer(s, np.uint8)

    def _both(self, words: list[str], encode_a, encode_b) -> Iterator[tuple[bytes, bytes] | None]:
        whole = [b" " + w.encode() for w in words]
        sizes, joined = np.fromiter(map(len, whole), np.int64, len(whole)), b"".join(whole)
        packed, same = [], []
        for ids, pieces, width in ((encode_a(words), self.bytes_a, self.width_a), (encode_b(words), self.bytes_b, self.width_b)):
            ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat = [i for x in ids for i in x]
            numbers = np.array(flat, np.int64)
            upto = np.append(0, np.cumsum(width[numbers]))[ends]
            raw, at = numbers.astype(self.kind).tobytes(), [0, *(ends * self.kind.itemsize).tolist()]
            packed.append([raw[i:j] for i, j in zip(at[:-1], at[1:], strict=True)])
            if np.array_equal(np.diff(upto, prepend=0), sizes) and b"".join(map(pieces.__getitem__, flat)) == joined:
                same.append([True] * len(words))
            else:  # some word's tokens are not its bytes
                same.append([b"".join(map(pieces.__getitem__, x)) == w for x, w in zip(ids, whole, strict=True)])
        return ((a, b) if x and y else None for a, b, x, y in zip(*packed, *same, strict=True))

    def segments(self, texts: list[str]) -> Iterator[list[tuple[int, bytes, bytes]]]:
        """Byte offset, A's and B's ids of each text's segments; none where the tokens' bytes are others than the text's."""
        split = [units(t) for t in texts]
        known = self.known({u for x in split for u in x})
        for text, words in zip(texts, split, strict=True):
            both = [*map(known.__getitem__, words)]
            yield [] if not text or None in both else self._cut(words, both)

    def _cut(self, words: list[str], both: list[tuple[bytes, bytes]]) -> list[tuple[int, bytes, bytes]]:
        out, offset = [], 0
        for k in range(0, len(words), SEGMENT):
            ids_a, ids_b = zip(*both[k : k + SEGMENT], strict=True)
            out.append((offset, b"".join(ids_a), b"".join(ids_b)))
            offset += sum(len(w.encode()) + 1 for w in words[k : k + SEGMENT]) if k + SEGMENT < len(words) else 0
        return out


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _let_go() -> None:
    for kept in (aligner, _side_a, _side_b):
        kept.cache_clear()


keeps(__name__, _let_go)


def _events(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """The packed events; of a document without tokens one row of side -1."""
    both = aligner(*paths)
    for batch, data, at in chunks(batches, user=__name__):
        raw, copies = data.tobytes(), {}
        for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            key = doc_id, raw[a:b]
            copies[key] = copies.get(key, 0) + 1
        rows = []
        for ((doc_id, text), n), found in zip(copies.items(), both.segments([text.decode() for _, text in copies]), strict=True):
            digest = hashlib.blake2b(text, digest_size=16).digest()
            if not found:
                rows.append((doc_id, digest, 0, -1, n, b""))
            for offset, ids_a, ids_b in found:
                rows += [(doc_id, digest, offset, 0, n, ids_a), (doc_id, digest, offset, 1, n, ids_b)]
        yield _batch(rows, EVENTS)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split(" ") for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def links(ids_a: np.ndarray, ids_b: np.ndarray, width_a: np.ndarray, width_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two token sequences over the same bytes: the places of A's and B's tokens that each link holds,
    and how many A and B tokens lie before the end of each group. A link ends at each distinct end."""
    ends = np.concatenate([np.cumsum(width_a[ids_a]), np.cumsum(width_b[ids_b])])
    order = np.argsort(ends, kind="stable")
    ends, is_a = ends[order], order < len(ids_a)
    before = np.cumsum(is_a) - is_a  # A's ends before each, an equal one of A included
    new = np.append(True, ends[1:] != ends[:-1]) if len(ends) else is_a
    first, second = np.flatnonzero(new), np.flatnonzero(~new)
    return before[first], first - before[first], before[second], second - before[second] + 1


def grouped(ids_a: np.ndarray, ids_b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray, decimal: np.ndarray) -> tuple[bytes, np.ndarray]:
    """`a1,a2|b1;` of every group one after another, and the place in that where each group ends."""
    n_a, n_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
    idx = np.empty(len(ids_a) + len(ids_b), np.int64)
    mark = np.zeros(len(idx), np.int8)
    place_a = np.arange(len(ids_a)) + np.repeat(upto_b - n_b, n_a)
    place_b = np.arange(len(ids_b)) + np.repeat(upto_a, n_b)
    idx[place_a], idx[place_b] = ids_a, ids_b
    mark[upto_a + upto_b - n_b - 1] = 1
    mark[upto_a + upto_b - 1] = 2
    letters = decimal[mark, idx]
    solid = letters != 0
    ends = np.cumsum(np.count_nonzero(solid, axis=1))
    return letters[solid].tobytes(), ends[upto_a + upto_b - 1]


def _swept(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """Of a partition's events in order: a row with the linked pairs of each segment, and after a
    document's last segment a row with its counts and the digest of its groups."""
    give_back(__name__)
    both = aligner(*paths)
    pairs = len(both.bytes_a) * len(both.bytes_b)
    state: list = []  # of the document at hand: key, copies, n_a, n_b, n_groups, n_links, sha256
    out: list[tuple] = []

    def close() -> None:
        if state:
            key, copies, n_a, n_b, n_groups, n_links, sha = state
            out.append((*key, copies, n_a, n_b, n_groups, n_links, sha.hexdigest() if n_a else "", None, None))
            state.clear()

    def begin(key: tuple, copies: int) -> None:
        close()
        state.extend([key, copies, 0, 0, 0, 0, hashlib.sha256()])

    def sweep(held: list[list]) -> None:
        ids_a, ids_b = (np.frombuffer(b"".join([x[k] for x in held]), both.kind).astype(np.int64) for k in (3, 4))
        upto_a, upto_b = (np.cumsum([len(x[k]) // both.kind.itemsize for x in held]) for k in (3, 4))
        in_a, in_b, group_a, group_b = links(ids_a, ids_b, both.width_a, both.width_b)
        text, text_ends = grouped(ids_a, ids_b, group_a, group_b, both.decimal)
        n_groups = np.searchsorted(group_a, upto_a) + 1  # a segment's end ends a group
        n_links = np.searchsorted(in_a, upto_a - 1, "right")
        code = ids_a[in_a] * len(both.bytes_b) + ids_b[in_b]
        segment = np.searchsorted(upto_a, in_a, "right")
        held_pairs = np.sort(segment * pairs + code)
        first = np.flatnonzero(np.append(True, held_pairs[1:] != held_pairs[:-1]))
        times, distinct = np.diff(np.append(first, len(code))), held_pairs[first] % pairs
        cuts = np.searchsorted(first, n_links)
        a0 = b0 = g0 = l0 = c0 = t0 = 0
        for x, a1, b1, g1, l1, c1 in zip(held, upto_a.tolist(), upto_b.tolist(), n_groups.tolist(), n_links.tolist(), cuts.tolist(), strict=True):
            key, offset, copies = x[0], x[1], x[2]
            if not offset:
                begin(key, copies)
            t1 = int(text_ends[g1 - 1])
            state[6].update((b";" if offset else b"") + text[t0 : t1 - 1])
            for k, n in ((2, a1 - a0), (3, b1 - b0), (4, g1 - g0), (5, l1 - l0)):
                state[k] += n
            steps = np.diff(distinct[c0:c1], prepend=0).astype(both.code)
            out.append((*key, copies, None, None, None, None, None, _packed(steps), _packed(times[c0:c1].astype("<u4"))))
            a0, b0, g0, l0, c0, t0 = a1, b1, g1, l1, c1, t1

    held: list[list] = []  # segments: key, offset, copies, A's ids, B's ids
    size = 0
    for batch in batches:
        for doc_id, digest, offset, side, copies, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", "offset", "side", "copies", "ids")), strict=True):
            key = doc_id, digest
            if side < 0:
                if held:
                    sweep(held)
                    held, size = [], 0
                if not (state and state[0] == key):
                    begin(key, 0)
                state[1] += copies
            elif held and held[-1][0] == key and held[-1][1] == offset:
                if side and held[-1][4] is None:
                    held[-1][4] = ids
                elif not side:  # another such row: the same tokens, counted once more
                    held[-1][2] += copies
            else:
                if size > SWEEP * both.kind.itemsize:
                    sweep(held)
                    held, size = [], 0
                held.append([key, offset, copies, ids, None])
                size += len(ids)
        if out:
            yield _batch(out, SWEPT)
            out = []
    if held:
        sweep(held)
    close()
    if out:
        yield _batch(out, SWEPT)


def _packed(x: np.ndarray) -> bytes:
    """zstd of the array's bytes, plane by plane, after its length."""
    return len(x).to_bytes(8, "little") + pa.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: np.dtype) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], n * kind.itemsize, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).ravel()


def _pairs(batch: pa.RecordBatch, kind: np.dtype) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row, distinct pairs in order, and how often the row's segment links each."""
    for k, (pairs, times) in enumerate(zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist(), strict=True)):
        yield k, np.cumsum(_unpacked(pairs, kind).astype(np.int64)), _unpacked(times, np.dtype("<u4")).astype(np.int64)


def _summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.empty(0, np.int64)
    return code[first], np.add.reduceat(n[order], first) if len(first) else first


def _counts(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    give_back(__name__)
    kind = aligner(*paths).code
    codes, times, held, size = [], [], 0, 0
    row = lambda c, n: pa.RecordBatch.from_arrays([pa.array(c), pa.array(n)], ["pair", "n"])
    for batch in batches:
        for (_, code, n), copies in zip(_pairs(batch, kind), batch.column("copies").to_pylist(), strict=True):
            codes.append(code)
            times.append(n * copies)
            size += len(code)
            if size > held + SUMMED:
                code, n = _summed(np.concatenate(codes), np.concatenate(times))
                held = size = len(code)
                codes, times = [code], [n]
                if held > SUMMED:
                    yield row(code, n)
                    codes, times, held, size = [], [], 0, 0
    if codes:
        yield row(*_summed(np.concatenate(codes), np.concatenate(times)))


_SCORED = "doc_id long, digest binary, pair long, times long, n_best long, count_sum long"


def _scored(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], heavy) -> Iterator[pa.RecordBatch]:
    """Of each segment, sums over its frequent pairs (under a pair below 0) and its other pairs as rows."""
    give_back(__name__)
    kind, (known, count, best) = aligner(*paths).code, heavy.value
    for batch in batches:
        out: list[list[np.ndarray]] = []
        spread = 0
        for k, code, n in _pairs(batch, kind):
            at = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
            found = known[at] == code if len(known) else np.zeros(len(code), bool)
            m, n_found = at[found], n[found]
            spread += 1
            rest = code[~found]
            out.append([np.full(len(rest) + 1, k), np.append(-spread, rest), np.append(0, n[~found]), np.append(n_found[best[m]].sum(), np.zeros(len(rest), np.int64)), np.append((n_found * count[m]).sum(), np.zeros(len(rest), np.int64))])
        if out:
            rows, *numbers = (np.concatenate(c) for c in zip(*out, strict=True))
            keys = batch.select(["doc_id", "digest"]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*keys.columns, *map(pa.array, numbers)], ["doc_id", "digest", "pair", "times", "n_best", "count_sum"])


def events(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The end events of both sides, packed: EVENTS."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(partial(_events, paths=(path_a, path_b)), EVENTS)


def swept(events_: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """SWEPT: rows with the linked pairs of each segment (other numbers null), and a row for each document
    (pairs null) with its counts and the digest of its groups."""
    stream = events_.repartition("doc_id", "digest").sortWithinPartitions("doc_id", "digest", "offset", "side")
    return stream.mapInArrow(partial(_swept, paths=(path_a, path_b)), SWEPT)


def pair_counts(links_: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """pair (a * B's size + b), n (links that hold it), best (whether no pair of that b has more)."""
    counts = links_.select("copies", "pairs", "times").mapInArrow(partial(_counts, paths=(path_a, path_b)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = written(counts, "pair-counts")
    # a row for each id of B at most
    most = counts.groupBy((F.col("pair") % len(aligner(path_a, path_b).bytes_b)).alias("b")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), F.col("pair") % len(aligner(path_a, path_b).bytes_b) == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _heavy(counts: DataFrame, most: int) -> tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The lowest class of counts that is taken, and the pairs of it and of those above, most together."""
    sizes = counts.groupBy("class").count().collect()  # a row for each class: some hundreds
    cut, room = 1 << 30, most
    for k, n in sorted(((r["class"], r["count"]) for r in sizes), reverse=True):
        if n > room:
            break
        cut, room = k, room - n
    got = counts.filter(F.col("class") >= cut).select("pair", "n", "best").sort("pair").toArrow()
    return cut, tuple(got.column(c).to_numpy() for c in ("pair", "n", "best"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document."""
    spark, paths = docs.sparkSession, (path_a, path_b)
    all_rows = written(swept(events(docs, path_a, path_b, id_col, text_col), path_a, path_b), "links")
    links_, facts = all_rows.filter(F.col("pairs").isNotNull()), all_rows.filter(F.col("pairs").isNull())
    counts = pair_counts(links_, path_a, path_b).withColumn("class", F.floor(F.log2("n") * CLASSES).cast("int"))
    cut, arrays = _heavy(counts, heavy)
    scored = links_.select("doc_id", "digest", "pairs", "times").mapInArrow(partial(_scored, paths=paths, heavy=spark.sparkContext.broadcast(arrays)), _SCORED)
    rare = counts.filter(F.col("class") < cut).select("pair", "n", "best")
    scored = scored.join(rare.hint("merge"), "pair", "left").select(
        "doc_id", "digest",
        (F.col("n_best") + F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        (F.col("count_sum") + F.coalesce(F.col("times") * F.col("n"), F.lit(0))).alias("count_sum"),
    )
    names = ["copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    both = facts.select("doc_id", "digest", *names, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum")).unionByName(scored, allowMissingColumns=True)
    out = both.groupBy("doc_id", "digest").agg(*(F.max(c).alias(c) for c in names), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op11_token_alignment": op11_token_alignment}
ORACLES: dict[str, str] = {}
