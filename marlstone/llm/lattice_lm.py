"""LM scoring: the marginal probability of a document over all segmentations of its words.

A text is lower-cased (A-Z), cut into words, and closed by one end token. The vocabulary of the
lattice is that of an existing public tokenizer (its pieces, as bytes), to which the corpus gives
unigram scores, and one unit for each training word that crosses the word's whole lattice:

* unit: (c - D) / N for a token with c > 0 of the N training tokens, D the absolute discount;
* spelled: D * V / N times the sum, over every segmentation of the word's bytes into pieces, of the
  product of the pieces' scores and the stop's. A forward recursion in log space gives that sum:
  alpha[j] = logsumexp over pieces s[i:j] of alpha[i] + log q(piece).

Both add up to one over all words, so scores are those of a proper distribution. The pieces' scores
are expected counts over the distinct training words (expectation-maximisation with the same lattice,
from scores that fall with a piece's rank, as public tokenizers here have ranks, no probabilities); one
sum per piece comes to the driver, as many as the vocabulary has. Token counts cover every training document. The commonest words (HEAD at most, by a
threshold on their counts) are looked up in each task; all others meet their counts in a join.

Defined results: a null text counts as empty (the end token alone); a null doc_id counts as
remainder 0 (held out); repeated rows count and are scored each; without any
training document units have no mass and the end token has probability 1/2; an empty table gives an
empty result; columns other than the id and the text are left out.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import bucket_of, chunks, mixed, table, written

HEAD = 1 << 16
EM_ROUNDS = 3
#: Distinct words that a task counts before it hands the counts on.
COUNTED = 200_000
_STOP_START, _RANK_START, _FLOOR = 0.15, 200, 0.01
_LN10 = float(np.log(10))


class Pieces:
    """A tokenizer's pieces without white space, A-Z lowered, and every single byte."""

    def __init__(self, path: str):
        ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                piece, rank = line.split()
                piece = base64.b64decode(piece).removeprefix(b" ").lower()
                if piece.split() == [piece]:
                    ranks[piece] = min(int(rank), ranks.get(piece, int(rank)))
        for b in range(256):
            ranks.setdefault(bytes([b]), len(ranks))
        self.pieces = list(ranks)
        self.ranks = np.array(list(ranks.values()))
        self.at = {p: i for i, p in enumerate(self.pieces)}
        #: Lengths that pieces have, the longest first.
        self.lengths = np.array(sorted({len(p) for p in self.pieces}, reverse=True))
        rng = np.random.Generator(np.random.PCG64(7))
        self.letters = rng.integers(1, 2**63, 256, dtype=np.uint64)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        keys = np.array([self._key(p) for p in self.pieces], np.uint64)
        self.bits = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.mask = (1 << (64 - int(self.bits))) - 1
        self.keys, self.ids = np.zeros(self.mask + 1, np.uint64), np.full(self.mask + 1, -1, np.int32)
        for i, k in enumerate(keys):
            slot = int(k >> self.bits)
            while self.ids[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.ids[slot] = k, i

    def _key(self, piece: bytes) -> int:
        with np.errstate(over="ignore"):
            h = sum(int(self.letters[b]) * pow(int(self.base), j, 1 << 64) for j, b in enumerate(piece)) & (2**64 - 1)
            return int(mixed(np.array([h + len(piece)], np.uint64))[0]) or 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The pieces' numbers, -1 where there is none."""
        slot = (keys >> self.bits).astype(np.int64)
        out = self.ids[slot]
        far = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        out[far] = -1
        slot = slot[far]
        while len(far):
            slot = (slot + 1) & self.mask
            hit = self.keys[slot] == keys[far]
            out[far[hit]] = self.ids[slot[hit]]
            go = ~hit & (self.ids[slot] >= 0)
            far, slot = far[go], slot[go]
        return out

    def starts(self, j: int) -> np.ndarray:
        """Where pieces that end at j may begin, nearest last."""
        i = j - self.lengths
        return i[i >= 0]

    def edges(self, words: np.ndarray) -> list[np.ndarray]:
        """words: (n, length) bytes. For each end j, the numbers of the pieces s[i:j], (n, len(starts(j)))."""
        n, length = words.shape
        powers = np.full(length, self.base, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        back = np.full(length, self.inverse, np.uint64)
        back[0] = 1
        back = np.multiply.accumulate(back)
        total = np.zeros((n, length + 1), np.uint64)
        np.cumsum(self.letters[words] * powers, axis=1, out=total[:, 1:])
        out = []
        for j in range(1, length + 1):
            i = self.starts(j)
            keys = mixed((total[:, j : j + 1] - total[:, i]) * back[i] + (j - i).astype(np.uint64))
            keys[keys == 0] = 1
            out.append(self.find(keys.ravel()).reshape(n, len(i)))
        return out


@cache
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def _groups(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length at a time: their places and bytes."""
    lengths = np.array([len(w) for w in words], np.int64)
    order = np.argsort(lengths, kind="stable")
    i = 0
    while i < len(order):
        length = int(lengths[order[i]])
        j = min(int(np.searchsorted(lengths[order], length, "right")), i + max(1, 200_000 // length))
        yield order[i:j], np.frombuffer(b"".join([words[k] for k in order[i:j]]), np.uint8).reshape(j - i, length)
        i = j


def _forward(pieces: Pieces, edges: list[np.ndarray], logq: np.ndarray) -> np.ndarray:
    n = len(edges[0])
    alpha = np.zeros((n, len(edges) + 1))
    for j, ids in enumerate(edges, 1):
        x = alpha[:, pieces.starts(j)] + logq[ids]
        most = x.max(axis=1)
        alpha[:, j] = most + np.log(np.exp(x - most[:, None]).sum(axis=1))
    return alpha


def spelled(words: list[bytes], pieces: Pieces, logq: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability over all segmentations; logq: of the pieces, then the stop."""
    out, logq, stop = np.zeros(len(words)), np.append(logq[:-1], -np.inf), logq[-1]
    for at, group in _groups(words):
        out[at] = _forward(pieces, pieces.edges(group), logq)[:, -1] + stop
    return out


def expected(words: list[bytes], pieces: Pieces, logq: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces and the stop in the words, each taken once."""
    out, logq = np.zeros(len(pieces.pieces) + 1), np.append(logq[:-1], -np.inf)
    for _, group in _groups(words):
        edges = pieces.edges(group)
        alpha = _forward(pieces, edges, logq)
        beta = np.full_like(alpha, -np.inf)
        beta[:, -1] = 0
        for j in range(len(edges), 0, -1):
            i = pieces.starts(j)
            step = logq[edges[j - 1]] + beta[:, j : j + 1]
            found = edges[j - 1] >= 0
            out[:-1] += np.bincount(edges[j - 1][found], np.exp(alpha[:, i] + step - alpha[:, -1:])[found], len(pieces.pieces))
            beta[:, i] = np.logaddexp(beta[:, i], step)
        out[-1] += len(group)
    return out


def start_scores(pieces: Pieces) -> np.ndarray:
    """Scores that fall with the rank a piece has in its tokenizer."""
    q = 1 / (pieces.ranks + _RANK_START)
    return np.log(np.append(q / q.sum() * (1 - _STOP_START), _STOP_START))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def handed() -> Iterator[pa.RecordBatch]:
        for trained, counts in enumerate(seen):
            if counts:
                total = pa.array(list(counts.values()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), total if trained else pa.array(np.zeros(len(counts), np.int64)), total], ["word", "c", "total"])
                counts.clear()

    for batch, data, at in chunks(batches):
        raw = data.tobytes().lower()
        for a, b, held_out in zip(at[:-1], at[1:], batch.column("held_out").to_pylist(), strict=True):
            seen[not held_out].update(raw[a:b].split())
        if len(seen[0]) + len(seen[1]) > COUNTED:
            yield from handed()
    yield from handed()


def _expect(batches: Iterator[pa.RecordBatch], path: str, logq: np.ndarray) -> Iterator[pa.RecordBatch]:
    pieces, out = pieces_of(path), None
    for batch in batches:
        x = expected([w.encode() for w in batch.column("word").to_pylist()], pieces, logq)
        out = x if out is None else out + x
    if out is not None:
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["piece", "n"])


class Model:
    """What scoring a token needs besides its count."""

    def __init__(self, path: str, n: int, v: int, n_docs: int, n1: int, n2: int, logq: np.ndarray):
        self.path, self.n, self.logq, self.docs = path, n, logq, n_docs
        discount = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
        self.discount = discount
        self.rest = discount * v / n if n else 0.5
        self.base_rest = n + 0.1 * (v + 1)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / self.base_rest)

    def end(self) -> tuple[float, float]:
        """Base score and score of the end token."""
        return float(self.base(np.array([self.docs]))[0]), float(np.log10((self.docs - self.discount) / self.n)) if self.docs else float(np.log10(0.5))

    def scores(self, words: list[bytes], c: np.ndarray) -> np.ndarray:
        spell = np.log(self.rest) + spelled(words, pieces_of(self.path), self.logq)
        with np.errstate(divide="ignore"):
            unit = np.log(np.where(c > 0, c - self.discount, 0) / max(1, self.n))
        return np.logaddexp(unit, spell) / _LN10


def _score_words(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = batch.column("c").to_numpy()
        scores = model.scores([w.encode() for w in batch.column("word").to_pylist()], c)
        yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(c > 0).cast(pa.int64()), pa.array(model.base(c)), pa.array(scores)], ["word", "w_known", "w_base", "w_score"])


def _score_docs(batches: Iterator[pa.RecordBatch], head: dict[bytes, tuple[int, float, float]], end: tuple[float, float], known_end: int) -> Iterator[pa.RecordBatch]:
    """For each document a row with the sums over its common words, under a key that is no word;
    for each of its other words a row with the number of times it occurs."""
    row, get = pyspark.TaskContext.get().partitionId() << 36, head.get
    for batch, data, at in chunks(batches):
        raw = data.tobytes().lower()
        rows, words, times, ids, held, n, known, base, score = [], [], [], [], [], [], [], [], []
        for a, b, doc_id, held_out in zip(at[:-1], at[1:], batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), strict=True):
            row += 1
            tokens = raw[a:b].split()
            k, x, y, far, far_n = known_end, *end, [], []
            for w, t in Counter(tokens).items():
                if h := get(w):
                    k += t * h[0]
                    x += t * h[1]
                    y += t * h[2]
                else:
                    far.append(w)
                    far_n.append(t)
            m = len(far)
            rows += [row] * (m + 1)
            words += [b" %d" % row, *far]
            times += [0, *far_n]
            pad = [None] * m
            ids += [doc_id, *pad]
            held += [held_out, *pad]
            n += [len(tokens) + 1, *pad]
            known += [k, *pad]
            base += [x, *pad]
            score += [y, *pad]
        types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        columns = [pa.array(x, t) for x, t in zip((rows, words, times, ids, held, n, known, base, score), types, strict=True)]
        columns[1] = columns[1].cast(pa.string())
        yield pa.RecordBatch.from_arrays(columns, ["row", "word", "times", "doc_id", "held_out", "n_tokens", "d_known", "d_base", "d_score"])


def score(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", modulus: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of each document."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (bucket_of(id_col, modulus) == 0).alias("held_out"))
    counted = docs.mapInArrow(_count, "word string, c long, total long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))
    words = written(counted, "words")
    n_docs = docs.filter("not held_out").count()
    known = F.col("c") > 0
    stats = words.agg(F.sum("c"), F.count(F.when(known, 1)), F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1))).first()
    n, v, n1, n2 = (x or 0 for x in stats)
    pieces = pieces_of(path)
    logq = start_scores(pieces)
    for _ in range(EM_ROUNDS if v else 0):
        got = words.filter(known).select("word").mapInArrow(partial(_expect, path=path, logq=logq), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        q = np.full(len(logq), _FLOOR)
        q[got.piece] += got.n
        logq = np.log(q / q.sum())
    model = Model(path, n + n_docs, v + bool(n_docs), n_docs, n1, n2, logq)
    # the head: whole classes of counts (16 to a doubling), from the top, while they hold HEAD words at most
    level, most, room = F.floor(F.log2("total") * 16), None, HEAD
    for r in words.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if (room := room - r["count"]) < 0:
            break
        most = r["level"]
    head: dict[bytes, tuple[int, float, float]] = {}
    if most is not None:
        top = words.filter(level >= most).select("word", "c").toPandas()
        keys, c = [w.encode() for w in top.word], top.c.to_numpy()
        head = dict(zip(keys, zip((c > 0).astype(int).tolist(), model.base(c).tolist(), model.scores(keys, c).tolist(), strict=True), strict=True))
    rest = words.filter(level < most) if most is not None else words
    rest = rest.select("word", "c").mapInArrow(partial(_score_words, model=model), "word string, w_known long, w_base double, w_score double")
    rows = docs.mapInArrow(
        partial(_score_docs, head=head, end=model.end(), known_end=int(n_docs > 0)),
        "row long, word string, times long, doc_id long, held_out boolean, n_tokens long, d_known long, d_base double, d_score double",
    )
    both = lambda d, w: F.coalesce(F.col(d), F.col("times") * F.col(w))
    return (
        rows.join(rest, "word", "left")
        .select("row", "doc_id", "held_out", "n_tokens", both("d_known", "w_known").alias("known"), both("d_base", "w_base").alias("base"), both("d_score", "w_score").alias("score"))
        .groupBy("row")
        .agg(*(F.max(x).alias(x) for x in ("doc_id", "held_out", "n_tokens")), F.sum("known").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
        .drop("row")
    )


def op2_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


QUERIES = {"op2_lattice_score": op2_lattice_score}
ORACLES: dict[str, str] = {}
