"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the presences of n-grams of UTF-8 bytes (SIZES long, A-Z lowered, hashed into BUCKETS
bins). For each bin that a labelled training document holds, r = log of (documents of label 1 with it /
documents of label 0 with it), both smoothed and relative to the labels' totals; every such bin is a
feature of value r, drawn towards 0 the more the nearer r lies to its standard error (by z^2 / (z^2 +
SHRINK^2)), so that chance counts of rare n-grams don't drown the others. A logistic regression with an
L2 penalty is fitted on them by limited-memory quasi-Newton steps (L-BFGS), and gives the score.

Counts cover every labelled training document, one row for each range of bins and task; the regression
is fitted on SAMPLE_BYTES of labelled texts at most: of each label, in the order of the ids' hashes, as
many as its share of those bytes holds. The shares are those of the labels' texts, but LEAST_SHARE at
least; where that makes a label more frequent than it is, the bias is put right by the log of the odds.

Defined results: a null or empty text has no feature and gets the score of the bias alone; a null
label teaches nothing; several labels of one id count as their greatest; with labels of one kind only
(or none), every score is that kind's share (0 without any); null doc_ids meet no label and are not
held out; repeated rows each get a row; texts of any length count whole, one that alone exceeds a quarter
of its label's share of the sample counts in the ratios only; a label without any text in the sample (all
of them too long) leaves the ratios alone, unweighted, as the score; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import bucket_of, chunks, drop, give_back, numbered, table, written

SIZES = (3, 4, 5, 6)
BUCKETS, SLICES = 1 << 20, 32
#: Text that the regression is fitted on; the driver holds a number of 4 bytes for each n-gram of it at most.
SAMPLE_BYTES = 8 << 20
#: Bytes that any labelled id counts as at least, so that the sample's rows are bounded too.
LEAST_BYTES = 64
#: A label's part of the sample at least.
LEAST_SHARE = 1 / 16
#: Features that a step works on at a time.
STRIDE = 1 << 19
#: Bytes of a long text that are looked at together, and portions in which the sample comes to the driver.
PIECE, PORTIONS = 1 << 19, 8
THRESHOLD = 0.3
L2 = 0.3
#: Standard errors at which a ratio counts half.
SHRINK = 4.0
_SMOOTH = 1.0

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_FOLD += 1


def gram_bins(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, the bins of the n-grams of the texts in data, and the places where they begin."""
    x = _FOLD[data]
    ends = np.repeat(at[1:], np.diff(at))
    here = np.arange(len(data))
    h = np.zeros(len(data), np.uint32)
    for n in range(1, max(SIZES) + 1):
        h = h[: len(data) - n + 1] * np.uint32(0x01000193) + x[n - 1 :]
        if n in SIZES and len(h):
            ok = here[: len(h)][here[: len(h)] + n <= ends[: len(h)]]
            y = (h[ok] ^ (h[ok] >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n)
            yield (y * np.uint32(0x9E3779B1) >> np.uint32(12)).astype(np.int32), ok


def _present(data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct bins of each text. A long text alone is gone through piece by piece."""
    if len(at) == 2 and len(data) > PIECE:
        seen = np.zeros(BUCKETS, bool)
        for k in range(0, len(data), PIECE):
            piece = data[k : k + PIECE + max(SIZES) - 1]
            for bins, _ in gram_bins(piece, np.array([0, len(piece)])):
                seen[bins] = True
        yield np.flatnonzero(seen).astype(np.int32)
        return
    grams = [*gram_bins(data, at)]
    cuts = [np.searchsorted(where, at) for _, where in grams]
    last = np.zeros(BUCKETS, np.int32)
    for k in range(len(at) - 1):
        mine = np.concatenate([np.empty(0, np.int32), *(bins[c[k] : c[k + 1]] for (bins, _), c in zip(grams, cuts, strict=True))])
        order = np.arange(len(mine), dtype=np.int32)
        last[mine] = order  # of a bin's places the last one written stays
        yield mine[last[mine] == order]


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums, totals = np.zeros((2, BUCKETS), np.int32), np.zeros(2, np.int64)
    for batch, data, at in chunks(batches):
        for bins, label in zip(_present(data, at), batch.column("toxic").to_pylist(), strict=True):
            sums[label, bins] += 1
            totals[label] += 1
    if totals.any():
        rows = [(k, zlib.compress(np.ascontiguousarray(sums[:, k * (BUCKETS // SLICES) : (k + 1) * (BUCKETS // SLICES)]).tobytes(), 1), *map(int, totals)) for k in range(SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["slice", "counts", "n0", "n1"])


def _ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each slice that arrives, the ratio of every bin; 0 where no document holds it."""
    sums: dict[int, np.ndarray] = {}
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, counts, n0, n1 in zip(*(batch.column(c).to_pylist() for c in ("slice", "counts", "n0", "n1")), strict=True):
            x = np.frombuffer(zlib.decompress(counts), np.int32).astype(np.int64)
            sums[k] = sums[k] + x if k in sums else x
            totals[k] = totals.get(k, 0) + np.array([n0, n1])
    for k, x in sums.items():
        c0, c1 = x.reshape(2, -1)
        n0, n1 = map(int, totals[k])
        r = np.log((c1 + _SMOOTH) / (n1 + 2 * _SMOOTH)) - np.log((c0 + _SMOOTH) / (n0 + 2 * _SMOOTH))
        z = r**2 / (1 / (c1 + _SMOOTH) + 1 / (c0 + _SMOOTH))
        r *= z / (z + SHRINK**2)
        r[c0 + c1 == 0] = 0
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([r.tobytes()], pa.binary()), pa.array([n0]), pa.array([n1])], ["slice", "r", "n0", "n1"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, at in chunks(batches):
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([np.sort(x) for x in _present(data, at)], pa.list_(pa.int32()))], ["toxic", "features"])


#: Parts of the bins' numbers by their bits above the lowest sixteen.
_HIGH = BUCKETS >> 16


class Rows:
    """Ascending features of rows in two bytes each: their lowest sixteen bits, and of each row how many
    there are of every higher part. at: n + 1 row starts; what is asked for must begin and end with rows."""

    def __init__(self, at: np.ndarray):
        self.at, self.low, self.counts = at, np.empty(at[-1], np.uint16), np.zeros((len(at) - 1, _HIGH), np.uint32)

    def __getitem__(self, asked: slice) -> np.ndarray:
        a, b = np.searchsorted(self.at, [asked.start, asked.stop])
        high = np.repeat(np.tile(np.arange(_HIGH, dtype=np.int32) << 16, b - a), self.counts[a:b].ravel())
        return high | self.low[asked]

    def __setitem__(self, asked: slice, features: np.ndarray) -> None:
        a, b = np.searchsorted(self.at, [asked.start, asked.stop])
        self.low[asked] = features & 0xFFFF
        part = np.repeat(np.arange(b - a), np.diff(self.at[a : b + 1])) * _HIGH + (features >> 16)
        self.counts[a:b] = np.bincount(part, minlength=(b - a) * _HIGH).reshape(-1, _HIGH)

    def spans(self) -> list[slice]:
        """Whole rows, about STRIDE features at a time."""
        cuts = [0]
        while cuts[-1] < len(self.at) - 1:
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(self.at, self.at[cuts[-1]] + STRIDE, "right")) - 1))
        return [slice(int(self.at[a]), int(self.at[b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def fit(at: np.ndarray, feature: np.ndarray | Rows, y: np.ndarray, r: np.ndarray, l2: float = L2, steps: int = 60) -> np.ndarray:
    """Weights and, last, the bias of the logistic regression on r-scaled presences. at: n + 1 row starts."""
    m, cuts, i = len(r), [0], 0
    while i < len(y):  # whole rows, about STRIDE features at a time
        i = max(i + 1, int(np.searchsorted(at, at[i] + STRIDE, "right")) - 1)
        cuts.append(i)
    spans = [(a, b, np.diff(at[a : b + 1])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        v, s = r * w[:-1], np.full(len(y), w[-1])
        for a, b, n in spans:
            if (some := n > 0).any():
                s[a:b][some] += np.add.reduceat(v[feature[at[a] : at[b]]], (at[a:b] - at[a])[some])
        p = 1 / (1 + np.exp(-np.clip(s, -40, 40)))
        grad = np.zeros(m)
        for a, b, n in spans:
            grad += np.bincount(feature[at[a] : at[b]], np.repeat((p - y)[a:b], n), m)
        grad *= r
        np.multiply(w[:-1], l2, out=v)
        grad += v
        return float(np.logaddexp(0, s).sum() - (y * s).sum() + l2 / 2 * (w[:-1] @ w[:-1])), np.append(grad, (p - y).sum())

    w = np.zeros(m + 1)
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    f, g = loss(w)
    # steps taken and what they changed of the gradient, in single precision: they shape the next step alone
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    scale = 1 / max(1.0, np.linalg.norm(g))
    for _ in range(steps):
        q, back = g.copy(), []
        for s, d, both in reversed(past):
            a = float(s @ q) / both
            q -= np.float32(a) * d
            back.append(a)
        q *= scale
        for (s, d, both), a in zip(past, reversed(back), strict=True):
            q += s * np.float32(a - float(d @ q) / both)
        t = 1.0
        while True:
            new_f, new_g = loss(w - t * q)
            if new_f <= f - 1e-4 * t * (g @ q) or t < 1e-6:
                break
            t /= 2
        s, d = -t * q, new_g - g
        if (both := float(s @ d)) > 1e-12:
            scale = both / float(d @ d)
            past = [*past[-4:], (s.astype(np.float32), d.astype(np.float32), both)]
        del s, d
        done = abs(f - new_f) < 1e-7 * max(1, abs(f))
        w, f, g = w - t * q, new_f, new_g
        if done:
            break
    return w


def _score(batches: Iterator[pa.RecordBatch], weight, bias: float, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch, data, at in chunks(batches):
        p = _probability(data, at, weight.value, bias)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def _probability(data: np.ndarray, at: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(bias + np.array([weight[bins].sum() for bins in _present(data, at)]), -40, 40)))


def _keep(batches: Iterator[pa.RecordBatch], text: str, weight, bias: float, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch, data, at in chunks(batches, text):
        yield batch.filter(pa.array(_probability(data, at, weight.value, bias) < threshold))


def _sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """doc_id and toxic of the labelled ids that the regression is fitted on.

    Only ids of hashes so small that twice a label's share is expected of them are put in order, so the
    window over a label's rows holds no more than the share's bytes allow, however many labels there are."""
    size = F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(LEAST_BYTES)).cast("long")
    known = docs.select("doc_id", size.alias("size")).join(labels.hint("merge"), "doc_id").groupBy("doc_id", "toxic").agg(F.sum("size").alias("size"))
    known = written(known, "labelled")
    total = {r["toxic"]: r["size"] for r in known.groupBy("toxic").agg(F.sum("size").alias("size")).collect()}  # a row a label
    parts = {k: max(LEAST_SHARE, n / sum(total.values())) for k, n in total.items()}
    rows = known.withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40))
    out = known.select("doc_id", "toxic").limit(0)
    for k, part in parts.items():
        room = limit * part / sum(parts.values())
        mine = rows.filter((F.col("toxic") == k) & (F.col("size") <= room / 4) & (F.col("at") < 2 * room / total[k]))
        upto = F.sum("size").over(Window.orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
        out = out.unionByName(mine.withColumn("upto", upto).filter(F.col("upto") <= room).select("doc_id", "toxic"))
    return out


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, sample_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, float]:
    """The weights of the bins (r times w), and the bias."""
    labels = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (bucket_of("doc_id", modulus) != held_out)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    docs = docs.select("doc_id", "text").filter(bucket_of("doc_id", modulus) != held_out)
    labelled = docs.join(labels.hint("merge"), "doc_id").select("text", "toxic")
    got = labelled.mapInArrow(_presence, "slice int, counts binary, n0 long, n1 long").repartition(SLICES, "slice").mapInArrow(_ratios, "slice int, r binary, n0 long, n1 long").toPandas()
    n0, n1 = (int(got[c].max()) if len(got) else 0 for c in ("n0", "n1"))
    if not n0 or not n1:
        return np.zeros(BUCKETS), 40.0 if n1 and not n0 else -40.0
    r = np.zeros((SLICES, BUCKETS // SLICES))
    for k, x in zip(got["slice"], got["r"], strict=True):
        r[k] = np.frombuffer(x)
    r = r.ravel()
    y, at, feature = _gathered(docs.join(F.broadcast(_sample(docs, labels, sample_bytes)), "doc_id").select("text", "toxic"))
    if not 0 < y.sum() < len(y):
        return r, float(np.log(n1 / n0))
    # only bins that the sample holds get a weight, so the fit's vectors are no longer than that
    there = np.zeros(BUCKETS, bool)
    for span in feature.spans():
        there[feature[span]] = True
    held = np.flatnonzero(there)
    number = np.zeros(BUCKETS, np.int32)
    number[held] = np.arange(len(held))
    for span in feature.spans():
        feature[span] = number[feature[span]]
    w = fit(at, feature, y, r[held])
    del feature, number
    weight = np.zeros(BUCKETS)
    weight[held] = w[:-1] * r[held]
    give_back()
    return weight, float(w[-1] + np.log(n1 / n0) - np.log(y.sum() / (len(y) - y.sum())))


def _gathered(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, Rows]:
    """Labels, row starts and features of the sample, filled portion by portion."""
    found = rows.mapInArrow(_features, "toxic int, features array<int>")
    found = written(found.withColumn("portion", F.pmod(F.xxhash64("features"), F.lit(PORTIONS)).cast("int")), "features")
    n, total = found.agg(F.count("*"), F.coalesce(F.sum(F.size("features").cast("long")), F.lit(0))).first()
    at, labels, k, i = np.full(n + 1, total, np.int64), [], 0, 0
    at[0] = 0
    feature = Rows(at)
    for portion in range(PORTIONS):
        got = found.filter(F.col("portion") == portion).select("toxic", "features").toArrow()
        labels.append(got.column("toxic").to_numpy())
        for c in got.column("features").chunks:
            values = c.flatten().to_numpy()
            at[i + 1 : i + 1 + len(c)] = k + np.cumsum(np.diff(c.offsets.to_numpy()))
            feature[k : k + len(values)] = values
            k, i = k + len(values), i + len(c)
        del got
        pa.default_memory_pool().release_unused()
    drop(found)
    return np.concatenate(labels).astype(float), at, feature


def _two(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _labels(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("toxic"))


def classify(docs: DataFrame, labels: DataFrame, train: DataFrame | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", modulus: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted of each document. Learns from train's texts (or docs')."""
    weight, bias = learn(_two(docs if train is None else train, id_col, text_col), _labels(labels), modulus, held_out)
    weight = docs.sparkSession.sparkContext.broadcast(weight)
    rows = _two(docs, id_col, text_col).withColumn("held_out", bucket_of("doc_id", modulus) == held_out)
    return rows.mapInArrow(partial(_score, weight=weight, bias=bias, threshold=threshold), "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", modulus: int = 4, held_out: int = 2) -> DataFrame:
    """docs without the documents that are predicted toxic."""
    weight, bias = learn(_two(docs, id_col, text_col), _labels(labels), modulus, held_out)
    weight, rows = docs.sparkSession.sparkContext.broadcast(weight), numbered(docs)
    return rows.mapInArrow(partial(_keep, text=f"_{docs.columns.index(text_col)}", weight=weight, bias=bias, threshold=threshold), rows.schema).toDF(*docs.columns)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
