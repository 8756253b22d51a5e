"""Language identification as mixture inference.

Every word of a text comes from one of the learned languages, in proportions of the document's own.
A word's likelihood in a language is the product of its letter trigrams' (hashed into BUCKETS bins,
smoothed). Expectation-maximisation over the words estimates the proportions; the set of languages is
the one that backward elimination leaves under a penalised likelihood (PENALTY * log(words) for each
language beyond the first). As no set can be likelier than all languages together, a text whose best
single language is within one penalty of that needs no elimination.

The prediction is the language of the largest proportion, the score that proportion.

Trigram counts cover every training row; there is one sum for each language and range of bins. More
than MOST_LANGUAGES languages raise an error, as every worker holds all of them.

Defined results: `und` with score 0 for a null text, one without a letter, or when nothing was
learned; repeated rows each get a row (and count in training); ties go to the smaller language by
code point; a null doc_id is a training row (remainder 0); texts of any length count whole, one at a
time where they are long; an empty table gives an empty result;
other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import bucket_of, chunks, numbered, table

BUCKETS, SLICES = 1 << 15, 8
SMOOTHING = 0.5
PENALTY = 1.0
ROUNDS = 8
UNDETERMINED = "und"
#: Languages that can be learned; each takes 128 KB in the driver and in every worker.
MOST_LANGUAGES = 512
#: A word's likelihoods within a text are floored at this part of its best one.
_LEAST = 1e-30

_LETTER = np.zeros(256, np.uint32)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of the trigrams around each letter byte, the places in them where words begin, and those
    words' texts."""
    x = np.concatenate([[0], _LETTER[data], [0]]).astype(np.uint32)
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    before, after = x[:-2].copy(), x[2:].copy()
    before[inner] = 0
    after[inner - 1] = 0
    x = x[1:-1]
    here = np.flatnonzero(x)
    bins = ((before[here] | x[here] << np.uint32(8) | after[here] << np.uint32(16)) * np.uint32(2654435761) >> np.uint32(17)).astype(np.int32)
    begin = np.flatnonzero(before[here] == 0)
    return bins, begin, np.searchsorted(at, here[begin], "right") - 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch, data, at in chunks(batches):
        bins, begin, text = trigrams(data, at)
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        number = np.array([names.index(x) for x in langs])
        of = np.repeat(number[text], np.diff(np.append(begin, len(bins)))) if len(begin) else np.empty(0, np.int64)
        flat = np.bincount(of * BUCKETS + bins, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
        for k, name in enumerate(names):
            sums[name] = sums[name] + flat[k] if name in sums else flat[k]
    rows = [(name, k, part.astype("<i8").tobytes()) for name, s in sums.items() for k, part in enumerate(s.reshape(SLICES, -1))]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary()), strict=True)], ["lang", "slice", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        for lang, k, counts in zip(*(batch.column(c).to_pylist() for c in ("lang", "slice", "counts")), strict=True):
            x = np.frombuffer(counts, "<i8")
            sums[lang, k] = sums[lang, k] + x if (lang, k) in sums else x
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums]), pa.array([k[1] for k in sums], pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["lang", "slice", "counts"])


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages, and the log of each trigram bin's probability in each; docs: text and lang."""
    schema, rows = "lang string, slice int, counts binary", docs.filter("lang is not null and text is not null").select("text", "lang")
    # before any worker holds counts of each of them
    if rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn: join those that are one, or learn from fewer rows")
    got = rows.mapInArrow(_count, schema).repartition(SLICES * 4, "lang", "slice").mapInArrow(_add, schema).toPandas()
    langs = sorted(set(got.lang))
    n = np.zeros((len(langs), SLICES, BUCKETS // SLICES))
    for lang, k, counts in got.itertuples(index=False):
        n[langs.index(lang), k] += np.frombuffer(counts, "<i8")
    n = n.reshape(len(langs), BUCKETS) + SMOOTHING
    return langs, np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32)


def _fit(p: np.ndarray, begin: np.ndarray, n: np.ndarray, active: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods of texts; p: words by languages; begin, n: the texts' words."""
    share = active / active.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        r = p * np.repeat(share, n, axis=0)
        r /= r.sum(axis=1, keepdims=True) + 1e-300
        share = np.add.reduceat(r, begin, axis=0) / n[:, None]
    like = (p * np.repeat(share, n, axis=0)).sum(axis=1)
    return share, np.add.reduceat(np.log(like + 1e-300), begin)


def mixtures(log_likelihood: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Proportions (texts by languages) under the selected sets; a text without words has zeros."""
    langs = log_likelihood.shape[1]
    out = np.zeros((texts, langs))
    n_all = np.bincount(text, minlength=texts)
    have = np.flatnonzero(n_all)
    if not len(have):
        return out
    n = n_all[have]
    begin = np.concatenate([[0], np.cumsum(n)[:-1]])
    p = np.maximum(np.exp(log_likelihood - log_likelihood.max(axis=1, keepdims=True)), _LEAST)
    single = np.add.reduceat(np.log(p), begin, axis=0)
    best = single.argmax(axis=1)
    chosen = np.zeros((len(have), langs))
    chosen[np.arange(len(have)), best] = 1
    fee = PENALTY * np.log(n + 1.0)
    share, like = _fit(p, begin, n, np.ones((len(have), langs)))
    out[have] = chosen
    open_ = np.flatnonzero(like - fee > single.max(axis=1))
    if len(open_):
        rows = np.concatenate([np.arange(begin[k], begin[k] + n[k]) for k in open_])
        p, n, fee, share, like = p[rows], n[open_], fee[open_], share[open_], like[open_]
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        active = np.ones_like(share)
        going = np.ones(len(open_), bool)
        for _ in range(langs - 1):
            trial = active.copy()
            least = np.where(active > 0, share, np.inf).argmin(axis=1)
            trial[np.arange(len(trial)), least] = 0
            trial[trial.sum(axis=1) == 0] = 1
            new_share, new_like = _fit(p, begin, n, trial)
            going &= (new_like + fee >= like) & (active.sum(axis=1) > 1)
            if not going.any():
                break
            active[going], share[going], like[going] = trial[going], new_share[going], new_like[going]
        out[have[open_]] = share
    return out


def _shares(data: np.ndarray, at: np.ndarray, lettered: np.ndarray, langs: list[str], logp: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """The texts' proportions and predicted languages."""
    bins, begin, text = trigrams(data, at)
    ll = np.stack([np.add.reduceat(row[bins], begin) for row in logp], axis=1).astype(np.float64) if len(begin) and langs else np.zeros((0, max(1, len(langs))))
    share = mixtures(ll, text if len(ll) else text[:0], len(at) - 1)
    return share, [langs[i] if ok else UNDETERMINED for i, ok in zip(share.argmax(axis=1), lettered, strict=True)]


def _predict(batches: Iterator[pa.RecordBatch], langs: list[str], logp: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch, data, at in chunks(batches):
        lettered = np.array(batch.column("lettered").to_pylist(), bool) & bool(langs)
        share, lang = _shares(data, at, lettered, langs, logp)
        score = np.where(lettered, np.clip(share.max(axis=1), 0, 1), 0.0)
        found = [[{"lang": langs[i], "share": float(s[i])} for i in np.flatnonzero(s > 0)] if ok else [] for s, ok in zip(share, lettered, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
            ["doc_id", "held_out", "lang_pred", "score", "mixture"],
        )


def _keep(batches: Iterator[pa.RecordBatch], text: str, langs: list[str], logp: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch, data, at in chunks(batches, text):
        lettered = np.array(batch.column("lettered").to_pylist(), bool) & bool(langs)
        lang = _shares(data, at, lettered, langs, logp)[1]
        yield batch.select(batch.schema.names[:-1]).filter(pa.array([x != UNDETERMINED for x in lang], pa.bool_()))


def _learned(train: DataFrame, id_col: str, text_col: str, lang_col: str, modulus: int, held_out: int) -> tuple[list[str], np.ndarray]:
    return learn(train.filter(bucket_of(id_col, modulus) != held_out).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")))


def _lettered(text_col: str):
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("lettered")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, held_out: int = 2) -> DataFrame:
    """docs without the documents whose language is undetermined."""
    langs, logp = _learned(docs, id_col, text_col, lang_col, modulus, held_out)
    rows = numbered(docs, _lettered(text_col))
    return rows.mapInArrow(partial(_keep, text=f"_{docs.columns.index(text_col)}", langs=langs, logp=logp), rows.drop("lettered").schema).toDF(*docs.columns)


def identify(docs: DataFrame, train: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score and mixture of each document. Learns from train's rows (or
    docs') with a language whose crc32(id) mod `modulus` is not `held_out`."""
    langs, logp = _learned(docs if train is None else train, id_col, text_col, lang_col, modulus, held_out)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (bucket_of(id_col, modulus) == held_out).alias("held_out"), _lettered(text_col))
    return rows.mapInArrow(partial(_predict, langs=langs, logp=logp), "doc_id long, held_out boolean, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")


def op3_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).drop("mixture")


QUERIES = {"op3_language_mix": op3_language_mix}
ORACLES: dict[str, str] = {}
