"""Spelling variants by a symmetric-delete join.

Words are runs of LETTERS, A-Z lowered, of which a rule drops a letter here and there (`words`); those of
at least SHORTEST letters and LEAST occurrences count. Two words are near if one inserted, deleted or
replaced letter makes one of the other.

* Every word emits a hash of itself and of each distinct string that one deletion makes of it. Near words
  meet at one such key: at the shorter word, or at what both are without the letter in which they differ.
* Rows of keys carry 128-bit hashes of words, no words; pairs that meet are made distinct, take their
  words and are checked exactly.
* A key of n letters is met by itself and by its insertions alone, 90 * (n + 1) + 1 words at most, as
  there are 90 letters; so no key is hot however the texts are.
* A word's form is its near word of most occurrences, if those are RATIO times its own at least; so no
  chain of forms is longer than the digits of a count, and pointer doubling finds all roots in few joins.

Defined results: null and empty texts have no words; a null id is written as nothing before the colon of
the rule; repeated rows count as often as they are; a tie of forms goes to the smallest in code-point
order; an empty table gives an empty result; columns other than the id and the text are left out. A word
of any length counts, and costs about 100 bytes of a worker a letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import drop, give_back, mixed, table, written

LETTERS = "[A-Za-zÀ-ÿ]"
SHORTEST, LEAST, RATIO = 7, 2, 10
#: One run in so many loses a letter.
DELETES = 31
#: Letters of words that a worker looks at together.
LETTERS_AT_ONCE = 1 << 18
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_VALUES = np.random.Generator(np.random.PCG64(20250917)).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST, deletes: int = DELETES) -> DataFrame:
    """word and n: runs of letters, A-Z lowered. With h the crc32 of `<id>:<run>`, a run of which h is a
    multiple of `deletes` loses its letter h % length (counted from 0)."""
    # shorter runs make no word of enough letters, and a longer run is matched whole
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"{LETTERS}{{{shortest},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    rows = rows.select(F.when(F.col("h") % deletes == 0, less).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= shortest)
    return rows.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def deletions(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in data (a byte a letter, word k from at[k] on) and of their distinct single
    deletions, and the word of each. Equal strings have equal hashes; of equal neighbours the last is deleted."""
    n = np.diff(at)
    place = np.arange(len(data)) - np.repeat(at[:-1], n)
    powers = np.full(int(n.max(initial=0)) + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    total = np.append(np.uint64(0), np.cumsum(_VALUES[data] * powers[place], dtype=np.uint64))
    whole = total[at[1:]] - total[at[:-1]]
    owner = np.repeat(np.arange(len(n)), n)
    last = np.ones(len(data), bool)
    last[:-1] = (data[1:] != data[:-1]) | (owner[1:] != owner[:-1])
    i, of = np.flatnonzero(last), owner[last]
    # what stands behind the deleted letter moves up by one
    less = (total[i] - total[at[of]]) + (total[at[of + 1]] - total[i + 1]) * _BACK
    length = np.concatenate([n, n[of] - 1]).astype(np.uint64)
    return mixed(np.append(whole, less) + length * np.uint64(0xD6E8FEB86659FD93)).view(np.int64), np.append(np.arange(len(n)), of)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    give_back()
    for batch in batches:
        found, i = batch.column("word").to_pylist(), 0
        ends = np.cumsum([*map(len, found)])
        while i < len(found):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + LETTERS_AT_ONCE, "right")))
            part = found[i:j]
            data = np.frombuffer("".join(part).encode("latin-1"), np.uint8)  # the letters are those of Latin-1
            keys, of = deletions(data, np.append(0, np.cumsum([*map(len, part)])))
            for k in range(0, len(keys), LETTERS_AT_ONCE):
                mine = pa.array(of[k : k + LETTERS_AT_ONCE] + i)
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + LETTERS_AT_ONCE]), batch.column("a").take(mine), batch.column("b").take(mine)], ["key", "a", "b"])
            i = j


def near(counted: DataFrame) -> DataFrame:
    """Both ways round, each pair of near words once: word, n, other, other_n. counted: word, n."""
    known = counted.select(F.xxhash64("word").alias("a"), F.xxhash64(F.lit("second"), "word").alias("b"), "word", "n")
    keys = known.select("a", "b", "word").mapInArrow(_keys, "key long, a long, b long")
    other = keys.select("key", F.col("a").alias("a2"), F.col("b").alias("b2"))
    before = (F.col("a") < F.col("a2")) | ((F.col("a") == F.col("a2")) & (F.col("b") < F.col("b2")))
    pairs = keys.join(other.hint("merge"), "key").filter(before).select("a", "b", "a2", "b2").distinct()
    pairs = pairs.join(known.hint("merge"), ["a", "b"]).select("a2", "b2", "word", "n")
    pairs = pairs.join(known.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("word").alias("other"), F.col("n").alias("other_n")).hint("merge"), ["a2", "b2"])
    pairs = pairs.filter(F.levenshtein("word", "other", 1) == 1)
    one = lambda *c: F.struct(*(F.col(x).alias(y) for x, y in zip(c, ("word", "n", "other", "other_n"), strict=True)))
    return pairs.select(F.explode(F.array(one("word", "n", "other", "other_n"), one("other", "other_n", "word", "n"))).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """word and root, the last of the chain of forms that begins at the word; forms: word, form, without rings."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = at.join(step.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        further = written(joined, "roots")
        drop(at)
        if not further.filter("moved").limit(1).count():
            return further.select("word", "root")
        path, at = further._marlstone_path, further.select("word", "root")
        at._marlstone_path = path


def variants(counted: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of counted (word, n)."""
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other")))
    groups = near(counted).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    has = -F.col("best.less") >= F.col("n") * ratio
    groups = written(groups.select("word", "n_near", F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "near")
    out = counted.join(groups.hint("merge"), "word", "left").join(roots(groups.filter("form is not null").select("word", "form")).hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(written(words(table(spark, sf_dir, "documents")), "words"))


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
ORACLES: dict[str, str] = {}
