"""The index against scans: ranks, routes, texts of any kind, what is read, changed files."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import search as S
from marlstone.operators import trigrams as X

TEXTS = [None, "", "a", "ab", "abc", "Abcabcab cab", "ΣΑΣ σας", "注意力机制与注意力", "注意", "x\0yz", "İstanbul", "🙂👍🏽 ok 🙂👍", "aaaaaa", "the theme, other THE"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("abc é\n") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    data = [(k, rng.choice(TEXTS), t, rng.choice(["en", "fr", None])) for k, t in enumerate(texts)]
    return spark.createDataFrame(data, "id long, title string, body string, lang string").repartition(3).cache()


@pytest.fixture(scope="module", params=[1 << 20, 200])
def index(rows, request):
    return X.build(rows, "id", ("title", "body"), ("lang",), chunk=request.param)


QUERIES = ["abc", "ab", "a", "", "aaa", "the", "ΣΑΣ", "注意", "注意力", "力机制与", "🙂👍🏽", "cab ", "abcabc", "zzz", "c é\nb", " x\0y "]


def listed(df):
    return sorted((r.id, r.lang, [None if x is None else round(x, 9) for x in r.ranks]) for r in df.collect())


def test_ranks_equal_those_of_a_scan(rows, index):
    assert (index.rows, index.fields) == (rows.count(), 2)
    want = listed(S.ranks(rows, QUERIES, ("title", "body")).select("id", "lang", "ranks"))
    assert listed(S.indexed_ranks(index, QUERIES, "lang")) == want and len(want) > 200
    for q in QUERIES:
        want = S.search(rows, q, ("title", "body"), "id").select("id", F.round("rank", 9)).collect()
        got = S.indexed_search(index, q).select("id", F.round("rank", 9)).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)), q


def test_unknown_grams_read_nothing_and_rare_ones_little(rows, index):
    size = lambda q: index.selected([("bm25", X.grams_of(q))]).agg(F.coalesce(F.sum(F.length("blob")), F.lit(0))).first()[0]
    assert size("qqq") == 0 < size("other") <= size("aaaa") + size("abca")
    plan = index.selected([("bm25", X.grams_of("other"))])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan


def test_files_hold_ranges_of_grams(index):
    spark = index.spark
    ranges = spark.read.parquet(f"{index.path}/postings").groupBy(F.col("_metadata.file_name").alias("f")).agg(F.min("gram").alias("a"), F.max("gram").alias("b")).orderBy("a").collect()
    assert all(x.b <= y.a for x, y in zip(ranges[:-1], ranges[1:], strict=True))


def test_pools_and_fusion(rows, index):
    for queries in (["abc", "the", "注意"], ["aaa"]):
        assert [tuple(r) for r in S.fuse(index, queries, (), "id", 20).collect()] == [tuple(r) for r in S.fuse(rows, queries, ("title", "body"), "id", 20).collect()]


def test_places_are_kept_as_they_are():
    for x in ([], [0], [3, 3 << 32, (1 << 62)]):
        assert X.unpacked(X.packed(np.array(x, np.int64))).tolist() == x
    got = dict(X.postings(["abab", "", "b"]))
    assert {g: X.unpacked(b).tolist() for g, b in got.items()} == {X.gram("aba"): [0], X.gram("bab"): [1], X.gram("ab\0"): [2], X.gram("b\0\0"): [3, 2 << 32]}


def test_empty_table_and_new_files(spark, rows, tmp_path):
    assert S.indexed_search(X.build(rows.limit(0), "id", ("title", "body")), "abc").count() == 0
    path = str(tmp_path / "t")
    rows.filter("id < 9").write.parquet(path)
    read = lambda: X.index_of(spark.read.parquet(path), "t", "id", ("body",))
    first = read()
    assert read() is first
    rows.filter("id >= 9").write.mode("append").parquet(path)
    assert read() is not first and read().rows == rows.count()


def test_files_are_about_equal_by_bytes(rows, monkeypatch):
    """One frequent gram's postings are spread and no file has most of the bytes; nothing is written twice."""
    monkeypatch.setattr(X, "FILE_BYTES", 4096)
    texts = rows.select("id", F.concat(F.repeat(F.lit("abab"), 40), F.coalesce("body", F.lit(""))).alias("body")).cache()
    index = X.build(texts, "id", ("body",), chunk=200)
    files = index.postings().filter("gram <> -1").groupBy(F.col("_metadata.file_name").alias("f")).agg(F.min("gram").alias("a"), F.max("gram").alias("b"), F.sum(F.length("blob") + 32).alias("n")).orderBy("a", "b").collect()
    assert len(files) >= 8 and max(f.n for f in files) < 4 * sum(f.n for f in files) / len(files)
    assert all(x.b <= y.a for x, y in zip(files[:-1], files[1:], strict=True))
    for q in ("abab", "cab"):
        want = S.search(texts, q, ("body",), "id").select("id", F.round("rank", 9)).collect()
        assert sorted(map(tuple, S.indexed_search(index, q).select("id", F.round("rank", 9)).collect())) == sorted(map(tuple, want)) != []
