"""Changes to tables on small ones, with nulls, repeats and empty ones."""

from pyspark.sql import functions as F

from marlstone.operators import joins as J
from marlstone.operators import maintenance as M


def test_upserts_keep_what_a_change_leaves_open(spark):
    table = spark.createDataFrame([(1, "a", 1), (2, None, 2)], "k int, x string, y int")
    changes = spark.createDataFrame([(2, "b", None, 1), (2, None, 9, 2), (3, "c", 3, 1)], "k int, x string, y int, at int")
    assert sorted(map(tuple, M.upsert(table, changes, ["k"], "at").collect())) == [(1, "a", 1), (2, "b", 9), (3, "c", 3)]
    assert M.upsert(table.limit(0), changes.limit(0), ["k"], "at").count() == 0


def test_partitions_are_replaced_on_disk(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "v int, p string")
    M.write_partitions(rows, path, ["p"])
    M.write_partitions(spark.createDataFrame([(9, "a")], "v int, p string"), path, ["p"])
    assert sorted((r.v, r.p) for r in spark.read.parquet(path).collect()) == [(3, "b"), (9, "a")]


def test_revisions(spark):
    table = spark.createDataFrame([(1, 5, "a"), (2, 1, "b")], "k int, revision int, x string")
    changes = spark.createDataFrame([(10, 1, 5, "n"), (11, 1, 5, "late"), (12, 2, 7, "z"), (13, 3, 1, "none"), (14, 2, None, "null")], "request int, k int, expected int, x string")
    new, fate = M.compare_and_set(table, changes, "k", "revision")
    assert sorted(map(tuple, new.collect())) == [(1, 6, "n"), (2, 1, "b")]
    assert {r.request: r.outcome for r in fate.collect()}[10] == "applied" and {r.request: r.outcome for r in fate.collect()}[11] == "superseded"
    assert {r.outcome for r in fate.filter("request in (12, 13)").collect()} == {"conflict", "missing"}


def test_cascades_strip_arrays_in_order(spark):
    gone = spark.createDataFrame([(2,), (2,)], "job int")
    notes = spark.createDataFrame([("t", [(3, 1), (2, 2), (1, 3), (3, 4)]), ("u", [(2, 1)]), ("v", None)], "term string, o array<struct<job:int,n:int>>")
    out = M.cascaded(gone, "job", {}, {}, {"notes": (notes, "term", "o", "job")})["notes"]
    assert {r.term: [x.n for x in r.o] for r in out.collect()} == {"t": [1, 3, 4], "u": [], "v": []}


def test_classes_are_known():
    assert M.classified(["documents", "customer"]) == {"documents": "A", "customer": "D"}
    try:
        M.classified(["documents", "new"])
    except ValueError as e:
        assert "new" in str(e)
    else:
        raise AssertionError


def test_pictures_in_order(spark):
    rows = [(1, 0, 0), (1, 1, 0b111111), (1, 2, 0b111111111111), (1, 3, 0), (1, 4, None), (2, 0, 0b1)]
    got = {(r.job, r["index"]): r.keep for r in J.kept_pictures(spark.createDataFrame(rows, "job int, index int, phash long"), "job").collect()}
    # 1 is near 0, so 2, which is near 1 but not near 0, stays
    assert got == {(1, 0): True, (1, 1): False, (1, 2): True, (1, 3): False, (1, 4): False, (2, 0): True}


def test_terms_stand_as_words(spark):
    texts = spark.createDataFrame([(1, "AI and SAID"), (2, "注意力机制"), (3, "c++ now"), (4, None)], "id long, t string")
    terms = spark.createDataFrame([("ai",), ("said",), ("意力",), ("c++",), ("",)], "term string")
    assert sorted(map(tuple, J.terms_in(texts.filter("t is not null"), terms, "id", "t").collect())) == [(1, "ai"), (1, "said"), (2, "意力"), (3, "c++")]


def test_titles_and_members(spark):
    left = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "b", 1), (2, "a", 2)], "g int, m string, p int")
    assert [tuple(r) for r in J.same_members(left.filter("g = 1"), left.withColumn("g", F.col("g") + 10), "g", "m", "p").collect()] == [(1, 11)]
