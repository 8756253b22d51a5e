"""Batches and digests under several budgets against plain folds."""

import random

from pyspark.sql import functions as F

from marlstone.operators import budgets as B


def plain(sizes, items, limit, batches, total, base):
    if len(sizes) > total:
        return [(None, None, "total")] * len(sizes)
    if any((n or 0) + base > limit for n in sizes):
        return [(None, None, "item")] * len(sizes)
    out, batch, count, held = [], -1, 0, 0
    for n in sizes:
        n = n or 0
        why = "start" if batch < 0 else "items" if count >= items else "bytes" if held + n > limit else None
        if why:
            batch, count, held = batch + 1, 0, base
        count, held = count + 1, held + n
        out.append((batch, why, None))
    return [(None, None, "batches")] * len(sizes) if batch + 1 > batches else out


def test_batches_equal_a_plain_fold(spark):
    rng = random.Random(3)
    groups = {g: [rng.choice([None, 0, 5, 20, 40, 61 if g % 9 == 0 else 60]) for _ in range(rng.randint(1, 22))] for g in [None, *range(1, 60)] if g is not None} | {None: [1, 2, 3]}
    rows = spark.createDataFrame([(g, i, n) for g, sizes in groups.items() for i, n in enumerate(sizes)], "batch_of long, i int, n long")
    got = {}
    for r in B.budgeted(rows, "batch_of", "i", "n", items=4, limit=70, batches=6, total=20, base=10).orderBy("batch_of", "i").collect():
        got.setdefault(r.batch_of, []).append((r.batch, r.opened, r.refused))
    assert got == {g: plain(sizes, 4, 70, 6, 20, 10) for g, sizes in groups.items()}
    assert {x[2] for v in got.values() for x in v} == {None, "total", "item", "batches"}
    assert B.budgeted(rows.limit(0), "batch_of", "i", "n").count() == 0


def test_digest_keeps_its_budgets(spark):
    rows = spark.createDataFrame(
        [(1, "a", "x" * 30 + "  \n" + "y" * 30), (2, "a", "  "), (3, "a", "z" * 10), (4, "a", "w" * 10), (5, "b", None), (6, None, "é" * 50), (7, None, "n"), (8, None, "m"), (9, "c", "c" * 50), (10, "d", "d")],
        "id long, g string, t string",
    )
    made = lambda **k: [(r.place, r.id, r.excerpt, r.truncated, r.kept) for r in B.digest(rows, "id", "g", [F.asc("id")], "t", F.lit(None).cast("string"), **k).orderBy("place").collect()]
    assert made(each=31, total=80, base=10, each_base=1, prompt=116) == [(0, 1, "x" * 30, True, True), (1, 3, "z" * 10, False, True), (2, 6, "é" * 31, True, True), (3, 7, "n", False, False), (4, 9, "c" * 8, True, False)]
    assert [x[1] for x in made(most=3)] == [1, 3, 6] and [x[1] for x in made(group_candidates=1)] == [1, 6, 9, 10] and [x[1] for x in made(candidates=3)] == [1, 3]
    assert B.digest(rows.limit(0), "id", "g", [F.asc("id")], "t", F.lit("")).count() == 0
