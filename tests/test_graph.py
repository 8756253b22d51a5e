"""Graphs of any depth, with cycles, against plain versions."""

import random

from marlstone.operators import graph as G


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string")


def test_deep_chains_are_followed_to_their_end(spark):
    chain = [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(69)]
    got = {r.node: r.depth for r in G.downstream(edges(spark, chain), spark.createDataFrame([("n000",)], "root string")).collect()}
    assert got == {f"n{k:03d}": k for k in range(1, 70)}
    nodes = spark.createDataFrame([(f"n{k:03d}",) for k in range(70)], "node string")
    assert [r.level for r in G.topological(nodes, edges(spark, chain)).orderBy("place").collect()] == list(range(70))


def test_many_paths_stay_few_rows(spark):
    rungs = [(f"{a}{k}", f"{b}{k + 1}") for k in range(24) for a in "xy" for b in "xy"]
    got = G.downstream(edges(spark, rungs), spark.createDataFrame([("x0",), ("y0",)], "root string"))
    assert got.count() == 2 * 2 * 24


def test_cycles_end(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")]
    got = sorted((r.node, r.depth) for r in G.downstream(edges(spark, rows), spark.createDataFrame([("b",)], "root string")).collect())
    assert got == [("b", 2), ("c", 1), ("d", 2)]
    nodes = spark.createDataFrame([(x,) for x in "dcba"], "node string")
    assert [(r.node, r.level) for r in G.topological(nodes, edges(spark, rows)).orderBy("place").collect()] == [("a", 0), ("b", None), ("c", None), ("d", None)]


def test_components_against_union_find(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in rows:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in G.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in rows if a != b for x in (a, b)}
    keyed = spark.createDataFrame([(1, "p"), (2, "p"), (2, "q"), (3, "q"), (4, None), (5, None)], "node long, key string")
    assert sorted(map(tuple, G.components_by_key(keyed, "node", "key").collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]


def test_skips_set_free_what_waits_behind_them(spark):
    steps = [("a", "done", False, False, False), ("b", "waiting", True, False, False), ("c", "waiting", False, False, False), ("d", "skipped", True, True, False), ("e", "skipped", True, True, True), ("f", "waiting", False, False, False), ("g", "failed", False, False, False), ("h", "waiting", False, False, False)]
    rows = spark.createDataFrame(steps, "step string, status string, conditional boolean, holds boolean, allow_failure boolean")
    got = {r.step: r.status for r in G.advance(rows, edges(spark, [("a", "b"), ("b", "c"), ("a", "d"), ("a", "e"), ("d", "f"), ("g", "h")])).collect()}
    assert got == {"a": "done", "b": "skipped", "c": "ready", "d": "ready", "e": "skipped", "f": "waiting", "g": "failed", "h": "waiting"}


def test_empty_graphs(spark):
    none = edges(spark, [])
    assert G.downstream(none, spark.createDataFrame([("a",)], "root string")).count() == 0
    assert G.topological(spark.createDataFrame([], "node string"), none).count() == 0
    assert G.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pairs_are_dealt_by_the_number_of_rows(spark, monkeypatch):
    """As many tasks as the rows need, whatever the session's number of partitions, and the pairs of a plain count."""
    from collections import Counter
    from itertools import combinations

    from marlstone.operators import analytics as A

    monkeypatch.setattr(A, "PAIR_ROWS", 50)
    data = [(j, j * t % 11) for j in range(100) for t in range(5)]
    want = Counter(p for j in range(100) for p in combinations(sorted({t for k, t in data if k == j}), 2))
    got = A.pairs(spark.createDataFrame(data, "job long, term long"), "job", "term")
    assert {(r.src, r.tgt): r.weight for r in got.collect()} == want
    plan = got._jdf.queryExecution().toString()
    assert "hashpartitioning(src" in plan and ", 20)" in plan.replace(", REPARTITION_BY_NUM", ")").replace("))", ")") and ", 10" in plan
