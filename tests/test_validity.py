"""Evidence, unreconciled work, heading paths and timelines on tables of known make."""

import random

from pyspark.sql import functions as F

from marlstone.operators import validity as V


def test_reasons_in_their_order(spark):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    row = lambda e, job, chunk, body="b", domain="d", section="s": (e, job, chunk, "k", section, 0, 9, domain, sha(body))
    evidence = spark.createDataFrame(
        [row(1, 1, "c1"), row(2, 9, "c1"), row(3, 2, "none"), row(4, 3, "none"), row(5, 1, "none"), row(6, 1, "c1", "other"), row(7, 1, "c1", domain="x"), row(8, 1, "c2"), row(9, None, None), row(10, 1, "c3", section=None), row(11, 1, "c3")],
        "evidence_id long, job long, chunk string, kind string, section string, start int, end int, domain string, sha256 string",
    )
    jobs = spark.createDataFrame([(1, "done", True, "d"), (2, "failed", False, "d"), (3, "done", None, "d")], "job long, status string, current boolean, domain string")
    chunks = spark.createDataFrame([("c1", 1, "k", "s", 0, 9, "d", "b"), ("c2", 2, "k", "s", 0, 9, "d", "b"), ("c3", 1, "k", None, 0, 9, "d", "b")], "chunk string, job long, kind string, section string, start int, end int, domain string, body string")
    got = {r.evidence_id: r.reason for r in V.evidence_states(evidence, jobs, chunks, domain=True).collect()}
    assert got == {1: None, 2: "job_deleted", 3: "job_not_done", 4: "job_superseded", 5: "chunk_removed", 6: "chunk_changed", 7: "job_domain_changed", 8: "chunk_changed", 9: "job_deleted", 10: None, 11: "chunk_changed"}
    plain = {r.evidence_id: (r.state, r.reason) for r in V.evidence_states(evidence, jobs, chunks).collect()}
    assert plain[7] == ("valid", None) and plain[5] == ("missing", "chunk_removed") and plain[6] == ("stale", "chunk_changed")
    assert V.evidence_states(evidence.limit(0), jobs, chunks).count() == 0


def test_work_that_is_due(spark):
    jobs = spark.createDataFrame([(i, "done" if i != 2 else "running", i != 3, 100 - i) for i in range(1, 12)], "job long, status string, current boolean, created int")
    indexed = spark.createDataFrame([(i,) for i in range(1, 12) if i != 4] * 2, "job long")
    projections = spark.createDataFrame([(5, 2, "full", "a"), (6, 1, "full", "a"), (7, 2, "-", "a"), (8, 2, "-", "a"), (9, 1, "-", "a"), (10, 2, "full", "a"), (10, 1, "-", "a")], "job long, version int, digest string, source string")
    tries = spark.createDataFrame([(6, 2, "retry", 50, "a"), (7, 2, "verified_empty", 0, "a"), (8, 2, "verified_empty", 7, "b"), (9, 2, "retry", 200, "a"), (11, 1, "failed", None, None)], "job long, version int, state string, next_retry int, source string")
    got = [(r.job, r.next_retry) for r in V.unreconciled(jobs, indexed, projections, tries, F.lit(100), 2, "-").collect()]
    assert got == [(11, None), (1, None), (8, 7), (6, 50)]
    assert [r.job for r in V.unreconciled(jobs, indexed, projections, tries, F.lit(100), 2, "-", 0).collect()] == [11]


def test_paths_equal_a_stack(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.choice([None, None, 1, 2, 3, 6]), f"t{i}") for k in (1, 2, None) for i in range(60)]
    want = {}
    for k, i, level, title in rows:
        held = [] if i == 0 else want[k, i - 1][1]
        held = held if level is None else [h for h in held if h[0] < level] + [(level, title)]
        want[k, i] = ([h[1] for h in held], held)
    got = V.heading_paths(spark.createDataFrame(rows, "k int, i int, level int, title string"), "k", "i", "level", "title")
    assert {(r.k, r.i): r.path for r in got.collect()} == {x: v[0] for x, v in want.items()}


def test_streams_in_one_order(spark):
    a = spark.createDataFrame([("k", 5, 1, "x"), ("k", 1, 2, None), ("j", 1, 1, "y")], "key string, at int, id long, a string")
    b = spark.createDataFrame([("k", 5, 0, 2.5), ("k", None, 9, 1.0)], "key string, at int, id long, b double")
    got = [(r.key, r.place, r.stream, r.at, r.a, r.b) for r in V.timeline("key", "at", first=a, second=b).orderBy("key", "place").collect()]
    assert got == [("j", 1, "first", 1, "y", None), ("k", 1, "second", None, None, 1.0), ("k", 2, "first", 1, None, None), ("k", 3, "first", 5, "x", None), ("k", 4, "second", 5, None, 2.5)]
