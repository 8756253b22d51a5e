"""Tasks of a tick on states of known make."""

import datetime as dt

from pyspark.sql import functions as F

from marlstone.streaming import state, ticks

NOON = dt.datetime(2024, 1, 29, 12, tzinfo=dt.UTC)


def noon():
    return F.lit("2024-01-29 12:00:00").cast("timestamp")


def ago(seconds):
    return NOON - dt.timedelta(seconds=seconds)


def rows(df):
    return sorted((r.subject, r.action) for r in df.collect())


def test_jobs_without_a_worker_wait_and_are_told_again(spark):
    steps = spark.createDataFrame([(1, "ready", "gpu"), (1, "done", "cpu"), (2, "ready", "gpu"), (2, "running", "cpu"), (3, "ready", "gpu"), (3, "ready", "cpu"), (4, "done", "gpu"), (5, "ready", None)], "job long, status string, pool string")
    workers = spark.createDataFrame([("cpu", True), ("gpu", False), (None, False)], "pool string, online boolean")
    none = spark.createDataFrame([], "job long, since timestamp")
    told, waiting = ticks.without_worker(steps, workers, none, noon(), 60)
    assert rows(told) == [] and sorted(r.job for r in waiting.collect()) == [1, 5]
    later = F.lit("2024-01-29 12:01:00").cast("timestamp")
    told, again = ticks.without_worker(steps, workers, waiting, later, 60)
    assert rows(told) == [("1", "no worker"), ("5", "no worker")]
    assert rows(ticks.without_worker(steps, workers, again, later, 60)[0]) == []
    back = workers.unionByName(spark.createDataFrame([("gpu", True)], workers.schema))
    assert [r.job for r in ticks.without_worker(steps, back, again, later, 60)[1].collect()] == [5]


def test_workers_files_and_batches(spark):
    workers = spark.createDataFrame([("a", ago(899), False), ("b", ago(901), True), ("c", ago(901), None), ("d", None, False)], "worker string, heartbeat timestamp, registered boolean")
    assert rows(ticks.stale_workers(workers, noon())) == [("b", "offline"), ("c", "removed"), ("d", "removed")]
    files = spark.createDataFrame([("x", ago(30000)), ("x", ago(5)), ("y", ago(30000)), ("z", ago(30000)), (None, ago(30000))], "execution string, modified timestamp")
    assert rows(ticks.staged_orphans(files.filter("execution is not null"), spark.createDataFrame([("z",), ("z",)], "execution string"), noon())) == [("y", "deleted")]
    batches = spark.createDataFrame([(1, "pending_enqueue", None), (2, "queued", ago(700)), (3, "queued", ago(5)), (4, "queued", ago(700)), (5, "queued", None), (6, "done", ago(700)), (7, "queued", ago(5))], "batch long, status string, claimed timestamp")
    results = spark.createDataFrame([(4, True), (7, True), (7, False), (9, True)], "batch long, ok boolean")
    assert rows(ticks.suggestion_batches(batches, results, noon(), 600)) == [("1", "queued"), ("2", "queued again"), ("4", "done"), ("7", "failed")]


def test_completions_and_digests(spark):
    job = lambda *ids: spark.createDataFrame([(i,) for i in ids], "job long")
    steps = spark.createDataFrame([(1, "done"), (1, "skipped"), (2, "done"), (2, "failed"), (3, "done"), (4, None)], "job long, status string")
    assert rows(ticks.completions(steps, job(1, 2, 4, 8), job(5, 6, 5), job(6))) == [("1", "finished"), ("5", "indexed")]
    domains = spark.createDataFrame([("a", True), ("a", True), ("b", False), ("c", True)], "domain string, active boolean")
    sent = spark.createDataFrame([("c", NOON.date()), ("a", dt.date(2024, 1, 22))], "domain string, day date")
    assert rows(ticks.digests(domains, sent, noon())) == [("a", "digest")] and rows(ticks.digests(domains, sent, noon(), 1)) == []


def test_sides_meet_in_one_aggregate_and_nulls_meet_nothing(spark):
    frame = lambda c, *ids: spark.createDataFrame([(i,) for i in ids], f"{c} string")
    free, now = state.leaked(frame("holder", "a", "a", "b", "c", None), frame("holder", "b", "b", None), frame("holder", "a", "b", "d", None))
    assert [r.holder for r in free.collect()] == ["a"] and sorted(str(r.holder) for r in now.collect()) == ["None", "a", "c"]
    files = spark.createDataFrame([("x", ago(30000)), ("y", ago(30000)), ("z", None), (None, ago(30000))], "execution string, modified timestamp")
    left = ticks.staged_orphans(files, frame("execution", "y", None), noon())
    assert sorted(str(r.subject) for r in left.collect()) == ["None", "x"]
    job = lambda *ids: spark.createDataFrame([(i,) for i in ids], "job long")
    steps = spark.createDataFrame([(1, "done"), (None, "done"), (3, "done")], "job long, status string")
    done = ticks.completions(steps, job(1, 1, None, 7), job(5, None, None), job(None))
    assert sorted((str(r.subject), r.action) for r in done.collect()) == [("1", "finished"), ("5", "indexed"), ("None", "indexed")]
    for df in (free, now, left, done):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_an_empty_state_has_no_actions(spark):
    empty = {k: v.limit(0) for k, v in ticks._state(spark, "/root/testdata/sf0.001").items()}
    empty |= {"waiting": spark.createDataFrame([], "job long, since timestamp"), "suspects": spark.createDataFrame([], "holder string")}
    found, _ = ticks.tick(empty, noon())
    assert found.columns == ["place", "task", "subject", "action"] and found.count() == 0 and len(state.TICK) == 9
