"""The event-time operators on a file stream."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marlstone.streaming import windows as W

SF = "/root/testdata/sf0.001"


@pytest.fixture
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet")


def stream(spark, df, path, files=4, order=1):
    """A stream that reads the files one by one, in the order of their event ids (-1: against it)."""
    df.repartitionByRange(files, "event_id").write.parquet(str(path))
    parts = sorted(Path(path).glob("part-*.parquet"))[::order]
    for k, part in enumerate(parts):  # the source goes by modification time
        os.utime(part, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(df, name, spark, mode="append", checkpoint=None):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_tumbling_stream_equals_batch(spark, events, tmp_path):
    live = W.windowed(stream(spark, events, tmp_path / "in"), "ts", "event_type", "1 day", delay="1 hour")
    got = run(live, "tumbling", spark, "complete", tmp_path / "c")
    want = W.windowed(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 day")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_append_mode_emits_closed_windows_only(spark, events, tmp_path):
    got = run(W.windowed(stream(spark, events, tmp_path / "in"), "ts", "event_type", "1 day", delay="1 hour"), "closed", spark, "append", tmp_path / "c")
    want = W.windowed(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 day")
    assert 0 < got.count() < want.count()
    assert got.join(want, ["start", "event_type", "n", "total"], "left_anti").count() == 0


def test_repeated_events_take_effect_once(spark, events, tmp_path):
    twice = events.unionByName(events)
    got = run(W.once(stream(spark, twice, tmp_path / "in"), ["event_id"], "ts", "40 days"), "once", spark, "append", tmp_path / "c")
    assert got.count() == events.count() == got.select("event_id").distinct().count()


def test_states_never_move_back(spark, tmp_path):
    rows = [(1, "ready", 1), (1, "running", 2), (1, "ready", 3), (1, "done", 4), (2, "running", 5), (2, "waiting", 6), (1, "running", 7), (2, "odd", 8)]
    df = spark.createDataFrame(rows, "step long, state string, event_id long").withColumn("ts", F.timestamp_seconds("event_id"))
    got = run(W.lifecycle(stream(spark, df, tmp_path / "in", 8)), "steps", spark, "update", tmp_path / "c").collect()
    order = {s: i for i, s in enumerate(W.ORDER)}
    for step, last in ((1, "done"), (2, "running")):
        states = [order[r.state] for r in got if r.step == step]
        assert states == sorted(states) and W.ORDER[states[-1]] == last


def test_stale_generations_and_limits(spark):
    rows = spark.createDataFrame([("a", 1, 10), ("a", 2, 11), ("b", 1, 12)], "k string, generation int, v int")
    now = spark.createDataFrame([("a", 2), ("b", 1)], "k string, generation int")
    assert sorted(r.v for r in W.fenced(rows, now, "k", "generation").collect()) == [11, 12]
    e = spark.createDataFrame([("u", k) for k in range(5)], "k string, id long").withColumn("ts", F.timestamp_seconds(F.col("id") * 20))
    assert [r.allowed for r in W.limited(e, "k", "ts", "1 minute", 2, "id").orderBy("id").collect()] == [True, True, False, True, True]


def test_dead_letters(spark):
    rows = spark.createDataFrame([(1,), (None,), (-1,)], "v int")
    good, bad = W.dead_letters(rows, F.col("v") > 0)
    assert good.count() == 1 and bad.count() == 2


def test_late_rows_are_dropped_and_on_time_ones_are_not(spark, events, tmp_path):
    """Files against their order: all but the first read are behind the watermark of an hour."""
    want = W.windowed(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 day")
    live = W.windowed(stream(spark, events, tmp_path / "in", order=-1), "ts", "event_type", "1 day", delay="1 hour")
    got = run(live, "late_windows", spark, "append", tmp_path / "c")
    total = lambda df: df.agg(F.sum("n")).first()[0] or 0
    assert total(got) < 0.5 * total(want)
    patient = W.windowed(stream(spark, events, tmp_path / "in2", order=-1), "ts", "event_type", "1 day", delay="40 days")
    assert total(run(patient, "patient_windows", spark, "complete", tmp_path / "c2")) == total(want)


def test_leases_on_a_stream(spark, tmp_path):
    from marlstone.streaming import state

    rows = [(1, "a", 0, "claim"), (1, "b", 5, "claim"), (1, "a", 8, "renew"), (2, "a", 9, "claim"), (2, "a", 10, "release"), (2, "b", 11, "claim"), (1, "b", 30, "claim"), (3, "z", 500, "claim"), (3, "z", 900, "renew")]
    df = spark.createDataFrame([(*r, float(k), k) for k, r in enumerate(rows)], "key long, holder string, s int, kind string, ttl double, event_id long").select("key", "holder", F.timestamp_seconds(F.col("s") + 1000).alias("at"), "kind", F.lit(10.0).alias("ttl"), F.col("event_id").alias("id"), "event_id")
    live = stream(spark, df, tmp_path / "in", 9).select("key", "holder", "at", "kind", "ttl", "id")
    got = [tuple(r) for r in run(state.lease_stream(live, "1 second"), "leases", spark, "update", tmp_path / "c").collect()]
    assert (1, "a", "held") in got and (1, "a", "expired") not in got[:1]
    assert (2, None, "free") in got and (2, "b", "held") in got
    assert (1, "b", "held") in got and (1, "b", "expired") in got
    table = state.leases(df.filter("key < 3"), "key", F.timestamp_seconds(F.lit(1035)), 10.0).collect()
    assert sorted((r.key, r.holder, r.held) for r in table) == [(1, "b", True), (2, "b", False)]


def test_reconciling_runs_its_tasks_in_order(spark, events, tmp_path):
    from marlstone.streaming import state

    seen = []
    tasks = {name: (lambda batch, n, name=name: seen.append((n, name, batch.count()))) for name in reversed(state.TICK)}
    q = state.reconcile(stream(spark, events, tmp_path / "in", 2), tasks).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert [x[1] for x in seen] == [*state.TICK, *state.TICK] and sum(x[2] for x in seen if x[1] == "slots") == events.count()


def test_windows_open_with_their_first_row(spark):
    e = spark.createDataFrame([("u", s, k) for k, s in enumerate([50, 70, 80, 109, 110, 130])], "k string, s int, id long").withColumn("ts", F.timestamp_seconds("s"))
    got = [r.allowed for r in W.limited(e, "k", "ts", "1 minute", 2, "id").orderBy("id").collect()]
    assert got == [True, True, False, False, True, True]
