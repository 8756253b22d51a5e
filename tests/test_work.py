"""The processors with timers against plain versions, however a stream is cut."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.streaming import work as W


def millis(df):
    return df.withColumn("at", F.unix_millis("at"))


def run(spark, processor, rows, schema, parts):
    df = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_millis("ms")).drop("ms").repartition(3)
    out = W.replayed(spark, lambda x: W.processed(x, processor), df, "work", parts)
    return sorted((tuple(r) for r in millis(out).collect()), key=repr)


def timed(rng, n, span=400_000):
    return sorted(rng.sample(range(1_000_000, 1_000_000 + span), n))


@pytest.mark.parametrize("parts", [1, 4])
def test_retries_come_at_their_time(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.randrange(3), t, k, rng.randrange(4), rng.choice([None, 0.5, 30.0, 200.0])) for k, t in enumerate(timed(rng, 60))]
    end = max(r[1] for r in rows)
    want = [(k, i, a, "given up", t) for k, t, i, a, d in rows if d is None] + [(k, i, a + 1, "again", t + int(d * 1000)) for k, t, i, a, d in rows if d is not None and t + int(d * 1000) <= end]
    assert run(spark, W.Retries(), rows, "key long, ms long, id long, attempt int, delay double", parts) == sorted(want, key=repr)


@pytest.mark.parametrize("parts", [1, 3])
def test_silent_workers_go_offline_and_away(spark, parts):
    class Quick(W.Heartbeats):
        quiet, gone = 20, 60

    rng = random.Random(parts)
    rows = [(rng.randrange(4), t, k) for k, t in enumerate(timed(rng, 40))]
    end, want = max(r[1] for r in rows), []
    for w in range(4):
        mine = [t for k, t, _ in rows if k == w]
        for before, t, after in zip([None, *mine], mine, [*mine[1:], end + 1], strict=False):
            want += [(w, "online", t)] if before is None or t - before > 20_000 else []
            want += [(w, s, t + n) for s, n in (("offline", 20_000), ("removed", 60_000)) if after > t + n]
    assert run(spark, Quick(), rows, "key long, ms long, id long", parts) == sorted(want, key=repr)


def test_leases_run_out_between_rows_and_after_them(spark):
    rows = [(1, 1000, 1, "a", "claim", 10.0), (1, 5000, 2, "b", "claim", 10.0), (1, 9000, 3, "a", "renew", 10.0), (1, 19000, 4, "b", "claim", 10.0), (1, 20000, 5, "a", "release", 1.0), (1, 21000, 6, "b", "release", 1.0), (2, 22000, 7, "z", "claim", 5.0), (3, 60000, 8, "q", "renew", 5.0)]
    want = [(1, "a", "taken", 1000), (1, "b", "refused", 5000), (1, "a", "expired", 19000), (1, "b", "taken", 19000), (1, "b", "released", 21000), (2, "z", "taken", 22000), (2, "z", "expired", 27000)]
    for parts in (1, 4):
        assert run(spark, W.Leases(), rows, "key long, ms long, id long, holder string, kind string, ttl double", parts) == sorted(want, key=repr)


def plain_group(rows, idle):
    out, held = [], {}
    for key, now, _, kind, who, count, message in sorted(rows, key=lambda r: (r[1], r[2])):
        mine = held.setdefault(key, {})
        if kind == "add":
            mine[message] = [-1, 0]
        elif kind == "ack":
            mine.pop(message, None)
        else:
            old = sorted((m for m, x in mine.items() if 0 <= x[0] <= now - idle), key=lambda m: (mine[m][0], m))[:count]
            for m in old or sorted(m for m, x in mine.items() if x[0] < 0)[:count]:
                mine[m] = [now, mine[m][1] + 1]
                out.append((key, m, who, mine[m][1], "claimed" if old else "new", now))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 3])
def test_idle_messages_are_claimed_before_new_ones(spark, parts):
    rng, rows = random.Random(parts), []
    for k, t in enumerate(timed(rng, 120, 100_000)):
        rows.append((k % 2, t, k, rng.choice(["add", "add", "read", "read", "ack"]), rng.choice("xyz"), rng.randint(1, 3), k if k < 3 else rng.randrange(k)))
    rows = [(*r[:6], r[2]) if r[3] == "add" else r for r in rows]
    want = plain_group(rows, 5000)
    assert {r[4] for r in want} == {"claimed", "new"}
    assert run(spark, W.Group(), rows, "key long, ms long, id long, kind string, consumer string, count int, message long", parts) == want


def test_group_query_equals_the_plain_version(spark):
    d = "/root/testdata/sf0.001"
    rows = []
    for r in spark.read.parquet(f"{d}/events.parquet").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp"))).collect():
        kind = "add" if r.event_type in ("purchase", "signup") else "ack" if r.event_type == "error" else "read"
        rows.append((r.event_id % 5, r.ms, r.event_id, kind, str(r.user_id), 2, r.event_id - 15 if kind == "ack" else r.event_id))
    last = {}
    for _, m, who, times, kind, _ in plain_group(rows, 24 * 3600 * 1000):
        last[m] = max(last.get(m, (0,)), (times, kind, who))
    got = {r.message: (r.times, r.kind, r.consumer) for r in W.stream_group(spark, d).collect()}
    assert got == last


def test_a_group_of_many_messages_takes_time_in_proportion():
    """A row once searched and sorted all that was pending; 60,000 rows took minutes."""
    import time

    rng = random.Random(7)
    rows = [(t, t, rng.choice(["add", "add", "read", "ack"]), "x", 2, t if t < 9 else rng.randrange(t)) for t in range(60_000)]
    rows = [(*r[:5], r[0]) if r[2] == "add" else r for r in rows]
    held, start = [], time.monotonic()
    group = W.Group()
    got = group._rows(held, rows[:50_000]) + group._rows(held, rows[50_000:])
    assert time.monotonic() - start < 10
    few, mine = [], W.Group()
    out = mine._rows(few, rows[:300]) + mine._rows(few, rows[300:2000])
    assert out == got[: len(out)]
    assert sorted((1, r[0], r[1], r[2], r[3], r[4]) for r in out) == sorted(plain_group([(1, *r) for r in rows[:2000]], 5000))
