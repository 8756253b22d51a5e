"""Event-time operators. Each is one plan for batch and stream: give it a streaming frame and a
watermark is kept; the registered queries run them over the whole events table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlstone.operators.textops import greedy_windows
from marlstone.session import load


def _marked(rows: DataFrame, ts: str, delay: str | None) -> DataFrame:
    """A watermark needs an instant: a time without zone counts as the session's."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay) if delay else rows


def windowed(rows: DataFrame, ts: str, key: str, size: str, slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Counts and sums of value by key in tumbling or sliding windows."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return _marked(rows, ts, delay).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(rows: DataFrame, ts: str, key: str, gap: str, delay: str | None = None) -> DataFrame:
    return _marked(rows, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def late(rows: DataFrame, ts: str, order: str, delay_seconds: int, part: str, span: int) -> DataFrame:
    """rows with late: older than the greatest time before them in arrival order less the delay, by part
    of the arrivals (each part keeps a watermark of its own).

    The greatest times of spans of `span` arrival numbers come first, then those within a span, so that
    no task holds a part whole."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = rows.withColumn("_span", F.floor(F.col(order) / span)).withColumn("_at", at)
    tops = rows.groupBy(part, "_span").agg(F.max("_at").alias("_top"))
    before = Window.partitionBy(part).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(part, "_span", F.max("_top").over(before).alias("_before"))
    within = F.max("_at").over(Window.partitionBy(part, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    top = F.greatest(F.col("_before"), F.col("_within"))
    return rows.withColumn("_within", within).join(tops, [part, "_span"]).withColumn("late", F.coalesce(F.col("_at") < top - delay_seconds * 1_000_000, F.lit(False))).drop("_span", "_at", "_within", "_before")


def once(rows: DataFrame, keys: list[str], ts: str | None = None, delay: str | None = None) -> DataFrame:
    """The first effect of each terminal event. A stream forgets keys behind the watermark."""
    return _marked(rows, ts, delay).dropDuplicatesWithinWatermark(keys) if delay else rows.dropDuplicates(keys)


def fenced(rows: DataFrame, current: DataFrame, key: str, generation: str) -> DataFrame:
    """Rows of a key's current generation; late ones of older generations go."""
    return rows.join(current.select(F.col(key), F.col(generation).alias("_now")), key).filter(F.col(generation) == F.col("_now")).drop("_now")


SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def limited(rows: DataFrame, key: str, ts: str, size: str, limit: int, tie: str) -> DataFrame:
    """rows with allowed: at most `limit` of a key in each window of `size` ("1 minute"), in time order. A
    key's window opens with its first row after the one before has ended; refused rows count too."""
    n, unit = size.split()
    seconds = float(n) * SECONDS[unit.removesuffix("s")]
    timed = rows.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6)
    opened = greedy_windows(timed, key, "_at", seconds)
    place = F.row_number().over(Window.partitionBy(key, "window_start").orderBy("_at", tie))
    return opened.withColumn("allowed", place <= limit).drop("_at", "window_start")


#: States of a step, in the order in which it may move on.
ORDER = ("waiting", "ready", "running", "done")


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = state.get[0] if state.exists else 0
    moves = 0
    for batch in batches:
        for to in batch.sort_values(["ts", "event_id"])["state"]:
            if (k := ORDER.index(to) if to in ORDER else -1) > now:
                now, moves = k, moves + 1
    state.update((now,))
    if moves:
        yield pd.DataFrame({"step": [key[0]], "state": [ORDER[now]], "moves": [moves]})


def lifecycle(rows: DataFrame) -> DataFrame:
    """A monotone state machine for each step: moves that would go back are dropped. rows: a stream of
    step, state, ts and event_id; gives a row whenever a step has moved on."""
    return rows.groupBy("step").applyInPandasWithState(_advance, "step long, state string, moves long", "at long", "update", GroupStateTimeout.NoTimeout)


def dead_letters(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that can be taken, and those for the poison sink."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def _events(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "events")


def tumbling_counts(s: SparkSession, d: str) -> DataFrame:
    return windowed(_events(s, d), "ts", "event_type", "6 hours").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


def sliding_counts(s: SparkSession, d: str) -> DataFrame:
    return windowed(_events(s, d), "ts", "event_type", "12 hours", "6 hours").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


def session_counts(s: SparkSession, d: str) -> DataFrame:
    return sessions(_events(s, d), "ts", "user_id", "4 hours").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"), F.sum("n").alias("events"))


def late_events(s: SparkSession, d: str) -> DataFrame:
    """Arrivals shuffled a little by a rule: how many are more than an hour late, by event type."""
    e = _events(s, d).withColumn("arrival", (F.col("event_id") + F.col("event_id") * 7919 % 40) * 1_000_000 + F.col("event_id"))
    return late(e, "ts", "arrival", 3600, "event_type", 1_000_000_000).groupBy("event_type").agg(F.count(F.when(F.col("late"), 1)).alias("late"), F.count("*").alias("n"))


def event_dedup_idempotent(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d).select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return once(e.unionByName(e), ["user_id", "event_type", "day"])


def stale_generation_filter(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d).withColumn("generation", F.floor(F.col("event_id") / 1000))
    return fenced(e, e.groupBy("user_id").agg(F.max("generation").alias("generation")), "user_id", "generation").select("event_id", "user_id", "generation")


def rate_limit_fixed_window(s: SparkSession, d: str) -> DataFrame:
    return limited(_events(s, d), "user_id", "ts", "1 day", 2, "event_id").groupBy("user_id").agg(F.count(F.when(F.col("allowed"), 1)).alias("allowed"), F.count(F.when(~F.col("allowed"), 1)).alias("refused"))


def daily_digest_once(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d).select(F.col("event_type").alias("domain"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id")
    return e.groupBy("domain", "day").agg(F.min("event_id").alias("event_id"))


def poison_split(s: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k INT")["k"]
    good, bad = dead_letters(_events(s, d).withColumn("k", k), F.col("k") >= 10)
    return good.agg(F.lit("good").alias("sink"), F.count("*").alias("n")).unionByName(bad.agg(F.lit("poison").alias("sink"), F.count("*").alias("n")))


QUERIES = {f.__name__: f for f in (tumbling_counts, sliding_counts, session_counts, late_events, event_dedup_idempotent, stale_generation_filter, rate_limit_fixed_window, daily_digest_once, poison_split)}

_W = "strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01'), '%Y-%m-%d %H:%M')"
ORACLES = {
    "late_events": """
WITH a AS (SELECT *, (event_id + event_id * 7919 % 40) * 1000000 + event_id AS arrival FROM events),
l AS (SELECT event_type, ts < max(ts) OVER (PARTITION BY event_type ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL '1 hour' AS late FROM a)
SELECT event_type, count(*) FILTER (late) AS late, count(*) AS n FROM l GROUP BY event_type""",
    "tumbling_counts": f"SELECT {_W} AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "sliding_counts": "WITH b AS (SELECT *, unnest([time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01'), time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01') - INTERVAL '6 hours']) AS b FROM events) SELECT strftime(b, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM b GROUP BY ALL",
    "session_counts": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '4 hours' THEN 0 ELSE 1 END AS first FROM events),
s AS (SELECT user_id, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), n AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, count(*) AS sessions, max(n) AS longest, sum(n)::BIGINT AS events FROM n GROUP BY user_id""",
    "event_dedup_idempotent": "SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events",
    "stale_generation_filter": "WITH e AS (SELECT event_id, user_id, event_id // 1000 AS generation FROM events) SELECT e.* FROM e JOIN (SELECT user_id, max(generation) AS g FROM e GROUP BY user_id) m ON m.user_id = e.user_id AND m.g = e.generation",
    "rate_limit_fixed_window": """
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t0, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, i, t0, t0 AS begun, 1 AS nth FROM e WHERE i = 1
      UNION ALL SELECT e.user_id, e.i, e.t0, CASE WHEN e.t0 >= w.begun + 86400000000 THEN e.t0 ELSE w.begun END, CASE WHEN e.t0 >= w.begun + 86400000000 THEN 1 ELSE w.nth + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT user_id, count(*) FILTER (nth <= 2) AS allowed, count(*) FILTER (nth > 2) AS refused FROM w GROUP BY user_id""",
    "daily_digest_once": "SELECT event_type AS domain, strftime(ts, '%Y-%m-%d') AS day, min(event_id) AS event_id FROM events GROUP BY ALL",
    "poison_split": "SELECT CASE WHEN (props->>'k')::INT >= 10 THEN 'good' ELSE 'poison' END AS sink, count(*) AS n FROM events GROUP BY 1",
}
