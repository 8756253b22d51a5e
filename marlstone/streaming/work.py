"""Work on streams with timers: retries at their time, leases that run out, workers that fall silent, and
messages of a consumer group, of which idle ones are claimed before new ones are read.

Each is a stateful processor over a stream with a watermark: what is pending is kept by key in the state
store and survives a restart, timers fire when the watermark reaches them. Rows of a key are taken in event
time; what falls due between two rows of one batch is dealt with between them, so that results do not depend
on how a stream is cut into batches. A key's rows of one batch are held together, so a trigger's size
(maxFilesPerTrigger, maxBytesPerTrigger) bounds a task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from marlstone.functions import scalars as S
from marlstone.session import load
from marlstone.shared import shared_path

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Timed(StatefulProcessor):
    """A processor whose state is a list of entries, each with a time at which it is due.

    Subclasses say what a row does to the entries (`row`) and what an entry does when it is due (`due`);
    both may change the entries and give rows to put out. Times are milliseconds."""

    entry = "due long"
    out = "at long"
    columns: tuple[str, ...] = ()
    #: 1 if what is due at a row's very time comes before the row, else 0.
    ends = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.entry)

    def row(self, entries: list[tuple], now: int, row: tuple) -> list[tuple]:
        raise NotImplementedError

    def due(self, entries: list[tuple], entry: tuple) -> list[tuple]:
        """The first field of an entry is when it is due; the entry is taken out before this."""
        raise NotImplementedError

    def _until(self, entries: list[tuple], now: int) -> list[tuple]:
        out = []
        while entries and (entry := min(entries))[0] <= now:
            entries.remove(entry)
            out += self.due(entries, entry)
        return out

    def _rows(self, entries: list[tuple], rows: list[tuple]) -> list[tuple]:
        """What rows (when, then the processor's columns), in order, put out; entries are changed."""
        out = []
        for now, *row in rows:
            out += self._until(entries, now - 1 + self.ends)
            out += self.row(entries, now, tuple(row))
        return out

    def _put(self, key: tuple, entries: list[tuple], held: list[tuple], before: set[int], out: list[tuple]) -> Iterator[pd.DataFrame]:
        times = {e[0] for e in entries if e[0] < FAR}
        for t in before - times:
            self.handle.deleteTimer(t)
        for t in times - before:
            self.handle.registerTimer(t)
        if entries != held:  # each call goes to the state server and back
            if entries:
                self.held.put(entries)
            else:
                self.held.clear()
        if out:
            names = [x.split()[0] for x in self.out.split(", ")]
            yield pd.DataFrame([(*key, *r) for r in out], columns=names)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(e) for e in self.held.get()]
        entries, before = [*held], {e[0] for e in held if e[0] < FAR}
        taken = []
        for part in rows:
            taken += zip(*(part[c].tolist() for c in ("ms", "id", *self.columns)), strict=True)
        taken.sort(key=lambda r: r[:2])
        out = self._rows(entries, [(r[0], *r[2:]) for r in taken])
        yield from self._put(key, entries, held, before, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(e) for e in self.held.get()]
        entries = [*held]
        fired = expiredTimerInfo.getExpiryTimeInMs()
        before = {e[0] for e in entries if e[0] < FAR and e[0] != fired}
        # what becomes due on the way, up to the watermark, would else wait for the next batch
        out = self._until(entries, max(fired, timerValues.getCurrentWatermarkInMs()))
        yield from self._put(key, entries, held, before, out)

    def close(self) -> None:
        pass


#: The time of entries that no timer waits for.
FAR = 1 << 60


class Retries(Timed):
    """Failures are tried again when their delay is over; those without a delay are given up at once."""

    entry = "due long, id long, attempt int"
    out = "key long, id long, attempt int, fate string, at long"
    columns = ("id", "attempt", "delay")

    def row(self, entries, now, row):
        id_, attempt, delay = row
        if pd.isna(delay):
            return [(int(id_), int(attempt), "given up", now)]
        entries.append((now + int(delay * 1000), int(id_), int(attempt)))
        return []

    def due(self, entries, entry):
        at, id_, attempt = entry
        return [(id_, attempt + 1, "again", at)]


class Leases(Timed):
    """A claim takes a lease that is free, has run out or is its holder's own; a renewal or a release counts
    only from the holder while the lease runs; a lease that nobody renews runs out by its timer."""

    entry = "due long, holder string"
    out = "key long, holder string, state string, at long"
    columns = ("holder", "kind", "ttl")

    ends = 1  # a lease runs up to its end, not through it

    def row(self, entries, now, row):
        who, kind, ttl = row
        held = entries[0][1] if entries else None
        if kind == "claim" and held in (None, who) or kind == "renew" and held == who:
            entries[:] = [(now + int(ttl * 1000), who)]
            return [] if held == who else [(who, "taken", now)]
        if kind == "release" and held == who:
            entries.clear()
            return [(who, "released", now)]
        return [] if held == who or kind != "claim" else [(who, "refused", now)]

    def due(self, entries, entry):
        return [(entry[1], "expired", entry[0])]


class Heartbeats(Timed):
    """A worker that gives no sign for `quiet` seconds is offline, after `gone` seconds it is removed; a sign
    of one that was not online makes it so."""

    entry = "due long, state string, last long"
    out = "key long, state string, at long"
    columns = ()
    quiet, gone = 30, 900

    def row(self, entries, now, row):
        was = entries[0][1] if entries else None
        entries[:] = [(now + self.quiet * 1000, "online", now)]
        return [] if was == "online" else [("online", now)]

    def due(self, entries, entry):
        at, was, last = entry
        if was == "online":
            entries.append((last + self.gone * 1000, "offline", last))
        return [("offline" if was == "online" else "removed", at)]


class Group(Timed):
    """A group's messages: a consumer that reads gets what was given out `idle` seconds ago and more without
    having been handled, first given first, and only if there is none, new messages; `count` at most of
    either. What is acknowledged is never given out again.

    An entry: FAR, when it was given out (-1: not yet), the message, the consumer, how often it was given out."""

    entry = "due long, given long, id long, consumer string, times int"
    out = "key long, id long, consumer string, times int, kind string, at long"
    columns = ("id", "kind", "consumer", "count", "message")
    idle = 5

    def _rows(self, entries, rows):
        """Messages wait in two heaps, by number and by when they were given out; those that were handled or
        given out again since are passed over when their turn comes. A row takes no more than its own messages."""
        waiting = {n: e for n, e in enumerate(entries)}
        of: dict[int, list[int]] = defaultdict(list)
        for n, e in waiting.items():
            of[e[2]].append(n)
        new = [(e[2], n) for n, e in waiting.items() if e[1] < 0]
        given = [(e[1], e[2], n) for n, e in waiting.items() if e[1] >= 0]
        heapify(new)
        heapify(given)
        out, number = [], len(entries)
        for now, _, kind, consumer, count, message in rows:
            if kind == "add":
                waiting[number] = (FAR, -1, int(message), "", 0)
                of[int(message)].append(number)
                heappush(new, (int(message), number))
                number += 1
            elif kind == "ack":
                for n in of.pop(message, ()):
                    del waiting[n]
            else:
                take: list[int] = []
                while given and len(take) < int(count) and given[0][0] <= now - self.idle * 1000:
                    at, _, n = heappop(given)
                    if n in waiting and waiting[n][1] == at:
                        take.append(n)
                fate = "claimed" if take else "new"
                while fate == "new" and new and len(take) < int(count):
                    if (n := heappop(new)[1]) in waiting:
                        take.append(n)
                for n in take:
                    _, _, id_, _, times = waiting[n]
                    waiting[n] = (FAR, now, id_, consumer, times + 1)
                    heappush(given, (now, id_, n))
                    out.append((id_, consumer, times + 1, fate, now))
        entries[:] = waiting.values()
        return out

    def due(self, entries, entry):
        return []


def processed(stream: DataFrame, processor: Timed, delay: str = "0 seconds") -> DataFrame:
    """The rows that a processor puts out. stream: key, at, id and the processor's columns."""
    marked = stream.select("key", "at", "id", F.unix_millis("at").alias("ms"), *(c for c in processor.columns if c != "id")).withWatermark("at", delay)
    out = marked.groupBy("key").transformWithStateInPandas(processor, StructType.fromDDL(processor.out), "update", "eventTime")
    return out.withColumn("at", F.timestamp_millis("at"))


def replayed(spark: SparkSession, make: Callable[[DataFrame], DataFrame], rows: DataFrame, name: str, parts: int = 3) -> DataFrame:
    """What a stream operator puts out over a table's rows in the order of `at`.

    The rows come in parts, one time after another, as files of a folder; after each the stream runs until it
    has read them, stops, and goes on from its checkpoint with the next. All lies in the shared folder."""
    path = shared_path(spark, name)
    ms = rows.select(F.unix_millis("at").alias("ms"))
    cuts = ms.agg(F.percentile_approx("ms", [(k + 1) / parts for k in range(parts - 1)], 1000)).first()[0] or []
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        for low, high in zip([None, *cuts], [*cuts, None], strict=True):
            part = rows if low is None else rows.filter(F.unix_millis("at") > low)
            (part if high is None else part.filter(F.unix_millis("at") <= high)).write.mode("append").parquet(f"{path}/in")
            out = make(spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
            query = out.writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}"))
            query.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return spark.read.schema(out.schema).parquet(f"{path}/out").drop("batch")


def _events(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "events").withColumn("at", F.col("ts").cast("timestamp"))


def stream_retries(s: SparkSession, d: str) -> DataFrame:
    """Events as failures of five kinds, tried again at their time; those due after the last event are not."""
    kinds = F.element_at(F.array(*map(F.lit, ("ai", "timeout", "storage", "odd", "ai_rate_limit"))), (F.col("event_id") % 5 + 1).cast("int"))
    rows = _events(s, d).select(F.col("user_id").alias("key"), "at", F.col("event_id").alias("id"), (F.col("user_id") % 4).cast("int").alias("attempt"), S.retry_delay(kinds, F.col("user_id") % 4).cast("double").alias("delay"))
    out = replayed(s, lambda x: processed(x, Retries()), rows, "retries")
    return out.select("key", "id", "attempt", "fate", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


def stream_leases(s: SparkSession, d: str) -> DataFrame:
    """Events as claims, renewals and releases of forty leases of six hours."""
    kind = F.when(F.col("event_type") == "error", "release").when(F.col("event_type") == "view", "renew").otherwise("claim")
    rows = _events(s, d).select((F.col("event_id") % 40).alias("key"), "at", F.col("event_id").alias("id"), (F.col("user_id") % 3).cast("string").alias("holder"), kind.alias("kind"), F.lit(21600.0).alias("ttl"))
    out = replayed(s, lambda x: processed(x, Leases()), rows, "leases")
    return out.groupBy("key", "state").agg(F.count("*").alias("n"), F.count_distinct("holder").alias("holders"), F.date_format(F.max("at"), "yyyy-MM-dd HH:mm:ss").alias("last"))


class SlowHeartbeats(Heartbeats):
    quiet, gone = 6 * 3600, 24 * 3600


def stream_heartbeats(s: SparkSession, d: str) -> DataFrame:
    """Users as workers, their events as signs of life: offline after six hours, removed after a day."""
    rows = _events(s, d).select(F.col("user_id").alias("key"), "at", F.col("event_id").alias("id"))
    out = replayed(s, lambda x: processed(x, SlowHeartbeats()), rows, "heartbeats")
    return out.select("key", "state", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


class DayGroup(Group):
    idle = 24 * 3600


def stream_group(s: SparkSession, d: str) -> DataFrame:
    """Five groups: purchases and signups add messages, views and clicks read two, errors acknowledge the
    message of the event three before. How often each message was given out, and how it was last."""
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "add").when(F.col("event_type") == "error", "ack").otherwise("read")
    message = F.when(F.col("event_type") == "error", F.col("event_id") - 15).otherwise(F.col("event_id"))
    rows = _events(s, d).select((F.col("event_id") % 5).alias("key"), "at", F.col("event_id").alias("id"), kind.alias("kind"), F.col("user_id").cast("string").alias("consumer"), F.lit(2).alias("count"), message.alias("message"))
    out = replayed(s, lambda x: processed(x, DayGroup()), rows, "group")
    return out.groupBy(F.col("id").alias("message")).agg(F.max("times").cast("long").alias("times"), F.max_by("kind", "times").alias("kind"), F.max_by("consumer", "times").alias("consumer"))


QUERIES = {f.__name__: f for f in (stream_retries, stream_leases, stream_heartbeats, stream_group)}

_T = "strftime({}, '%Y-%m-%d %H:%M:%S')"
ORACLES = {
    "stream_leases": f"""
WITH RECURSIVE e AS (SELECT event_id % 40 AS key, (user_id % 3)::VARCHAR AS who, epoch_ms(ts) AS t0, CASE event_type WHEN 'error' THEN 'release' WHEN 'view' THEN 'renew' ELSE 'claim' END AS kind, row_number() OVER (PARTITION BY event_id % 40 ORDER BY epoch_ms(ts), event_id) AS i FROM events),
r AS (SELECT key, 0::BIGINT AS i, NULL::VARCHAR AS holder, 0::BIGINT AS till FROM (SELECT DISTINCT key FROM e)
  UNION ALL SELECT e.key, e.i,
    CASE WHEN (kind = 'claim' AND (holder IS NULL OR t0 >= till OR who = holder)) OR (kind = 'renew' AND holder = who AND t0 < till) THEN who WHEN t0 >= till OR (kind = 'release' AND who = holder) THEN NULL ELSE holder END,
    CASE WHEN (kind = 'claim' AND (holder IS NULL OR t0 >= till OR who = holder)) OR (kind = 'renew' AND holder = who AND t0 < till) THEN t0 + 21600000 ELSE till END
  FROM r JOIN e ON e.key = r.key AND e.i = r.i + 1),
x AS (SELECT r.key, holder, till, t0, who, kind, coalesce(holder IS NOT NULL AND t0 < till, false) AS live FROM r LEFT JOIN e ON e.key = r.key AND e.i = r.i + 1),
o AS (SELECT key, 'expired' AS state, holder, till AS t FROM x WHERE holder IS NOT NULL AND coalesce(t0, (SELECT epoch_ms(max(ts)) FROM events)) >= till
  UNION ALL SELECT key, CASE WHEN kind = 'claim' AND NOT live THEN 'taken' WHEN kind = 'claim' AND who <> holder THEN 'refused' WHEN kind = 'release' AND live AND who = holder THEN 'released' END, who, t0 FROM x WHERE t0 IS NOT NULL)
SELECT key, state, count(*) AS n, count(DISTINCT holder) AS holders, {_T.format("make_timestamp_ms(max(t))")} AS last FROM o WHERE state IS NOT NULL GROUP BY key, state""",
    "stream_retries": f"""
WITH e AS (SELECT user_id AS key, event_id AS id, ts, ['ai', 'timeout', 'storage', 'odd', 'ai_rate_limit'][(event_id % 5 + 1)::INT] AS k, (user_id % 4)::INT AS a FROM events),
x AS (SELECT *, CASE k WHEN 'ai' THEN [30, 60, 120][a + 1] WHEN 'timeout' THEN [10][a + 1] WHEN 'storage' THEN [15, 60, 180][a + 1] WHEN 'ai_rate_limit' THEN [300, 600, 1200, 1800, 1800][a + 1] END AS s FROM e)
SELECT key, id, CASE WHEN s IS NULL THEN a ELSE a + 1 END AS attempt, CASE WHEN s IS NULL THEN 'given up' ELSE 'again' END AS fate, {_T.format("ts + to_seconds(coalesce(s, 0))")} AS at FROM x
WHERE s IS NULL OR date_trunc('millisecond', ts) + to_seconds(s) <= (SELECT date_trunc('millisecond', max(ts)) FROM events)""",
    "stream_heartbeats": f"""
WITH e AS (SELECT user_id AS key, ts, lead(ts) OVER w AS after, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT max(ts) AS m FROM events),
o AS (SELECT key, 'online' AS state, ts AS t FROM e WHERE before IS NULL OR ts - before > INTERVAL '6 hours'
  UNION ALL SELECT key, 'offline', ts + INTERVAL '6 hours' FROM e, m WHERE coalesce(after, m + INTERVAL '1 millisecond') > ts + INTERVAL '6 hours'
  UNION ALL SELECT key, 'removed', ts + INTERVAL '24 hours' FROM e, m WHERE coalesce(after, m + INTERVAL '1 millisecond') > ts + INTERVAL '24 hours')
SELECT key, state, {_T.format("t")} AS at FROM o""",
}
