"""Queues, leases, slots and retries: what happens to work over time, as plans over event tables and, where
it takes state, as stream operators."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlstone.functions import scalars as S
from marlstone.functions import text as T
from marlstone.session import load


def leases(events: DataFrame, key: str, now: Column, seconds: float) -> DataFrame:
    """key, holder, until and held of each lease. events: key, holder, at, kind (claim, renew, release) and
    id. A claim takes a lease that is free, has run out or is its holder's own; a renewal or a release counts
    only from the holder while the lease runs. A key's events pass in order through one task."""
    schema = f"{key} long, holder string, until double"
    k = events.columns.index(key)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last, holder, until, found = None, None, 0.0, False

        def row():
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([holder], pa.string()), pa.array([until])], [key, "holder", "until"])

        for batch in batches:
            columns = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("holder", "_at", "kind")}
            for i, this in enumerate(batch.column(k).to_pylist()):
                if found and this != last:
                    yield row()
                    holder, until = None, 0.0
                last, found = this, True
                who, at, kind = columns["holder"][i], columns["_at"][i], columns["kind"][i]
                runs = holder is not None and at < until
                if kind == "claim" and (not runs or who == holder) or kind == "renew" and runs and who == holder:
                    holder, until = who, at + seconds
                elif kind == "release" and runs and who == holder:
                    holder, until = None, at
        if found:
            yield row()

    timed = events.withColumn("_at", F.unix_micros(F.col("at").cast("timestamp")) / 1e6)
    out = timed.repartition(key).sortWithinPartitions(key, "_at", "id").mapInArrow(run, schema)
    return out.withColumn("held", F.col("holder").isNotNull() & (F.unix_micros(now.cast("timestamp")) / 1e6 < F.col("until")))


def _lease(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A lease on a stream: it runs out by event time."""
    if state.hasTimedOut:
        holder, _ = state.get
        state.remove()
        yield pd.DataFrame({"key": [key[0]], "holder": [holder], "state": ["expired"]})
        return
    holder, until = state.get if state.exists else (None, 0)
    for batch in batches:
        for who, at, kind, ttl in batch.sort_values(["at", "id"])[["holder", "at", "kind", "ttl"]].itertuples(index=False):
            ms = int(at.timestamp() * 1000)
            runs = holder is not None and ms < until
            if kind == "claim" and (not runs or who == holder) or kind == "renew" and runs and who == holder:
                holder, until = who, ms + int(ttl * 1000)
            elif kind == "release" and runs and who == holder:
                holder, until = None, ms
    if holder is None:
        state.remove() if state.exists else None
    else:
        state.update((holder, until))
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"key": [key[0]], "holder": [holder], "state": ["held" if holder else "free"]})


def lease_stream(events: DataFrame, delay: str) -> DataFrame:
    """key, holder and state whenever a lease changes or runs out. events: a stream of key (long), holder, at,
    kind, id and ttl (seconds)."""
    marked = events.withWatermark("at", delay)
    return marked.groupBy("key").applyInPandasWithState(_lease, "key long, holder string, state string", "holder string, until long", "update", GroupStateTimeout.EventTimeTimeout)


def admitted(requests: DataFrame, resource: str, order: list[str], caps: DataFrame) -> DataFrame:
    """requests with admitted: of a resource's holders in order the first `cap` distinct ones get a slot
    (caps: resource, cap; without one all do); a holder that asks again keeps its slot."""
    most = caps.agg(F.max("cap")).first()[0] or 0
    first = requests.groupBy(resource, "holder").agg(F.min(F.struct(*order)).alias("_first")).join(caps, resource)
    # no more than the largest cap of a resource's holders leave the tasks that sort them
    nth = first.withColumn("_nth", F.row_number().over(Window.partitionBy(resource).orderBy("_first"))).filter(F.col("_nth") <= most)
    slots = nth.filter("_nth <= cap").select(resource, "holder", F.lit(True).alias("_slot"))
    open_ = requests.join(caps.select(resource, F.lit(True).alias("_capped")), resource, "left").join(slots, [resource, "holder"], "left")
    return open_.withColumn("admitted", F.col("_capped").isNull() | F.coalesce("_slot", F.lit(False))).drop("_capped", "_slot")


def score(done: Column, step: Column, boost: dict[str, int]) -> Column:
    """A task's place in its queue: jobs that are further on first, some steps before all (least is first)."""
    extra = F.lit(0)
    for name, value in boost.items():
        extra = F.when(step == name, F.lit(value)).otherwise(extra)
    return -(done + extra)


def popped(tasks: DataFrame, pool: str) -> DataFrame:
    """The first task of each pool by score, then name."""
    return tasks.groupBy(pool).agg(F.min_by("member", F.struct("score", "member")).alias("member"))


def claims(tasks: DataFrame, workers: DataFrame, full: DataFrame) -> DataFrame:
    """worker and member: the first task in the order of score, then name, that each worker may take alone:
    ready, of its pool, matching its tags, no resource in full (resource). Tasks meet the distinct sets of tags
    that a pool's workers have, workers the first task of their set."""
    busy = tasks.select("member", F.explode("resources").alias("resource")).join(full, "resource", "left_semi").select("member").distinct()
    open_ = tasks.filter("status = 'ready'").join(busy, "member", "left_anti")
    fits = S.matches(F.col("require_tags"), F.col("tags"), F.col("allowed_providers"), F.col("worker_tags"), F.col("reject_tags"))
    kind = ["pool", "worker_tags", "reject_tags"]
    sets = workers.select("worker", "pool", *(F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))).alias(c) for c in kind[1:]))
    best = sets.select(*kind).distinct().join(open_, "pool").filter(fits).groupBy(*kind).agg(F.min_by("member", F.struct("score", "member")).alias("member"))
    return sets.join(best, kind).groupBy("worker").agg(F.min("member").alias("member"))


def queue_peek(tasks: DataFrame, ages: DataFrame, pool: str, limit: int) -> DataFrame:
    """The first tasks of a pool with the time they were queued, where it is known."""
    return tasks.filter(F.col("pool") == pool).orderBy("score", "member").limit(limit).join(ages, "member", "left")


def retries(failures: DataFrame, at: str) -> DataFrame:
    """Failures (error_type, attempt from 0) with due: when they are tried again, null if they are not."""
    delay = S.retry_delay(F.col("error_type"), F.col("attempt"))
    return failures.withColumn("due", F.timestamp_micros(F.unix_micros(F.col(at).cast("timestamp")) + delay.cast("long") * 1_000_000))


def due_now(waiting: DataFrame, now: Column) -> DataFrame:
    return waiting.filter(F.col("due") <= now)


def together(key: str, *sides: DataFrame) -> GroupedData:
    """The rows of all sides by key, where a side lacks others' columns with nulls there: the sides meet in one
    aggregate, which spares a task the sorts of joins."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides).groupBy(key)


def leaked(held: DataFrame, live: DataFrame, suspects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Holders to free, and the suspects of the next tick: a holder no running step names is a suspect, one
    that was so at the tick before is freed. A null holder is a suspect that nothing names."""
    is_ = lambda rows, name: rows.select("holder", F.lit(True).alias(name))
    named = lambda rows: rows.filter("holder is not null")
    found = together("holder", is_(held, "held"), is_(named(live), "live"), is_(named(suspects), "suspect")).agg(*(F.max(c).alias(c) for c in ("held", "live", "suspect")))
    now = found.filter("held and live is null")
    return now.filter("suspect").select("holder"), now.select("holder")


def orphans(steps: DataFrame, now: Column, fresh: float, grace: float) -> DataFrame:
    """step and reason of the running steps (step, worker, alive, progress_at, mismatch_since) to reclaim: no
    worker, a lost one, or no progress within `fresh` seconds since `grace` and more."""
    age = lambda c: F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    stale = F.col("progress_at").isNull() | (age("progress_at") >= fresh)
    reason = F.when(F.coalesce("worker", F.lit("")) == "", "no worker").when(~F.coalesce("alive", F.lit(False)), "worker lost").when(stale & (age("mismatch_since") >= grace), "claim lost")
    return steps.withColumn("reason", reason).filter("reason is not null").select("step", "reason")


def stuck(steps: DataFrame, now: Column, limit: float = 180.0) -> DataFrame:
    """Running steps whose last sign of progress is older than the limit; those without any are left alone."""
    age = F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros(F.col("progress_at").cast("timestamp")) / 1e6
    return steps.filter(age > limit)


#: Tasks of a reconciling tick, in order; ticks.tick has their plans.
TICK = ("orphans", "stuck", "no_worker", "workers", "slots", "staging", "effects", "batches", "digest")


def reconcile(stream: DataFrame, tasks: dict, seconds: int = 30):
    """A stream's writer that runs the tasks of TICK in their order over every tick's rows."""

    def tick(batch: DataFrame, number: int) -> None:
        for name in TICK:
            if name in tasks:
                tasks[name](batch, number)

    return stream.writeStream.foreachBatch(tick).trigger(processingTime=f"{seconds} seconds")


def overlapped(chunks: DataFrame, key: str, order: str, text: str, overlap: int = 16 * 1024) -> DataFrame:
    """key, order and whether the chunk, with the last `overlap` characters before it, holds a secret: so a
    secret across the cut between chunks is found. No task holds more of a stream than that."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.lag(F.right(F.col(text), F.lit(overlap))).over(w)
    return chunks.withColumn("_tail", before).withColumn("secret", T.has_secret(F.concat(F.coalesce("_tail", F.lit("")), F.col(text)))).drop("_tail")


def attempts(events: DataFrame, key: str, most: int = 3) -> DataFrame:
    """Events by what becomes of them: poison at once where the envelope can't be read (valid false), poison
    from the `most`-th failure on, else tried again; handled ones are done."""
    failed = F.sum(F.when(F.col("valid") & ~F.col("ok"), 1).otherwise(0)).over(Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("fate", F.when(~F.col("valid"), "poison").when(F.col("ok"), "done").when(failed >= most, "poison").otherwise("again"))


def _events(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "events")


def lease_table(s: SparkSession, d: str) -> DataFrame:
    """Days of events as leases of a day: users claim, renew and release them."""
    kind = F.when(F.col("event_type") == "error", "release").when(F.col("event_type") == "view", "renew").otherwise("claim")
    e = _events(s, d).select((F.col("event_id") % 40).alias("slot"), (F.col("user_id") % 3).cast("string").alias("holder"), F.col("ts").alias("at"), kind.alias("kind"), F.col("event_id").alias("id"))
    return leases(e, "slot", F.lit("2024-01-30").cast("timestamp"), 86400.0).select("slot", F.when(F.col("held"), F.col("holder")).alias("holder"), "held")


def slots_admitted(s: SparkSession, d: str) -> DataFrame:
    """Event types as resources, users as holders: two to six slots, one type without a cap."""
    e = _events(s, d).select("event_type", F.col("user_id").alias("holder"), "event_id")
    caps = s.createDataFrame([("click", 2), ("view", 4), ("error", 6), ("signup", 3)], "event_type string, cap int")
    return admitted(e, "event_type", ["event_id"], caps).groupBy("event_type").agg(F.count(F.when(F.col("admitted"), 1)).alias("admitted"), F.count("*").alias("asked"))


def _tasks(s: SparkSession, d: str) -> DataFrame:
    step = F.element_at(F.array(*map(F.lit, ("whisper", "ocr", "smart", "review"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    tags = lambda c: F.when(c, F.array(F.lit("gpu"))).otherwise(F.array().cast("array<string>"))
    return load(s, d, "orders").select(
        F.format_string("t%09d", "o_orderkey").alias("member"), F.col("o_orderpriority").alias("pool"), score(F.col("o_custkey") % 7, step, {"whisper": 100}).alias("score"), F.when(F.col("o_orderstatus") == "F", "waiting").otherwise("ready").alias("status"),
        tags(step == "whisper").alias("require_tags"), tags(F.lit(False)).alias("tags"), F.lit(None).cast("array<string>").alias("allowed_providers"), F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit("disk"))).otherwise(tags(F.lit(False))).alias("resources"),
    )


def queue_pop(s: SparkSession, d: str) -> DataFrame:
    return popped(_tasks(s, d).filter("status = 'ready'"), "pool")


def worker_claims(s: SparkSession, d: str) -> DataFrame:
    """Suppliers as workers of the pools, one in three with a graphics card; the disks are full."""
    pools = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    tags = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("gpu"))).otherwise(F.array().cast("array<string>"))
    workers = load(s, d, "supplier").select(F.col("s_suppkey").alias("worker"), F.element_at(F.array(*map(F.lit, pools)), (F.col("s_suppkey") % 5 + 1).cast("int")).alias("pool"), tags.alias("worker_tags"), F.array().cast("array<string>").alias("reject_tags"))
    return claims(_tasks(s, d), workers, s.createDataFrame([("disk",)], "resource string"))


def queue_listing(s: SparkSession, d: str) -> DataFrame:
    ages = load(s, d, "orders").filter("o_orderkey % 3 <> 0").select(F.format_string("t%09d", "o_orderkey").alias("member"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("queued"))
    return queue_peek(_tasks(s, d), ages, "1-URGENT", 25).select("member", "score", "queued")


def delayed_retries(s: SparkSession, d: str) -> DataFrame:
    """Events as failures of five kinds; how many are due by the end, and how many never are."""
    kinds = F.element_at(F.array(*map(F.lit, ("ai", "timeout", "storage", "odd", "ai_rate_limit"))), (F.col("event_id") % 5 + 1).cast("int"))
    out = retries(_events(s, d).select("ts", kinds.alias("error_type"), (F.col("user_id") % 4).alias("attempt")), "ts")
    late = F.count(F.when(F.col("due") <= F.lit("2024-01-20 00:00:00").cast("timestamp"), 1))
    return out.groupBy("error_type").agg(late.alias("due"), F.count(F.when(F.col("due").isNull(), 1)).alias("never"), F.count("*").alias("n"))


def leaked_slots(s: SparkSession, d: str) -> DataFrame:
    """Holders of three days: freed is who was held without running on both of the last two."""
    day = lambda k: _events(s, d).filter(F.date_format("ts", "yyyy-MM-dd") == f"2024-01-{k}")
    who = lambda df: df.select(F.col("user_id").alias("holder")).distinct()
    live = lambda df: who(df.filter("event_type = 'click'"))
    _, before = leaked(who(day(10)), live(day(10)), who(day(10).limit(0)))
    free, now = leaked(who(day(11)), live(day(11)), before)
    return free.withColumn("state", F.lit("freed")).unionByName(now.join(free, "holder", "left_anti").withColumn("state", F.lit("suspect")))


def _steps(s: SparkSession, d: str) -> DataFrame:
    last = _events(s, d).groupBy(F.col("user_id").alias("step")).agg(F.max("ts").alias("progress_at"), F.min("ts").alias("mismatch_since"))
    worker = F.when(F.col("step") % 7 == 0, F.lit("")).otherwise(F.col("step").cast("string"))
    return last.withColumns({"worker": worker, "alive": F.col("step") % 5 != 0, "progress_at": F.when(F.col("step") % 11 != 0, F.col("progress_at"))})


_NOW = "2024-01-30 00:00:00"


def orphan_steps(s: SparkSession, d: str) -> DataFrame:
    return orphans(_steps(s, d), F.lit(_NOW).cast("timestamp"), 6 * 3600.0, 86400.0)


def stuck_steps(s: SparkSession, d: str) -> DataFrame:
    return stuck(_steps(s, d), F.lit(_NOW).cast("timestamp"), 6 * 3600.0).select("step")


def secret_chunks(s: SparkSession, d: str) -> DataFrame:
    """Whole documents in chunks of 100 characters, all but letters and spaces blotted out; every third has a
    secret put across one of its cuts, the second to the eighth by its id."""
    plain, at = F.regexp_replace("text", "[^a-z ]", "x"), (F.floor(F.col("doc_id") / 3) % 7 * 100 + 190).cast("int")
    put = F.when(F.col("doc_id") % 3 == 0, F.concat(F.rpad(plain, at, F.lit("x")), F.lit(" password=abcdefghijk "), F.substring(plain, at + 1, F.length(plain)))).otherwise(plain)
    rows = load(s, d, "documents").filter("text is not null").select("doc_id", put.alias("t"))
    cut = rows.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / 100)), lambda i: F.substring("t", (i * 100 + 1).cast("int"), F.lit(100)))).alias("k", "t"))
    return overlapped(cut, "doc_id", "k", "t", 64).filter("secret").groupBy("doc_id").agg(F.max("k").alias("chunk"))


def poison_attempts(s: SparkSession, d: str) -> DataFrame:
    """Users' events: purchases fail, every 17th can't be read."""
    e = _events(s, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") % 17 != 0).alias("valid"), (F.col("event_type") != "purchase").alias("ok"))
    return attempts(e, "key").groupBy("fate").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (lease_table, slots_admitted, queue_pop, worker_claims, queue_listing, delayed_retries, leaked_slots, orphan_steps, stuck_steps, secret_chunks, poison_attempts)}

_TASKS = "t AS (SELECT printf('t%09d', o_orderkey) AS member, o_orderpriority AS pool, -(o_custkey % 7 + CASE WHEN o_orderkey % 4 = 0 THEN 100 ELSE 0 END) AS score, o_orderstatus <> 'F' AS ready, o_orderkey % 4 = 0 AS gpu, o_orderkey % 5 = 0 AS disk, o_orderkey, o_orderdate FROM orders)"
_STEPS = "w AS (SELECT user_id AS step, max(ts) AS p, min(ts) AS m FROM events GROUP BY 1), st AS (SELECT step, CASE WHEN step % 11 <> 0 THEN epoch_us(TIMESTAMP '2024-01-30') - epoch_us(p) END AS age, epoch_us(TIMESTAMP '2024-01-30') - epoch_us(m) AS since FROM w)"
ORACLES = {
    "lease_table": """
WITH RECURSIVE e AS (SELECT event_id % 40 AS slot, (user_id % 3)::VARCHAR AS who, epoch_us(ts) AS t0, CASE event_type WHEN 'error' THEN 'release' WHEN 'view' THEN 'renew' ELSE 'claim' END AS kind, row_number() OVER (PARTITION BY event_id % 40 ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT slot, 0::BIGINT AS i, NULL::VARCHAR AS holder, 0::BIGINT AS till FROM (SELECT DISTINCT slot FROM e)
  UNION ALL SELECT e.slot, e.i,
    CASE WHEN kind = 'claim' AND (holder IS NULL OR t0 >= till OR who = holder) THEN who WHEN kind = 'release' AND t0 < till AND who = holder THEN NULL ELSE holder END,
    CASE WHEN (kind = 'claim' AND (holder IS NULL OR t0 >= till OR who = holder)) OR (kind = 'renew' AND t0 < till AND who = holder) THEN t0 + 86400000000 WHEN kind = 'release' AND t0 < till AND who = holder THEN t0 ELSE till END
  FROM r JOIN e ON e.slot = r.slot AND e.i = r.i + 1),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY slot ORDER BY i DESC) = 1)
SELECT slot, CASE WHEN till > epoch_us(TIMESTAMP '2024-01-30') THEN holder END AS holder, holder IS NOT NULL AND till > epoch_us(TIMESTAMP '2024-01-30') AS held FROM l""",
    "slots_admitted": """
WITH m AS (SELECT event_type, user_id, min(event_id) AS e FROM events GROUP BY ALL), f AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY e) AS nth FROM m)
SELECT event_type, count(*) FILTER (nth <= CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 4 WHEN 'error' THEN 6 WHEN 'signup' THEN 3 ELSE 1000000000 END) AS admitted, count(*) AS asked FROM events JOIN f USING (event_type, user_id) GROUP BY event_type""",
    "queue_pop": f"WITH {_TASKS} SELECT pool, member FROM t WHERE ready QUALIFY row_number() OVER (PARTITION BY pool ORDER BY score, member) = 1",
    "worker_claims": f"WITH {_TASKS}, w AS (SELECT s_suppkey AS worker, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][(s_suppkey % 5 + 1)::INT] AS pool FROM supplier) SELECT worker, member FROM w JOIN t USING (pool) WHERE ready AND NOT disk AND (NOT gpu OR worker % 3 = 0) QUALIFY row_number() OVER (PARTITION BY worker ORDER BY score, member) = 1",
    "queue_listing": f"WITH {_TASKS} SELECT member, score, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS queued FROM t WHERE pool = '1-URGENT' ORDER BY score, member LIMIT 25",
    "delayed_retries": """
WITH e AS (SELECT ts, ['ai', 'timeout', 'storage', 'odd', 'ai_rate_limit'][(event_id % 5 + 1)::INT] AS error_type, (user_id % 4)::INT AS a FROM events),
x AS (SELECT *, CASE error_type WHEN 'ai' THEN [30, 60, 120][a + 1] WHEN 'timeout' THEN [10][a + 1] WHEN 'storage' THEN [15, 60, 180][a + 1] WHEN 'ai_rate_limit' THEN [300, 600, 1200, 1800, 1800][a + 1] END AS s FROM e)
SELECT error_type, count(*) FILTER (ts + to_seconds(s) <= TIMESTAMP '2024-01-20') AS due, count(*) FILTER (s IS NULL) AS never, count(*) AS n FROM x GROUP BY error_type""",
    "leaked_slots": """
WITH h AS (SELECT strftime(ts, '%d') AS d, user_id AS holder, bool_or(event_type = 'click') AS live FROM events WHERE strftime(ts, '%Y-%m-%d') IN ('2024-01-10', '2024-01-11') GROUP BY ALL)
SELECT holder, CASE WHEN holder IN (SELECT holder FROM h WHERE d = '10' AND NOT live) THEN 'freed' ELSE 'suspect' END AS state FROM h WHERE d = '11' AND NOT live""",
    "orphan_steps": f"WITH {_STEPS} SELECT step, CASE WHEN step % 7 = 0 THEN 'no worker' WHEN step % 5 = 0 THEN 'worker lost' ELSE 'claim lost' END AS reason FROM st WHERE step % 7 = 0 OR step % 5 = 0 OR ((age IS NULL OR age >= 21600000000) AND since >= 86400000000)",
    "stuck_steps": f"WITH {_STEPS} SELECT step FROM st WHERE age > 21600000000",
    "secret_chunks": "SELECT doc_id, (doc_id // 3 % 7 + 2)::INT AS chunk FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0",
    "poison_attempts": """
WITH e AS (SELECT event_id % 17 <> 0 AS valid, event_type <> 'purchase' AS ok, sum(CASE WHEN event_id % 17 <> 0 AND event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM events)
SELECT CASE WHEN NOT valid THEN 'poison' WHEN ok THEN 'done' WHEN f >= 3 THEN 'poison' ELSE 'again' END AS fate, count(*) AS n FROM e GROUP BY 1""",
}
