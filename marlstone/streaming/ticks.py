"""The periodic tick that keeps work going: nine tasks in a fixed order, each a plan over tables of the state.

A task gives the actions that are due (subject, action) and never makes them itself; what it must know of the
tick before comes in as a table and goes out as one, so that a tick may run anywhere and again. Nothing is
collected. A null or missing sign of life counts as none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.session import load
from marlstone.streaming import state

#: Seconds without a worker until it is told, until a worker is gone, until staged files are.
NO_WORKER, GONE, STAGED = 180.0, 900.0, 6 * 3600.0


def _age(now: Column, at: str) -> Column:
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    return seconds(now) - seconds(F.col(at))


def _actions(rows: DataFrame, subject: str, action: Column) -> DataFrame:
    return rows.select(F.col(subject).cast("string").alias("subject"), action.alias("action"))


def without_worker(steps: DataFrame, workers: DataFrame, waiting: DataFrame, now: Column, grace: float = NO_WORKER) -> tuple[DataFrame, DataFrame]:
    """Jobs that can't go on, told after `grace` seconds and then again, and the waiting jobs (job, since) of
    the next tick. A job can't go on if no step runs, some are ready, and no pool of these has a worker
    online. steps: job, status, pool; workers: pool, online."""
    pools = workers.filter("online").select("pool").distinct().withColumn("_able", F.lit(True))
    states = steps.join(pools, "pool", "left").select("job", (F.col("status") == "running").alias("runs"), (F.col("status") == "ready").alias("ready"), ((F.col("status") == "ready") & F.col("_able")).alias("able"))
    found = state.together("job", states, waiting.select("job", "since").filter("job is not null")).agg(*(F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("runs", "ready", "able")), F.min("since").alias("since"))
    now_waiting = found.filter("not runs and ready and not able").select("job", F.coalesce("since", now.cast("timestamp")).alias("since"))
    due = _age(now, "since") >= grace
    told = _actions(now_waiting.filter(due), "job", F.lit("no worker"))
    return told, now_waiting.withColumn("since", F.when(due, now.cast("timestamp")).otherwise(F.col("since")))


def stale_workers(workers: DataFrame, now: Column, limit: float = GONE) -> DataFrame:
    """Workers (worker, heartbeat, registered) without a sign for `limit` seconds: offline where they are
    still registered, else removed."""
    stale = workers.filter(F.col("heartbeat").isNull() | (_age(now, "heartbeat") > limit))
    return _actions(stale, "worker", F.when(F.coalesce("registered", F.lit(False)), "offline").otherwise("removed"))


def staged_orphans(files: DataFrame, live: DataFrame, now: Column, grace: float = STAGED) -> DataFrame:
    """Staged files (execution, modified) of executions that no running step names (live: execution), older
    than `grace` seconds: an action for each execution all of whose files are that old."""
    runs = live.filter("execution is not null").select("execution", F.lit(True).alias("runs"))
    found = state.together("execution", files.select("execution", "modified"), runs).agg(F.max("modified").alias("modified"), F.max("runs").alias("runs"))
    return _actions(found.filter((_age(now, "modified") > grace) & F.col("runs").isNull()), "execution", F.lit("deleted"))


def completions(steps: DataFrame, active: DataFrame, finished: DataFrame, indexed: DataFrame) -> DataFrame:
    """Active jobs all of whose steps are done or skipped are finished; finished jobs without an index are
    indexed. steps: job, status; the others: job."""
    is_ = lambda rows, name: rows.select("job", F.lit(True).alias(name))
    named = lambda rows: rows.filter("job is not null")
    all_ = F.every("ended").alias("all")  # null without steps
    ended = state.together("job", steps.select("job", F.coalesce(F.col("status").isin("done", "skipped"), F.lit(False)).alias("ended")), is_(named(active), "active")).agg(all_, F.max("active").alias("active")).filter("all and active")
    bare = state.together("job", is_(finished, "finished"), is_(named(indexed), "indexed")).agg(F.max("finished").alias("finished"), F.max("indexed").alias("indexed")).filter("finished and indexed is null")
    return _actions(ended, "job", F.lit("finished")).unionByName(_actions(bare, "job", F.lit("indexed")))


def suggestion_batches(batches: DataFrame, results: DataFrame, now: Column, claim: float) -> DataFrame:
    """Batches (batch, status, claimed): those to be queued are, queued ones with a result (batch, ok) are
    done or failed, and those claimed over `claim` seconds ago without one are queued again."""
    found = batches.join(results.groupBy("batch").agg(F.every("ok").alias("ok")), "batch", "left")
    late = _age(now, "claimed") > claim
    fate = F.when(F.col("status") == "pending_enqueue", "queued").when(F.col("status") == "queued", F.when(F.col("ok"), "done").when(~F.col("ok"), "failed").when(late, "queued again"))
    return _actions(found.withColumn("_fate", fate).filter("_fate is not null"), "batch", F.col("_fate"))


def digests(domains: DataFrame, sent: DataFrame, now: Column, weekday: int = 0) -> DataFrame:
    """Domains (domain, active) with news that get the digest of the day: on one day of the week (0: Monday),
    once a day (sent: domain, day)."""
    day = F.to_date(now.cast("timestamp"))
    today = sent.filter(F.col("day") == day).select("domain").distinct()
    return _actions(domains.filter(F.col("active") & (F.weekday(day) == weekday)).select("domain").distinct().join(today, "domain", "left_anti"), "domain", F.lit("digest"))


def tick(tables: dict[str, DataFrame], now: Column, claim: float = 600.0, fresh: float = 180.0, grace: float = 180.0) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The actions (place, task, subject, action) of the tasks of state.TICK in their order, and the tables
    that the next tick needs: `waiting` and `suspects`.

    tables: steps (job, step, status, pool, worker, alive, progress_at, mismatch_since, execution), workers
    (worker, pool, online, heartbeat, registered), held (holder), files, active, finished, indexed, batches,
    results, domains, sent, and from the tick before waiting (job, since) and suspects (holder)."""
    steps, workers = tables["steps"], tables["workers"]
    running = steps.filter("status = 'running'")
    live = running.select("execution").filter("execution is not null")
    told, waiting = without_worker(steps, workers, tables["waiting"], now)
    free, suspects = state.leaked(tables["held"], live.withColumnRenamed("execution", "holder"), tables["suspects"])
    lost = state.orphans(running.withColumn("step", F.col("execution")), now, fresh, grace)
    found = {
        "orphans": _actions(lost, "step", F.col("reason")), "stuck": _actions(state.stuck(running, now), "execution", F.lit("told")), "no_worker": told, "workers": stale_workers(workers, now), "slots": _actions(free, "holder", F.lit("freed")),
        "staging": staged_orphans(tables["files"], live, now), "effects": completions(steps, tables["active"], tables["finished"], tables["indexed"]), "batches": suggestion_batches(tables["batches"], tables["results"], now, claim), "digest": digests(tables["domains"], tables["sent"], now),
    }
    out = None
    for place, name in enumerate(state.TICK):
        rows = found[name].select(F.lit(place).alias("place"), F.lit(name).alias("task"), "subject", "action")
        out = rows if out is None else out.unionByName(rows)
    return out, {"waiting": waiting, "suspects": suspects}


#: Monday, 29 January 2024, noon.
_NOON = 1706529600


def _state(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """Orders as jobs, their lines as steps, suppliers as workers, customers as batches, nations as domains,
    at a Monday's noon."""
    at = lambda seconds: F.timestamp_seconds(F.lit(_NOON) - seconds)
    li, orders, sup = load(s, d, "lineitem"), load(s, d, "orders"), load(s, d, "supplier")
    execution = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    status = F.when(F.col("l_returnflag") == "R", "done").when(F.col("l_returnflag") == "A", "skipped").when((F.col("l_orderkey") + F.col("l_linenumber")) % 5 == 0, "running").otherwise("ready")
    workers = sup.select(F.col("s_suppkey").alias("worker"), F.concat(F.lit("p"), (F.col("s_suppkey") % 4).cast("string")).alias("pool"), (F.col("s_suppkey") % 4 != 1).alias("online"), at(F.col("s_suppkey") * 37 % 2000).alias("heartbeat"), (F.col("s_suppkey") % 3 != 0).alias("registered"))
    steps = li.select(
        F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("step"), status.alias("status"), F.concat(F.lit("p"), (F.col("l_partkey") % 4).cast("string")).alias("pool"), F.col("l_suppkey").alias("_s"), execution.alias("execution"),
        at((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 400).alias("progress_at"), at(F.col("l_partkey") % 300).alias("mismatch_since"),
    ).join(sup.select(F.col("s_suppkey").alias("_s"), F.col("s_suppkey").cast("string").alias("worker"), (F.col("s_suppkey") % 3 != 0).alias("alive")), "_s", "left").drop("_s")
    customer = load(s, d, "customer")
    return {
        "steps": steps, "workers": workers, "held": li.filter("l_quantity > 45").select(execution.alias("holder")), "files": li.filter("l_discount >= 0.09").select(execution.alias("execution"), at(F.col("l_partkey") % 10 * 3600).alias("modified")),
        "active": orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("job")), "finished": orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("job")), "indexed": orders.filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("job")),
        "batches": customer.select(F.col("c_custkey").alias("batch"), F.when(F.col("c_custkey") % 3 == 0, "pending_enqueue").when(F.col("c_custkey") % 3 == 1, "queued").otherwise("done").alias("status"), at(F.col("c_custkey") * 11 % 1200).alias("claimed")),
        "results": customer.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("batch"), (F.col("c_acctbal") > 7000).alias("ok")), "domains": load(s, d, "nation").select(F.col("n_name").alias("domain"), (F.col("n_regionkey") != 0).alias("active")),
        "sent": load(s, d, "nation").filter("n_nationkey % 5 = 0").select(F.col("n_name").alias("domain"), F.to_date(F.timestamp_seconds(F.lit(_NOON))).alias("day")),
    }


def reconciling_ticks(s: SparkSession, d: str) -> DataFrame:
    """The actions of two ticks, three minutes apart: the second knows who waited and was suspect at the first."""
    tables = _state(s, d)
    none = {"waiting": s.createDataFrame([], "job long, since timestamp"), "suspects": s.createDataFrame([], "holder string")}
    at = lambda seconds: F.timestamp_seconds(F.lit(_NOON + seconds))
    first, held = tick(tables | none, at(0))
    second, _ = tick(tables | held, at(180))
    return first.withColumn("tick", F.lit(1)).unionByName(second.withColumn("tick", F.lit(2)))


QUERIES = {"reconciling_ticks": reconciling_ticks}

_STEPS = """
s AS (SELECT l_orderkey AS job, l_orderkey || '-' || l_linenumber AS x, 'p' || (l_partkey % 4) AS pool, CASE WHEN l_returnflag = 'R' THEN 'done' WHEN l_returnflag = 'A' THEN 'skipped' WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN 'running' ELSE 'ready' END AS status, (l_orderkey * 7 + l_linenumber) % 400 AS quiet, l_partkey % 300 AS off, l_suppkey AS w, l_partkey % 10 * 3600 AS old, l_quantity > 45 AS held, l_discount >= 0.09 AS staged FROM lineitem),
t AS (SELECT * FROM (VALUES (1, 0), (2, 180)) v(tick, now)),
j AS (SELECT job FROM s GROUP BY job HAVING NOT bool_or(status = 'running') AND bool_or(status = 'ready') AND NOT bool_or(status = 'ready' AND pool IN (SELECT 'p' || (s_suppkey % 4) FROM supplier WHERE s_suppkey % 4 <> 1)))"""
ORACLES = {
    "reconciling_ticks": f"""
WITH {_STEPS}
SELECT tick, 0 AS place, 'orphans' AS task, x AS subject, CASE WHEN w NOT IN (SELECT s_suppkey FROM supplier) THEN 'no worker' WHEN w % 3 = 0 THEN 'worker lost' ELSE 'claim lost' END AS action FROM s, t WHERE status = 'running' AND (w NOT IN (SELECT s_suppkey FROM supplier) OR w % 3 = 0 OR (now + quiet >= 180 AND now + off >= 180))
UNION ALL SELECT tick, 1, 'stuck', x, 'told' FROM s, t WHERE status = 'running' AND now + quiet > 180
UNION ALL SELECT 2, 2, 'no_worker', job::VARCHAR, 'no worker' FROM j
UNION ALL SELECT tick, 3, 'workers', s_suppkey::VARCHAR, CASE WHEN s_suppkey % 3 <> 0 THEN 'offline' ELSE 'removed' END FROM supplier, t WHERE s_suppkey * 37 % 2000 + now > 900
UNION ALL SELECT DISTINCT 2, 4, 'slots', x, 'freed' FROM s WHERE held AND x NOT IN (SELECT x FROM s WHERE status = 'running')
UNION ALL SELECT tick, 5, 'staging', x, 'deleted' FROM s, t WHERE staged AND x NOT IN (SELECT x FROM s WHERE status = 'running') GROUP BY x, tick, now HAVING min(old) + now > 21600
UNION ALL SELECT tick, 6, 'effects', job::VARCHAR, 'finished' FROM (SELECT job FROM s WHERE job IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0) GROUP BY job HAVING bool_and(status IN ('done', 'skipped'))), t
UNION ALL SELECT tick, 6, 'effects', o_orderkey::VARCHAR, 'indexed' FROM orders, t WHERE o_orderstatus = 'F' AND o_orderkey % 4 = 0
UNION ALL SELECT * FROM (SELECT tick, 7, 'batches', c_custkey::VARCHAR, CASE WHEN c_custkey % 3 = 0 THEN 'queued' WHEN c_custkey % 3 = 1 THEN CASE WHEN c_acctbal > 7000 THEN 'done' WHEN c_acctbal > 5000 THEN 'failed' WHEN c_custkey * 11 % 1200 + now > 600 THEN 'queued again' END END AS f FROM customer, t) WHERE f IS NOT NULL
UNION ALL SELECT tick, 8, 'digest', n_name, 'digest' FROM nation, t WHERE n_regionkey <> 0 AND n_nationkey % 5 <> 0""",
}
