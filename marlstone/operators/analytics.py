"""Timelines, radar, mastery, co-occurrence, statuses.

Events stand for concept occurrences and reviews (event type: term, user: card), line items for
occurrences of terms (part) in jobs (order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.session import load


def bucket(ts: Column, grain: str) -> Column:
    """day, ISO week (YYYY-Www) or month of a time, as text."""
    if grain == "day":
        return F.date_format(ts, "yyyy-MM-dd")
    if grain == "month":
        return F.date_format(ts, "yyyy-MM")
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.extract(F.lit("WEEK"), ts))


def timeline(rows: DataFrame, term: str, ts: str, grain: str) -> DataFrame:
    return rows.groupBy(F.col(term).alias("term"), bucket(F.col(ts), grain).alias("bucket")).agg(F.count("*").alias("n"))


def radar(rows: DataFrame, term: str, ts: str, now: Column, days: int) -> DataFrame:
    """Counts of a term in the last days and in as many before, its first time, and the difference."""
    at = F.col(ts)
    recent = at >= now - F.expr(f"INTERVAL {days} DAYS")
    prior = ~recent & (at >= now - F.expr(f"INTERVAL {2 * days} DAYS"))
    out = rows.filter(at <= now).groupBy(F.col(term).alias("term")).agg(F.count(F.when(recent, 1)).alias("recent"), F.count(F.when(prior, 1)).alias("prior"), F.min(at).alias("first_seen"))
    return out.withColumn("delta", F.col("recent") - F.col("prior"))


#: Rows of jobs that a task pairs.
PAIR_ROWS = 500_000


def pairs(rows: DataFrame, job: str, term: str) -> DataFrame:
    """src, tgt (src < tgt) and weight: how many jobs two terms share. Jobs here hold few terms each.

    Rows are dealt by their number, not by the session's partitions, and before anything is summed, so that
    what a task sorts and sums stays the same however many rows there are."""
    tasks = max(1, -(-rows.count() // PAIR_ROWS))
    terms = rows.select(F.col(job).alias("job"), F.col(term).alias("term")).repartition(tasks, "job").distinct()
    a, b = terms.withColumnRenamed("term", "src"), terms.withColumnRenamed("term", "tgt")
    return a.join(b, "job").filter("src < tgt").select("src", "tgt").repartition(2 * tasks, "src", "tgt").groupBy("src", "tgt").agg(F.count("*").alias("weight"))


def cooccurrence(rows: DataFrame, job: str, term: str, least: int) -> DataFrame:
    """Unordered pairs of terms that share `least` jobs or more."""
    return pairs(rows, job, term).filter(F.col("weight") >= least)


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("node"), "weight")
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def _events(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "events")


def concept_timeline_day(s: SparkSession, d: str) -> DataFrame:
    return timeline(_events(s, d), "event_type", "ts", "day")


def concept_timeline_week(s: SparkSession, d: str) -> DataFrame:
    return timeline(_events(s, d), "event_type", "ts", "week")


def concept_timeline_month(s: SparkSession, d: str) -> DataFrame:
    return timeline(load(s, d, "orders"), "o_orderpriority", "o_orderdate", "month")


def timeline_rollup(s: SparkSession, d: str) -> DataFrame:
    rows = _events(s, d).select(F.col("event_type").alias("term"), bucket(F.col("ts"), "day").alias("day"))
    return rows.rollup("term", "day").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("grain"))


def concept_radar(s: SparkSession, d: str) -> DataFrame:
    return radar(_events(s, d), "event_type", "ts", F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"), 7)


def top_terms(s: SparkSession, d: str) -> DataFrame:
    words = load(s, d, "documents").select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[ \n]+"))).alias("term")).filter(F.char_length("term") >= 8)
    return words.groupBy("term").agg(F.count("*").alias("jobs")).orderBy(F.desc("jobs"), "term").limit(30)


def tag_frequency(s: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k INT")["k"]
    return _events(s, d).select(k.alias("tag")).filter("tag is not null").groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(20)


def mastery_by_concept(s: SparkSession, d: str) -> DataFrame:
    """The latest grade of each card, averaged by concept, and its level."""
    grade = F.when(F.col("event_type") == "purchase", 100).when(F.col("event_type") == "signup", 70).when(F.col("event_type") == "click", 40).otherwise(0)
    last = Window.partitionBy("user_id", F.col("event_id") % 12).orderBy(F.desc("ts"), F.desc("event_id"))
    latest = _events(s, d).withColumn("concept", (F.col("event_id") % 12)).withColumn("grade", grade).withColumn("place", F.row_number().over(last)).filter("place = 1")
    out = latest.groupBy("concept").agg(F.count("*").alias("cards"), F.round(F.avg("grade"), 0).cast("int").alias("score"), F.max("ts").alias("last_review"))
    return out.withColumn("level", F.when(F.col("score") >= 85, "mastered").when(F.col("score") >= 60, "learning").otherwise("fragile"))


def study_stats(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d)
    good = F.col("event_type").isin("purchase", "signup")
    return e.agg(F.count_distinct("user_id").alias("cards"), F.count("*").alias("reviews"), F.count(F.when(good, 1)).alias("kept"), F.round(F.count(F.when(good, 1)) / F.count("*"), 4).alias("retention"))


def due_cards(s: SparkSession, d: str) -> DataFrame:
    """Customers whose last order is older than 400 days on a set day, oldest first."""
    last = load(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    due = load(s, d, "customer").join(last, "c_custkey", "left").filter(F.col("last").isNull() | (F.col("last") < F.lit("2000-06-01").cast("timestamp_ntz")))
    return due.select("c_custkey", F.date_format("last", "yyyy-MM-dd").alias("last"))


def concept_cooccurrence_graph(s: SparkSession, d: str) -> DataFrame:
    return cooccurrence(load(s, d, "lineitem"), "l_orderkey", "l_suppkey", 12)


def graph_degree_stats(s: SparkSession, d: str) -> DataFrame:
    return degrees(cooccurrence(load(s, d, "lineitem"), "l_orderkey", "l_suppkey", 12))


def counter_rates(s: SparkSession, d: str) -> DataFrame:
    """Rates of a counter sampled by day: its growth over the seconds since the sample before, 0 at least."""
    day = _events(s, d).groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.round(F.sum(F.col("value") * 100)).cast("long").alias("x"))
    w = Window.partitionBy("event_type").orderBy("day")
    dt = F.unix_seconds(F.col("day").cast("timestamp")) - F.unix_seconds(F.lag("day").over(w).cast("timestamp"))
    out = day.withColumn("before", F.lag("x").over(w)).withColumn("rate", F.greatest(F.lit(0.0), (F.col("x") - F.col("before")) / dt))
    return out.filter("before is not null").select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("rate", 6).alias("rate"))


ONLINE_SECONDS, STALE_SECONDS = 30, 900


def worker_status(last: Column, now: Column, job: Column, paused: Column, online: int = ONLINE_SECONDS, stale: int = STALE_SECONDS) -> Column:
    """A worker's state by the age of its last sign: paused while it is online and held, stale without a
    sign or behind the longer limit, offline behind the shorter, else busy with a job or idle."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp"))
    here = F.coalesce(age <= online * 1_000_000, F.lit(False))
    return F.when(here & F.coalesce(paused, F.lit(False)), "paused").when(age.isNull() | (age > stale * 1_000_000), "stale").when(~here, "offline").when(job.isNotNull() & (job != ""), "busy").otherwise("idle")


def component_status(last: Column, now: Column, online: int = ONLINE_SECONDS, stale: int = STALE_SECONDS) -> Column:
    """A component's state: unknown without a sign, up, degraded or down."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp"))
    return F.when(age.isNull(), "unknown").when(age <= online * 1_000_000, "up").when(age <= stale * 1_000_000, "degraded").otherwise("down")


def _signs(s: SparkSession, d: str) -> DataFrame:
    """Each user as a worker: its last event is its last sign, looked at some seconds later; one in eleven
    never gave one. What it did last is its job, unless that was a view; one in five is held."""
    last = _events(s, d).groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("event_type", F.struct("ts", "event_id")).alias("doing"))
    late = F.expr("make_dt_interval(0, 0, 0, user_id * 37 % 1000)")
    return last.select("user_id", F.when(F.col("user_id") % 11 != 0, F.col("ts")).alias("last"), (F.col("ts") + late).alias("now"), F.when(F.col("doing") != "view", F.col("doing")).alias("job"), (F.col("user_id") % 5 == 0).alias("paused"))


def status_from_heartbeat(s: SparkSession, d: str) -> DataFrame:
    return _signs(s, d).select("user_id", worker_status(F.col("last"), F.col("now"), F.col("job"), F.col("paused")).alias("status"))


def component_states(s: SparkSession, d: str) -> DataFrame:
    return _signs(s, d).select("user_id", component_status(F.col("last"), F.col("now")).alias("status"))


def readiness(checks: DataFrame, *by: str) -> DataFrame:
    """not_ready where a required check is in error, else degraded where any is not ok, else ready; and
    the checks that are not ok, those in the way as blocking. checks: name, required, status."""
    bad = F.coalesce(F.col("status") != "ok", F.lit(True))
    block = F.coalesce(F.col("required"), F.lit(False)) & F.coalesce(F.col("status") == "error", F.lit(False))
    found = F.array_sort(F.collect_list(F.when(bad, F.concat(F.col("name"), F.lit(":"), F.when(block, "blocking").otherwise("degraded")))))
    out = checks.groupBy(*by).agg(F.bool_or(block).alias("_block"), F.bool_or(bad).alias("_bad"), F.array_join(found, ",").alias("reasons"))
    return out.select(*by, F.when(F.col("_block"), "not_ready").when(F.col("_bad"), "degraded").otherwise("ready").alias("status"), "reasons")


def readiness_by_segment(s: SparkSession, d: str) -> DataFrame:
    """Nations as systems; their customers' segments as checks, required but for HOUSEHOLD: in error from
    a debt of 900 on, degraded from any debt on."""
    per = load(s, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_acctbal").alias("least"))
    checks = per.select("c_nationkey", F.col("c_mktsegment").alias("name"), (F.col("c_mktsegment") != "HOUSEHOLD").alias("required"), F.when(F.col("least") <= -900, "error").when(F.col("least") < 0, "degraded").otherwise("ok").alias("status"))
    return readiness(checks, "c_nationkey")


def pool_summary(s: SparkSession, d: str) -> DataFrame:
    pools = F.array_distinct(F.array((F.col("user_id") % 3), (F.col("user_id") % 5)))
    return status_from_heartbeat(s, d).select(F.explode(pools).alias("pool"), "status").groupBy("pool").agg(F.count(F.when(F.col("status").isin("busy", "idle", "paused"), 1)).alias("online"), F.count(F.when(F.col("status") == "busy", 1)).alias("busy"), F.count(F.when(F.col("status") == "paused", 1)).alias("paused"))


def term_conflicts(s: SparkSession, d: str) -> DataFrame:
    """Names with more than one distinct type."""
    return load(s, d, "part").groupBy("p_name").agg(F.array_sort(F.collect_set("p_type")).alias("types")).filter(F.size("types") > 2).select("p_name", F.array_join("types", ",").alias("types"))


def nearest_rank(s: SparkSession, d: str) -> DataFrame:
    at = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)").alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"))]
    return _events(s, d).groupBy("event_type").agg(*at)


def set_fingerprint(s: SparkSession, d: str) -> DataFrame:
    """One digest for the set of suppliers of each part."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_set("l_suppkey")), lambda x: x.cast("string")), ",")
    return load(s, d, "lineitem").groupBy("l_partkey").agg(F.sha2(ids, 256).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (concept_timeline_day, concept_timeline_week, concept_timeline_month, timeline_rollup, concept_radar, top_terms, tag_frequency, mastery_by_concept, study_stats, due_cards, concept_cooccurrence_graph, graph_degree_stats, counter_rates, status_from_heartbeat, component_states, readiness_by_segment, pool_summary, term_conflicts, nearest_rank, set_fingerprint)
}

_GRAPH = "WITH p AS (SELECT DISTINCT l_orderkey AS job, l_suppkey AS term FROM lineitem), e AS (SELECT a.term AS src, b.term AS tgt, count(*) AS weight FROM p a JOIN p b ON a.job = b.job AND a.term < b.term GROUP BY ALL HAVING count(*) >= 12)"
_STATUS = """WITH w AS (SELECT user_id, CASE WHEN user_id % 11 <> 0 THEN max(ts) END AS last, max(ts) + to_seconds(user_id * 37 % 1000) AS now, arg_max(event_type, (ts, event_id)) AS doing FROM events GROUP BY user_id),
a AS (SELECT *, epoch_us(now) - epoch_us(last) AS age FROM w),
st AS (SELECT user_id, CASE WHEN age <= 30000000 AND user_id % 5 = 0 THEN 'paused' WHEN age IS NULL OR age > 900000000 THEN 'stale' WHEN age > 30000000 THEN 'offline' WHEN doing <> 'view' THEN 'busy' ELSE 'idle' END AS status FROM a)"""

ORACLES = {
    "concept_timeline_day": "SELECT event_type AS term, strftime(ts, '%Y-%m-%d') AS bucket, count(*) AS n FROM events GROUP BY ALL",
    "concept_timeline_week": "SELECT event_type AS term, strftime(ts, '%G-W%V') AS bucket, count(*) AS n FROM events GROUP BY ALL",
    "concept_timeline_month": "SELECT o_orderpriority AS term, strftime(o_orderdate, '%Y-%m') AS bucket, count(*) AS n FROM orders GROUP BY ALL",
    "timeline_rollup": "SELECT event_type AS term, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, grouping(event_type, strftime(ts, '%Y-%m-%d'))::BIGINT AS grain FROM events GROUP BY ROLLUP (event_type, strftime(ts, '%Y-%m-%d'))",
    "concept_radar": "WITH r AS (SELECT event_type AS term, count(*) FILTER (ts >= TIMESTAMP '2024-01-18') AS recent, count(*) FILTER (ts < TIMESTAMP '2024-01-18' AND ts >= TIMESTAMP '2024-01-11') AS prior, min(ts) AS first_seen FROM events WHERE ts <= TIMESTAMP '2024-01-25' GROUP BY event_type) SELECT *, recent - prior AS delta FROM r",
    "top_terms": "WITH w AS (SELECT unnest(list_distinct(string_split_regex(lower(text), '[ \\n]+'))) AS term FROM documents) SELECT term, count(*) AS jobs FROM w WHERE length(term) >= 8 GROUP BY term ORDER BY jobs DESC, term LIMIT 30",
    "tag_frequency": "SELECT (props->>'k')::INT AS tag, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, tag LIMIT 20",
    "mastery_by_concept": """
WITH g AS (SELECT event_id % 12 AS concept, user_id, ts, CASE event_type WHEN 'purchase' THEN 100 WHEN 'signup' THEN 70 WHEN 'click' THEN 40 ELSE 0 END AS grade FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 12 ORDER BY ts DESC, event_id DESC) = 1),
c AS (SELECT concept, count(*) AS cards, round(avg(grade), 0)::INT AS score, max(ts) AS last_review FROM g GROUP BY concept)
SELECT *, CASE WHEN score >= 85 THEN 'mastered' WHEN score >= 60 THEN 'learning' ELSE 'fragile' END AS level FROM c""",
    "study_stats": "SELECT count(DISTINCT user_id) AS cards, count(*) AS reviews, count(*) FILTER (event_type IN ('purchase', 'signup')) AS kept, round(count(*) FILTER (event_type IN ('purchase', 'signup'))::DOUBLE / count(*), 4) AS retention FROM events",
    "due_cards": "WITH l AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY o_custkey) SELECT c_custkey, strftime(last, '%Y-%m-%d') AS last FROM customer LEFT JOIN l ON o_custkey = c_custkey WHERE last IS NULL OR last < TIMESTAMP '2000-06-01'",
    "concept_cooccurrence_graph": _GRAPH + " SELECT * FROM e",
    "graph_degree_stats": _GRAPH + " SELECT node, count(*) AS degree, sum(weight)::BIGINT AS strength FROM (SELECT src AS node, weight FROM e UNION ALL SELECT tgt, weight FROM e) GROUP BY node",
    "counter_rates": """
WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, round(sum(value * 100))::BIGINT AS x FROM events GROUP BY ALL),
r AS (SELECT event_type, day, greatest(0.0::DOUBLE, (x - lag(x) OVER w)::DOUBLE / (epoch(day) - epoch(lag(day) OVER w))) AS rate, lag(x) OVER w AS px FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day))
SELECT event_type, strftime(day, '%Y-%m-%d') AS day, round(rate, 6) AS rate FROM r WHERE px IS NOT NULL""",
    "status_from_heartbeat": _STATUS + " SELECT * FROM st",
    "component_states": _STATUS + " SELECT user_id, CASE WHEN age IS NULL THEN 'unknown' WHEN age <= 30000000 THEN 'up' WHEN age <= 900000000 THEN 'degraded' ELSE 'down' END AS status FROM a",
    "readiness_by_segment": """
WITH c AS (SELECT c_nationkey, c_mktsegment AS name, CASE WHEN min(c_acctbal) <= -900 THEN 'error' WHEN min(c_acctbal) < 0 THEN 'degraded' ELSE 'ok' END AS status FROM customer GROUP BY ALL),
f AS (SELECT *, status = 'error' AND name <> 'HOUSEHOLD' AS block FROM c)
SELECT c_nationkey, CASE WHEN bool_or(block) THEN 'not_ready' WHEN bool_or(status <> 'ok') THEN 'degraded' ELSE 'ready' END AS status,
       coalesce(string_agg(name || CASE WHEN block THEN ':blocking' ELSE ':degraded' END, ',' ORDER BY name) FILTER (status <> 'ok'), '') AS reasons FROM f GROUP BY c_nationkey""",
    "pool_summary": _STATUS + ", p AS (SELECT unnest(list_distinct([user_id % 3, user_id % 5])) AS pool, status FROM st) SELECT pool, count(*) FILTER (status IN ('busy', 'idle', 'paused')) AS online, count(*) FILTER (status = 'busy') AS busy, count(*) FILTER (status = 'paused') AS paused FROM p GROUP BY pool",
    "term_conflicts": "SELECT p_name, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS types FROM part GROUP BY p_name HAVING count(DISTINCT p_type) > 2",
    "nearest_rank": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type",
    "set_fingerprint": "SELECT l_partkey, sha256(array_to_string(list_sort(list(DISTINCT l_suppkey)), ',')) AS digest FROM lineitem GROUP BY l_partkey",
}
