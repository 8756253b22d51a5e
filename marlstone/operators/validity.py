"""What still holds: evidence against the jobs and chunks it was taken from, work that is not reconciled yet,
texts under their headings, unlike events in one order of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import scalars as S
from marlstone.session import load


def evidence_states(evidence: DataFrame, jobs: DataFrame, chunks: DataFrame, domain: bool = False) -> DataFrame:
    """evidence with state (valid, stale, missing) and reason, the first that holds of: job_deleted,
    (job_domain_changed, with `domain`,) job_not_done, job_superseded, chunk_removed, chunk_changed.

    evidence: evidence_id, job, chunk, kind, section, start, end, sha256 (and domain); jobs: job, status,
    current (and domain); chunks: chunk, job, kind, section, start, end, body (and domain). job and chunk are
    unique in their tables. Only the chunks' digests travel, never their bodies. Nulls are values of their own."""
    named = ["kind", "section", "start", "end"] + ["domain"] * domain
    j = jobs.select("job", F.col("status").alias("_status"), F.col("current").alias("_current"), F.lit(True).alias("_job"), *([F.col("domain").alias("_job_domain")] if domain else []))
    c = chunks.select("chunk", F.col("job").alias("_of"), *(F.col(n).alias(f"_{n}") for n in named), F.sha2("body", 256).alias("_sha"), F.lit(True).alias("_chunk"))
    same = F.col("_of").eqNullSafe(F.col("job")) & F.col("_sha").eqNullSafe(F.col("sha256"))
    for n in named:
        same = same & F.col(f"_{n}").eqNullSafe(F.col(n))
    reason = F.when(F.col("_job").isNull(), "job_deleted")
    if domain:
        reason = reason.when(~F.col("_job_domain").eqNullSafe(F.col("domain")), "job_domain_changed")
    reason = reason.when(~F.col("_status").eqNullSafe("done"), "job_not_done").when(~F.coalesce("_current", F.lit(False)), "job_superseded").when(F.col("_chunk").isNull(), "chunk_removed").when(~same, "chunk_changed")
    state = F.when(F.col("reason").isNull(), "valid").when(F.col("reason").isin("job_deleted", "chunk_removed"), "missing").otherwise("stale")
    return evidence.join(j, "job", "left").join(c, "chunk", "left").withColumn("reason", reason).withColumn("state", state).select(*evidence.columns, "state", "reason")


def unreconciled(jobs: DataFrame, indexed: DataFrame, projections: DataFrame, tries: DataFrame, now: Column, version: int, empty: str, limit: int = 100) -> DataFrame:
    """The next jobs (job, created, next_retry) whose projection is to be made, longest due first, `limit` of
    them (1 to 1000): current, done and indexed ones, if nothing waits for its retry and no projection of
    this version has rows, where a projection or a try is of another version, or else there is no projection
    with rows and no verdict that the source of a projection of this version is empty.

    jobs: job, status, current, created; indexed: job; projections: job, version, digest, source; tries: job,
    version, state (retry, verified_empty), next_retry, source. Each table is reduced to a row a job before
    any join."""
    has = lambda test: F.max(F.coalesce(test, F.lit(False)).cast("int"))
    mine, rows = F.col("version") == version, F.col("digest") != empty
    p = projections.groupBy("job").agg(has(mine & rows).alias("made"), has(~mine).alias("old"), has(rows).alias("rows"))
    t = tries.groupBy("job").agg(has(mine & (F.col("state") == "retry") & (F.col("next_retry") > now)).alias("waits"), has(~mine).alias("old_try"), F.min("next_retry").alias("next_retry"))
    proved = tries.filter(mine & (F.col("state") == "verified_empty")).select("job", "source").join(projections.filter(mine).select("job", "source"), ["job", "source"], "left_semi").select("job").distinct().withColumn("proved", F.lit(1))
    found = jobs.filter("status = 'done' and current").join(indexed.select("job").distinct(), "job", "left_semi").join(p, "job", "left").join(t, "job", "left").join(proved, "job", "left")
    found = found.na.fill(0, ["made", "old", "rows", "waits", "old_try", "proved"])
    due = found.filter("waits = 0 and made = 0 and (old = 1 or old_try = 1 or (rows = 0 and proved = 0))")
    return due.select("job", "created", "next_retry").orderBy(F.asc_nulls_first("next_retry"), "created", "job").limit(max(1, min(limit, 1000)))


def heading_paths(rows: DataFrame, key: str, order: str, level: str, title: str, deepest: int = 6) -> DataFrame:
    """rows with path: the titles of the headings that a row stands under, outermost first, its own last if
    it is a heading. A heading (its level 1 to `deepest`; other rows: null) ends those of its level and of
    deeper ones. order is unique within a key. One window, no matter how many levels."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = {n: F.last(F.when(F.col(level) == n, F.struct(F.col(order).alias("at"), F.col(title).alias("title"))), ignorenulls=True).over(w) for n in range(1, deepest + 1)}
    out = rows.withColumns({f"_h{n}": c for n, c in last.items()})
    kept = []
    for n in range(1, deepest + 1):
        open_ = F.col(f"_h{n}").isNotNull()
        for higher in range(1, n):
            open_ = open_ & F.coalesce(F.col(f"_h{higher}.at") < F.col(f"_h{n}.at"), F.lit(True))
        kept.append(F.when(open_, F.struct(F.col(f"_h{n}.title").alias("title"))))
    path = F.transform(F.filter(F.array(*kept), lambda x: x.isNotNull()), lambda x: x["title"])
    return out.withColumn("path", path).drop(*(f"_h{n}" for n in last))


def timeline(key: str, at: str, **streams: DataFrame) -> DataFrame:
    """Events of unlike tables as one: stream (its name), key, at, the columns of any of them (null where a
    stream has none) and place in the key's order of time; at one time, in the order of the streams given,
    then of their `id`."""
    out = None
    for n, (name, rows) in enumerate(streams.items()):
        rows = rows.withColumns({"stream": F.lit(name), "_n": F.lit(n)})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(at, "_n", "id"))).drop("_n")


def evidence_reasons(s: SparkSession, d: str) -> DataFrame:
    """Documents as chunks, as evidence taken of them, and as the jobs they came from; by their ids some jobs
    are gone, in another domain, not done or superseded, some chunks gone or changed."""
    k, docs = F.col("doc_id"), load(s, d, "documents").filter("text is not null")
    fields = [F.lit("smart").alias("kind"), F.col("source").alias("section"), F.lit(0).alias("start"), F.length("text").alias("end"), F.col("lang").alias("domain")]
    evidence = docs.select(k.alias("evidence_id"), k.alias("job"), F.concat(F.lit("c"), k.cast("string")).alias("chunk"), *fields, F.sha2("text", 256).alias("sha256"))
    jobs = docs.filter(k % 11 != 1).select(k.alias("job"), F.when(k % 11 == 2, "failed").otherwise("done").alias("status"), (k % 11 != 3).alias("current"), F.when(k % 11 == 4, "moved").otherwise(F.col("lang")).alias("domain"))
    chunks = docs.filter(k % 7 != 1).select(F.concat(F.lit("c"), k.cast("string")).alias("chunk"), k.alias("job"), *fields, F.when(k % 7 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("body"))
    chunks = chunks.withColumn("end", F.when(F.col("job") % 7 == 3, F.col("end") + 1).otherwise(F.col("end")))
    return evidence_states(evidence, jobs, chunks, domain=True).select("evidence_id", "state", "reason")


def unreconciled_next(s: SparkSession, d: str) -> DataFrame:
    """Orders as jobs, returned lines as their index, first lines as projections, second lines as tries; with
    the wait after one more try, the third."""
    li = load(s, d, "lineitem")
    jobs = load(s, d, "orders").select(F.col("o_orderkey").alias("job"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("running").alias("status"), (F.col("o_orderkey") % 7 != 0).alias("current"), F.col("o_orderdate").alias("created"))
    first = li.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("job"), F.when(F.col("l_quantity") > 12, 2).otherwise(1).alias("version"), F.when(F.col("l_discount") < 0.06, "-").otherwise("full").alias("digest"), (F.col("l_suppkey") % 2).alias("source"))
    second = li.filter("l_linenumber = 2").select(
        F.col("l_orderkey").alias("job"), F.when(F.col("l_tax") > 0.02, 2).otherwise(1).alias("version"), F.when(F.col("l_returnflag") == "A", "retry").otherwise("verified_empty").alias("state"), F.col("l_shipdate").alias("next_retry"), (F.col("l_suppkey") % 2).alias("source")
    )
    found = unreconciled(jobs, li.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("job")), first, second, F.lit(_AT).cast("timestamp_ntz"), 2, "-", 1000)
    return found.select("job", F.date_format("next_retry", "yyyy-MM-dd").alias("next_retry"), S.backoff(F.lit(3), 60, 3600).cast("long").alias("wait"))


_AT = "1998-06-01 00:00:00"


def _lines(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return rows.withColumn("level", F.when(F.col("i") % 3 == 0, ((F.col("i") * 7 + F.col("doc_id")) % 4 + 1).cast("int")))


def line_heading_paths(s: SparkSession, d: str) -> DataFrame:
    """Lines of whole documents, every third a heading of a level by its place: how deep all lines stand, and a digest of a
    document's paths."""
    paths = heading_paths(_lines(s, d).withColumn("title", F.col("i").cast("string")), "doc_id", "i", "level", "title").withColumn("p", F.array_join("path", ">"))
    return paths.groupBy("doc_id").agg(F.sum(F.size("path")).alias("depth"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda x: x["p"]), "\n")).alias("digest"))


def order_timeline(s: SparkSession, d: str) -> DataFrame:
    """Orders and the shipments of their lines as one timeline of each customer, with unlike columns."""
    orders = load(s, d, "orders")
    placed = orders.select(F.col("o_custkey").alias("customer"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))
    lines = load(s, d, "lineitem").join(orders.select("o_orderkey", F.col("o_custkey").alias("customer")), F.col("l_orderkey") == F.col("o_orderkey"))
    shipped = lines.select("customer", F.col("l_shipdate").alias("at"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("quantity"))
    out = timeline("customer", "at", order=placed, ship=shipped)
    return out.groupBy("customer", "stream").agg(F.sum("place").alias("places"), F.count("*").alias("n"), F.count("priority").alias("priorities"), F.sum(F.coalesce("quantity", F.lit(0.0))).alias("quantity"))


QUERIES = {f.__name__: f for f in (evidence_reasons, unreconciled_next, line_heading_paths, order_timeline)}

ORACLES = {
    "evidence_reasons": """
WITH e AS (SELECT doc_id, CASE WHEN doc_id % 11 = 1 THEN 'job_deleted' WHEN doc_id % 11 = 4 THEN 'job_domain_changed' WHEN doc_id % 11 = 2 THEN 'job_not_done' WHEN doc_id % 11 = 3 THEN 'job_superseded' WHEN doc_id % 7 = 1 THEN 'chunk_removed' WHEN doc_id % 7 IN (2, 3) THEN 'chunk_changed' END AS reason FROM documents WHERE text IS NOT NULL)
SELECT doc_id AS evidence_id, CASE WHEN reason IS NULL THEN 'valid' WHEN reason IN ('job_deleted', 'chunk_removed') THEN 'missing' ELSE 'stale' END AS state, reason FROM e""",
    "unreconciled_next": f"""
WITH p AS (SELECT l_orderkey AS job, CASE WHEN l_quantity > 12 THEN 2 ELSE 1 END AS version, l_discount >= 0.06 AS full_, l_suppkey % 2 AS source FROM lineitem WHERE l_linenumber = 1),
t AS (SELECT l_orderkey AS job, CASE WHEN l_tax > 0.02 THEN 2 ELSE 1 END AS version, l_returnflag = 'A' AS retry, l_shipdate AS due, l_suppkey % 2 AS source FROM lineitem WHERE l_linenumber = 2),
n AS (SELECT job, min(due) AS due FROM t GROUP BY job)
SELECT o_orderkey AS job, strftime(n.due, '%Y-%m-%d') AS next_retry, 240::BIGINT AS wait FROM orders LEFT JOIN n ON n.job = o_orderkey
WHERE o_orderstatus = 'F' AND o_orderkey % 7 <> 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
  AND o_orderkey NOT IN (SELECT job FROM t WHERE version = 2 AND retry AND due > TIMESTAMP '{_AT}') AND o_orderkey NOT IN (SELECT job FROM p WHERE version = 2 AND full_)
  AND (o_orderkey IN (SELECT job FROM p WHERE version = 1) OR o_orderkey IN (SELECT job FROM t WHERE version = 1)
    OR (o_orderkey NOT IN (SELECT job FROM p WHERE full_) AND o_orderkey NOT IN (SELECT t.job FROM t JOIN p ON p.job = t.job AND p.source = t.source WHERE t.version = 2 AND p.version = 2 AND NOT retry)))
ORDER BY n.due NULLS FIRST, o_orderdate, o_orderkey LIMIT 1000""",
    "line_heading_paths": """
WITH RECURSIVE l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, i, CASE WHEN i % 3 = 0 THEN (i * 7 + doc_id) % 4 + 1 END AS level FROM l),
f AS (SELECT doc_id, i, []::STRUCT(n BIGINT, i BIGINT)[] AS held FROM h WHERE false
  UNION ALL SELECT doc_id, 0, [{'n': level, 'i': i}] FROM h WHERE i = 0),
r AS (SELECT * FROM f UNION ALL SELECT h.doc_id, h.i, CASE WHEN h.level IS NULL THEN r.held ELSE list_append(list_filter(r.held, lambda x: x.n < h.level), {'n': h.level, 'i': h.i}) END FROM r JOIN h ON h.doc_id = r.doc_id AND h.i = r.i + 1)
SELECT doc_id, sum(len(held))::BIGINT AS depth, md5(string_agg(list_aggregate(list_transform(held, lambda x: x.i::VARCHAR), 'string_agg', '>'), chr(10) ORDER BY i)) AS digest FROM r GROUP BY doc_id""",
    "order_timeline": """
WITH u AS (SELECT o_custkey AS customer, o_orderdate AS t, 0 AS k, o_orderkey AS id, o_orderpriority AS priority, 0.0::DOUBLE AS quantity FROM orders UNION ALL SELECT o_custkey, l_shipdate, 1, l_orderkey * 1000 + l_linenumber, NULL, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY t, k, id) AS place FROM u)
SELECT customer, CASE k WHEN 0 THEN 'order' ELSE 'ship' END AS stream, sum(place)::BIGINT AS places, count(*) AS n, count(priority) AS priorities, sum(quantity) AS quantity FROM r GROUP BY customer, k""",
}
