"""Filters, facets, version chains, usage metering and overviews, as plain plans.

The supplied tables stand for the corpus' records: orders for jobs (customer: lineage), line items for
metered calls (return flag and line status: provider and model), nations for domains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.scalars import lenient_time, strict_time
from marlstone.session import load


def listed(rows: DataFrame, order: list, limit: int, offset: int = 0, **equal: object) -> DataFrame:
    """Rows that meet every given equality (None: no such filter), a page of them in a total order."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows.orderBy(*order).offset(offset).limit(max(1, min(limit, 1000)))


def facets(rows: DataFrame, *columns: str) -> DataFrame:
    """facet, value and count of each column's values, in one pass; null values are left out."""
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns)))
    return rows.select(values.alias("x")).select("x.*").filter("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


def current_versions(rows: DataFrame, lineage: str, *order: Column) -> DataFrame:
    """version (1 is newest) and is_current of every row of its lineage."""
    place = F.row_number().over(Window.partitionBy(lineage).orderBy(*order))
    return rows.withColumn("version", place).withColumn("is_current", F.col("version") == 1)


def capped(rows: DataFrame, group: str, per_group: int, limit: int, *order: Column) -> DataFrame:
    """At most per_group rows of a group, then at most limit rows, both in the order."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= per_group).orderBy(*order).limit(limit)


def _orders(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "orders")


def jobs_page(s: SparkSession, d: str) -> DataFrame:
    return listed(_orders(s, d), [F.desc("o_orderdate"), "o_orderkey"], 25, 50, o_orderstatus="F", o_orderpriority=None).select("o_orderkey", "o_orderdate")


def job_lookup(s: SparkSession, d: str) -> DataFrame:
    ids = s.range(0, 900, 7).select(F.col("id").alias("o_orderkey"))
    return _orders(s, d).join(ids, "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus", "o_totalprice")


def job_facets_grouping_sets(s: SparkSession, d: str) -> DataFrame:
    return facets(_orders(s, d), "o_orderstatus", "o_orderpriority")


def jobs_window_strict(s: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate")
    return _orders(s, d).filter((at >= F.lit("1997-03-01").cast("timestamp_ntz")) & (at < F.lit("1997-03-08").cast("timestamp_ntz"))).select("o_orderkey", "o_orderdate")


def _written_times(s: SparkSession, d: str) -> DataFrame:
    """Events with their time as text: with a zone, two hours ahead, without a zone, and no time at all."""
    k, at = F.col("event_id") % 4, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    ahead = F.concat(F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    return load(s, d, "events").select("event_id", F.when(k == 0, F.concat(at, F.lit("Z"))).when(k == 1, ahead).when(k == 2, at).otherwise("soon").alias("at"))


def _between(rows: DataFrame, at: Column) -> DataFrame:
    """The half-open window of a day."""
    return rows.filter((at >= F.lit("2024-01-10 00:00:00").cast("timestamp")) & (at < F.lit("2024-01-11 00:00:00").cast("timestamp"))).select("event_id")


def window_of_strict_times(s: SparkSession, d: str) -> DataFrame:
    """Times without a zone are no times."""
    return _between(_written_times(s, d), strict_time(F.col("at")))


def window_of_lenient_times(s: SparkSession, d: str) -> DataFrame:
    """Times without a zone are UTC."""
    return _between(_written_times(s, d), lenient_time(F.col("at")))


def lineage_current(s: SparkSession, d: str) -> DataFrame:
    """One aggregate: no lineage is sorted whole."""
    newest = F.max_by("o_orderkey", F.struct("o_orderdate", (-F.col("o_orderkey")).alias("k")))
    return _orders(s, d).groupBy("o_custkey").agg(newest.alias("o_orderkey"))


def lineage_counts(s: SparkSession, d: str) -> DataFrame:
    return _orders(s, d).groupBy("o_custkey").agg(F.count("*").alias("versions")).filter("versions > 1")


def digest_per_job_cap(s: SparkSession, d: str) -> DataFrame:
    return capped(load(s, d, "lineitem").filter("l_quantity >= 45"), "l_orderkey", 2, 100, F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")).select("l_orderkey", "l_linenumber", "l_extendedprice")


def usage_summary(s: SparkSession, d: str) -> DataFrame:
    li = load(s, d, "lineitem")
    return li.agg(
        F.count("*").alias("calls"),
        F.coalesce(F.sum("l_quantity"), F.lit(0.0)).alias("tokens"),
        F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("failed"),
        F.count_distinct("l_orderkey").alias("jobs"),
        F.round(F.coalesce(F.sum("l_extendedprice"), F.lit(0.0)), 2).alias("cost"),
    )


def usage_by_model(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("calls"), F.sum("l_quantity").alias("tokens"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("cost"))


def cache_hit_rate(s: SparkSession, d: str) -> DataFrame:
    li = load(s, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(0.0)).alias("hit"), F.sum("l_quantity").alias("all"))
    return li.select("l_suppkey", F.when(F.col("all") == 0, 0.0).otherwise(F.round(F.col("hit") / F.col("all") * 100, 4)).alias("hit_rate"))


def usage_cost_price_table(s: SparkSession, d: str) -> DataFrame:
    """Priced by part; parts without a price (size over 45 here) have a null cost."""
    price = load(s, d, "part").filter("p_size <= 45").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    cost = F.col("l_quantity") * F.col("p_retailprice") * (1 + F.col("l_tax"))
    per = load(s, d, "lineitem").join(price, "l_partkey", "left").groupBy("l_suppkey")
    return per.agg(F.round(F.sum(cost), 4).alias("cost"), F.count(F.when(F.col("p_retailprice").isNull(), 1)).alias("unpriced"))


def throughput_by_status(s: SparkSession, d: str) -> DataFrame:
    recent = _orders(s, d).filter(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    return recent.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def domain_overview(s: SparkSession, d: str) -> DataFrame:
    """Every domain that any table names, with its counts and its latest record."""
    customers, suppliers = load(s, d, "customer"), load(s, d, "supplier")
    orders = _orders(s, d).join(customers.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("k")), "o_custkey").groupBy("k").agg(F.count("*").alias("jobs"), F.max("o_orderdate").alias("latest"))
    by = lambda df, c, n: df.groupBy(F.col(c).alias("k")).agg(F.count("*").alias(n))
    spine = customers.select(F.col("c_nationkey").alias("k")).union(suppliers.select("s_nationkey")).distinct()
    out = spine.join(by(customers, "c_nationkey", "collections"), "k", "left").join(by(suppliers, "s_nationkey", "terms"), "k", "left").join(orders, "k", "left")
    names = load(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("domain"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.join(names, "k").select("domain", zero("collections"), zero("terms"), zero("jobs"), "latest")


def anti_unindexed(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents").select("doc_id").join(load(s, d, "labels").select("doc_id"), "doc_id", "left_anti")


def unreconciled_jobs(s: SparkSession, d: str) -> DataFrame:
    """Documents with no label, or a bad label and no benchmark-like length; flags come by one left join."""
    flags = load(s, d, "labels").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad"))
    return load(s, d, "documents").join(flags, "doc_id", "left").filter(F.col("bad").isNull() | ((F.col("bad") == 1) & (F.col("n_chars") < 1000))).select("doc_id", F.coalesce("bad", F.lit(-1)).alias("bad"))


def evidence_state(s: SparkSession, d: str) -> DataFrame:
    """missing: no such order; stale: a later order of the customer; else valid. The first that holds."""
    latest = _orders(s, d).groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    rows = load(s, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct().withColumn("o_orderkey", F.when(F.col("k") % 11 == 0, -F.col("k") - 1).otherwise(F.col("k")))
    rows = rows.join(_orders(s, d).select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey", "left").join(latest, "o_custkey", "left")
    state = F.when(F.col("o_orderdate").isNull(), "missing").when(F.col("last") > F.col("o_orderdate"), "stale").otherwise("valid")
    return rows.select(F.col("k").alias("evidence"), state.alias("state"))


def merge_classify(s: SparkSession, d: str) -> DataFrame:
    """A snapshot of customers merged into the table: insert, noop, conflict or only there, by digests."""
    c = load(s, d, "customer")
    digest = lambda bal: F.md5(F.concat_ws("|", "c_name", F.round(bal, 2).cast("decimal(18,2)").cast("string")))
    here = c.filter("c_custkey % 5 <> 0").select("c_custkey", digest(F.col("c_acctbal")).alias("a"))
    there = c.filter("c_custkey % 7 <> 0").select("c_custkey", digest(F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))).alias("b"))
    kind = F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "keep").when(F.col("a") == F.col("b"), "noop").otherwise("conflict")
    return here.join(there, "c_custkey", "full_outer").select("c_custkey", kind.alias("kind"))


def merge_units(s: SparkSession, d: str) -> DataFrame:
    """A conflict in any row of a unit (nation) holds back the whole unit."""
    rows = merge_classify(s, d).join(load(s, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return rows.groupBy("c_nationkey").agg(F.bool_or(F.col("kind") == "conflict").alias("poisoned"), F.count(F.when(F.col("kind") == "insert", 1)).alias("inserts"))


def sync_diff(s: SparkSession, d: str) -> DataFrame:
    """Items of a collection before and after a sync: new, gone, moved or same, by position."""
    o = _orders(s, d)
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long")
    before = o.filter("o_orderkey % 4 <> 0").withColumn("p", place).select("o_custkey", "o_orderkey", "p")
    after = o.filter("o_orderkey % 6 <> 0").withColumn("q", place).select("o_custkey", "o_orderkey", "q")
    kind = F.when(F.col("p").isNull(), "new").when(F.col("q").isNull(), "gone").when(F.col("p") != F.col("q"), "moved").otherwise("same")
    return before.join(after, ["o_custkey", "o_orderkey"], "full_outer").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def gc_unreachable(s: SparkSession, d: str) -> DataFrame:
    """Mark and sweep of fixed depth: customers of one segment are roots, their orders are reached, the
    orders' parts are reached; parts that are not are swept."""
    roots = load(s, d, "customer").filter("c_mktsegment = 'BUILDING' and c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    orders = _orders(s, d).join(roots, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    live = load(s, d, "lineitem").join(orders, "l_orderkey", "left_semi").select(F.col("l_partkey").alias("p_partkey"))
    return load(s, d, "part").select("p_partkey").join(live, "p_partkey", "left_anti")


def layered_override(s: SparkSession, d: str) -> DataFrame:
    """Of a part's global, brand and own price the most specific; here all come from one table."""
    p = load(s, d, "part")
    layers = p.select("p_partkey", F.lit(3).alias("rank"), F.lit(1.0).alias("price"))
    brand = p.filter("p_brand = 'Brand#2'").select("p_partkey", F.lit(2).alias("rank"), F.lit(2.0).alias("price"))
    own = p.filter("p_size > 40").select("p_partkey", F.lit(1).alias("rank"), F.col("p_retailprice").alias("price"))
    layers = layers.unionByName(brand).unionByName(own)
    return layers.groupBy("p_partkey").agg(F.min_by("price", "rank").alias("price"))


def hash_chain(s: SparkSession, d: str) -> DataFrame:
    """Rows whose sequence does not go on from the one before, in each user's event ledger."""
    e = load(s, d, "events").filter("event_id % 97 <> 0")
    last = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.withColumn("before", last).withColumn("seq", seq).filter((F.col("before").isNotNull()) & (F.col("event_id") - F.col("before") > 400)).select("user_id", "event_id", "before", F.col("seq").cast("long").alias("seq"))


def bbox_union(s: SparkSession, d: str) -> DataFrame:
    li = load(s, d, "lineitem").groupBy("l_suppkey")
    return li.agg(F.min("l_discount").alias("x0"), F.min("l_tax").alias("y0"), F.max("l_discount").alias("x1"), F.max("l_tax").alias("y1"))


def next_versions(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "customer").join(_orders(s, d).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey", "left").groupBy("c_custkey").agg((F.coalesce(F.count("o_orderkey"), F.lit(0)) + 1).alias("next_version"))


QUERIES = {
    f.__name__: f
    for f in (jobs_page, job_lookup, job_facets_grouping_sets, jobs_window_strict, window_of_strict_times, window_of_lenient_times, lineage_current, lineage_counts, digest_per_job_cap, usage_summary, usage_by_model, cache_hit_rate, usage_cost_price_table, throughput_by_status, domain_overview, anti_unindexed, unreconciled_jobs, evidence_state, merge_classify, merge_units, sync_diff, gc_unreachable, layered_override, hash_chain, bbox_union, next_versions)
}

_MERGE = """
WITH a AS (SELECT c_custkey, md5(c_name || '|' || round(c_acctbal, 2)::DECIMAL(18,2)::VARCHAR) AS a FROM customer WHERE c_custkey % 5 <> 0),
b AS (SELECT c_custkey, md5(c_name || '|' || round(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END, 2)::DECIMAL(18,2)::VARCHAR) AS b FROM customer WHERE c_custkey % 7 <> 0),
m AS (SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a IS NULL THEN 'insert' WHEN b IS NULL THEN 'keep' WHEN a = b THEN 'noop' ELSE 'conflict' END AS kind FROM a FULL JOIN b ON a.c_custkey = b.c_custkey)"""

ORACLES = {
    "jobs_page": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50",
    "job_lookup": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey IN (SELECT unnest(range(0, 900, 7)))",
    "job_facets_grouping_sets": "SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority",
    "jobs_window_strict": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-03-08'",
    "window_of_strict_times": "SELECT event_id FROM events WHERE event_id % 4 IN (0, 1) AND date_trunc('second', ts) >= TIMESTAMP '2024-01-10' AND date_trunc('second', ts) < TIMESTAMP '2024-01-11'",
    "window_of_lenient_times": "SELECT event_id FROM events WHERE event_id % 4 <> 3 AND date_trunc('second', ts) >= TIMESTAMP '2024-01-10' AND date_trunc('second', ts) < TIMESTAMP '2024-01-11'",
    "lineage_current": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1",
    "lineage_counts": "SELECT o_custkey, count(*) AS versions FROM orders GROUP BY o_custkey HAVING count(*) > 1",
    "digest_per_job_cap": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS p FROM lineitem WHERE l_quantity >= 45) SELECT l_orderkey, l_linenumber, l_extendedprice FROM r WHERE p <= 2 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100",
    "usage_summary": "SELECT count(*) AS calls, sum(l_quantity) AS tokens, count(*) FILTER (l_returnflag = 'R') AS failed, count(DISTINCT l_orderkey) AS jobs, round(sum(l_extendedprice), 2) AS cost FROM lineitem",
    "usage_by_model": "SELECT l_returnflag, l_linestatus, count(*) AS calls, sum(l_quantity) AS tokens, round(sum(l_extendedprice * (1 - l_discount)), 4) AS cost FROM lineitem GROUP BY ALL",
    "cache_hit_rate": "SELECT l_suppkey, round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) / sum(l_quantity) * 100, 4) AS hit_rate FROM lineitem GROUP BY l_suppkey",
    "usage_cost_price_table": "SELECT l_suppkey, round(sum(l_quantity * p_retailprice * (1 + l_tax)), 4) AS cost, count(*) FILTER (p_retailprice IS NULL) AS unpriced FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 45) ON p_partkey = l_partkey GROUP BY l_suppkey",
    "throughput_by_status": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' GROUP BY o_orderstatus",
    "domain_overview": """
WITH spine AS (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)
SELECT n_name AS domain, (SELECT count(*) FROM customer WHERE c_nationkey = k) AS collections, (SELECT count(*) FROM supplier WHERE s_nationkey = k) AS terms,
       (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = k) AS jobs, (SELECT max(o_orderdate) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = k) AS latest
FROM spine JOIN nation ON n_nationkey = k""",
    "anti_unindexed": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "unreconciled_jobs": "WITH f AS (SELECT doc_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id) SELECT d.doc_id, coalesce(bad, -1)::INT AS bad FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id WHERE bad IS NULL OR (bad = 1 AND n_chars < 1000)",
    "evidence_state": """
WITH e AS (SELECT DISTINCT l_orderkey AS evidence, CASE WHEN l_orderkey % 11 = 0 THEN -l_orderkey - 1 ELSE l_orderkey END AS k FROM lineitem), m AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY o_custkey)
SELECT evidence, CASE WHEN o_orderdate IS NULL THEN 'missing' WHEN last > o_orderdate THEN 'stale' ELSE 'valid' END AS state FROM e LEFT JOIN orders o ON o.o_orderkey = k LEFT JOIN m ON m.o_custkey = o.o_custkey""",
    "merge_classify": _MERGE + " SELECT * FROM m",
    "merge_units": _MERGE + " SELECT c_nationkey, bool_or(kind = 'conflict') AS poisoned, count(*) FILTER (kind = 'insert') AS inserts FROM m JOIN customer c ON c.c_custkey = m.c_custkey GROUP BY c_nationkey",
    "sync_diff": """
WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders WHERE o_orderkey % 4 <> 0),
b AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS q FROM orders WHERE o_orderkey % 6 <> 0)
SELECT CASE WHEN p IS NULL THEN 'new' WHEN q IS NULL THEN 'gone' WHEN p <> q THEN 'moved' ELSE 'same' END AS kind, count(*) AS n FROM a FULL JOIN b ON a.o_custkey = b.o_custkey AND a.o_orderkey = b.o_orderkey GROUP BY 1""",
    "gc_unreachable": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000)",
    "layered_override": "SELECT p_partkey, CASE WHEN p_size > 40 THEN p_retailprice WHEN p_brand = 'Brand#2' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS price FROM part",
    "hash_chain": "WITH e AS (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events WHERE event_id % 97 <> 0) SELECT user_id, event_id, before, seq FROM e WHERE event_id - before > 400",
    "bbox_union": "SELECT l_suppkey, min(l_discount) AS x0, min(l_tax) AS y0, max(l_discount) AS x1, max(l_tax) AS y1 FROM lineitem GROUP BY l_suppkey",
    "next_versions": "SELECT c_custkey, count(o_orderkey) + 1 AS next_version FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
}
