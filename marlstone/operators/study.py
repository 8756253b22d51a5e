"""Spaced repetition, its statistics, and what calls cost."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.session import load

# The schedule's limits.
LEAST_EASE, MOST_EASE, FIRST_EASE = 1.3, 3.0, 2.5
AGAIN_DAYS, MOST_DAYS = 600 / 86400, 36500.0
GRADES = ("again", "hard", "good", "easy")


def review(interval: float, ease: float, repetitions: int, lapses: int, grade: str) -> tuple[float, float, int, int]:
    """Interval in days, ease, repetitions and lapses of a card after a review."""
    interval, ease = max(0.0, interval), min(MOST_EASE, max(LEAST_EASE, ease))
    if grade == "again":
        return AGAIN_DAYS, round(max(LEAST_EASE, ease - 0.2), 2), 0, lapses + 1
    first, second, growth = {"hard": (1.0, None, 1.2), "good": (1.0, 3.0, ease), "easy": (3.0, 6.0, ease * 1.3)}[grade]
    days = first if repetitions == 0 else second if repetitions == 1 and second else max(1.0, interval * growth)
    ease = {"hard": max(LEAST_EASE, ease - 0.15), "good": ease, "easy": min(MOST_EASE, ease + 0.15)}[grade]
    return min(MOST_DAYS, days), round(ease, 2), repetitions + 1, lapses


def replayed(reviews: DataFrame, card: str, at: str, tie: str, grade: str) -> DataFrame:
    """reviews with interval_days, ease, repetitions, lapses and due_at after each: a card's reviews in
    order, each from the state the one before left. They pass through one task that holds one card's state."""
    schema = reviews.schema
    for name, kind in (("interval_days", "double"), ("ease", "double"), ("repetitions", "integer"), ("lapses", "integer")):
        schema = schema.add(name, kind)
    c, g = reviews.columns.index(card), reviews.columns.index(grade)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, (0.0, FIRST_EASE, 0, 0)
        for batch in batches:
            out = []
            for key, what in zip(batch.column(c).to_pylist(), batch.column(g).to_pylist(), strict=True):
                if (key,) != last:
                    last, state = (key,), (0.0, FIRST_EASE, 0, 0)
                state = review(*state, what) if what in GRADES else state
                out.append(state)
            more = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.float64(), pa.float64(), pa.int32(), pa.int32()), strict=True)] if out else [pa.array([], t) for t in (pa.float64(), pa.float64(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "interval_days", "ease", "repetitions", "lapses"])

    done = reviews.repartition(card).sortWithinPartitions(card, at, tie).mapInArrow(run, schema)
    return done.withColumn("due_at", F.timestamp_micros(F.unix_micros(F.col(at).cast("timestamp")) + F.round(F.col("interval_days") * 86_400_000_000).cast("long")))


def statistics(cards: DataFrame, due: DataFrame, logs: DataFrame, now: Column, domain: str | None = None) -> DataFrame:
    """One row: cards by status, active ones that are due, reviews by grade, reviewed cards and the share of
    reviews that were kept; of all domains or of one. cards: card_id, status, domain; due: card_id, due_at;
    logs: card_id, grade."""
    mine = cards if domain is None else cards.filter(F.col("domain") == domain)
    hit = lambda column, value: F.count(F.when(F.col(column) == value, 1)).alias(value)
    totals = mine.agg(F.count("*").alias("total"), *(hit("status", x) for x in ("suggested", "active", "suspended", "rejected")))
    open_ = mine.filter("status = 'active'").join(due, "card_id").filter(F.col("due_at") <= now).agg(F.count("*").alias("due"))
    said = mine.join(logs, "card_id", "left").agg(F.count("grade").alias("reviews"), F.count_distinct(F.when(F.col("grade").isNotNull(), F.col("card_id"))).alias("reviewed"), *(hit("grade", x) for x in GRADES))
    kept = F.col("hard") + F.col("good") + F.col("easy")
    share = F.when(F.col("reviews") == 0, 0.0).otherwise(F.bround(kept / F.col("reviews"), 4))
    return totals.crossJoin(open_).crossJoin(said).withColumn("kept", kept).withColumn("retention", share)  # one row each


def priced(usage: DataFrame, prices: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """usage (provider, model and four kinds of tokens) with cost: by the model's price, else by that of
    provider/model, else of the provider's other name/model; a kind without a price is free, and without
    any price the cost is null. prices: name and a price for each kind."""
    kinds = ("input", "output", "cache_write", "cache_read")
    other = F.col("provider")
    for name, short in prefixes.items():
        other = F.when(F.col("provider") == name, F.lit(short)).otherwise(other)
    keys = F.array("model", F.concat_ws("/", "provider", "model"), F.concat_ws("/", other, "model"))
    models = usage.select("provider", "model").distinct().select("provider", "model", F.posexplode(keys).alias("place", "name"))
    found = models.join(prices, "name").groupBy("provider", "model").agg(F.min_by(F.struct(*kinds), "place").alias("price"))
    cost = sum((F.col(f"{k}_tokens") * F.coalesce(F.col(f"price.{k}"), F.lit(0.0)) for k in kinds[1:]), F.col("input_tokens") * F.coalesce(F.col("price.input"), F.lit(0.0)))
    return usage.join(found, ["provider", "model"], "left").withColumn("cost", F.when(F.col("price").isNotNull(), cost)).drop("price")


def _reviews(s: SparkSession, d: str) -> DataFrame:
    grade = F.when(F.col("event_type") == "error", "again").when(F.col("event_type") == "view", "hard").when(F.col("event_type") == "click", "good").otherwise("easy")
    return load(s, d, "events").select(F.col("user_id").alias("card_id"), "ts", "event_id", grade.alias("grade"))


def study_replay(s: SparkSession, d: str) -> DataFrame:
    """Each user as a card, its events as reviews."""
    out = replayed(_reviews(s, d), "card_id", "ts", "event_id", "grade")
    return out.select("event_id", F.round("interval_days", 6).alias("interval_days"), "ease", "repetitions", "lapses")


def study_statistics(s: SparkSession, d: str) -> DataFrame:
    """Cards of one nation; a card's status by its balance, due by its last order."""
    cards = load(s, d, "customer").select(F.col("c_custkey").alias("card_id"), F.when(F.col("c_acctbal") < 0, "suspended").when(F.col("c_acctbal") < 500, "suggested").when(F.col("c_acctbal") > 9500, "rejected").otherwise("active").alias("status"), F.col("c_mktsegment").alias("domain"))
    due = load(s, d, "orders").groupBy(F.col("o_custkey").alias("card_id")).agg(F.max("o_orderdate").alias("due_at"))
    return statistics(cards, due, _reviews(s, d).drop("event_id"), F.lit("1998-01-01").cast("timestamp_ntz"), "BUILDING")


PREFIXES = {"N": "none", "R": "returned"}
PRICES = (("O", 1.0, 2.0, None, 0.5), ("A/F", 2.0, 1.0, 0.25, None), ("returned/F", 3.0, None, 1.0, 1.0))


def usage_costs(s: SparkSession, d: str) -> DataFrame:
    """Return flags as providers, line statuses as models: one priced by itself, one by provider, one by the
    provider's other name, one not at all."""
    li = load(s, d, "lineitem")
    usage = li.select(F.col("l_returnflag").alias("provider"), F.col("l_linestatus").alias("model"), F.col("l_quantity").alias("input_tokens"), (F.col("l_linenumber") * 2).alias("output_tokens"), F.col("l_linenumber").alias("cache_write_tokens"), (F.col("l_quantity") / 2).alias("cache_read_tokens"))
    prices = s.createDataFrame(PRICES, "name string, input double, output double, cache_write double, cache_read double")
    out = priced(usage, prices, PREFIXES)
    return out.groupBy("provider", "model").agg(F.round(F.sum("cost"), 4).alias("cost"), F.count(F.when(F.col("cost").isNull(), 1)).alias("unpriced"))


def top_by_length(s: SparkSession, d: str) -> DataFrame:
    """The 20 parts with the longest lists of orders."""
    held = load(s, d, "lineitem").groupBy("l_partkey").agg(F.collect_list("l_orderkey").alias("o"))
    return held.select("l_partkey", F.size("o").cast("long").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(20)


def dated_occurrences(s: SparkSession, d: str) -> DataFrame:
    """Occurrences of terms by their job's month; those whose job is unknown drop out."""
    jobs = load(s, d, "orders").filter("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return load(s, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 10).alias("term")).join(jobs, "l_orderkey").groupBy("term", "month").agg(F.count("*").alias("n"))


def optional_domain(s: SparkSession, d: str) -> DataFrame:
    """Counts of a query with an optional parameter, without and with it."""
    rows = load(s, d, "part")
    count = lambda brand: rows.filter(F.lit(brand).isNull() | (F.col("p_brand") == F.lit(brand))).agg(F.lit(brand or "any").alias("asked"), F.count("*").alias("n"))
    return count(None).unionByName(count("Brand#2"))


def override_layers(s: SparkSession, d: str) -> DataFrame:
    """The nearest layer's text of a part wins, kind before brand before all; a blank text counts as none,
    and without any the part has no row."""
    p = load(s, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    layer = lambda rank, text: p.select("p_partkey", F.lit(rank).alias("rank"), text.alias("text"))
    rows = layer(1, F.when(F.col("p_size") % 3 == 0, F.lit("  ")).when(F.col("p_size") % 3 == 1, F.col("p_type"))).unionByName(layer(2, F.when(F.col("p_size") % 5 != 0, F.col("p_brand")))).unionByName(layer(3, F.when(F.col("p_size") % 2 == 0, F.lit("all"))))
    return rows.filter(F.trim("text") != "").groupBy("p_partkey").agg(F.min_by("text", "rank").alias("text"))


def promoted_versions(s: SparkSession, d: str) -> DataFrame:
    """The current version of each lineage: the newest that is marked so, else the newest of all."""
    rows = load(s, d, "orders").withColumn("marked", F.col("o_orderstatus") == "F")
    return rows.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("marked", "o_orderdate", (-F.col("o_orderkey")).alias("k"))).alias("current"))


def ledger_breaks(s: SparkSession, d: str) -> DataFrame:
    """Entries of a user's ledger that don't name the digest of the entry before: every 89th names another."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    digest = F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type"), 256)
    rows = load(s, d, "events").withColumn("digest", digest).withColumn("named", F.when(F.col("event_id") % 89 == 0, "tampered").otherwise(F.lag("digest").over(w)))
    before = rows.withColumn("right", F.lag("digest").over(w))
    return before.filter(~F.col("named").eqNullSafe(F.col("right"))).select("user_id", "event_id")


QUERIES = {f.__name__: f for f in (study_replay, study_statistics, usage_costs, top_by_length, dated_occurrences, optional_domain, override_layers, promoted_versions, ledger_breaks)}

ORACLES = {
    "study_replay": """
WITH RECURSIVE e AS (SELECT user_id AS k, event_id, CASE event_type WHEN 'error' THEN 'again' WHEN 'view' THEN 'hard' WHEN 'click' THEN 'good' ELSE 'easy' END AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT k, 0::BIGINT AS i, 0::BIGINT AS event_id, 0.0::DOUBLE AS d, 2.5::DOUBLE AS ease, 0 AS reps, 0 AS lapses FROM (SELECT DISTINCT k FROM e)
  UNION ALL SELECT e.k, e.i, e.event_id,
    least(36500.0::DOUBLE, CASE g WHEN 'again' THEN 600.0::DOUBLE / 86400 WHEN 'hard' THEN CASE WHEN reps = 0 THEN 1.0::DOUBLE ELSE greatest(1.0::DOUBLE, d * 1.2::DOUBLE) END
      WHEN 'good' THEN CASE reps WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 3.0::DOUBLE ELSE greatest(1.0::DOUBLE, d * ease) END ELSE CASE reps WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 6.0::DOUBLE ELSE greatest(1.0::DOUBLE, d * (ease * 1.3::DOUBLE)) END END),
    round(CASE g WHEN 'again' THEN greatest(1.3::DOUBLE, ease - 0.2::DOUBLE) WHEN 'hard' THEN greatest(1.3::DOUBLE, ease - 0.15::DOUBLE) WHEN 'good' THEN ease ELSE least(3.0::DOUBLE, ease + 0.15::DOUBLE) END, 2),
    CASE g WHEN 'again' THEN 0 ELSE reps + 1 END, CASE g WHEN 'again' THEN lapses + 1 ELSE lapses END
  FROM r JOIN e ON e.k = r.k AND e.i = r.i + 1)
SELECT event_id, round(d, 6) AS interval_days, ease, reps AS repetitions, lapses FROM r WHERE i > 0""",
    "study_statistics": """
WITH c AS (SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'suspended' WHEN c_acctbal < 500 THEN 'suggested' WHEN c_acctbal > 9500 THEN 'rejected' ELSE 'active' END AS st FROM customer WHERE c_mktsegment = 'BUILDING'),
l AS (SELECT id, event_type AS g FROM c JOIN events ON user_id = id)
SELECT (SELECT count(*) FROM c) AS total, (SELECT count(*) FROM c WHERE st = 'suggested') AS suggested, (SELECT count(*) FROM c WHERE st = 'active') AS active, (SELECT count(*) FROM c WHERE st = 'suspended') AS suspended, (SELECT count(*) FROM c WHERE st = 'rejected') AS rejected,
  (SELECT count(*) FROM c JOIN (SELECT o_custkey, max(o_orderdate) AS due FROM orders GROUP BY 1) ON o_custkey = id WHERE st = 'active' AND due <= TIMESTAMP '1998-01-01') AS due,
  count(*) AS reviews, count(DISTINCT id) AS reviewed, count(*) FILTER (g = 'error') AS again, count(*) FILTER (g = 'view') AS hard, count(*) FILTER (g = 'click') AS good, count(*) FILTER (g NOT IN ('error', 'view', 'click')) AS easy,
  count(*) FILTER (g <> 'error') AS kept, CASE WHEN count(*) = 0 THEN 0.0::DOUBLE ELSE round(count(*) FILTER (g <> 'error')::DOUBLE / count(*), 4) END AS retention FROM l""",
    "usage_costs": """
WITH u AS (SELECT l_returnflag AS provider, l_linestatus AS model, l_quantity AS q, l_linenumber AS n FROM lineitem),
c AS (SELECT provider, model, CASE WHEN model = 'O' THEN q + 4.0::DOUBLE * n + 0.25::DOUBLE * q WHEN provider = 'A' THEN 2 * q + 2.0::DOUBLE * n + 0.25::DOUBLE * n WHEN provider = 'R' THEN 3 * q + n + q / 2 END AS cost FROM u)
SELECT provider, model, round(sum(cost), 4) AS cost, count(*) FILTER (cost IS NULL) AS unpriced FROM c GROUP BY ALL""",
    "top_by_length": "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20",
    "dated_occurrences": "SELECT l_partkey % 10 AS term, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 10 <> 0 GROUP BY ALL",
    "optional_domain": "SELECT 'any' AS asked, count(*) AS n FROM part UNION ALL SELECT 'Brand#2', count(*) FROM part WHERE p_brand = 'Brand#2'",
    "override_layers": "SELECT p_partkey, text FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 1 THEN p_type WHEN p_size % 5 <> 0 THEN p_brand WHEN p_size % 2 = 0 THEN 'all' END AS text FROM part) WHERE text IS NOT NULL",
    "promoted_versions": "SELECT o_custkey, o_orderkey AS current FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_orderdate DESC, o_orderkey) = 1",
    "ledger_breaks": "SELECT user_id, event_id FROM events WHERE event_id % 89 = 0",
}
