"""Changes to tables as plans: a table and what happens to it give the new table and what came of each
change. Nothing is changed in place; write the result as a new snapshot, or with write_partitions()."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.session import load


def upsert(table: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """table with the changes in, in order: of each column the last value that a key's changes give, else its own."""
    last = changes.groupBy(*key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in changes.columns if c not in (*key, order)), F.lit(True).alias("_hit"))
    both = table.join(last, key, "full_outer")
    return both.select(*key, *(F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in last.columns else F.col(c) for c in table.columns if c not in key))


def replace_partitions(table: DataFrame, new: DataFrame, parts: list[str], emptied: DataFrame | None = None) -> DataFrame:
    """table with every partition that new (or emptied) names replaced by new's rows."""
    named = new.select(*parts).distinct() if emptied is None else new.select(*parts).union(emptied.select(*parts)).distinct()
    return table.join(named, parts, "left_anti").unionByName(new)


def write_partitions(new: DataFrame, path: str, parts: list[str]) -> None:
    """Replace just the partitions that new holds of a partitioned table."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def compare_and_set(table: DataFrame, changes: DataFrame, key: str, revision: str) -> tuple[DataFrame, DataFrame]:
    """The table after changes that expect (column expected) the revision it has, each raising it by one, and
    each change's outcome: applied, conflict, missing, or superseded where another change of the key came
    first (column request, ascending)."""
    seen = changes.join(table.select(key, F.col(revision).alias("_now")), key, "left")
    fits = F.col("expected") == F.col("_now")
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce(fits, F.lit(False)).desc(), "request"))
    outcome = F.when(F.col("_now").isNull(), "missing").when(~fits, "conflict").when(F.col("_nth") > 1, "superseded").otherwise("applied")
    seen = seen.withColumn("_nth", first).withColumn("outcome", outcome)
    good = seen.filter("outcome = 'applied'")
    fields = [c for c in table.columns if c not in (key, revision) and c in changes.columns]
    named = good.select(key, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in fields))
    out = table.join(named, key, "left")
    out = out.select(key, *((F.coalesce(f"_{c}", c) if c in fields else F.col(c) + F.when(F.col("_hit"), 1).otherwise(0) if c == revision else F.col(c)).alias(c) for c in table.columns if c != key))
    return out, seen.select("request", key, "outcome")


def requests(ledger: DataFrame, incoming: DataFrame) -> DataFrame:
    """What becomes of requests (request_id, fingerprint): replayed with the stored outcome, conflict where
    the id was used for something else, new for the first of an id that is not in the ledger."""
    first = F.row_number().over(Window.partitionBy("request_id").orderBy("seq"))
    own = F.first("fingerprint").over(Window.partitionBy("request_id").orderBy("seq"))
    seen = incoming.withColumn("_nth", first).withColumn("_own", own).join(ledger.select("request_id", F.col("fingerprint").alias("_was"), "outcome"), "request_id", "left")
    known = F.coalesce("_was", F.when(F.col("_nth") > 1, F.col("_own")))
    kind = F.when(known.isNull(), "new").when(known == F.col("fingerprint"), "replayed").otherwise("conflict")
    return seen.select("seq", "request_id", kind.alias("kind"), F.when(kind == "replayed", F.col("outcome")).alias("outcome"))


#: How far an entry is; the farther wins.
STATUSES = ("rejected", "suggested", "accepted")


def merged_entries(members: DataFrame, target: str) -> DataFrame:
    """One row a target from its entries (term, status, definition, locked, aliases, occurrences of job and
    n): the farthest status, the longest definition (then the least), locked if any is; all names but the
    target as aliases; of a job's occurrences the largest count."""
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    longest = F.max_by("definition", F.struct(F.length("definition"), -F.ascii("definition"), F.col("term")))
    names = F.array_distinct(F.flatten(F.collect_set(F.concat(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>"))))))
    entries = members.groupBy(target).agg(F.max(F.struct(rank, "status")).alias("s"), longest.alias("definition"), F.bool_or("locked").alias("locked"), names.alias("names"))
    seen = members.select(target, F.explode("occurrences").alias("o")).groupBy(target, "o.job").agg(F.max("o.n").alias("n")).groupBy(target).agg(F.count("*").alias("jobs"), F.sum("n").alias("hits"))
    out = entries.join(seen, target, "left")
    return out.select(target, "s.status", "definition", "locked", F.array_sort(F.filter("names", lambda x: x != F.col(target))).alias("aliases"), F.coalesce("jobs", F.lit(0)).alias("jobs"), F.coalesce("hits", F.lit(0)).alias("hits"))


def suggestions(glossary: DataFrame, new: DataFrame, index: DataFrame) -> DataFrame:
    """The entries that suggestions (job, key, name) come to: one whose key the index (key, entity) knows
    goes to that entity, else to its own name; a rejected entity takes none; an entity of two jobs and more
    is accepted, else it keeps its status, a new one is suggested."""
    placed = new.join(index, "key", "left").select("job", F.coalesce("entity", "name").alias("entity"))
    counted = placed.groupBy("entity").agg(F.count_distinct("job").alias("new_jobs"))
    both = counted.join(glossary.select(F.col("term").alias("entity"), "status", "jobs"), "entity", "left").filter("status is null or status <> 'rejected'")
    jobs = F.coalesce("jobs", F.lit(0)) + F.col("new_jobs")
    return both.select("entity", jobs.alias("jobs"), F.when(jobs >= 2, "accepted").otherwise(F.coalesce("status", F.lit("suggested"))).alias("status"))


def renamed(tables: dict[str, DataFrame], column: str, old: str, new: str, unique: dict[str, list[str]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table with the value renamed, and the rows that would then collide on a unique key (table, key)."""
    change = F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column))
    out = {name: df.withColumn(column, change) for name, df in tables.items()}
    clashes = [out[name].groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(name).alias("table"), F.concat_ws("/", *key).alias("key")) for name, key in unique.items()]
    return out, reduce(DataFrame.unionByName, clashes)


def cascaded(gone: DataFrame, key: str, owned: dict[str, DataFrame], detached: dict[str, DataFrame], stripped: dict[str, tuple[DataFrame, str, str, str]]) -> dict[str, DataFrame]:
    """Tables after the rows of some keys went: owned tables lose theirs, detached ones have the key set to
    null, stripped ones (table, its key, array column, field) lose the array's elements of those keys."""
    marks = gone.select(key).distinct()
    out = {name: df.join(marks, key, "left_anti") for name, df in owned.items()}
    flagged = marks.withColumn("_gone", F.lit(True))
    out |= {name: df.join(flagged, key, "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone") for name, df in detached.items()}
    for name, (df, own, array, field) in stripped.items():
        held = df.select(F.col(own).alias("_own"), F.posexplode(array).alias("_pos", "_x")).withColumn(key, F.col(f"_x.{field}"))
        kept = held.join(marks, key, "left_anti").groupBy("_own").agg(F.array_sort(F.collect_list(F.struct("_pos", "_x"))).alias("_kept"))
        empty = F.array().cast(df.schema[array].dataType)
        out[name] = df.join(kept, F.col(own) == F.col("_own"), "left").withColumn(array, F.coalesce(F.transform("_kept", lambda x: x["_x"]), empty)).drop("_own", "_kept")
    return out


def digest_of(*columns: str, order: list[str]) -> Column:
    """One digest of a group's rows in an order of their own."""
    return F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(*order, *(c for c in columns if c not in order))))), 256)


def changed_projections(ledger: DataFrame, new: DataFrame, job: str, columns: list[str]) -> DataFrame:
    """job and digest of the jobs whose rows are others than the ledger (job, digest) knows; a job without
    rows any more has the digest of an empty list."""
    now = new.groupBy(job).agg(digest_of(*columns, order=columns).alias("digest"))
    empty = F.sha2(F.lit("[]"), 256)
    both = now.join(ledger.select(job, F.col("digest").alias("_was")), job, "full_outer").withColumn("digest", F.coalesce("digest", empty))
    return both.filter("_was is null or _was <> digest").select(job, "digest")


def saved_versions(versions: DataFrame, saves: DataFrame, key: list[str]) -> DataFrame:
    """versions with the saves (content, seq, overwrite) in: an overwrite replaces the newest version's
    content, if there is one; each other save makes the next version. Several saves of a key go by seq."""
    newest = versions.groupBy(*key).agg(F.max("version").alias("_top"))
    order = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("overwrite") & ((F.coalesce("_top", F.lit(0)) > 0) | (F.row_number().over(Window.partitionBy(*key).orderBy("seq")) > 1)), 0).otherwise(1)
    placed = saves.join(newest, key, "left").withColumn("_step", step).withColumn("version", F.coalesce("_top", F.lit(0)) + F.sum("_step").over(order))
    last = placed.groupBy(*key, "version").agg(F.max_by("content", "seq").alias("_new"))
    out = versions.select(*key, "version", "content").join(last, [*key, "version"], "full_outer")
    return out.select(*key, F.col("version").cast("long").alias("version"), F.coalesce("_new", "content").alias("content"))


def put(store: DataFrame, new: DataFrame) -> DataFrame:
    """What becomes of contents (name: the digest it is stored under, content): same, stored, corrupt where
    the name is not its digest, differs where the store has other bytes under the name."""
    both = new.groupBy("name").agg(F.min("content").alias("content")).join(store.select("name", F.col("content").alias("_had")), "name", "left")
    kind = F.when(F.col("name") != F.sha2("content", 256), "corrupt").when(F.col("_had").isNull(), "stored").when(F.col("_had") == F.col("content"), "same").otherwise("differs")
    return both.select("name", kind.alias("kind"))


def scrubbed(store: DataFrame) -> DataFrame:
    """name and kind (ok, corrupt, empty) of every stored content by its own digest."""
    kind = F.when(F.col("content").isNull(), "empty").when(F.sha2("content", 256) == F.col("name"), "ok").otherwise("corrupt")
    return store.select("name", kind.alias("kind"))


#: How a table may leave its home: A as it is, B without secrets, C as digests, D not at all, E rebuilt there.
CLASSES = {"documents": "A", "labels": "A", "pages": "B", "conversations": "C", "customer": "D", "embeddings": "E"}


def classified(names: list[str], allowed: dict[str, str] = CLASSES) -> dict[str, str]:
    if unknown := sorted(set(names) - set(allowed)):
        raise ValueError(f"tables without a class: {', '.join(unknown)}")
    return {n: allowed[n] for n in names}


def stale_definitions(definitions: DataFrame, inputs: DataFrame, key: str) -> DataFrame:
    """key and reason of the definitions whose inputs are others now: no digest, changed or without inputs."""
    both = definitions.select(key, "input_hash").join(inputs.groupBy(key).agg(digest_of("input", order=["input"]).alias("_now")), key, "left")
    reason = F.when(F.col("input_hash").isNull(), "no digest").when(F.col("_now").isNull(), "no inputs").when(F.col("_now") != F.col("input_hash"), "changed")
    return both.select(key, reason.alias("reason")).filter("reason is not null")


def _orders(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "orders")


def upsert_rows(s: SparkSession, d: str) -> DataFrame:
    """Customers, and their orders as changes of balance (null for pending ones) and segment."""
    base = load(s, d, "customer").filter("c_custkey % 4 <> 0").select("c_custkey", "c_acctbal", "c_mktsegment")
    changes = _orders(s, d).select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("c_acctbal"), F.col("o_orderpriority").alias("c_mktsegment"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return upsert(base, changes, ["c_custkey"], "at")


def replaced_partitions(s: SparkSession, d: str) -> DataFrame:
    """Line items of every third order anew, at half the quantity; of every eleventh none any more."""
    li = load(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = li.filter("l_orderkey % 3 = 0 and l_orderkey % 11 <> 0 and l_linenumber <= 2").withColumn("l_quantity", F.col("l_quantity") / 2)
    return replace_partitions(li, new, ["l_orderkey"], li.filter("l_orderkey % 11 = 0")).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def _cas(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    table = load(s, d, "customer").select("c_custkey", (F.col("c_custkey") % 3 + 1).alias("revision"), "c_mktsegment")
    changes = _orders(s, d).select(F.col("o_orderkey").alias("request"), (F.col("o_custkey") + F.when(F.col("o_orderkey") % 50 == 0, 100000000).otherwise(0)).alias("c_custkey"), (F.col("o_orderkey") % 3 + 1).alias("expected"), F.col("o_orderpriority").alias("c_mktsegment"))
    return compare_and_set(table, changes, "c_custkey", "revision")


def cas_table(s: SparkSession, d: str) -> DataFrame:
    return _cas(s, d)[0]


def cas_outcomes(s: SparkSession, d: str) -> DataFrame:
    return _cas(s, d)[1]


def request_outcomes(s: SparkSession, d: str) -> DataFrame:
    """Events as requests, the user and day as id, the event's type as fingerprint; the ledger has even users'
    first days."""
    e = load(s, d, "events").select(F.col("event_id").alias("seq"), F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("request_id"), F.col("event_type").alias("fingerprint"), "user_id")
    ledger = e.filter("user_id % 2 = 0 and seq % 5 = 0").groupBy("request_id").agg(F.min_by("fingerprint", "seq").alias("fingerprint"), F.min("seq").cast("string").alias("outcome"))
    return requests(ledger, e)


def _members(s: SparkSession, d: str) -> DataFrame:
    part = load(s, d, "part")
    status = F.when(F.col("p_size") > 40, "accepted").when(F.col("p_size") > 10, "suggested").otherwise("rejected")
    jobs = load(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").cast("string").alias("job")).agg(F.count("*").alias("n")).groupBy("p_partkey").agg(F.collect_list(F.struct("job", "n")).alias("occurrences"))
    none = F.array().cast("array<struct<job:string,n:bigint>>")
    rows = part.join(jobs, "p_partkey", "left")
    term = F.concat(F.lit("t"), F.col("p_partkey").cast("string"))
    return rows.select(F.concat(F.lit("t"), (F.col("p_partkey") % 40).cast("string")).alias("target"), term.alias("term"), status.alias("status"), F.concat_ws(" ", "p_type", F.col("p_partkey").cast("string")).alias("definition"), (F.col("p_size") == 1).alias("locked"), F.array(F.col("p_brand")).alias("aliases"), F.coalesce("occurrences", none).alias("occurrences"))


def glossary_merge(s: SparkSession, d: str) -> DataFrame:
    out = merged_entries(_members(s, d), "target")
    return out.select("target", "status", F.length("definition").alias("longest"), "locked", F.sha2(F.array_join("aliases", ","), 256).alias("aliases"), "jobs", "hits")


def glossary_suggestions(s: SparkSession, d: str) -> DataFrame:
    """Suppliers' parts as suggestions of a job each; keys of the first half are known."""
    li = load(s, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_suppkey").cast("string").alias("job"), (F.col("l_partkey") % 150).alias("k")).distinct()
    new = li.select("job", F.concat(F.lit("k"), F.col("k").cast("string")).alias("key"), F.concat(F.lit("n"), F.col("k").cast("string")).alias("name"))
    part = load(s, d, "part").filter("p_partkey < 75")
    index = part.select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key"), F.concat(F.lit("e"), (F.col("p_partkey") % 20).cast("string")).alias("entity"))
    glossary = s.range(20).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("term"), F.when(F.col("id") % 3 == 0, "rejected").otherwise("suggested").alias("status"), F.lit(0).alias("jobs"))
    return suggestions(glossary, new, index)


def domain_rename(s: SparkSession, d: str) -> DataFrame:
    """Documents' source src3 becomes src5; sources and languages that then have several first documents clash."""
    docs = load(s, d, "documents").select("doc_id", "source", "lang")
    heads = docs.groupBy("source", "lang").agg(F.min("doc_id").alias("doc_id"))
    tables, clashes = renamed({"documents": docs, "heads": heads}, "source", "src3", "src5", {"heads": ["source", "lang"]})
    return tables["documents"].groupBy(F.col("source").alias("key")).agg(F.count("*").alias("n")).unionByName(clashes.select("key", F.lit(-1).cast("long").alias("n")))


def cascade_delete(s: SparkSession, d: str) -> DataFrame:
    """Every fifth supplier goes: its line items too, nations forget it, parts' lists of suppliers lose it."""
    gone = load(s, d, "supplier").filter("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("k"))
    li = load(s, d, "lineitem").select(F.col("l_suppkey").alias("k"), "l_partkey")
    lists = li.distinct().groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct("k"))).alias("held"))
    out = cascaded(gone, "k", {"items": li}, {"links": load(s, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey")}, {"parts": (lists, "l_partkey", "held", "k")})
    n = out["items"].groupBy("l_partkey").agg(F.count("*").alias("items"))
    linked = out["links"].agg(F.count("k").alias("linked"), F.count("*").alias("links"))
    return out["parts"].join(n, "l_partkey", "left").select("l_partkey", F.size("held").alias("suppliers"), F.coalesce("items", F.lit(0)).alias("items")).crossJoin(linked)  # one row


def projection_ledger(s: SparkSession, d: str) -> DataFrame:
    """Parts of orders as occurrences; the ledger knows the first half of the orders, every seventh wrongly,
    and one that is gone."""
    li = load(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    old = li.filter("l_orderkey % 7 <> 0 or l_linenumber > 1").groupBy("l_orderkey").agg(digest_of("l_linenumber", "l_partkey", order=["l_linenumber", "l_partkey"]).alias("digest")).filter("l_orderkey % 2 = 0")
    ledger = old.unionByName(s.createDataFrame([(-1, "x")], "l_orderkey long, digest string"))
    return changed_projections(ledger, li, "l_orderkey", ["l_linenumber", "l_partkey"]).select("l_orderkey")


def prompt_versions(s: SparkSession, d: str) -> DataFrame:
    """Customers' orders as saved prompts: urgent ones overwrite. Every third customer has two versions before."""
    old = load(s, d, "customer").filter("c_custkey % 3 = 0").select("c_custkey", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("version"), F.lit("old").alias("content"))
    saves = _orders(s, d).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").cast("string").alias("content"), (F.col("o_orderpriority") == "1-URGENT").alias("overwrite"))
    return saved_versions(old, saves, ["c_custkey"])


def content_put(s: SparkSession, d: str) -> DataFrame:
    docs = load(s, d, "documents").filter("text is not null")
    name = F.sha2("text", 256)
    store = docs.filter("doc_id % 2 = 0").groupBy(name.alias("name")).agg(F.min(F.when(F.col("doc_id") % 10 == 0, F.lit("other")).otherwise(F.col("text"))).alias("content"))
    new = docs.select(F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("x"), name)).otherwise(name).alias("name"), F.col("text").alias("content"))
    return put(store, new)


def content_scrub(s: SparkSession, d: str) -> DataFrame:
    docs = load(s, d, "documents")
    store = docs.select(F.sha2("text", 256).alias("name"), F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).when(F.col("doc_id") % 7 != 1, F.col("text")).alias("content"))
    return scrubbed(store).groupBy("kind").agg(F.count("*").alias("n"))


def expired_definitions(s: SparkSession, d: str) -> DataFrame:
    """Parts as definitions made from their suppliers; every fourth has none, every fifth an old digest."""
    inputs = load(s, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_suppkey").cast("string").alias("input")).distinct()
    made = inputs.groupBy("k").agg(digest_of("input", order=["input"]).alias("h"))
    parts = load(s, d, "part").select(F.col("p_partkey").alias("k")).join(made, "k", "left")
    kept = F.when(F.col("k") % 4 == 0, None).when(F.col("k") % 5 == 0, F.lit("old")).otherwise(F.coalesce("h", F.lit("none")))
    return stale_definitions(parts.select("k", kept.alias("input_hash")), inputs, "k")


def collection_counts(s: SparkSession, d: str) -> DataFrame:
    """Counts of a collection's items made anew, 0 for empty ones."""
    n = _orders(s, d).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return load(s, d, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


def merged_arrays(s: SparkSession, d: str) -> DataFrame:
    """Union of arrays by a key: each part's suppliers from two halves of the lines, of a supplier the first row."""
    li = load(s, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    best = li.groupBy("l_partkey", "l_suppkey").agg(F.min(F.struct((F.col("l_orderkey") % 2).alias("half"), "l_orderkey", "l_linenumber")).alias("m"))
    held = F.array_sort(F.collect_list(F.struct("l_suppkey", F.col("m.l_orderkey").alias("o"))))
    return best.groupBy("l_partkey").agg(F.array_join(F.transform(held, lambda x: F.concat_ws(":", x["l_suppkey"], x["o"])), ",").alias("suppliers"))


QUERIES = {
    f.__name__: f
    for f in (upsert_rows, replaced_partitions, cas_table, cas_outcomes, request_outcomes, glossary_merge, glossary_suggestions, domain_rename, cascade_delete, projection_ledger, prompt_versions, content_put, content_scrub, expired_definitions, collection_counts, merged_arrays)
}

_CAS = """
WITH t AS (SELECT c_custkey, c_custkey % 3 + 1 AS revision, c_mktsegment FROM customer),
c AS (SELECT o_orderkey AS request, o_custkey + CASE WHEN o_orderkey % 50 = 0 THEN 100000000 ELSE 0 END AS c_custkey, o_orderkey % 3 + 1 AS expected, o_orderpriority AS seg FROM orders),
j AS (SELECT c.*, t.revision FROM c LEFT JOIN t ON t.c_custkey = c.c_custkey),
o AS (SELECT *, CASE WHEN revision IS NULL THEN 'missing' WHEN expected <> revision THEN 'conflict' WHEN row_number() OVER (PARTITION BY c_custkey, expected = revision ORDER BY request) > 1 THEN 'superseded' ELSE 'applied' END AS outcome FROM j)"""
ORACLES = {
    "upsert_rows": """
WITH l AS (SELECT o_custkey AS k, arg_max(o_totalprice, (o_orderdate, o_orderkey)) FILTER (o_orderstatus <> 'P') AS b, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS seg FROM orders GROUP BY 1),
c AS (SELECT * FROM customer WHERE c_custkey % 4 <> 0)
SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(b, c_acctbal) AS c_acctbal, coalesce(seg, c_mktsegment) AS c_mktsegment FROM c FULL JOIN l ON k = c_custkey""",
    "replaced_partitions": "SELECT l_orderkey, count(*) AS n, round(sum(CASE WHEN l_orderkey % 3 = 0 AND l_hit THEN l_quantity / 2 ELSE l_quantity END), 2) AS quantity FROM (SELECT *, bool_or(l_linenumber <= 2) OVER (PARTITION BY l_orderkey) AS l_hit FROM lineitem) WHERE l_orderkey % 11 <> 0 AND (l_orderkey % 3 <> 0 OR NOT l_hit OR l_linenumber <= 2) GROUP BY l_orderkey",
    "cas_table": _CAS + " SELECT t.c_custkey, t.revision + CASE WHEN a.request IS NULL THEN 0 ELSE 1 END AS revision, coalesce(a.seg, t.c_mktsegment) AS c_mktsegment FROM t LEFT JOIN (SELECT * FROM o WHERE outcome = 'applied') a ON a.c_custkey = t.c_custkey",
    "cas_outcomes": _CAS + " SELECT request, c_custkey, outcome FROM o",
    "request_outcomes": """
WITH e AS (SELECT event_id AS seq, user_id || '/' || strftime(ts, '%Y-%m-%d') AS request_id, event_type AS f, user_id FROM events),
l AS (SELECT request_id, arg_min(f, seq) AS f, min(seq)::VARCHAR AS outcome FROM e WHERE user_id % 2 = 0 AND seq % 5 = 0 GROUP BY 1),
j AS (SELECT e.seq, e.request_id, e.f, coalesce(l.f, CASE WHEN row_number() OVER w > 1 THEN first_value(e.f) OVER w END) AS was, l.outcome FROM e LEFT JOIN l USING (request_id) WINDOW w AS (PARTITION BY e.request_id ORDER BY e.seq))
SELECT seq, request_id, CASE WHEN was IS NULL THEN 'new' WHEN was = f THEN 'replayed' ELSE 'conflict' END AS kind, CASE WHEN was = f THEN outcome END AS outcome FROM j""",
    "glossary_merge": """
WITH m AS (SELECT 't' || (p_partkey % 40) AS target, 't' || p_partkey AS term, CASE WHEN p_size > 40 THEN 3 WHEN p_size > 10 THEN 2 ELSE 1 END AS st, p_type || ' ' || p_partkey AS def, p_size = 1 AS locked, p_brand AS alias, p_partkey FROM part),
o AS (SELECT target, l_suppkey AS job, max(n) AS n FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) JOIN m ON p_partkey = l_partkey GROUP BY ALL),
a AS (SELECT target, list_sort(list_filter(list_distinct(list_concat(list(term), list(alias))), lambda x: x <> target)) AS a FROM m GROUP BY target)
SELECT m.target, ['rejected', 'suggested', 'accepted'][max(st)] AS status, max(length(def))::INT AS longest, bool_or(locked) AS locked, sha256(array_to_string(any_value(a.a), ',')) AS aliases, coalesce((SELECT count(*) FROM o WHERE o.target = m.target), 0) AS jobs, coalesce((SELECT sum(n) FROM o WHERE o.target = m.target), 0)::BIGINT AS hits
FROM m JOIN a ON a.target = m.target GROUP BY m.target""",
    "glossary_suggestions": """
WITH n AS (SELECT DISTINCT l_suppkey AS job, l_partkey % 150 AS k FROM lineitem WHERE l_linenumber = 1),
p AS (SELECT job, CASE WHEN k < 75 AND k IN (SELECT p_partkey FROM part) THEN 'e' || (k % 20) ELSE 'n' || k END AS entity FROM n),
c AS (SELECT entity, count(DISTINCT job) AS jobs FROM p GROUP BY 1)
SELECT entity, jobs, CASE WHEN jobs >= 2 THEN 'accepted' ELSE 'suggested' END AS status FROM c WHERE NOT (entity LIKE 'e%' AND substring(entity, 2)::INT % 3 = 0)""",
    "domain_rename": """
WITH r AS (SELECT CASE WHEN source = 'src3' THEN 'src5' ELSE source END AS key FROM documents),
h AS (SELECT DISTINCT source, lang FROM documents)
SELECT key, count(*) AS n FROM r GROUP BY key UNION ALL SELECT 'src5/' || a.lang, -1 FROM h a JOIN h b ON a.lang = b.lang WHERE a.source = 'src3' AND b.source = 'src5'""",
    "cascade_delete": """
WITH k AS (SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 = 0)
SELECT l_partkey, count(DISTINCT l_suppkey) FILTER (l_suppkey NOT IN (SELECT * FROM k))::INT AS suppliers, count(*) FILTER (l_suppkey NOT IN (SELECT * FROM k)) AS items, (SELECT count(*) FROM supplier WHERE s_suppkey % 5 <> 0) AS linked, (SELECT count(*) FROM supplier) AS links FROM lineitem GROUP BY l_partkey""",
    "projection_ledger": """
WITH f AS (SELECT l_orderkey, bool_or(l_orderkey % 7 <> 0 OR l_linenumber > 1) AS known, bool_or(l_orderkey % 7 = 0 AND l_linenumber <= 1) AS differs FROM lineitem GROUP BY 1)
SELECT l_orderkey FROM f WHERE l_orderkey % 2 <> 0 OR NOT known OR differs UNION ALL SELECT -1""",
    "prompt_versions": """
WITH s AS (SELECT o_custkey AS k, o_orderkey AS seq, o_orderpriority = '1-URGENT' AS over, CASE WHEN o_custkey % 3 = 0 THEN 2 ELSE 0 END AS top, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders),
v AS (SELECT k, seq, top + sum(CASE WHEN over AND (top > 0 OR nth > 1) THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY seq) AS version FROM s),
l AS (SELECT k, version, arg_max(seq, seq)::VARCHAR AS content FROM v GROUP BY ALL),
o AS (SELECT c_custkey AS k, unnest([1, 2]) AS version FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(o.k, l.k) AS c_custkey, coalesce(o.version, l.version)::BIGINT AS version, coalesce(l.content, 'old') AS content FROM o FULL JOIN l ON o.k = l.k AND o.version = l.version""",
    "content_put": """
WITH d AS (SELECT doc_id, text, sha256(text) AS h FROM documents WHERE text IS NOT NULL), s AS (SELECT h, min(CASE WHEN doc_id % 10 = 0 THEN 'other' ELSE text END) AS c FROM d WHERE doc_id % 2 = 0 GROUP BY h),
n AS (SELECT CASE WHEN doc_id % 9 = 0 THEN 'x' || h ELSE h END AS name, h, min(text) AS text FROM d GROUP BY ALL)
SELECT name, CASE WHEN name <> n.h THEN 'corrupt' WHEN s.h IS NULL THEN 'stored' WHEN s.c = text THEN 'same' ELSE 'differs' END AS kind FROM n LEFT JOIN s ON s.h = name""",
    "content_scrub": "SELECT CASE WHEN doc_id % 7 = 0 THEN 'corrupt' WHEN doc_id % 7 = 1 THEN 'empty' ELSE 'ok' END AS kind, count(*) AS n FROM documents GROUP BY 1",
    "expired_definitions": "SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN 'no digest' WHEN p_partkey NOT IN (SELECT l_partkey FROM lineitem) THEN 'no inputs' ELSE 'changed' END AS reason FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 5 = 0 OR p_partkey NOT IN (SELECT l_partkey FROM lineitem)",
    "collection_counts": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "merged_arrays": """
WITH b AS (SELECT l_partkey, l_suppkey, l_orderkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey % 2, l_orderkey, l_linenumber) = 1)
SELECT l_partkey, string_agg(l_suppkey || ':' || l_orderkey, ',' ORDER BY l_suppkey) AS suppliers FROM b GROUP BY l_partkey""",
}
