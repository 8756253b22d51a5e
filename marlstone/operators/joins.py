"""Joins of records: composite keys, pointers, lookups, ordered sets, texts that match, pictures that repeat."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.scalars import match_text
from marlstone.operators.textops import holding
from marlstone.session import load
from marlstone.shared import drop, written


def newest_of(rows: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """The columns of each key's newest row (a pointer to its current version)."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(at)).alias("_n")).select(key, *(F.col(f"_n.{c}").alias(c) for c in columns))


def titled(rows: DataFrame, titles: DataFrame, key: str, title: str) -> DataFrame:
    """rows with their title; a row whose title is missing or empty goes."""
    return rows.join(titles.select(key, title), key, "left").filter(F.coalesce(F.trim(title), F.lit("")) != "")


def same_members(left: DataFrame, right: DataFrame, group: str, member: str, place: str) -> DataFrame:
    """Pairs of groups of both sides that hold the same members in the same order. Lists meet by digest,
    then whole."""
    listed = lambda df, name: df.groupBy(F.col(group).alias(name)).agg(F.transform(F.array_sort(F.collect_list(F.struct(place, member))), lambda x: x[member]).alias(f"_{name}")).withColumn("_d", F.xxhash64(f"_{name}"))
    return listed(left, "a").join(listed(right, "b"), "_d").filter("_a = _b").select("a", "b")


def aligned(needles: DataFrame, texts: DataFrame, least: int = 8, ratio: float = 0.85) -> DataFrame:
    """id, match, confidence and state of each needle (id, text) among texts (id, text) in the form in which
    texts are compared: matched by the only equal text; else by the only text that holds it or lies in it,
    if the shorter has 85 % of the longer's length; ambiguous or unmatched otherwise, and if it is short."""
    form = lambda df, a, b: df.select(F.col("id").alias(a), match_text(F.coalesce("text", F.lit(""))).alias(b)).filter(F.length(b) >= least)
    left, right = form(needles, "id", "needle"), form(texts, "match", "body")
    equal = left.join(right, F.col("needle") == F.col("body")).groupBy("id").agg(F.count("*").alias("n"), F.min("match").alias("match"))
    rest = left.join(equal, "id", "left_anti")
    inside = holding(right, rest, "body", "needle", "match", "id").unionByName(holding(rest, right, "needle", "body", "id", "match")).select("id", "match", (F.least(F.length("needle"), F.length("body")) / F.greatest(F.length("needle"), F.length("body"))).alias("share")).distinct()
    held = inside.groupBy("id").agg(F.count("*").alias("n"), F.min("match").alias("match"), F.max("share").alias("share"))
    one = F.when(F.col("n") == 1, F.col("match"))
    exact = equal.select("id", one.alias("match"), F.when(F.col("n") == 1, 1.0).otherwise(0.0).alias("confidence"), F.when(F.col("n") == 1, "matched").otherwise("ambiguous").alias("state"))
    good = (F.col("n") == 1) & (F.col("share") >= ratio)
    near = held.select("id", F.when(good, F.col("match")).alias("match"), F.when(good, F.round("share", 6)).otherwise(0.0).alias("confidence"), F.when(good, "matched").otherwise("ambiguous").alias("state"))
    return needles.select("id").join(exact.unionByName(near), "id", "left").select("id", "match", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("state", F.lit("unmatched")).alias("state"))


def terms_in(texts: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """key and term of the terms (column term) that a text holds: names of Latin letters as words, others
    wherever they stand. A term's first word, or its first two characters, finds the texts to look at; ids
    meet first, texts come to the pairs that are found."""
    latin = F.col("term").rlike("^[A-Za-z0-9]")
    low = F.lower("term")
    keyed = terms.filter("term <> ''").select("term", F.when(latin, F.regexp_extract(low, "^[a-z0-9]+", 0)).otherwise(F.substring("term", 1, 2)).alias("_k")).distinct()
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))
    bits = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit("[一-鿿]+"), F.lit(0)), lambda r: F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.substring(r, i, F.lit(2))))))
    found = texts.select(key, F.explode(F.array_union(words, bits)).alias("_k")).join(keyed, "_k").select(key, "term").distinct().join(texts.select(key, text), key)
    word = F.concat(F.lit("(?i)(?<![A-Za-z0-9])"), F.regexp_replace("term", r"([^A-Za-z0-9\s])", r"\\$1"), F.lit("(?![A-Za-z0-9])"))
    return found.filter(F.when(F.col("term").rlike("^[A-Za-z0-9]"), F.regexp_like(F.col(text), word)).otherwise(F.contains(F.col(text), F.col("term")))).select(key, "term").distinct()


def near_hashes(frames: DataFrame, group: str, near: int) -> DataFrame:
    """Pairs of a group's pictures (index, phash) whose 64-bit hashes differ in `near` bits at most, as
    (group, earlier, later). Such hashes agree in one of near + 1 bands of bits; equal hashes are one."""
    width = -(-64 // (near + 1))
    first = frames.groupBy(group, "phash").agg(F.min("index").alias("index"))
    band = lambda k: F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("phash", k * width).bitwiseAND(F.lit((1 << width) - 1)).alias("v"))
    banded = first.select(group, "phash", "index", F.explode(F.array(*map(band, range(near + 1)))).alias("_b"))
    a = banded.select(group, "_b", F.col("phash").alias("_p"), F.col("index").alias("earlier"))
    b = banded.select(group, "_b", F.col("phash").alias("_q"), F.col("index").alias("later"))
    close = a.join(b, [group, "_b"]).filter((F.col("earlier") < F.col("later")) & (F.bit_count(F.col("_p").bitwiseXOR(F.col("_q"))) <= near))
    return close.select(group, "earlier", "later").distinct()


#: Pictures of a group in the first of its blocks; each further block is so many times as long as all before it.
FIRST_BLOCK, GROWTH = 500, 3


def _banded(rows: DataFrame, group: str, near: int) -> DataFrame:
    width = -(-64 // (near + 1))
    band = lambda k: F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("phash", k * width).bitwiseAND(F.lit((1 << width) - 1)).alias("v"))
    return rows.withColumn("_b", F.explode(F.array(*map(band, range(near + 1)))))


def _near_any(rows: DataFrame, kept: DataFrame, group: str, near: int) -> DataFrame:
    """group and index of the rows near to a kept picture."""
    other = _banded(kept.select(group, "phash"), group, near).withColumnRenamed("phash", "_p")
    met = _banded(rows.select(group, "index", "phash"), group, near).join(other, [group, "_b"])
    return met.filter(F.bit_count(F.col("phash").bitwiseXOR(F.col("_p"))) <= near).select(group, "index").distinct()


def _kept_of(block: DataFrame, group: str, near: int) -> DataFrame:
    """The kept ones of pictures of which none is near to one kept before them: those with no undecided one
    before them are decided, round by round."""
    pairs = written(near_hashes(block, group, near), "pairs")
    undecided = written(block.select(group, "index"), "undecided")
    kept: list[DataFrame] = []
    while not undecided.isEmpty():
        waits = pairs.join(undecided.select(group, F.col("index").alias("earlier")), [group, "earlier"], "left_semi").select(group, F.col("later").alias("index")).distinct()
        keep = written(undecided.join(waits, [group, "index"], "left_anti"), "keep")
        kept.append(keep)
        gone = pairs.join(keep.select(group, F.col("index").alias("earlier")), [group, "earlier"], "left_semi").select(group, F.col("later").alias("index")).distinct()
        old, undecided = undecided, written(undecided.join(keep, [group, "index"], "left_anti").join(gone, [group, "index"], "left_anti"), "undecided")
        drop(old)
    marks = reduce(DataFrame.unionByName, kept, block.select(group, "index").limit(0))
    out = written(block.join(marks, [group, "index"], "left_semi"), "kept")
    drop(pairs, undecided, *kept)
    return out


def kept_pictures(frames: DataFrame, group: str, near: int = 6) -> DataFrame:
    """frames (index, phash) with keep: a picture goes if one kept before it is near; a null hash is never kept.

    A group's pictures are taken in blocks by index, each longer than all before it. What is near to one kept
    from the blocks before goes at once, so that pairs are formed only of the rest: crowds of near pictures,
    which make pairs with the square of their size, lie behind the few that are kept of them."""
    hashed = frames.filter("phash is not null")
    first = written(hashed.groupBy(group, "phash").agg(F.min("index").alias("index")), "first")
    sizes = first.groupBy(group).agg(F.count("*").alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    shares: list[float] = []
    while largest * (1 + GROWTH) ** -(len(shares)) > FIRST_BLOCK:
        shares.insert(0, (1 + GROWTH) ** -(len(shares) + 1.0))
    blocks = first.withColumn("_block", F.lit(0))
    if shares:
        cuts = first.groupBy(group).agg(F.percentile_approx("index", shares).alias("_cuts"))  # near them is enough
        blocks = first.join(cuts, group).withColumn("_block", F.size(F.filter("_cuts", lambda x: x < F.col("index")))).drop("_cuts")
    kept: list[DataFrame] = []
    for k in range(len(shares) + 1):
        block = blocks.filter(F.col("_block") == k).select(group, "phash", "index")
        for before in kept:
            block = block.join(_near_any(block, before, group, near), [group, "index"], "left_anti")
        block = written(block, "block")
        kept.append(_kept_of(block, group, near))
        drop(block)
    drop(first)
    marks = reduce(DataFrame.unionByName, kept).select(group, "index")
    return frames.join(marks.withColumn("_keep", F.lit(True)), [group, "index"], "left").withColumn("keep", F.coalesce("_keep", F.lit(False))).drop("_keep")


def evidence_three_way(s: SparkSession, d: str) -> DataFrame:
    """Line items as evidence, their orders as jobs, and as chunks the larger lines' (order, part, supplier)."""
    li = load(s, d, "lineitem")
    chunks = li.filter("l_quantity > 25").groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("size"))
    jobs = load(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    found = li.select("l_orderkey", "l_partkey", "l_suppkey").join(jobs, "l_orderkey").join(chunks, ["l_orderkey", "l_partkey", "l_suppkey"])
    return found.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("size"), 2).alias("size"))


def evidence_four_way(s: SparkSession, d: str) -> DataFrame:
    """Occurrences with evidence and job, and the chunk where there is one."""
    li = load(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    orders = load(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = load(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    chunks = load(s, d, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    found = li.join(orders, "l_orderkey").join(customers, "o_custkey").join(chunks, "l_partkey", "left")
    return found.groupBy("c_mktsegment", "p_brand").agg(F.count("*").alias("n"))


def current_definition(s: SparkSession, d: str) -> DataFrame:
    """Customers with the newest of their orders as the version they point to."""
    pointer = newest_of(load(s, d, "orders"), "o_custkey", "o_orderkey", "o_orderkey")
    versions = load(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return pointer.join(versions, "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")


def kind_lookup(s: SparkSession, d: str) -> DataFrame:
    """Each document with the quality of its label, null without one (a lookup in the select list)."""
    label = load(s, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return load(s, d, "documents").select("doc_id").join(label, "doc_id", "left")


def order_by_lookup(s: SparkSession, d: str) -> DataFrame:
    """The 40 customers first by the date of their latest order, else by a date of old, then by number."""
    last = load(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    rows = load(s, d, "customer").select("c_custkey").join(last, "c_custkey", "left")
    return rows.orderBy(F.coalesce("last", F.lit("1970-01-01").cast("timestamp_ntz")).desc(), "c_custkey").limit(40).select("c_custkey")


def title_lookup(s: SparkSession, d: str) -> DataFrame:
    """Documents by their source's title; sources 2 and 5 have an empty one, source 7 none."""
    docs = load(s, d, "documents").select("doc_id", "source")
    titles = docs.select("source").distinct().filter("source <> 'src7'").withColumn("title", F.when(F.col("source").isin("src2", "src5"), " ").otherwise(F.upper("source")))
    return titled(docs, titles, "source", "title").select("doc_id", "title")


def frame_texts(s: SparkSession, d: str) -> DataFrame:
    """Frames with the text found on them, by job and number; a frame without any stays."""
    frames = load(s, d, "conversations").select("conv_id", "turn")
    ocr = load(s, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.char_length("text").alias("chars"))
    return frames.join(ocr, ["conv_id", "turn"], "left").groupBy("conv_id").agg(F.count("*").alias("frames"), F.count("chars").alias("texts"), F.sum("chars").alias("chars"))


def beat_bucket_join(s: SparkSession, d: str) -> DataFrame:
    """Turns of users and of assistants that share a beat of 30 seconds (a turn lasts 10)."""
    rows = load(s, d, "conversations").select("conv_id", F.floor(F.col("turn") * 10 / 30).alias("beat"), "turn", "role")
    side = lambda role, name: rows.filter(F.col("role") == role).select("conv_id", "beat", F.col("turn").alias(name))
    return side("user", "asked").join(side("assistant", "said"), ["conv_id", "beat"])


def member_lists(s: SparkSession, d: str) -> DataFrame:
    """Orders of both parities with the same suppliers in the same order."""
    li = load(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    return same_members(li.filter("l_orderkey % 2 = 0"), li.filter("l_orderkey % 2 = 1"), "l_orderkey", "l_suppkey", "l_linenumber").groupBy("a").agg(F.count("*").alias("partners"), F.min("b").alias("first"))


def text_alignment(s: SparkSession, d: str) -> DataFrame:
    """Benchmark items whole, in capitals, without their last ten characters, or cut to a third, against the
    items; every fifth item stands there twice."""
    items = load(s, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    k, n = F.col("id") % 4, F.length("text")
    cut = F.when(k == 1, F.upper("text")).when(k == 2, F.substring("text", F.lit(1), n - 10)).when(k == 3, F.substring("text", F.lit(1), F.floor(n / 3).cast("int"))).otherwise(F.col("text"))
    texts = items.unionByName(items.filter("id % 5 = 0").select((F.col("id") + 1000000).alias("id"), "text"))
    return aligned(items.select("id", cut.alias("text")), texts)


TERMS = ("tion", "the", "les der", "License", "and the", "src")


def term_anchor_join(s: SparkSession, d: str) -> DataFrame:
    return terms_in(load(s, d, "documents").filter("text is not null"), s.createDataFrame([(t,) for t in TERMS], "term string"), "doc_id", "text")


def picture_dedup(s: SparkSession, d: str) -> DataFrame:
    """Documents as pictures of three jobs: forty hashes, each with up to five bits turned."""
    turned = F.expr("(doc_id % 40 + 1) * 123456789123 ^ shiftleft(1L, int(doc_id * 7 % 61)) ^ shiftleft(1L, int(doc_id * 13 % 59)) ^ shiftleft(7L, int(doc_id % 11 * 5))")
    frames = load(s, d, "documents").select((F.col("doc_id") % 3).alias("job"), F.col("doc_id").alias("index"), turned.alias("phash"))
    return kept_pictures(frames, "job").groupBy("job").agg(F.count("*").alias("n"), F.count(F.when(F.col("keep"), 1)).alias("kept"), F.sum(F.when(F.col("keep"), F.col("index"))).alias("sum"))


def frame_index(s: SparkSession, d: str) -> DataFrame:
    """A running number over all frames of a job's parts in order."""
    w = Window.partitionBy("conv_id").orderBy("part", "turn")
    rows = load(s, d, "conversations").select("conv_id", F.when(F.col("role") == "system", 0).otherwise(1).alias("part"), "turn")
    return rows.select("conv_id", "part", "turn", F.row_number().over(w).cast("long").alias("number"))


def first_seen(s: SparkSession, d: str) -> DataFrame:
    """Events without later ones of the same user and type, in the order of arrival."""
    e = load(s, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    return e.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))


def event_timeline(s: SparkSession, d: str) -> DataFrame:
    """Orders, shipments and events of unlike columns as one timeline: how many of each a month."""
    kind = lambda df, at, name: df.select(F.col(at).alias("at"), F.lit(name).alias("kind"))
    rows = kind(load(s, d, "orders"), "o_orderdate", "order").unionByName(kind(load(s, d, "lineitem"), "l_shipdate", "ship")).unionByName(kind(load(s, d, "events"), "ts", "event"))
    return rows.groupBy(F.date_format("at", "yyyy-MM").alias("month"), "kind").agg(F.count("*").alias("n"))


def distinct_evidence(s: SparkSession, d: str) -> DataFrame:
    """How well each brand is attested by distinct orders, suppliers and types, over its cheap lines."""
    from marlstone.functions.scalars import attestation

    li = load(s, d, "lineitem").filter("l_quantity <= 3").join(load(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey")
    out = li.groupBy("p_brand").agg(F.count_distinct("l_orderkey").alias("jobs"), F.count_distinct(F.struct("l_suppkey", "l_partkey")).alias("sources"), F.count_distinct("p_type").alias("kinds"))
    return out.withColumn("level", attestation(F.col("jobs"), F.col("sources"), F.col("kinds")))


def sorted_by_json(s: SparkSession, d: str) -> DataFrame:
    """The first 50 events by a JSON field: those that have it by value, the others last, then by number."""
    k: Column = F.from_json("props", "k INT")["k"]
    rows = load(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, k).cast("long").alias("k"))
    return rows.orderBy(F.coalesce("k", F.lit(2**63 - 1)), "event_id").limit(50)


def job_membership(s: SparkSession, d: str) -> DataFrame:
    """Terms whose list of occurrences names a job, with their hits there: parts of three orders."""
    held = load(s, d, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.count("*").alias("n")).groupBy("l_partkey").agg(F.collect_list(F.struct("l_orderkey", "n")).alias("o"))
    hit = lambda x: x["l_orderkey"].isin(1, 2, 3)
    return held.filter(F.exists("o", hit)).select("l_partkey", F.aggregate(F.filter("o", hit), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("hits"))


def uncategorised(rows: DataFrame, column: str, value: object = None, missing: bool = False) -> DataFrame:
    """Rows without a value where those are asked for, else rows of the value, all without either."""
    return rows.filter(F.col(column).isNull()) if missing else rows if value is None else rows.filter(F.col(column) == value)


def without_category(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "documents").join(load(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return uncategorised(rows, "quality", 1, missing=True).groupBy("lang").agg(F.count("*").alias("n"))


def like_any(rows: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows with the query, in any case of ASCII, in one of the columns; % and _ in it are any characters."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False))
    return rows.filter(found)


def cards_like(s: SparkSession, d: str) -> DataFrame:
    return like_any(load(s, d, "part"), "e_on", "p_name", "p_type", "p_brand").select("p_partkey")


QUERIES = {
    f.__name__: f
    for f in (evidence_three_way, evidence_four_way, current_definition, kind_lookup, order_by_lookup, title_lookup, frame_texts, beat_bucket_join, member_lists, text_alignment, term_anchor_join, picture_dedup, frame_index, first_seen, event_timeline, distinct_evidence, sorted_by_json, job_membership, without_category, cards_like)
}

_WORDS = ", ".join(f"('{t}')" for t in TERMS)
ORACLES = {
    "evidence_three_way": "SELECT o_orderstatus, count(*) AS n, round(sum(size), 2) AS size FROM lineitem l JOIN orders ON o_orderkey = l.l_orderkey JOIN (SELECT l_orderkey, l_partkey, l_suppkey, sum(l_quantity) AS size FROM lineitem WHERE l_quantity > 25 GROUP BY ALL) c ON c.l_orderkey = l.l_orderkey AND c.l_partkey = l.l_partkey AND c.l_suppkey = l.l_suppkey GROUP BY 1",
    "evidence_four_way": "SELECT c_mktsegment, CASE WHEN p_size <= 25 THEN p_brand END AS p_brand, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey LEFT JOIN part ON p_partkey = l_partkey AND p_size <= 25 GROUP BY ALL",
    "current_definition": "SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM orders o WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders x WHERE x.o_custkey = o.o_custkey)",
    "kind_lookup": "SELECT doc_id, (SELECT max(quality) FROM labels l WHERE l.doc_id = d.doc_id) AS quality FROM documents d",
    "order_by_lookup": "SELECT c_custkey FROM customer ORDER BY coalesce((SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey), TIMESTAMP '1970-01-01') DESC, c_custkey LIMIT 40",
    "title_lookup": "SELECT doc_id, upper(source) AS title FROM documents WHERE source NOT IN ('src2', 'src5', 'src7')",
    "frame_texts": "SELECT conv_id, count(*) AS frames, count(CASE WHEN role = 'assistant' THEN length(text) END) AS texts, sum(CASE WHEN role = 'assistant' THEN length(text) END)::BIGINT AS chars FROM conversations GROUP BY conv_id",
    "beat_bucket_join": "SELECT a.conv_id, a.turn * 10 // 30 AS beat, a.turn AS asked, b.turn AS said FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn * 10 // 30 = b.turn * 10 // 30 WHERE a.role = 'user' AND b.role = 'assistant'",
    "member_lists": "WITH l AS (SELECT l_orderkey AS k, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS m FROM lineitem GROUP BY 1) SELECT a.k AS a, count(*) AS partners, min(b.k) AS first FROM l a JOIN l b ON a.m = b.m WHERE a.k % 2 = 0 AND b.k % 2 = 1 GROUP BY a.k",
    "text_alignment": """
WITH t AS (SELECT item_id AS id, replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')), 'ß', 'ss') AS body FROM benchmark UNION ALL SELECT item_id + 1000000, replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')), 'ß', 'ss') FROM benchmark WHERE item_id % 5 = 0),
n AS (SELECT item_id AS id, replace(lower(trim(regexp_replace(CASE item_id % 4 WHEN 1 THEN upper(text) WHEN 2 THEN substring(text, 1, length(text) - 10) WHEN 3 THEN substring(text, 1, length(text) // 3) ELSE text END, '\\s+', ' ', 'g'), ' ')), 'ß', 'ss') AS needle FROM benchmark),
e AS (SELECT n.id, count(*) AS n, min(t.id) AS match FROM n JOIN t ON needle = body WHERE length(needle) >= 8 GROUP BY n.id),
c AS (SELECT n.id, count(*) AS n, min(t.id) AS match, max(least(length(needle), length(body))::DOUBLE / greatest(length(needle), length(body))) AS share FROM n JOIN t ON contains(body, needle) OR contains(needle, body) WHERE length(needle) >= 8 AND length(body) >= 8 AND n.id NOT IN (SELECT id FROM e) GROUP BY n.id)
SELECT n.id, CASE WHEN e.n = 1 THEN e.match WHEN c.n = 1 AND share >= 0.85 THEN c.match END AS match, CASE WHEN e.n = 1 THEN 1.0::DOUBLE WHEN c.n = 1 AND share >= 0.85 THEN round(share, 6) ELSE 0.0::DOUBLE END AS confidence,
  CASE WHEN e.n = 1 OR (c.n = 1 AND share >= 0.85) THEN 'matched' WHEN e.n > 1 OR c.n > 0 THEN 'ambiguous' ELSE 'unmatched' END AS state FROM n LEFT JOIN e ON e.id = n.id LEFT JOIN c ON c.id = n.id""",
    "term_anchor_join": f"SELECT doc_id, term FROM documents, (VALUES {_WORDS}) t(term) WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9])' || term || '([^A-Za-z0-9]|$)')",
    "picture_dedup": """
WITH RECURSIVE h AS (SELECT doc_id % 3 AS job, doc_id AS i, xor(xor(xor((doc_id % 40 + 1) * 123456789123, (1::BIGINT << (doc_id * 7 % 61)::INT)), (1::BIGINT << (doc_id * 13 % 59)::INT)), (7::BIGINT << (doc_id % 11 * 5)::INT)) AS p, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) AS nth FROM documents),
k AS (SELECT job, nth, [p] AS held, i AS s, 1 AS kept FROM h WHERE nth = 1
  UNION ALL SELECT h.job, h.nth, CASE WHEN x.near THEN k.held ELSE list_append(k.held, h.p) END, k.s + CASE WHEN x.near THEN 0 ELSE h.i END, k.kept + CASE WHEN x.near THEN 0 ELSE 1 END
  FROM k JOIN h ON h.job = k.job AND h.nth = k.nth + 1, LATERAL (SELECT len(list_filter(k.held, lambda q: bit_count(xor(q, h.p)) <= 6)) > 0 AS near) x)
SELECT job, max(nth) AS n, max(kept)::BIGINT AS kept, max(s)::BIGINT AS sum FROM k GROUP BY job""",
    "frame_index": "SELECT conv_id, CASE WHEN role = 'system' THEN 0 ELSE 1 END AS part, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'system' THEN 0 ELSE 1 END, turn) AS number FROM conversations",
    "first_seen": "SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL)",
    "event_timeline": "SELECT strftime(t, '%Y-%m') AS month, kind, count(*) AS n FROM (SELECT o_orderdate AS t, 'order' AS kind FROM orders UNION ALL SELECT l_shipdate, 'ship' FROM lineitem UNION ALL SELECT ts, 'event' FROM events) GROUP BY ALL",
    "distinct_evidence": """
WITH c AS (SELECT p_brand, count(DISTINCT l_orderkey) AS jobs, count(DISTINCT (l_suppkey, l_partkey)) AS sources, count(DISTINCT p_type) AS kinds FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity <= 3 GROUP BY 1)
SELECT *, CASE WHEN jobs >= 3 AND sources >= 3 AND kinds >= 3 THEN 'strong' WHEN jobs >= 2 AND sources >= 2 AND kinds >= 2 THEN 'corroborated' ELSE 'supported' END AS level FROM c""",
    "sorted_by_json": "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN (props->>'k')::BIGINT END AS k FROM events ORDER BY coalesce(k, 9223372036854775807), event_id LIMIT 50",
    "job_membership": "SELECT l_partkey, count(*) AS hits FROM lineitem WHERE l_orderkey IN (1, 2, 3) GROUP BY 1",
    "without_category": "SELECT lang, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NULL GROUP BY 1",
    "cards_like": "SELECT p_partkey FROM part WHERE p_name ILIKE '%e_on%' OR p_type ILIKE '%e_on%' OR p_brand ILIKE '%e_on%'",
}
