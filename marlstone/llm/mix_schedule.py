"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame operations only.

Sizes are word counts. Sources in code-point order (null last) weigh WEIGHTS over and over and share
all words; a target stops at MOST times its source's size, the excess goes to the others by weight.

* Slots: slot k has the point (k A mod M) / M, A / M next to the golden ratio's fraction. Points map
  through the sources' cumulative targets, so any run of slots holds each source in proportion. A
  source's slots are ranked by running counts over chunks of slots, then within a chunk.
* Blocks: a source's documents, shuffled by a digest of their ids, lie end to end and repeat MOST
  times; the target's length of that is cut into as many equal blocks as the source has slots (about
  BLOCK words each). Rank r takes block r. Places come from running sums over ranges of digests, then
  within a range, so that no task holds a source.
* The join of both on (source, rank) says which words of which document each slot takes, and when.

Defined results: a null text has size 0 and is not taken; a null source is a source; a source with a
target but no slot gets one at the end; null doc_ids and repeated rows are rows like any other, each
with a result of its own; texts of any length count whole, a long one is taken block by block; an empty
table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import numbered, table, written

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 128
#: A / M is within 1 / M of the golden ratio's fraction; M is prime.
M, A = 2_147_483_647, 1_327_217_885
#: A pass over the sources' shares finds a point's source by cell.
CELLS = 1 << 14
SLOTS_A_CHUNK, ROWS_A_RANGE = 4096, 2048
#: Chunks that are summed together before the sums of a source are.
CHUNKS_A_SPAN = 4096
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """row (a number of its own), doc_id, source, its key, size and shuffling digest of each document. Rows
    without id are shuffled by their texts and numbers, so that they don't lie together."""
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    name = F.coalesce(F.col(id_col).cast("string"), F.concat_ws(" ", F.lit("no id"), F.xxhash64(text_col), row))
    return docs.select(
        row.alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("key"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit("mix "), name)).alias("digest"),
    )


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row a source: key, source_size, target, words (the target in whole words), lo and hi (its
    share of the points). Works on one row a source alone.

    With sources in order of most * size / weight, capping the first k leaves the others a level of
    (all - caps) / weights a unit of weight; the true level is the greatest of those."""
    sums = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long")
    x = sums.withColumn("w", w).withColumn("all", F.sum("source_size").over(Window.partitionBy()))
    before = Window.orderBy(F.col("source_size") * float(most) / F.col("w"), "key").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(F.col("source_size") * float(most) / F.col("w"), "key").rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("all") - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most).cast("double") / F.sum("w").over(onward)
    x = x.withColumn("level", level).withColumn("level", F.max("level").over(Window.partitionBy()))
    x = x.withColumn("target", F.least(F.col("source_size") * float(most), F.col("level") * F.col("w"))).withColumn("words", F.round("target").cast("long"))
    upto = F.sum("words").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    total = F.greatest(F.sum("words").over(Window.partitionBy()), F.lit(1))
    return x.withColumn("hi", upto.cast("double") / total * M).withColumn("lo", (upto - F.col("words")).cast("double") / total * M).select("key", "source", "source_size", "target", "words", "lo", "hi")


def offsets(sums: DataFrame, order: str, span: Column, value: str) -> DataFrame:
    """sums (one row a key and order) with start, the value of the key's rows before this one. In two
    levels: within spans of neighbours, then over the spans, so that no task holds all rows of a key."""
    sums = sums.withColumn("span", span)
    spans = sums.groupBy("key", "span").agg(F.sum(value).alias("whole"))
    before = F.sum("whole").over(Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, 0)) - F.col("whole")
    within = F.sum(value).over(Window.partitionBy("key", "span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    out = sums.withColumn("within", within).join(spans.select("key", "span", before.alias("before")), ["key", "span"])
    return out.withColumn("start", F.col("before") + F.col("within")).drop("span", "within", "before")


def slots(spark: SparkSession, sources: DataFrame, n: int) -> DataFrame:
    """slot, key, rank, n_slots (of the source), words: the schedule of n slots."""
    k = spark.range(n).select(F.col("id").alias("slot"), ((F.col("id") % M * A) % M).alias("u"))
    k = k.withColumn("cell", F.floor(F.col("u") * float(CELLS) / M))
    cell = lambda x: F.greatest(F.lit(0), F.least(F.floor(F.col(x) * float(CELLS) / M), F.lit(CELLS - 1)))
    cells = sources.filter("words > 0").select("key", "lo", "hi", F.explode(F.sequence(cell("lo"), cell("hi"))).alias("cell"))
    k = k.join(cells, "cell").filter("u >= lo and u < hi").select("slot", "key", F.floor(F.col("slot") / SLOTS_A_CHUNK).alias("chunk"))
    chunk = k.groupBy("key", "chunk").agg(F.count("*").alias("in_chunk"))
    n_slots = chunk.groupBy("key").agg(F.sum("in_chunk").alias("n_slots"))
    chunk = offsets(chunk, "chunk", F.floor(F.col("chunk") / CHUNKS_A_SPAN), "in_chunk").join(n_slots, "key").select("key", "chunk", F.col("start").alias("done"), "n_slots")
    here = F.row_number().over(Window.partitionBy("key", "chunk").orderBy("slot"))
    ranked = k.withColumn("here", here).join(chunk, ["key", "chunk"]).select("slot", "key", (F.col("done") + F.col("here") - 1).alias("rank"), "n_slots")
    missed = sources.filter("words > 0").join(n_slots, "key", "left_anti")
    return ranked.unionByName(missed.select(F.lit(n).cast("long").alias("slot"), "key", F.lit(0).cast("long").alias("rank"), F.lit(1).cast("long").alias("n_slots")))


def places(rows: DataFrame, n_rows: int, info: DataFrame) -> DataFrame:
    """rows with place (the words of the source's documents before this one, in shuffled order) and
    their source's info, which joins the ranges, few and even, before those join the rows."""
    digits = max(1, math.ceil(math.log(max(1, n_rows / ROWS_A_RANGE), 16)))
    rows = rows.withColumn("range", F.substring("digest", 1, digits))
    ranges = rows.groupBy("key", "range").agg(F.sum("size").alias("in_range"))
    ranges = offsets(ranges, "range", F.substring("range", 1, max(1, digits // 2)), "in_range").drop("in_range").join(info, "key")
    here = F.sum("size").over(Window.partitionBy("key", "range").orderBy("digest", "size", "row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return rows.withColumn("here", here).join(ranges, ["key", "range"]).withColumn("place", F.col("start") + F.col("here")).drop("range", "start", "here", "digest")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents (row, doc_id, key, size, source_size, target), and what the slots take of them:
    slot, row, round (0 for the first pass over the source), first and n (words of the document). row_col
    names a column that numbers the rows; without one they are numbered here."""
    spark = docs.sparkSession
    rows = written(sizes(docs, id_col, text_col, source_col, row_col), "sizes")
    sources = written(targets(rows, weights, most), "sources")
    n_words, n_rows = sources.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0], rows.count()
    plan = slots(spark, sources, -(-n_words // block))
    per_source = plan.groupBy("key").agg(F.max("n_slots").alias("n_slots"))
    info = sources.join(per_source, "key", "left").select("key", "source_size", "target", "words", F.coalesce("n_slots", F.lit(1)).alias("n_slots"))
    info = info.withColumn("base", F.floor(F.col("words") / F.col("n_slots"))).withColumn("extra", F.col("words") % F.col("n_slots"))
    known = written(places(rows, n_rows, info), "places")
    rounds = F.when((F.col("size") > 0) & (F.col("place") < F.col("words")), F.sequence(F.lit(0).cast("long"), F.least(F.lit(most - 1).cast("long"), F.floor((F.col("words") - F.col("place") - 1) / F.col("source_size")))))
    passes = known.withColumn("round", F.explode(rounds)).withColumn("p", F.col("round") * F.col("source_size") + F.col("place")).withColumn("q", F.least(F.col("p") + F.col("size"), "words"))
    longer = F.col("extra") * (F.col("base") + 1)
    block_of = lambda x: F.when(x < longer, F.floor(x / (F.col("base") + 1))).otherwise(F.col("extra") + F.floor((x - longer) / F.greatest(F.col("base"), F.lit(1))))
    pieces = passes.withColumn("rank", F.explode(F.sequence(block_of(F.col("p")), block_of(F.col("q") - 1))))
    begin = F.col("rank") * F.col("base") + F.least("rank", "extra")
    first = F.greatest(begin, F.col("p"))
    end = F.least(begin + F.col("base") + F.when(F.col("rank") < F.col("extra"), 1).otherwise(0), "q")
    taken = pieces.withColumn("first", first - F.col("p")).withColumn("n", end - first).select("key", "rank", "row", "round", "first", "n").join(plan.select("slot", "key", "rank"), ["key", "rank"])
    return known.select("row", "doc_id", "key", "size", "source_size", "target"), taken.select("slot", "row", "round", "first", "n")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str = "n_chars") -> DataFrame:
    """docs as the slots take them: a row for each pass over a document, its text cut after the words
    taken where that is not all (and length_col, where there is one, set to the cut text's length).

    The rows are numbered and written first, so that schedule and texts meet by number, whatever ids,
    sources and texts they share."""
    id_, text, source, length = (f"_{docs.columns.index(c)}" if c in docs.columns else None for c in (id_col, text_col, source_col, length_col))
    kept = written(numbered(docs, F.monotonically_increasing_id().alias("row")), "rows")
    facts, taken = mix(kept, id_col=id_, text_col=text, source_col=source, row_col="row")
    rounds = [F.sum(F.when(F.col("round") == k, F.col("n"))).alias(f"t{k}") for k in range(MOST)]
    passes = facts.select("row", "size").join(taken.groupBy("row").agg(*rounds), "row").select("row", "size", F.array(*(f"t{k}" for k in range(MOST))).alias("passes"))
    rows = kept.join(passes.hint("merge"), "row")
    rows = rows.withColumn("taken", F.explode("passes")).filter("taken > 0")
    white = r"[\x20\x09-\x0D]"
    pieces = F.split(F.regexp_replace(text, f"^{white}+", ""), f"(?<={white})(?={white.replace('[', '[^')})")
    cut = F.when(F.col("taken") == F.col("size"), F.col(text)).otherwise(F.regexp_replace(F.array_join(F.slice(pieces, F.lit(1), F.col("taken").cast("int")), ""), f"{white}+$", ""))
    rows = rows.withColumn("cut", cut)
    out = [F.col("cut") if f"_{k}" == text else F.char_length("cut").cast(docs.schema[c].dataType) if f"_{k}" == length else F.col(f"_{k}") for k, c in enumerate(docs.columns)]
    return rows.select(*out).toDF(*docs.columns)


def op4_mix_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, taken = mix(table(spark, sf_dir, "documents"))
    facts = docs.select("row", "doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("n"))
    more = taken.select("row", *(F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("size", "long"), ("source_size", "long"), ("target", "double"))), "n")
    return facts.unionByName(more).groupBy("row").agg(*(F.max(c).alias(c) for c in ("doc_id", "size", "source_size", "target")), F.sum("n").alias("taken")).drop("row")


#: The blocks tile each source's target, so a document is taken as far as its places lie before it.
ORACLE = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5('mix ' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM d GROUP BY source
), o AS (
  SELECT *, sum(source_size) OVER () AS everything, source_size * 3.0::DOUBLE / w AS ratio FROM s
), l AS (
  SELECT *, (everything - 3 * coalesce(sum(source_size) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(w) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM o
), t AS (
  SELECT source, source_size, least(source_size * 3.0::DOUBLE, max(level) OVER () * w) AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS words,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY digest, d.size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size)::BIGINT AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(place + size, words) - place) + greatest(0, least(source_size + place + size, words) - source_size - place)
        + greatest(0, least(2 * source_size + place + size, words) - 2 * source_size - place))::BIGINT AS taken
FROM p
"""

QUERIES = {"op4_mix_schedule": op4_mix_schedule}
ORACLES = {"op4_mix_schedule": ORACLE}
