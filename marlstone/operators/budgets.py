"""Selections and batches under several budgets at once: what goes into one prompt, and into how many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import scalars as S
from marlstone.session import load

# Items and bytes of a batch, batches and items of a group.
BATCH_ITEMS, BATCH_BYTES, MOST_BATCHES, MOST_ITEMS = 100, 64 * 1024, 32, 512
# Candidates of a digest, of one group; sources, of one group; characters of one, of all; bytes of the prompt.
CANDIDATES, GROUP_CANDIDATES, SOURCES, GROUP_SOURCES, EXCERPT, EXCERPTS, PROMPT = 256, 8, 16, 2, 1200, 12_000, 32 * 1024


def budgeted(rows: DataFrame, group: str, order: str, size: str, items: int = BATCH_ITEMS, limit: int = BATCH_BYTES, batches: int = MOST_BATCHES, total: int = MOST_ITEMS, base: int = 0) -> DataFrame:
    """rows with batch, opened and refused. In order, an item goes into the open batch if that then has at
    most `items` items and `base` and its items' bytes are at most `limit`; else it opens the next one.
    opened: `start`, `items` or `bytes` (the budget that ended the batch before) at a batch's first row.

    A group is refused as a whole, its batch null, where it has more than `total` items (refused: total),
    else one that fits into no batch (item), else more than `batches` batches (batches). Only groups of
    `total` items and fewer are gone through in order, so that no task holds more of a group. order is
    unique within a group; a null size is 0 and null is a group like others."""
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    facts = rows.groupBy(F.col(group).alias("_g")).agg(F.when(F.count("*") > total, "total").when(F.max(n) + base > limit, "item").alias("refused"))
    known = rows.join(facts, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    w = Window.partitionBy(group)
    items_ = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), n.alias("n"))))
    start = F.struct(F.lit(-1).alias("b"), F.lit(0).alias("k"), F.lit(base).cast("long").alias("h"), F.array().cast("array<struct<b:int,why:string>>").alias("out"))

    def step(held: Column, x: Column) -> Column:
        why = F.when(held["b"] < 0, "start").when(held["k"] >= items, "items").when(held["h"] + x["n"] > limit, "bytes")
        b = (held["b"] + why.isNotNull().cast("int")).cast("int")
        count, bytes_ = F.when(why.isNull(), held["k"] + 1).otherwise(1), F.when(why.isNull(), held["h"]).otherwise(F.lit(base).cast("long")) + x["n"]
        return F.struct(b.alias("b"), count.alias("k"), bytes_.alias("h"), F.array_append(held["out"], F.struct(b.alias("b"), why.alias("why"))).alias("out"))

    places = known.filter("refused is null").groupBy(F.col(group).alias("_g")).agg(items_.alias("_i"))
    dealt = places.select("_g", F.explode(F.arrays_zip(F.col("_i.o").alias("o"), F.aggregate("_i", start, step, lambda held: held["out"]).alias("x"))).alias("_z"))
    dealt = dealt.select("_g", F.col("_z.o").alias("_o"), F.col("_z.x.b").alias("batch"), F.col("_z.x.why").alias("opened"))
    out = known.join(dealt, F.col(group).eqNullSafe(F.col("_g")) & F.col(order).eqNullSafe(F.col("_o")) & F.col("refused").isNull(), "left").drop("_g", "_o")
    many = F.when(F.col("refused").isNull(), F.max("batch").over(w) + 1) > batches
    out = out.filter("refused is null").withColumn("refused", F.when(many, "batches")).unionByName(out.filter("refused is not null"))
    return out.withColumns({c: F.when(F.col("refused").isNull(), F.col(c)) for c in ("batch", "opened")})


def digest(
    rows: DataFrame, key: str, group: str, order: list[Column], text: str, title: Column, base: int = 0, each_base: int = 0, prompt: int = PROMPT,
    candidates: int = CANDIDATES, group_candidates: int = GROUP_CANDIDATES, most: int = SOURCES, per_group: int = GROUP_SOURCES, each: int = EXCERPT, total: int = EXCERPTS,
) -> DataFrame:
    """place, key, group, excerpt, truncated and kept of the sources of one prompt.

    Candidates are the first rows in order, `group_candidates` of a group and `candidates` in all. One after
    another they become sources, unless they are blank or their group has `per_group` already, until there
    are `most` or their excerpts have `total` characters; an excerpt is the first `each` characters of a body,
    or what is left, without white space at its end. A source of the last places is not kept where the
    prompt (`base` bytes, and of each source `each_base`, its title's and its excerpt's) would have more than
    `prompt` bytes. What is gone through in order are `candidates` excerpts, whatever the table's size."""
    body = S.body_text(F.col(text))
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    few = rows.withColumn("_n", nth).filter(F.col("_n") <= group_candidates).orderBy(*order).limit(candidates)
    few = few.withColumn("_p", F.row_number().over(Window.orderBy(*order)))  # `candidates` rows
    bare = lambda x: F.regexp_replace(x, r"\s+$", "")
    item = F.struct(F.col("_p").alias("p"), F.col(key).alias("k"), F.col(group).alias("g"), F.coalesce(title, F.lit("")).alias("t"), F.substring(body, 1, each).alias("x"), F.length(body).alias("n"))
    kind = dict(rows.dtypes)
    start = F.struct(F.array().cast(f"array<struct<k:{kind[key]},g:{kind[group]},t:string,x:string,cut:boolean>>").alias("out"), F.lit(0).alias("chars"))

    def step(held: Column, x: Column) -> Column:
        left = F.lit(total) - held["chars"]
        cut = bare(F.substring(x["x"], F.lit(1), left))
        same = F.size(F.filter(held["out"], lambda y: y["g"].eqNullSafe(x["g"])))
        take = (F.size(held["out"]) < most) & (left > 0) & (same < per_group) & (F.length(cut) > 0)
        more = F.struct(x["k"].alias("k"), x["g"].alias("g"), x["t"].alias("t"), cut.alias("x"), (x["n"] > F.length(cut)).alias("cut"))
        return F.when(take, F.struct(F.array_append(held["out"], more).alias("out"), (held["chars"] + F.length(cut)).alias("chars"))).otherwise(held)

    found = few.agg(F.array_sort(F.collect_list(item)).alias("_i")).select(F.posexplode(F.aggregate("_i", start, step, lambda held: held["out"])).alias("place", "_x"))
    held = F.sum(F.lit(each_base) + F.octet_length("_x.t") + F.octet_length("_x.x")).over(Window.orderBy("place"))  # `most` rows
    return found.select("place", F.col("_x.k").alias(key), F.col("_x.g").alias(group), F.col("_x.x").alias("excerpt"), F.col("_x.cut").alias("truncated"), (held + base <= prompt).alias("kept"))


def budgeted_batches(s: SparkSession, d: str) -> DataFrame:
    """Turns of all conversations in batches of three turns and 1,800 bytes, 40 of them the prompt's;
    two batches, six turns and no turn of over 1,760 bytes in a conversation."""
    rows = load(s, d, "conversations").select("conv_id", "turn", F.octet_length("text").alias("bytes"))
    return budgeted(rows, "conv_id", "turn", "bytes", items=3, limit=1800, batches=2, total=6, base=40).select("conv_id", "turn", "batch", "opened", "refused")


def digest_prompt(s: SparkSession, d: str) -> DataFrame:
    """The last documents as sources of a digest whose prompt has room for 9,000 bytes of them."""
    rows = load(s, d, "documents")
    out = digest(rows, "doc_id", "source", [F.desc("doc_id")], "text", F.col("lang"), base=PROMPT - 9000, each_base=20)
    return out.select("place", "doc_id", F.sha2("excerpt", 256).alias("digest"), "truncated", "kept")


QUERIES = {f.__name__: f for f in (budgeted_batches, digest_prompt)}

ORACLES = {
    "budgeted_batches": """
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(strlen(text), 0) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS all_, max(strlen(text)) OVER (PARTITION BY conv_id) AS top FROM conversations),
f AS (SELECT *, CASE WHEN all_ > 6 THEN 'total' WHEN top > 1760 THEN 'item' END AS refused FROM c),
w AS (SELECT conv_id, turn, i, n AS held, 1 AS k, 0 AS batch, 'start' AS opened FROM f WHERE refused IS NULL AND i = 1
  UNION ALL SELECT f.conv_id, f.turn, f.i, CASE WHEN w.k >= 3 OR w.held + f.n > 1760 THEN f.n ELSE w.held + f.n END, CASE WHEN w.k >= 3 OR w.held + f.n > 1760 THEN 1 ELSE w.k + 1 END, CASE WHEN w.k >= 3 OR w.held + f.n > 1760 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.k >= 3 THEN 'items' WHEN w.held + f.n > 1760 THEN 'bytes' END
  FROM w JOIN f ON f.conv_id = w.conv_id AND f.i = w.i + 1 WHERE f.refused IS NULL),
m AS (SELECT conv_id, max(batch) AS last FROM w GROUP BY conv_id)
SELECT f.conv_id, f.turn, CASE WHEN last < 2 THEN batch END AS batch, CASE WHEN last < 2 THEN opened END AS opened, CASE WHEN last >= 2 THEN 'batches' ELSE refused END AS refused FROM f LEFT JOIN w ON w.conv_id = f.conv_id AND w.turn = f.turn LEFT JOIN m ON m.conv_id = f.conv_id""",
    "digest_prompt": r"""
WITH RECURSIVE b AS (SELECT doc_id, source, lang, trim(regexp_replace(text, '[ \t]+(\n|$)', '\1', 'g'), E' \n\t') AS body, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS nth FROM documents),
c AS (SELECT *, row_number() OVER (ORDER BY doc_id DESC) AS p FROM b WHERE nth <= 8 ORDER BY doc_id DESC LIMIT 256),
w AS (SELECT 0::BIGINT AS p, []::VARCHAR[] AS groups, 0::BIGINT AS chars, NULL::BIGINT AS doc_id, NULL::VARCHAR AS x, false AS cut, NULL::VARCHAR AS lang
  UNION ALL SELECT p, CASE WHEN take THEN list_append(groups, source) ELSE groups END, CASE WHEN take THEN chars + length(y) ELSE chars END, CASE WHEN take THEN id END, CASE WHEN take THEN y END, length(body) > length(y), lang
  FROM (SELECT *, len(groups) < 16 AND chars < 12000 AND len(list_filter(groups, lambda g: g IS NOT DISTINCT FROM source)) < 2 AND length(y) > 0 AS take FROM (SELECT c.p, w.groups, w.chars, c.source, c.lang, c.doc_id AS id, c.body, regexp_replace(substr(c.body, 1, least(1200, 12000 - w.chars)), '\s+$', '') AS y FROM w JOIN c ON c.p = w.p + 1))),
o AS (SELECT doc_id, x, cut, (row_number() OVER (ORDER BY p) - 1)::INT AS place, sum(20 + strlen(coalesce(lang, '')) + strlen(x)) OVER (ORDER BY p) AS held FROM w WHERE doc_id IS NOT NULL)
SELECT place, doc_id, sha256(x) AS digest, cut AS truncated, held <= 9000 AS kept FROM o""",
}
