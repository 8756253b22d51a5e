"""Which table, figure or block of one form of a document is which of another: by caption, by label, by a
caption that holds the other; each partner is given once, and what is not certain is kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.scalars import match_text
from marlstone.operators.textops import holding
from marlstone.session import load

LEAST, RATIO = 8, 0.85


def label_of(caption: Column) -> Column:
    """The normal form of the label with which a caption begins (`fig. 3` and `Figure 3:` are one), or null."""
    kind = F.lower(F.regexp_extract(caption, r"(?i)^\s*(figure|fig|table|tab|algorithm|alg|图|表)", 1))
    number = F.regexp_extract(caption, r"(?i)^\s*(?:figure|fig|table|tab|algorithm|alg|图|表)[.\s]*([0-9]+(?:[.][0-9]+)*|[ivxlc]+\b)", 1)
    name = F.when(kind.isin("fig", "图"), "figure").when(kind.isin("tab", "表"), "table").when(kind == "alg", "algorithm").otherwise(kind)
    return F.when((kind != "") & (number != ""), F.concat_ws(" ", name, F.lower(number)))


def linked(left: DataFrame, right: DataFrame, least: int = LEAST, ratio: float = RATIO) -> DataFrame:
    """id, match, confidence, state and method of each row of left. Both sides: doc, id (unique on its side),
    place, caption, and label where it is known otherwise than by the caption (a column, may be null).

    Within a document, captions in the form in which texts are compared, of `least` characters and more:
    caption: the only equal one; label: else the only one of that label, if it is the only one here too;
    contained: else the only one that holds this caption or lies in it, with 85 % of the longer's length.
    Several that would do are ambiguous. Of rows that come to the same partner the first by place gets it,
    the others are ambiguous."""
    form = match_text(F.coalesce("caption", F.lit("")))
    side = lambda df, a, b: df.select("doc", F.col("id").alias(a), "place", form.alias(b), F.coalesce(F.col("label") if "label" in df.columns else F.lit(None).cast("string"), label_of(F.col("caption"))).alias(f"{b}_label"))
    here, there = side(left, "id", "needle"), side(right, "match", "body").drop("place")
    long_here, long_there = here.filter(F.length("needle") >= least), there.filter(F.length("body") >= least)
    known = lambda method, share, n: F.struct(F.lit(method).alias("method"), share.alias("share"), n.alias("n"), F.col("match"))

    exact = long_here.join(long_there.withColumnRenamed("body", "needle"), ["doc", "needle"]).groupBy("id").agg(F.count("*").alias("n"), F.min("match").alias("match"))
    exact = exact.select("id", known("caption", F.lit(1.0), F.col("n")).alias("x"))
    rest = here.join(exact, "id", "left_anti")
    own = here.filter("needle_label is not null").groupBy("doc", "needle_label").agg(F.count("*").alias("own"))
    theirs = there.filter("body_label is not null").groupBy("doc", F.col("body_label").alias("needle_label")).agg(F.count("*").alias("n"), F.min("match").alias("match"))
    labelled = rest.join(own, ["doc", "needle_label"]).join(theirs, ["doc", "needle_label"])
    labelled = labelled.select("id", known("label", F.lit(1.0), F.greatest("own", "n")).alias("x"))
    rest = rest.join(labelled, "id", "left_anti").filter(F.length("needle") >= least)

    a, b = rest.select("id", "doc", "needle"), long_there.select("match", "doc", "body")
    inside = holding(b, a, "body", "needle", "match", "id", "doc").unionByName(holding(a, b, "needle", "body", "id", "match", "doc"))
    share = F.least(F.length("needle"), F.length("body")) / F.greatest(F.length("needle"), F.length("body"))
    held = inside.select("id", "match", share.alias("share")).distinct().groupBy("id").agg(F.count("*").alias("n"), F.min("match").alias("match"), F.max("share").alias("share"))
    held = held.select("id", known("contained", F.round("share", 6), F.when((F.col("n") == 1) & (F.col("share") >= ratio), 1).otherwise(2).cast("long")).alias("x"))

    found = here.select("id", "place").join(exact.unionByName(labelled).unionByName(held), "id", "left")
    one = F.when(F.col("x.n") == 1, F.col("x.match"))
    first = F.row_number().over(Window.partitionBy(one).orderBy("place", "id")) == 1
    found = found.withColumn("match", one)
    # rows without a partner stand in no window, which would be one for all of them
    taken = found.filter("match is not null").withColumn("_first", first)
    good = F.col("_first")
    certain = taken.select("id", F.when(good, F.col("match")).alias("match"), F.when(good, F.col("x.share")).otherwise(0.0).alias("confidence"), F.when(good, "matched").otherwise("ambiguous").alias("state"), "x.method")
    unsure = found.filter("match is null").select("id", F.lit(None).cast(dict(found.dtypes)["match"]).alias("match"), F.lit(0.0).alias("confidence"), F.when(F.col("x").isNull(), "unmatched").otherwise("ambiguous").alias("state"), "x.method")
    return certain.unionByName(unsure)


def _visuals(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations as captioned figures of a document, and the same in its other form: by place,
    mod 6, in capitals; with the label alone and another text; without the last word; twice; missing; short."""
    t = load(s, d, "conversations").filter("text is not null").select(F.col("conv_id").alias("doc"), F.col("turn").alias("place"), F.regexp_replace("text", r"\s+", " ").alias("t"))
    name = F.concat(F.lit("Figure "), F.col("place").cast("string"))
    left = t.select("doc", (F.col("doc") * 1000 + F.col("place")).alias("id"), "place", F.when(F.col("place") % 6 == 2, F.col("t")).otherwise(F.concat(name, F.lit(": "), F.col("t"))).alias("caption"))
    k = F.col("place") % 6
    other = F.when(k == 1, F.concat(F.lit("FIG. "), F.col("place").cast("string"), F.lit(" redrawn"))).when(k == 2, F.regexp_replace("t", r" [^ ]*$", "")).when(k == 5, F.lit("Fig")).otherwise(F.concat(F.upper(name), F.lit(":  "), F.upper("t")))
    right = t.filter("place % 6 <> 4").select("doc", (F.col("doc") * 1000 + F.col("place")).alias("id"), "place", other.alias("caption"))
    again = right.filter("place % 6 = 3").withColumn("id", F.col("id") + 500)
    return left, right.unionByName(again)


def visual_links(s: SparkSession, d: str) -> DataFrame:
    return linked(*_visuals(s, d)).select("id", "match", F.round("confidence", 6).alias("confidence"), "state", "method")


QUERIES = {"visual_links": visual_links}
_FORM = "replace(lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'), ' ')), 'ß', 'ss')"
ORACLES = {
    "visual_links": rf"""
WITH t AS (SELECT conv_id AS doc, turn AS place, regexp_replace(text, '\s+', ' ', 'g') AS t FROM conversations WHERE text IS NOT NULL),
l AS (SELECT doc, doc * 1000 + place AS id, place, CASE WHEN place % 6 = 2 THEN t ELSE 'Figure ' || place || ': ' || t END AS c, CASE WHEN place % 6 = 2 THEN NULL ELSE place END AS label FROM t),
r0 AS (SELECT doc, doc * 1000 + place AS id, place, CASE place % 6 WHEN 1 THEN 'FIG. ' || place || ' redrawn' WHEN 2 THEN regexp_replace(t, ' [^ ]*$', '') WHEN 5 THEN 'Fig' ELSE 'FIGURE ' || place || ':  ' || upper(t) END AS c, CASE WHEN place % 6 IN (2, 5) THEN NULL ELSE place END AS label FROM t WHERE place % 6 <> 4),
r AS (SELECT doc, id, {_FORM.format(c="c")} AS body, label FROM r0 UNION ALL SELECT doc, id + 500, {_FORM.format(c="c")}, label FROM r0 WHERE place % 6 = 3),
h AS (SELECT doc, id, place, {_FORM.format(c="c")} AS needle, label FROM l),
e AS (SELECT h.id, count(*) AS n, min(r.id) AS match FROM h JOIN r ON r.doc = h.doc AND body = needle WHERE length(needle) >= 8 GROUP BY h.id),
g AS (SELECT h.id, greatest((SELECT count(*) FROM h o WHERE o.doc = h.doc AND o.label = h.label), count(*)) AS n, min(r.id) AS match FROM h JOIN r ON r.doc = h.doc AND r.label = h.label WHERE h.id NOT IN (SELECT id FROM e) GROUP BY h.id, h.doc, h.label),
c AS (SELECT h.id, count(*) AS k, min(r.id) AS match, max(least(length(needle), length(body))::DOUBLE / greatest(length(needle), length(body))) AS share FROM h JOIN r ON r.doc = h.doc AND (contains(body, needle) OR contains(needle, body))
  WHERE length(needle) >= 8 AND length(body) >= 8 AND h.id NOT IN (SELECT id FROM e) AND h.id NOT IN (SELECT id FROM g) GROUP BY h.id),
x AS (SELECT id, 'caption' AS method, 1.0::DOUBLE AS share, n, match FROM e UNION ALL SELECT id, 'label', 1.0, n, match FROM g UNION ALL SELECT id, 'contained', round(share, 6), CASE WHEN k = 1 AND share >= 0.85 THEN 1 ELSE 2 END, match FROM c),
w AS (SELECT h.id, method, share, CASE WHEN n = 1 THEN match END AS m, n, CASE WHEN n = 1 THEN row_number() OVER (PARTITION BY CASE WHEN n = 1 THEN match END ORDER BY place, h.id) END AS nth FROM h LEFT JOIN x ON x.id = h.id)
SELECT id, CASE WHEN nth = 1 THEN m END AS match, CASE WHEN nth = 1 THEN share ELSE 0.0::DOUBLE END AS confidence, CASE WHEN nth = 1 THEN 'matched' WHEN n IS NULL THEN 'unmatched' ELSE 'ambiguous' END AS state, method FROM w""",
}
