"""Reading order of laid-out pages, and captions of their pictures.

A page's boxes (layout_boxes) are cut where white space allows: as long as a vertical strip of white runs
through a stretch of the page, the stretch is read column by column, each cut again; else from top to
bottom. A page is one row, as it has one reading order; documents of any length spread over tasks
page by page.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from itertools import pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from marlstone.functions import text as T
from marlstone.operators.packing import caption
from marlstone.session import load
from marlstone.sources.feeds import PAGES, layout_pages

#: A strip is white space between columns if it is so many times as wide as a line is high.
STRIP = 1.0
#: What a caption begins with.
CAPTION = r"(?i)^(?:figure|fig\.?|table|tab\.?|图|表)\s*(\d+)"

Box = tuple[float, float, float, float, int]  # left, top, right, bottom, number


def _fused(spans: list[tuple[float, float]], strip: float) -> list[tuple[float, float]]:
    """The spans from left to right, those with less white than a strip between them made one."""
    if len(spans) == 1:
        return spans
    out: list[tuple[float, float]] = []
    begin = end = None
    for a, b in sorted(spans):
        if end is None:
            begin, end = a, b
        elif a - end >= strip:
            out.append((begin, end))
            begin, end = a, b
        elif b > end:
            end = b
    out.append((begin, end))
    return out


def _bands(boxes: list[Box]) -> list[list[Box]]:
    """Boxes, which come from top to bottom, cut at every horizontal strip of white."""
    out: list[list[Box]] = []
    end = float("-inf")
    for box in boxes:
        if box[1] >= end:
            out.append([box])
            end = box[3]
        else:
            out[-1].append(box)
            if box[3] > end:
                end = box[3]
    return out


def reading(boxes: list[Box]) -> list[tuple[int, str]]:
    """Numbers of the boxes in reading order, each with the path of columns that it lies in.

    Bands that follow one another belong together as long as one strip of white runs through all of them
    between two columns; such a stretch of two bands and more is read column by column."""
    if not boxes:
        return []
    heights = sorted([b[3] - b[1] for b in boxes])
    strip = max(1.0, STRIP * heights[len(heights) // 2])
    out: list[tuple[int, str]] = []

    def read(part: list[Box], path: str) -> None:
        bands = _bands(part)
        across = [_fused([(b[0], b[2]) for b in band], strip) for band in bands]
        i = 0
        while i < len(bands):
            j, spans = i + 1, across[i]
            while j < len(bands) and len(both := spans if across[j] == spans else _fused(spans + across[j], strip)) > 1:
                j, spans = j + 1, both
            if j > i + 1:
                cuts = [(a[1] + b[0]) / 2 for a, b in pairwise(spans)]
                held: list[list[Box]] = [[] for _ in range(len(cuts) + 1)]
                for band in bands[i:j]:
                    for b in band:
                        held[bisect_left(cuts, b[0])].append(b)
                for k, column in enumerate(held):
                    read(column, f"{path}{k}.")
            elif len(bands[i]) == 1:
                out.append((bands[i][0][4], path))
            else:
                out.extend([(b[4], path) for b in sorted(bands[i], key=_FROM_LEFT)])
            i = j

    read(sorted(boxes, key=_FROM_TOP), "")
    return out


_FROM_TOP, _FROM_LEFT = itemgetter(1, 0, 4), itemgetter(0, 1, 4)


def _read(pages: pa.Array) -> pa.Array:
    """The boxes of pages, a page a value, in reading order, each with number and column."""
    return pa.concat_arrays([_read_some(pages.slice(i, PAGES)) for i in range(0, max(1, len(pages)), PAGES)])


def _read_some(pages: pa.Array) -> pa.Array:
    flat, sizes = pages.flatten(), pages.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    left, top, width, height = (flat.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("left", "top", "width", "height"))
    unknown = np.isnan(left) | np.isnan(top) | np.isnan(width) | np.isnan(height)
    some = unknown.any()
    boxes = [*zip(left.tolist(), top.tolist(), (left + width).tolist(), (top + height).tolist(), range(len(flat)), strict=True)]
    found: list[tuple[int, str]] = []
    ends = np.cumsum(sizes)
    for begin, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        if some and (rest := np.flatnonzero(unknown[begin:end]) + begin).size:
            found += reading([b for b in boxes[begin:end] if not unknown[b[4]]]) + [(i, "") for i in rest.tolist()]
        else:
            found += reading(boxes[begin:end])
    held = flat.take(pa.array([i for i, _ in found], pa.int32()))
    numbers = pa.array(np.arange(len(found)) - np.repeat(ends - sizes, sizes), pa.int32())
    names = [f.name for f in flat.type if f.name not in ("number", "column")]
    held = pa.StructArray.from_arrays([*map(held.field, names), numbers, pa.array([path for _, path in found], pa.string())], [*names, "number", "column"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), held)


def read_pages(pages: DataFrame) -> DataFrame:
    """pages, whose boxes (place, left, top, width, height and what else they have) come in the order of their
    places, with boxes in reading order, each with number (from 0) and column (the path of its columns). Boxes
    without a place on the page come last."""
    kind = pages.schema["boxes"].dataType.elementType
    kind = StructType([f for f in kind if f.name not in ("number", "column")]).add("number", IntegerType()).add("column", StringType())
    return pages.withColumn("boxes", F.arrow_udf(_read, ArrayType(kind))("boxes"))


def _gathered(boxes: DataFrame, key: str, *order: str) -> DataFrame:
    """Boxes, a box a row, as pages of a row each."""
    names = [c for c in boxes.columns if c not in (key, "page")]
    first = sorted(names, key=lambda c: order.index(c) if c in order else len(order))
    return boxes.groupBy(key, "page").agg(F.sort_array(F.collect_list(F.struct(*first))).alias("boxes"))


def ordered(boxes: DataFrame, key: str) -> DataFrame:
    """boxes (key, page, kind, place, left, top, width, height, text) with number (from 0, in the page's
    reading order) and column (the path of its columns). Boxes without a place on the page come last."""
    held = read_pages(_gathered(boxes, key, "place")).select(key, "page", F.inline("boxes"))
    return held.select(*boxes.columns, "number", "column")


def _by_column(pages: DataFrame, kept: Callable[[Column], Column]) -> DataFrame:
    """Pages with boxes b, those of their texts that are kept, column by column in the order of reading."""
    texts = F.transform(F.filter("boxes", lambda x: (x["kind"] == "text") & kept(x)), lambda x: F.struct(*(x[c].alias(c) for c in ("column", "number", "place", "left", "top", "width", "height", "text"))))
    return pages.withColumn("b", F.sort_array(texts))


def _cut(pages: DataFrame, first: Callable[[Column, Column], Column]) -> DataFrame:
    """Pages with groups, b cut where a box is the first of a group: first() has a box and the one before it
    in its column, or null."""
    with_last = F.transform("b", lambda x, i: F.struct(x.alias("x"), F.when(F.get("b", i - 1)["column"] == x["column"], F.get("b", i - 1)).alias("last")))
    begins = F.transform(with_last, lambda p, i: F.when(p["last"].isNull() | first(p["x"], p["last"]), i))
    rows = pages.withColumn("_i", F.filter(begins, lambda i: i.isNotNull()))
    group = F.transform("_i", lambda i, k: F.slice("b", i + 1, F.coalesce(F.get("_i", k + 1), F.size("b")) - i))
    return rows.withColumn("groups", group)


def _in_one_line(top: float | None, height: float | None, top2: float | None, height2: float | None) -> bool:
    """Whether two boxes overlap in height by half of the lower one. A side that is not known does not count, as
    in SQL's least and greatest; there NaN is the largest number."""
    if None not in (top, height, top2, height2) and (x := top + height + top2 + height2) == x:
        return (min(top + height, top2 + height2) - max(top, top2)) * 2 >= min(height, height2)
    order = lambda x: (1, 0.0) if x != x else (0, x)
    known = lambda *xs: [x for x in xs if x is not None]
    bottoms = [a + b for a, b in ((top, height), (top2, height2)) if a is not None and b is not None]
    tops, heights = known(top, top2), known(height, height2)
    return bool(bottoms and tops and heights) and order((min(bottoms, key=order) - max(tops, key=order)) * 2) >= order(min(heights, key=order))


_LINE = pa.struct({"column": pa.string(), "line": pa.int32(), "first": pa.int32(), "text": pa.string()})


@F.arrow_udf(from_arrow_type(pa.list_(_LINE)))
def _lines_of(pages: pa.Array) -> pa.Array:
    """The lines of pages with ordered boxes, a page a value."""
    return pa.concat_arrays([_lines_of_some(pages.slice(i, PAGES)) for i in range(0, max(1, len(pages)), PAGES)])


def _values(column: pa.Array) -> list:
    """A column's values; by numpy, which takes a tenth of the time, where none is null."""
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def _lines_of_some(pages: pa.Array) -> pa.Array:
    flat, sizes = pages.flatten(), pages.value_lengths().fill_null(0).to_pylist()
    kind, column, number, top, height, text = (_values(flat.field(c)) for c in ("kind", "column", "number", "top", "height", "text"))
    found: list[tuple[str, int, int, list]] = []
    ends, end = [0], 0
    for size in sizes:
        begin, end, last, pieces = end, end + size, None, []
        for i in sorted([i for i in range(begin, end) if kind[i] == "text"], key=lambda i: (column[i], number[i])):
            if last is not None and column[i] == column[last] and _in_one_line(top[i], height[i], top[last], height[last]):
                pieces.append(text[i])
            else:
                line = found[-1][1] + 1 if last is not None and column[i] == column[last] else 0
                pieces = [text[i]]
                found.append((column[i], line, number[i], pieces))
            last = i
        ends.append(len(found))
    columns = [*zip(*found, strict=True)] or [()] * 4
    columns[3] = [" ".join([t for t in pieces if t is not None]) for pieces in columns[3]]
    held = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LINE, strict=True)], fields=[*_LINE])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held, type=pa.list_(_LINE))


def page_lines(pages: DataFrame, key: str) -> DataFrame:
    """lines() of the pages that read_pages() gives."""
    found = pages.select(key, "page", _lines_of("boxes").alias("_l"))
    return found.select(key, "page", F.inline(F.flatten(F.array("_l"))))  # a column would be asked for its size first, and so be made twice


def lines(boxes: DataFrame, key: str) -> DataFrame:
    """key, page, column, line (from 0), first (its first box's number) and text of the lines of ordered text boxes:
    neighbours in reading order that overlap in height by half of the lower one are one line."""
    return page_lines(_gathered(boxes, key, "number"), key)


def page_captions(pages: DataFrame, key: str) -> DataFrame:
    """captions() of the pages that read_pages() gives."""
    right, bottom = lambda x: x["left"] + x["width"], lambda x: x["top"] + x["height"]
    placed = lambda x: x["left"].isNotNull() & x["top"].isNotNull() & x["width"].isNotNull() & x["height"].isNotNull()
    begins = lambda x: x["text"].rlike(CAPTION)
    far = lambda x, b: F.coalesce(x["top"] - bottom(b) > x["height"], F.lit(True))
    rows = _cut(_by_column(pages, placed), lambda x, b: far(x, b) | begins(x))
    sides = lambda g: (f(F.transform(g, of)).alias(c) for c, f, of in (("c0", F.array_min, lambda x: x["left"]), ("d0", F.array_min, lambda x: x["top"]), ("c1", F.array_max, right), ("d1", F.array_max, bottom)))
    found = F.transform(F.filter("groups", lambda g: begins(g[0])), lambda g: F.struct(g[0]["place"].alias("caption"), *sides(g), F.transform(g, lambda x: x["text"]).alias("pieces")))
    pictures = F.transform(F.filter("boxes", lambda x: (x["kind"] == "image") & placed(x)), lambda x: F.struct(x["place"].alias("picture"), x["left"].alias("left"), x["top"].alias("top"), right(x).alias("right"), bottom(x).alias("bottom")))
    rows = rows.select(key, "page", pictures.alias("_pictures"), found.alias("_found"))
    # one expression: an exploded column would be asked for its size first, and so be made twice
    pairs = F.flatten(F.transform("_pictures", lambda p: F.transform("_found", lambda f: F.struct(*(p[c].alias(c) for c in ("picture", "left", "top", "right", "bottom")), *(f[c].alias(c) for c in ("caption", "c0", "d0", "c1", "d1", "pieces"))))))
    both = rows.select(key, "page", F.inline(pairs)).filter("left < c1 and c0 < right")  # a page's pictures and captions
    distance = F.greatest(F.col("d0") - F.col("bottom"), F.col("top") - F.col("d1"), F.lit(0.0))
    both = both.withColumn("distance", distance)
    first = lambda side, other: F.row_number().over(Window.partitionBy(key, "page", side).orderBy("distance", other)) == 1
    both = both.withColumns({"_a": first("picture", "caption"), "_b": first("caption", "picture")}).filter("_a and _b").withColumn("text", caption(F.col("pieces")))
    return both.select(key, "page", "picture", "caption", F.regexp_extract("text", CAPTION, 1).alias("label"), "text")


def captions(boxes: DataFrame, key: str) -> DataFrame:
    """key, page, picture and caption (the boxes' places), label and text: of a page's pictures and captions
    those that are nearest to each other, both ways (ties to the one placed first). Only boxes that share a
    part of their width meet; a caption's text takes in the lines that follow it in its column, as long as
    none is further away than its own height."""
    return page_captions(_gathered(boxes, key, "number"), key)


def _pages(s: SparkSession, d: str) -> DataFrame:
    """Documents as pages read from layout XML: on each page a title over the whole width, 24 words in two columns of six
    lines with two words each, and a picture over its caption in the second one. Boxes stand in the XML
    from the bottom to the top, columns mixed."""
    words = F.filter(F.split(T.escape_html(F.col("text")), r"\s+"), lambda w: w != "")
    rows = load(s, d, "documents").filter("text is not null").select("doc_id", words.alias("w"))
    pages = rows.select("doc_id", "w", F.explode(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 24)))).alias("page"))
    here = F.slice(F.col("w"), (F.col("page") * 24 + 1).cast("int"), F.lit(24))
    tasks = max(int(s.conf.get("spark.sql.shuffle.partitions")), 4 * s.sparkContext.defaultParallelism)
    pages = pages.select("doc_id", "page", here.alias("here")).repartition(tasks, "doc_id", "page")  # one file's documents go to many tasks
    tag = lambda top, left, width: f'<text top="{top}" left="{left}" width="{width}" height="10" font="0">'
    box = lambda *x: F.concat(F.lit(tag(*x[:3])), *x[3:], F.lit("</text>"))
    tags = F.array(*(F.lit(tag(40 + i // 2 % 6 * 14, 90 * (i % 2) + 220 * (i >= 12), 84)) for i in range(24)))
    shown = F.reverse(F.transform("here", lambda x, i: F.concat(F.get(tags, i), x, F.lit("</text>"))))
    number = lambda x: x.cast("string")
    page = F.concat(
        F.lit('<page number="'), number(F.col("page") + 1), F.lit('" top="0" left="0" height="300" width="420">'), box(290, 230, 150, F.lit("Figure "), number(F.col("page") + 1), F.lit(": mea-")), box(302, 230, 80, F.lit("sured &amp; drawn")),
        F.lit('<image top="150" left="230" width="120" height="130" src="a.png"/>'), F.array_join(shown, ""), box(10, 60, 260, F.lit("Title &lt;"), number(F.col("page")), F.lit("&gt;")), F.lit("</page>"),
    )
    return read_pages(layout_pages(pages.select("doc_id", F.concat(F.lit("<pdf2xml>"), page, F.lit("</pdf2xml>")).alias("xml")), "doc_id", "xml"))


def pdf_reading_order(s: SparkSession, d: str) -> DataFrame:
    """The words of laid-out pages come out in the order in which they were laid out."""
    words = F.transform(F.filter("boxes", lambda x: (x["kind"] == "text") & x["top"].between(20, 120)), lambda x: x["text"])
    rows = _pages(s, d).select("doc_id", "page", F.array_join(words, " ").alias("t"))  # no page is without words
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: x["t"]), " ")
    return rows.groupBy("doc_id").agg(F.sha2(text, 256).alias("digest"), F.count_distinct("page").alias("pages"))


def pdf_lines(s: SparkSession, d: str) -> DataFrame:
    """Lines of the pages: the title, then the lines of both columns, then the caption."""
    return page_lines(_pages(s, d), "doc_id").groupBy("doc_id").agg(F.count("*").alias("lines"), F.count(F.when(F.col("text").startswith("Title <"), 1)).alias("titles"), F.sum(F.when(F.col("text").startswith("Title"), F.col("first")).otherwise(0)).alias("place"))


def pdf_captions(s: SparkSession, d: str) -> DataFrame:
    return page_captions(_pages(s, d), "doc_id").select("doc_id", "page", "label", "text")


QUERIES = {f.__name__: f for f in (pdf_reading_order, pdf_lines, pdf_captions)}

_WORDS = "w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, w, len(w) AS n, (len(w) + 23) // 24 AS pages FROM w WHERE len(w) > 0)"
ORACLES = {
    "pdf_reading_order": f"WITH {_WORDS} SELECT doc_id, sha256(array_to_string(w, ' ')) AS digest, pages::BIGINT AS pages FROM n",
    "pdf_lines": f"WITH {_WORDS} SELECT doc_id, (pages * 3 + (pages - 1) * 12 + ((n - (pages - 1) * 24) + 1) // 2)::BIGINT AS lines, pages::BIGINT AS titles, 0::BIGINT AS place FROM n",
    "pdf_captions": f"WITH {_WORDS}, p AS (SELECT doc_id, unnest(range(1, pages + 1)) AS page FROM n) SELECT doc_id, page::INT AS page, page::VARCHAR AS label, 'Figure ' || page || ': measured & drawn' AS text FROM p",
}
