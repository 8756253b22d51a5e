"""Feeds, listings, artifacts and sinks: what comes from outside as rows, and what goes out."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from marlstone.operators.maintenance import put
from marlstone.session import load
from marlstone.shared import shared_path, written

#: Kinds of content by a file's ending.
AUDIO_ENDINGS = ("mp3", "m4a", "wav", "aac", "flac")
ENDINGS = {"video": ("mp4", "mkv", "webm", "mov"), "audio": AUDIO_ENDINGS, "document": ("pdf", "md", "html", "txt", "epub")}
AUDIO_FILE = r"(?i)\.(?:mp3|m4a|wav|aac|flac)(?:\?|$)"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size and modified of every file below a folder; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """item_id (name below the folder, size, time), title, url and content_type of the files of known kinds."""
    found = files(spark, path)
    below = F.regexp_replace(F.substring(F.col("path"), F.locate(path.rstrip("/").split("://")[-1], F.col("path")) + len(path.rstrip("/").split("://")[-1]), F.length("path")), "^/+", "")
    ending, kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)), F.lit(None).cast("string")
    for name, ends in ENDINGS.items():
        kind = F.when(ending.isin(*ends), name).otherwise(kind)
    item = F.concat_ws("|", below, F.col("size").cast("string"), F.unix_seconds("modified").cast("string"))
    return found.select(item.alias("item_id"), F.regexp_extract("path", "([^/]+)$", 1).alias("title"), F.col("path").alias("url"), kind.alias("content_type")).filter("content_type is not null")


def json_artifacts(spark: SparkSession, path: str, schema: str, most: int = 1 << 20) -> DataFrame:
    """path, size, oversized and value of JSON files; one of more than `most` bytes is not parsed, a broken
    one has no value."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.when(F.col("length") <= most, F.decode("content", "UTF-8"))
    return rows.select("path", F.col("length").alias("size"), (F.col("length") > most).alias("oversized"), F.from_json(text, schema).alias("value"))


def byte_range(content: Column, start: int, n: int) -> Column:
    """n bytes from a place (0 is the first); fewer at the end."""
    return F.substring(content, start + 1, n)


def unescaped(c: Column) -> Column:
    """XML's own entities and numbered characters of text as what they stand for, each once."""
    named = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))
    pieces = F.regexp_extract_all(c, F.lit(r"(&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};|&[a-z]+;|[^&]+|&)"), F.lit(1))

    def one(x: Column) -> Column:
        code = F.when(x.rlike("^&#x"), F.conv(F.substring(x, F.lit(4), F.length(x) - 4), 16, 10)).otherwise(F.regexp_extract(x, "^&#([0-9]+);$", 1)).try_cast("int")
        # a character by its number: its four bytes, read as UTF-32
        out = F.when(x.rlike(r"^&#") & (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).when(x == "&amp;", "&")
        for a, b in named:
            out = out.when(x == a, b)
        return out.otherwise(x)

    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(c)


def _inner(name: str) -> str:
    return rf"(?is)<{name}\b[^>]*>\s*(.*?)\s*</{name}>"


def _plain(c: Column) -> Column:
    """The text of an element: what a CDATA section holds as it is, else without entities."""
    section = F.regexp_extract(c, r"(?s)^<!\[CDATA\[(.*)\]\]>$", 1)
    return F.trim(F.when(c.startswith("<![CDATA["), section).otherwise(unescaped(c)))


def feed_items(feeds: DataFrame, key: str, xml: str) -> DataFrame:
    """key, position, item_id, title, url and content_type of the entries of RSS and Atom feeds.

    The id is guid or id, else the link; an entry without either goes. Papers and videos go by the link's
    host; an entry with an audio enclosure is audio, and its url is the enclosure's."""
    entry = F.posexplode(F.regexp_extract_all(xml, F.lit(r"(?is)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), F.lit(1)))
    rows = feeds.select(key, entry.alias("position", "_e"))
    text = lambda *names: F.coalesce(*(F.nullif(_plain(F.regexp_extract("_e", _inner(n), 1)), F.lit("")) for n in names))
    tags = F.regexp_extract_all("_e", F.lit(r"(?is)(<(?:link|enclosure)\b[^>]*>)"), F.lit(1))
    attribute = lambda t, name: unescaped(F.regexp_extract(t, rf"""(?i)\b{name}\s*=\s*["']([^"']*)["']""", 1))
    is_audio = lambda t: (t.rlike("(?i)^<enclosure") | (attribute(t, "rel") == "enclosure")) & (F.lower(attribute(t, "type")).contains("audio") | attribute(t, "href").rlike(AUDIO_FILE) | attribute(t, "url").rlike(AUDIO_FILE))
    audio = F.get(F.filter(tags, is_audio), F.lit(0))
    sound = F.coalesce(F.nullif(attribute(audio, "url"), F.lit("")), F.nullif(attribute(audio, "href"), F.lit("")))
    plain = F.get(F.filter(tags, lambda t: t.rlike("(?i)^<link") & (attribute(t, "rel").isin("", "alternate")) & (attribute(t, "href") != "")), F.lit(0))
    rows = rows.select(key, "position", F.coalesce(text("link"), attribute(plain, "href")).alias("link"), text("guid", "id").alias("own"), F.coalesce(text("title"), F.lit("")).alias("title"), sound.alias("sound"))
    low = F.lower(F.coalesce("link", F.lit("")))
    kind = F.when(low.contains("arxiv.org"), "paper").when(low.contains("youtube.com") | low.contains("youtu.be"), "video").when(F.col("sound").isNotNull(), "audio").otherwise("article")
    item = F.coalesce("own", F.nullif(F.col("link"), F.lit("")))
    url = F.when(kind == "audio", F.col("sound")).otherwise(F.coalesce(F.nullif(F.col("link"), F.lit("")), item))
    return rows.select(key, "position", item.alias("item_id"), "title", url.alias("url"), kind.alias("content_type")).filter("item_id is not null")


#: A box as XML, with its sides if they come first and in the usual order; others are looked for one by one.
_BOX = re.compile(r"<(?:(text)|image)\b(?:" + "".join(rf"""\s+{x}="(-?\d+(?:\.\d+)?)\"""" for x in ("top", "left", "width", "height")) + r")?([^>]*)>(?(1)(.*?)</text>)", re.I | re.S | re.A)
_SIDES = ("left", "top", "width", "height")
_SIDE = [re.compile(rf"""\b{x}\s*=\s*["'](-?\d+(?:\.\d+)?)""", re.I | re.A) for x in _SIDES]
#: What makes a box's text more than its characters, and an entity (each stands for what unescaped() says).
_ODD = r"[<&\t\n\x0b\f\r]|  |^ | $"
_ENTITY = re.compile(r"&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|&(lt|gt|quot|apos|amp);")
_NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}
_FOUND = pa.struct({"kind": pa.string(), "place": pa.int32(), **dict.fromkeys(_SIDES, pa.float64()), "text": pa.string()})
#: Pages whose boxes are Python's own values at once.
PAGES = 64


def _character(m: re.Match) -> str:
    if m[3]:
        return _NAMED[m[3]]
    code = int(m[1], 16) if m[1] else int(m[2])
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code <= 0xDFFF else m[0]


def _plain_text(x: str) -> str:
    return _ENTITY.sub(_character, re.sub(r"[ \t\n\x0b\f\r]+", " ", re.sub("<[^<>]*>", "", x)).strip(" "))


def _side(tag: str, side: re.Pattern) -> float | None:
    return float(m[1]) if (m := side.search(tag)) else None


@F.arrow_udf(from_arrow_type(pa.list_(_FOUND)))
def _boxes_of(pages: pa.Array) -> pa.Array:
    """The boxes of pages, a page a value, in the order of the XML."""
    return pa.concat_arrays([_boxes_of_some(pages.slice(i, PAGES).to_pylist()) for i in range(0, max(1, len(pages)), PAGES)])


def _boxes_of_some(pages: list[str]) -> pa.Array:
    found = [_BOX.findall(p) for p in pages]
    tags, top, left, width, height, rest, texts = zip(*chain.from_iterable(found), strict=True) if any(found) else [()] * 7
    if all(top):
        sides = [pa.array(c, pa.string()).cast(pa.float64()) for c in (left, top, width, height)]
    else:  # a tag with other attributes has all of them in rest
        sides = [pa.array([float(c) if c else _side(r, side) for c, r in zip(column, rest, strict=True)], pa.float64()) for column, side in zip((left, top, width, height), _SIDE, strict=True)]
    text = list(texts)
    for i in np.flatnonzero(pc.match_substring_regex(pa.array(text, pa.string()), _ODD).to_numpy(zero_copy_only=False)).tolist():
        text[i] = _plain_text(text[i])
    kinds = ["text" if t else "image" for t in tags]
    places = [*chain.from_iterable(range(len(f)) for f in found)]
    flat = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(places, pa.int32()), *sides, pa.array(text, pa.string())], fields=[*_FOUND])
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, found))], pa.int32()), flat, type=pa.list_(_FOUND))


def layout_pages(pages: DataFrame, key: str, xml: str) -> DataFrame:
    """key, page and boxes (kind, text or image; place, left, top, width, height and text) of PDF layout XML
    (pages of text and image tags with top, left, width, height), a page a row."""
    # a page ends at the next end of one, and begins at the first tag of one before it
    pieces = pages.select(key, F.split(xml, "</(?i)page>").alias("_e"))
    page = F.transform(F.slice("_e", F.lit(1), F.size("_e") - 1), lambda x: F.regexp_extract(x, r"<(?is)page\b[^>]*>.*", 0))
    rows = pieces.select(key, F.explode(page).alias("_p")).filter("_p != ''")
    return rows.select(key, F.regexp_extract("_p", r"""(?i)^<page\b[^>]*?\bnumber\s*=\s*["'](\d+)""", 1).cast("int").alias("page"), _boxes_of("_p").alias("boxes"))


def layout_boxes(pages: DataFrame, key: str, xml: str) -> DataFrame:
    """The boxes of layout_pages(), a box a row: key, page, kind, place, left, top, width, height and text."""
    return layout_pages(pages, key, xml).select(key, "page", F.inline("boxes"))


def box_union(boxes: DataFrame, *by: str) -> DataFrame:
    """The least box that holds a group's boxes."""
    return boxes.groupBy(*by).agg(F.min("left").alias("x0"), F.min("top").alias("y0"), F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1"))


def metric_lines(rows: DataFrame, name: str, value: str, *labels: str) -> DataFrame:
    """Lines name{label="value",...} value of a metrics file; values of labels are escaped, null ones are empty."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    inner = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), escaped(c), F.lit('"')) for c in labels))
    return rows.select(F.concat(F.lit(name), F.when(F.lit(bool(labels)), F.concat(F.lit("{"), inner, F.lit("}"))).otherwise(""), F.lit(" "), F.col(value).cast("string")).alias("value"))


def write_once(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines in a folder that is there whole or not at all; an existing one is an error."""
    rows.write.mode("errorifexists").json(path)


def store_contents(new: DataFrame, path: str) -> DataFrame:
    """Add contents (name: their digest, content) to a store of them. Known ones change nothing; a name that
    is not its content's digest, or stands for another one in the store, is an error and nothing is stored.
    Gives what became of each."""
    spark = new.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    store = spark.read.parquet(path) if there else new.select("name", "content").limit(0)
    fate = put(store, new)
    if bad := fate.filter("kind in ('corrupt', 'differs')").limit(3).collect():
        raise ValueError(f"contents that can't be stored: {', '.join(r.name for r in bad)}")
    fresh = new.groupBy("name").agg(F.min("content").alias("content")).join(fate.filter("kind = 'stored'").select("name"), "name")
    out = written(fate, "fate")  # what it was before the contents go in
    fresh.write.mode("append").parquet(path)
    return out


#: Sources by name: a function from a session and a source's id to items.
ADAPTERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"local_dir": listing}


def register(name: str, adapter: Callable[[SparkSession, str], DataFrame]) -> None:
    """A source of items under a name; a taken one is an error."""
    if name in ADAPTERS:
        raise ValueError(f"a source is registered as {name} already")
    ADAPTERS[name] = adapter


def items(spark: SparkSession, kind: str, source: str) -> DataFrame:
    if kind not in ADAPTERS:
        raise ValueError(f"unknown source {kind}: one of {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[kind](spark, source)


def rss_items(s: SparkSession, d: str) -> DataFrame:
    """Pages as feeds of four entries: an article with guid, audio, a paper without, one with no id at all."""
    n = F.col("page_id").cast("string")
    xml = F.concat(
        F.lit("<rss><channel><title>t</title><item><title><![CDATA[A "), n, F.lit("]]></title><guid isPermaLink='false'>g"), n, F.lit("</guid><link>"), F.col("url"), F.lit("</link></item>"),
        F.lit('<item><link>https://x.org/p</link><guid>a</guid><enclosure url="https://x.org/'), n, F.lit('.mp3?a=1" type="audio/mpeg"/></item>'),
        F.lit("<item><link>https://arxiv.org/abs/"), n, F.lit("</link></item><item><title>none</title></item></channel></rss>"),
    )
    return feed_items(load(s, d, "pages").select("page_id", xml.alias("xml")), "page_id", "xml").select("page_id", F.col("position").cast("int").alias("position"), "item_id", "title", "url", "content_type")


def atom_items(s: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    xml = F.concat(F.lit('<feed><entry><id>urn:'), n, F.lit('</id><title>T</title><link rel="alternate" href="https://youtu.be/'), n, F.lit('"/></entry><entry><link rel="enclosure" type="audio/x" href="https://x.org/s"/><link href="https://x.org/e"/></entry></feed>'))
    return feed_items(load(s, d, "pages").select("page_id", xml.alias("xml")), "page_id", "xml").select("page_id", "item_id", "title", "url", "content_type")


def pdf_boxes(s: SparkSession, d: str) -> DataFrame:
    """Conversations' turns as layout pages of two lines and a picture: the box that holds a page's lines."""
    n = F.col("turn").cast("string")
    xml = F.concat(F.lit('<pdf2xml><page number="'), n, F.lit('" height="9"><text top="'), n, F.lit('" left="10" width="50" height="12" font="0"><b>A &amp; B</b></text><text top="40" left="'), n, F.lit('" width="7.5" height="10">x</text><image top="1" left="1" width="3" height="3" src="a.png"/></page></pdf2xml>'))
    boxes = layout_boxes(load(s, d, "conversations").select("conv_id", xml.alias("xml")), "conv_id", "xml")
    texts = boxes.filter("kind = 'text'").groupBy("conv_id", "page").agg(F.max(F.when(F.col("place") == 0, F.col("text"))).alias("text"))
    images = boxes.groupBy("conv_id", "page").agg(F.count(F.when(F.col("kind") == "image", 1)).alias("images"))
    return box_union(boxes.filter("kind = 'text'"), "conv_id", "page").join(texts, ["conv_id", "page"]).join(images, ["conv_id", "page"])


def metrics_text(s: SparkSession, d: str) -> DataFrame:
    per = load(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return metric_lines(per, "events_total", "n", "event_type")


def _folder(s: SparkSession, d: str) -> str:
    """Documents' sources written as JSON lines, a folder of files each."""
    path = shared_path(s, "artifacts")
    rows = load(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    write_once(rows, path)
    return path


def json_files(s: SparkSession, d: str) -> DataFrame:
    """Artifacts written once and read back."""
    path = _folder(s, d)
    lines = s.read.schema("source string, n long").json(path)
    whole = files(s, path, "*.json").agg(F.sum("size").alias("bytes"))
    return lines.crossJoin(whole).select("source", "n", (F.col("bytes") > 0).alias("sized"))  # one row


def byte_ranges(s: SparkSession, d: str) -> DataFrame:
    """Bytes 10 to 29 of each document's UTF-8."""
    return load(s, d, "documents").select("doc_id", F.hex(byte_range(F.encode("text", "UTF-8"), 10, 20)).alias("bytes"))


QUERIES = {f.__name__: f for f in (rss_items, atom_items, pdf_boxes, metrics_text, json_files, byte_ranges)}
ORACLES = {
    "rss_items": """
SELECT page_id, 0 AS position, 'g' || page_id AS item_id, 'A ' || page_id AS title, url, 'article' AS content_type FROM pages
UNION ALL SELECT page_id, 1, 'a', '', 'https://x.org/' || page_id || '.mp3?a=1', 'audio' FROM pages
UNION ALL SELECT page_id, 2, 'https://arxiv.org/abs/' || page_id, '', 'https://arxiv.org/abs/' || page_id, 'paper' FROM pages""",
    "atom_items": "SELECT page_id, 'urn:' || page_id AS item_id, 'T' AS title, 'https://youtu.be/' || page_id AS url, 'video' AS content_type FROM pages UNION ALL SELECT page_id, 'https://x.org/e', '', 'https://x.org/s', 'audio' FROM pages",
    "pdf_boxes": "SELECT conv_id, turn::INT AS page, least(10, turn)::DOUBLE AS x0, least(turn, 40)::DOUBLE AS y0, greatest(60, turn + 7.5)::DOUBLE AS x1, greatest(turn + 12, 50)::DOUBLE AS y1, 'A & B' AS text, 1::BIGINT AS images FROM conversations",
    "metrics_text": "SELECT 'events_total{event_type=\"' || event_type || '\"} ' || count(*) AS value FROM events GROUP BY event_type",
    "json_files": "SELECT source, count(*) AS n, true AS sized FROM documents GROUP BY source",
    "byte_ranges": "SELECT doc_id, substring(hex(encode(text)), 21, 40) AS bytes FROM documents",
}
