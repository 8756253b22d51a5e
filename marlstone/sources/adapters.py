"""Source adapters as Spark data sources: what a source holds as items, in a batch or as a stream.

* corpus_feed: files of feeds, a feed a line, as items of their entries. A file is read in ranges of bytes:
  a range gives the lines that begin in it, and seeks to them, so that large files spread over tasks.
* corpus_listing: a folder of files as items, folder by folder.
* corpus_ranges: byte ranges of files, read by seeking (one range a row of the option `ranges`).

Items: source, position, item_id, title, url, content_type. As a stream, corpus_feed gives the items of
lines that are new. Its offset is a file's name and a place in it: files are read in the order of their
names, and the last one may grow; so an offset is small however many files there are, and a stream that
stops goes on behind the last line it has given. Names must sort in the order in which files come.

Paths are those of pyarrow's file systems (a local path, file:, s3:, gs:, hdfs:).
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from marlstone.session import load
from marlstone.shared import shared_path
from marlstone.sources.feeds import AUDIO_ENDINGS, ENDINGS

#: Bytes of a file that a task reads, unless the option `range` says otherwise.
RANGE = 32 << 20
ITEM = "source string, position int, item_id string, title string, url string, content_type string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def files_in(path: str) -> list[fs.FileInfo]:
    """The files below a path by name; hidden ones (_ and . before their names) are left out."""
    system, inner = opened(path)
    found = system.get_file_info(fs.FileSelector(inner, recursive=True)) if system.get_file_info(inner).type == fs.FileType.Directory else [system.get_file_info(inner)]
    return sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)


@dataclass
class Range(InputPartition):
    """Bytes of a file."""

    path: str
    start: int
    end: int


def cut(path: str, start: int, end: int, size: int) -> list[Range]:
    return [Range(path, k, min(k + size, end)) for k in range(start, end, size)]


def lines_of(system: fs.FileSystem, part: Range) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of the lines that begin in a range; no byte before the range is read but one."""
    with system.open_input_file(part.path) as file:
        at = part.start
        file.seek(max(0, at - 1))
        f = io.BufferedReader(file, 1 << 16)
        if at:
            at += len(f.readline()) - 1  # the rest of a line that began before, if it isn't just its end
        while at < part.end:
            line = f.readline()
            if not line:
                return
            yield at, line.rstrip(b"\r\n")
            at += len(line)


def whole_lines(system: fs.FileSystem, path: str, start: int, size: int) -> int:
    """The place behind the last line that is complete."""
    step, end = 1 << 16, size
    with system.open_input_file(path) as f:
        while end > start:
            begin = max(start, end - step)
            f.seek(begin)
            if (k := f.read(end - begin).rfind(b"\n")) >= 0:
                return begin + k + 1
            end = begin
    return start


def _name(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def entries(xml: bytes) -> list[tuple[str, str, str, str]]:
    """item_id, title, url and content_type of a feed's entries; a feed that is no XML has none.

    The id is guid or id, else the link; an entry without either goes. The link is the text of link, else
    the address of a link that is an alternate. Papers and videos go by the link's host; an entry with an
    audio enclosure is audio, and its url is the enclosure's."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return []
    out = []
    for entry in (x for x in root.iter() if _name(x.tag) in ("item", "entry")):
        kids = [(_name(k.tag), k) for k in entry]
        text = lambda *names: next((v for n in names for t, k in kids if t == n and (v := " ".join((k.text or "").split()))), "")  # noqa: B023, E731
        links = [k for t, k in kids if t in ("link", "enclosure")]
        is_audio = lambda k: (_name(k.tag) == "enclosure" or k.get("rel") == "enclosure") and ("audio" in k.get("type", "").lower() or (k.get("url") or k.get("href") or "").split("?")[0].lower().endswith(tuple("." + e for e in AUDIO_ENDINGS)))
        sound = next(((k.get("url") or k.get("href") or "").strip() for k in links if is_audio(k)), "")
        plain = next((k.get("href").strip() for k in links if _name(k.tag) == "link" and k.get("rel", "alternate") == "alternate" and k.get("href")), "")
        link = text("link") or plain
        item = text("guid", "id") or link
        if not item:
            continue
        low = link.lower()
        kind = "paper" if "arxiv.org" in low else "video" if "youtube.com" in low or "youtu.be" in low else "audio" if sound else "article"
        out.append((item, text("title"), sound if kind == "audio" else link or item, kind))
    return out


def _batches(rows: Iterator[tuple], schema: str, most: int = 5000) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*held, strict=True), fields, strict=True)], [n for n, _ in fields])

    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield batch(held)
            held = []
    if held:
        yield batch(held)


def _feed_rows(path: str, part: Range) -> Iterator[tuple]:
    system, _ = opened(path)
    for at, line in lines_of(system, part):
        source = f"{part.path.rpartition('/')[2]}:{at}"
        for position, entry in enumerate(entries(line)):
            yield (source, position, *entry)


class _FeedReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Range]:
        return [r for f in files_in(self.path) for r in cut(f.path, 0, f.size, self.size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(_feed_rows(self.path, partition), ITEM) if partition is not None else iter(())


class _FeedStream(DataSourceStreamReader):
    """Lines of files in the order of their names; an offset is the last file's name and a place in it."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {"file": "", "at": 0}

    def latestOffset(self) -> dict:
        found = files_in(self.path)
        if not found:
            return self.initialOffset()
        last = found[-1]
        return {"file": last.path, "at": whole_lines(opened(self.path)[0], last.path, 0, last.size)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for f in files_in(self.path):
            if start["file"] <= f.path <= end["file"]:
                first = start["at"] if f.path == start["file"] else 0
                out += cut(f.path, first, end["at"] if f.path == end["file"] else f.size, self.size)
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(_feed_rows(self.path, partition), ITEM)


class Feeds(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus_feed"

    def schema(self) -> str:
        return ITEM

    def reader(self, schema) -> DataSourceReader:
        return _FeedReader(self.options["path"], int(self.options.get("range", RANGE)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _FeedStream(self.options["path"], int(self.options.get("range", RANGE)))


@dataclass
class Folder(InputPartition):
    path: str


class _ListingReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Folder]:
        """The folder's own files, and each folder in it with all below."""
        system, inner = opened(self.path)
        return [Folder(""), *(Folder(f.path) for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.Directory)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        system, inner = opened(self.path)
        found = system.get_file_info(fs.FileSelector(partition.path or inner, recursive=bool(partition.path)))

        def rows() -> Iterator[tuple]:
            for f in sorted(found, key=lambda f: f.path):
                ending = f.extension.lower()
                kind = next((k for k, ends in ENDINGS.items() if ending in ends), None)
                if f.type == fs.FileType.File and kind:
                    below = f.path[len(inner.rstrip("/")) + 1 :]
                    yield below.rpartition("/")[0], 0, f"{below}|{f.size}|{int((f.mtime_ns or 0) // 1_000_000_000)}", f.base_name, f.path, kind

        return _batches(rows(), ITEM)


class Listing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus_listing"

    def schema(self) -> str:
        return ITEM

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(self.options["path"])


class _RangeReader(DataSourceReader):
    def __init__(self, path: str, ranges: list[tuple[str, int, int]], most: int):
        self.path, self.ranges, self.most = path, ranges, most

    def partitions(self) -> list[Range]:
        return [Range(name, start, start + n) for name, start, n in self.ranges]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """The bytes of the range that the file has; a range over the bound is refused before it is read."""
        system, inner = opened(self.path)
        if partition.end - partition.start > self.most:
            raise ValueError(f"a range of {partition.end - partition.start} bytes of {partition.path} exceeds {self.most}")
        with system.open_input_file(f"{inner.rstrip('/')}/{partition.path}") as f:
            size = f.size()
            f.seek(min(partition.start, size))
            data = f.read(max(0, min(partition.end, size) - partition.start))
        return _batches(iter([(partition.path, partition.start, size, data)]), "file string, start long, size long, content binary")


class Ranges(DataSource):
    """Options: path (a folder), ranges (JSON: a list of [file, start, length]), most (bytes of one)."""

    @classmethod
    def name(cls) -> str:
        return "corpus_ranges"

    def schema(self) -> str:
        return "file string, start long, size long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _RangeReader(self.options["path"], [tuple(r) for r in json.loads(self.options["ranges"])], int(self.options.get("most", 1 << 26)))


SOURCES = (Feeds, Listing, Ranges)


def register(spark: SparkSession, *more: type[DataSource]) -> list[str]:
    """Make the sources, and others of a user's own, known to a session; gives their names."""
    for source in (*SOURCES, *more):
        spark.dataSource.register(source)
    return [s.name() for s in (*SOURCES, *more)]


def declared(names: list[str], *more: type[DataSource]) -> None:
    """Whether the sources that settings name are those there are; a difference is an error."""
    there = {s.name() for s in (*SOURCES, *more)}
    if there != set(names):
        raise ValueError(f"sources without settings: {sorted(there - set(names))}; settings without a source: {sorted(set(names) - there)}")


def _feeds(s: SparkSession, d: str) -> str:
    """Pages as feeds, a line each: an article with an entity in its link and title, audio, a paper, a video
    of another kind of feed, and an entry without any id; every ninth feed is broken."""
    n = F.col("page_id").cast("string")
    rss = F.concat(
        F.lit('<rss version="2.0"><channel><title>t</title><item><title>A &amp;amp; B '), n, F.lit("</title><guid isPermaLink='false'>g"), n, F.lit("</guid><link>https://x.org/"), n, F.lit("?a=1&amp;b=2</link></item>"),
        F.lit("<item><title><![CDATA[<b> & c]]></title><link>https://x.org/p</link><guid>a"), n, F.lit('</guid><enclosure url="https://x.org/'), n, F.lit('.mp3?a=1&amp;c=2" type="audio/mpeg"/></item>'),
        F.lit("<item><link>https://arxiv.org/abs/"), n, F.lit("</link></item><item><title>none</title></item></channel></rss>"),
    )
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>urn:'), n, F.lit('</id><title>T</title><link rel="self" href="https://x.org/s"/><link href="https://youtu.be/'), n, F.lit('"/></entry></feed>'))
    line = F.when(F.col("page_id") % 9 == 0, F.substring(rss, 1, 80)).when(F.col("page_id") % 2 == 0, atom).otherwise(rss)
    path = shared_path(s, "feeds")
    load(s, d, "pages").select(line.alias("value")).write.text(path)
    return path


def feed_source_items(s: SparkSession, d: str) -> DataFrame:
    register(s)
    return s.read.format("corpus_feed").option("range", 4096).load(_feeds(s, d)).select("position", "item_id", "title", "url", "content_type")


def feed_stream_items(s: SparkSession, d: str) -> DataFrame:
    """The same as a stream, run until it has read all."""
    register(s)
    path = _feeds(s, d)
    out = shared_path(s, "items")
    query = s.readStream.format("corpus_feed").option("range", 4096).load(path).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return s.read.schema(ITEM).parquet(out).select("position", "item_id", "title", "url", "content_type")


def listing_source_items(s: SparkSession, d: str) -> DataFrame:
    """Documents' sources as folders of one text file each: what the listing says of them."""
    register(s)
    path = shared_path(s, "listing")
    rows = load(s, d, "documents").select("source", F.col("doc_id").cast("string").alias("value"))
    rows.repartition("source").write.partitionBy("source").text(path)
    found = s.read.format("corpus_listing").load(path)
    size = F.split("item_id", r"\|")[1].cast("long")
    return found.groupBy(F.regexp_extract("source", "source=(.*)", 1).alias("source"), "content_type").agg(F.sum(size).alias("bytes"))


QUERIES = {f.__name__: f for f in (feed_source_items, feed_stream_items, listing_source_items)}

_ITEMS = """
WITH p AS (SELECT page_id AS n FROM pages WHERE page_id % 9 <> 0)
SELECT 0 AS position, 'g' || n AS item_id, 'A &amp; B ' || n AS title, 'https://x.org/' || n || '?a=1&b=2' AS url, 'article' AS content_type FROM p WHERE n % 2 <> 0
UNION ALL SELECT 1, 'a' || n, '<b> & c', 'https://x.org/' || n || '.mp3?a=1&c=2', 'audio' FROM p WHERE n % 2 <> 0
UNION ALL SELECT 2, 'https://arxiv.org/abs/' || n, '', 'https://arxiv.org/abs/' || n, 'paper' FROM p WHERE n % 2 <> 0
UNION ALL SELECT 0, 'urn:' || n, 'T', 'https://youtu.be/' || n, 'video' FROM p WHERE n % 2 = 0"""
ORACLES = {
    "feed_source_items": _ITEMS,
    "feed_stream_items": _ITEMS,
    "listing_source_items": "SELECT source, 'document' AS content_type, sum(length(doc_id::VARCHAR) + 1)::BIGINT AS bytes FROM documents GROUP BY source",
}
