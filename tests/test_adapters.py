"""The data sources: ranges of bytes, feeds of any kind, streams that stop and go on."""

import json

import pytest
from pyspark.sql import functions as F

from marlstone.sources import adapters as A
from marlstone.sources import feeds

RSS = "<rss><channel><item><title>T{0} &lt;b&gt; &#x1F642;&#233;</title><guid>g{0}</guid><link>https://x.org/?a={0}&amp;b=2</link></item></channel></rss>"


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    assert A.register(spark) == ["corpus_feed", "corpus_listing", "corpus_ranges"]


@pytest.mark.parametrize("size", [61, 150, 1 << 20])
def test_every_line_is_read_once_whatever_the_ranges(spark, tmp_path, size):
    text = "\n".join(RSS.format(k) + " " * (k % 5) for k in range(30)) + "\n\nbroken <\n" + RSS.format(99)
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.txt").write_text("")
    (tmp_path / "_hidden").write_text(RSS.format(500))
    got = spark.read.format("corpus_feed").option("range", size).load(str(tmp_path))
    assert got.rdd.getNumPartitions() >= len(text.encode()) // size
    rows = got.collect()
    assert sorted(r.item_id for r in rows) == sorted(f"g{k}" for k in [*range(30), 99])
    assert all(r.url == f"https://x.org/?a={r.item_id[1:]}&b=2" and r.title == f"T{r.item_id[1:]} <b> 🙂é" for r in rows)


def test_both_readers_of_feeds_agree(spark, tmp_path):
    lines = [
        RSS.format(1), '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>u</id><link href="https://youtu.be/q"/></entry></feed>',
        "<rss><item><title><![CDATA[a &amp; <i>]]></title><link>https://x.org/p</link><enclosure url='https://x.org/s.MP3?x=1&amp;y=2' type=''/></item></rss>", "<rss><item><title>none</title></item></rss>",
        "<rss><item><guid>only</guid></item></rss>", "<feed><entry><link rel='enclosure' type='audio/x' href='https://x.org/s'/><link href='https://x.org/e'/></entry></feed>",
    ]
    (tmp_path / "f.txt").write_text("\n".join(lines))
    got = sorted(map(tuple, spark.read.format("corpus_feed").load(str(tmp_path)).drop("source").collect()))
    table = spark.createDataFrame(list(enumerate(lines)), "k long, xml string")
    want = sorted(map(tuple, feeds.feed_items(table, "k", "xml").drop("k").collect()))
    assert got == want and len(got) == 5 and ("a &amp; <i>" in {r[2] for r in got})


def test_entities_are_read_once(spark):
    for text, want in (("&amp;lt;", "&lt;"), ("a&b &unknown; &#65;&#x1f642;&quot;", 'a&b &unknown; A🙂"'), ("&#xD800;&#0;", "&#xD800;&#0;"), ("", ""), (None, None)):
        assert spark.createDataFrame([(text,)], "t string").select(feeds.unescaped(F.col("t"))).first()[0] == want


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def run():
        stream = spark.readStream.format("corpus_feed").option("range", 200).load(str(folder))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.item_id for r in spark.read.schema(A.ITEM).parquet(out).collect())

    (folder / "1.txt").write_text(RSS.format(1) + "\n" + RSS.format(2) + "\n" + RSS.format(3)[:40])
    assert run() == ["g1", "g2"]  # the last line isn't complete yet
    with (folder / "1.txt").open("a") as f:
        f.write(RSS.format(3)[40:] + "\n" + RSS.format(4) + "\n")
    assert run() == ["g1", "g2", "g3", "g4"]
    assert run() == ["g1", "g2", "g3", "g4"]
    (folder / "2.txt").write_text("".join(RSS.format(k) + "\n" for k in range(5, 25)))
    (folder / "3.txt").write_text(RSS.format(25) + "\n")
    assert run() == sorted(f"g{k}" for k in range(1, 26))


def test_listing_by_folders(spark, tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    for name in ("a.mp3", "sub/b.PDF", "sub/deep/c.md", "d.bin"):
        (tmp_path / name).write_text("x" * len(name))
    got = {r.title: (r.source, r.content_type, r.item_id.split("|")[1]) for r in spark.read.format("corpus_listing").load(str(tmp_path)).collect()}
    assert got == {"a.mp3": ("", "audio", "5"), "b.PDF": ("sub", "document", "9"), "c.md": ("sub/deep", "document", "13")}


def test_ranges_read_what_is_asked(spark, tmp_path):
    (tmp_path / "f").write_bytes(bytes(range(100)))
    ranges = [["f", 0, 4], ["f", 96, 10], ["f", 200, 5], ["f", 7, 0]]
    read = lambda r, **o: spark.read.format("corpus_ranges").options(path=str(tmp_path), ranges=json.dumps(r), **o).load()
    got = {(r.start, r.size): bytes(r.content) for r in read(ranges).collect()}
    assert got == {(0, 100): bytes(range(4)), (96, 100): bytes(range(96, 100)), (200, 100): b"", (7, 100): b""}
    with pytest.raises(Exception, match="exceeds 3"):
        read(ranges, most=3).collect()


def test_settings_name_all_sources():
    A.declared(["corpus_feed", "corpus_listing", "corpus_ranges"])
    with pytest.raises(ValueError, match="moon"):
        A.declared(["corpus_feed", "corpus_listing", "corpus_ranges", "moon"])
