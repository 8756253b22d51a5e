"""Reading order against generated layouts, captions, lines, broken boxes."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.sources import layout as L
from marlstone.sources.feeds import layout_boxes, layout_pages

BOX = "k long, page int, kind string, place int, left double, top double, width double, height double, text string"


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10_000))
def test_generated_pages_are_read_as_they_were_laid_out(seed):
    """Stretches one below the other, each of one to three columns; in a column lines of one to three words,
    lines of neighbouring columns at heights of their own, at times two stretches within a column."""
    rng = random.Random(seed)
    want = []

    def column(left, width, top, lines):
        for _ in range(lines):
            n = rng.randint(1, 3)
            for k in range(n):
                want.append((left + k * width / n, top, left + (k + 1) * width / n - 2, top + 8))
            top += 8 + rng.randint(3, 9)
        return top

    top = 0
    for stretch in range(rng.randint(1, 4)):
        n = rng.choice([1, 1, 2, 2, 3])
        if n == 1:
            want.append((0.0, top, 400.0, top + 8))
            top += 8 + rng.randint(4, 20)
            continue
        width = (400 - 20 * (n - 1)) / n
        top = max(column(c * (width + 20), width, top, rng.randint(2, 5)) for c in range(n)) + rng.randint(4, 20)
        want.append((0.0, top, 400.0, top + 8))  # a line over the whole width ends the columns
        top += 20
    mixed = [(*b, i) for i, b in enumerate(want)]
    rng.shuffle(mixed)
    assert [i for i, _ in L.reading(mixed)] == list(range(len(want)))


def test_reading_order_of_odd_pages():
    assert L.reading([]) == []
    assert [i for i, _ in L.reading([(0, 0, 10, 10, 7)])] == [7]
    same = [(0, 0, 10, 10, 2), (0, 0, 10, 10, 1)]
    assert [i for i, _ in L.reading(same)] == [1, 2]
    assert sorted(i for i, _ in L.reading([(0, 0, 0, 0, 0), (5, 5, 5, 5, 1), (0, 0, 400, 400, 2)])) == [0, 1, 2]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, 1, "text", 0, 220.0, 100.0, 90.0, 10.0, "right one"), (1, 1, "text", 1, 0.0, 100.0, 90.0, 10.0, "left one"), (1, 1, "text", 2, 220.0, 115.0, 90.0, 10.0, "right two"), (1, 1, "text", 3, 0.0, 115.0, 40.0, 10.0, "left"),
        (1, 1, "text", 4, 50.0, 117.0, 40.0, 10.0, "two"), (1, 1, "text", 5, 0.0, 80.0, 310.0, 12.0, "Title"), (1, 1, "text", 6, None, 1.0, 1.0, 1.0, "nowhere"),
        (1, 2, "image", 0, 0.0, 0.0, 100.0, 50.0, ""), (1, 2, "text", 1, 0.0, 55.0, 100.0, 10.0, "Fig. 3: a pic-"), (1, 2, "text", 2, 0.0, 67.0, 100.0, 10.0, "ture ( small )"), (1, 2, "text", 3, 0.0, 120.0, 100.0, 10.0, "body"),
        (1, 2, "image", 4, 200.0, 300.0, 100.0, 50.0, ""), (1, 2, "text", 5, 200.0, 280.0, 100.0, 10.0, "Table 1 over it"), (1, 2, "image", 6, 400.0, 0.0, 50.0, 50.0, ""), (2, 1, "image", 0, 0.0, 0.0, 9.0, 9.0, ""),
    ]
    return spark.createDataFrame(rows, BOX)


def test_columns_and_lines(pages):
    got = L.ordered(pages, "k")
    assert [r.text for r in got.filter("k = 1 and page = 1").orderBy("number").collect()] == ["Title", "left one", "left", "two", "right one", "right two", "nowhere"]
    lines = [r.text for r in L.lines(got, "k").filter("page = 1").orderBy("first").collect()]
    assert lines[:5] == ["Title", "left one", "left two", "right one", "right two"]


def test_captions_go_to_the_nearest_picture(pages):
    got = sorted((r.picture, r.caption, r.label, r.text) for r in L.captions(L.ordered(pages, "k"), "k").collect())
    assert got == [(0, 1, "3", "Fig. 3: a picture (small)"), (4, 5, "1", "Table 1 over it")]


def test_no_pages(pages):
    assert L.ordered(pages.limit(0), "k").count() == 0 and L.captions(L.ordered(pages.limit(0), "k"), "k").count() == 0


def test_many_pages_go_to_python_at_once_and_ties_follow_places(spark):
    rows = [(k, p, "text", n, 0.0, 10.0, 5.0, 5.0, str(n)) for k in range(3) for p in range(4) for n in (2, 1, 0)]
    rows.append((0, 0, "text", 3, None, 0.0, 1.0, 1.0, "nowhere"))
    got = L.ordered(spark.createDataFrame(rows, BOX).repartition(3, "place"), "k")
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()  # a call for each page took most of the time
    found = got.collect()
    assert len(found) == len(rows) and all(r["number"] == r["place"] and r["column"] == "" for r in found)


@pytest.mark.parametrize("query", [L.pdf_captions, L.pdf_lines, L.pdf_reading_order], ids=lambda q: q.__name__)
def test_a_page_stays_one_row_and_is_read_once(spark, query):
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "_read(_boxes_of(" in plan  # boxes of their own were grouped and sorted over and over
    assert plan.count("RepartitionByExpression") == 1 and "collect_list(struct(kind" not in plan and len(plan) < 20_000


def test_odd_pages_of_layout_xml(spark):
    xml = (
        'junk</page><PAGE number="3"><text top="1" left="2" width="3" height="4"><b>a  &amp;lt;</b> &#x42;&#0; </text><text height="8" data-left="1" LEFT = \'-5.5\' top="12px" width="x">c</text>'
        '<texts top="1"><image top="1" left="2" width="3" height="4"/><TEXT left="1"></TEXT><text top="9"></page><page number="4"></Page><page number="5"><text top="1">unclosed'
    )
    rows = spark.createDataFrame([(1, xml), (2, None), (3, "")], "k long, x string")
    got = [tuple(r) for r in layout_boxes(rows, "k", "x").orderBy("place").collect()]
    assert got == [
        (1, 3, "text", 0, 2.0, 1.0, 3.0, 4.0, "a &lt; B&#0;"), (1, 3, "text", 1, 1.0, 12.0, None, 8.0, "c"), (1, 3, "image", 2, 2.0, 1.0, 3.0, 4.0, ""), (1, 3, "text", 3, 1.0, None, None, None, ""),
    ]
    assert [(r.k, r.page, len(r.boxes)) for r in layout_pages(rows, "k", "x").orderBy("page").collect()] == [(1, 3, 4), (1, 4, 0)]
