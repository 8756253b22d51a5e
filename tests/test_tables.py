"""Table functions in SQL text give the rows of the DataFrame functions."""

import pytest

from marlstone.session import load
from marlstone.sources import html as H
from marlstone.sources import scholarly, tables

SF = "/root/testdata/sf0.001"


def test_rows_are_those_of_the_functions(spark):
    pages = H._with_table(spark, SF)
    tables.register_tables(spark)
    for name, made in (("page_blocks", H.blocks), ("page_cells", H.cells)):
        got = spark.sql(f"SELECT p.page_id, x.* FROM {{pages}} p, LATERAL {name}(p.html) x", pages=pages)
        want = made(pages)
        assert got.columns == want.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 0
    links = spark.sql("SELECT p.page_id, x.* FROM {pages} p, LATERAL paper_links(p.html, p.url) x", pages=load(spark, SF, "pages"))
    want = scholarly.part(scholarly.papers(load(spark, SF, "pages"), url="url"), "links")
    assert sorted(map(repr, links.collect())) == sorted(map(repr, want.collect()))


def test_nulls_and_wrong_arguments(spark):
    tables.register_tables(spark)
    assert spark.sql("SELECT * FROM page_blocks(NULL)").collect() == []
    assert [tuple(r) for r in spark.sql("SELECT kind, text FROM page_blocks('<article><p>x</article>')").collect()] == [("paragraph", "x")]
    with pytest.raises(Exception, match="a text is needed"):
        spark.sql("SELECT * FROM page_blocks(1)").collect()
