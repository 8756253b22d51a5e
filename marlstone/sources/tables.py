"""Readers of pages and subtitles as table functions for SQL: each gives the rows of one text, beside the row
it came from (`FROM pages p, LATERAL page_blocks(p.html) b`). They are the readers of the DataFrame functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from marlstone.session import load
from marlstone.sources import html as H
from marlstone.sources import scholarly


def _analyzed(schema: str, *arguments: AnalyzeArgument) -> AnalyzeResult:
    """The rows' columns; an argument that is no text is an error before anything runs."""
    for a in arguments:
        if a.dataType is not None and a.dataType.typeName() not in ("string", "void"):
            raise ValueError(f"a text is needed, not {a.dataType.simpleString()}")
    kinds = {"int": IntegerType(), "string": StringType()}  # no session is here to read DDL
    return AnalyzeResult(StructType([StructField(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))]))


class PageBlocks:
    """block, kind, parent, level, language and text of a page's blocks; of a null page none."""

    @staticmethod
    def analyze(html: AnalyzeArgument) -> AnalyzeResult:
        return _analyzed(H.BLOCK.split(", ", 1)[1], html)

    def eval(self, html: str) -> Iterator[tuple]:
        for number, row in enumerate(H._parsed(html or "")[1].rows):
            yield number, *row


class PageCells:
    """block, row, col, rowspan, colspan, role and text of the cells of a page's tables."""

    @staticmethod
    def analyze(html: AnalyzeArgument) -> AnalyzeResult:
        return _analyzed(H.CELL.split(", ", 1)[1], html)

    def eval(self, html: str) -> Iterator[tuple]:
        yield from H._parsed(html or "")[1].cells


class PaperLinks:
    """block, kind, target and label of a scholarly page's links; relative ones are of the page's address."""

    @staticmethod
    def analyze(html: AnalyzeArgument, url: AnalyzeArgument) -> AnalyzeResult:
        return _analyzed("block int, kind string, target string, label string", html, url)

    def eval(self, html: str, url: str) -> Iterator[tuple]:
        paper = scholarly._Paper(html or "", url or "")
        paper.walk()
        yield from paper.links()


FUNCTIONS = {"page_blocks": PageBlocks, "page_cells": PageCells, "paper_links": PaperLinks}


def register_tables(spark: SparkSession) -> list[str]:
    """Make the table functions known to a session's SQL; gives their names."""
    for name, made in FUNCTIONS.items():
        spark.udtf.register(name, udtf(made))
    return [*FUNCTIONS]


def lateral_page_blocks(s: SparkSession, d: str) -> DataFrame:
    """Pages' blocks by kind, in SQL text."""
    register_tables(s)
    return s.sql("SELECT p.page_id, count_if(b.kind = 'heading') AS headings, count_if(b.kind <> 'heading' AND b.block IS NULL) AS without FROM {pages} p, LATERAL page_blocks(p.html) b GROUP BY p.page_id", pages=load(s, d, "pages"))


def lateral_page_links(s: SparkSession, d: str) -> DataFrame:
    """Pages' links with their addresses, in SQL text."""
    register_tables(s)
    return s.sql("SELECT p.page_id, l.kind, l.target, count(*) AS n FROM {pages} p, LATERAL paper_links(p.html, p.url) l GROUP BY ALL", pages=load(s, d, "pages"))


QUERIES = {f.__name__: f for f in (lateral_page_blocks, lateral_page_links)}

ORACLES = {
    "lateral_page_blocks": "SELECT page_id, len(regexp_extract_all(CASE WHEN contains(html, '<article>') THEN regexp_extract(html, '<article>((?:.|\\n)*)</article>', 1) ELSE '' END, '<h[1-6]>([^<]*)</h[1-6]>', 1))::BIGINT AS headings, 0::BIGINT AS without FROM pages",
    "lateral_page_links": """
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1)) AS h FROM pages)
SELECT page_id, CASE WHEN starts_with(h, '#') THEN 'internal' ELSE 'external' END AS kind, CASE WHEN starts_with(h, '/') THEN regexp_extract(url, '^(https?://[^/]+)', 1) || h ELSE h END AS target, count(*) AS n FROM l GROUP BY ALL""",
}
