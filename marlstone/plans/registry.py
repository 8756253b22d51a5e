"""All queries of the library but those of the training-data subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.operators import analytics, ask, budgets, graph, joins, kernel, languages, linkage, maintenance, packing, projection, relational, search, snippets, study, textops, validity
from marlstone.sources import adapters, feeds, html, layout, scholarly, subtitles, tables
from marlstone.streaming import state, ticks, windows, work

MODULES = (search, snippets, relational, analytics, graph, projection, joins, linkage, kernel, languages, maintenance, packing, budgets, study, ask, textops, validity, subtitles, html, scholarly, tables, feeds, adapters, layout, windows, state, ticks, work)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
