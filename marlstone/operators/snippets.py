"""What is shown of a text around a query's hits: the best window of twelve runs of three characters.

Every hit opens a window, and so does the sentence it stands in. A window counts by its hits, one that begins
a sentence by some more; the best one is shown, a window opened by a hit with its hits in its middle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.session import load

#: Runs of a window, and what a first hit, a text's and a sentence's beginning count.
RUNS, HIT, TEXT_BEGINS, SENTENCE_BEGINS = 12, 1000, 120, 100


def _simple(text: str) -> str:
    """Lower case, character by character, so that places stay as they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def _sentences(text: str, runs: int) -> list[int]:
    """Where runs begin that begin the text, or follow a full stop or colon and white space."""
    out = [0]
    for k in range(1, runs):
        if text[k - 1] in " \t\r\n":
            before = text[:k].rstrip(" \t\r\n")[-1:]
            if before in (".", ":") and before:
                out.append(k)
    return out


def snippet(text: str, query: str, runs: int = RUNS) -> str | None:
    """The best window with its hits marked, and dots where the text goes on; null without a hit or for a
    query of under three characters."""
    low, asked = _simple(text), _simple(query)
    n, long = len(text) - 2, len(asked) - 2
    if long < 1:
        return None
    hits, at = [], low.find(asked)
    while at >= 0:
        hits.append(at)
        at = low.find(asked, at + 1)
    if not hits:
        return None
    starts = _sentences(text, n) if n > runs else [0]
    best, begin = 0, 0
    for hit in hits:
        for opens in (hit, max(s for s in starts if s <= hit)):
            held = [h for h in hits if opens <= h < opens + runs]
            if not held or (opens < hit and n <= runs):
                continue
            value = HIT + len(held) - 1
            if opens == hit and value > best:
                middle = held[0] - int((runs - (held[-1] + long - held[0])) / 2)
                best, begin = value, max(0, min(middle, n - runs))
            elif opens < hit:
                value += SENTENCE_BEGINS if opens else TEXT_BEGINS
                if value > best:
                    best, begin = value, opens
    end = min(begin + runs, n)
    marks: list[list[int]] = []
    for h in hits:
        if marks and h <= marks[-1][1]:
            marks[-1][1] = h + long - 1
        else:
            marks.append([h, h + long - 1])
    out, at, stop = [], begin, end + 2
    for a, b in marks:
        if not begin <= a < end:  # what begins before the window is not marked in it
            continue
        b = min(b + 3, stop)
        out += [text[at:a], "<mark>", text[a:b], "</mark>"]
        at = b
    return ("…" if begin else "") + "".join(out) + text[at:stop] + ("…" if end < n else "")


def snippets(rows: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """key and snippet of the rows whose text holds the query in any case; others don't reach Python."""
    kind = rows.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"], "snippet": [snippet(t, query) for t in batch["t"]]})

    found = rows.filter(F.contains(T.fold(F.col(text)), F.lit(query.lower().replace("ς", "σ"))))
    return found.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, snippet string").filter("snippet is not null").withColumnRenamed("k", key)


def token_snippets(s: SparkSession, d: str) -> DataFrame:
    return snippets(load(s, d, "documents"), "doc_id", "text", "license")


QUERIES = {"token_snippets": token_snippets}
ORACLES: dict[str, str] = {}
