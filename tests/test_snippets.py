"""Snippets against those of a full-text index of runs of three characters, where there is one here."""

import random
import sqlite3

import pytest

from marlstone.operators import snippets as S


def index():
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table t using fts5(body, tokenize='trigram')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index with runs of three characters here")
    return con


def test_snippets_equal_those_of_the_index():
    con, rng, n = index(), random.Random(7), 0
    words = ["license", "License", "a", "text.", "of", "this:", "thing", "lic", "ense", "licenselicense", "end.\n", "x  y", "é"]
    for k in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))
        con.execute("insert into t(rowid, body) values (?, ?)", (k + 1, text))
        for query in ("license", "ense", "of this", "lic"):
            got = con.execute("select snippet(t, 0, '<mark>', '</mark>', '…', 12) from t where t match ? and rowid = ?", (f'"{query}"', k + 1)).fetchone()
            assert S.snippet(text, query) == (got[0] if got else None), (text, query)
            n += got is not None
    assert n > 300


def test_snippets_of_odd_texts(spark):
    assert S.snippet("", "abc") is None and S.snippet("abc", "ab") is None and S.snippet("xAbCx", "abc") == "x<mark>AbC</mark>x"
    rows = spark.createDataFrame([(1, None), (2, "No hit"), (3, "İ the License")], "k long, t string")
    assert [tuple(r) for r in S.snippets(rows, "k", "t", "license").collect()] == [(3, "İ the <mark>License</mark>")]
