"""Quotations and strings in texts against plain containment; languages by profiles."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import languages as L
from marlstone.operators import linkage
from marlstone.operators import textops as X
from marlstone.streaming import state


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = "the cat sat on a mat, and é 日本 then sat again a a".split()
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) if k % 17 else None) for k in range(120)]
    docs.append((3, docs[5][1]))
    quotes = ["", None, "a", "cat sat", "at on", "sat on a mat,", "the cat sat on a mat, and", "日本 then", "a a", "zzz"] + [" ".join((t or "").split()[2:9]) for _, t in docs[:30]]
    return docs, [*enumerate(quotes)]


def test_holding_equals_containment(spark, texts, monkeypatch):
    docs, quotes = texts
    d, q = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(quotes, "item long, quote string")
    want = sorted((i, j) for i, t in docs for j, s in quotes if s and t and s in t)
    for chars in (X.SCAN_CHARS, 12):  # in one block, and in many
        monkeypatch.setattr(X, "SCAN_CHARS", chars)
        assert sorted((r.id, r.item) for r in X.holding(d, q, "text", "quote", "id", "item").collect()) == want
    assert X.holding(d.limit(0), q, "text", "quote", "id", "item").count() == X.holding(d, q.limit(0), "text", "quote", "id", "item").count() == 0


def test_no_join_carries_a_text_but_the_last(spark, texts):
    d, q = spark.createDataFrame(texts[0], "id long, text string"), spark.createDataFrame(texts[1], "item long, quote string")
    plan = X.holding(d, q, "text", "quote", "id", "item")._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in X.holding(d, q, "text", "quote", "id", "item")._jdf.queryExecution().executedPlan().toString()


def test_slots_go_to_the_first_holders(spark):
    rows = spark.createDataFrame([("a", k % 5, k) for k in range(20)] + [("free", k, k) for k in range(3)] + [("none", 1, 1)], "r string, holder long, at long")
    caps = spark.createDataFrame([("a", 2), ("none", 0)], "r string, cap int")
    got = {(r.r, r.holder): r.admitted for r in state.admitted(rows, "r", ["at"], caps).collect()}
    assert got == {**{("a", k): k < 2 for k in range(5)}, **{("free", k): True for k in range(3)}, ("none", 1): False}
    assert state.admitted(rows, "r", ["at"], caps.limit(0)).filter("not admitted").count() == 0


def test_partners_are_given_once(spark):
    side = "doc long, id long, place long, caption string, label string"
    left = spark.createDataFrame([(1, 1, 1, "Figure 1: a long caption", None), (1, 2, 2, "a long caption of a figure", None), (1, 3, 3, "Fig. 7 same words here", None), (1, 4, 4, "Figure 7 same words here", None), (1, 5, 5, None, None), (1, 6, 6, "FIGURE 1: A LONG CAPTION", "x"), (2, 7, 1, "Table 2. other", None)], side)
    right = spark.createDataFrame([(1, 11, 1, "Figure 1:  a long caption", None), (1, 12, 2, "a long caption of a figure.", None), (2, 13, 1, "tab 2: quite different", None), (1, 14, 4, "Figure 7 something", None)], side)
    got = {r.id: (r.match, r.state, r.method) for r in linkage.linked(left, right).collect()}
    assert got[1] == (11, "matched", "caption") and got[6] == (None, "ambiguous", "caption")
    assert got[2] == (12, "matched", "contained") and got[3][1] == got[4][1] == "ambiguous" and got[5] == (None, "unmatched", None) and got[7] == (13, "matched", "label")


def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.detected_language(spark, "/root/testdata/sf0.01")
    assert got.count() == docs.count()
    right = got.join(docs.select("doc_id", F.col("lang").alias("true"), "text"), "doc_id").filter(L.held_out("doc_id") & (F.length("text") > 200))
    n, hits = right.agg(F.count("*"), F.sum((F.col("lang") == F.col("true")).cast("int"))).first()
    assert n > 100 and hits / n > 0.95
    few = spark.createDataFrame([(1, "short"), (2, None), (3, "12345 " * 20)], "doc_id long, text string")
    assert {r.lang for r in L.detected(few, "doc_id", "text", L.profiles(docs, "lang", "text")).collect()} == {"unknown"}


def test_holding_within_a_group_meets_no_other_group(spark, texts):
    docs, quotes = texts
    d = spark.createDataFrame([(i, i % 3, t) for i, t in dict(docs).items()], "id long, doc long, text string")
    q = spark.createDataFrame([(j, j % 3, s) for j, s in quotes], "item long, doc long, quote string")
    want = sorted((i, j) for i, t in dict(docs).items() for j, s in quotes if s and t and s in t and i % 3 == j % 3)
    found = X.holding(d, q, "text", "quote", "id", "item", "doc")
    assert sorted((r.id, r.item) for r in found.collect()) == want != [] and found.columns == ["id", "doc", "text", "item", "quote"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_in" in plan and all("_in" in line for line in plan.splitlines() if "Join" in line and "_g#" in line)


def test_runs_equal_a_plain_count_and_go_on_summed(spark, monkeypatch):
    """Counted whole by language, and each text's in one task, summed before they leave it."""
    import re
    from collections import Counter

    docs = [(1, "en", "The the THE, cat 42 x"), (2, "en", None), (3, "fr", "Été, é日本 🙂 ß"), (4, None, "a_b"), (5, "fr", ""), (6, "en", "the " * 50)]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string").coalesce(1)
    want = Counter()
    for _, lang, t in docs:
        for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
            want.update((lang, L.run_of(f" {w} "[k : k + 3])) for k in range(len(w)))
    for chunk in (L.CHUNK, 8):
        monkeypatch.setattr(L, "CHUNK", chunk)
        assert {(r.lang, r.run): r.n for r in L.runs(df, "lang", "text").collect()} == want
    assert "Generate" not in L.runs(df, "lang", "text")._jdf.queryExecution().toString()
