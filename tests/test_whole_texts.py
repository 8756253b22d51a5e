"""Queries over whole texts, where a prefix would give less."""

import hashlib

from marlstone.functions import text as T
from marlstone.operators import textops


def tables(spark, tmp_path, **rows):
    columns = {"documents": "doc_id long, text string", "benchmark": "item_id long, text string"}
    for name, values in rows.items():
        spark.createDataFrame(values, columns[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_quantities_after_character_1000(spark, tmp_path):
    d = tables(spark, tmp_path, documents=[(1, "word " * 400 + "12kg"), (2, "3% " + "x" * 33000 + " $4.50"), (3, "none"), (4, None)])
    got = {r.doc_id: r.quantities for r in textops.quantity_tokens(spark, d).collect()}
    assert got == {1: "||12|kg", 2: "||3|%;|$|4.50|"}


def test_halfwidth_after_character_200(spark, tmp_path):
    d = tables(spark, tmp_path, documents=[(1, "a" * 300), (2, "a" * 300 + "B"), (3, "a" * 300 + T.FULL_WIDTH[-1])])
    got = {r.doc_id: r.digest for r in textops.halfwidth_whole(spark, d).collect()}
    want = {1: "a" * 300, 2: "a" * 300 + "B", 3: "a" * 300 + T.HALF_WIDTH[-1]}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


def test_anchor_is_the_whole_item_found_once(spark, tmp_path):
    head = "h" * 20 + "-" * 20
    d = tables(spark, tmp_path, documents=[(1, f"{head} a, {head} b"), (2, f"{head} c"), (3, "banana"), (4, None)], benchmark=[(1, f"{head} b"), (2, "ana"), (3, "nan"), (4, ""), (5, None)])
    assert {tuple(r) for r in textops.quote_anchor_whole(spark, d).collect()} == {(1, 1, 45), (3, 3, 3)}
    assert (3, 2) not in {(r.doc_id, r.item_id) for r in textops.quote_anchor(spark, d).collect()}  # overlaps count


def test_audio_links_and_json_kinds_of_every_sort(spark):
    """Both queries once left sorts out, and pages that name their audio."""
    from marlstone.operators import kernel as K

    d = "/root/testdata/sf0.001"
    links = K.QUERIES["fn_audio_link"](spark, d).collect()
    assert len(links) == spark.read.parquet(f"{d}/pages.parquet").count()
    assert {"".join(c for c in r["value"] if not c.isdigit()) for r in links} == {"https://a/", "/p.ma?x=", "/stream", "/e.wav", "/x.mp", ""}
    kinds = {r["value"] for r in K.QUERIES["fn_json_kind"](spark, d).select("value").distinct().collect()}
    assert kinds == {"integer", "text", "array", "none", "real", "null", "true", "false", "object"}
    assert not any("WHERE NOT" in K.ORACLES[q] for q in ("fn_audio_link", "fn_json_kind"))


def test_words_of_a_screen_are_looked_at_closely_where_they_may_be_noise(spark):
    import re

    from pyspark.sql import functions as F

    from marlstone.sources import subtitles as S

    edges = "-=_.,;:!?()[]{}<>|/\\'\"~`*+，。、：；！？（）【】《》"
    words = "word 派克财经x x派克财经 PAKEN.tv xpakenx KEN paKen USDT/x Macd(12) diffs 'change' MA(5) xMA(5) (ma(3 bilibi1 BIL1B liiil illllb1x 12345 1234 12,345. 2.699K 9m a1. O22.98 中12345 12345中 ... 、。 《a》 -b- ١٢٣٤٥ 1a ǅb bbbbb".split()

    def noise(w):
        t = w.strip(edges)
        low = t.lower()
        price = not re.search("[一-鿿]", t) and (re.search(r"^[0-9][0-9.,:]{4,}$", t) or re.search(r"^[0-9][0-9.,]*[KkMm]$", t))
        return bool(not t or "paken" in low or t.startswith("派克财经") or ("b" in low and re.search("^[bil1]{5,}$", low)) or low.startswith("ma(") or any(x in low for x in ("usdt", "macd", "diff", "change")) or re.search(r"^[a-z][0-9][0-9.,]+$", low) or price)

    rows = spark.createDataFrame([(" ".join(words),), (None,), ("",), *((w,) for w in words)], "t string")
    got = [r.x for r in rows.select(S.clean_ocr(F.col("t")).alias("x")).collect()]
    kept = [w for w in words if not noise(w)]
    assert got == [" ".join(kept), None, "", *("" if noise(w) else w for w in words)] and 10 < len(kept) < len(words) - 10
    assert [r.x for r in rows.select(F.lower("t").rlike(S._MAYBE).alias("x")).collect()][3:] != [True] * len(words)
