"""Truth tables of the column functions: samples, and what is right for each."""

from collections.abc import Callable

import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import facts as X
from marlstone.functions import scalars as S
from marlstone.functions import text as T
from marlstone.sources import subtitles

_list = lambda a: F.array_join(a, "|")
_page = '<html>{}<a href="/x.mp3">x</a></html>'.format
_related = lambda c: _list(F.transform(S.norm_related(F.from_json(c, "array<struct<term:string,rel:string>>")), lambda x: F.concat_ws(":", x["term"], x["rel"])))
_tags = lambda c: F.split(F.nullif(c, F.lit("-")), " ")
_RULES = [{"exists": "input/*.srt", "when": "skip"}, {"if_flag": "fast", "when": "skip"}, {"exists": "input/*.ass"}, {"when": "skip"}]

#: name: (function of the samples' columns, samples and, last, what is right).
TRUTHS: dict[str, tuple[Callable[..., Column], list[tuple]]] = {
    "citation_text": (S.citation_text, [("## Heading one", "Heading one"), ("- a **bold** claim.", "a bold claim"), ("| a | b |\n|---|:---:|\n| c | d |", "a b c d"), ("1. First\n\n2) Second", "First Second"), ("(见 [E3] `code_x`)", "见 codex"), ("", "")]),
    "quote_text": (S.quote_text, [("a \n\t b", "a b"), ("été", "été"), ("  ", "")]),
    "match_text": (S.match_text, [("Ｆｕｌｌ　Ｗidth", "full width"), ("Straße", "strasse"), ("ﬁne  Print", "fine print")]),
    "body_text": (S.body_text, [("a  \r\nb\t\n\n", "a\nb"), ("é\rx", "é\nx"), ("\n\n", "")]),
    "primary_fields": (
        lambda t, z: F.concat_ws(";", *(lambda x: (x["term"], x["zh_name"], _list(x["aliases"])))(S.primary_fields(t, z))),
        [("量化 (Quantization)", "", "Quantization;量化;量化 (Quantization)"), ("Quantization（量化）", "", "Quantization;量化;Quantization(量化)"), ("Graph (GNN)", "图", "Graph;图;Graph (GNN)"), ("注意力", "", "注意力;;"), ("Attention", " 注意 ", "Attention;注意;")],
    ),
    "norm_related": (_related, [('[{"term":" A ","rel":"is_a"},{"term":"A","rel":"related"},{"term":"B","rel":"odd"},{"term":""}]', "A:is_a|B:related"), ("[]", "")]),
    "pairs": (
        lambda c: _list(F.transform(F.array_sort(F.map_entries(S.pairs(c))), lambda x: F.concat_ws("=", x["key"], x["value"]))),
        [("注意力（Attention）很重要。 注意力在此。", "Attention=注意力"), ("只有一次（Once）。", ""), ("```\n图（Graph）图\n``` 图（Graph）是图。", "Graph=图"), ("甲（Same）甲，乙（Same）乙", "Same=甲")],
    ),
    "zh_name": (lambda t, n, d: F.concat_ws("=", *(lambda x: (x["en"], x["zh"]))(S.zh_name(t, n, d))), [("Martingale", "鞅", "", "Martingale=鞅"), ("鞅(Martingale)", "", "", "Martingale=鞅"), ("Recency bias", "", "近因偏差,过分强调近期", "Recency bias=近因偏差"), ("Recency bias", "", "no comma", ""), ("", "x", "y", "")]),
    "looks_chinese": (lambda c: S.looks_chinese(c).cast("string"), [("你好 ab", "true"), ("你好 abc", "false"), ("abc", "false"), ("", "false")]),
    "native_ids": (
        lambda u, k: F.coalesce(S.native_id(u, k), F.lit("")),
        [("https://www.bilibili.com/video/BV1xx411c7mD?p=2", "bilibili", "BV1xx411c7mD"), ("https://youtu.be/dQw4w9WgXcQ", "youtube", "dQw4w9WgXcQ"), ("https://www.youtube.com/watch?v=dQw4w9WgXcQ&t=1", "youtube", "dQw4w9WgXcQ"), ("https://arxiv.org/abs/2301.00001v2", "arxiv", "2301.00001v2"), ("hep-th/9901001", "arxiv", "hep-th/9901001"), ("https://x.org/", "http_article", "")],
    ),
    "lineage_key": (
        lambda u, k, t: S.lineage_key(u, k, t),
        [("https://youtu.be/dQw4w9WgXcQ", "youtube", "video", "jobs_yt_dQw4w9WgXcQ"), ("https://x.org/a", "http_article", "document", "jobs_article_5be3d88a13"), ("https://x.org/a", "upload", "video", "jobs_video_5be3d88a13")],
    ),
    "lineage_of": (S.lineage_of, [("jobs_yt_dQw4w9WgXcQ_240131235959ab12", "jobs_yt_dQw4w9WgXcQ"), ("jobs_old", "jobs_old"), ("jobs_x_240131235959AB12", "jobs_x_240131235959AB12")]),
    "slugs": (lambda a, b: F.concat_ws(";", S.slug(a), S.folder_slug(b)), [(" my list ", "/data/My Files/", "my-list;My-Files"), ("12345", "x", "12345;x"), ("https://x.org/a", "a/b.c", "5be3d88a13;b-c")]),
    "part_id": (lambda j, k: S.part_id(j, k), [("job", "1", "pt_35445e23bff595ffe0d6"), ("job", "2", "pt_ecb80011162aedda8652")]),
    "official": (lambda u, o: S.official(u, F.nullif(o, F.lit(""))), [("https://www.csrc.gov.cn/x", "", "high"), ("https://sse.com.cn", "https://a.b", "high"), ("http://www.csrc.gov.cn", "", "low"), ("https://szse.cn/x", "http://a.b", "low"), ("https://notgov.cn", "", "low")]),
    "case_references": (lambda c: _list(S.case_references(c)), [("见（2021）京01民终123号和〔2020〕5号，（2021）京01民终123号", "〔2020〕5号|（2021）京01民终123号"), ("none", "")]),
    "note_version": (lambda f: F.concat_ws("/", *(lambda x: (x["provider"], x["model"], x["version"]))(S.note_version(f))), [("out/notes_smart_acme_big-1_20240131-235959.md", "acme/big-1/20240131-235959"), ("notes_smart_a_b_c_20240131-235959.md", ""), ("notes.md", "")]),
    "audio_link": (
        lambda h: F.coalesce(S.audio_link(h), F.lit("")),
        [(_page('<meta property="og:audio" content="https://a/b"><audio src="/c.mp3">'), "https://a/b"), (_page('<audio src="/cover.png"><source src="/c.m4a?x=1">'), "/c.m4a?x=1"), (_page('<audio src="/stream">'), "/stream"), (_page('<enclosure url="/e.wav"/>'), "/e.wav"), (_page(""), "/x.mp3"), ("<p>", "")],
    ),
    "redacted_text": (S.redacted_urls, [("see https://u:p@x.org/a?token=1&b=2. And (http://Y.org/?sig=3).", "see https://x.org/a?b=2. And (http://y.org/)."), ("nothing here", "nothing here"), ("https://x.org/?b=1", "https://x.org/?b=1")]),
    "redacted_url": (
        T.redacted_url,
        [("https://h/p?X-Amz-Signature=1&a=2", "https://h/p?a=2"), ("https://h/p?session_id=1;sessionToken=2&credential=3", "https://h/p"), ("https://h/p?my%5Ftoken=1&ok=2", "https://h/p?ok=2"), ("https://h/p?sid=1&aside=2", "https://h/p?aside=2"), ("https://h/p?expires=9&q=Authorization:x", "https://h/p"), ("HTTP://H:80/p?monkey=1", "http://h/p")],
    ),
    "retry_delay": (lambda k, a: F.coalesce(S.retry_delay(k, a.cast("int")).cast("string"), F.lit("none")), [("ai", "0", "30"), ("ai", "2", "120"), ("ai", "3", "none"), ("processing", "0", "0"), ("processing", "1", "none"), ("ai_rate_limit", "4", "1800"), ("input_missing", "0", "none"), ("odd", "0", "none")]),
    "backoff": (lambda a: S.backoff(a.cast("int"), 30, 3600).cast("bigint").cast("string"), [("1", "30"), ("2", "60"), ("7", "1920"), ("8", "3600"), ("90", "3600")]),
    "effective_timeout": (lambda b, p, s, c: S.effective_timeout(*(x.try_cast("int") for x in (b, p, s, c))).cast("string"), [("60", "30", "61", "", "60"), ("60", "30", "200", "", "120"), ("60", "30", "6000", "900", "900"), ("60", "", "6000", "", "60"), ("60", "30", "0", "", "60")]),
    "hash_band": (lambda a, b: S.hash_band(a.cast("bigint"), b.cast("bigint")), [("0", "63", "duplicate"), ("0", "127", "gray"), ("0", "1023", "gray"), ("0", "2047", "different"), ("-1", "-2", "duplicate")]),
    "scalar": (lambda c: F.concat_ws(":", *(lambda x: (x["kind"], x["value"]))(S.scalar(c))), [("12", "int:12"), ("-07", "int:-7"), ("1.5", "float:1.5"), ("1.5x", "string:1.5x"), ("", "string:")]),
    "lenient_time": (
        lambda c: F.coalesce(F.date_format(S.lenient_time(c), "yyyy-MM-dd HH:mm:ss"), F.lit("none")),
        [("2021", "2021-01-01 00:00:00"), ("2021-03", "2021-03-01 00:00:00"), ("2021-03-04", "2021-03-04 00:00:00"), ("2021-03-04T05:06:07", "2021-03-04 05:06:07"), ("2021-03-04T05:06:07+02:00", "2021-03-04 03:06:07"), ("2021-03-04 05:06Z", "2021-03-04 05:06:00"), ("2021-13-04", "none"), ("soon", "none")],
    ),
    "strict_time": (lambda c: F.coalesce(F.date_format(S.strict_time(c), "yyyy-MM-dd HH:mm:ss"), F.lit("none")), [("2021-03-04T05:06:07", "none"), ("2021-03-04T05:06:07z", "2021-03-04 05:06:07"), ("2021-03-04T23:06:07-01:00", "2021-03-05 00:06:07"), ("2021", "none")]),
    "written_date": (
        S.written_date,
        [("Published 2021-03-04 online", "2021-03-04"), ("2021-03", "2021-03"), ("1999", "1999"), ("Received March  4, 2021; accepted", "2021-03-04"), ("Mar 4, 2021", "2021-03-04"), ("March 2021", "2021-03"), ("Mar 2021", "2021-03"), ("4 March", ""), ("", "")],
    ),
    "json_kind": (lambda c: F.coalesce(S.json_kind(c, "$.a"), F.lit("none")), [('{"a":1}', "integer"), ('{"a":1.5}', "real"), ('{"a":"x"}', "text"), ('{"a":null}', "null"), ('{"a":true}', "true"), ('{"a":false}', "false"), ('{"a":[1]}', "array"), ('{"a":{"b":1}}', "object"), ('{"b":1}', "none"), ("broken", "none")]),
    "json_list": (lambda c: _list(S.json_list(c)), [('["a","b"]', "a|b"), ("broken", ""), ("[]", ""), ('{"a":1}', "")]),
    "canonical_json": (lambda a, b: S.canonical_json(z=a, b=F.nullif(b, F.lit("")), m=F.lit(1)), [('é"\\/', "x", '{"b":"x","m":1,"z":"é\\"\\\\/"}'), ("", "", '{"b":null,"m":1,"z":""}')]),
    "glob": (lambda p: F.concat_ws("", *(S.globbed(p, g).cast("int").cast("string") for g in ("input/*.srt", "in?ut/[ab]*", "[!i]*"))), [("input/a.srt", "110"), ("input/b/c.txt", "010"), ("xinput/a.srt", "001"), ("input.srt", "000")]),
    "rules": (lambda a, b, c: S.first_rule(_RULES, {"input/*.srt": a == "y", "input/*.ass": b == "y"}, {"fast": c == "y"}).cast("string"), [("y", "y", "n", "false"), ("n", "y", "y", "false"), ("n", "y", "n", "true"), ("n", "n", "n", "false")]),
    "tag_match": (
        lambda r, t, a, w, x: S.matches(_tags(r), _tags(t), _tags(a), _tags(w), _tags(x)).cast("string"),
        [("gpu", "big", "-", "gpu cn", "slow", "true"), ("gpu cn", "-", "-", "gpu", "-", "false"), ("-", "big slow", "-", "gpu", "slow", "false"), ("-", "-", "p q", "p", "-", "true"), ("-", "-", "p q", "p q", "-", "false"), ("-", "-", "p", "z", "-", "false")],
    ),
    "attestation": (lambda a, b, c: S.attestation(*(x.cast("int") for x in (a, b, c))), [("3", "3", "3", "strong"), ("5", "2", "3", "corroborated"), ("2", "2", "1", "supported"), ("0", "0", "0", "none"), ("1", "0", "1", "none")]),
    "progress": (lambda a, b: S.progress(a.cast("int"), b.cast("int")).cast("string"), [("1", "8", "12"), ("3", "8", "38"), ("0", "0", "0"), ("2", "3", "67")]),
    "short_definition": (S.short_definition, [("One. Two.", "One."), ("v1.5 is out", "v1.5 is out"), ("问？答。", "问？"), ("  ", ""), ("x" * 130, "x" * 120 + "…")]),
    "source_of": (
        S.source_of,
        [("https://www.bilibili.com/video/x", "bilibili"), ("BV1xx411c7mD", "bilibili"), ("https://youtu.be/x", "youtube"), ("https://arxiv.org/pdf/1.pdf", "arxiv"), ("https://x.org/a.PDF?x=1", "pdf"), ("https://x.org/a.mp3", "podcast"), ("file:///a", "local_file"), ("https://x.org", "http_article"), ("ftp://x", "other"), ("", "other")],
    ),
    "fact_quantities": (
        lambda c: _list(X.quantities(c)),
        [("-5% of $3,500.50 and 12 kg", "-5%|3500.50usd|12kg"), ("3 hours, 20 mins", "3h|20mins"), ("５ 3公里 7台", "3km|7device"), ("8 sheep or 9", "8unknown:sheep|9"), ("v1.2 x", ""), ("5 units −2", "5device|-2")],
    ),
    "fact_tokens": (
        lambda c: F.concat_ws(";", X.negations(c).cast("string"), _list(X.ranges(c)), _list(X.polarity(c)), _list(X.subjects(c))),
        [("It did not fail, growth is at least 3", "2;>=;fail|increase;"), ("between 3 and 4, less than 5", "0;<|between;;"), ("没有超过", "1;>;absent;"), ("Model A-1 and server: B2 passed", "0;;pass;a-1|b2"), ("x <= 3 and y > 4", "0;<=|>;;")],
    ),
    "conflicts": (
        lambda a, b: F.concat_ws(";", _list(X.conflicts(a, b)), _list(X.conflicts(a, b, True))),
        [("rose by 5% to 3 kg", "rose by 5% to 3 kg", ";"), ("5%", "5% and 6%", "quantity;"), ("7%", "5% and 6%", "quantity;quantity"), ("it is not so", "it is so", "negation;negation"), ("at most 3", "at least 3", "range;range"), ("model A", "model B", "subject;subject")],
    ),
    "clock": (lambda c: subtitles.clock(c.cast("double")), [("0", "[00:00]"), ("61.9", "[01:01]"), ("6000", "[100:00]")]),
    "definition_version": (lambda d, t, h: S.definition_version(d, t, F.lit(3), F.nullif(h, F.lit("")), F.lit("me")), [("d", "t", "", "cdv_9586e396360705e7e0175808287bfe3ea02165ef863c256d653fec51a01e4591")]),
}


@pytest.mark.parametrize("name", sorted(TRUTHS))
def test_function(spark, name):
    function, samples = TRUTHS[name]
    names = [f"c{k}" for k in range(len(samples[0]) - 1)]
    rows = spark.createDataFrame([(i, *x[:-1]) for i, x in enumerate(samples)], ", ".join(["i long", *(f"{n} string" for n in names)]))
    got = [r.value for r in rows.select("i", function(*map(F.col, names)).alias("value")).orderBy("i").collect()]
    assert got == [x[-1] for x in samples]
