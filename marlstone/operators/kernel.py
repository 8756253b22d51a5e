"""The column functions as queries over the tables: names, addresses, dates, JSON and claims made of what the
rows hold, with SQL that computes the same from the same columns. Truth tables of the functions are among
the tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import facts as X
from marlstone.functions import scalars as S
from marlstone.session import load

_list = lambda a: F.array_join(a, "|")
_cat = lambda *xs: F.concat(*(F.lit(x[1:]) if x.startswith("=") else F.col(x).cast("string") for x in xs))
_whole = lambda c: F.col(c).cast("long").cast("string")

#: name: (table, keys, the value, the same value in SQL, the rows).
FUNCTIONS: dict[str, tuple[str, str, Callable[[], Column], str, str]] = {}


def _add(name: str, table: str, keys: str, value: Callable[[], Column], sql: str, where: str = "true") -> None:
    FUNCTIONS[name] = table, keys, value, sql, where


_DIGITS, _NUMERALS = "0123456789", "零一二三四五六七八九"
_zh = lambda: F.translate(F.col("p_size").cast("string"), _DIGITS, _NUMERALS)
_ZH = f"translate(p_size::VARCHAR, '{_DIGITS}', '{_NUMERALS}')"
_TEXT = "text IS NOT NULL"

# Forms of texts.
_add("fn_quote_text", "documents", "doc_id", lambda: F.sha2(S.quote_text(F.col("text")), 256), r"sha256(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'), ' '))", _TEXT)
_add("fn_match_text", "benchmark", "item_id", lambda: F.sha2(S.match_text(F.upper("text")), 256), r"sha256(replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')), 'ß', 'ss'))", _TEXT)
_add("fn_body_text", "documents", "doc_id", lambda: F.sha2(S.body_text(F.concat(F.lit("\r\n "), F.col("text"), F.lit(" \t\r\n\r"))), 256), r"sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\s+$', ''), '^\s+', ''))", _TEXT)
_add("fn_citation_text", "benchmark", "item_id", lambda: S.citation_text(F.concat(F.lit("## "), F.regexp_replace("text", r"\s+", " "), F.lit("\n\n|---|:---:|\n- **of** `"), F.col("item_id").cast("string"), F.lit("` [E3]。"))), r"regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[`*_~]', '', 'g') || ' of ' || item_id, '^[ ,，.。;；:：!?！？()（）\[\]【】]+', '')", _TEXT)
_add("fn_looks_chinese", "documents", "doc_id", lambda: S.looks_chinese(F.when(F.col("doc_id") % 2 == 0, F.translate("text", "etaoinshr", "甲乙丙丁戊己庚辛壬")).otherwise(F.translate("text", "eta", "甲乙丙"))), "(SELECT len(regexp_extract_all(x, '[一-鿿]')) > 0 AND len(regexp_extract_all(x, '[一-鿿]')) >= len(regexp_extract_all(x, '[A-Za-z]')) FROM (SELECT substring(CASE WHEN doc_id % 2 = 0 THEN translate(text, 'etaoinshr', '甲乙丙丁戊己庚辛壬') ELSE translate(text, 'eta', '甲乙丙') END, 1, 4000) AS x))", _TEXT)
_add("fn_short_definition", "documents", "doc_id", lambda: S.short_definition(F.regexp_replace("text", r"\s+", " ")), r"""(SELECT CASE WHEN length(h) > 120 THEN rtrim(substring(h, 1, 120)) || '…' ELSE h END FROM (SELECT trim(substring(x, 1, least(CASE WHEN a > 0 THEN a ELSE 1000000000 END, CASE WHEN b > 0 THEN b - 1 ELSE 1000000000 END))) AS h
  FROM (SELECT x, length(regexp_extract(x, '^[^。！？!?]*[。！？!?]')) AS a, length(regexp_extract(x, '^.*?\. ')) AS b FROM (SELECT trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS x))))""", _TEXT)

# Names and relations of concepts.
_add("fn_primary_fields", "part", "p_partkey", lambda: F.concat_ws(";", *(lambda x: (x["term"], x["zh_name"], _list(x["aliases"])))(S.primary_fields(F.when(F.col("p_partkey") % 2 == 0, F.concat(_zh(), F.lit(" ("), F.col("p_name"), F.lit(")"))).otherwise(F.concat(F.col("p_name"), F.lit("（"), _zh(), F.lit("）"))), F.lit("")))), f"p_name || ';' || {_ZH} || ';' || CASE WHEN p_partkey % 2 = 0 THEN {_ZH} || ' (' || p_name || ')' ELSE p_name || '(' || {_ZH} || ')' END")
_add("fn_norm_related", "part", "p_partkey", lambda: _list(F.transform(S.norm_related(F.from_json(_cat('=[{"term":" ', "p_brand", '= ","rel":"is_a"},{"term":"', "p_brand", '=","rel":"related"},{"term":"', "p_type", '=","rel":"odd"},{"term":""}]'), "array<struct<term:string,rel:string>>")), lambda x: F.concat_ws(":", x["term"], x["rel"]))), "p_brand || ':is_a|' || p_type || ':related'")
_add("fn_pairs", "part", "p_partkey", lambda: _list(F.transform(F.map_entries(S.pairs(F.concat(_zh(), F.lit("（"), F.col("p_name"), F.lit("）很重要。```\n"), _zh(), F.lit("\n``` "), F.when(F.col("p_partkey") % 3 > 0, F.concat(_zh(), F.lit("在此。"))).otherwise("")))), lambda x: F.concat_ws("=", x["key"], x["value"]))), f"CASE WHEN p_partkey % 3 > 0 THEN p_name || '=' || {_ZH} ELSE '' END")
_add("fn_zh_name", "part", "p_partkey", lambda: F.concat_ws("=", *(lambda x: (x["en"], x["zh"]))(S.zh_name(F.when(F.col("p_partkey") % 3 == 1, F.concat(_zh(), F.lit("("), F.col("p_name"), F.lit(")"))).otherwise(F.col("p_name")), F.when(F.col("p_partkey") % 3 == 0, _zh()), F.when(F.col("p_partkey") % 2 == 0, F.concat(_zh(), F.lit("，很长"))).otherwise("no comma")))), f"CASE WHEN p_partkey % 3 < 2 OR p_partkey % 2 = 0 THEN p_name || '=' || {_ZH} ELSE '' END")
_add("fn_definition_version", "part", "p_partkey", lambda: S.definition_version(F.col("p_brand"), F.col("p_name"), F.col("p_size"), F.when(F.col("p_partkey") % 2 == 0, F.sha2("p_type", 256)), F.lit("me")), """'cdv_' || sha256('{"actor":"me","domain":"' || p_brand || '","input_hash":' || CASE WHEN p_partkey % 2 = 0 THEN '"' || sha256(p_type) || '"' ELSE 'null' END || ',"term":"' || p_name || '","version":' || p_size || '}')""")
_add("fn_tag_match", "part", "p_partkey", lambda: S.matches(F.array(F.split("p_type", " ")[0]), F.array("p_brand"), F.when(F.col("p_size") % 3 == 0, F.split("p_type", " ")), F.split("p_type", " "), F.when(F.col("p_size") % 2 == 0, F.array("p_brand")).otherwise(F.array(F.lit("none")))), "p_size % 2 <> 0 AND (p_size % 3 <> 0 OR len(list_distinct(string_split(p_type, ' '))) = 1)")
_add("fn_scalar", "part", "p_partkey", lambda: F.concat_ws("|", *(F.concat_ws(":", S.scalar(c)["kind"], S.scalar(c)["value"]) for c in (F.concat(F.lit("-"), F.lpad(F.col("p_size").cast("string"), 4, "0")), F.concat(_whole("p_partkey"), F.lit(".5")), F.col("p_name")))), "'int:-' || p_size || '|float:' || p_partkey || '.5|string:' || p_name", "p_size > 0")

# Addresses, files and ids.
_SRC = "CASE page_id % 4 WHEN 0 THEN 'youtube' WHEN 1 THEN 'bilibili' WHEN 2 THEN 'arxiv' ELSE 'http_article' END"
_source = lambda: F.element_at(F.array(*map(F.lit, ("youtube", "bilibili", "arxiv", "http_article"))), (F.col("page_id") % 4 + 1).cast("int"))
_k = lambda n: F.col("page_id") % 4 == n
_video = lambda: F.when(_k(0), F.concat(F.lit("https://www.youtube.com/watch?v="), F.substring(F.md5("url"), 1, 11), F.lit("&t=1"))).when(_k(1), F.concat(F.lit("https://www.bilibili.com/video/BV"), F.substring(F.md5("url"), 1, 10), F.lit("?p=2"))).when(_k(2), F.concat(F.lit("https://arxiv.org/abs/2301."), F.lpad(F.col("page_id").cast("string"), 5, "0"), F.lit("v2"))).otherwise(F.col("url"))
_NATIVE = "CASE page_id % 4 WHEN 0 THEN substring(md5(url), 1, 11) WHEN 1 THEN 'BV' || substring(md5(url), 1, 10) WHEN 2 THEN '2301.' || lpad(page_id::VARCHAR, 5, '0') || 'v2' ELSE '' END"
_add("fn_native_ids", "pages", "page_id", lambda: F.coalesce(S.native_id(_video(), _source()), F.lit("")), _NATIVE)
_add("fn_lineage_key", "pages", "page_id", lambda: S.lineage_key(_video(), _source(), F.lit("document")), f"'jobs_' || CASE page_id % 4 WHEN 0 THEN 'yt_' || {_NATIVE} WHEN 1 THEN 'bili_' || {_NATIVE} WHEN 2 THEN 'arxiv_' || {_NATIVE} ELSE 'article_' || substring(sha1(url), 1, 10) END")
_add("fn_source_of", "pages", "page_id", lambda: S.source_of(F.when(F.col("page_id") % 9 == 5, F.concat(F.split("url", r"\?")[0], F.lit(".PDF?x=1"))).when(F.col("page_id") % 9 == 6, F.concat(F.split("url", r"\?")[0], F.lit(".mp3"))).otherwise(_video())), f"CASE page_id % 9 WHEN 5 THEN 'pdf' WHEN 6 THEN 'podcast' ELSE {_SRC} END")
_add("fn_slugs", "pages", "page_id", lambda: F.concat_ws(";", S.slug(F.col("url")), S.slug(_cat("= page ", "page_id", "=! ")), S.folder_slug(_cat("=/data/My Page.", "page_id", "=/"))), "substring(sha1(url), 1, 10) || ';page-' || page_id || ';My-Page-' || page_id")
_add("fn_official", "pages", "page_id", lambda: S.official(F.when(_k(0), F.regexp_replace("url", "://[^/]+", "://www.csrc.gov.cn")).when(_k(1), F.regexp_replace("url", "^https?://[^/]+", "https://sse.com.cn:443")).otherwise(F.col("url")), F.when(F.col("page_id") % 3 == 0, F.col("url"))), "CASE WHEN (page_id % 4 = 1 OR (page_id % 4 = 0 AND url LIKE 'https://%')) AND (page_id % 3 <> 0 OR url LIKE 'https://%') THEN 'high' ELSE 'low' END")
_AUDIO_TAGS = ('<meta property="og:audio" content="https://a/{}"><audio src="/c.mp3">', '<audio src="/cover.png"><source src="/p{}.m4a?x=1"></audio>', '<audio src="/stream{}">', '<enclosure url="/e{}.wav"/>', '<a href="/page"></a><a href="/x{}.mp3">', "")  # by page_id % 6, before the page
_audio_page = lambda: F.concat(F.replace(F.element_at(F.array(*map(F.lit, _AUDIO_TAGS)), (F.col("page_id") % 6 + 1).cast("int")), F.lit("{}"), F.col("page_id").cast("string")), F.col("html"))
_found = lambda pattern: f"list_filter(list_transform(regexp_extract_all(h, '(?i){pattern}[\"\'\']([^\"\'\'<>]+)[\"\'\']', 1), lambda x: trim(x)), lambda x: x <> '')"
_audio = lambda found: f"list_filter({found}, lambda x: regexp_matches(lower(split_part(x, '?', 1)), '\\.({'|'.join(S.AUDIO_ENDINGS)})$'))[1]"
_SOURCES = _found("<(?:audio|source)\\b[^<>]*?\\ssrc=")
_add(
    "fn_audio_link", "pages", "page_id", lambda: F.coalesce(S.audio_link(_audio_page()), F.lit("")),
    f"""(SELECT coalesce({_found('<meta[^<>]*property=["' + "''" + ']og:audio["' + "''" + '][^<>]*content=')}[1], {_audio(_SOURCES)}, {_SOURCES}[1], {_audio(_found("<enclosure\\b[^<>]*?\\surl="))}, {_audio(_found("<a\\b[^<>]*?\\shref="))}, '')
  FROM (SELECT replace([{', '.join(f"'{x}'" for x in _AUDIO_TAGS)}][(page_id % 6 + 1)::INT], '{{}}', page_id::VARCHAR) || html AS h))""",
)
_add("fn_glob", "pages", "page_id", lambda: F.concat_ws("", *(S.globbed(F.col("url"), g).cast("int").cast("string") for g in ("https://*/*.html", "http?://[a-m]*", "*/[!0-9]*[0-9]"))), "(url GLOB 'https://*/*.html')::INT || '' || (url GLOB 'http?://[a-m]*')::INT || (url GLOB '*/[!0-9]*[0-9]')::INT")
_add("fn_redacted_text", "documents", "doc_id", lambda: S.redacted_urls(_cat("=see https://u:p@X.org/", "doc_id", "=?token=1&b=", "lang", "=. And (http://Y.org:80/?sig=3#f).")), "'see https://x.org/' || doc_id || '?b=' || lang || '. And (http://y.org/).'", "lang IS NOT NULL")
_add("fn_part_id", "conversations", "conv_id, turn", lambda: S.part_id(F.col("conv_id").cast("string"), F.col("turn")), "'pt_' || substring(sha256(conv_id || ':part:' || turn), 1, 20)")
_add("fn_lineage_of", "events", "event_id", lambda: S.lineage_of(F.concat(_cat("=jobs_u", "user_id", "=_"), F.date_format("ts", "yyMMddHHmmss"), F.substring(F.md5(F.col("event_id").cast("string")), 1, 4))), "'jobs_u' || user_id")
_add("fn_case_references", "documents", "doc_id", lambda: _list(S.case_references(F.concat(F.col("text"), F.lit(" 见（2021）京01民终"), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"), F.lit("号和〔2020〕"), (F.col("doc_id") % 100).cast("string"), F.lit(" 号。")))), "'〔2020〕' || (doc_id % 100) || ' 号|（2021）京01民终' || lpad((doc_id % 10000)::VARCHAR, 4, '0') || '号'", _TEXT)
_add("fn_canonical_json", "documents", "doc_id", lambda: S.canonical_json(source=F.col("source"), id=F.col("doc_id"), chars=F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")), lang=F.concat(F.lit('"\\'), F.col("lang"))), """'{"chars":' || CASE WHEN doc_id % 2 = 0 THEN n_chars::VARCHAR ELSE 'null' END || ',"id":' || doc_id || ',"lang":"\\"\\\\' || lang || '","source":"' || source || '"}'""", "lang IS NOT NULL AND source IS NOT NULL")
_add("fn_json_list", "documents", "doc_id", lambda: F.sha2(F.array_join(S.json_list(F.when(F.col("doc_id") % 5 == 4, F.substring("text", 1, 9)).otherwise(F.to_json(F.split("text", " ")))), " "), 256), "sha256(CASE WHEN doc_id % 5 = 4 THEN '' ELSE text END)", "text IS NOT NULL AND substring(text, 1, 1) <> '['")

# Times, numbers and rules.
_add("fn_written_date", "events", "event_id", lambda: S.written_date(F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM")).otherwise(F.concat(F.lit("Received  "), F.date_format("ts", "MMMM d, yyyy"), F.lit("; accepted")))), "CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m') ELSE strftime(ts, '%Y-%m-%d') END")
_json = lambda value: F.to_json(F.struct(value.alias("k")))
_KINDS = (
    lambda: F.col("props"), lambda: _json(F.col("event_type")), lambda: _json(F.array("user_id")), lambda: F.to_json(F.struct("user_id")), lambda: _json(F.col("user_id") + F.lit(0.5)), lambda: F.concat(F.lit('{"k":null,"user":'), F.col("user_id").cast("string"), F.lit("}")),
    lambda: _json(F.col("user_id") % 2 == 0), lambda: _json(F.struct(F.col("user_id").alias("b"))), lambda: F.concat(F.lit('{"k":'), F.col("event_type")),
)
_add(
    "fn_json_kind", "events", "event_id", lambda: F.coalesce(S.json_kind(F.coalesce(*(F.when(F.col("event_id") % 9 == n, x()) for n, x in enumerate(_KINDS))), "$.k"), F.lit("none")),
    "CASE event_id % 9 WHEN 6 THEN (user_id % 2 = 0)::VARCHAR ELSE ['integer', 'text', 'array', 'none', 'real', 'null', '', 'object', 'none'][(event_id % 9 + 1)::INT] END",
)
_add("fn_backoff", "events", "event_id", lambda: S.backoff((F.col("user_id") % 40 + 1).cast("int"), 30, 3600).cast("long"), "least(3600, 30 * (2 ** least(user_id % 40, 20)))::BIGINT")
_add("fn_effective_timeout", "orders", "o_orderkey", lambda: S.effective_timeout(F.lit(60), F.col("o_custkey") % 40, F.floor("o_totalprice") % 7200, F.when(F.col("o_orderkey") % 3 == 0, F.lit(900))), "(SELECT CASE WHEN p = 0 OR t <= 0 THEN 60 WHEN o_orderkey % 3 = 0 THEN least(greatest(60, ceil(t / 60.0) * p), 900) ELSE greatest(60, ceil(t / 60.0) * p) END::BIGINT FROM (SELECT o_custkey % 40 AS p, floor(o_totalprice)::BIGINT % 7200 AS t))")
_add("fn_hash_band", "events", "event_id", lambda: S.hash_band(F.col("event_id") * 123456789, (F.col("event_id") + F.col("user_id") % 5) * 123456789), "(SELECT CASE WHEN n <= 6 THEN 'duplicate' WHEN n <= 10 THEN 'gray' ELSE 'different' END FROM (SELECT bit_count(xor(event_id * 123456789, (event_id + user_id % 5) * 123456789)) AS n))")
_add("fn_progress", "orders", "o_orderkey", lambda: S.progress(F.col("o_custkey") % 9, F.col("o_custkey") % 9 + F.col("o_orderkey") % 8), "CASE WHEN o_custkey % 9 + o_orderkey % 8 = 0 THEN 0 ELSE round_even(100.0 * (o_custkey % 9) / (o_custkey % 9 + o_orderkey % 8), 0)::BIGINT END")
_rules = [{"exists": "input/*.srt", "when": "skip"}, {"if_flag": "fast", "when": "skip"}, {"exists": "input/*.ass"}, {"when": "skip"}]
_add("fn_rules", "events", "event_id", lambda: S.first_rule(_rules, {"input/*.srt": F.col("event_type") == "view", "input/*.ass": F.col("user_id") % 2 == 0}, {"fast": F.col("event_id") % 3 == 0}), "CASE WHEN event_type = 'view' THEN false WHEN event_id % 3 = 0 THEN false ELSE user_id % 2 = 0 END")

_add("fn_days_apart", "events", "event_id", lambda: F.round(S.days_apart(F.col("ts"), F.lit("2024-01-15 12:00:00").cast("timestamp")), 5), "round(abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) / 86400000000.0::DOUBLE, 5)")
_add("fn_json_projection", "documents", "doc_id", lambda: S.projected(F.to_json(F.struct("n_chars", F.col("doc_id").alias("id"), F.struct("source", "lang", F.array("lang").alias("more")).alias("meta"))), "id BIGINT, meta STRUCT<lang: STRING>, none INT"), """'{"id":' || doc_id || ',"meta":{"lang":"' || lang || '"}}'""", "lang IS NOT NULL")

# Facts of claims.
_LINE = "l_orderkey, l_linenumber"
_add("fn_fact_quantities", "lineitem", _LINE, lambda: _list(X.quantities(F.concat(F.lit("sold "), _whole("l_quantity"), F.lit(" kg at $"), F.format_number(F.floor("l_extendedprice"), 0), F.lit(", in "), _whole("l_linenumber"), F.lit(" hours, −"), _whole("l_suppkey"), F.lit("％ of 3 sheep")))), "l_quantity::BIGINT || 'kg|' || floor(l_extendedprice)::BIGINT || 'usd|' || l_linenumber || 'h|-' || l_suppkey || '%|3unknown:sheep'")
_add("fn_fact_tokens", "lineitem", _LINE, lambda: F.concat_ws(";", *(lambda c: (X.negations(c).cast("string"), _list(X.ranges(c)), _list(X.polarity(c)), _list(X.subjects(c))))(F.concat(F.when(F.col("l_returnflag") == "R", F.lit("It did not fail, growth is at least 3, ")).when(F.col("l_returnflag") == "A", F.lit("between 3 and 4, less than 5, ")).otherwise(F.lit("没有超过, ")), F.lit("model L"), _whole("l_linenumber")))), "CASE l_returnflag WHEN 'R' THEN '2;>=;fail|increase;l' WHEN 'A' THEN '0;<|between;;l' ELSE '1;>;absent;l' END || l_linenumber")
_add("fn_conflicts", "lineitem", _LINE, lambda: _list(X.conflicts(F.concat(F.lit("weighs "), _whole("l_quantity"), F.lit(" kg")), F.concat(F.lit("weighs "), _whole("l_linenumber"), F.when(F.col("l_returnflag") == "R", F.lit(" kg and no more")).otherwise(F.lit(" kg"))))), "concat_ws('|', CASE WHEN l_returnflag = 'R' THEN 'negation' END, CASE WHEN l_quantity <> l_linenumber THEN 'quantity' END)")


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    table, keys, value, _, where = FUNCTIONS[name]

    def run(s: SparkSession, d: str) -> DataFrame:
        return load(s, d, table).filter(where).select(*keys.split(", "), value().alias("value"))

    return run


def newest_notes(s: SparkSession, d: str) -> DataFrame:
    """Documents as files of generated notes: of each provider and model the newest file, and how many there are."""
    file = F.concat(F.lit("out/notes_smart_"), F.col("lang"), F.lit("_"), F.col("source"), F.lit("_2024010"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("-"), F.lpad((F.col("doc_id") % 240000).cast("string"), 6, "0"), F.lit(".md"))
    rows = load(s, d, "documents").filter("lang is not null and source is not null").select(file.alias("file"), S.note_version(file).alias("v")).filter("v is not null")
    return rows.groupBy("v.provider", "v.model").agg(F.max_by("file", "v.version").alias("file"), F.count_distinct("v.version").alias("versions"))


def window_rechecked(s: SparkSession, d: str) -> DataFrame:
    """Events of two days, their times as texts with a zone, in UTC, or without one, which is none: first those
    of a window a second wider at both ends, by days, then exactly."""
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id") % 3
    text = F.when(k == 0, F.concat(F.date_format(F.timestamp_micros(F.unix_micros(ts) + 7_200_000_000), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).otherwise(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(k == 1, "Z").otherwise("")))
    low, high = (F.lit(x).cast("timestamp") for x in ("2024-01-10 00:00:00", "2024-01-12 00:00:00"))
    rows = load(s, d, "events").select("event_id", S.strict_time(text).alias("at"), S.julian_day(ts).alias("day"))
    second = 1 / 86400
    wide = rows.filter((F.col("day") >= S.julian_day(low) - second) & (F.col("day") < S.julian_day(high) + second))
    return wide.filter((F.col("at") >= low) & (F.col("at") < high)).select("event_id")


QUERIES = {name: _query(name) for name in FUNCTIONS} | {"newest_notes": newest_notes, "window_rechecked": window_rechecked}
ORACLES = {name: f"SELECT {keys}, {sql} AS value FROM {table} WHERE {where}" for name, (table, keys, _, sql, where) in FUNCTIONS.items()} | {
    "window_rechecked": "SELECT event_id FROM events WHERE event_id % 3 <> 2 AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'",
    "newest_notes": "WITH f AS (SELECT lang, source, '2024010' || (doc_id % 9 + 1) || '-' || lpad((doc_id % 240000)::VARCHAR, 6, '0') AS v FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL) SELECT lang AS provider, source AS model, 'out/notes_smart_' || lang || '_' || source || '_' || max(v) || '.md' AS file, count(DISTINCT v) AS versions FROM f GROUP BY lang, source",
}
