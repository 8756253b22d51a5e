"""Column functions of one value: identities, dates, retries, languages, JSON. No Python runs per row but
for Unicode normal forms, which come by Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from marlstone.functions import text as T


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def spaced(c: Column) -> Column:
    """White space collapsed, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def nfkc_folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t).casefold())


def body_text(c: Column) -> Column:
    """The form of a text that its digest is taken of: composed, line feeds, no white space at the ends of
    lines and of the whole."""
    return T.canonical_body(nfc(c))


def match_text(c: Column) -> Column:
    """The form in which texts are compared: compatibility forms, folded case, single spaces."""
    return spaced(nfkc_folded(c))


def quote_text(c: Column) -> Column:
    """The form in which quotations are compared: composed, single spaces."""
    return spaced(nfc(c))


def citation_text(c: Column) -> Column:
    """A claim's plain text: no table rules, cells by spaces, no heading and list marks, no evidence marks
    and emphasis, single spaces, no punctuation at the ends."""
    edges = r"[ ,，.。;；:：!?！？()（）\[\]【】]+"  # a fixed value
    rule = lambda x: F.trim(F.regexp_replace(x, r"^\|+|\|+$", "")).rlike(r"^\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*$")
    cells = lambda x: F.array_join(F.filter(F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x)), lambda y: y != ""), " ")
    marks = lambda x: F.regexp_replace(F.regexp_replace(x, r"^#{1,6}\s*", ""), r"^(?:[-*+>]|\d+[.)、])\s*", "")
    lines = F.filter(F.transform(F.split(c, r"\r\n|\n|\r"), trimmed), lambda x: (x != "") & ~rule(x))
    plain = F.array_join(F.transform(lines, lambda x: F.when(x.startswith("|"), cells(x)).otherwise(marks(x))), " ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\[E(?:[1-9]|1[0-2])\]", ""), r"[`*_~]", "")
    return F.regexp_replace(F.regexp_replace(plain, r"\s+", " "), f"^{edges}|{edges}$", "")


#: What an English and what a Chinese name look like.
_ENGLISH = r"^[A-Za-z][A-Za-z0-9 .+/&'-]{0,59}$"
_CHINESE = "[一-鿿]"


def primary_fields(term: Column, zh_name: Column) -> Column:
    """struct of term, zh_name and aliases of a new entity: of `name (remark)` the English half names it
    and the Chinese half is its Chinese name; the given form, where it differs, is an alias."""
    raw = F.trim(T.half_width(F.trim(F.coalesce(term, F.lit("")))))
    pattern = r"^(.+?)\s*\(([^()]+)\)$"
    split = raw.rlike(pattern)
    main, note = F.when(split, F.trim(F.regexp_extract(raw, pattern, 1))).otherwise(raw), F.when(split, F.trim(F.regexp_extract(raw, pattern, 2)))
    turned = F.coalesce(main.rlike(_CHINESE) & note.rlike(_ENGLISH), F.lit(False))
    kept = F.coalesce(main.rlike(_ENGLISH) & note.rlike(_CHINESE), F.lit(False))
    name = F.when(turned, note).otherwise(main)
    given = F.trim(F.coalesce(zh_name, F.lit("")))
    zh = F.when(given != "", given).when(turned, main).when(kept, note).otherwise("")
    return F.struct(name.alias("term"), zh.alias("zh_name"), F.when((raw != "") & (raw != name), F.array(raw)).otherwise(F.array().cast("array<string>")).alias("aliases"))


#: Relations that are known; others count as related.
RELATIONS = ("prerequisite", "is_a", "part_of", "related")


def norm_related(items: Column) -> Column:
    """Relations (term, rel) without empty terms, of each term the first; unknown relations are `related`."""
    clean = F.filter(F.transform(items, lambda x: F.struct(F.trim(F.coalesce(x["term"], F.lit(""))).alias("term"), F.when(x["rel"].isin(*RELATIONS), x["rel"]).otherwise("related").alias("rel"))), lambda x: x["term"] != "")
    names = F.transform(clean, lambda x: x["term"])
    return F.filter(clean, lambda x, i: F.array_position(names, x["term"]) == i + 1)


#: Fixed value: a Chinese name with its English one behind it.
_PAIR = r"(?<![一-鿿A-Za-z0-9·])([一-鿿·]{1,24})（([A-Za-z][A-Za-z0-9 .+/&'-]{1,59})）"


def pairs(markdown: Column) -> Column:
    """Map of English to Chinese from 中文（English） outside fenced code; of an English name the first
    Chinese one, if that stands in the text once more."""
    plain = F.regexp_replace(markdown, "(?s)```.*?```", " ")
    zh, en = (F.regexp_extract_all(plain, F.lit(_PAIR), F.lit(k)) for k in (1, 2))
    both = F.arrays_zip(F.transform(en, lambda x: F.trim(x)).alias("en"), zh.alias("zh"))
    names = F.transform(both, lambda x: x["en"])
    first = F.filter(both, lambda x, i: F.array_position(names, x["en"]) == i + 1)
    often = F.filter(first, lambda x: (F.length(plain) - F.length(F.replace(plain, x["zh"], F.lit("")))) >= F.length(x["zh"]) * 2)
    return F.map_from_arrays(F.transform(often, lambda x: x["en"]), F.transform(often, lambda x: x["zh"]))


def zh_name(term: Column, name: Column, definition: Column) -> Column:
    """struct of en and zh of a glossary row, or null: the given Chinese name of an English term, the halves
    of 中文(English), or the Chinese word before a comma that opens the definition."""
    t, english = F.trim(F.coalesce(term, F.lit(""))), r"^[A-Za-z][A-Za-z0-9 .+/&'-]{1,59}$"
    given, wide = F.trim(F.coalesce(name, F.lit(""))), F.translate(t, "()", "（）")
    opens = F.regexp_extract(F.trim(F.coalesce(definition, F.lit(""))), "^([一-鿿·]{1,12})[,，、]", 1)
    of = lambda a, b: F.struct(a.alias("en"), b.alias("zh"))
    return F.when(t.rlike(english) & given.rlike("^[一-鿿·]{1,24}$"), of(t, given)).when(wide.rlike(f"^{_PAIR}$"), of(F.trim(F.regexp_extract(wide, _PAIR, 2)), F.regexp_extract(wide, _PAIR, 1))).when(t.rlike(english) & (opens != ""), of(t, opens))


def looks_chinese(c: Column) -> Column:
    """Whether the first 4000 characters hold Chinese ones, at least as many as Latin letters."""
    head = F.substring(c, 1, 4000)  # the rule looks at a subtitle file's head
    chinese = F.regexp_count(head, F.lit(_CHINESE))
    return (chinese > 0) & (chinese >= F.regexp_count(head, F.lit("[A-Za-z]")))


#: What content ids look like, by platform and prefix of its lineages.
NATIVE = (("bilibili", "bili", r"(BV[a-zA-Z0-9]{10})"), ("youtube", "yt", r"(?:v=|youtu\.be/|/shorts/|/embed/)([A-Za-z0-9_-]{11})"), ("arxiv", "arxiv", r"(?i)(?:arxiv\.org/(?:abs|pdf)/)?(\d+\.\d+(?:v\d+)?|[a-z-]+(?:\.[A-Za-z]{2})?/\d{7}(?:v\d+)?)"), ("podcast", "audio", ""), ("http_article", "article", ""))


def native_id(url: Column, source: Column) -> Column:
    """The platform's own id in a URL, or null."""
    out = F.lit(None).cast("string")
    for name, _, pattern in NATIVE:
        if pattern:
            out = F.when(source == name, F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))).otherwise(out)
    return out


def lineage_key(url: Column, source: Column, kind: Column) -> Column:
    """jobs_{prefix}_{native id, else ten digits of the URL's digest}."""
    prefix = F.coalesce(kind, F.lit("x"))
    for name, short, _ in NATIVE:
        prefix = F.when(source == name, short).otherwise(prefix)
    return F.concat_ws("_", F.lit("jobs"), prefix, F.coalesce(native_id(url, source), F.substring(F.sha1(url), 1, 10)))


def lineage_of(job: Column) -> Column:
    """A job's lineage: its id without the time stamp at the end."""
    return F.regexp_replace(job, r"_\d{12}[0-9a-f]{4}$", "")


def slug(c: Column) -> Column:
    """Letters, digits, _ and - of a short id; ten digits of the digest for long ones and URLs."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(c), "[^A-Za-z0-9_-]+", "-"), "^-+|-+$", "")
    return F.when((clean != "") & (F.length(clean) <= 24) & ~F.contains(c, F.lit("://")), clean).otherwise(F.substring(F.sha1(c), 1, 10))


def folder_slug(c: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.regexp_extract(F.regexp_replace(c, "/+$", ""), "([^/]*)$", 1), "[^A-Za-z0-9_-]+", "-"), "^-+|-+$", "")
    return F.when(clean != "", clean).otherwise(F.substring(F.sha1(c), 1, 10))


def part_id(job: Column, part: Column) -> Column:
    return F.concat(F.lit("pt_"), F.substring(F.sha2(F.concat_ws(":", job, F.lit("part"), part.cast("string")), 256), 1, 20))


#: Hosts of offices and exchanges.
OFFICIAL = ("gov.cn", "court.gov.cn", "csrc.gov.cn", "sse.com.cn", "szse.cn")


def official(url: Column, original: Column) -> Column:
    """high for an office's host by https all the way, else low."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    safe = url.rlike("(?i)^https://") & (original.isNull() | original.rlike("(?i)^https://"))
    return F.when(safe & host.rlike(r"(?:^|\.)(?:" + "|".join(x.replace(".", r"\.") for x in OFFICIAL) + ")$"), "high").otherwise("low")


#: Fixed value: numbers of cases and decisions.
CASE = r"[〔\[（(]\s*20\d{2}\s*[〕\]）)][^，。\s]{0,8}?\d{1,4}\s*号"


def case_references(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(CASE), F.lit(0)), lambda x: F.trim(x))))


#: Fixed value: file names of generated notes.
_SMART = r"notes_smart_([^_/]+)_([^_/]+)_(\d{8}-\d{6})\.md$"


def note_version(file: Column) -> Column:
    """struct of provider, model and version of a generated note's file name, or null."""
    return F.when(file.rlike(_SMART), F.struct(*(F.regexp_extract(file, _SMART, k).alias(n) for k, n in enumerate(("provider", "model", "version"), 1))))


AUDIO_ENDINGS = ("mp3", "m4a", "wav", "aac", "flac")


def audio_link(html: Column) -> Column:
    """A page's audio file: its og:audio meta, else the first audio or source tag with such a file or else
    the first of them, else an enclosure, else a link to one; null without any."""
    url = r"""["']([^"'<>]+)["']"""
    found = lambda pattern: F.filter(F.transform(F.regexp_extract_all(html, F.lit("(?i)" + pattern), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    audio = lambda a: F.filter(a, lambda x: F.lower(F.substring_index(x, "?", 1)).rlike(r"\.(?:" + "|".join(AUDIO_ENDINGS) + ")$"))
    meta, tags = found(r"<meta[^<>]*property=[\"']og:audio[\"'][^<>]*content=" + url), found(r"<(?:audio|source)\b[^<>]*?\ssrc=" + url)
    return F.coalesce(F.get(meta, F.lit(0)), F.get(audio(tags), F.lit(0)), F.get(tags, F.lit(0)), F.get(audio(found(r"<enclosure\b[^<>]*?\surl=" + url)), F.lit(0)), F.get(audio(found(r"<a\b[^<>]*?\shref=" + url)), F.lit(0)))


def redacted_urls(c: Column) -> Column:
    """A text with the URLs in it redacted; punctuation at a URL's end is the sentence's.

    The text is cut at its URLs; every second piece is one."""
    pattern = r"(?i)\bhttps?://[^\s\"'<>\\]{3,8192}"
    urls, rest = F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1)), F.split(c, pattern)

    def one(x: Column) -> Column:
        raw = F.regexp_replace(x, r"[.,;:!?)\]}'\"]+$", "")
        return F.concat(T.redacted_url(raw), F.substring(x, F.length(raw) + 1, F.length(x)))

    return F.array_join(F.transform(rest, lambda x, i: F.concat(x, F.coalesce(F.get(F.transform(urls, one), i), F.lit("")))), "")


#: Retries by kind of error, and their delays in seconds; others are not retried.
RETRIES = {"processing": (0,), "ai": (30, 60, 120), "ai_rate_limit": (300, 600, 1200, 1800, 1800), "timeout": (10,), "storage": (15, 60, 180)}


def retry_delay(kind: Column, attempt: Column) -> Column:
    """Seconds before the attempt (from 0), null where there is none."""
    out = F.lit(None).cast("int")
    for name, delays in RETRIES.items():
        out = F.when(kind == name, F.get(F.array(*map(F.lit, delays)), attempt.cast("int"))).otherwise(out)
    return out


def backoff(attempt: Column, base: float, cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(20))))


def effective_timeout(base: Column, per_minute: Column, seconds: Column, cap: Column) -> Column:
    """The base, longer for long media (per_minute for each minute begun), up to the cap if there is one."""
    scaled = F.greatest(base, F.ceil(seconds / 60) * per_minute)
    return F.when((F.coalesce(per_minute, F.lit(0)) == 0) | (F.coalesce(seconds, F.lit(0)) <= 0), base).when(F.coalesce(cap, F.lit(0)) > 0, F.least(scaled, cap)).otherwise(scaled).cast("long")


def hash_band(a: Column, b: Column, near: int = 6) -> Column:
    """duplicate, gray or different, by the bits in which two picture hashes differ."""
    distance = F.bit_count(a.bitwiseXOR(b))
    return F.when(distance <= near, "duplicate").when(distance <= near + 4, "gray").otherwise("different")


def scalar(c: Column) -> Column:
    """struct of kind and value of a text that is a whole number, a decimal number or just a text."""
    whole, number = F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$")
    return F.struct(F.when(whole, "int").when(number, "float").otherwise("string").alias("kind"), F.when(whole, F.trim(c).try_cast("bigint").cast("string")).when(number, F.trim(c).try_cast("double").cast("string")).otherwise(c).alias("value"))


_ZONE = r"(?:[Zz]|[+-]\d{2}:?\d{2})$"


def lenient_time(c: Column) -> Column:
    """An instant from an ISO time, a year or a month; without a zone it is UTC; null if it is none."""
    v = F.trim(c)
    v = F.when(v.rlike(r"^\d{4}$"), F.concat(v, F.lit("-01-01"))).when(v.rlike(r"^\d{4}-\d{2}$"), F.concat(v, F.lit("-01"))).otherwise(v)
    iso = v.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:[Zz]|[+-]\d{2}:?\d{2})?)?$")
    zoned = F.when(v.rlike(r"[T ].*" + _ZONE), v).when(v.rlike("[T ]"), F.concat(v, F.lit("Z"))).otherwise(F.concat(v, F.lit("T00:00:00Z")))
    return F.when(iso, F.try_to_timestamp(F.regexp_replace(F.upper(zoned), r"([T ]\d{2}:\d{2})(Z|[+-])", "$1:00$2")))


def strict_time(c: Column) -> Column:
    """An instant from an ISO time with a zone, else null."""
    return F.when(F.trim(c).rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?" + _ZONE), lenient_time(c))


def julian_day(c: Column) -> Column:
    """An instant as days of the Julian calendar's count, with their fractions."""
    return F.unix_micros(c.cast("timestamp")) / 86_400_000_000 + 2440587.5


def days_apart(a: Column, b: Column) -> Column:
    return F.abs(julian_day(a) - julian_day(b))


def projected(c: Column, fields: str) -> Column:
    """JSON with the named fields alone (a schema, nested as it may be); null where the text is no object."""
    return F.to_json(F.from_json(c, fields))


MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def written_date(c: Column) -> Column:
    """A date in a line of print as ISO text, as exact as it is given: a day in it, else a month or a year
    that it is; empty if there is none."""
    v = spaced(c)
    names = "|".join(MONTHS)
    day = F.regexp_extract(v, rf"(?i)\b((?:{names})\s+\d{{1,2}},\s+\d{{4}})\b", 1)
    parsed = lambda x, pattern, out: F.date_format(F.try_to_timestamp(F.initcap(x), F.lit(pattern)), out)
    iso = F.regexp_extract(v, r"\b(\d{4}-\d{2}-\d{2})\b", 1)
    whole = lambda form, pattern, out: F.when(v.rlike(form), parsed(v, pattern, out))
    return F.coalesce(
        F.nullif(iso, F.lit("")), F.when(v.rlike(r"^\d{4}-(?:0[1-9]|1[0-2])$|^(?:19|20)\d{2}$"), v), F.when(day != "", F.coalesce(parsed(day, "MMMM d, yyyy", "yyyy-MM-dd"), F.lit(""))),
        whole(r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy", "yyyy-MM-dd"), whole(rf"(?i)^(?:{names}) \d{{4}}$", "MMMM yyyy", "yyyy-MM"), whole(r"^[A-Za-z]{3} \d{4}$", "MMM yyyy", "yyyy-MM"), F.lit(""),
    )


#: Where a link comes from, the first that fits: patterns, and endings of its path.
SOURCES = (
    ("bilibili", (r"bilibili\.com", r"^BV[a-zA-Z0-9]{10}$", r"b23\.tv"), ()), ("youtube", (r"youtube\.com", r"youtu\.be"), ()), ("arxiv", (r"arxiv\.org",), ()),
    ("pdf", (), (".pdf",)), ("podcast", (), (".mp3", ".m4a", ".wav", ".aac", ".flac")), ("local_file", ("^file://",), ()), ("http_article", ("^https?://",), ()),
)


def source_of(value: Column, sources: tuple = SOURCES) -> Column:
    """The first source whose pattern or ending fits, else other."""
    out, path = F.lit("other"), F.substring_index(F.lower(value), "?", 1)
    for name, patterns, endings in reversed(sources):
        fits = F.lit(False)
        for pattern in patterns:
            fits = fits | value.rlike(f"(?i){pattern}")
        for ending in endings:
            fits = fits | path.endswith(ending)
        out = F.when(fits, name).otherwise(out)
    return F.when(F.coalesce(value, F.lit("")) == "", "other").otherwise(out)


def json_list(c: Column, kind: str = "array<string>") -> Column:
    """A JSON array, empty where the text is none."""
    return F.coalesce(F.from_json(c, kind), F.array().cast(kind))


def json_kind(c: Column, path: str) -> Column:
    """The JSON type at a path: null, true, false, integer, real, text, array or object; null if nothing is there."""
    x = F.schema_of_variant(F.try_variant_get(F.try_parse_json(c), path, "variant"))
    bool_ = F.try_variant_get(F.try_parse_json(c), path, "boolean")
    return F.when(x.isNull(), None).when(x == "VOID", "null").when(x == "BOOLEAN", F.when(bool_, "true").otherwise("false")).when(x == "BIGINT", "integer").when(x.startswith("DECIMAL") | (x == "DOUBLE"), "real").when(x == "STRING", "text").when(x.startswith("ARRAY"), "array").otherwise("object")


def canonical_json(**fields: Column) -> Column:
    """JSON of the fields in the order of their names, without spaces; nulls stay."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def definition_version(domain: Column, term: Column, version: Column, input_hash: Column, actor: Column) -> Column:
    return F.concat(F.lit("cdv_"), F.sha2(canonical_json(domain=domain, term=term, version=version, input_hash=input_hash, actor=actor), 256))


def globbed(path: Column, pattern: str) -> Column:
    """Whether a path matches a shell pattern (*, ? and classes; * crosses folders)."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(ch, "\\" + ch if not ch.isalnum() and ch != "_" else ch)
        i += 1
    return path.rlike(f"(?s)^{out}$")


def first_rule(rules: list[dict], exists: dict[str, Column], flags: dict[str, Column]) -> Column:
    """Whether a step runs: the first rule that applies says so (when: on or skip). A rule applies if what
    its `exists` names is there and its `if_flag` is set; without any that applies the step runs."""
    out = F.lit(True)
    for rule in reversed(rules):
        holds = F.lit(True)
        if (glob := rule.get("exists")) is not None:
            holds = holds & F.coalesce(exists[glob], F.lit(False))
        if (flag := rule.get("if_flag")) is not None:
            holds = holds & F.coalesce(flags[flag], F.lit(False))
        out = F.when(holds, F.lit(rule.get("when", "on") not in ("skip", False))).otherwise(out)
    return out


def matches(required: Column, tags: Column, allowed: Column, worker: Column, rejected: Column) -> Column:
    """Whether a worker may take a task: it has all required tags, rejects none of the task's, and where
    providers are named has exactly one of them."""
    none = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return (F.size(F.array_except(none(required), none(worker))) == 0) & ~F.arrays_overlap(none(tags), none(rejected)) & (allowed.isNull() | (F.size(F.array_intersect(none(allowed), none(worker))) == 1))


def attestation(jobs: Column, sources: Column, kinds: Column) -> Column:
    """How well a claim is attested by distinct jobs, sources and kinds of evidence."""
    least = F.least(jobs, sources, kinds)
    return F.when((jobs == 0) | (sources == 0), "none").when(least >= 3, "strong").when(least >= 2, "corroborated").otherwise("supported")


def progress(done: Column, total: Column) -> Column:
    """Per cent done, ties to even; 0 of nothing."""
    return F.when(total == 0, F.lit(0)).otherwise(F.bround(done * 100 / total)).cast("long")


def short_definition(c: Column, limit: int = 120) -> Column:
    """A definition's first sentence, cut after `limit` characters with an ellipsis."""
    v = trimmed(F.coalesce(c, F.lit("")))
    head = trimmed(F.regexp_extract(v, r"(?s)^(.*?(?:[。！？!?]|\.(?=[ \t\n])|$))", 1))
    return F.when(F.length(head) > limit, F.concat(F.rtrim(F.substring(head, 1, limit)), F.lit("…"))).otherwise(head)
