"""Text and identity operators: keys, terms, URLs, secrets, pages, chunks, cue windows, quotations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.session import load

CHUNK, STEP = 1400, 1280


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


NEGATIONS = ("not", "no", "never", "nicht", "kein", "ne", "pas", "sin", "nunca")


def hit_terms(texts: DataFrame, key: str, text: str, terms: list[str], limit: int = 40) -> DataFrame:
    """Terms of a fixed list found in a text, the most frequent first, then by name: in any case, no
    letter or digit of ASCII next to them, and with the endings s, es and 's."""
    pattern = lambda t: "(?i)(?<![A-Za-z0-9])" + re.escape(t) + "(?:'s|es|s)?(?![A-Za-z0-9])"
    counts = [F.struct(F.lit(t).alias("term"), F.regexp_count(text, F.lit(pattern(t))).cast("long").alias("n")) for t in terms]
    found = texts.select(F.col(key), F.explode(F.array(*counts)).alias("x")).select(key, "x.term", "x.n").filter("n > 0")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), F.lower("term")))
    return found.withColumn("place", place).filter(F.col("place") <= limit)


def resolve(names: DataFrame, name: Column, entities: DataFrame, entity: str, label: str) -> DataFrame:
    """The entity of a name by its candidate keys, the first key that is known winning, then the least entity."""
    index = entities.select(F.col(entity).alias("entity"), F.explode(T.candidate_keys(F.col(label))).alias("key")).groupBy("key").agg(F.min("entity").alias("entity"))
    keys = names.withColumn("_k", T.candidate_keys(name)).select("*", F.posexplode("_k").alias("_pos", "key")).drop("_k")
    return keys.join(index, "key").groupBy(*names.columns).agg(F.min_by("entity", "_pos").alias("entity"))


def chunk_note(text: str) -> list[tuple[str, int, int, str]]:
    """(section, start, end, body): lines with text are paragraphs, and end where the next line begins; a
    heading closes a chunk and, unless it is empty, names the section; a long paragraph goes in windows of
    CHUNK every STEP; others fill chunks of CHUNK characters."""
    out: list[tuple[str, int, int, str]] = []
    held: list[tuple[int, int, str]] = []
    section = of = ""
    size = at = 0

    def close() -> None:
        nonlocal size
        if body := "\n".join(p for *_, p in held).strip():
            out.append((of, held[0][0], held[-1][1], body))
        held.clear()
        size = 0

    for line in text.splitlines(keepends=True):
        begin, at = at, at + len(line)
        if not line.strip():
            continue
        line = line.rstrip("\n")
        if line.lstrip().startswith("#"):
            close()
            section = line.lstrip("#").strip() or section
        if len(line) > CHUNK:
            close()
            for k in range(0, len(line), STEP):
                if part := line[k : k + CHUNK].strip():
                    out.append((section, begin + k, min(begin + k + len(part), at), part))
            continue
        if held and size + len(held) + len(line) > CHUNK:
            close()
        if not held:
            of = section
        held.append((begin, at, line))
        size += len(line)
    close()
    return out


def note_chunks(notes: DataFrame, key: str, text: str) -> DataFrame:
    """key, chunk, section, char_start, char_end and body of each chunk, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, *c) for k, t in zip(batch["k"], batch["t"], strict=True) for i, c in enumerate(chunk_note(t or ""))]
            yield pd.DataFrame(rows, columns=["k", "chunk", "section", "char_start", "char_end", "body"])

    out = notes.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInPandas(run, "k long, chunk long, section string, char_start long, char_end long, body string")
    return out.withColumnRenamed("k", key)


_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
_TAG = re.compile(r"<[^>]+>")
_MARKS = tuple((re.compile(p), to) for p, to in ((r"`([^`]*)`", r"\1"), (r"!?\[([^\]]*)\]\([^)]*\)", r"\1"), (r"^(\s{0,3})[-*+]\s+", r"\1"), (r"^(\s{0,3})>\s?", r"\1"), (r"[*_~]+", "")))


def index_text(text: str) -> str:
    """Markdown as text to be indexed: fence lines (of back ticks or tildes, closed by their own kind) go,
    the code in them stays as it is; elsewhere code marks, link targets, bullets, quotes and emphasis go;
    tags become a space everywhere; runs of blank lines become one, none at the ends."""
    out: list[str] = []
    fence = ""
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if (mark := _FENCE.match(line)) and fence in ("", mark[1][0]):
            fence = "" if fence else mark[1][0]
            continue
        line = _TAG.sub(" ", line)
        if not fence:
            for pattern, to in _MARKS:
                line = pattern.sub(to, line)
        line = line.rstrip()
        if line or (out and out[-1]):
            out.append(line)
    return "\n".join(out).rstrip("\n")


def indexed(notes: DataFrame, key: str, text: str) -> DataFrame:
    """key and body, the text to be indexed of each note, batch by batch; a null text gives an empty body."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"], "body": [index_text(t or "") for t in batch["t"]]})

    return notes.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInPandas(run, "k long, body string").withColumnRenamed("k", key)


def greedy_windows(rows: DataFrame, key: str, at: str, width: float) -> DataFrame:
    """rows with window_start: a row opens a window of its key when none is open or the open one began
    `width` or more before it (not a session: the anchor is the window's first row).

    Each key's rows pass in order through one task, which holds a batch and the open window's start."""
    schema = rows.schema.add("window_start", "double")
    k, t = rows.columns.index(key), rows.columns.index(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, begin = None, 0.0
        for batch in batches:
            keys, times = batch.column(k).to_pylist(), batch.column(t).cast(pa.float64()).to_numpy(zero_copy_only=False)
            out, i = np.empty(len(times)), 0
            while i < len(times):
                if (keys[i],) != last or not times[i] < begin + width:
                    last, begin = (keys[i],), times[i]
                j = i + 1
                while j < len(times) and keys[j] == keys[i] and times[j] < begin + width:
                    j += 1
                out[i:j] = begin
                i = j
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "window_start"])

    return rows.repartition(key).sortWithinPartitions(key, at).mapInArrow(run, schema)


def windows_by_fold(cues: DataFrame, key: str, start: str, seconds: float) -> DataFrame:
    """Greedy windows of cues: their start, how many cues they have and when the last begins."""
    rows = cues.select(F.col(key), F.col(start).cast("double").alias("_at")).filter("_at is not null")
    return greedy_windows(rows, key, "_at", seconds).groupBy(key, "window_start").agg(F.count("*").alias("cues"), F.max("_at").alias("last_start"))


def _docs(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents")


def _pages(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "pages")


def norm_key_resolve(s: SparkSession, d: str) -> DataFrame:
    parts = load(s, d, "part")
    names = parts.select("p_partkey", F.concat(F.upper("p_name"), F.lit("  (Old Name)")).alias("raw"))
    return resolve(names, F.col("raw"), parts, "p_partkey", "p_name").select("p_partkey", "entity")


def halfwidth(s: SparkSession, d: str) -> DataFrame:
    return _folded(_docs(s, d), F.col("text"))


def halfwidth_whole(s: SparkSession, d: str) -> DataFrame:
    return halfwidth(s, d)


def _folded(docs: DataFrame, text: Column) -> DataFrame:
    return docs.select("doc_id", F.sha2(T.half_width(F.translate(text, T.HALF_WIDTH, T.FULL_WIDTH)), 256).alias("digest"))


TERMS = ["idiot", "clown", "license", "the", "les", "von"]


def hit_terms_query(s: SparkSession, d: str) -> DataFrame:
    return hit_terms(_docs(s, d), "doc_id", "text", TERMS)


def url_native_ids(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("page_id", F.regexp_extract("url", r"/([0-9]+)", 1).alias("native"), F.lower(F.regexp_extract("url", r"://([^/?#]+)", 1)).alias("host"))


def url_redact(s: SparkSession, d: str) -> DataFrame:
    odd = F.concat(F.regexp_replace("url", "://", "://User:pw@"), F.when(F.contains("url", F.lit("?")), F.lit("&token=abc&X-Amz-Signature=1;session_id=2&page=3&sessionToken=4&Expires=5")).otherwise(F.lit("")))
    return _pages(s, d).select("page_id", T.redacted_url(odd).alias("url"))


def lineage_keys(s: SparkSession, d: str) -> DataFrame:
    clean = F.regexp_replace(T.redacted_url(F.col("url")), r"^https?://(www\.|m\.)?", "")
    return _pages(s, d).select("page_id", F.substring(F.sha1(F.regexp_replace(clean, r"[?/]*(\?.*)?$", "")), 1, 10).alias("lineage"))


def source_class(s: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    kind = F.when(u.rlike(r"^https?://blog\."), "blog").when(u.rlike(r"^https?://m\."), "mobile").when(u.rlike(r"\.html?($|[?#])"), "page").when(u.rlike(r"utm_"), "feed").otherwise("web")
    return _pages(s, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def secret_scan(s: SparkSession, d: str) -> DataFrame:
    flags = [F.when(F.col("text").rlike(p), F.lit(n)) for n, p in T.SECRETS]
    return _docs(s, d).select("doc_id", F.concat_ws(",", *flags).alias("secrets")).filter("secrets <> ''")


def html_links(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("href")).groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("href").alias("targets"))


def html_title_meta(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", r'<html lang="([^"]*)"', 1).alias("lang"))


def html_text(s: SparkSession, d: str) -> DataFrame:
    """Text of a page: no scripts, styles, comments and tags; blocks end lines; white space collapsed."""
    c = F.regexp_replace("html", r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?i)</?(p|div|li|h[1-6]|br|ul|tr|article|section)[^<>]*>", "\n")
    c = F.regexp_replace(c, r"<[^<>]*>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r" ?\n[ \n]*", "\n")
    return _pages(s, d).select("page_id", F.sha2(F.trim(F.regexp_replace(F.regexp_replace(c, r"^\n+", ""), r"\n+$", "")), 256).alias("digest"))


def html_blocks(s: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(r"<(h[1-6]|p|li)[ >]"), F.lit(1))
    return _pages(s, d).select("page_id", F.explode(found).alias("block")).groupBy("page_id", "block").agg(F.count("*").alias("n"))


def page_quality(s: SparkSession, d: str) -> DataFrame:
    """Reason codes of a page, in a fixed order."""
    html = F.lower("html")
    reasons = [F.when(~F.contains(html, F.lit("<article")), F.lit("no_main")), F.when(F.contains(html, F.lit("subscribe to continue")), F.lit("paywall")), F.when(F.contains(html, F.lit('rel="next"')), F.lit("paged")), F.when(F.char_length("html") < 1500, F.lit("short")), F.when(F.contains(html, F.lit("enable javascript")), F.lit("dynamic"))]
    return _pages(s, d).select("page_id", F.concat_ws(",", *reasons).alias("reasons"))


def markdown_index_text(s: SparkSession, d: str) -> DataFrame:
    marked = F.concat(F.lit("# Head\n> "), F.col("text"), F.lit("\n```py\na *= b_c\n```\n\n\n- **bold** [link](http://x)\n"))
    return indexed(_docs(s, d).withColumn("marked", marked), "doc_id", "marked").select("doc_id", F.sha2("body", 256).alias("digest"))


def note_chunks_query(s: SparkSession, d: str) -> DataFrame:
    return note_chunks(_docs(s, d), "doc_id", "text").select("doc_id", "chunk", "section", "char_start", "char_end", F.sha2("body", 256).alias("body_sha256"))


def cue_windows_60(s: SparkSession, d: str) -> DataFrame:
    cues = load(s, d, "conversations").filter("text is not null").select("conv_id", (F.col("turn") * 25 + F.char_length("text") % 20).alias("start"), "text")
    return windows_by_fold(cues, "conv_id", "start", 60.0)


def beat_timeline(s: SparkSession, d: str) -> DataFrame:
    """Turns and their lengths in beats of 30 seconds (a turn lasts 10)."""
    beat = F.floor(F.col("turn") * 10 / 30)
    return load(s, d, "conversations").groupBy("conv_id", beat.alias("beat")).agg(F.count("*").alias("cues"), F.sum(F.char_length("text")).alias("chars"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("roles"))


def part_offsets(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return load(s, d, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.char_length("text")).over(w), F.lit(0)).alias("offset"))


def quantity_tokens(s: SparkSession, d: str) -> DataFrame:
    q = F.array_join(T.quantities(F.col("text")), ";")
    return _docs(s, d).select("doc_id", q.alias("quantities")).filter("quantities <> ''")


def negation_polarity(s: SparkSession, d: str) -> DataFrame:
    n = F.size(F.filter(_words("text"), lambda w: w.isin(*NEGATIONS))).cast("long")
    return _docs(s, d).select("doc_id", n.alias("negations"), (n % 2).alias("polarity")).filter("negations > 0")


#: Characters of the strings that a scan of texts looks for at a time.
SCAN_CHARS = 4 << 20


def scanned(rows: DataFrame, keys: list[str], text: str, strings: DataFrame, string: str) -> DataFrame:
    """keys and string of the strings that each text holds (case counts); null and empty ones are in none.

    All strings are looked for in one pass over a text, by an automaton. Strings come in blocks of SCAN_CHARS,
    each a pass over the texts, so that no task and no driver holds more of them."""
    known = strings.select(F.col(string).alias("_s")).filter("_s <> ''").distinct()
    total = known.agg(F.sum(F.length("_s") + 1)).first()[0] or 0
    kinds = {f.name: f.dataType for f in rows.select(*keys).schema}
    schema = ", ".join(f"`{k}` {t.simpleString()}" for k, t in kinds.items()) + ", _s string"
    out = rows.sparkSession.createDataFrame([], schema)
    blocks = -(-total // SCAN_CHARS)
    for block in range(blocks):
        words = [r[0] for r in known.filter(F.pmod(F.xxhash64("_s"), F.lit(blocks)) == block).collect()]
        words = rows.sparkSession.sparkContext.broadcast(words)

        def run(batches: Iterator[pa.RecordBatch], words=words) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for w in words.value:
                machine.add_word(w, w)
            if words.value:
                machine.make_automaton()
            for batch in batches:
                at, found = [], []
                for i, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    here = {w for _, w in machine.iter(t)} if t and words.value else ()
                    at += [i] * len(here)
                    found += here
                yield pa.RecordBatch.from_arrays([*batch.select(list(range(len(kinds)))).take(pa.array(at, pa.int64())).columns, pa.array(found, pa.string())], [*kinds, "_s"])

        out = out.unionByName(rows.select(*keys, F.col(text).alias("_t")).mapInArrow(run, schema))
    return out.withColumnRenamed("_s", string)


def holding(docs: DataFrame, items: DataFrame, text: str, quote: str, key: str, item: str, within: str | None = None) -> DataFrame:
    """docs joined with the items whose quote their text holds word for word (case counts). key and item
    name the ids of both; columns named _w, _q, _g or _in must not be there. within: a column of docs and items
    that must be equal; the result has it once, and only ids of one of its values meet.

    A quote of five words and more is found by three of its inner words, which a text that holds it must
    have in a row; shorter ones by a scan of the texts. Only ids meet; texts and quotes come to the pairs
    of ids that are found."""
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    gram = lambda w, i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2))
    place = [F.col(within).alias("_in")] if within else []
    same = ["_in"] if within else []
    quotes = items.filter((F.col(quote) != "") & F.col(quote).isNotNull()).withColumn("_q", words(F.col(quote)))
    middle = F.greatest(F.floor(F.size("_q") / 2), F.lit(2)).cast("int")
    keyed = quotes.filter(F.size("_q") >= 5).select(item, *place, gram(F.col("_q"), middle).alias("_g"))
    grams = docs.select(key, *place, words(F.col(text)).alias("_w")).filter(F.size("_w") >= 3)
    grams = grams.select(key, *same, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("_w") - 2), lambda i: gram(F.col("_w"), i)))).alias("_g"))
    pairs = grams.join(keyed, [*same, "_g"]).select(key, item)
    short = quotes.filter(F.size("_q") < 5).select(item, *place, quote)
    if within:
        # the texts of one value are few: each is looked through for that value's short quotes alone
        texts = docs.select(key, *place, F.col(text).alias("_w"))
        pairs = pairs.unionByName(texts.join(short.withColumnRenamed(quote, "_q"), "_in").filter(F.contains("_w", F.col("_q"))).select(key, item)).distinct()
        items = items.drop(within)
    else:
        pairs = pairs.unionByName(scanned(docs, [key], text, short, quote).join(short, quote).select(key, item)).distinct()
    return pairs.join(docs, key).join(items, item).filter(F.contains(F.col(text), F.col(quote))).select(*docs.columns, *items.columns)


def exact_quote_match(s: SparkSession, d: str) -> DataFrame:
    """Benchmark items that a document holds word for word."""
    items = load(s, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    return holding(_docs(s, d).select("doc_id", "text"), items, "text", "quote", "doc_id", "item_id").select("doc_id", "item_id")


def anchors(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Where a quotation stands in a document, if it stands just once; occurrences may overlap. Items may
    have prefix and suffix: what stands right before and after the quotation (null: anything)."""
    for part in ("prefix", "suffix"):
        if part not in items.columns:
            items = items.withColumn(part, F.lit(None).cast("string"))
    whole = F.concat(F.coalesce("prefix", F.lit("")), F.col("quote"), F.coalesce("suffix", F.lit("")))
    items = items.filter("quote <> ''").withColumn("whole", whole)
    hits = holding(docs.select("doc_id", "text"), items, "text", "whole", "doc_id", "item_id").withColumn("place", F.instr("text", F.col("whole")))
    once = hits.filter(F.expr("locate(whole, text, place + 1) = 0"))
    return once.select("doc_id", "item_id", (F.col("place") + F.length(F.coalesce("prefix", F.lit("")))).cast("long").alias("place"))


def quote_anchor(s: SparkSession, d: str) -> DataFrame:
    """The item without its first and last ten characters, anchored by those as prefix and suffix."""
    cut = lambda a, n: F.substring(F.col("text"), a, n)
    size = F.length("text")
    items = load(s, d, "benchmark").filter(size > 20).select("item_id", cut(F.lit(11), size - 20).alias("quote"), cut(F.lit(1), F.lit(10)).alias("prefix"), cut(size - 9, F.lit(10)).alias("suffix"))
    return anchors(_docs(s, d), items)


def quote_anchor_whole(s: SparkSession, d: str) -> DataFrame:
    """The whole text of each item."""
    return anchors(_docs(s, d), load(s, d, "benchmark").select("item_id", F.col("text").alias("quote")))


def body_fingerprint_dups(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.sha2(T.canonical_body(F.col("text")), 256).alias("h")).groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").select("first", "copies")


#: Beginnings of titles that editors and series put there.
JUNK_TITLES = ("nber working paper", "working paper", "microsoft word", "untitled", "draft")
ONE_WORD = 24


def suspicious(title: Column) -> Column:
    """Whether a title is none: empty, a file name, one of the known beginnings, or a single short word."""
    t = F.trim(F.coalesce(title, F.lit("")))
    return (t == "") | t.rlike(r"(?i)\.(dvi|tex|pdf|docx?)$") | F.lower(t).rlike("^(?:" + "|".join(JUNK_TITLES) + ")") | (~F.contains(t, F.lit(" ")) & (F.char_length(t) <= ONE_WORD))


def suspicious_title(s: SparkSession, d: str) -> DataFrame:
    """Titles of pages, and of every third page its file name or first word."""
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    name = F.when(F.col("page_id") % 3 == 1, F.substring_index(title, " ", 1)).when(F.col("page_id") % 3 == 2, F.concat(title, F.lit(".PDF"))).otherwise(title)
    return _pages(s, d).select("page_id", suspicious(name).alias("suspicious"))


def heading_fill(s: SparkSession, d: str) -> DataFrame:
    """Each turn under the last user turn before it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return load(s, d, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("under"))


def stable_ids(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", T.stable_id("ce_", F.col("source"), F.col("doc_id").cast("string")).alias("evidence_id"))


QUERIES = {
    **{
        f.__name__: f
        for f in (norm_key_resolve, halfwidth, halfwidth_whole, url_native_ids, url_redact, lineage_keys, source_class, secret_scan, html_links, html_title_meta, html_text, html_blocks, page_quality, markdown_index_text, cue_windows_60, beat_timeline, part_offsets, quantity_tokens, negation_polarity, exact_quote_match, quote_anchor, quote_anchor_whole, body_fingerprint_dups, suspicious_title, heading_fill, stable_ids)
    },
    "hit_terms": hit_terms_query,
    "note_chunks": note_chunks_query,
}

_URL = """
WITH p AS (SELECT page_id, {url} AS c FROM pages),
q AS (SELECT page_id, lower(regexp_extract(c, '^([A-Za-z]+)://', 1)) AS sch, lower(regexp_extract(c, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#]*)', 1)) AS host, regexp_extract(c, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path,
      array_to_string(list_filter(string_split_regex(regexp_extract(c, '\\?([^#]*)', 1), '[&;]'), lambda x: x <> '' AND NOT regexp_matches(lower(string_split(x, '=')[1]), '{secret}')), '&') AS qs FROM p),
u AS (SELECT page_id, sch || '://' || host || path || (CASE WHEN qs <> '' THEN '?' || qs ELSE '' END) AS url FROM q)"""
_SECRET = "(?:" + "|".join(T.SECRET_PARTS) + ")|^(?:" + "|".join(T.SECRET_NAMES) + ")$|^(?:" + "|".join(T.SECRET_PREFIXES) + ")"

ORACLES = {
    "norm_key_resolve": "SELECT p.p_partkey, m.entity FROM part p JOIN (SELECT p_name, min(p_partkey) AS entity FROM part GROUP BY p_name) m ON m.p_name = p.p_name",
    "halfwidth": "SELECT doc_id, sha256(text) AS digest FROM documents",
    "halfwidth_whole": "SELECT doc_id, sha256(text) AS digest FROM documents",
    "hit_terms": "WITH t AS (SELECT doc_id, u.term, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w IN (u.term, u.term || 's', u.term || 'es'))) AS n FROM documents, (VALUES "
    + ", ".join(f"('{t}')" for t in TERMS)
    + ") u(term)) SELECT doc_id, term, n::BIGINT AS n, (row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term))::INT AS place FROM t WHERE n > 0",
    "url_native_ids": "SELECT page_id, regexp_extract(url, '/([0-9]+)', 1) AS native, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host FROM pages",
    "url_redact": _URL.format(secret=_SECRET, url="replace(url, '://', '://User:pw@') || (CASE WHEN contains(url, '?') THEN '&token=abc&X-Amz-Signature=1;session_id=2&page=3&sessionToken=4&Expires=5' ELSE '' END)") + " SELECT * FROM u",
    "lineage_keys": _URL.format(secret=_SECRET, url="url") + " SELECT page_id, substring(sha1(regexp_replace(regexp_replace(url, '^https?://(www\\.|m\\.)?', ''), '[?/]*(\\?.*)?$', '')), 1, 10) AS lineage FROM u",
    "source_class": "SELECT CASE WHEN regexp_matches(url, '^https?://blog\\.') THEN 'blog' WHEN regexp_matches(url, '^https?://m\\.') THEN 'mobile' WHEN regexp_matches(url, '\\.html?($|[?#])') THEN 'page' WHEN contains(url, 'utm_') THEN 'feed' ELSE 'web' END AS kind, count(*) AS n FROM pages GROUP BY 1",
    "secret_scan": "SELECT * FROM (SELECT doc_id, concat_ws(',', " + ", ".join("CASE WHEN regexp_matches(text, '" + p.replace("'", "''") + f"') THEN '{n}' END" for n, p in T.SECRETS) + ") AS secrets FROM documents) WHERE secrets <> ''",
    "html_links": "WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages) SELECT page_id, count(*) AS links, count(DISTINCT href) AS targets FROM l GROUP BY page_id",
    "html_title_meta": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages",
    "html_text": """
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g') AS c FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(c, '(?i)</?(p|div|li|h[1-6]|br|ul|tr|article|section)[^<>]*>', chr(10), 'g'), '<[^<>]*>', '', 'g') AS c FROM a),
e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(c, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS c FROM b),
w AS (SELECT page_id, regexp_replace(regexp_replace(c, '[ \\t]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g') AS c FROM e)
SELECT page_id, sha256(trim(regexp_replace(regexp_replace(c, '^\\n+', ''), '\\n+$', ''), ' ')) AS digest FROM w""",
    "html_blocks": "WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<(h[1-6]|p|li)[ >]', 1)) AS block FROM pages) SELECT page_id, block, count(*) AS n FROM l GROUP BY ALL",
    "page_quality": "SELECT page_id, concat_ws(',', CASE WHEN NOT contains(lower(html), '<article') THEN 'no_main' END, CASE WHEN contains(lower(html), 'subscribe to continue') THEN 'paywall' END, CASE WHEN contains(lower(html), 'rel=\"next\"') THEN 'paged' END, CASE WHEN length(html) < 1500 THEN 'short' END, CASE WHEN contains(lower(html), 'enable javascript') THEN 'dynamic' END) AS reasons FROM pages",
    "cue_windows_60": """
WITH RECURSIVE c AS (SELECT conv_id, (turn * 25 + length(text) % 20)::DOUBLE AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn * 25 + length(text) % 20, text) AS i FROM conversations WHERE text IS NOT NULL),
w AS (SELECT conv_id, i, s, s AS w FROM c WHERE i = 1 UNION ALL SELECT c.conv_id, c.i, c.s, CASE WHEN c.s - w.w >= 60 THEN c.s ELSE w.w END FROM w JOIN c ON c.conv_id = w.conv_id AND c.i = w.i + 1)
SELECT conv_id, w AS window_start, count(*) AS cues, max(s) AS last_start FROM w GROUP BY conv_id, w""",
    "beat_timeline": "SELECT conv_id, (turn * 10) // 30 AS beat, count(*) AS cues, sum(length(text))::BIGINT AS chars, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY ALL",
    "part_offsets": "SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM conversations",
    "negation_polarity": "WITH n AS (SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: w IN ('not', 'no', 'never', 'nicht', 'kein', 'ne', 'pas', 'sin', 'nunca'))) AS n FROM documents) SELECT doc_id, n::BIGINT AS negations, (n % 2)::BIGINT AS polarity FROM n WHERE n > 0",
    "exact_quote_match": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "quote_anchor": "SELECT doc_id, item_id, (instr(d.text, b.text) + 10)::BIGINT AS place FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE length(b.text) > 20 AND NOT contains(substring(d.text, instr(d.text, b.text) + 1), b.text)",
    "quote_anchor_whole": "SELECT doc_id, item_id, instr(d.text, b.text)::BIGINT AS place FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> '' AND NOT contains(substring(d.text, instr(d.text, b.text) + 1), b.text)",
    "body_fingerprint_dups": "WITH h AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\s+$', ''), '^\\s+', '') AS h FROM documents) SELECT min(doc_id) AS first, count(*) AS copies FROM h GROUP BY h HAVING count(*) > 1",
    "suspicious_title": "WITH a AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages), t AS (SELECT page_id, trim(CASE page_id % 3 WHEN 1 THEN string_split(t, ' ')[1] WHEN 2 THEN t || '.PDF' ELSE t END) AS t FROM a) SELECT page_id, t = '' OR regexp_matches(lower(t), '\\.(dvi|tex|pdf|docx?)$') OR starts_with(lower(t), 'nber working paper') OR starts_with(lower(t), 'working paper') OR starts_with(lower(t), 'microsoft word') OR starts_with(lower(t), 'untitled') OR starts_with(lower(t), 'draft') OR (NOT contains(t, ' ') AND length(t) <= 24) AS suspicious FROM t",
    "heading_fill": "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS under FROM conversations",
    "stable_ids": "SELECT doc_id, 'ce_' || substring(sha256(source || chr(31) || doc_id), 1, 20) AS evidence_id FROM documents",
}
