"""Subtitle files, live comments and transcripts as rows, and cues joined to text. Column functions only:
a file is one string of one row, and its cues are exploded where it stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.textops import greedy_windows
from marlstone.session import load

_TIME = r"(\d{2}):(\d{2}):(\d{2})[,.](\d{3})"
_CUE = rf"{_TIME}\s*-->\s*{_TIME}"
_COMMENT = r"(?i)^Dialogue:\s*\d+,(\d+):(\d{2}):(\d{2})\.(\d{2}),\d+:\d{2}:\d{2}\.\d{2},(?:[^,]*,){6}(.*)"
_LINE = r"^\[(\d{2}):(\d{2})\]\s*(.*)"
BEAT = 30


def _seconds(line: Column, pattern: str, first: int, parts: int) -> Column:
    """Hours, minutes, seconds and their parts as seconds."""
    n = lambda k: F.regexp_extract(line, pattern, first + k).try_cast("double")
    return n(0) * 3600 + n(1) * 60 + n(2) + n(3) / parts


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def srt(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, index, start, end (seconds) and text of the cues of SubRip files. Blocks end at blank lines; one
    without a number, a time line or a text is passed over; a text of several lines keeps them."""
    blocks = files.select(key, F.posexplode(F.split(_trimmed(F.regexp_replace(text, "\r\n?", "\n")), r"\n\s*\n")).alias("block", "_b"))
    lines = blocks.select(key, "block", F.split(_trimmed(F.col("_b")), "\n").alias("_l")).filter(F.size("_l") >= 3)
    time = F.col("_l")[1]
    cues = lines.select(
        key, "block", F.trim(F.col("_l")[0]).try_cast("int").alias("index"), _seconds(time, _CUE, 1, 1000).alias("start"), _seconds(time, _CUE, 5, 1000).alias("end"),
        _trimmed(F.array_join(F.slice("_l", 3, F.size("_l")), "\n")).alias("text"),
    )
    return cues.filter("index is not null and start is not null and text <> ''")


def ass(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, start and text of the comments of ASS files: override tags in braces go, \\N is a space,
    what is empty then goes. Sort by start, then line."""
    lines = files.select(key, F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("line", "_l")).filter(F.col("_l").rlike(_COMMENT))
    body = F.trim(F.replace(F.regexp_replace(F.regexp_extract("_l", _COMMENT, 5), r"\{[^}]*\}", ""), F.lit("\\N"), F.lit(" ")))
    return lines.select(key, "line", _seconds(F.col("_l"), _COMMENT, 1, 100).alias("start"), body.alias("text")).filter("text <> ''")


def transcript(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, start and text of the lines `[MM:SS] text`; other lines go."""
    lines = files.select(key, F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("line", "_l")).filter(F.col("_l").rlike(_LINE))
    n = lambda k: F.regexp_extract("_l", _LINE, k)
    return lines.select(key, "line", (n(1).cast("int") * 60 + n(2).cast("int")).alias("start"), n(3).alias("text"))


def clock(seconds: Column) -> Column:
    """[MM:SS]; minutes go beyond 59."""
    s = F.floor(seconds)
    return F.format_string("[%02d:%02d]", F.floor(s / 60), s % 60)


def joined(texts: Column) -> Column:
    """Texts one after another, with a space between two ASCII letters or digits that would meet."""
    word = "[A-Za-z0-9]"
    glue = lambda acc, t: F.when(acc.rlike(f"{word}$") & t.rlike(f"^{word}"), F.lit(" ")).otherwise("")
    kept = F.filter(texts, lambda t: t.isNotNull() & (t != ""))
    # neighbours alone decide, so no text is copied again and again
    return F.array_join(F.transform(kept, lambda t, i: F.concat(F.when(i > 0, glue(F.element_at(kept, F.greatest(i, F.lit(1))), t)).otherwise(""), t)), "")


def segments(cues: DataFrame, key: str, start: str, text: str, seconds: float = 60.0) -> DataFrame:
    """key, window_start, cues and text of greedy windows of cues, their texts joined in order."""
    rows = cues.select(key, F.col(start).cast("double").alias("_at"), F.col(text).alias("_t"))
    ordered = F.array_sort(F.collect_list(F.struct("_at", "_t")))
    out = greedy_windows(rows, key, "_at", seconds).groupBy(key, "window_start").agg(F.count("*").alias("cues"), ordered.alias("_c"))
    return out.select(key, "window_start", "cues", joined(F.transform("_c", lambda c: c["_t"])).alias("text"))


def beats(cues: DataFrame, frames: DataFrame, comments: DataFrame, key: str, most: int = 20) -> DataFrame:
    """key, beat (of BEAT seconds), text, frames and comments of a timeline of three streams.

    cues and comments: at, text; frames: at, name, ocr. A beat's cue texts follow one another; of its
    frames those whose text stood in the beat before or was the last one kept go; then at most two frames
    with a text stay, or one frame if none has; of comments the first `most`."""
    beat = F.floor(F.col("at") / BEAT).alias("beat")
    said = cues.groupBy(key, beat).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda c: F.trim(c["text"])), "").alias("text"))
    shown = kept_frames(frames, key)
    shown = shown.groupBy(key, "beat").agg(F.array_sort(F.collect_list(F.struct((F.coalesce("ocr", F.lit("")) == "").alias("plain"), F.col("at"), F.col("name")))).alias("f"))
    full = F.filter("f", lambda x: ~x["plain"])
    some = F.when(F.size(full) > 0, F.slice(full, 1, 2)).otherwise(F.slice("f", 1, 1))
    shown = shown.select(key, "beat", F.array_join(F.transform(some, lambda x: x["name"]), ",").alias("frames"))
    heard = comments.groupBy(key, beat).agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("at", "text"))), 1, most), lambda c: c["text"]), " / ").alias("comments"))
    every = said.select(key, "beat").union(shown.select(key, "beat")).union(heard.select(key, "beat")).distinct()
    out = every.join(said, [key, "beat"], "left").join(shown, [key, "beat"], "left").join(heard, [key, "beat"], "left")
    return out.na.fill("", ["text", "frames", "comments"])


def kept_frames(frames: DataFrame, key: str) -> DataFrame:
    """frames with beat, without those whose text (ocr) is that of the frame with a text kept last or of
    one kept before in its beat. Frames without a text stay. Sorted frames pass in order through a fold
    that holds one beat's texts."""
    schema = frames.schema.add("beat", "long")

    def fold(batches):
        import pyarrow as pa

        now, last, seen = None, None, set()
        for batch in batches:
            keep, rows = [], zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (key, "at", "ocr")), strict=True)
            beat = [int(at // BEAT) for at in batch.column(batch.schema.get_field_index("at")).to_pylist()]
            for (k, _, ocr), b in zip(rows, beat, strict=True):
                if now is None or now[0] != k:
                    last = None
                if now != (k, b):
                    now, seen = (k, b), set()
                if ocr and (ocr == last or ocr in seen):
                    keep.append(False)
                    continue
                keep.append(True)
                if ocr:
                    seen.add(ocr)
                    last = ocr
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(beat, pa.int64())], [*batch.schema.names, "beat"]).filter(pa.array(keep, pa.bool_()))

    return frames.repartition(key).sortWithinPartitions(key, "at", "name").mapInArrow(fold, schema)


#: Marks of platforms and quotes on screen.
OCR_PLATFORM, OCR_PREFIX, OCR_CHARTS = "paken", "派克财经", ("usdt", "macd", "diff", "change")
_EDGES = r"-=_.,;:!?()\[\]{}<>|/\\'\"~`*+，。、：；！？（）【】《》"


#: What a noisy word holds at least, lowered: most words hold none of it and need no closer look.
_MAYBE = rf"[0-9]|{OCR_PLATFORM}|{OCR_PREFIX}|{'|'.join(OCR_CHARTS)}|ma\(|[bil1]{{5}}|^[{_EDGES}]*$"


def clean_ocr(text: Column) -> Column:
    """Words of a screen without what is noise: only marks, a platform's name in its misread forms, chart
    labels and prices, long numbers without a Chinese character."""

    def noise(word: Column) -> Column:
        t, low = word["t"], word["low"]
        charts = low.startswith("ma(")
        for x in OCR_CHARTS:
            charts = charts | F.contains(low, F.lit(x))
        price = ~t.rlike("[一-鿿]") & (t.rlike(r"^\d[\d.,:]{4,}$") | t.rlike(r"^\d[\d.,]*[KkMm]$"))
        return (t == "") | F.contains(low, F.lit(OCR_PLATFORM)) | t.startswith(OCR_PREFIX) | (F.contains(low, F.lit("b")) & low.rlike("^[bil1]{5,}$")) | charts | low.rlike(r"^[a-z]\d[\d.,]+$") | price

    def bare(word: Column) -> Column:  # an array of one, so that a word is stripped once
        return F.transform(F.array(F.regexp_replace(word, f"^[{_EDGES}]+|[{_EDGES}]+$", "")), lambda t: F.struct(t.alias("t"), F.lower(t).alias("low")))

    return F.array_join(F.filter(F.split(F.trim(text), r"\s+"), lambda w: ~(F.lower(w).rlike(_MAYBE) & F.exists(bare(w), noise))), " ")


def confident(boxes: Column, least: float = 0.6) -> Column:
    """Texts of the recognised boxes (text, score) of that score and more, in order."""
    return F.array_join(F.transform(F.filter(boxes, lambda b: b["score"] >= least), lambda b: b["text"]), " ")


def _cues(s: SparkSession, d: str) -> DataFrame:
    """Sentences of turns: id (of the turn), i, text; each lasts three seconds, every three and a half."""
    turns = load(s, d, "conversations").filter("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text"))
    parts = F.filter(F.transform(F.split("text", r"[.!?\n]+"), lambda x: F.trim(x)), lambda x: x != "")
    return turns.select("id", parts.alias("parts")).filter(F.size("parts") > 0)


def _stamp(at: Column, mark: str, digits: int) -> Column:
    whole = F.floor(at)
    return F.format_string(f"%02d:%02d:%02d{mark}%0{digits}d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60, F.round((at - whole) * 10**digits).cast("long"))


def srt_cues(s: SparkSession, d: str) -> DataFrame:
    """Turns written as SubRip files, every fifth block with a broken number, and read back."""
    block = lambda x, i: F.concat(F.when(i % 5 == 4, F.lit("x")).otherwise((i + 1).cast("string")), F.lit("\n"), _stamp(i * 3.5, ",", 3), F.lit(" --> "), _stamp(i * 3.5 + 3, ".", 3), F.lit("\n"), x, F.lit("\nsecond line\n"))
    files = _cues(s, d).select("id", F.array_join(F.transform("parts", block), "\n").alias("text"))
    return srt(files, "id", "text").select("id", "index", "start", "end", F.sha2("text", 256).alias("digest"))


def ass_comments(s: SparkSession, d: str) -> DataFrame:
    line = lambda x, i: F.concat(F.when(i % 4 == 3, F.lit("Comment: 0,")).otherwise(F.lit("Dialogue: 0,")), _stamp(i * 3.5, ".", 2), F.lit(",0:00:09.00,Default,,0,0,0,,{\\move(1,2)}"), F.replace(x, F.lit(" "), F.lit("\\N")), F.lit("{\\i0}"))
    files = _cues(s, d).select("id", F.concat(F.lit("[Events]\n"), F.array_join(F.transform("parts", line), "\n"), F.lit("\nDialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,{only tags}")).alias("text"))
    return ass(files, "id", "text").select("id", "start", F.sha2("text", 256).alias("digest"))


def transcript_lines(s: SparkSession, d: str) -> DataFrame:
    line = lambda x, i: F.concat(F.when(i % 3 == 2, F.lit("(no time)")).otherwise(clock(i * 61)), F.lit(" "), x)
    files = _cues(s, d).select("id", F.array_join(F.transform("parts", line), "\n").alias("text"))
    return transcript(files, "id", "text").select("id", "start", F.sha2("text", 256).alias("digest"))


def _timed(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "conversations").filter("text is not null").select("conv_id", "turn", (F.col("turn") * 25 + F.char_length("text") % 20).cast("double").alias("at"), "text", "role")


def cue_segments(s: SparkSession, d: str) -> DataFrame:
    return segments(_timed(s, d), "conv_id", "at", "text").select("conv_id", "window_start", "cues", F.sha2("text", 256).alias("digest"))


def timeline_beats(s: SparkSession, d: str) -> DataFrame:
    """Turns of users as cues, of assistants as two frames of their whole text a second
    apart (every fourth without), the rest as comments."""
    rows = _timed(s, d)
    cues, comments = rows.filter("role = 'user'").select("conv_id", "at", "text"), rows.filter("role not in ('user', 'assistant')").select("conv_id", "at", "text")
    frames = rows.filter("role = 'assistant'").select("conv_id", "at", F.col("turn").cast("string").alias("name"), F.when(F.col("turn") % 4 != 0, F.col("text")).otherwise("").alias("ocr"))
    frames = frames.unionByName(frames.withColumns({"at": F.col("at") + 1, "name": F.concat("name", F.lit("b"))}))
    return beats(cues, frames, comments, "conv_id").select("conv_id", "beat", F.sha2("text", 256).alias("digest"), "frames", "comments")


def cue_range_join(s: SparkSession, d: str) -> DataFrame:
    """Cues and segments of the same bounds in milliseconds: segments of a cue each, every seventh moved."""
    cues = _cues(s, d).select("id", F.posexplode("parts").alias("i", "text")).select("id", "i", (F.col("i") * 3500).alias("start_ms"), (F.col("i") * 3500 + 3000).alias("end_ms"))
    parts = cues.select("id", (F.col("start_ms") + F.when(F.col("i") % 7 == 6, 1).otherwise(0)).alias("start_ms"), "end_ms", F.col("i").alias("segment"))
    return cues.join(parts, ["id", "start_ms", "end_ms"]).groupBy("id").agg(F.count("*").alias("matched"), F.max("segment").alias("last"))


def ocr_words(s: SparkSession, d: str) -> DataFrame:
    """Whole documents between marks, labels of charts and prices, cleaned."""
    noisy = F.concat(F.lit("-- MACD(12) "), F.col("text"), F.lit(" 132.401.98 2.699K O22.98 bilibi1 USDT/x ..."))
    return load(s, d, "documents").select("doc_id", F.sha2(clean_ocr(noisy), 256).alias("digest"))


def ocr_confident(s: SparkSession, d: str) -> DataFrame:
    boxes = F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("text"), ((i * 37 % 100) / 100.0).alias("score")))
    return load(s, d, "documents").select("doc_id", F.sha2(confident(boxes), 256).alias("digest"))


QUERIES = {f.__name__: f for f in (srt_cues, ass_comments, transcript_lines, cue_segments, timeline_beats, cue_range_join, ocr_words, ocr_confident)}

_PARTS = "c AS (SELECT conv_id * 1000 + turn AS id, list_filter(list_transform(string_split_regex(text, '[.!?\\n]+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS parts FROM conversations WHERE text IS NOT NULL), p AS (SELECT id, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS i FROM c)"
_TIMED = "r AS (SELECT conv_id, turn, (turn * 25 + length(text) % 20)::DOUBLE AS t0, text, role FROM conversations WHERE text IS NOT NULL)"
ORACLES = {
    "srt_cues": f"WITH {_PARTS} SELECT id, (i + 1)::INT AS index, i * 3.5::DOUBLE AS start, i * 3.5::DOUBLE + 3 AS end, sha256(text || chr(10) || 'second line') AS digest FROM p WHERE i % 5 <> 4",
    "ass_comments": f"WITH {_PARTS} SELECT id, i * 3.5::DOUBLE AS start, sha256(text) AS digest FROM p WHERE i % 4 <> 3",
    "transcript_lines": f"WITH {_PARTS} SELECT id, (i * 61)::INT AS start, sha256(text) AS digest FROM p WHERE i % 3 <> 2",
    "cue_segments": f"""
WITH RECURSIVE {_TIMED}, c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY t0, text) AS i FROM r),
w AS (SELECT conv_id, i, t0, text, t0 AS w FROM c WHERE i = 1 UNION ALL SELECT c.conv_id, c.i, c.t0, c.text, CASE WHEN c.t0 - w.w >= 60 THEN c.t0 ELSE w.w END FROM w JOIN c ON c.conv_id = w.conv_id AND c.i = w.i + 1),
g AS (SELECT *, CASE WHEN regexp_matches(lag(text) OVER (PARTITION BY conv_id, w ORDER BY i), '[A-Za-z0-9]$') AND regexp_matches(text, '^[A-Za-z0-9]') THEN ' ' ELSE '' END AS glue FROM w)
SELECT conv_id, w AS window_start, count(*) AS cues, sha256(string_agg(glue || text, '' ORDER BY i)) AS digest FROM g GROUP BY conv_id, w""",
    "timeline_beats": f"""
WITH RECURSIVE {_TIMED},
b AS (SELECT *, floor(t0 / 30)::BIGINT AS beat FROM r),
g AS (SELECT conv_id, t0, turn::VARCHAR AS name, CASE WHEN turn % 4 <> 0 THEN text ELSE '' END AS ocr FROM b WHERE role = 'assistant'),
f AS (SELECT conv_id, floor(t0 / 30)::BIGINT AS beat, t0, name, ocr, row_number() OVER (PARTITION BY conv_id ORDER BY t0, name) AS i FROM (FROM g UNION ALL SELECT conv_id, t0 + 1, name || 'b', ocr FROM g)),
k AS (SELECT *, true AS kept, CASE WHEN ocr <> '' THEN ocr END AS last, CASE WHEN ocr <> '' THEN [ocr] ELSE []::VARCHAR[] END AS seen FROM f WHERE i = 1
      UNION ALL
      SELECT f.*, NOT x.gone, CASE WHEN f.ocr = '' OR x.gone THEN k.last ELSE f.ocr END, CASE WHEN f.ocr = '' OR x.gone THEN x.seen ELSE list_append(x.seen, f.ocr) END
      FROM k JOIN f ON f.conv_id = k.conv_id AND f.i = k.i + 1, LATERAL (SELECT CASE WHEN f.beat = k.beat THEN k.seen ELSE []::VARCHAR[] END AS seen, f.ocr <> '' AND (f.ocr = coalesce(k.last, '') OR (f.beat = k.beat AND list_contains(k.seen, f.ocr))) AS gone) x),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, beat ORDER BY ocr = '', t0, name) AS nth, count(*) FILTER (ocr <> '') OVER (PARTITION BY conv_id, beat) AS texts FROM k WHERE kept),
s AS (SELECT conv_id, beat, string_agg(name, ',' ORDER BY nth) AS frames FROM t WHERE (texts > 0 AND ocr <> '' AND nth <= 2) OR (texts = 0 AND nth = 1) GROUP BY ALL),
u AS (SELECT conv_id, beat, string_agg(trim(text, ' '), '' ORDER BY t0, text) AS text FROM b WHERE role = 'user' GROUP BY ALL),
m AS (SELECT conv_id, beat, string_agg(text, ' / ' ORDER BY t0, text) AS comments FROM b WHERE role NOT IN ('user', 'assistant') GROUP BY ALL),
e AS (SELECT conv_id, beat FROM s UNION SELECT conv_id, beat FROM u UNION SELECT conv_id, beat FROM m)
SELECT conv_id, beat, sha256(coalesce(text, '')) AS digest, coalesce(frames, '') AS frames, coalesce(comments, '') AS comments FROM e LEFT JOIN u USING (conv_id, beat) LEFT JOIN s USING (conv_id, beat) LEFT JOIN m USING (conv_id, beat)""",
    "cue_range_join": f"WITH {_PARTS} SELECT id, count(*) AS matched, max(i)::INT AS last FROM p WHERE i % 7 <> 6 GROUP BY id",
    "ocr_words": r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT doc_id, list_filter(w, lambda x: NOT (trim(x, '-=_.,;:!?()[]{}<>|/\''"~`*+') = '' OR regexp_matches(lower(trim(x, '-=_.,;:!?()[]{}<>|/\''"~`*+')), 'paken|usdt|macd|diff|change|^[a-z][0-9][0-9.,]+$|^ma\(')
  OR (contains(lower(x), 'b') AND regexp_matches(lower(trim(x, '-=_.,;:!?()[]{}<>|/\''"~`*+')), '^[bil1]{5,}$')) OR regexp_matches(trim(x, '-=_.,;:!?()[]{}<>|/\''"~`*+'), '^[0-9][0-9.,:]{4,}$|^[0-9][0-9.,]*[KkMm]$'))) AS w FROM w)
SELECT doc_id, sha256(array_to_string(w, ' ')) AS digest FROM n""",
    "ocr_confident": "SELECT doc_id, sha256(coalesce(string_agg(w, ' ' ORDER BY i) FILTER (i * 37 % 100 >= 60), '')) AS digest FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM documents) GROUP BY doc_id",
}
