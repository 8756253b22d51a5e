"""Passages for a question: retrieval by several queries, one text once, one passage a job; the manifest of
sources, and whether an answer's citations hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import scalars as S
from marlstone.operators import search
from marlstone.operators.trigrams import Index, index_of
from marlstone.session import load
from marlstone.shared import written

#: Of notes that tie, the kind that is shown; others come last.
NOTE_KINDS = ("smart", "translated", "original", "mechanical", "transcript")
BODY_CHARS = 4000
MOST_SOURCES = 20


def _sha(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


FIELDS, FACTS = ("title", "section", "body"), ("job_id", "note_type", "artifact_sha256", "body_sha256")


def chunk_index(chunks: DataFrame, name: str) -> Index:
    """The index of chunks that passages() takes: it holds their bodies too, to give those that are shown."""
    return index_of(chunks, name, "chunk_id", FIELDS, (*FACTS, "body"))


def passages(chunks: DataFrame | Index, queries: list[str], k: int, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """place, job_id, note_type, chunk_id, score and body of a question's k passages at most.

    chunks: chunk_id, job_id, note_type, title, section, body, artifact_sha256, body_sha256, or an index of
    those; with that no body is read but the k that are shown. Each query's
    pool of chunks scores 1 / (60 + place) for their text; chunks of one job with equal digests of note and
    body are one text, shown by the kind that comes first in NOTE_KINDS; a text's best place in a query
    counts. Texts go by score, job, kind, note type and chunk; a job has one passage, from a chunk with a
    note type and both digests, its body cut at BODY_CHARS."""
    pool, indexed = min(100, max(k, 4 * k)), isinstance(chunks, Index)
    found = search.indexed_pools(chunks, queries, pool, *FACTS) if indexed else search.pools(chunks, queries, fields, "chunk_id", pool, (*FACTS, "body"))
    extra = ("chunk", "n") if indexed else ("body",)
    valid = _sha(F.col("artifact_sha256")) & _sha(F.col("body_sha256"))
    kind = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, NOTE_KINDS)), F.coalesce("note_type", F.lit(""))), F.lit(0)), F.lit(99))
    same = F.when(valid & (F.coalesce("job_id", F.lit("")) != ""), F.concat_ws("|", "job_id", "artifact_sha256", "body_sha256")).otherwise(F.concat_ws("|", F.lit(""), "chunk_id"))
    found = found.withColumns({"valid": valid, "kind": kind, "note_type": F.coalesce("note_type", F.lit("")), "same": same})
    shown = F.min_by(F.struct("job_id", "kind", "note_type", "chunk_id", "valid", *extra), F.struct("kind", "note_type", "chunk_id")).alias("x")
    best = found.groupBy("same", "query").agg(F.min("place").alias("place"))
    scores = best.groupBy("same").agg(F.round(F.sum(1.0 / (search.RRF_K + F.col("place"))), 9).alias("score"))
    texts = scores.join(found.groupBy("same").agg(shown), "same").select("score", "x.*")
    order = (F.desc("score"), F.asc("job_id"), F.asc("kind"), F.asc("note_type"), F.asc("chunk_id"))
    good = texts.filter("coalesce(job_id, '') <> '' and valid and note_type <> ''")
    one = good.withColumn("nth", F.row_number().over(Window.partitionBy("job_id").orderBy(*order))).filter("nth = 1")
    placed = one.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # k rows
    if indexed:
        placed = chunks.facts(written(placed, "placed"), "body")
    return placed.select("place", "job_id", "note_type", "chunk_id", "score", F.substring("body", 1, BODY_CHARS).alias("body"))


def queries_of(question: str, derived: list[str]) -> list[str]:
    """The derived queries, or the question as it is where there are none; nothing for an empty question."""
    return derived or ([question] if question.strip() else [])


def manifest(sources: DataFrame, task: str, place: str) -> DataFrame:
    """Sources of a task in order with their body in its normal form, digest, fingerprint and error: too many
    sources, an identity (job, note type, note, body) that stands before, a body that is not the one named."""
    body = S.body_text(F.col("body"))
    rows = sources.withColumn("body", body).withColumn("now", F.sha2("body", 256))
    print_ = F.sha2(S.canonical_json(artifact_sha256=F.col("artifact_sha256"), body_sha256=F.col("now"), job_id=F.col("job_id"), note_type=F.col("note_type")), 256)
    rows = rows.withColumn("source_fingerprint", print_)
    again = F.row_number().over(Window.partitionBy(task, "source_fingerprint").orderBy(place)) > 1
    count = F.count("*").over(Window.partitionBy(task))
    error = F.when(count > MOST_SOURCES, "too many sources").when(~_sha(F.col("artifact_sha256")), "no digest").when(F.col("body_sha256").isNotNull() & (F.col("body_sha256") != F.col("now")), "body digest differs").when(again, "duplicate source")
    index = F.row_number().over(Window.partitionBy(task).orderBy(place))
    return rows.withColumn("error", error).withColumn("index", index).drop("now", "body_sha256").withColumn("body_sha256", F.sha2("body", 256))


_MARK, _LOOSE = r"\[来源[1-9]\d*\]", r"\[来源[^\]\r\n]*\]"


def citations(answers: DataFrame, sources: DataFrame, task: str) -> tuple[DataFrame, DataFrame]:
    """Each citation of answers (task, answer) with its errors, and each task's state and measures.

    A citation is [来源N] with a number; other such brackets are malformed. It holds if the source (task,
    index, body) exists and the line it stands on, in the form of claims and without citations, is in the
    source's body in that form. coverage is the share of lines with two letters and more that cite. valid:
    no error and all such lines cite; unverified: no error; else invalid."""
    lines = answers.select(task, F.posexplode(F.split("answer", r"\r\n|\n|\r")).alias("line", "text"))
    claim = S.citation_text(F.regexp_replace("text", _MARK, ""))
    lines = lines.withColumn("claim", claim)
    cites = lines.select(task, "line", "claim", F.posexplode(F.regexp_extract_all("text", F.lit(f"({_MARK})"), F.lit(1))).alias("nth", "mark"))
    cites = cites.withColumn("index", F.regexp_extract("mark", r"(\d+)", 1).cast("int"))
    known = sources.select(task, "index", S.citation_text(F.col("body")).alias("_body"), F.lit(True).alias("_known"))
    error = F.when(F.col("_known").isNull(), "unknown_source_index").when((F.col("claim") == "") | ~F.contains("_body", F.col("claim")), "unsupported_claim")
    items = cites.join(known, [task, "index"], "left").select(task, "line", "nth", "index", "claim", error.alias("error"))
    letters = F.length(F.regexp_replace("claim", "[^A-Za-z一-鿿]", "")) >= 2
    marked = F.col("text").rlike(_MARK)
    loose = F.size(F.regexp_extract_all("text", F.lit(f"({_LOOSE})"), F.lit(1))) - F.size(F.regexp_extract_all("text", F.lit(f"({_MARK})"), F.lit(1)))
    per_line = lines.groupBy(task).agg(F.count(F.when(letters, 1)).alias("claims"), F.count(F.when(letters & marked, 1)).alias("cited"), F.sum(loose).alias("malformed"))
    per_item = items.groupBy(task).agg(F.count("*").alias("checked"), F.count(F.when(F.col("error") == "unknown_source_index", 1)).alias("unknown"), F.count(F.when(F.col("error") == "unsupported_claim", 1)).alias("unsupported"))
    both = per_line.join(per_item, task, "left").na.fill(0, ["checked", "unknown", "unsupported"])
    share = lambda a, b: F.when(b == 0, 0.0).otherwise(F.round(a / b, 6))
    n, refs = F.col("checked"), F.col("checked") + F.col("malformed")
    errors = F.array_compact(F.array(F.when(F.col("malformed") > 0, "malformed_citation"), F.when(n == 0, "missing_citations"), F.when(F.col("unknown") > 0, "unknown_source_index"), F.when(F.col("unsupported") > 0, "unsupported_claim")))
    covered = share(F.col("cited"), F.col("claims"))
    state = F.when(F.size(errors) > 0, "invalid").when(covered < 1, "unverified").otherwise("valid")
    return items, both.select(
        task, state.alias("state"), n.alias("checked"), F.array_join(F.when(state == "unverified", F.array(F.lit("uncited_claims"))).otherwise(errors), ",").alias("errors"),
        share(n, refs).alias("structural"), share(n - F.col("unknown"), n).alias("source"), share(n - F.col("unknown") - F.col("unsupported"), n).alias("claim"), covered.alias("coverage"),
    )


def evidence_ids(chunks: DataFrame, note: list[str], order: str, evidence: str, most: int = 20) -> DataFrame:
    """The evidence ids of each note's chunks in order, of equal ones the first, `most` at most: `ce_` and 64
    hex digits; what is no list of those gives none."""
    listed = S.json_list(F.get_json_object(evidence, "$.canonical_evidence_ids"))
    rows = chunks.select(*note, order, F.posexplode(listed).alias("_pos", "id")).filter(F.col("id").rlike("^ce_[0-9a-f]{64}$"))
    first = rows.groupBy(*note, "id").agg(F.min(F.struct(order, "_pos")).alias("at"))
    place = F.row_number().over(Window.partitionBy(*note).orderBy("at"))
    return first.withColumn("place", place).filter(F.col("place") <= most).select(*note, "place", "id")


QUERIES_ASKED = ("tion", "ment", "idiot", "ening")


def _chunks(s: SparkSession, d: str) -> DataFrame:
    """Documents as chunks of forty jobs; every seventh without the note's digest, every eleventh without a kind."""
    docs = load(s, d, "documents").filter("text is not null")
    kind = F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.element_at(F.array(*map(F.lit, (*NOTE_KINDS, "other"))), (F.col("doc_id") % 6 + 1).cast("int")))
    job = F.concat(F.lit("j"), (F.col("doc_id") % 40).cast("string"))
    return docs.select(
        F.format_string("c%09d", "doc_id").alias("chunk_id"), job.alias("job_id"), kind.alias("note_type"), F.col("source").alias("title"), F.col("lang").alias("section"), F.col("text").alias("body"),
        F.when(F.col("doc_id") % 7 != 0, F.sha2(job, 256)).alias("artifact_sha256"), F.sha2("text", 256).alias("body_sha256"),
    )


def ask_passages(s: SparkSession, d: str) -> DataFrame:
    return passages(chunk_index(_chunks(s, d), "chunks of documents"), list(QUERIES_ASKED), 12).select("place", "job_id", "note_type", "chunk_id", "score", F.sha2("body", 256).alias("digest"))


def ask_manifest(s: SparkSession, d: str) -> DataFrame:
    """Conversations as tasks, their turns as sources, some twice, some with a wrong digest."""
    turns = load(s, d, "conversations").filter("text is not null")
    rows = turns.unionByName(turns.filter("turn = 3").withColumn("turn", F.lit(10**6).cast("long")))
    digest = F.when(F.col("turn") == 5, F.lit("0" * 64)).when(F.col("turn") % 2 == 0, F.sha2(S.body_text(F.col("text")), 256))
    rows = rows.select("conv_id", "turn", F.lit("j").alias("job_id"), F.col("role").alias("note_type"), F.sha2(F.lit("a"), 256).alias("artifact_sha256"), digest.alias("body_sha256"), F.concat("text", F.lit("  \n")).alias("body"))
    return manifest(rows, "conv_id", "turn").select("conv_id", "index", "source_fingerprint", "error")


def _answers(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Items as tasks, with a source each of their text; answers that quote it whole, by number mod 6: rightly; a
    source that isn't there; a claim that isn't in it; a broken mark; no mark; a line more without one."""
    items = load(s, d, "benchmark").select("item_id", F.col("text").alias("body"), F.lit(1).alias("index"))
    quote, k = F.trim(F.regexp_replace("text", r"\s+", " ")), F.col("item_id") % 6
    answer = (
        F.when(k == 0, F.concat(F.lit("- **"), quote, F.lit("** [来源1]。"))).when(k == 1, F.concat(quote, F.lit(" [来源7]"))).when(k == 2, F.lit("unheard words [来源1]"))
        .when(k == 3, F.concat(quote, F.lit(" [来源1] and [来源x]"))).when(k == 4, quote).otherwise(F.concat(quote, F.lit(" [来源1]\n\nanother line\n--")))
    )
    return load(s, d, "benchmark").select("item_id", answer.alias("answer")), items


def ask_citations(s: SparkSession, d: str) -> DataFrame:
    return citations(*_answers(s, d), "item_id")[1]


def ask_citation_items(s: SparkSession, d: str) -> DataFrame:
    return citations(*_answers(s, d), "item_id")[0].select("item_id", "index", "error")


def note_evidence_ids(s: SparkSession, d: str) -> DataFrame:
    """Turns as chunks with the ids of all their words; conversations as notes, twenty ids at most."""
    ids = F.transform(F.split("text", " "), lambda w: F.concat(F.lit("ce_"), F.sha2(w, 256)))
    json = F.when(F.col("turn") % 6 == 5, F.lit("{broken")).otherwise(F.to_json(F.struct(F.array_append(ids, F.lit("ce_short")).alias("canonical_evidence_ids"))))
    rows = load(s, d, "conversations").filter("text is not null").select("conv_id", "turn", json.alias("evidence"))
    return evidence_ids(rows, ["conv_id"], "turn", "evidence", 20).withColumn("place", F.col("place").cast("long"))


def glossary_queries(s: SparkSession, d: str) -> DataFrame:
    """Queries of the items, glossary terms first."""
    items = load(s, d, "benchmark").filter("text is not null")
    terms = s.createDataFrame([("and the",), ("tion",), ("zzz",), (" ",)], "term string")
    return search.derived_queries(items, "item_id", "text", 4, terms)


QUERIES = {f.__name__: f for f in (ask_passages, ask_manifest, ask_citations, ask_citation_items, note_evidence_ids, glossary_queries)}

_H = "(length({c}) - length(replace({c}, '{q}', ''))) // {n}"
_STOPS = ", ".join(f"'{x}'" for x in search.STOP_WORDS)
_ANSWERS = """
WITH b AS (SELECT item_id, item_id % 6 AS k FROM benchmark)"""
ORACLES = {
    "ask_passages": "WITH d AS (SELECT doc_id, printf('c%09d', doc_id) AS chunk_id, 'j' || (doc_id % 40) AS job_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE ['smart', 'translated', 'original', 'mechanical', 'transcript', 'other'][(doc_id % 6 + 1)::INT] END AS nt, doc_id % 7 <> 0 AS valid, sha256(text) AS h, text, lower(source) AS a, lower(lang) AS b, lower(text) AS c FROM documents WHERE text IS NOT NULL),"
    " h AS (SELECT *, greatest(length(a) - 2, 0) + greatest(length(b) - 2, 0) + greatest(length(c) - 2, 0) AS dl, "
    + ", ".join(f"{_H.format(c='a', q=q, n=len(q))} + {_H.format(c='b', q=q, n=len(q))} + {_H.format(c='c', q=q, n=len(q))} AS f{k}" for k, q in enumerate(QUERIES_ASKED))
    + """ FROM d), u AS (SELECT *, unnest([0, 1, 2, 3]) AS q, unnest([f0, f1, f2, f3]) AS f FROM h),
st AS (SELECT q, count(*) AS n, count(*) FILTER (f > 0) AS df, avg(dl) AS av FROM u GROUP BY q),
r AS (SELECT u.*, round(-(CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) > 0 THEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / av)), 9) AS rank FROM u JOIN st ON u.q = st.q WHERE f > 0),
p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank, chunk_id) AS place FROM r QUALIFY place <= 48),
i AS (SELECT *, CASE WHEN valid THEN job_id || '|' || h ELSE chunk_id END AS same, coalesce(nullif(list_position(['smart', 'translated', 'original', 'mechanical', 'transcript'], nt), 0), 99) AS kind FROM p),
s AS (SELECT same, round(sum(1.0::DOUBLE / (60 + place)), 9) AS score FROM (SELECT same, q, min(place) AS place FROM i GROUP BY ALL) GROUP BY same),
x AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY same ORDER BY kind, nt, chunk_id) = 1),
g AS (SELECT x.*, score FROM x JOIN s ON s.same = x.same WHERE valid AND nt <> '' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY score DESC, kind, nt, chunk_id) = 1)
SELECT row_number() OVER (ORDER BY score DESC, job_id, kind, nt, chunk_id)::INT AS place, job_id, nt AS note_type, chunk_id, score, sha256(substring(text, 1, 4000)) AS digest FROM g ORDER BY score DESC, job_id, kind, nt, chunk_id LIMIT 12""",
    "ask_manifest": """
WITH t AS (SELECT conv_id, turn, role, text FROM conversations WHERE text IS NOT NULL UNION ALL SELECT conv_id, 1000000, role, text FROM conversations WHERE text IS NOT NULL AND turn = 3),
n AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+\\n', chr(10), 'g'), '\\s+$', ''), '^\\s+', '') AS body FROM t),
f AS (SELECT conv_id, turn, sha256('{"artifact_sha256":"' || sha256('a') || '","body_sha256":"' || sha256(body) || '","job_id":"j","note_type":"' || role || '"}') AS fp FROM n)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS index, fp AS source_fingerprint, CASE WHEN turn = 5 THEN 'body digest differs' WHEN row_number() OVER (PARTITION BY conv_id, fp ORDER BY turn) > 1 THEN 'duplicate source' END AS error FROM f""",
    "ask_citations": _ANSWERS
    + """ SELECT item_id, ['invalid', 'invalid', 'invalid', 'invalid', 'valid', 'unverified'][CASE k WHEN 0 THEN 5 WHEN 5 THEN 6 ELSE k END] AS state, CASE WHEN k = 4 THEN 0 ELSE 1 END::BIGINT AS checked,
  ['', 'unknown_source_index', 'unsupported_claim', 'malformed_citation,unsupported_claim', 'missing_citations', 'uncited_claims'][k + 1] AS errors, CASE k WHEN 3 THEN 0.5::DOUBLE WHEN 4 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS structural,
  CASE WHEN k IN (1, 4) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS source, CASE WHEN k IN (0, 5) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS claim, CASE k WHEN 4 THEN 0.0::DOUBLE WHEN 5 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS coverage FROM b""",
    "ask_citation_items": _ANSWERS + " SELECT item_id, CASE WHEN k = 1 THEN 7 ELSE 1 END AS index, CASE k WHEN 1 THEN 'unknown_source_index' WHEN 2 THEN 'unsupported_claim' WHEN 3 THEN 'unsupported_claim' END AS error FROM b WHERE k <> 4",
    "note_evidence_ids": """
WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS p FROM conversations WHERE text IS NOT NULL AND turn % 6 <> 5),
f AS (SELECT conv_id, w, min((turn, p)) AS t0 FROM w GROUP BY ALL)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY t0) AS place, 'ce_' || sha256(w) AS id FROM f QUALIFY place <= 20""",
    "glossary_queries": f"""
WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS query, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]+'), 1) AS pos FROM benchmark),
g AS (SELECT item_id, query, min(pos) AS pos FROM w WHERE length(query) >= 2 AND query NOT IN ({_STOPS}) GROUP BY ALL),
t AS (SELECT item_id, term AS query FROM benchmark, (VALUES ('and the'), ('tion')) v(term) WHERE contains(text, term)),
a AS (SELECT item_id, query, 0 AS k, NULL AS n, NULL AS pos FROM t UNION ALL SELECT item_id, query, 1, length(query), pos FROM g WHERE (item_id, query) NOT IN (SELECT (item_id, query) FROM t))
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY k, n DESC, pos, query))::INT AS place, query FROM a QUALIFY place <= 4""",
}
