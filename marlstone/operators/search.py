"""Substring search with BM25 ranks, retrieval by several queries with rank fusion, citations, metrics.

Statistics are those of the whole table, before filters, so that a row has the same rank under any
filter. Every order is total: ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators.textops import holding, scanned
from marlstone.operators.trigrams import Index, index_of
from marlstone.session import load
from marlstone.shared import written

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
RRF_K = 60


def _route(query: str) -> tuple[str, str]:
    """The cleaned query and how it is searched: not at all under two characters, two Chinese ones by
    plain containment in the order of keys, other ones under three not at all, else by BM25."""
    q = " ".join(query.replace("\0", "").split())
    if len(q) == 2 and all("一" <= c <= "鿿" for c in q):
        return q, "plain"
    return q, "none" if len(q) < 3 else "bm25"


def _hits(c: str, query: str, route: str) -> Column:
    """Overlapping occurrences of the query in a column; under the plain route 1 if there is any."""
    if route == "plain":
        return F.contains(c, F.lit(query)).cast("long")
    folded = _folded(query)
    if any(folded.startswith(folded[k:]) for k in range(1, len(folded))):
        return T.occurrences(T.fold(F.col(c)), folded)
    # occurrences that can't overlap are as many as cutting them out takes lengths of the query
    text = T.fold(F.col(c))
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(folded), F.lit("")))) / len(folded)).cast("long")


def _folded(query: str) -> str:
    return query.lower().replace("ς", "σ")


def _scores(hits: DataFrame, routes: list[tuple[str, str]], n: Column, average: Column, df: Column) -> DataFrame:
    """hits (with _h, each query's hits, and _dl, the length) with ranks by BM25."""
    norm = K1 * (1 - B + B * F.col("_dl") / average)

    def rank(k: int) -> Column:
        f = F.col("_h")[k]
        idf = F.log((n - df[k] + 0.5) / (df[k] + 0.5))
        score = F.round(-F.when(idf > 0, idf).otherwise(IDF_FLOOR) * f * (K1 + 1) / (f + norm), 9)
        return F.when(f > 0, score if routes[k][1] == "bm25" else F.lit(0.0))

    return hits.withColumn("ranks", F.array(*map(rank, range(len(routes)))))


def ranks(rows: DataFrame, queries: list[str], fields: tuple[str, ...]) -> DataFrame:
    """rows with ranks: an array of each query's rank of the row (least is best), null where it has no hit.

    One pass over the texts counts the hits of all queries for the statistics, one ranks; statistics are
    those of all rows. The counts come out of a generator, so that no filter makes them anew."""
    routes = [_route(q) for q in queries]
    total = lambda parts: sum(parts[1:], parts[0])
    hits = [total([F.coalesce(_hits(c, q, how), F.lit(0)) for c in fields]) if how != "none" else F.lit(0).cast("long") for q, how in routes]
    length = total([F.greatest(F.coalesce(F.char_length(c), F.lit(0)) - 2, F.lit(0)) for c in fields])
    counted = rows.select("*", F.inline(F.array(F.struct(F.array(*hits).alias("_h"), length.alias("_dl")))))
    of = F.array(*(F.count(F.when(F.col("_h")[k] > 0, 1)) for k in range(len(queries))))
    stats = counted.agg(F.count("*").alias("_n"), of.alias("_df"), F.avg("_dl").alias("_avg"))
    scored = counted.filter(F.exists("_h", lambda h: h > 0)).crossJoin(F.broadcast(stats))  # stats: one row
    return _scores(scored, routes, F.col("_n"), F.col("_avg"), F.col("_df")).drop("_h", "_dl", "_n", "_df", "_avg")


def indexed_ranks(index: Index, queries: list[str], *keep: str) -> DataFrame:
    """chunk and n (a document's place in the index), its key, the columns to keep, and ranks as ranks() has
    them, by an index of the texts: the hits are written once, the statistics come from them."""
    routes = [_route(q) for q in queries]
    hits = written(index.hits([(_folded(q), how) for q, how in routes]), "hits")
    df = hits.agg(F.array(*(F.count(F.when(F.col("hits")[k] > 0, 1)) for k in range(len(queries))))).first()[0]
    found = index.facts(hits.withColumnRenamed("hits", "_h"), index.key, *keep, "size").withColumnRenamed("size", "_dl")
    return _scores(found, routes, F.lit(index.rows), F.lit(index.average), F.array(*map(F.lit, df))).drop("_h", "_dl")


def bm25(rows: DataFrame, query: str, fields: tuple[str, ...]) -> DataFrame:
    """rows with a hit of the query as a contiguous, case-folded substring, and rank (least is best)."""
    return ranks(rows, [query], fields).withColumn("rank", F.col("ranks")[0]).drop("ranks")


def search(rows: DataFrame, query: str, fields: tuple[str, ...], key: str, where: Column | None = None) -> DataFrame:
    """Ranked rows of a query by its route."""
    out = rows.limit(0).withColumn("rank", F.lit(0.0)) if _route(query)[1] == "none" else bm25(rows, query, fields)
    return out if where is None else out.filter(where)


def indexed_search(index: Index, query: str, *keep: str, where: Column | None = None) -> DataFrame:
    """The key, the columns to keep and rank of a query's hits by its route."""
    out = indexed_ranks(index, [query], *keep).select(index.key, *keep, F.col("ranks")[0].alias("rank"))
    return out if where is None else out.filter(where)


def top(ranked: DataFrame, key: str, limit: int, offset: int = 0) -> DataFrame:
    return ranked.orderBy("rank", key).offset(offset).limit(limit)


def pools(rows: DataFrame, queries: list[str], fields: tuple[str, ...], key: str, pool: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """key (and the columns to keep), query (its number) and place of each query's `pool` best rows."""
    found = ranks(rows, queries, fields).select(key, *keep, F.posexplode("ranks").alias("query", "rank")).filter("rank is not null")
    place = F.row_number().over(Window.partitionBy("query").orderBy("rank", key))
    return found.withColumn("place", place).filter(F.col("place") <= pool).drop("rank")


def indexed_pools(index: Index, queries: list[str], pool: int, *keep: str) -> DataFrame:
    """What pools() gives, by an index, with the documents' places in it."""
    found = indexed_ranks(index, queries, *keep).select("chunk", "n", index.key, *keep, F.posexplode("ranks").alias("query", "rank")).filter("rank is not null")
    place = F.row_number().over(Window.partitionBy("query").orderBy("rank", index.key))
    return found.withColumn("place", place).filter(F.col("place") <= pool).drop("rank")


def fuse(rows: DataFrame | Index, queries: list[str], fields: tuple[str, ...], key: str, k: int) -> DataFrame:
    """Reciprocal rank fusion over the queries' pools: sum of 1 / (60 + rank), best first."""
    pool = min(100, max(k, 4 * k))
    found = indexed_pools(rows, queries, pool) if isinstance(rows, Index) else pools(rows, queries, fields, key, pool)
    return found.groupBy(key).agg(F.round(F.sum(1.0 / (RRF_K + F.col("place"))), 9).alias("score"), F.count("*").alias("n_queries")).orderBy(F.desc("score"), key).limit(k)


#: Words that are no query.
STOP_WORDS = ("the", "a", "an", "of", "to", "in", "is", "are", "and", "or", "for", "what", "how", "why", "which", "this", "that", "with", "about", "between", "do", "does", "can", "vs", "versus", "compare", "difference")
#: The same of Chinese characters; shorter ones are left out by their length.
CJK_STOP_WORDS = ("一个", "什么", "怎么", "如何", "为什么", "哪些", "这个", "那个", "可以", "他们", "我们", "你们", "以及", "或者", "还是", "因为", "所以", "但是", "关于", "对于", "通过", "进行", "区别", "差异", "比较", "之间")
CJK_WINDOWS = (4, 3, 2)


def derived_queries(questions: DataFrame, key: str, text: str, most: int = 6, glossary: DataFrame | None = None) -> DataFrame:
    """The search queries of a question, `most` of them: first the glossary's terms (column term) that it
    holds, by name; then its distinct words of two characters and more, no stop words, longest first, then
    in order. Words are runs of letters and digits, and of runs of Chinese characters the whole, if no
    longer than the longest window, and the windows shorter than the run."""
    runs = questions.select(F.col(key), F.posexplode(F.regexp_extract_all(F.lower(text), F.lit("([一-鿿]+|[a-z0-9]+)"), F.lit(1))).alias("pos", "run"))
    n = F.length("run")
    sizes = F.filter(F.array(*(F.lit(w) for w in CJK_WINDOWS)), lambda w: w < n)
    sizes = F.when(F.col("run").rlike("^[a-z0-9]"), F.array(n)).when(n <= max(CJK_WINDOWS), F.concat(F.array(n), sizes)).otherwise(sizes)
    cut = runs.select(key, "pos", "run", F.explode(sizes).alias("size"))
    cut = cut.select(key, "pos", "run", "size", F.explode(F.sequence(F.lit(1), F.length("run") - F.col("size") + 1)).alias("at"))
    words = cut.select(key, F.substring("run", F.col("at"), F.col("size")).alias("query"), F.struct("pos", (-F.col("size")).alias("size"), "at").alias("pos"))
    words = words.filter((F.length("query") >= 2) & ~F.col("query").isin(*STOP_WORDS, *CJK_STOP_WORDS)).groupBy(key, "query").agg(F.min("pos").alias("pos")).withColumn("term", F.lit(1))
    if glossary is not None:
        held = scanned(questions, [key], text, glossary.select(F.trim("term").alias("_term")), "_term").select(key, F.lower("_term").alias("query")).distinct()
        words = words.join(held, [key, "query"], "left_anti").unionByName(held.withColumn("term", F.lit(0)), allowMissingColumns=True)
    length = F.when(F.col("term") == 1, F.length("query"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("term", F.desc(length), "pos", "query"))
    return words.withColumn("place", place).filter(F.col("place") <= most).select(key, "place", "query")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("body"), "lang")


FIELDS = ("title", "body")


def _index(spark: SparkSession, d: str) -> Index:
    return index_of(_documents(spark, d), "documents", "doc_id", FIELDS, ("lang",))


def search_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return top(indexed_search(_index(spark, d), "tion"), "doc_id", 20).select("doc_id", "rank")


def search_scanned_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same without an index, by a scan of all texts."""
    return top(search(_documents(spark, d), "tion", FIELDS, "doc_id"), "doc_id", 20).select("doc_id", "rank")


def search_filtered_total(spark: SparkSession, d: str) -> DataFrame:
    hits = indexed_search(_index(spark, d), "ment", "lang", where=F.col("lang") == "fr")
    return hits.agg(F.count("*").alias("total"), F.round(F.min("rank"), 9).alias("best"))


def search_page(spark: SparkSession, d: str) -> DataFrame:
    return top(indexed_search(_index(spark, d), "ment", "lang", where=F.col("lang") == "fr"), "doc_id", 10, 10).select("doc_id", "rank")


def search_reliable_only(spark: SparkSession, d: str) -> DataFrame:
    good = load(spark, d, "labels").filter("quality = 1").select("doc_id")
    return top(indexed_search(_index(spark, d), "tion").join(good, "doc_id", "left_semi"), "doc_id", 15).select("doc_id", "rank")


def two_character_search(spark: SparkSession, d: str) -> DataFrame:
    """Texts with ten letters turned into Chinese characters, searched for two of those: by route, in the
    order of keys, every hit of rank 0."""
    rows = _documents(spark, d).withColumn("body", F.translate("body", "abcdefghij", "甲乙丙丁戊己庚辛壬癸"))
    return top(search(rows, " 戊\0甲 ", FIELDS, "doc_id"), "doc_id", 50).select("doc_id", "rank")


def short_query_substring(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).filter(F.contains("body", F.lit("ça"))).select("doc_id").orderBy("doc_id").limit(50)


def substring_snippet(spark: SparkSession, d: str) -> DataFrame:
    hits = _documents(spark, d).filter(F.contains("body", F.lit("License")))
    return hits.select("doc_id", T.snippet(F.col("body"), "License").alias("snippet"))


def ask_derive_queries(spark: SparkSession, d: str) -> DataFrame:
    return derived_queries(load(spark, d, "benchmark"), "item_id", "text")


def ask_rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fuse(_index(spark, d), ["tion", "ment", "idiot", "ening"], FIELDS, "doc_id", 20)


def quality(ranked: DataFrame, truth: DataFrame, questions: DataFrame, *by: str) -> DataFrame:
    """Measures of ranked lists against what is relevant, over all questions and by each of `by`.

    questions: q and the columns of by; ranked: q, id, place, body (a text's digest); truth: q, id.
    n, answerable (questions with relevant texts), recall at 1, 3, 5 and 10 (share of the relevant that is
    found, averaged over answerable questions), mrr_at_10, no_hit (answerable questions without any
    result), false_positive (other questions with one), coverage_at_8 (answerable questions whose first
    eight hold a relevant text) and duplicates (results whose text stands higher in the list)."""
    hits = ranked.join(truth.withColumn("good", F.lit(1)), ["q", "id"], "left")
    again = F.row_number().over(Window.partitionBy("q", "body").orderBy("place")) > 1
    hits = hits.withColumn("again", again)
    at = [F.count(F.when(F.col("place") <= k, F.col("good"))).alias(f"at_{k}") for k in (1, 3, 5, 8, 10)]
    per = hits.groupBy("q").agg(*at, F.min(F.when(F.col("good") == 1, F.col("place"))).alias("first"), F.count("*").alias("results"), F.count(F.when(F.col("again"), 1)).alias("repeats"))
    all_ = questions.join(truth.groupBy("q").agg(F.count("*").alias("relevant")), "q", "left").join(per, "q", "left").na.fill(0, ["relevant", "results", "repeats", *(f"at_{k}" for k in (1, 3, 5, 8, 10))])
    known = F.col("relevant") > 0
    part = lambda x: F.round(F.avg(F.when(known, x)), 6)
    measures = [
        F.count("*").alias("n"), F.count(F.when(known, 1)).alias("answerable"),
        *(part(F.col(f"at_{k}") / F.col("relevant")).alias(f"recall_at_{k}") for k in (1, 3, 5, 10)),
        part(F.when(F.col("first") <= 10, 1.0 / F.col("first")).otherwise(0.0)).alias("mrr_at_10"),
        part(F.when(F.col("results") == 0, 1.0).otherwise(0.0)).alias("no_hit"),
        F.round(F.avg(F.when(~known, F.when(F.col("results") > 0, 1.0).otherwise(0.0))), 6).alias("false_positive"),
        part(F.when(F.col("at_8") > 0, 1.0).otherwise(0.0)).alias("coverage_at_8"),
        F.round(F.sum("repeats") / F.sum("results"), 6).alias("duplicates"),
    ]
    cuts = [F.lit("all").alias("cut"), *(F.concat_ws("=", F.lit(c), F.col(c).cast("string")).alias("cut") for c in by)]
    return all_.withColumn("cut", F.explode(F.array(*cuts))).groupBy("cut").agg(*measures)


def word_ranks(questions: DataFrame, docs: DataFrame, most: int) -> DataFrame:
    """q, id, place and body of the `most` best texts for each question's derived queries as whole words:
    those with more of them first, then shorter ones, then by id. questions: q, text; docs: id, text."""
    asked = derived_queries(questions, "q", "text").select("q", F.col("query").alias("word"))
    words = docs.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([一-鿿]+|[a-z0-9]+)"), F.lit(1)))).alias("word"))
    found = words.join(asked, "word").groupBy("q", "id").agg(F.count("*").alias("n")).join(docs.select("id", F.length("text").alias("size"), F.sha2("text", 256).alias("body")), "id")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("n"), "size", "id"))
    return found.withColumn("place", place).filter(F.col("place") <= most).select("q", "id", "place", "body")


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """For each benchmark item the ten best documents for the queries derived from its whole text, against
    the documents that hold it word for word; over all and by the item's number, even or odd."""
    items = load(spark, d, "benchmark").select(F.col("item_id").alias("q"), "text", (F.col("item_id") % 2).alias("parity"))
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    truth = holding(docs, items.select("q", F.col("text").alias("quote")), "text", "quote", "id", "q").select("q", "id")
    return quality(word_ranks(items, docs, 10), truth, items.select("q", "parity"), "parity")


def citation_check(spark: SparkSession, d: str) -> DataFrame:
    """Quoted lines of assistant turns: valid where the line is in another turn of the conversation."""
    turns = load(spark, d, "conversations").filter("text is not null")
    lines = turns.filter("role = 'assistant'").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "claim")).filter(F.char_length("claim") >= 12)
    source = turns.select("conv_id", F.col("turn").alias("other"), F.col("text").alias("body"))
    near = lines.join(source, "conv_id").filter((F.col("other") != F.col("turn")) & F.contains("body", F.col("claim"))).select("conv_id", "turn", "line").distinct().withColumn("found", F.lit(1))
    per = lines.join(near, ["conv_id", "turn", "line"], "left").groupBy("conv_id").agg(F.count("*").alias("claims"), F.count("found").alias("supported"))
    return per.withColumn("coverage", F.round(F.col("supported") / F.col("claims"), 6)).withColumn("status", F.when(F.col("supported") == F.col("claims"), "verified").otherwise("unverified"))


_HITS = "(length({c}) - length(replace({c}, '{q}', ''))) // {n}"


def _bm25_sql(q: str) -> str:
    f = " + ".join(_HITS.format(c=f"lower({c})", q=q, n=len(q)) for c in ("source", "text"))
    return f"""
WITH s AS (SELECT doc_id, lang, {f} AS f, greatest(length(source) - 2, 0) + greatest(length(text) - 2, 0) AS dl FROM documents),
st AS (SELECT count(*) AS n, count(*) FILTER (f > 0) AS df, avg(dl) AS av FROM s),
r AS (SELECT doc_id, lang, round(-(CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) > 0 THEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END)
        * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / av)), 9) AS rank FROM s, st WHERE f > 0)"""


_RRF = "\n".join(
    [
        "WITH h AS (SELECT doc_id, greatest(length(source) - 2, 0) + greatest(length(text) - 2, 0) AS dl, "
        + ", ".join(f"{_HITS.format(c='lower(source)', q=q, n=len(q))} + {_HITS.format(c='lower(text)', q=q, n=len(q))} AS f{k}" for k, q in enumerate(("tion", "ment", "idiot", "ening")))
        + " FROM documents), u AS (SELECT doc_id, dl, unnest([0, 1, 2, 3]) AS q, unnest([f0, f1, f2, f3]) AS f FROM h),",
        "st AS (SELECT q, count(*) AS n, count(*) FILTER (f > 0) AS df, avg(dl) AS av FROM u GROUP BY q),",
        "r AS (SELECT doc_id, u.q, round(-(CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) > 0 THEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END)"
        " * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / av)), 9) AS rank FROM u JOIN st ON u.q = st.q WHERE f > 0),",
        "p AS (SELECT doc_id, q, row_number() OVER (PARTITION BY q ORDER BY rank, doc_id) AS place FROM r)",
        "SELECT doc_id, round(sum(1.0::DOUBLE / (60 + place)), 9) AS score, count(*) AS n_queries FROM p WHERE place <= 80 GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20",
    ]
)

QUERIES = {
    "search_bm25_topk": search_bm25_topk,
    "search_scanned_topk": search_scanned_topk,
    "search_filtered_total": search_filtered_total,
    "search_page": search_page,
    "search_reliable_only": search_reliable_only,
    "short_query_substring": short_query_substring,
    "two_character_search": two_character_search,
    "substring_snippet": substring_snippet,
    "ask_derive_queries": ask_derive_queries,
    "ask_rrf_fusion": ask_rrf_fusion,
    "retrieval_metrics": retrieval_metrics,
    "citation_check": citation_check,
}

ORACLES = {
    "search_bm25_topk": _bm25_sql("tion") + " SELECT doc_id, rank FROM r ORDER BY rank, doc_id LIMIT 20",
    "search_scanned_topk": _bm25_sql("tion") + " SELECT doc_id, rank FROM r ORDER BY rank, doc_id LIMIT 20",
    "search_filtered_total": _bm25_sql("ment") + " SELECT count(*) AS total, min(rank) AS best FROM r WHERE lang = 'fr'",
    "search_page": _bm25_sql("ment") + " SELECT doc_id, rank FROM r WHERE lang = 'fr' ORDER BY rank, doc_id LIMIT 10 OFFSET 10",
    "search_reliable_only": _bm25_sql("tion") + " SELECT doc_id, rank FROM r WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY rank, doc_id LIMIT 15",
    "two_character_search": "SELECT doc_id, 0.0::DOUBLE AS rank FROM documents WHERE contains(text, 'ea') OR contains(source, '戊甲') ORDER BY doc_id LIMIT 50",
    "short_query_substring": "SELECT doc_id FROM documents WHERE contains(text, 'ça') ORDER BY doc_id LIMIT 50",
    "substring_snippet": """
WITH h AS (SELECT doc_id, text, instr(text, 'License') AS p FROM documents WHERE contains(text, 'License')),
w AS (SELECT *, greatest(p - 60, 1) AS b FROM h), x AS (SELECT *, p + 67 - b AS n FROM w)
SELECT doc_id, (CASE WHEN b > 1 THEN '…' ELSE '' END)
  || replace(replace(replace(replace(replace(replace(substring(text, b, n), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), 'License', '<mark>License</mark>')
  || (CASE WHEN b + n - 1 < length(text) THEN '…' ELSE '' END) AS snippet FROM x""",
    "ask_derive_queries": f"""
WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[一-鿿]+|[a-z0-9]+')) AS query, generate_subscripts(regexp_extract_all(lower(text), '[一-鿿]+|[a-z0-9]+'), 1) AS pos FROM benchmark),
g AS (SELECT item_id, query, min(pos) AS pos FROM w WHERE length(query) >= 2 AND query NOT IN ({', '.join(f"'{x}'" for x in STOP_WORDS)}) GROUP BY ALL),
r AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY length(query) DESC, pos))::INT AS place, query FROM g)
SELECT * FROM r WHERE place <= 6""",
    "ask_rrf_fusion": _RRF,
    "retrieval_metrics": f"""
WITH w AS (SELECT item_id AS q, unnest(regexp_extract_all(lower(text), '[一-鿿]+|[a-z0-9]+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[一-鿿]+|[a-z0-9]+'), 1) AS pos FROM benchmark),
g AS (SELECT q, word, min(pos) AS pos FROM w WHERE length(word) >= 2 AND word NOT IN ({', '.join(f"'{x}'" for x in STOP_WORDS)}) GROUP BY ALL),
a AS (SELECT q, word FROM g QUALIFY row_number() OVER (PARTITION BY q ORDER BY length(word) DESC, pos) <= 6),
t AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(lower(text), '[一-鿿]+|[a-z0-9]+')) AS word FROM documents),
h AS (SELECT q, id, count(*) AS n FROM t JOIN a USING (word) GROUP BY ALL),
r AS (SELECT q, id, text, row_number() OVER (PARTITION BY q ORDER BY n DESC, length(text), id) AS place FROM h JOIN documents ON doc_id = id QUALIFY place <= 10),
v AS (SELECT b.item_id AS q, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
x AS (SELECT r.*, v.id IS NOT NULL AS good, row_number() OVER (PARTITION BY r.q, text ORDER BY place) > 1 AS again FROM r LEFT JOIN v ON v.q = r.q AND v.id = r.id),
p AS (SELECT b.item_id AS q, b.item_id % 2 AS parity, (SELECT count(*) FROM v WHERE v.q = b.item_id) AS relevant, coalesce(s.results, 0) AS results, coalesce(s.repeats, 0) AS repeats, s.first, coalesce(a1, 0) AS a1, coalesce(a3, 0) AS a3, coalesce(a5, 0) AS a5, coalesce(a8, 0) AS a8, coalesce(a10, 0) AS a10
      FROM benchmark b LEFT JOIN (SELECT q, count(*) AS results, count(*) FILTER (again) AS repeats, min(place) FILTER (good) AS first, count(*) FILTER (good AND place <= 1) AS a1, count(*) FILTER (good AND place <= 3) AS a3, count(*) FILTER (good AND place <= 5) AS a5, count(*) FILTER (good AND place <= 8) AS a8, count(*) FILTER (good AND place <= 10) AS a10 FROM x GROUP BY q) s ON s.q = b.item_id),
c AS (SELECT *, unnest(['all', 'parity=' || parity]) AS cut FROM p)
SELECT cut, count(*) AS n, count(*) FILTER (relevant > 0) AS answerable,
  round(avg(a1::DOUBLE / relevant) FILTER (relevant > 0), 6) AS recall_at_1, round(avg(a3::DOUBLE / relevant) FILTER (relevant > 0), 6) AS recall_at_3, round(avg(a5::DOUBLE / relevant) FILTER (relevant > 0), 6) AS recall_at_5, round(avg(a10::DOUBLE / relevant) FILTER (relevant > 0), 6) AS recall_at_10,
  round(avg(CASE WHEN first <= 10 THEN 1.0::DOUBLE / first ELSE 0 END) FILTER (relevant > 0), 6) AS mrr_at_10, round(avg(CASE WHEN results = 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (relevant > 0), 6) AS no_hit,
  round(avg(CASE WHEN results > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (relevant = 0), 6) AS false_positive, round(avg(CASE WHEN a8 > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (relevant > 0), 6) AS coverage_at_8,
  round(sum(repeats)::DOUBLE / sum(results), 6) AS duplicates FROM c GROUP BY cut""",
    "citation_check": """
WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS claim, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM conversations WHERE role = 'assistant'),
c AS (SELECT * FROM l WHERE length(claim) >= 12),
f AS (SELECT c.conv_id, EXISTS (SELECT 1 FROM conversations o WHERE o.conv_id = c.conv_id AND o.turn <> c.turn AND contains(o.text, c.claim)) AS found FROM c)
SELECT conv_id, count(*) AS claims, count(*) FILTER (found) AS supported, round(count(*) FILTER (found)::DOUBLE / count(*), 6) AS coverage,
       CASE WHEN count(*) FILTER (found) = count(*) THEN 'verified' ELSE 'unverified' END AS status FROM f GROUP BY conv_id""",
}
