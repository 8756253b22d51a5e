"""Preference pairs from chat: one prompt, and a masked completion each of chosen and rejected.

Two conversations make a pair, the chosen and the rejected one. Their longest common turn prefix is all
turns before the first turn number at which they differ. It is rendered once, as the prompt; what
follows in either is rendered as its completion, with the spans of characters that are trained on: text
and end marker of the turns whose role is in TRAINED. All else (headers, other roles, the prompt) is
masked.

The first difference is found on digests of the turns alone, so texts are shuffled once. Long
conversations come in pieces of PIECE turn numbers, so that no row and no task has to hold one whole;
the strings of a pair's pieces, joined in order, are its prompt and completions, and spans count from
the start of their piece. Everything runs on DataFrame functions.

Defined results: rows without conv_id belong to no conversation and are left out; rows without turn
have no place in theirs: they are counted in n_unplaced of the pair's first piece and not rendered;
repeated rows (same conversation, turn, role and text) are one turn; different rows of one turn number
all count, by role, then text; a null role is "unknown" and a null text empty; "<|" in a text or a role
becomes "< |", so that neither can forge a marker; equal conversations are all prompt, and completions are
empty; a conversation without partner has an empty prompt and paired false; an empty table gives an
empty result; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import table

#: Turn numbers of a piece.
PIECE = 512
#: Roles whose turns are trained on.
TRAINED = ("assistant",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def neighbours(turns: DataFrame) -> DataFrame:
    """turns with pair_id and side (0: chosen, 1: rejected): conversation 2k is chosen over 2k + 1."""
    return _columns(turns).select(F.shiftright("conv_id", 1).alias("pair_id"), F.col("conv_id").bitwiseAND(F.lit(1)).cast("int").alias("side"), "turn", "role", "text")


def members(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same by a table of pair_id, chosen_id and rejected_id; a conversation may be in many pairs."""
    sides = pairs.select(F.col("pair_id").cast("long"), F.posexplode(F.array(F.col("chosen_id").cast("long"), F.col("rejected_id").cast("long"))).alias("side", "conv_id"))
    return _columns(turns).join(sides.distinct(), "conv_id").select("pair_id", "side", "turn", "role", "text")


def _columns(turns: DataFrame) -> DataFrame:
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("unknown")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).filter("conv_id is not null")


def _pieces(rows: DataFrame, piece: int) -> DataFrame:
    """pair_id, piece, paired, n_unplaced and cut (the first turn number that differs; null: none)."""
    digests = rows.select("pair_id", "side", "turn", F.xxhash64("role", "text").alias("d1"), F.xxhash64("text", F.lit(17), "role").alias("d2")).groupBy("pair_id", "side", "turn", "d1", "d2").agg(F.count("*").alias("n"))
    mine = lambda x: F.when(F.col("side") == 0, x).otherwise(-x)
    wide = "decimal(38,0)"
    turn = digests.groupBy("pair_id", "turn").agg(
        F.sum(mine(F.lit(1))).alias("k"),
        F.sum(mine(F.col("d1").cast(wide))).alias("s1"),
        F.sum(mine(F.col("d2").cast(wide))).alias("s2"),
        F.sum(mine(F.col("d1").bitwiseAND(F.lit((1 << 31) - 1)) * F.col("d2").bitwiseAND(F.lit((1 << 31) - 1)))).alias("s3"),
        F.min("side").alias("low"), F.max("side").alias("high"), F.sum("n").alias("n"),
    )
    differs = (F.col("k") != 0) | (F.col("s1") != 0) | (F.col("s2") != 0) | (F.col("s3") != 0)
    by_piece = turn.groupBy("pair_id", F.coalesce(F.floor(F.col("turn") / piece), F.lit(0)).alias("piece")).agg(
        F.min(F.when(differs, F.col("turn"))).alias("first"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum(F.when(F.col("turn").isNull(), F.col("n")).otherwise(0)).alias("loose")
    )
    pair = by_piece.groupBy("pair_id").agg(F.min("first").alias("cut"), (F.min("low") < F.max("high")).alias("paired"), F.sum("loose").alias("loose"), F.min("piece").alias("p0"))
    return by_piece.select("pair_id", "piece").join(pair, "pair_id").select("pair_id", "piece", "paired", "cut", F.when(F.col("piece") == F.col("p0"), F.col("loose")).otherwise(0).alias("n_unplaced"))


def _head(x: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(x["role"], F.lit("<|"), F.lit("< |")), F.lit("\n"))


def _body(x: Column) -> Column:
    return F.concat(F.replace(x["text"], F.lit("<|"), F.lit("< |")), F.lit(CLOSE))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(_head(x), _body(x), F.lit("\n"))), "")


def _spans(turns: Column) -> Column:
    """The trained spans of what _rendered() makes of the turns, in characters."""
    lengths = F.transform(turns, lambda x: F.struct(F.length(_head(x)).alias("head"), F.length(_body(x)).alias("body"), x["role"].isin(*TRAINED).alias("train")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["head"]
        span = F.struct(begin.alias("start"), (begin + x["body"]).alias("end"))
        return F.struct((begin + x["body"] + 1).alias("at"), F.when(x["train"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(lengths, start, step, lambda acc: acc["spans"])


def format_pairs(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """Of rows (pair_id, side, turn, role, text): pair_id, piece, paired, n_unplaced, n_prompt_turns,
    prompt, chosen, rejected, chosen_spans, rejected_spans; a row for each piece of each pair."""
    texts = rows.filter("turn is not null").groupBy("pair_id", F.floor(F.col("turn") / piece).alias("piece")).agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text", "side"))).alias("turns"))
    both = _pieces(rows, piece).join(texts, ["pair_id", "piece"], "left")
    turns, cut = F.coalesce(F.col("turns"), F.array().cast(texts.schema["turns"].dataType)), F.col("cut")
    part = lambda side, common: F.filter(turns, lambda x: (x["side"] == side) & ((cut.isNull() | (x["turn"] < cut)) if common else (cut.isNotNull() & (x["turn"] >= cut))))
    parts = both.select("pair_id", "piece", "paired", "n_unplaced", part(0, True).alias("p"), part(0, False).alias("c"), part(1, False).alias("r"))
    p, c, r = map(F.col, "pcr")
    return parts.select("pair_id", "piece", "paired", "n_unplaced", F.size(p).alias("n_prompt_turns"), _rendered(p).alias("prompt"), _rendered(c).alias("chosen"), _rendered(r).alias("rejected"), _spans(c).alias("chosen_spans"), _spans(r).alias("rejected_spans"))


def _text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_pairs(neighbours(table(spark, sf_dir, "conversations")))
    return out.withColumns({"chosen_spans": _text("chosen_spans"), "rejected_spans": _text("rejected_spans")})


ORACLE = f"""
WITH t AS (
  SELECT DISTINCT conv_id >> 1 AS pair_id, conv_id & 1 AS side, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), sides AS (
  SELECT pair_id, turn, side, list([role, text] ORDER BY role, text) AS said FROM t WHERE turn IS NOT NULL GROUP BY ALL
), cuts AS (
  SELECT pair_id, min(turn) FILTER (WHERE a.said IS DISTINCT FROM b.said) AS cut
  FROM (SELECT * FROM sides WHERE side = 0) a FULL JOIN (SELECT * FROM sides WHERE side = 1) b USING (pair_id, turn) GROUP BY ALL
), pairs AS (
  SELECT conv_id >> 1 AS pair_id, count(DISTINCT conv_id) = 2 AS paired, count(*) FILTER (WHERE turn IS NULL) AS loose, coalesce(min(turn // {PIECE}), 0) AS p0
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL
), pieces AS (SELECT DISTINCT pair_id, coalesce(turn // {PIECE}, 0) AS piece FROM t),
segments AS (
  SELECT pair_id, turn // {PIECE} AS piece, turn, role, text, CASE WHEN cut IS NULL OR turn < cut THEN 'p' WHEN side = 0 THEN 'c' ELSE 'r' END AS part,
    '{OPEN}' || replace(role, '<|', '< |') || chr(10) AS head, replace(text, '<|', '< |') || '{CLOSE}' AS body
  FROM t JOIN cuts USING (pair_id) WHERE turn IS NOT NULL AND (side = 0 OR turn >= cut)
), placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY pair_id, piece, part ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS pos FROM segments
), strings AS (
  SELECT pair_id, piece, part, count(*) AS n, string_agg(head || body || chr(10), '' ORDER BY turn, role, text) AS s,
    coalesce(string_agg(pos || '-' || (pos + length(body)), ',' ORDER BY turn, role, text) FILTER (WHERE role IN ({", ".join(f"'{x}'" for x in TRAINED)})), '') AS spans
  FROM placed GROUP BY ALL
)
SELECT pair_id, piece, paired, CASE WHEN piece = p0 THEN loose ELSE 0 END AS n_unplaced, coalesce(p.n, 0)::INT AS n_prompt_turns, coalesce(p.s, '') AS prompt,
  coalesce(c.s, '') AS chosen, coalesce(r.s, '') AS rejected, coalesce(c.spans, '') AS chosen_spans, coalesce(r.spans, '') AS rejected_spans
FROM pieces JOIN pairs USING (pair_id)
LEFT JOIN (SELECT * FROM strings WHERE part = 'p') p USING (pair_id, piece)
LEFT JOIN (SELECT * FROM strings WHERE part = 'c') c USING (pair_id, piece)
LEFT JOIN (SELECT * FROM strings WHERE part = 'r') r USING (pair_id, piece)
"""

QUERIES = {"op6_preference_format": op6_preference_format}
ORACLES = {"op6_preference_format": ORACLE}
