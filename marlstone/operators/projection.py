"""What of a projection must be made anew: digests go along the edges level by level, so that a step is made
again only where something that it reads is another than before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.graph import STEPS, step_edges, step_nodes, topological
from marlstone.session import load

_DONE = "array<struct<step: string, outcome: string, reason: string, input: string, output: string>>"


def _made(done: Column, x: Column, needs: Column) -> Column:
    """done and what came of the step x, once those before it are in done."""
    needed = needs[x["step"]]
    reads = F.filter(done, lambda r: F.array_contains(needed, r["step"]))
    behind = F.filter(reads, lambda r: r["outcome"].isin("failed", "blocked"))
    read = F.concat_ws("|", F.array_sort(F.transform(reads, lambda r: F.concat_ws("=", r["step"], r["output"]))))
    now = F.sha2(F.concat_ws("\u001f", F.lit("in"), x["definition"], read), 256)
    by = F.array_min(F.transform(behind, lambda r: r["step"]))

    def fate(v: Column) -> Column:
        now, by, bad = v["now"], v["by"], v["by"].isNotNull()
        same, there = F.coalesce(now == x["input"], F.lit(False)), F.coalesce(x["valid"], F.lit(False)) & x["output"].isNotNull()
        fails = F.coalesce(x["fails"], F.lit(False))
        outcome = F.when(bad, "blocked").when(same & there, "reused").when(fails, "failed").otherwise("rebuilt")
        reason = F.when(bad, F.concat(F.lit("behind "), by)).when(same & there, None).when(x["input"].isNull(), "never made").when(~same, "input changed").otherwise("output lost")
        output = F.when(bad, None).when(same & there, x["output"]).when(~fails, F.coalesce(x["makes"], F.sha2(F.concat(F.lit("out"), now), 256)))
        return F.struct(x["step"].alias("step"), outcome.alias("outcome"), reason.alias("reason"), F.when(~bad, now).alias("input"), output.alias("output"))

    # an array of one, so that what is used more than once is found once
    return F.concat(done, F.transform(F.array(F.struct(now.alias("now"), by.alias("by"))), fate)).cast(_DONE)


def reprojected(steps: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """job, step, outcome, reason, input and output (digests) of every step of every job.

    nodes (node) and edges (src, dst) are the template, which is small; steps: job, step, definition (what
    it is made by), input and output (digests of the last run, null if there is none), valid (whether what
    it wrote is there and whole), fails (whether making it now fails) and makes (the output's digest if it
    is made now; null: a digest of its input).

    A step's input digest is that of its definition and of the outputs of the steps it needs, by name.
    reused: the input is as it was and the output valid; rebuilt; failed; blocked: a step that it needs has
    failed or is blocked. A rebuilt step with the output it had before leaves those behind it as they are.
    A job's steps meet once, and are gone through by level: a task holds one job's, which are as many as the
    template's. A row without a job is by itself."""
    level = {r.node: r.level for r in topological(nodes, edges).collect()}  # the template's nodes
    if loops := sorted(n for n, k in level.items() if k is None):
        raise ValueError(f"steps on a cycle or behind one: {', '.join(loops)}")
    if not level:
        return steps.select("job", "step", *(F.lit("").alias(c) for c in ("outcome", "reason", "input", "output"))).limit(0)
    before: dict[str, list[str]] = {n: [] for n in level}
    for r in edges.select("src", "dst").distinct().collect():  # the template's edges
        if r.dst in before:
            before[r.dst].append(r.src)
    depth = steps.sparkSession.createDataFrame(list(level.items()), "step string, level int")
    needs = F.create_map(*(c for n, names in before.items() for c in (F.lit(n), F.array(*map(F.lit, names)).cast("array<string>"))))
    rows = steps.join(F.broadcast(depth), "step").withColumn("_alone", F.when(F.col("job").isNull(), F.monotonically_increasing_id()))
    jobs = rows.groupBy("job", "_alone").agg(F.array_sort(F.collect_list(F.struct("level", "step", "definition", "input", "output", "valid", "fails", "makes"))).alias("_steps"))
    return jobs.select("job", F.inline(F.aggregate("_steps", F.array().cast(_DONE), lambda done, x: _made(done, x, needs))))


def rebuilt_steps(s: SparkSession, d: str) -> DataFrame:
    """Customers as jobs of the template of steps, made once and then made again with another definition of
    dedup in every fifth job, a lost output of smart in every third, a failure of ocr, if it is made, in
    every seventh, and scenes that always come out the same though every second job has a new definition."""
    jobs = load(s, d, "customer").select(F.col("c_custkey").alias("job"))
    rows = jobs.join(F.broadcast(step_nodes(s).withColumnRenamed("node", "step")))  # the template's steps
    is_ = lambda n: F.col("step") == n
    makes = F.when(is_("scene"), F.sha2(F.concat(F.lit("scene"), F.col("job").cast("string")), 256))
    no = F.lit(None).cast("string")
    first = reprojected(rows.withColumns({"definition": F.lit("1"), "input": no, "output": no, "valid": F.lit(True), "fails": F.lit(False), "makes": makes}), step_nodes(s), step_edges(s))
    second = F.when(is_("dedup") & (F.col("job") % 5 == 0), "2").when(is_("scene") & (F.col("job") % 2 == 0), "2").otherwise("1")
    again = first.select("job", "step", "input", "output").withColumns({"definition": second, "valid": ~(is_("smart") & (F.col("job") % 3 == 0)), "fails": is_("ocr") & (F.col("job") % 7 == 0), "makes": makes})
    return reprojected(again, step_nodes(s), step_edges(s)).select("job", "step", "outcome", "reason")


QUERIES = {"rebuilt_steps": rebuilt_steps}


def _sql() -> str:
    """Step by step in the template's order: its state, its reason and whether its output is another than before."""
    needs = dict(STEPS)
    own = {"dedup": "job % 5 = 0", "scene": "job % 2 = 0"}
    sql, last = "WITH s0 AS (SELECT c_custkey AS job FROM customer)", "s0"
    for k, (n, deps) in enumerate(STEPS, 1):
        bad = " OR ".join(f"o_{x} IN ('failed', 'blocked')" for x in deps) or "false"
        new = " OR ".join([own.get(n, "false"), *(f"c_{x}" for x in deps)])
        lost = "job % 3 = 0" if n == "smart" else "false"
        fails = "job % 7 = 0" if n == "ocr" else "false"
        by = "least(" + ", ".join(f"CASE WHEN o_{x} IN ('failed', 'blocked') THEN '{x}' END" for x in deps) + ")" if deps else "NULL"
        sql += f",\ns{k} AS (SELECT *, CASE WHEN {bad} THEN 'blocked' WHEN NOT ({new}) AND NOT ({lost}) THEN 'reused' WHEN {fails} THEN 'failed' ELSE 'rebuilt' END AS o_{n}, CASE WHEN {bad} THEN 'behind ' || {by} WHEN {new} THEN 'input changed' WHEN {lost} THEN 'output lost' END AS r_{n}, {'false' if n == 'scene' else f'NOT ({bad}) AND ({new})'} AS c_{n} FROM {last})"
        last = f"s{k}"
    assert set(needs) == {n for n, _ in STEPS}
    return sql + "\n" + "\nUNION ALL ".join(f"SELECT job, '{n}' AS step, o_{n} AS outcome, r_{n} AS reason FROM {last}" for n, _ in STEPS)


ORACLES = {"rebuilt_steps": _sql()}
