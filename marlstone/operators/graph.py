"""Graphs as edge tables: components, closures, topological order, the steps that are ready, concept graphs.

Loops run until nothing changes, whatever the depth; each round is written to the shared folder, so that
lineage stays short and lost executors cost one round at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators.analytics import pairs
from marlstone.session import load
from marlstone.shared import drop, written


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node reachable) of every node of the edges (a, b).

    Each round hooks every node onto its least neighbour, if that is less, and moves the edges along;
    the hooks of all rounds, one after another, lead from a node to its component."""
    first = edges = written(edges.filter("a <> b").select("a", "b"), "edges")
    hooks: list[DataFrame] = []
    while not edges.isEmpty():
        ends = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        hook = written(ends.groupBy("a").agg(F.min("b").alias("to")).filter("to < a"), "hooks")
        hooks.append(hook)
        x = hook.select("a", F.col("to").alias("ta"))
        y = hook.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b")).filter("a <> b")
        old, edges = edges, written(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        if old is not first:
            drop(old)
    nodes = first.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    out = nodes.select("node", F.col("node").alias("component"))
    for hook in hooks:
        out = out.join(hook.select(F.col("a").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    out = written(out, "components")
    drop(*{id(x): x for x in (first, edges, *hooks)}.values())
    return out


def components_by_key(rows: DataFrame, node: str, key: str) -> DataFrame:
    """node and component of rows that are joined by equal keys; a null key joins nothing."""
    named = rows.select(F.col(node).alias("node"), F.col(key).alias("key")).distinct()
    least = named.filter("key is not null").groupBy("key").agg(F.min("node").alias("b"))
    edges = named.join(least, "key").select(F.col("node").alias("a"), "b")
    found = components(edges)
    return named.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def downstream(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Of each root: node and depth (least distance, 1 and more) of all that (indirectly) need it.
    roots: root; edges: src, dst. A root on a cycle is downstream of itself."""
    edges = edges.select("src", "dst").distinct()
    front = written(roots.select("root", F.col("root").alias("node")).distinct().join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(1)), "front")
    rounds = [front]
    while not front.isEmpty():
        seen = reduce(DataFrame.unionByName, rounds).select("root", "node")
        following = front.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct().join(seen, ["root", "node"], "left_anti")
        front = written(following.withColumn("depth", F.lit(len(rounds) + 1)), "front")
        rounds.append(front)
    return reduce(DataFrame.unionByName, rounds)


def topological(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, level (the longest way from a node that needs nothing; null on or behind a cycle) and place:
    by level, those without one last, ties by name."""
    left, waits = written(nodes.select("node").distinct(), "left"), written(edges.select("src", "dst").distinct(), "waits")
    done: list[DataFrame] = []
    while not left.isEmpty():
        free = written(left.join(waits.select(F.col("dst").alias("node")), "node", "left_anti").withColumn("level", F.lit(len(done))), "level")
        if free.isEmpty():
            drop(free)
            break
        done.append(free)
        old = left, waits
        left = written(left.join(free, "node", "left_anti"), "left")
        waits = written(waits.join(free.select(F.col("node").alias("src")), "src", "left_anti"), "waits")
        drop(*old)
    out = reduce(DataFrame.unionByName, [*done, left.withColumn("level", F.lit(None).cast("int"))])
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("level"), "node")))  # one row a step


def advance(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """step and status after all that can move has moved: a waiting step whose needs are all done or
    skipped is skipped if its condition is false, else ready; a conditional step that was skipped becomes
    ready if its condition holds now, unless its failure is allowed. Rounds go on until none moves.

    steps: step, status, conditional, holds, allow_failure (all but step may be left out or null)."""
    for name, kind in (("status", "string"), ("conditional", "boolean"), ("holds", "boolean"), ("allow_failure", "boolean")):
        if name not in steps.columns:
            steps = steps.withColumn(name, F.lit(None).cast(kind))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    steps = written(steps.select("step", F.coalesce("status", F.lit("waiting")).alias("status"), no("conditional").alias("conditional"), no("holds").alias("holds"), no("allow_failure").alias("allow_failure")), "steps")
    needs = edges.select(F.col("src").alias("need"), F.col("dst").alias("step")).distinct()
    while True:
        met = needs.join(steps.select(F.col("step").alias("need"), F.col("status").alias("of")), "need", "left").groupBy("step").agg(F.bool_and(F.coalesce(F.col("of").isin("done", "skipped"), F.lit(False))).alias("met"))
        off = F.col("conditional") & ~F.col("holds")
        on = F.when(off, "skipped").otherwise("ready")
        again = F.when(F.col("conditional") & F.col("holds") & ~F.col("allow_failure"), "ready").otherwise("skipped")
        can = F.coalesce("met", F.lit(True))
        back = F.when(can & (F.col("status") == "skipped"), again).otherwise(F.col("status"))
        new = F.when(can & (F.col("status") == "waiting"), on).otherwise(F.col("status"))
        moved = written(steps.join(met, "step", "left").withColumns({"back": back, "new": new}), "moved")
        # what is no longer skipped must not count as met for others, so it moves before they do
        to = next((c for c in ("back", "new") if not moved.filter(F.col(c) != F.col("status")).isEmpty()), None)
        steps = moved.select("step", F.col(to or "status").alias("status"), "conditional", "holds", "allow_failure")
        if to is None:
            return steps.select("step", "status")


def stale_roots(edges: DataFrame, stale: DataFrame) -> DataFrame:
    """The stale steps (column step) that are not downstream of another stale one."""
    behind = downstream(edges, stale.select(F.col("step").alias("root"))).filter("root <> node").select(F.col("node").alias("step"))
    return stale.select("step").distinct().join(behind, "step", "left_anti")


def rebuild_order(nodes: DataFrame, edges: DataFrame, stale: DataFrame) -> DataFrame:
    """step and place of all that must be made anew: the stale steps (column step) and what is downstream of
    them, each behind what it needs."""
    behind = downstream(edges, stale.select(F.col("step").alias("root"))).select(F.col("node").alias("step"))
    all_ = behind.union(stale.select("step")).distinct()
    order = topological(nodes, edges).select(F.col("node").alias("step"), "place")
    return order.join(all_, "step", "left_semi").withColumn("place", F.row_number().over(Window.orderBy("place")))  # one row a step


def next_in_chain(items: DataFrame, chain: str, position: str) -> DataFrame:
    """Of each chain in which no item (column status) runs, the first deferred item by position."""
    out = items.groupBy(chain).agg(F.bool_or(F.col("status") == "running").alias("busy"), F.min(F.when(F.col("status") == "deferred", F.col(position))).alias("next"))
    return out.filter("not busy and next is not null").select(chain, "next")


def merge_targets(members: DataFrame, component: str) -> DataFrame:
    """Of each component the entity that the others are merged into: accepted before others, then the
    longer definition, a name that begins with a Latin letter, the older, the smaller name.
    members: term, status, definition, created_at."""
    order = F.struct(
        (F.col("status") != "accepted").alias("o"), (-F.length(F.coalesce("definition", F.lit("")))).alias("d"), (~F.col("term").rlike("^[A-Za-z]")).alias("l"), F.col("created_at").alias("c"), F.col("term").alias("t")
    )
    return members.groupBy(component).agg(F.min_by("term", order).alias("target"), F.count("*").alias("members"))


def expanded_parts(template: DataFrame, edges: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A template's steps and edges for jobs of several parts. template: step, per_part; parts: job, part.

    A step that runs for each part becomes step#part; an edge between two such stays within the part, one
    from such a step to a single one comes from every part (fan-in), one to such a step goes to every part."""
    name = F.concat_ws("#", "step", F.col("part").cast("string"))
    jobs = parts.select("job").distinct()
    nodes = template.filter("per_part").crossJoin(parts).select("job", name.alias("step"), "part")  # a template is a few steps
    nodes = nodes.unionByName(template.filter("not per_part").crossJoin(jobs).select("job", "step", F.lit(None).cast(parts.schema["part"].dataType).alias("part")))
    kind = template.select("step", "per_part")
    e = edges.join(kind.withColumnsRenamed({"step": "src", "per_part": "of_src"}), "src").join(kind.withColumnsRenamed({"step": "dst", "per_part": "of_dst"}), "dst")
    many, one = e.filter("of_src or of_dst").crossJoin(parts), e.filter("not of_src and not of_dst").crossJoin(jobs)
    end = lambda c: F.when(F.col(f"of_{c}"), F.concat_ws("#", c, F.col("part").cast("string"))).otherwise(F.col(c)).alias(c)
    return nodes, many.select("job", end("src"), end("dst")).unionByName(one.select("job", "src", "dst"))


def concept_graph(nodes: DataFrame, typed: DataFrame, together: DataFrame, least: int) -> DataFrame:
    """src, tgt, kind and weight of a concept graph. typed: src, tgt, kind, position; together: src, tgt
    (src < tgt), weight. Edges to oneself or to what is no node go. Of typed edges of one pair, whatever
    their direction, the first by source and position stays, with the pair's shared jobs as weight, 1 at
    least; pairs without a typed edge are joined (kind cooccur) from `least` shared jobs on."""
    known = nodes.select("node")
    ends = typed.filter("src <> tgt").join(known.select(F.col("node").alias("src")), "src", "left_semi").join(known.select(F.col("node").alias("tgt")), "tgt", "left_semi")
    pair = ends.select("*", F.least("src", "tgt").alias("u"), F.greatest("src", "tgt").alias("v"))
    first = pair.groupBy("u", "v").agg(F.min_by(F.struct("src", "tgt", "kind"), F.struct("src", "position")).alias("e"))
    counted = together.select(F.col("src").alias("u"), F.col("tgt").alias("v"), "weight")
    both = first.join(counted, ["u", "v"], "left").select("e.src", "e.tgt", "e.kind", F.greatest(F.coalesce("weight", F.lit(1)), F.lit(1)).cast("long").alias("weight"))
    rest = counted.filter(F.col("weight") >= least).join(first, ["u", "v"], "left_anti").select(F.col("u").alias("src"), F.col("v").alias("tgt"), F.lit("cooccur").alias("kind"), F.col("weight").cast("long").alias("weight"))
    return both.unionByName(rest)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, isolated nodes and the greatest degree."""
    degree = edges.select(F.explode(F.array("src", "tgt")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    per = nodes.select("node").distinct().join(degree, "node", "left")
    return per.agg(F.count("*").alias("nodes"), F.count(F.when(F.col("degree").isNull(), 1)).alias("isolated"), F.coalesce(F.max("degree"), F.lit(0)).alias("largest")).crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each


def _k(c: str) -> Column:
    return F.concat(F.lit("c"), F.col(c).cast("string"))


#: Suppliers stand for concepts, orders for jobs; a supplier names the one `p_size` further on in part.
def _concepts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes = load(s, d, "supplier").filter("s_suppkey % 9 <> 0").select(F.col("s_suppkey").cast("long").alias("node"))
    part = load(s, d, "part").filter("p_size <= 20")
    typed = part.select((F.col("p_partkey") % 97).alias("src"), ((F.col("p_partkey") * 7 + F.col("p_size")) % 97).alias("tgt"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("position"))
    lines = load(s, d, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("long").alias("t"))
    together = pairs(lines, "l_orderkey", "t")
    return nodes, typed, together.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("tgt")), "tgt", "left_semi")


def concept_graph_typed(s: SparkSession, d: str) -> DataFrame:
    return concept_graph(*_concepts(s, d), 12).select(_k("src").alias("src"), _k("tgt").alias("tgt"), "kind", "weight")


def concept_graph_stats(s: SparkSession, d: str) -> DataFrame:
    nodes, typed, together = _concepts(s, d)
    return graph_stats(nodes, concept_graph(nodes, typed, together, 12))


def term_components(s: SparkSession, d: str) -> DataFrame:
    """Connected parts by shared names: every part's component is the least key with one of its keys."""
    keys = F.array(F.concat(F.lit("n"), F.col("p_brand"), F.lit("/"), F.col("p_size").cast("string"), F.lit("/"), F.col("p_type")), F.concat(F.lit("m"), (F.col("p_partkey") / 3).cast("long").cast("string")))
    return components_by_key(load(s, d, "part").select(F.col("p_partkey").alias("node"), F.explode(keys).alias("key")), "node", "key")


def merge_target_choice(s: SparkSession, d: str) -> DataFrame:
    part = load(s, d, "part").select((F.col("p_partkey") % 50).alias("component"), F.concat(F.when(F.col("p_partkey") % 4 == 0, F.lit("9")).otherwise(""), "p_name", F.lit("/"), F.col("p_partkey").cast("string")).alias("term"), F.when(F.col("p_size") > 30, "accepted").otherwise("proposed").alias("status"), F.col("p_type").alias("definition"), F.col("p_size").alias("created_at"))
    return merge_targets(part, "component")


def book_chain_next(s: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as a book's chapters: done (F), deferred (O), running (P)."""
    items = load(s, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "deferred").otherwise("running").alias("status"))
    return next_in_chain(items, "o_custkey", "o_orderkey")


#: A template of steps and what each needs, as the sample DAG of the graph queries.
STEPS = (
    ("download", ()), ("transcribe", ("download",)), ("scene", ("download",)), ("frames", ("scene",)), ("dedup", ("frames",)), ("ocr", ("dedup",)), ("punctuate", ("transcribe",)),
    ("merge", ("punctuate", "ocr")), ("mechanical", ("merge",)), ("evidence", ("merge",)), ("smart", ("mechanical", "evidence")), ("review", ("smart",)), ("concepts", ("smart",)), ("publish", ("review", "concepts")),
)
DONE = ("download", "transcribe", "scene", "punctuate", "frames")
#: Steps with a condition, and whether it holds.
CONDITIONS = {"dedup": False, "ocr": False, "evidence": True}
PER_PART = ("transcribe", "scene", "frames", "dedup", "ocr", "punctuate")


def step_edges(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(d, n) for n, deps in STEPS for d in deps], "src string, dst string")


def step_nodes(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(n,) for n, _ in STEPS], "node string")


def dag_downstream(s: SparkSession, d: str) -> DataFrame:
    found = downstream(step_edges(s), s.createDataFrame([("scene",), ("punctuate",)], "root string"))
    return found.groupBy("node").agg(F.min("depth").alias("depth"))


def topological_order(s: SparkSession, d: str) -> DataFrame:
    return topological(step_nodes(s), step_edges(s))


def topological_cycle(s: SparkSession, d: str) -> DataFrame:
    """With an edge back from evidence to merge: what is on or behind the cycle follows by name."""
    return topological(step_nodes(s), step_edges(s).unionByName(s.createDataFrame([("evidence", "merge")], "src string, dst string")))


def ready_steps(s: SparkSession, d: str) -> DataFrame:
    steps = s.createDataFrame([(n, "done" if n in DONE else "waiting") for n, _ in STEPS], "step string, status string")
    return advance(steps, step_edges(s)).filter("status = 'ready'").select(F.col("step").alias("node"))


def ready_with_conditions(s: SparkSession, d: str) -> DataFrame:
    """Conditions that don't hold skip steps, and those behind them move on."""
    rows = [(n, "done" if n in DONE else "waiting", n in CONDITIONS, CONDITIONS.get(n, False)) for n, _ in STEPS]
    return advance(s.createDataFrame(rows, "step string, status string, conditional boolean, holds boolean"), step_edges(s))


def stale_root_steps(s: SparkSession, d: str) -> DataFrame:
    return stale_roots(step_edges(s), s.createDataFrame([("frames",), ("ocr",), ("transcribe",), ("publish",)], "step string"))


def projection_rebuild(s: SparkSession, d: str) -> DataFrame:
    """What to make anew when the evidence and the scenes are stale."""
    return rebuild_order(step_nodes(s), step_edges(s), s.createDataFrame([("evidence",), ("dedup",)], "step string"))


def parts_fan_in(s: SparkSession, d: str) -> DataFrame:
    """The template's edges for every customer as a job whose nation's number, mod 3 plus 1, is its parts."""
    parts = load(s, d, "customer").select(F.col("c_custkey").alias("job"), F.explode(F.sequence(F.lit(1), F.col("c_nationkey") % 3 + 1)).alias("part"))
    template = s.createDataFrame([(n, n in PER_PART) for n, _ in STEPS], "step string, per_part boolean")
    _, edges = expanded_parts(template, step_edges(s), parts)
    return edges.groupBy("src", "dst").agg(F.count("*").alias("jobs"))


QUERIES = {
    f.__name__: f
    for f in (concept_graph_typed, concept_graph_stats, term_components, merge_target_choice, book_chain_next, dag_downstream, topological_order, topological_cycle, ready_steps, ready_with_conditions, stale_root_steps, projection_rebuild, parts_fan_in)
}

_EDGES = "edges(src, dst) AS (VALUES " + ", ".join(f"('{a}', '{n}')" for n, deps in STEPS for a in deps) + ")"
_NODES = "nodes(node) AS (VALUES " + ", ".join(f"('{n}')" for n, _ in STEPS) + ")"
_DONE = ", ".join(f"'{x}'" for x in DONE)
_CONCEPTS = """
WITH n AS (SELECT s_suppkey AS node FROM supplier WHERE s_suppkey % 9 <> 0),
t AS (SELECT p_partkey % 97 AS src, (p_partkey * 7 + p_size) % 97 AS tgt, p_type AS kind, p_partkey AS pos FROM part WHERE p_size <= 20),
k AS (SELECT *, row_number() OVER (PARTITION BY least(src, tgt), greatest(src, tgt) ORDER BY src, pos) AS nth FROM t WHERE src <> tgt AND src IN (SELECT node FROM n) AND tgt IN (SELECT node FROM n)),
f AS (SELECT * FROM k WHERE nth = 1),
p AS (SELECT DISTINCT l_orderkey AS job, l_suppkey AS term FROM lineitem WHERE l_suppkey IN (SELECT node FROM n)),
c AS (SELECT a.term AS u, b.term AS v, count(*) AS weight FROM p a JOIN p b ON a.job = b.job AND a.term < b.term GROUP BY ALL),
e AS (SELECT src, tgt, kind, greatest(coalesce(weight, 1), 1)::BIGINT AS weight FROM f LEFT JOIN c ON u = least(src, tgt) AND v = greatest(src, tgt)
      UNION ALL SELECT u, v, 'cooccur', weight FROM c WHERE weight >= 12 AND NOT EXISTS (SELECT 1 FROM f WHERE least(src, tgt) = u AND greatest(src, tgt) = v))"""
_PAIRS = ", ".join(f"('{n}', {n in PER_PART})" for n, _ in STEPS)

ORACLES = {
    "concept_graph_typed": _CONCEPTS + " SELECT 'c' || src AS src, 'c' || tgt AS tgt, kind, weight FROM e",
    "concept_graph_stats": _CONCEPTS
    + ", d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT tgt FROM e) GROUP BY node) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM n WHERE node NOT IN (SELECT node FROM d)) AS isolated, (SELECT coalesce(max(degree), 0) FROM d) AS largest, (SELECT count(*) FROM e) AS edges",
    "term_components": """
WITH RECURSIVE k AS (SELECT p_partkey AS node, 'n' || p_brand || '/' || p_size || '/' || p_type AS key FROM part UNION ALL SELECT p_partkey, 'm' || (p_partkey // 3) FROM part),
e AS (SELECT DISTINCT a.node AS a, b.node AS b FROM k a JOIN k b ON a.key = b.key),
r AS (SELECT node, node AS other FROM k UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other)
SELECT node, min(other) AS component FROM r GROUP BY node""",
    "merge_target_choice": """
WITH m AS (SELECT p_partkey % 50 AS component, (CASE WHEN p_partkey % 4 = 0 THEN '9' ELSE '' END) || p_name || '/' || p_partkey AS term, p_size > 30 AS accepted, p_type AS definition, p_size AS created FROM part)
SELECT component, first(term ORDER BY accepted DESC, length(definition) DESC, regexp_matches(term, '^[A-Za-z]') DESC, created, term) AS target, count(*) AS members FROM m GROUP BY component""",
    "book_chain_next": "SELECT o_custkey, min(o_orderkey) FILTER (o_orderstatus = 'O') AS next FROM orders GROUP BY o_custkey HAVING NOT bool_or(o_orderstatus NOT IN ('F', 'O')) AND bool_or(o_orderstatus = 'O')",
    "dag_downstream": f"WITH RECURSIVE {_EDGES}, r(node, depth) AS (VALUES ('scene', 0), ('punctuate', 0) UNION SELECT e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.node) SELECT node, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY node",
    "topological_order": f"WITH RECURSIVE {_EDGES}, {_NODES}, r(node, depth) AS (SELECT node, 0 FROM nodes WHERE node NOT IN (SELECT dst FROM edges) UNION SELECT e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.node), l AS (SELECT node, max(depth) AS level FROM r GROUP BY node) SELECT node, level, (row_number() OVER (ORDER BY level, node))::INT AS place FROM l",
    "topological_cycle": f"WITH RECURSIVE {_EDGES}, {_NODES}, behind(node) AS (VALUES ('merge') UNION SELECT e.dst FROM behind b JOIN edges e ON e.src = b.node), r(node, depth) AS (SELECT node, 0 FROM nodes WHERE node NOT IN (SELECT dst FROM edges) UNION SELECT e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.node WHERE e.dst NOT IN (SELECT node FROM behind)), l AS (SELECT node, max(depth) AS level FROM r GROUP BY node UNION ALL SELECT node, NULL FROM behind) SELECT node, level, (row_number() OVER (ORDER BY level NULLS LAST, node))::INT AS place FROM l",
    "ready_steps": f"WITH {_EDGES}, {_NODES} SELECT node FROM nodes WHERE node NOT IN ({_DONE}) AND NOT EXISTS (SELECT 1 FROM edges WHERE dst = node AND src NOT IN ({_DONE}))",
    "ready_with_conditions": f"WITH {_NODES} SELECT node AS step, CASE WHEN node IN ({_DONE}) THEN 'done' WHEN node IN ('dedup', 'ocr') THEN 'skipped' WHEN node = 'merge' THEN 'ready' ELSE 'waiting' END AS status FROM nodes",
    "stale_root_steps": "SELECT unnest(['frames', 'transcribe']) AS step",
    "projection_rebuild": f"WITH RECURSIVE {_EDGES}, {_NODES}, r(node, depth) AS (SELECT node, 0 FROM nodes WHERE node NOT IN (SELECT dst FROM edges) UNION SELECT e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.node), l AS (SELECT node, max(depth) AS level FROM r GROUP BY node), b(node) AS (VALUES ('evidence'), ('dedup') UNION SELECT e.dst FROM b JOIN edges e ON e.src = b.node) SELECT node AS step, (row_number() OVER (ORDER BY level, node))::INT AS place FROM l WHERE node IN (SELECT node FROM b)",
    "parts_fan_in": f"""
WITH {_EDGES}, k(step, per_part) AS (VALUES {_PAIRS}), p AS (SELECT c_custkey AS job, unnest(range(1, c_nationkey % 3 + 2)) AS part FROM customer),
x AS (SELECT src, dst, a.per_part AS fa, b.per_part AS fb FROM edges JOIN k a ON a.step = src JOIN k b ON b.step = dst),
e AS (SELECT DISTINCT job, CASE WHEN fa THEN src || '#' || part ELSE src END AS src, CASE WHEN fb THEN dst || '#' || part ELSE dst END AS dst FROM x, p)
SELECT src, dst, count(*) AS jobs FROM e GROUP BY ALL""",
}
