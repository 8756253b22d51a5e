"""Projections made anew, on templates and states of known make."""

import pytest

from marlstone.operators.projection import reprojected

NODES = [("a",), ("b",), ("c",), ("d",)]
EDGES = [("a", "c"), ("b", "c"), ("a", "c"), ("c", "d")]
SCHEMA = "job long, step string, definition string, input string, output string, valid boolean, fails boolean, makes string"


@pytest.fixture
def template(spark):
    return spark.createDataFrame(NODES, "node string"), spark.createDataFrame(EDGES, "src string, dst string")


def made(rows):
    return {(r.job, r.step): (r.outcome, r.reason) for r in rows.collect()}


def test_only_what_reads_something_else_is_made_again(spark, template):
    first = reprojected(spark.createDataFrame([(j, n, "1", None, None, None, None, None) for j in range(5) for (n,) in NODES], SCHEMA), *template)
    assert set(made(first).values()) == {("rebuilt", "never made")}
    change = {(1, "a"): ("2", True, False), (2, "c"): ("1", False, False), (3, "b"): ("1", False, True), (3, "a"): ("2", True, True)}
    rows = [(r.job, r.step, d, r.input, r.output, valid, fails, None) for r in first.collect() for d, valid, fails in [change.get((r.job, r.step), ("1", True, False))]]
    rows = [(*x[:5], True, False, x[4]) if x[:2] == (4, "a") else x for x in rows] + [(0, "no such step", "1", None, None, None, None, None)]
    got = made(reprojected(spark.createDataFrame(rows, SCHEMA), *template))
    same = ("reused", None)
    assert got == {
        **{(j, n): same for j in range(5) for (n,) in NODES},
        **{(1, "a"): ("rebuilt", "input changed"), (1, "c"): ("rebuilt", "input changed"), (1, "d"): ("rebuilt", "input changed")},
        (2, "c"): ("rebuilt", "output lost"),
        **{(3, "a"): ("failed", "input changed"), (3, "b"): ("failed", "output lost"), (3, "c"): ("blocked", "behind a"), (3, "d"): ("blocked", "behind c")},
    }


def test_rows_without_a_job_or_without_what_they_need(spark, template):
    rows = [(None, "c", "1", None, None, None, None, None), (None, "a", "1", None, None, None, True, None), (None, "c", "1", None, None, None, None, None), (7, "d", None, None, None, None, None, "made")]
    got = [(r.job, r.step, r.outcome, r.output == "made") for r in reprojected(spark.createDataFrame(rows, SCHEMA), *template).collect()]
    assert sorted(got, key=str) == sorted([(None, "c", "rebuilt", False), (None, "a", "failed", False), (None, "c", "rebuilt", False), (7, "d", "rebuilt", True)], key=str)


def test_a_jobs_steps_meet_in_one_exchange_and_no_join_of_their_own(spark, template):
    rows = spark.createDataFrame([(1, "a", "1", None, None, None, None, None)], SCHEMA)
    plan = reprojected(rows, *template)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and plan.count("Join ") == 1  # the join is with the template


def test_an_empty_template_and_a_cycle(spark, template):
    rows = spark.createDataFrame([(1, "a", "1", None, None, None, None, None)], SCHEMA)
    assert reprojected(rows, template[0].limit(0), template[1].limit(0)).count() == 0
    with pytest.raises(ValueError, match="cycle"):
        reprojected(rows, template[0], template[1].union(spark.createDataFrame([("d", "a")], "src string, dst string")))
