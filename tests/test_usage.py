"""Patterns, recommendations, workflows and sequence checks on small event logs, with nulls, ties and empty tables."""

import datetime as dt

import pytest
from codelake.operators import usage as U

EVENT = "event_id long, ts timestamp, tool_name string, user_id string, execution_time double, success boolean, ordinal long"


def log(spark, *steps):
    """Events of (user, tool, seconds, success), a second apart, with a column of a clashing name."""
    at = dt.datetime(2024, 1, 1)
    return U.sequenced(spark.createDataFrame([(k, at + dt.timedelta(seconds=k), t, u, x, ok, 7) for k, (u, t, x, ok) in enumerate(steps)], EVENT))


@pytest.fixture(scope="module")
def cycle(spark):
    steps = [("u", t, 1.0, True) for _ in range(20) for t in ("scan", "extract", "format")]
    return log(spark, *steps, ("v", "scan", None, False), (None, "extract", 2.0, None))


def test_patterns(spark, cycle):
    got = {(r["kind"], tuple(r["tools"])): r["frequency"] for r in U.patterns(cycle, 0.05, 0.1, 0.3).collect()}
    assert got[("sequence", ("scan", "extract", "format"))] == 20 and got[("pair", ("extract", "format"))] == 20
    assert U.patterns(cycle.limit(0)).count() == 0


def test_recommendations(spark, cycle):
    found, now = U.patterns(cycle, 0.05, 0.1, 0.3), U.current_tools(cycle, 1)
    assert {(r["user_id"], tuple(r["tools"]), r["last_tool"]) for r in now.collect()} == {("u", ("format",), "format"), ("v", ("scan",), "scan")}
    near = U.similar_patterns(found, now, 2).collect()
    assert {r["rank"] for r in near} == {1, 2} and max(r["similarity"] for r in near) == 0.5
    recs = {(r["user_id"], r["tool_name"]) for r in U.pattern_recommendations(found, now).collect()}
    assert ("v", "scan") not in recs and ("v", "extract") in recs and ("u", "scan") in recs
    best = {(r["user_id"], r["rank"]): (r["tool_name"], r["source"]) for r in U.combined_recommendations(cycle, found, now).collect()}
    assert best["v", 1][1] == 1 and best["v", 1][0] == "extract"
    for f in (U.similar_patterns, U.pattern_recommendations):
        assert f(found, now.limit(0)).count() == 0 and f(found.limit(0), now).count() == 0


def test_workflows(spark, cycle):
    s = {r["user_id"]: (r["steps"], r["repeated"], r["loose"], r["score"]) for r in U.workflow_suggestions(cycle, U.patterns(cycle, 0.05, 0.1, 0.3), 4).collect()}
    assert s == {"u": (4, 1, 0, 0.75), "v": (1, 0, 0, 1.0)}
    loose = {r["user_id"]: r["loose"] for r in U.workflow_suggestions(cycle, U.patterns(cycle).limit(0), 4).collect()}
    assert loose == {"u": 3, "v": 0}
    stats = {r["user_id"]: (r["runs"], r["success_rate"], r["mean_steps"], r["mean_seconds"]) for r in U.workflow_stats(U.workflow_runs(cycle)).collect()}
    assert stats == {"u": (1, 1.0, 60.0, 60.0), "v": (1, 0.0, 1.0, None)}
    assert {(r["user_id"], r["tool_name"], r["mean_time"]) for r in U.slow_steps(cycle, 0, 0.5).collect()} == {("u", "extract", 1.0)}  # the first by name among equals
    assert U.slow_steps(cycle).count() == 0 and U.workflow_stats(U.workflow_runs(cycle.limit(0))).count() == 0
    scores = {r["user_id"]: r["score"] for r in U.system_score(spark.createDataFrame([("high",), ("low",), (None,)], "severity string"), U.workflow_suggestions(cycle, U.patterns(cycle, 0.05, 0.1, 0.3), 4)).collect()}
    assert scores == {"u": 0.81, "v": 0.86}


def test_summary_and_order(spark, cycle):
    got = {r["user_id"]: (r["executions"], r["seconds"], r["recent_tools"]) for r in U.execution_summary(cycle, 2).collect()}
    assert got == {"u": (60, 59, "extract>format"), "v": (1, 0, "scan")}
    steps = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, "x"), ("b", 1, "y"), ("b", 2, "x"), ("b", 3, None)], "key string, pos int, tool_name string")
    needs = spark.createDataFrame([("y", "x"), ("y", "x"), ("x", "z")], "tool_name string, needed string")
    bad = {(r["key"], r["pos"], r["missing"]) for r in U.sequence_violations(steps, needs).collect()}
    assert bad == {("a", 1, "z"), ("a", 3, "z"), ("b", 1, "x"), ("b", 2, "z")}
    assert U.sequence_violations(steps.limit(0), needs).count() == 0 and U.sequence_violations(steps, needs.limit(0)).count() == 0
