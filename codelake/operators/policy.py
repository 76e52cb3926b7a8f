"""Rules as data: predicate trees compiled to columns, policies evaluated by priority, metric states."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def predicate(rule: dict | str, columns: list[str]) -> Column:
    """Column for a rule tree of conditions, ``and``, ``or`` and ``not``.

    A condition has field, operator (equals, not_equals, greater_than,
    less_than, contains, in, not_in) and value. A missing field, a null and an
    unknown operator or type are false, so ``not`` of them is true.
    """
    r = json.loads(rule) if isinstance(rule, str) else rule
    kind = r.get("type", "condition")
    if kind in ("and", "or"):
        parts = [predicate(x, columns) for x in r.get("rules", r.get("conditions", []))]
        out = F.lit(kind == "and")
        for p in parts:
            out = (out & p) if kind == "and" else (out | p)
        return out
    if kind == "not":
        return ~predicate(r.get("rule", r.get("condition", {})), columns)
    name, v = r.get("field"), r.get("value")
    if kind != "condition" or name not in columns:
        return F.lit(False)
    c = F.col(name)
    tests = {
        "equals": lambda: c == v, "not_equals": lambda: c != v, "greater_than": lambda: c > v, "less_than": lambda: c < v,
        "contains": lambda: c.cast("string").contains(str(v)), "in": lambda: c.isin(*v), "not_in": lambda: ~c.isin(*v)}
    test = tests.get(r.get("operator", ""))
    return F.coalesce(test(), F.lit(False)) if test else F.lit(False)


# Fixed default policies: id, mode, strategy, priority, rules.
DEFAULTS = (
    ("reliability_focused", "assisted", "reliability", 5, [{"type": "condition", "field": "task_type", "operator": "in", "value": ["critical", "production"]}]),
    ("perf_focused", "automated", "performance", 3, [{"type": "condition", "field": "priority", "operator": "equals", "value": "high"}]),
    ("learning_focused", "autonomous", "learning", 1, [{"type": "condition", "field": "environment", "operator": "equals", "value": "development"}]),
)


def evaluated(contexts: DataFrame, policies=DEFAULTS) -> DataFrame:
    """Adds policy_id, mode, strategy: the first policy by priority all of whose rules hold, else assisted and balanced.

    Without any policy the mode is manual.
    """
    pick = None
    for pid, mode, strategy, _, rules in sorted(policies, key=lambda p: -p[3]):
        holds = F.lit(True)
        for r in rules:
            holds = holds & predicate(r, contexts.columns)
        s = F.struct(F.lit(pid).alias("policy_id"), F.lit(mode).alias("mode"), F.lit(strategy).alias("strategy"))
        pick = F.when(holds, s) if pick is None else pick.when(holds, s)
    base = F.struct(F.lit(None).cast("string").alias("policy_id"), F.lit("assisted" if policies else "manual").alias("mode"), F.lit("balanced").alias("strategy"))
    return contexts.withColumn("_p", base if pick is None else pick.otherwise(base)).select(*contexts.columns, "_p.*")


def metric_status(metrics: DataFrame) -> DataFrame:
    """Last value of each metric and its state against the limits warn and crit; ratios are worse when lower."""
    last = metrics.groupBy("name").agg(F.max_by(F.struct("value", "unit", "warn", "crit"), "ts").alias("m")).select("name", "m.*")
    bad = lambda limit: F.when(F.col("unit") == "ratio", F.col("value") <= limit).otherwise(F.col("value") >= limit)
    return last.withColumn("status", F.when(bad(F.col("crit")), "critical").when(bad(F.col("warn")), "warning").otherwise("healthy"))


def overall(status: DataFrame) -> DataFrame:
    """The worst state of all metrics; unknown without any."""
    worst = F.max(F.when(F.col("status") == "critical", 3).when(F.col("status") == "warning", 2).otherwise(1)).alias("w")
    return status.agg(worst).select(F.when(F.col("w") == 3, "critical").when(F.col("w") == 2, "warning").when(F.col("w") == 1, "healthy").otherwise("unknown").alias("overall"))
