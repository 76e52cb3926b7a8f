"""Analytics over tool-usage events: statistics, sequences, predictions, recommendations, forecasts, bottlenecks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelake.batches import rows


def sequenced(events: DataFrame) -> DataFrame:
    """Adds seq, the place of each event in the order of (ts, event_id), from 1.

    Minutes are numbered apart and shifted by the number of events before them,
    so no task orders more than a minute at once; offsets are one row a minute.
    Events without a time have no place and drop out.
    """
    day = events.withColumn("_d", F.date_trunc("minute", "ts"))
    offset = day.groupBy("_d").agg(F.count("*").alias("_n")).withColumn("_o", F.sum("_n").over(Window.orderBy("_d")) - F.col("_n"))
    w = Window.partitionBy("_d").orderBy("ts", "event_id")
    return day.withColumn("_k", F.row_number().over(w)).join(offset.select("_d", "_o"), "_d").withColumn("seq", F.col("_k") + F.col("_o")).drop("_d", "_k", "_o")


def tool_stats(e: DataFrame) -> DataFrame:
    """tool_name, uses, success_rate, avg_time, users (null ones don't count), last_used (of the greatest seq)."""
    return e.groupBy("tool_name").agg(
        F.count("*").alias("uses"), F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"), F.round(F.sum(F.col("execution_time").cast("decimal(18,4)")).cast("double") / F.count("execution_time"), 6).alias("avg_time"),
        F.count_distinct("user_id").alias("users"), F.max_by("ts", "seq").alias("last_used"))


def history(e: DataFrame, n: int, by: str | None = None) -> DataFrame:
    """The last ``n`` events by seq, of all or of each value of ``by``."""
    if by is None:
        return e.orderBy(F.desc("seq")).limit(n)
    w = Window.partitionBy(by).orderBy(F.desc("seq"))
    return e.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def popular(e: DataFrame, n: int = 10) -> DataFrame:
    """The most used tools, those first used first among equals."""
    return e.groupBy("tool_name").agg(F.count("*").alias("uses"), F.min("seq").alias("first_seq")).orderBy(F.desc("uses"), "first_seq").limit(n).select("tool_name", "uses")


BLOCK = 100_000  # events that one task numbers at a time


def following(e: DataFrame, k: int) -> DataFrame:
    """Each event with the tools of the k-1 events after it: seq, t1 ... tk; events without enough followers drop out.

    The order is global, so the events are cut into ranges of ``BLOCK`` and
    each range also gets the first k-1 events of the next one; windows then run
    within a range.
    """
    b = F.floor((F.col("seq") - 1) / BLOCK)
    own = e.select("seq", "tool_name", b.alias("b"), F.lit(True).alias("own"))
    lent = e.filter((F.col("seq") - 1) % BLOCK < k - 1).select("seq", "tool_name", (b - 1).alias("b"), F.lit(False).alias("own")).filter("b >= 0")
    w = Window.partitionBy("b").orderBy("seq")
    cols = [F.col("tool_name").alias("t1"), *(F.lead("tool_name", i).over(w).alias(f"t{i + 1}") for i in range(1, k))]
    reach = F.lead("seq", k - 1).over(w).alias("last_seq") if k > 1 else F.col("seq").alias("last_seq")
    return own.unionByName(lent).select("seq", "own", *cols, reach).filter("own and last_seq is not null").drop("own", "last_seq")


def ngrams(e: DataFrame, k: int = 3) -> DataFrame:
    """Counts of all runs of k consecutive tools: t1 ... tk, n."""
    return following(e, k).groupBy(*(f"t{i + 1}" for i in range(k))).agg(F.count("*").alias("n"))


def sequential_patterns(e: DataFrame, min_support: float = 0.1) -> DataFrame:
    """Runs of three with their support: pattern_id, t1, t2, t3, n, support."""
    g = ngrams(e, 3)
    total = g.agg(F.sum("n").alias("total"))
    named = F.concat(F.lit("seq_"), F.substring(F.md5(F.concat(F.lit("('"), "t1", F.lit("', '"), "t2", F.lit("', '"), "t3", F.lit("')"))), 1, 8))
    return g.crossJoin(F.broadcast(total)).withColumn("support", F.round(F.col("n") / F.col("total"), 6)).filter(F.col("support") >= min_support).select(named.alias("pattern_id"), "t1", "t2", "t3", "n", "support")


def cooccurrence(e: DataFrame, min_support: float = 0.1, min_confidence: float = 0.5) -> DataFrame:
    """Pairs of tools in tumbling windows of three events: a < b, n, support, confidence (the greater conditional share)."""
    w = e.groupBy(F.floor((F.col("seq") - 1) / 3).alias("w")).agg(F.array_sort(F.collect_set("tool_name")).alias("tools"))
    many = w.filter(F.size("tools") > 1)
    windows = e.agg(F.ceil(F.max("seq") / 3).alias("windows"))
    single = many.select(F.explode("tools").alias("tool")).groupBy("tool").agg(F.count("*").alias("n"))
    pair = many.select(F.explode("tools").alias("a"), "tools").select("a", F.explode("tools").alias("b")).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    out = pair.join(single.select(F.col("tool").alias("a"), F.col("n").alias("na")), "a").join(single.select(F.col("tool").alias("b"), F.col("n").alias("nb")), "b").crossJoin(F.broadcast(windows))
    return out.select("a", "b", "n", F.round(F.col("n") / F.col("windows"), 6).alias("support"), F.round(F.greatest(F.col("n") / F.col("na"), F.col("n") / F.col("nb")), 6).alias("confidence")).filter((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence))


def next_tools(e: DataFrame) -> DataFrame:
    """Probability of each tool after each other one: src, dst, weight, probability; weights come from both steps of each run of three."""
    g = ngrams(e, 3)
    w = g.select(F.col("t1").alias("src"), F.col("t2").alias("dst"), "n").unionByName(g.select(F.col("t2").alias("src"), F.col("t3").alias("dst"), "n")).groupBy("src", "dst").agg(F.sum("n").alias("weight"))
    return w.withColumn("probability", F.round(F.col("weight") / F.sum("weight").over(Window.partitionBy("src")), 6))


def tool_sets(e: DataFrame, last: int = 100) -> DataFrame:
    """Tools of each user's last ``last`` events: user_id, tools (sorted set); null users have none."""
    return history(e.filter("user_id is not null"), last, "user_id").groupBy("user_id").agg(F.array_sort(F.collect_set("tool_name")).alias("tools"))


def similar_users(e: DataFrame, of: DataFrame, last: int = 100, top: int = 3, least: float = 0.3) -> DataFrame:
    """For each user of ``of`` (user_id) the most similar other users by Jaccard similarity of their tool sets.

    Users are matched by their set, of which there are few, not with each
    other: (user_id, other, similarity), ties by the other's id.
    """
    s = tool_sets(e, last)
    sets = s.select("tools").distinct()
    want = s.join(of.select("user_id").distinct(), "user_id", "left_semi")
    inner = F.size(F.array_intersect("tools", "o"))
    near = want.select("tools").distinct().join(sets.select(F.col("tools").alias("o")), F.arrays_overlap("tools", "o")).withColumn("similarity", F.round(inner / F.size(F.array_union("tools", "o")), 6)).filter(F.col("similarity") > least)
    w = Window.partitionBy("user_id").orderBy(F.desc("similarity"), "other")
    return want.join(near, "tools").join(s.select(F.col("user_id").alias("other"), F.col("tools").alias("o")), "o").filter("user_id <> other").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("user_id", "other", "similarity", "tools", F.col("o").alias("other_tools"))


def recommendations(e: DataFrame, of: DataFrame) -> DataFrame:
    """Tools that similar users use and a user doesn't: user_id, tool, confidence (the greatest similarity)."""
    s = similar_users(e, of)
    return s.select("user_id", F.explode(F.array_except("other_tools", "tools")).alias("tool"), "similarity").groupBy("user_id", "tool").agg(F.max("similarity").alias("confidence"))


def forecast(e: DataFrame, days: int = 7) -> DataFrame:
    """Mean use a day over the last observed days on which a tool was used: tool_name, expected, confidence."""
    c = e.groupBy(F.to_date("ts").alias("day"), "tool_name").agg(F.count("*").alias("n"))
    recent = c.select("day").distinct().orderBy(F.desc("day")).limit(days)
    seen = recent.agg(F.count("*").alias("days"))
    return c.join(F.broadcast(recent), "day", "left_semi").groupBy("tool_name").agg(F.round(F.avg("n"), 6).alias("expected")).crossJoin(F.broadcast(seen)).select("tool_name", "expected", F.round(F.least(F.lit(0.9), F.col("days") / 7), 6).alias("confidence"))


def bottlenecks(e: DataFrame) -> DataFrame:
    """Tools with a low success rate, long times or little use: tool_name, kind, severity, value."""
    s = tool_stats(e)
    size = e.agg(F.count("*").alias("all_uses"))
    bad = s.filter("success_rate < 0.8").select("tool_name", F.lit("high_error_rate").alias("kind"), F.when(F.col("success_rate") < 0.6, "high").otherwise("medium").alias("severity"), F.col("success_rate").alias("value"))
    slow = s.filter("avg_time > 5").select("tool_name", F.lit("slow_execution").alias("kind"), F.when(F.col("avg_time") > 10, "high").otherwise("medium").alias("severity"), F.col("avg_time").alias("value"))
    rare = s.crossJoin(F.broadcast(size)).filter("uses < 5 and all_uses > 100").select("tool_name", F.lit("underutilized").alias("kind"), F.lit("low").alias("severity"), F.col("uses").cast("double").alias("value"))
    return bad.unionByName(slow).unionByName(rare)


def user_needs(e: DataFrame, hour: int) -> DataFrame:
    """Tools a user is likely to need at an hour: .7 of the share overall and .3 of the share within that hour; above .1, the best 10."""
    all_ = e.filter("user_id is not null").groupBy("user_id", "tool_name").agg(F.count("*").alias("n"), F.count_if(F.hour("ts") == hour).alias("h"))
    w = Window.partitionBy("user_id")
    score = 0.7 * F.col("n") / F.sum("n").over(w) + 0.3 * F.coalesce(F.col("h") / F.nullif(F.sum("h").over(w), F.lit(0)), F.lit(0.0))
    got = all_.withColumn("score", F.round(score, 9)).withColumn("confidence", F.round(F.least(F.lit(0.9), F.sum("n").over(w) / 100), 6)).filter("score > 0.1")
    return got.withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), "tool_name"))).filter("r <= 10").select("user_id", "tool_name", "score", "confidence")


def moving_average_alerts(e: DataFrame, size: int = 10, limit: float = 2.0) -> DataFrame:
    """Events from the eleventh of a tool on whose mean time over the last ten exceeds the limit; zero and null times are left out."""
    w = Window.partitionBy("tool_name").orderBy("seq")
    t = e.filter("execution_time <> 0").select("tool_name", "seq", F.row_number().over(w).alias("k"), F.avg(F.col("execution_time").cast("decimal(18,4)")).over(w.rowsBetween(1 - size, 0)).cast("double").alias("mean_time"))
    return t.filter((F.col("k") > size) & (F.col("mean_time") > limit)).select("tool_name", "seq", F.round("mean_time", 4).alias("mean_time"))


def recent_performance(e: DataFrame, last: int = 5) -> DataFrame:
    """Mean and deviation of the last times of each tool with at least as many: slow above 1.5 s, steady below a tenth of the mean."""
    h = history(e.filter("execution_time is not null"), last, "tool_name")
    return h.groupBy("tool_name").agg(F.count("*").alias("n"), F.round(F.avg("execution_time"), 6).alias("mean_time"), F.round(F.stddev_samp("execution_time"), 6).alias("deviation")).filter(F.col("n") >= last).withColumn("slow", F.col("mean_time") > 1.5).withColumn("steady", F.col("deviation") < 0.1 * F.col("mean_time"))


def resource_usage(e: DataFrame) -> DataFrame:
    """Total and greatest time, uses and last use of each tool."""
    return e.groupBy("tool_name").agg(F.round(F.sum(F.col("execution_time").cast("decimal(18,4)")).cast("double"), 4).alias("total_time"), F.max("execution_time").alias("longest"), F.count("*").alias("uses"), F.max("ts").alias("last_ts"))


def idle(e: DataFrame, now: Column, hours: int = 1) -> DataFrame:
    """Tools whose last use lies more than ``hours`` before ``now``."""
    return e.groupBy("tool_name").agg(F.max("ts").alias("last_ts")).filter(F.col("last_ts") < now - F.make_interval(hours=F.lit(hours)))


def rate_limited(e: DataFrame, key: str = "user_id", limit: int = 30, window_s: float = 60.0) -> DataFrame:
    """Decision of a sliding-window limiter for each event: key, seq, allowed, retry_after.

    An event is allowed while fewer than ``limit`` allowed ones lie within the
    last ``window_s`` seconds; refused ones take no place. Whether an event is
    allowed depends on the decisions before it, so each key runs in order.
    """
    from collections import deque

    kept: deque[float] = deque()
    at: list[str] = []  # the key at hand

    def decide(b: dict[str, list]) -> dict[str, list]:
        ok, retry = [], []
        for k, t in zip(b["key"], b["t"], strict=True):
            if at != [k]:
                at[:] = [k]
                kept.clear()
            while kept and kept[0] <= t - window_s:
                kept.popleft()
            if len(kept) < limit:
                kept.append(t)
                ok.append(True)
                retry.append(0.0)
            else:
                ok.append(False)
                retry.append(round(kept[0] - (t - window_s), 6))
        return {"key": b["key"], "seq": b["seq"], "allowed": ok, "retry_after": retry}

    picked = e.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), "seq", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return rows(picked.repartition("key").sortWithinPartitions("key", "seq"), decide, "key string, seq long, allowed boolean, retry_after double")


def patterns(e: DataFrame, min_support: float = 0.01, pair_support: float = 0.05, pair_confidence: float = 0.3) -> DataFrame:
    """Frequent runs and pairs in one table: pattern_id, kind, tools, frequency, support, confidence.

    A run is as sure as it is frequent. Supports bound the number of patterns, so the table stays small.
    """
    run = sequential_patterns(e, min_support).select("pattern_id", F.lit("sequence").alias("kind"), F.array("t1", "t2", "t3").alias("tools"), F.col("n").alias("frequency"), "support", F.col("support").alias("confidence"))
    pair = cooccurrence(e, pair_support, pair_confidence)
    named = F.concat(F.lit("co_"), F.substring(F.md5(F.concat_ws("|", "a", "b")), 1, 8))
    return run.unionByName(pair.select(named.alias("pattern_id"), F.lit("pair").alias("kind"), F.array("a", "b").alias("tools"), F.col("n").alias("frequency"), "support", "confidence"))


def current_tools(e: DataFrame, n: int = 3) -> DataFrame:
    """The tools of each user's last ``n`` events: user_id, tools (each once), last_tool; null users have none."""
    return history(e.filter("user_id is not null"), n, "user_id").groupBy("user_id").agg(F.array_sort(F.collect_set("tool_name")).alias("tools"), F.max_by("tool_name", "seq").alias("last_tool"))


def similar_patterns(found: DataFrame, current: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` patterns whose tools are most like those of each user: user_id, pattern_id, similarity, rank.

    Joined on the tools that both have, so users and patterns without a common tool never meet.
    """
    p = found.select("pattern_id", F.array_distinct("tools").alias("_t")).select("pattern_id", F.size("_t").alias("_np"), F.explode("_t").alias("tool"))
    c = current.select("user_id", F.size("tools").alias("_nc"), F.explode("tools").alias("tool"))
    both = c.join(p, "tool").groupBy("user_id", "pattern_id", "_np", "_nc").agg(F.count("*").alias("_n"))
    scored = both.select("user_id", "pattern_id", F.round(F.col("_n") / (F.col("_np") + F.col("_nc") - F.col("_n")), 6).alias("similarity"))
    w = Window.partitionBy("user_id").orderBy(F.desc("similarity"), "pattern_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def pattern_recommendations(found: DataFrame, current: DataFrame, k: int = 5) -> DataFrame:
    """Tools of each user's similar patterns that the user is not using: user_id, tool_name, confidence (of the most similar pattern that has it)."""
    near = similar_patterns(found, current, k).join(found.select("pattern_id", "tools", "confidence"), "pattern_id")
    each = near.select("user_id", "rank", "confidence", F.explode(F.array_distinct("tools")).alias("tool_name"))
    new = each.join(current.select("user_id", F.explode("tools").alias("tool_name")), ["user_id", "tool_name"], "left_anti")
    return new.groupBy("user_id", "tool_name").agg(F.min_by("confidence", "rank").alias("confidence"))


def combined_recommendations(e: DataFrame, found: DataFrame, current: DataFrame, k: int = 5) -> DataFrame:
    """What follows the user's last tool, then what similar patterns hold, each tool once by the first source that names it; the ``k`` surest."""
    after = next_tools(e).select(F.col("src").alias("last_tool"), F.col("dst").alias("tool_name"), F.col("probability").alias("confidence"))
    context = current.select("user_id", "last_tool").join(after, "last_tool").select("user_id", "tool_name", "confidence", F.lit(1).alias("source"))
    both = context.unionByName(pattern_recommendations(found, current).withColumn("source", F.lit(2)))
    first = both.groupBy("user_id", "tool_name").agg(F.min_by(F.struct("source", "confidence"), "source").alias("of"))
    w = Window.partitionBy("user_id").orderBy(F.desc("of.confidence"), "tool_name")
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("user_id", "tool_name", F.col("of.source").alias("source"), F.col("of.confidence").alias("confidence"), "rank")


def workflow_suggestions(e: DataFrame, found: DataFrame, n: int = 8) -> DataFrame:
    """What could be better in each user's last ``n`` steps: user_id, steps, repeated, loose, score.

    ``repeated``: steps whose tool came before; ``loose``: neighbouring steps
    of different tools that no pattern holds together; the score is 1 less the suggestions for each step.
    """
    w = Window.partitionBy("user_id").orderBy("seq")
    last = history(e.filter("user_id is not null"), n, "user_id").select("user_id", "seq", "tool_name").withColumn("next", F.lead("tool_name").over(w))
    tools = found.select("pattern_id", F.explode(F.array_distinct("tools")).alias("a"), "tools").select("a", F.explode(F.array_distinct("tools")).alias("b")).filter("a <> b").distinct()
    known = last.join(tools.withColumn("held", F.lit(1)), (F.col("tool_name") == F.col("a")) & (F.col("next") == F.col("b")), "left")
    loose = F.col("next").isNotNull() & (F.col("next") != F.col("tool_name")) & F.col("held").isNull()
    g = known.groupBy("user_id").agg(F.count("*").alias("steps"), (F.count("*") - F.count_distinct("tool_name")).alias("repeated"), F.count_if(loose).alias("loose"))
    return g.withColumn("score", F.round(1 - (F.col("repeated") + F.col("loose")) / F.col("steps"), 6))


def workflow_runs(e: DataFrame) -> DataFrame:
    """One row for each user and day: user_id, day, steps, succeeded (every step did), seconds."""
    return e.filter("user_id is not null").groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("steps"), F.coalesce(F.min("success"), F.lit(False)).alias("succeeded"), F.sum(F.col("execution_time").cast("decimal(18,4)")).alias("seconds"))


def workflow_stats(runs: DataFrame) -> DataFrame:
    """Runs, share of runs that succeeded, mean steps and seconds of each user."""
    return runs.groupBy("user_id").agg(
        F.count("*").alias("runs"), F.round(F.avg(F.col("succeeded").cast("double")), 6).alias("success_rate"), F.round(F.avg("steps"), 6).alias("mean_steps"),
        F.round(F.sum("seconds").cast("double") / F.count("seconds"), 6).alias("mean_seconds"))


def slow_steps(e: DataFrame, least_runs: int = 5, seconds: float = 1.0) -> DataFrame:
    """The tool with the longest mean time of each user with more than ``least_runs`` days, where it is longer than ``seconds``."""
    often = workflow_runs(e).groupBy("user_id").agg(F.count("*").alias("runs")).filter(F.col("runs") > least_runs)
    mean = e.filter("user_id is not null and execution_time is not null").groupBy("user_id", "tool_name").agg(F.round(F.sum(F.col("execution_time").cast("decimal(18,4)")).cast("double") / F.count("*"), 6).alias("mean_time"))
    top = mean.groupBy("user_id").agg(F.min(F.struct((-F.col("mean_time")).alias("m"), "tool_name")).alias("top"))
    return top.join(often, "user_id").select("user_id", "runs", F.col("top.tool_name").alias("tool_name"), (-F.col("top.m")).alias("mean_time")).filter(F.col("mean_time") > seconds)


def execution_summary(e: DataFrame, n: int = 5) -> DataFrame:
    """Duration from first to last event, events and the last ``n`` tools of each user, the latest last."""
    e = e.filter("user_id is not null")
    whole = e.groupBy("user_id").agg(F.count("*").alias("executions"), F.floor((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1_000_000).alias("seconds"))
    last = history(e, n, "user_id").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("seq", "tool_name"))).alias("l"))
    return whole.join(last, "user_id").select("user_id", "executions", "seconds", F.array_join(F.col("l.tool_name"), ">").alias("recent_tools"))


def sequence_violations(steps: DataFrame, needs: DataFrame) -> DataFrame:
    """Steps before which a prerequisite is missing: key, pos, tool_name, missing.

    ``steps``: key, pos, tool_name; ``needs``: tool_name, needed. A prerequisite
    must stand at a smaller place of the same key; for each step only the first place of a tool is compared.
    """
    first = steps.groupBy("key", F.col("tool_name").alias("needed")).agg(F.min("pos").alias("at"))
    asked = steps.join(needs.distinct(), "tool_name").join(first, ["key", "needed"], "left")
    return asked.filter(F.col("at").isNull() | (F.col("at") >= F.col("pos"))).select("key", "pos", "tool_name", F.col("needed").alias("missing"))


def system_score(found: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Each user's score: 1 less 0.05 for each suggestion and 0.1, 0.05 or 0.02 for each bottleneck by severity, from 0 to 1."""
    weight = F.when(F.col("severity") == "high", 0.1).when(F.col("severity") == "medium", 0.05).otherwise(0.02)
    loss = found.agg(F.coalesce(F.sum(weight), F.lit(0.0)).alias("loss"))
    n = suggestions.select("user_id", (F.col("repeated") + F.col("loose")).alias("suggestions"))
    return n.crossJoin(F.broadcast(loss)).select("user_id", "suggestions", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - 0.05 * F.col("suggestions") - F.col("loss"))), 6).alias("score"))  # one row on the right
