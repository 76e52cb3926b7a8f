"""Queries over usage events, messages, vectors and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelake import tables as T
from codelake.functions import text as X
from codelake.operators import dialogue as L
from codelake.operators import policy as P
from codelake.operators import usage as U
from codelake.plans.sql import EVENTS, MESSAGES, w
from codelake.registry import op

_D = "CAST(execution_time AS DECIMAL(18,4))"
_STATS = f"ts AS (SELECT tool_name, count(*) AS uses, round(avg(success::INT::DOUBLE), 6) AS success_rate, round(sum({_D})::DOUBLE / count(execution_time), 6) AS avg_time, count(DISTINCT user_id) AS users, arg_max(ts, seq) AS last_used FROM ev GROUP BY 1)"
_TRI = "tr AS (SELECT tool_name AS t1, lead(tool_name, 1) OVER (ORDER BY seq) AS t2, lead(tool_name, 2) OVER (ORDER BY seq) AS t3 FROM ev), g AS (SELECT t1, t2, t3, count(*) AS n FROM tr WHERE t3 IS NOT NULL GROUP BY ALL)"
_SETS = "us AS (SELECT user_id, list_sort(list(DISTINCT tool_name)) AS tools FROM (SELECT * FROM ev WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) <= 100) GROUP BY 1)"


@op("tool_stats", "usage", w(EVENTS, _STATS) + "SELECT * FROM ts")
def tool_stats(spark: SparkSession, d: str) -> DataFrame:
    """Uses, success rate, mean time, users and last use of each tool."""
    return U.tool_stats(T.events(spark, d))


@op("user_history", "usage", w(EVENTS) + "SELECT user_id, seq, tool_name FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) <= 10")
def user_history(spark: SparkSession, d: str) -> DataFrame:
    """The last ten events of each user."""
    return U.history(T.events(spark, d), 10, "user_id").select("user_id", "seq", "tool_name")


@op("recent_history", "usage", w(EVENTS) + "SELECT seq, tool_name FROM ev ORDER BY seq DESC LIMIT 50")
def recent_history(spark: SparkSession, d: str) -> DataFrame:
    """The last 50 events."""
    return U.history(T.events(spark, d), 50).select("seq", "tool_name")


@op("popular_tools", "usage", w(EVENTS) + "SELECT tool_name, count(*) AS uses FROM ev GROUP BY 1 ORDER BY uses DESC, min(seq) LIMIT 10")
def popular_tools(spark: SparkSession, d: str) -> DataFrame:
    """The most used tools."""
    return U.popular(T.events(spark, d))


@op("sliding_trigrams", "usage", w(EVENTS, _TRI) + "SELECT * FROM g")
def sliding_trigrams(spark: SparkSession, d: str) -> DataFrame:
    """Counts of all runs of three tools."""
    return U.ngrams(T.events(spark, d), 3)


@op("sequential_patterns", "usage", w(EVENTS, _TRI) + "SELECT 'seq_' || substr(md5('(''' || t1 || ''', ''' || t2 || ''', ''' || t3 || ''')'), 1, 8) AS pattern_id, t1, t2, t3, n, round(n / (SELECT sum(n) FROM g), 6) AS support FROM g WHERE round(n / (SELECT sum(n) FROM g), 6) >= 0.01")
def sequential_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Frequent runs of three tools."""
    return U.sequential_patterns(T.events(spark, d), 0.01)


@op("cooccurrence", "usage", w(EVENTS) + """
    , x AS (SELECT (seq - 1) // 3 AS w, list(DISTINCT tool_name) AS tools FROM ev GROUP BY 1), y AS (SELECT w, unnest(tools) AS tool FROM x WHERE len(tools) > 1), s AS (SELECT tool, count(*) AS n FROM y GROUP BY 1),
    p AS (SELECT a.tool AS a, c.tool AS b, count(*) AS n FROM y a JOIN y c ON a.w = c.w AND a.tool < c.tool GROUP BY 1, 2), t AS (SELECT ceil(max(seq) / 3) AS windows FROM ev)
    SELECT p.a, p.b, p.n, round(p.n / t.windows, 6) AS support, round(greatest(p.n / sa.n, p.n / sb.n), 6) AS confidence FROM p JOIN s sa ON sa.tool = p.a JOIN s sb ON sb.tool = p.b, t WHERE round(p.n / t.windows, 6) >= 0.05 AND round(greatest(p.n / sa.n, p.n / sb.n), 6) >= 0.3""")
def cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """Tools used within the same windows of three events."""
    return U.cooccurrence(T.events(spark, d), 0.05, 0.3)


@op("next_event_prob", "usage", w(EVENTS, _TRI) + ", z AS (SELECT src, dst, sum(n)::BIGINT AS weight FROM (SELECT t1 AS src, t2 AS dst, n FROM g UNION ALL SELECT t2, t3, n FROM g) GROUP BY 1, 2) SELECT *, round(weight / sum(weight) OVER (PARTITION BY src), 6) AS probability FROM z")
def next_event_prob(spark: SparkSession, d: str) -> DataFrame:
    """Probability of each tool after each other one."""
    return U.next_tools(T.events(spark, d))


@op("user_similarity_topk", "usage", w(EVENTS, _SETS) + """
    , q AS (SELECT * FROM us WHERE user_id::BIGINT % 20 = 0), p AS (SELECT q.user_id, us.user_id AS other, round(len(list_intersect(q.tools, us.tools)) / len(list_distinct(list_concat(q.tools, us.tools))), 6) AS similarity FROM q JOIN us ON q.user_id <> us.user_id)
    SELECT * FROM p WHERE similarity > 0.3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, other) <= 3""")
def user_similarity_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three users with the most similar tools, for every user whose id is divisible by 20."""
    e = T.events(spark, d)
    return U.similar_users(e, e.filter("cast(user_id as bigint) % 20 = 0")).select("user_id", "other", "similarity")


@op("collab_recs", "usage")
def collab_recs(spark: SparkSession, d: str) -> DataFrame:
    """Tools that similar users use, for every user whose id is divisible by 20."""
    e = T.events(spark, d)
    return U.recommendations(e, e.filter("cast(user_id as bigint) % 20 = 0"))


@op("demand_forecast", "usage", w(EVENTS) + ", c AS (SELECT ts::DATE AS day, tool_name, count(*) AS n FROM ev GROUP BY 1, 2), r AS (SELECT DISTINCT day FROM c ORDER BY day DESC LIMIT 7) SELECT tool_name, round(avg(n), 6) AS expected, round(least(0.9, (SELECT count(*) FROM r) / 7), 6) AS confidence FROM c WHERE day IN (SELECT day FROM r) GROUP BY 1")
def demand_forecast(spark: SparkSession, d: str) -> DataFrame:
    """Expected uses a day of each tool."""
    return U.forecast(T.events(spark, d))


@op("bottlenecks", "usage", w(EVENTS, _STATS) + """
    SELECT tool_name, 'high_error_rate' AS kind, CASE WHEN success_rate < 0.6 THEN 'high' ELSE 'medium' END AS severity, success_rate AS value FROM ts WHERE success_rate < 0.8
    UNION ALL SELECT tool_name, 'slow_execution', CASE WHEN avg_time > 10 THEN 'high' ELSE 'medium' END, avg_time FROM ts WHERE avg_time > 5
    UNION ALL SELECT tool_name, 'underutilized', 'low', uses::DOUBLE FROM ts WHERE uses < 5 AND (SELECT count(*) FROM ev) > 100""")
def bottlenecks(spark: SparkSession, d: str) -> DataFrame:
    """Tools that fail, are slow or go unused."""
    return U.bottlenecks(T.events(spark, d))


@op("user_hour_needs", "usage", w(EVENTS) + """
    , a AS (SELECT user_id, tool_name, count(*) AS n, count(*) FILTER (hour(ts) = 9) AS h FROM ev WHERE user_id IS NOT NULL GROUP BY 1, 2), s AS (SELECT user_id, tool_name, round(0.7 * n / sum(n) OVER u + 0.3 * coalesce(h / nullif(sum(h) OVER u, 0), 0.0), 9)::DOUBLE AS score, round(least(0.9, sum(n) OVER u / 100), 6)::DOUBLE AS confidence FROM a WINDOW u AS (PARTITION BY user_id))
    SELECT * FROM s WHERE score > 0.1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, tool_name) <= 10""")
def user_hour_needs(spark: SparkSession, d: str) -> DataFrame:
    """Tools that each user is likely to need at nine."""
    return U.user_needs(T.events(spark, d), 9)


@op("insights_totals", "usage", w(EVENTS) + "SELECT count(*) AS events, count(DISTINCT tool_name) AS tools, count(DISTINCT user_id) AS users, round(avg(success::INT::DOUBLE), 6) AS success_rate FROM ev")
def insights_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals over all events."""
    return T.events(spark, d).agg(F.count("*").alias("events"), F.count_distinct("tool_name").alias("tools"), F.count_distinct("user_id").alias("users"), F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"))


_CO = """
    x AS (SELECT (seq - 1) // 3 AS w, list(DISTINCT tool_name) AS tools FROM ev GROUP BY 1), y AS (SELECT w, unnest(tools) AS tool FROM x WHERE len(tools) > 1), sg AS (SELECT tool, count(*) AS n FROM y GROUP BY 1),
    pr AS (SELECT a.tool AS a, c.tool AS b, count(*) AS n FROM y a JOIN y c ON a.w = c.w AND a.tool < c.tool GROUP BY 1, 2), wn AS (SELECT ceil(max(seq) / 3) AS windows FROM ev),
    co AS (SELECT pr.a, pr.b, pr.n, round(pr.n / wn.windows, 6) AS support, round(greatest(pr.n / sa.n, pr.n / sb.n), 6) AS confidence FROM pr JOIN sg sa ON sa.tool = pr.a JOIN sg sb ON sb.tool = pr.b, wn WHERE round(pr.n / wn.windows, 6) >= 0.05 AND round(greatest(pr.n / sa.n, pr.n / sb.n), 6) >= 0.3),
    pt AS (SELECT 'seq_' || substr(md5('(''' || t1 || ''', ''' || t2 || ''', ''' || t3 || ''')'), 1, 8) AS pattern_id, 'sequence' AS kind, [t1, t2, t3] AS tools, n AS frequency, round(n / (SELECT sum(n) FROM g), 6) AS support, round(n / (SELECT sum(n) FROM g), 6) AS confidence FROM g WHERE round(n / (SELECT sum(n) FROM g), 6) >= 0.01
        UNION ALL SELECT 'co_' || substr(md5(a || '|' || b), 1, 8), 'pair', [a, b], n, support, confidence FROM co),
    cu AS (SELECT user_id, list(DISTINCT tool_name) AS tools, arg_max(tool_name, seq) AS last_tool FROM (SELECT * FROM ev WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) <= 3) GROUP BY 1),
    sm AS (SELECT user_id, pattern_id, round(len(list_intersect(cu.tools, list_distinct(pt.tools))) / len(list_distinct(list_concat(cu.tools, pt.tools))), 6) AS similarity FROM cu, pt WHERE len(list_intersect(cu.tools, pt.tools)) > 0),
    sr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, pattern_id) AS rank FROM sm QUALIFY rank <= 5),
    rc AS (SELECT user_id, tool_name, arg_min(confidence, rank) AS confidence FROM (SELECT sr.user_id, sr.rank, pt.confidence, unnest(list_distinct(pt.tools)) AS tool_name FROM sr JOIN pt USING (pattern_id)) WHERE NOT EXISTS (SELECT 1 FROM cu WHERE cu.user_id = user_id AND FALSE) GROUP BY 1, 2)"""
_RC = _CO.replace(" WHERE NOT EXISTS (SELECT 1 FROM cu WHERE cu.user_id = user_id AND FALSE)", " z JOIN cu USING (user_id) WHERE NOT list_contains(cu.tools, z.tool_name)").replace("SELECT user_id, tool_name, arg_min(confidence, rank)", "SELECT user_id, tool_name, arg_min(z.confidence, z.rank)")
_WF = "ls AS (SELECT user_id, tool_name, seq, lead(tool_name) OVER (PARTITION BY user_id ORDER BY seq) AS nx FROM (SELECT * FROM ev WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) <= 8)), hp AS (SELECT DISTINCT a, b FROM (SELECT unnest(tools) AS a, tools FROM pt), unnest(tools) AS u(b)), wf AS (SELECT user_id, count(*) AS steps, count(*) - count(DISTINCT tool_name) AS repeated, count(*) FILTER (nx IS NOT NULL AND nx <> tool_name AND NOT EXISTS (SELECT 1 FROM hp WHERE hp.a = tool_name AND hp.b = nx)) AS loose FROM ls GROUP BY 1)"


@op("pattern_discovery", "usage", w(EVENTS, _TRI, _RC) + "SELECT pattern_id, kind, array_to_string(tools, '>') AS tools, frequency, support, confidence FROM pt")
def pattern_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Frequent runs and pairs of tools in one table."""
    return U.patterns(T.events(spark, d)).withColumn("tools", F.array_join("tools", ">"))


@op("similar_patterns", "usage", w(EVENTS, _TRI, _RC) + "SELECT user_id, pattern_id, similarity, rank::INTEGER AS rank FROM sr")
def similar_patterns(spark: SparkSession, d: str) -> DataFrame:
    """The five patterns most like the last three tools of each user."""
    e = T.events(spark, d)
    return U.similar_patterns(U.patterns(e), U.current_tools(e))


@op("pattern_recs", "usage", w(EVENTS, _TRI, _RC) + "SELECT * FROM rc")
def pattern_recs(spark: SparkSession, d: str) -> DataFrame:
    """Tools of similar patterns that each user is not using."""
    e = T.events(spark, d)
    return U.pattern_recommendations(U.patterns(e), U.current_tools(e))


@op("combined_recs", "usage", w(EVENTS, _TRI, _RC) + """
    , z AS (SELECT src, dst, sum(n)::BIGINT AS weight FROM (SELECT t1 AS src, t2 AS dst, n FROM g UNION ALL SELECT t2, t3, n FROM g) GROUP BY 1, 2), nt AS (SELECT *, round(weight / sum(weight) OVER (PARTITION BY src), 6) AS probability FROM z),
    al AS (SELECT user_id, dst AS tool_name, probability AS confidence, 1 AS source FROM cu JOIN nt ON nt.src = cu.last_tool UNION ALL SELECT user_id, tool_name, confidence, 2 FROM rc), f AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY user_id, tool_name ORDER BY source) = 1)
    SELECT user_id, tool_name, source, confidence, (row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, tool_name))::INTEGER AS rank FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, tool_name) <= 5""")
def combined_recs(spark: SparkSession, d: str) -> DataFrame:
    """The five surest tools for each user, by what follows the last one and by similar patterns."""
    e = T.events(spark, d)
    return U.combined_recommendations(e, U.patterns(e), U.current_tools(e))


@op("workflow_suggestions", "usage", w(EVENTS, _TRI, _RC, _WF) + "SELECT *, round(1 - (repeated + loose) / steps, 6) AS score FROM wf")
def workflow_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Repeated and loosely joined steps among the last eight of each user."""
    e = T.events(spark, d)
    return U.workflow_suggestions(e, U.patterns(e))


_RUNS = f"wr AS (SELECT user_id, ts::DATE AS day, count(*) AS steps, bool_and(success) AS succeeded, sum({_D}) AS seconds FROM ev WHERE user_id IS NOT NULL GROUP BY 1, 2)"


@op("workflow_stats", "usage", w(EVENTS, _RUNS) + "SELECT user_id, count(*) AS runs, round(avg(succeeded::INT::DOUBLE), 6) AS success_rate, round(avg(steps), 6) AS mean_steps, round(sum(seconds)::DOUBLE / count(seconds), 6) AS mean_seconds FROM wr GROUP BY 1")
def workflow_stats(spark: SparkSession, d: str) -> DataFrame:
    """Runs, success, steps and time of each user's days."""
    return U.workflow_stats(U.workflow_runs(T.events(spark, d)))


@op("slow_steps", "stream", w(EVENTS, _RUNS) + f", o AS (SELECT user_id, count(*) AS runs FROM wr GROUP BY 1 HAVING count(*) > 5), mt AS (SELECT user_id, tool_name, round(sum({_D})::DOUBLE / count(*), 6) AS mean_time FROM ev WHERE user_id IS NOT NULL AND execution_time IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY mean_time DESC, tool_name) = 1) SELECT user_id, runs, tool_name, mean_time FROM mt JOIN o USING (user_id) WHERE mean_time > 1.0")
def slow_steps(spark: SparkSession, d: str) -> DataFrame:
    """The slowest tool of each user with more than five days of use."""
    return U.slow_steps(T.events(spark, d))


@op("execution_summary", "usage", w(EVENTS) + ", l AS (SELECT user_id, string_agg(tool_name, '>' ORDER BY seq) AS recent_tools FROM (SELECT * FROM ev WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) <= 5) GROUP BY 1) SELECT user_id, count(*) AS executions, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000)::BIGINT AS seconds, any_value(recent_tools) AS recent_tools FROM ev JOIN l USING (user_id) GROUP BY 1")
def execution_summary(spark: SparkSession, d: str) -> DataFrame:
    """Events, duration and the last five tools of each user."""
    return U.execution_summary(T.events(spark, d))


NEEDS = (("purchase", "click"), ("purchase", "signup"), ("click", "view"))  # tool, what must come before it


@op("sequence_violations", "stream", w(EVENTS) + """
    , nd(tool_name, needed) AS (VALUES ('purchase', 'click'), ('purchase', 'signup'), ('click', 'view')), s AS (SELECT user_id AS key, seq AS pos, tool_name FROM ev WHERE user_id IS NOT NULL)
    SELECT s.key, s.pos, s.tool_name, nd.needed AS missing FROM s JOIN nd USING (tool_name) WHERE NOT EXISTS (SELECT 1 FROM s p WHERE p.key = s.key AND p.tool_name = nd.needed AND p.pos < s.pos)""")
def sequence_violations(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user before which a prerequisite is missing."""
    steps = T.events(spark, d).filter("user_id is not null").select(F.col("user_id").alias("key"), F.col("seq").alias("pos"), "tool_name")
    return U.sequence_violations(steps, spark.createDataFrame(list(NEEDS), "tool_name string, needed string"))


@op("system_score", "usage", w(EVENTS, _TRI, _RC, _WF, _STATS) + """
    , bn AS (SELECT CASE WHEN success_rate < 0.6 THEN 'high' ELSE 'medium' END AS severity FROM ts WHERE success_rate < 0.8 UNION ALL SELECT CASE WHEN avg_time > 10 THEN 'high' ELSE 'medium' END FROM ts WHERE avg_time > 5 UNION ALL SELECT 'low' FROM ts WHERE uses < 5 AND (SELECT count(*) FROM ev) > 100),
    ls2 AS (SELECT coalesce(sum(CASE severity WHEN 'high' THEN 0.1 WHEN 'medium' THEN 0.05 ELSE 0.02 END), 0) AS loss FROM bn)
    SELECT user_id, repeated + loose AS suggestions, round(greatest(0.0, least(1.0, 1.0 - 0.05 * (repeated + loose) - loss))::DOUBLE, 6) AS score FROM wf, ls2""")
def system_score(spark: SparkSession, d: str) -> DataFrame:
    """Score of each user's way of working, less what suggestions and bottlenecks cost."""
    e = T.events(spark, d)
    return U.system_score(U.bottlenecks(e), U.workflow_suggestions(e, U.patterns(e)))


@op("moving_avg_alerts", "stream", w(EVENTS) + f", x AS (SELECT tool_name, seq, row_number() OVER (PARTITION BY tool_name ORDER BY seq) AS k, avg({_D}) OVER (PARTITION BY tool_name ORDER BY seq ROWS 9 PRECEDING) AS m FROM ev WHERE execution_time <> 0) SELECT tool_name, seq, round(m::DOUBLE, 4) AS mean_time FROM x WHERE k > 10 AND m > 2.0")
def moving_avg_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Events at which the mean of a tool's last ten times is too long."""
    return U.moving_average_alerts(T.events(spark, d))


@op("last5_perf", "stream", w(EVENTS) + ", x AS (SELECT * FROM ev WHERE execution_time IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tool_name ORDER BY seq DESC) <= 5) SELECT tool_name, count(*) AS n, round(avg(execution_time), 6) AS mean_time, round(stddev_samp(execution_time), 6) AS deviation, avg(execution_time) > 1.5 AS slow, stddev_samp(execution_time) < 0.1 * avg(execution_time) AS steady FROM x GROUP BY 1 HAVING count(*) >= 5")
def last5_perf(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of each tool's last five times."""
    return U.recent_performance(T.events(spark, d))


@op("resource_usage", "stream", w(EVENTS) + f"SELECT tool_name, round(sum({_D})::DOUBLE, 4) AS total_time, max(execution_time) AS longest, count(*) AS uses, max(ts) AS last_ts FROM ev GROUP BY 1")
def resource_usage(spark: SparkSession, d: str) -> DataFrame:
    """Total and greatest times of each tool."""
    return U.resource_usage(T.events(spark, d))


@op("idle_users", "stream", w(EVENTS) + "SELECT user_id, max(ts) AS last_ts FROM ev GROUP BY 1 HAVING max(ts) < (SELECT max(ts) - INTERVAL 24 HOUR FROM ev)")
def idle_users(spark: SparkSession, d: str) -> DataFrame:
    """Users without an event in the last day of the log."""
    e = T.events(spark, d)
    now = F.broadcast(e.agg(F.max("ts").alias("now")))  # one row
    return e.groupBy("user_id").agg(F.max("ts").alias("last_ts")).crossJoin(now).filter(F.col("last_ts") < F.col("now") - F.expr("interval 24 hours")).drop("now")


@op("status_change", "stream", w(EVENTS) + ", h AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS h, CASE WHEN avg((NOT success)::INT) > 0.25 THEN 'degraded' ELSE 'normal' END AS status FROM ev GROUP BY 1) SELECT h, status FROM h QUALIFY lag(status) OVER (ORDER BY h) IS DISTINCT FROM status")
def status_change(spark: SparkSession, d: str) -> DataFrame:
    """Hours at which the state of the system changes."""
    h = T.events(spark, d).groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.when(F.avg((~F.col("success")).cast("int")) > 0.25, "degraded").otherwise("normal").alias("status"))
    return h.withColumn("before", F.lag("status").over(Window.orderBy("h"))).filter(~F.col("before").eqNullSafe(F.col("status"))).select("h", "status")  # one row for each hour


@op("metric_status", "stream", w(EVENTS) + ", x AS (SELECT tool_name AS name, arg_max(execution_time, seq) AS value FROM ev GROUP BY 1) SELECT name, value, CASE WHEN value >= 10 THEN 'critical' WHEN value >= 5 THEN 'warning' ELSE 'healthy' END AS status FROM x")
def metric_status(spark: SparkSession, d: str) -> DataFrame:
    """State of each tool's last time against the limits."""
    m = T.events(spark, d).select(F.col("tool_name").alias("name"), F.col("execution_time").alias("value"), F.lit("seconds").alias("unit"), F.lit(5.0).alias("warn"), F.lit(10.0).alias("crit"), F.col("seq").alias("ts"))
    return P.metric_status(m).select("name", "value", "status")


@op("policy_mode", "rules", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('critical', 'P') THEN 'assisted' WHEN o_orderpriority = '1-URGENT' THEN 'automated' ELSE 'assisted' END AS mode, CASE WHEN o_orderstatus IN ('critical', 'P') THEN 'reliability' WHEN o_orderpriority = '1-URGENT' THEN 'performance' ELSE 'balanced' END AS strategy FROM orders")
def policy_mode(spark: SparkSession, d: str) -> DataFrame:
    """Mode and strategy that the policies give each order."""
    rules = (
        ("reliable", "assisted", "reliability", 5, [{"type": "condition", "field": "o_orderstatus", "operator": "in", "value": ["critical", "P"]}]),
        ("fast", "automated", "performance", 3, [{"type": "not", "rule": {"type": "not", "rule": {"type": "condition", "field": "o_orderpriority", "operator": "equals", "value": "1-URGENT"}}}]),
        ("missing", "autonomous", "learning", 4, [{"type": "condition", "field": "no_such_field", "operator": "equals", "value": 1}]))
    return P.evaluated(T.read(spark, d, "orders"), rules).select("o_orderkey", "mode", "strategy")


@op("rate_limit_decisions", "stream")
def rate_limit_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decision of the limiter for each event of each user."""
    return U.rate_limited(T.events(spark, d), limit=3, window_s=86_400.0)


@op("est_tokens", "tokens", "SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 3.5)) END::INTEGER AS tokens FROM documents")
def est_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Estimated tokens of each document."""
    return T.read(spark, d, "documents").select("doc_id", X.est_tokens("text").alias("tokens"))


@op("truncated", "tokens", "SELECT doc_id, left(text, 175) AS head FROM documents WHERE text IS NOT NULL")
def truncated(spark: SparkSession, d: str) -> DataFrame:
    """Each text cut to 50 estimated tokens."""
    return T.read(spark, d, "documents").filter("text is not null").select("doc_id", L.truncated(F.col("text"), 50).alias("head"))


_MSG = MESSAGES + r", ms AS (SELECT conv_id, turn, nullif(regexp_extract(line, '^(user|assistant|system): ', 1), '') AS role, regexp_replace(line, '^(?:user|assistant|system): ', '') AS content FROM m)"
_EST = "CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, floor(length(content) / 3.5)) END"


@op("conv_tokens", "tokens", w(_MSG) + f"SELECT conv_id, count(*) AS messages, sum(4 + {_EST})::BIGINT AS tokens FROM ms GROUP BY 1")
def conv_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Estimated tokens of each conversation."""
    return L.conversation_tokens(L.messages_of(T.read(spark, d, "documents")))


@op("history_tail12", "tokens", w(_MSG) + "SELECT conv_id, turn::INTEGER AS turn, role FROM ms QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 12")
def history_tail12(spark: SparkSession, d: str) -> DataFrame:
    """The last twelve messages of each conversation."""
    return L.tail(L.messages_of(T.read(spark, d, "documents"))).select("conv_id", "turn", "role")


@op("history_summary", "tokens", w(_MSG) + ", x AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM ms) SELECT conv_id, string_agg('- ' || left(content, 80), chr(10) ORDER BY turn) AS summary FROM x WHERE n > 4 AND r > 4 AND role = 'user' GROUP BY 1")
def history_summary(spark: SparkSession, d: str) -> DataFrame:
    """Older user messages of each conversation, cut short."""
    return L.summarised(L.messages_of(T.read(spark, d, "documents")), 4)


@op("token_budget_prefix", "tokens", w(_MSG) + f", x AS (SELECT conv_id, turn, sum(4 + {_EST}) OVER (PARTITION BY conv_id ORDER BY turn) AS running FROM ms) SELECT conv_id, turn::INTEGER AS turn, running::BIGINT AS running FROM x WHERE running <= 160")
def token_budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Messages that fit a budget of 200 tokens."""
    return L.within_budget(L.messages_of(T.read(spark, d, "documents")), 200).select("conv_id", "turn", "running")


@op("cosine_topk", "vectors", "SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) DESC, b.vec_id) <= 5")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 20."""
    from codelake.operators.vectors import nearest

    e = T.read(spark, d, "embeddings")
    return nearest(e.filter("vec_id % 20 = 0"), e, 5)


@op("label_centroids", "vectors", "SELECT label, (i - 1)::INTEGER AS i, count(x) AS vectors, round(avg(x::DOUBLE), 5) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2")
def label_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Mean of each coordinate for each label, with the vectors that have it."""
    each = T.read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return each.groupBy("label", "i").agg(F.count("x").alias("vectors"), F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))
