"""Usage, call and audit logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs as L
from ..sources import testdata as T
from .number_queries import _scaled, scaled
from .oracle import cte, pick
from .registry import query

_OUT = pick("event_id", "success", "success", "failure", "success", "cancelled", "success", "timeout")
cte("t_call", f"""
SELECT event_id AS id, ts, 'u'||user_id AS account_id, 't'||(user_id%40) AS thread_id, event_type AS schema_name, value AS latency_ms, json_extract_string(props,'$.k')::INT AS tokens, {_OUT} AS outcome FROM events""")


def usage(spark, sf):
    return T.calls(spark, sf).select(
        "id", "account_id", F.col("ts").alias("created_at"), (F.col("tokens") - 20).alias("prompt_tokens"), F.col("tokens").alias("completion_tokens"),
        "latency_ms", (F.col("outcome") == "success").alias("success"),
    )


_USE = "SELECT account_id, count(*) AS calls, count(*) FILTER (outcome<>'success') AS failed, sum(greatest(tokens-20,0))::BIGINT AS prompt_tokens, sum(tokens)::BIGINT AS completion_tokens, sum(greatest(tokens-20,0)+tokens)::BIGINT AS total_tokens FROM t_call"


@query("usage_by_account", _USE + " WHERE ts>=TIMESTAMP '2024-01-10' GROUP BY ALL")
def usage_by_account(spark, sf):
    return L.usage_by_account(usage(spark, sf), F.lit("2024-01-10").cast("timestamp_ntz"))


@query("usage_summary", f"""
WITH u AS ({_USE} WHERE ts>=TIMESTAMP '2024-01-25' - INTERVAL 7 DAY AND ts>=TIMESTAMP '2024-01-18' GROUP BY ALL), a AS (SELECT DISTINCT 'u'||c_custkey AS account_id FROM customer)
SELECT a.account_id, coalesce(calls,0) AS calls, coalesce(failed,0) AS failed, coalesce(prompt_tokens,0) AS prompt_tokens, coalesce(completion_tokens,0) AS completion_tokens, coalesce(total_tokens,0) AS total_tokens FROM a LEFT JOIN u ON u.account_id=a.account_id""")
def usage_summary(spark, sf):
    accounts = T.table(spark, sf, "customer").selectExpr("concat('u', c_custkey) AS account_id")
    return L.usage_summary(usage(spark, sf), accounts, F.lit("2024-01-25").cast("timestamp_ntz"), 7)


def _pct(p):
    return f"coalesce(d[least(round_even((len(d)-1)*{p}::DOUBLE,0), len(d)-1)::BIGINT+1],0)"


_DUR = "d AS (SELECT schema_name AS k, list_sort(list(latency_ms)) AS d FROM (SELECT *, row_number() OVER (PARTITION BY schema_name ORDER BY ts DESC, id DESC) AS r FROM t_call) WHERE r<=1000 GROUP BY ALL)"
_PCTS = ", ".join(_scaled(f"round({_pct(p)},1)", f"p{round(p * 100)}_ms") for p in (0.5, 0.95, 0.99))


def _scale_all(df):
    return df.withColumns({n: scaled(n) for n in ("p50_ms", "p95_ms", "p99_ms")})


@query("agent_metrics", f"""
WITH {_DUR}, c AS (SELECT schema_name AS agent, count(*) FILTER (outcome='success') AS successes, count(*) FILTER (outcome='failure') AS failures FROM t_call GROUP BY ALL)
SELECT agent, successes+failures AS calls, successes, failures, {_scaled('round(successes/(successes+failures),3)', 'success_rate')}, {_PCTS} FROM c JOIN d ON d.k=agent""")
def agent_metrics(spark, sf):
    calls = T.calls(spark, sf).withColumnsRenamed({"schema_name": "agent", "latency_ms": "duration_ms"})
    return _scale_all(L.agent_metrics(calls)).drop("average_ms").withColumn("success_rate", scaled("success_rate"))


@query("call_metrics", f"""
WITH {_DUR}, c AS (SELECT schema_name, count(*) AS calls, count(*) FILTER (outcome='failure') AS failures, count(*) FILTER (outcome='cancelled') AS cancelled, count(*) FILTER (outcome='timeout') AS timeouts FROM t_call GROUP BY ALL),
r AS (SELECT CASE WHEN tokens>95 THEN 'retry_only' ELSE schema_name END AS schema_name, count(*) AS retries FROM t_call WHERE outcome<>'success' GROUP BY ALL)
SELECT coalesce(c.schema_name, r.schema_name) AS schema_name, coalesce(calls,0) AS calls, coalesce(failures,0) AS failures, coalesce(retries,0) AS retries, coalesce(cancelled,0) AS cancelled, coalesce(timeouts,0) AS timeouts, {_PCTS}
FROM c FULL JOIN r ON r.schema_name=c.schema_name LEFT JOIN d ON d.k=coalesce(c.schema_name, r.schema_name)""")
def call_metrics(spark, sf):
    calls = T.calls(spark, sf).withColumnRenamed("latency_ms", "duration_ms")
    retries = calls.filter("outcome <> 'success'").selectExpr("IF(tokens > 95, 'retry_only', schema_name) AS schema_name")
    return _scale_all(L.call_metrics(calls, retries)).drop("average_ms")


@query("metrics_totals", """
WITH e AS (SELECT CASE WHEN event_type='view' THEN 'cache_hit' WHEN event_type='click' THEN 'cache_miss' ELSE 'degradation' END AS metric, event_type AS label, 1 AS n FROM events)
SELECT metric, label, CAST(round(sum(n)*1000) AS BIGINT) AS value FROM e GROUP BY ALL
UNION ALL SELECT 'cache_hit_rate', '', CAST(round(round(count(*) FILTER (metric='cache_hit')/count(*) FILTER (metric IN ('cache_hit','cache_miss')),3)*1000) AS BIGINT) FROM e""")
def metrics_totals(spark, sf):
    e = T.table(spark, sf, "events").selectExpr(
        "CASE event_type WHEN 'view' THEN 'cache_hit' WHEN 'click' THEN 'cache_miss' ELSE 'degradation' END AS kind", "event_type AS label", "1 AS amount"
    )
    return L.metrics_totals(e).withColumn("value", F.round(F.col("value") * 1000).cast("bigint"))


_BUCKETS = ", ".join(f"({b}::DOUBLE)" for b in L.CALL_BUCKETS)


@query("histogram", f"""
SELECT schema_name, le, count(*) FILTER (latency_ms<=le) AS n, count(*) AS "count" FROM t_call, (VALUES {_BUCKETS}, ('infinity'::DOUBLE)) AS b(le) GROUP BY ALL""")
def histogram(spark, sf):
    return L.histogram(T.calls(spark, sf), "schema_name", F.col("latency_ms")).drop("sum")


@query("activity", "SELECT event_id AS id, 'u'||user_id AS actor_id, event_type AS action, 'c'||(user_id%29) AS correlation_id FROM events WHERE user_id%29=3 ORDER BY ts DESC, event_id DESC LIMIT 200")
def activity(spark, sf):
    return L.activity(T.audit(spark, sf), 200, correlation="c3").select("id", "actor_id", "action", "correlation_id")


@query("throttle", """
WITH e AS (SELECT event_id AS id, 'k'||(user_id%5) AS key, ts, event_type='purchase' AS success FROM events),
r AS (SELECT *, sum(success::INT) OVER (PARTITION BY key ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS run FROM e),
f AS (SELECT *, lag(ts, 2) OVER (PARTITION BY key, run ORDER BY ts, id) AS oldest FROM r WHERE NOT success),
s AS (SELECT *, (epoch_us(ts)/1e6)-(epoch_us(oldest)/1e6) AS age FROM f)
SELECT id, key, CASE WHEN oldest IS NOT NULL AND age<=86400 THEN greatest(1, ceil(86400.0-age))::BIGINT END AS retry_after FROM s""")
def throttle(spark, sf):
    e = T.table(spark, sf, "events").selectExpr("event_id AS id", "concat('k', user_id % 5) AS key", "ts", "event_type = 'purchase' AS success")
    return L.throttle(e, 3, 86400).drop("ts")


@query("stale_threads", """
SELECT 'u'||user_id AS thread_id FROM events GROUP BY ALL HAVING max(ts)<TIMESTAMP '2024-01-30' ORDER BY max(ts), thread_id LIMIT 200""")
def stale_threads(spark, sf):
    rows = T.calls(spark, sf).select(F.col("account_id").alias("thread_id"), "ts")
    return L.stale_threads(rows, F.lit("2024-01-30").cast("timestamp_ntz")).select("thread_id")


@query("purge_threads", """
WITH s AS (SELECT user_id FROM events GROUP BY ALL HAVING max(ts)<TIMESTAMP '2024-01-30' ORDER BY max(ts), max('u'||user_id) LIMIT 200)
SELECT event_id AS id FROM events WHERE user_id NOT IN (SELECT user_id FROM s)""")
def purge_threads(spark, sf):
    rows = T.calls(spark, sf).select("id", F.col("account_id").alias("thread_id"), "ts")
    return L.purge_threads(rows, L.stale_threads(rows, F.lit("2024-01-30").cast("timestamp_ntz"))).select("id")


@query("recent_turns", """
WITH t AS (SELECT conv_id, turn, lead(role) OVER w AS nr, role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM t WHERE role='user' AND nr='assistant')
SELECT conv_id AS thread_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS rank FROM d WHERE r<=5""")
def recent_turns(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    t = T.table(spark, sf, "conversations").withColumns({"a": F.lead("text").over(w), "nr": F.lead("role").over(w)})
    turns = t.selectExpr("conv_id AS thread_id", "turn", "IF(role = 'user', text, '') AS question", "IF(nr = 'assistant', a, '') AS summary")
    return L.recent_turns(turns).select("thread_id", "turn", "rank")


@query("validate_transitions", """
WITH s AS (SELECT event_id, user_id, ts, CASE WHEN value>50 THEN 'accepted' WHEN value>20 THEN 'rejected' ELSE 'reverted' END AS status FROM events),
b AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'proposed') AS before FROM s)
SELECT event_id, CASE WHEN before=status THEN 'unchanged' WHEN before='proposed' OR (before='accepted' AND status='rejected') THEN 'ok' ELSE 'conflict' END AS verdict FROM b""")
def validate_transitions(spark, sf):
    log = T.table(spark, sf, "events").selectExpr(
        "event_id", "user_id AS id", "ts", "event_id AS seq", "CASE WHEN value > 50 THEN 'accepted' WHEN value > 20 THEN 'rejected' ELSE 'reverted' END AS status"
    )
    return L.validate_transitions(log).select("event_id", "verdict")


@query("refresh_needed", "SELECT max(event_id) AS newest, max(event_id)>10 AS refresh FROM events")
def refresh_needed(spark, sf):
    return L.refresh_needed(T.table(spark, sf, "events").withColumnRenamed("event_id", "batch_id"), F.lit(10))
