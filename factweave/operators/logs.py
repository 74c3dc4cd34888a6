"""Usage, call and audit logs: rollups, histograms, throttling, memory and purge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import catalog
from .quality import nearest_rank

# Bucket bounds in seconds.
AGENT_BUCKETS = (0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60, 120, 300)
CALL_BUCKETS = (0.5, 1, 2, 5, 10, 20, 40, 60, 90, 180)
KEPT_DURATIONS = 1000


def clean_usage(usage: DataFrame) -> DataFrame:
    """Negative tokens and latencies become zero."""
    fixed = {n: F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)) for n in ("prompt_tokens", "completion_tokens", "latency_ms") if n in usage.columns}
    return usage.withColumns(fixed)


def valid_email(col: Column) -> Column:
    return F.lower(F.trim(col)).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]{2,}$") & F.length(F.trim(col)).between(3, 320)


def usage_by_account(usage: DataFrame, since) -> DataFrame:
    """Calls, failures and tokens per account since a moment, most tokens first."""
    c = F.col
    rows = clean_usage(usage).filter(c("created_at") >= since)
    return rows.groupBy("account_id").agg(
        F.count("*").alias("calls"), F.count_if(~c("success")).alias("failed"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
    ).withColumn("total_tokens", c("prompt_tokens") + c("completion_tokens")).orderBy(F.desc("total_tokens"), "account_id")


def usage_summary(usage: DataFrame, accounts: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Every account over the last 1 to 90 days; an account without calls has a row of zeros."""
    window = min(max(days, 1), 90)
    found = usage_by_account(usage, as_of - F.expr(f"INTERVAL {window} DAYS"))
    return accounts.select("account_id").join(found, "account_id", "left").fillna(0)


def _durations(calls: DataFrame, key: str, value: str, keep: int = KEPT_DURATIONS) -> DataFrame:
    """Sorted last ``keep`` durations per key: a bounded list."""
    last = catalog.top_k(calls.select(key, "ts", "id", value), [key], [F.desc("ts"), F.desc("id")], keep)
    return last.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("d"))


def _percentiles() -> list[Column]:
    avg = F.aggregate("d", F.lit(0.0), lambda a, x: a + x) / F.size("d")
    return [
        F.round(F.coalesce(avg, F.lit(0.0)), 1).alias("average_ms"),
        *[F.round(F.coalesce(nearest_rank(F.col("d"), p), F.lit(0.0)), 1).alias(f"p{round(p * 100)}_ms") for p in (0.5, 0.95, 0.99)],
    ]


def agent_metrics(calls: DataFrame, key: str = "agent") -> DataFrame:
    """Calls, successes, failures and the duration percentiles of the last 1000 calls per agent."""
    c = F.col
    counts = calls.groupBy(key).agg(F.count_if(c("outcome") == "success").alias("successes"), F.count_if(c("outcome") == "failure").alias("failures"))
    n = c("successes") + c("failures")
    return counts.join(_durations(calls, key, "duration_ms"), key, "left").select(
        key, n.alias("calls"), "successes", "failures", F.when(n > 0, F.round(c("successes") / n, 3)).otherwise(0.0).alias("success_rate"), *_percentiles()
    )


def call_metrics(calls: DataFrame, retries: DataFrame) -> DataFrame:
    """Per schema: calls, failures, retries, cancelled and timed out calls kept apart; schemas with only retries included."""
    c = F.col
    key = "schema_name"
    counts = calls.groupBy(key).agg(
        F.count("*").alias("calls"), *[F.count_if(c("outcome") == o).alias(n) for o, n in (("failure", "failures"), ("cancelled", "cancelled"), ("timeout", "timeouts"))]
    )
    again = retries.groupBy(key).agg(F.count("*").alias("retries"))
    joined = counts.join(again, key, "full_outer").fillna(0).join(_durations(calls, key, "duration_ms"), key, "left")
    return joined.select(key, "calls", "failures", "retries", "cancelled", "timeouts", *_percentiles())


def metrics_totals(events: DataFrame) -> DataFrame:
    """(metric, label, value): counters of an event log with columns kind, label, amount; plus the cache hit rate."""
    c = F.col
    counts = events.groupBy(c("kind").alias("metric"), "label").agg(F.sum("amount").cast("double").alias("value"))
    hits, misses = F.sum(F.when(c("kind") == "cache_hit", c("amount"))), F.sum(F.when(c("kind") == "cache_miss", c("amount")))
    both = F.coalesce(hits, F.lit(0)) + F.coalesce(misses, F.lit(0))
    rate = events.agg(F.when(both > 0, F.round(F.coalesce(hits, F.lit(0)) / both, 3)).otherwise(0.0).alias("value"))
    return counts.unionByName(rate.select(F.lit("cache_hit_rate").alias("metric"), F.lit("").alias("label"), "value"))


def histogram(calls: DataFrame, key: str, value: Column, buckets: tuple[float, ...] = CALL_BUCKETS) -> DataFrame:
    """Cumulative bucket counts (``le``), with sum and count, per key. ``value`` is in the unit of the buckets."""
    rows = calls.withColumn("_v", value)
    bounds = [float(b) for b in buckets]
    aggs = [F.count_if(F.col("_v") <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    wide = rows.groupBy(key).agg(F.count("*").alias("count"), F.sum("_v").alias("sum"), *aggs)
    pairs = [F.struct(F.lit(b).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("n")))
    return wide.select(key, "sum", "count", F.explode(F.array(*pairs)).alias("b")).select(key, "b.le", "b.n", "sum", "count")


def activity(audit: DataFrame, limit: int = 200, actor: str | None = None, correlation: str | None = None) -> DataFrame:
    """Activity feed: audit rows without metadata, newest first."""
    return catalog.recent(audit, limit, 0, actor, correlation).select(
        "id", "actor_id", "action", "object_id", "outcome", "correlation_id", "created_at"
    ).limit(limit)


def throttle(events: DataFrame, n: int = 10, window: int = 900) -> DataFrame:
    """Seconds until a key is free again after each of its failures; null while it is below ``n`` failures.

    A success clears the key's failures, so every success starts a new run, and the first failure of the run that is still
    in the window decides. ``events``: key, ts, success, id.
    """
    c = F.col
    seconds = lambda col: F.unix_micros(col.cast("timestamp")) / 1e6
    # Only events of the last window matter, so a key is cut into stretches of one window. Each stretch also sees the one
    # before it, and answers for its own events alone: a busy key is spread over time.
    slot = F.floor(seconds(c("ts")) / window)
    cut = events.withColumn("_own", slot).withColumn("_slot", F.explode(F.array(c("_own"), c("_own") + 1)))
    order = Window.partitionBy("key", "_slot").orderBy("ts", "id")
    runs = cut.withColumn("_run", F.sum(c("success").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy("key", "_slot", "_run").orderBy("ts", "id")
    back = runs.filter(~c("success")).withColumn("_oldest", F.lag("ts", n - 1).over(w)).filter(c("_own") == c("_slot"))
    age = seconds(c("ts")) - seconds(c("_oldest"))
    wait = F.greatest(F.lit(1), F.ceil(F.lit(float(window)) - age))
    return back.select("id", "key", "ts", F.when(c("_oldest").isNotNull() & (age <= window), wait).alias("retry_after"))


def stale_threads(rows: DataFrame, cutoff: Column, n: int = 200) -> DataFrame:
    """Threads whose newest row is older than the cutoff, oldest first, at most ``n`` per run."""
    return rows.groupBy("thread_id").agg(F.max("ts").alias("last")).filter(F.col("last") < cutoff).orderBy("last", "thread_id").limit(n)


def purge_threads(rows: DataFrame, stale: DataFrame) -> DataFrame:
    """Rows (of any table with a thread id) that stay."""
    return rows.join(stale.select("thread_id"), "thread_id", "left_anti")


def recent_turns(turns: DataFrame, n: int = 5) -> DataFrame:
    """Last n completed turns per thread, oldest first; a turn without question or answer is none."""
    c = F.col
    done = turns.filter((c("question") != "") & (c("summary") != ""))
    last = catalog.top_k(done, ["thread_id"], [F.desc("turn")], n)
    w = Window.partitionBy("thread_id").orderBy("turn")
    return last.withColumn("rank", F.row_number().over(w))


def validate_transitions(log: DataFrame) -> DataFrame:
    """Status changes of proposals with a verdict: proposed goes anywhere, accepted only to rejected; the rest conflicts."""
    c = F.col
    w = Window.partitionBy("id").orderBy("ts", "seq")
    before = F.coalesce(F.lag("status").over(w), F.lit("proposed"))
    rows = log.withColumn("before", before)
    fine = (c("before") == "proposed") | ((c("before") == "accepted") & (c("status") == "rejected"))
    return rows.withColumn("verdict", F.when(c("before") == c("status"), "unchanged").when(fine, "ok").otherwise("conflict"))


def refresh_needed(table: DataFrame, seen_batch: Column) -> DataFrame:
    """Is a derived view older than its table? One row: newest batch, and whether to recompute."""
    return table.agg(F.max("batch_id").alias("newest")).withColumn("refresh", F.col("newest") > seen_batch)
