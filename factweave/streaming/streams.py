"""Structured Streaming forms of intake, upsert, call metrics, throttling and sessions.

Tables grow by appended batches; a batch that is replayed after a failure gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.logs import CALL_BUCKETS


def read_stream(spark: SparkSession, schema: str | T.StructType, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


# --- windows -----------------------------------------------------------------------------------------------------------


def windowed_metrics(calls: DataFrame, ts: str, key: str, value: str, window: str, watermark: str) -> DataFrame:
    """Calls, failures, tokens and cumulative duration buckets per key and time window; late rows fall to the watermark.

    The same plan runs on a table, where a watermark has no effect.
    """
    c = F.col
    seconds = c(value)
    buckets = [F.count_if(seconds <= float(b)).alias(f"le_{str(b).replace('.', '_')}") for b in CALL_BUCKETS]
    rows = calls.withWatermark(ts, watermark) if calls.isStreaming else calls
    out = rows.groupBy(F.window(ts, window), key).agg(
        F.count("*").alias("calls"), F.count_if(c("outcome") == "failure").alias("failures"), F.sum("tokens").alias("tokens"), *buckets
    )
    return out.withColumns({"window_start": c("window.start"), "window_end": c("window.end")}).drop("window")


def windowed_failures(events: DataFrame, window: str, slide: str, watermark: str, n: int) -> DataFrame:
    """Keys with ``n`` failures or more in a sliding window: the simple form of throttling, without reset on success."""
    rows = events.withWatermark("ts", watermark) if events.isStreaming else events
    return rows.filter(~F.col("success")).groupBy(F.window("ts", window, slide), "key").agg(F.count("*").alias("failures")).filter(
        F.col("failures") >= n
    ).select(F.col("window.start").alias("window_start"), "key", "failures")


def activity_sessions(events: DataFrame, gap: str, watermark: str) -> DataFrame:
    """Stretches of activity per actor with no pause longer than ``gap``."""
    rows = events.withWatermark("created_at", watermark) if events.isStreaming else events
    return rows.groupBy(F.session_window("created_at", gap), "actor_id").agg(F.count("*").alias("actions")).select(
        F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "actor_id", "actions"
    )


# --- exact throttling --------------------------------------------------------------------------------------------------


class FailureWindow(StatefulProcessor):
    """Last ``n`` failure times of a key since its last success."""

    def __init__(self, n: int, window: float) -> None:
        self._n, self._window = n, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._hits = handle.getValueState("hits", "times array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = list(self._hits.get()[0]) if self._hits.exists() else []
        batch = pd.concat(list(rows)).sort_values(["ts", "id"], kind="stable")
        out = []
        for row_id, ts, success in zip(batch["id"], batch["ts"], batch["success"], strict=True):
            now = pd.Timestamp(ts).value / 1e9
            if success:
                held = []
                continue
            held = [t for t in [*held, now] if now - t <= self._window][-self._n:]
            wait = max(1, -int(-(held[0] + self._window - now) // 1)) if len(held) >= self._n else None
            out.append((row_id, key[0], wait))
        self._hits.update((held,))
        yield pd.DataFrame(out, columns=["id", "key", "retry_after"]).astype({"retry_after": "Int64"})

    def close(self) -> None:
        pass


def throttle_stream(events: DataFrame, n: int = 10, window: int = 900) -> DataFrame:
    """Seconds until a key is free again after each failure, exact within each key's arrival order."""
    return events.groupBy("key").transformWithStateInPandas(
        statefulProcessor=FailureWindow(n, float(window)), outputStructType="id long, key string, retry_after long", outputMode="Append",
        timeMode="None",
    )


# --- tables ------------------------------------------------------------------------------------------------------------


class BatchLog:
    """Rows of a stream, appended batch by batch; nothing written is read or written again.

    What a batch wrote stands in a partition of its own, so a batch that is replayed after a failure replaces its own rows, and a batch
    is rolled back by leaving it out when reading. What a row means across batches is decided by the reader.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.path}/batch_id=-1")  # so that there is a table to read

    def append(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def read(self, without: tuple[int, ...] = ()) -> DataFrame:
        """All rows with their ``batch_id``, but for those of batches that were rolled back."""
        rows = self.spark.read.schema(f"{self.schema}, batch_id BIGINT").parquet(self.path)
        return rows.filter(~F.col("batch_id").isin(*without)) if without else rows


FIRST_SEEN = "sha STRING, first_id BIGINT, copies BIGINT"


def intake_batch(log: BatchLog, order: str) -> Callable[[DataFrame, int], None]:
    """Appends one row per content hash of the batch: the first id by ``order`` and the number of copies. Null texts count as empty."""

    def run(batch: DataFrame, batch_id: int) -> None:
        keyed = batch.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
        log.append(keyed.groupBy("sha").agg(F.min(order).cast("long").alias("first_id"), F.count("*").alias("copies")), batch_id)

    return run


def first_seen(log: BatchLog, without: tuple[int, ...] = ()) -> DataFrame:
    """(sha, first_id, duplicates): the first row of each content over all batches, and how many copies came after it."""
    return log.read(without).groupBy("sha").agg(F.min_by("first_id", "batch_id").alias("first_id"), (F.sum("copies") - 1).alias("duplicates"))


def upsert_batch(log: BatchLog, key: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """Appends the batch's last row per key by ``order``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), F.struct(*order)).alias("_row"))
        log.append(last.select(key, "_row.*"), batch_id)

    return run


def latest_rows(log: BatchLog, key: str, order: list[str], without: tuple[int, ...] = ()) -> DataFrame:
    """The row of the latest batch per key, with ``created_by``, the first batch that brought the key; rolled-back batches never were."""
    rows = log.read(without)
    kept = [c for c in rows.columns if c not in (key, "batch_id")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*kept), F.struct("batch_id", *order)).alias("_row"), F.concat(F.lit("batch-"), F.min("batch_id")).alias("created_by"))
    return last.select(key, "_row.*", "created_by")


VIEW = "key STRING, rows BIGINT, amount DECIMAL(38,6), latest TIMESTAMP, seen BINARY"


def view_batch(log: BatchLog, key: str, amount: str, ts: str, item: str) -> Callable[[DataFrame, int], None]:
    """Appends the batch's part of a view per key: rows, exact sum, latest time and a sketch of the distinct items."""

    def run(batch: DataFrame, batch_id: int) -> None:
        part = batch.groupBy(F.col(key).cast("string").alias("key")).agg(
            F.count("*").alias("rows"), F.sum(F.col(amount).cast("decimal(28,6)")).cast("decimal(38,6)").alias("amount"),
            F.max(F.col(ts).cast("timestamp")).alias("latest"), F.hll_sketch_agg(item, 14).alias("seen"),
        )
        log.append(part, batch_id)

    return run


def view(log: BatchLog, without: tuple[int, ...] = ()) -> DataFrame:
    """The view over all batches: parts are added up, so a new batch costs its own rows only."""
    merged = log.read(without).groupBy("key").agg(
        F.sum("rows").alias("rows"), F.sum("amount").cast("decimal(38,6)").alias("amount"), F.max("latest").alias("latest"), F.hll_union_agg("seen").alias("seen"),
    )
    return merged.withColumn("distinct_items", F.hll_sketch_estimate("seen")).drop("seen")


def dedup_within_watermark(documents: DataFrame, ts: str, watermark: str) -> DataFrame:
    """First row per content hash while copies arrive within the watermark; state stays bounded."""
    return documents.withColumn("sha", F.sha2("text", 256)).withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["sha"])


def run_available(stream: DataFrame, folder: str, batch: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> str:
    """Process what is there and stop; returns the output folder. ``folder`` holds the stream's progress and output."""
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    out = f"{folder}/rows"
    query = writer.foreachBatch(batch).start() if batch else writer.outputMode(mode).format("parquet").option("path", out).start()
    query.awaitTermination()
    return out
