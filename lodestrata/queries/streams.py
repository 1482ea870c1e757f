"""Streams driven to the end over a table, with the batch answer as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.queries.registry import query, t
from lodestrata.sources.store import Store
from lodestrata.sources.tables import shared_folder
from lodestrata.streaming import feeds


def _files(spark, d, name: str, files: int = 3) -> tuple:
    """A folder with a table in several files, which a stream takes one in a batch, and its schema."""
    table, folder = t(spark, d, name), shared_folder(spark, f"stream-{name}")
    table.repartition(files).write.parquet(folder)
    return folder, table.schema


@query("SELECT conv_id, max(turn) AS seq FROM conversations GROUP BY conv_id")
def stream_latest_seq(spark, d):
    """The newest number of each conversation, folded over micro-batches."""
    return feeds.fold_latest(spark, *_files(spark, d, "conversations"), "conv_id", "turn", 1).select("conv_id", F.col("turn").alias("seq"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS hour_s, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_hourly_counts(spark, d):
    return feeds.hourly_counts(spark, *_files(spark, d, "events"), 1)


@query("SELECT (epoch_us(ts) // 10800000000 - k) * 10800 AS start_s, event_type, count(*) AS n FROM events, (VALUES (0), (1)) AS w(k) GROUP BY 1, 2")
def stream_sliding_counts(spark, d):
    """Counts in windows of six hours that slide by three."""
    return feeds.window_counts(spark, *_files(spark, d, "events"), "6 hours", "3 hours", 1)


@query(
    "SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM "
    "(SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s"
)
def stream_sessions(spark, d):
    """Each user's sessions, which end after two hours without an event."""
    return feeds.session_counts(spark, *_files(spark, d, "events"), "2 hours", 1)


_SIGNALS = "(SELECT user_id, epoch_us(ts) // 1000 AS ms FROM events)"


@query(
    f"WITH RECURSIVE p AS (SELECT user_id, min(ms) AS at_ms FROM {_SIGNALS} GROUP BY user_id UNION ALL SELECT p.user_id, min(e.ms) FROM p JOIN {_SIGNALS} e ON e.user_id = p.user_id AND e.ms >= p.at_ms + 86400000 GROUP BY p.user_id, p.at_ms) "
    "SELECT user_id, at_ms FROM p"
)
def stream_first_seen(spark, d):
    """Each user's signals that pass when those within a day of the last one are left out, over three batches in order of time."""
    ms = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(CAST(ts AS TIMESTAMP) AS TIMESTAMP_NTZ)) div 1000")
    signals = t(spark, d, "events").select(F.col("user_id").alias("key"), ms.alias("at"))
    low, high = signals.agg(F.min("at"), F.max("at")).first()
    folder, third = shared_folder(spark, "signals"), (high - low) // 3 + 1
    for k in range(3):
        signals.where(F.col("at").between(low + k * third, low + (k + 1) * third - 1)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    store = Store(spark, f"{folder}/store", feeds.SIGNALS)
    rows = feeds.stream(spark, f"{folder}/in", signals.schema, 1)
    sink = lambda batch, number: feeds.first_seen(store, batch, number, 86400000)
    rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return store.read("passed").select(F.col("key").alias("user_id"), F.col("at").alias("at_ms"))
