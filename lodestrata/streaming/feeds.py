"""Change feeds as streams: folds into snapshot tables, signals, deferred rows, windows.

Each sink commits its batch under its number, so a batch that is run again after a
failure changes nothing, and writes only the rows that the batch changed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from lodestrata.operators.changes import advance
from lodestrata.sources.store import DELETED, Store, Table
from lodestrata.sources.tables import shared_folder


def stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """The files of a folder, also those that come later; or one file, as a folder of its name alone."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        reader, path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    return reader.parquet(path)


Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


def into_store(rows: DataFrame, store: Store, name: str, merge: Merge, checkpoint: str) -> StreamingQuery:
    """Merges each batch into a table of the store: merge gets the rows that the batch's keys have there, and the batch. Reads all that is there and ends."""

    def sink(batch: DataFrame, number: int) -> None:
        store.update(name, batch, merge, writer=name, number=number)

    return rows.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _ran(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def _folded(rows: DataFrame, tag: str, table: Table, merge: Merge, shape: str) -> DataFrame:
    """The table that a stream leaves behind, after all that is there now."""
    spark = rows.sparkSession
    folder = shared_folder(spark, tag)
    store = Store(spark, f"{folder}/table", {tag: table})
    _ran(into_store(rows, store, tag, merge, f"{folder}/checkpoint"))
    done = store.read(tag)
    return spark.createDataFrame([], shape) if done is None else done


def _added(keys: list[str]) -> Merge:
    """Each batch's own counts are added to those before."""

    def merge(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        counts = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        return counts if old is None else old.unionByName(counts).groupBy(*keys).agg(F.sum("n").alias("n"))

    return merge


def fold_latest(spark: SparkSession, path: str, schema: StructType, key: str, seq: str, files_per_batch: int = 64) -> DataFrame:
    """The largest number of each key over all batches; numbers never fall."""

    def merge(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        top = batch.groupBy(key).agg(F.max(seq).alias(seq))
        return top if old is None else advance(old, top, [key], seq)

    kind = lambda c: schema[c].dataType.simpleString()
    return _folded(stream(spark, path, schema, files_per_batch).select(key, seq), "latest", Table((key,)), merge, f"{key} {kind(key)}, {seq} {kind(seq)}")


def hourly_counts(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """Rows by hour and kind, of any age; ``windowed`` is for bounded lateness."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(CAST(ts AS TIMESTAMP) AS TIMESTAMP_NTZ))")
    hour = F.expr("(us - pmod(us, 3600000000)) div 1000000")
    rows = stream(spark, path, schema, files_per_batch).withColumn("us", micros).select(hour.alias("hour_s"), "event_type")
    keys = ["hour_s", "event_type"]
    return _folded(rows, "hourly", Table(tuple(keys)), _added(keys), "hour_s long, event_type string, n long")


#: An event's wall-clock time as an instant in UTC, by which windows are aligned in every session's zone.
_INSTANT = "timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(CAST(ts AS TIMESTAMP) AS TIMESTAMP_NTZ)))"


def window_counts(spark: SparkSession, path: str, schema: StructType, size: str, slide: str | None = None, files_per_batch: int = 64) -> DataFrame:
    """Rows by window of event time and kind. Counts live in the store, so the stream itself keeps no state, and a row of any age is added to its windows."""
    rows = stream(spark, path, schema, files_per_batch).withColumn("ts", F.expr(_INSTANT))
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    keys = ["start_s", "event_type"]
    return _folded(rows.select(w.alias("w"), "event_type").select(F.unix_seconds("w.start").alias("start_s"), "event_type"), "windows", Table(tuple(keys)), _added(keys), "start_s long, event_type string, n long")


def merged_sessions(gap_us: int) -> Merge:
    """A batch's rows (user_id, us) and the users' sessions before (user_id, start_us, end_us, n) as sessions: a new one begins where the gap since all rows before is over. A session that another one swallowed is deleted."""

    def merge(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        fresh = batch.groupBy("user_id", "us").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("us").alias("start_us"), F.col("us").alias("end_us"), "n")
        every = fresh if old is None else fresh.unionByName(old)
        by_user = Window.partitionBy("user_id").orderBy("start_us", "end_us")
        reached = F.max("end_us").over(by_user.rowsBetween(Window.unboundedPreceding, -1))
        begins = every.withColumn("fresh", F.when(F.col("start_us") - reached < gap_us, 0).otherwise(1))
        grouped = begins.withColumn("s", F.sum("fresh").over(by_user.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "s")
        now = grouped.agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n").alias("n")).drop("s").withColumn(DELETED, F.lit(False))
        if old is None:
            return now
        key = [old["user_id"].eqNullSafe(now["user_id"]), old["start_us"] == now["start_us"]]
        return now.unionByName(old.join(now, key, "left_anti").withColumn(DELETED, F.lit(True)))

    return merge


def session_counts(spark: SparkSession, path: str, schema: StructType, gap: str, files_per_batch: int = 64) -> DataFrame:
    """Rows by user and session; late rows may join two sessions."""
    gap_us = spark.sql(f"SELECT unix_micros(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {gap})").first()[0]
    rows = stream(spark, path, schema, files_per_batch).select("user_id", F.unix_micros(F.expr(_INSTANT)).alias("us"))
    kind = schema["user_id"].dataType.simpleString()
    return _folded(rows, "sessions", Table(("user_id", "start_us"), by=("user_id",)), merged_sessions(gap_us), f"user_id {kind}, start_us long, end_us long, n long").select("user_id", "start_us", "n")


def change_sink(key: str) -> Merge:
    """A merge for change rows (key, seq, kind, ..): the last change of each key wins, deletes remove."""
    from lodestrata.operators.writes import latest_by_key

    return lambda old, batch: latest_by_key(batch, [key], [F.col("seq").desc()]).withColumn(DELETED, F.col("kind") == "delete")


def deferred(rows: DataFrame, key: str, ready: str, tries: int = 8, first_ms: int = 25, most_ms: int = 1000) -> DataFrame:
    """Rows (key, ready, payload) whose references are missing wait and are tried again; after the last try they are dropped.

    Gives (key, payload, outcome): 'resolved' once a row of the key is ready, else
    'dropped'. Waits double from first_ms up to most_ms of processing time.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        payload, tried = state.get if state.exists else (None, 0)
        done = None
        for b in batches:
            for row in b.itertuples():
                payload = row.payload if row.payload is not None else payload
                if getattr(row, ready):
                    done = "resolved"
        if state.hasTimedOut:
            tried += 1
            if tried >= tries:
                done = "dropped"
        if done:
            if state.exists:
                state.remove()
            yield pd.DataFrame({key: [k[0]], "payload": [payload], "outcome": [done]})
        else:
            state.update((payload, tried))
            state.setTimeoutDuration(min(most_ms, first_ms * 2**tried))

    shape = f"{key} {rows.schema[key].dataType.simpleString()}, payload string, outcome string"
    return rows.groupBy(key).applyInPandasWithState(step, shape, "payload string, tried int", "append", GroupStateTimeout.ProcessingTimeTimeout)


SIGNALS = {"seen": Table(("key",)), "passed": Table(("key", "at"), by=("key",))}


def first_seen(store: Store, batch: DataFrame, number: int, grace: int, writer: str = "signals") -> bool:
    """Of signals (key, at) with one key only the first passes, until its grace is over; then the next one does.

    What passed last is kept for each key in the store (SIGNALS) and the signals that passed beside
    it, in one commit a batch; one that comes late, before what passed last, is left out. A
    key's signals of one batch are walked in order of their distinct times.
    """

    def walk(rows: pa.Table) -> pa.Table:
        last, keep = rows["last"][0].as_py(), []
        for at in sorted(rows["at"].to_pylist()):
            if last is None or at >= last + grace:
                keep.append(at)
                last = at
        key = pa.array([rows["key"][0].as_py()] * len(keep), rows.schema.field("key").type)
        return pa.Table.from_arrays([key, pa.array(keep, pa.int64())], ["key", "at"])

    def make(old: dict[str, DataFrame | None]) -> dict[str, DataFrame]:
        rows = batch.select("key", "at").where("at IS NOT NULL").distinct()
        if old["seen"] is None:
            known = rows.withColumn("last", F.lit(None).cast("long"))
        else:
            before = old["seen"].select(F.col("key").alias("_key"), F.col("at").alias("last"))
            known = rows.join(before, rows["key"].eqNullSafe(before["_key"]), "left").select("key", "at", "last")
        passed = known.groupBy("key").applyInArrow(walk, rows.schema)
        return {"seen": passed.groupBy("key").agg(F.max("at").alias("at")), "passed": passed}

    return store.change(["seen", "passed"], batch, make, writer, number)


def windowed(rows: DataFrame, at: str, size: str, lateness: str | None, by: list[Column], slide: str | None = None) -> DataFrame:
    """Counts in tumbling or sliding windows of event time. Without lateness no row is too late, and no window ends before the stream does."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return (rows if lateness is None else rows.withWatermark(at, lateness)).groupBy(w.alias("window"), *by).count()


def sessions(rows: DataFrame, at: str, gap: str, lateness: str | None, by: list[Column]) -> DataFrame:
    """Counts in sessions that end after a gap; without lateness no row is too late."""
    return (rows if lateness is None else rows.withWatermark(at, lateness)).groupBy(F.session_window(at, gap).alias("session"), *by).count()
