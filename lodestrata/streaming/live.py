"""Live documents as streams keep them: a document's state, and the tail of updates that readers may still lack.

An update carries operations (client, clock, value). What a document's state already
holds, by each client's highest clock, is left out; the rest enters the state and is a
row of the tail under the document's next number. Tails are trimmed by count and
bytes; a delete drops state and tail, and numbers start again. State, operations and
tail change in one commit of a store, once for each batch. What a batch brings is worked out
once: the three tables are made from written intermediate ones, deleted after the commit.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.windows import keep_within
from lodestrata.sources.store import DELETED, Store, Table
from lodestrata.sources.tables import drop_folder, shared_folder

DOC = ["collection", "doc"]
TABLES = {"states": Table(("collection", "doc")), "operations": Table(("collection", "doc", "client", "clock"), by=("collection", "doc")), "tail": Table(("collection", "doc", "seq"), by=("collection", "doc"))}
#: An update's columns: n orders a document's updates, kind is upsert or delete.
UPDATE = "collection string, doc string, n long, kind string, ops array<struct<client: string, clock: long, value: string>>"


def _gone(old: DataFrame | None, dropped: DataFrame) -> DataFrame | None:
    """Old rows of documents that were deleted, as deletions."""
    return None if old is None else old.join(dropped, DOC, "left_semi").withColumn(DELETED, F.lit(True))


def record_updates(store: Store, batch: DataFrame, number: int, keep: int, budget: int, writer: str = "live") -> bool:
    """Apply a batch of updates (UPDATE); one that was applied before changes nothing."""

    spark, folder = batch.sparkSession, shared_folder(batch.sparkSession, "live-batch")

    def written(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def make(old: dict[str, DataFrame | None]) -> dict[str, DataFrame]:
        ends = batch.groupBy(*DOC).agg(F.max(F.when(F.col("kind") == "delete", F.col("n"))).alias("end"))
        dropped = ends.where("end IS NOT NULL").select(*DOC)
        live = batch.join(ends, DOC).where("kind <> 'delete' AND (end IS NULL OR n > end)")
        states = spark.createDataFrame([], "collection string, doc string, seq long, bytes long") if old["states"] is None else old["states"]
        base = states.join(dropped, DOC, "left_anti").select(*DOC, F.col("seq").alias("last"), F.col("bytes").alias("held"))
        by_doc = Window.partitionBy(*DOC).orderBy("n")
        updates = written(live.join(base, DOC, "left").withColumn("seq", F.coalesce(F.col("last") + 1, F.lit(0)) + F.row_number().over(by_doc) - 1).select(*DOC, "seq", "held", "ops"))
        ops = updates.select(*DOC, "seq", F.explode("ops").alias("o")).select(*DOC, "seq", "o.*").groupBy(*DOC, "seq", "client", "clock").agg(F.min("value").alias("value"))
        had = spark.createDataFrame([], "collection string, doc string, client string, clock long, value string") if old["operations"] is None else old["operations"]
        vector = had.join(dropped, DOC, "left_anti").groupBy(*DOC, "client").agg(F.max("clock").alias("known"))
        # An operation is new if its clock is above all that the client's earlier updates brought.
        top = ops.groupBy(*DOC, "client", "seq").agg(F.max("clock").alias("top"))
        earlier = Window.partitionBy(*DOC, "client").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        seen = top.withColumn("before", F.max("top").over(earlier)).join(vector, [*DOC, "client"], "left").select(*DOC, "client", "seq", F.greatest("before", "known").alias("before"))
        fresh = ops.join(seen, [*DOC, "client", "seq"]).where("before IS NULL OR clock > before")
        # Operations of one clock keep the first update's number.
        entered = written(fresh.groupBy(*DOC, "client", "clock").agg(F.min_by(F.struct("seq", "value"), "seq").alias("o")).select(*DOC, "client", "clock", "o.seq", "o.value"))
        size = F.coalesce(F.octet_length("value"), F.lit(0)).cast("long")
        rows = entered.groupBy(*DOC, "seq").agg(F.sum(size).alias("byte_length"), F.array_sort(F.collect_list(F.struct("client", "clock", "value"))).alias("ops"))
        every = rows if old["tail"] is None else rows.unionByName(old["tail"].join(dropped, DOC, "left_anti"))
        kept = written(keep_within(every, DOC, "seq", "byte_length", keep, budget))
        out_of_tail = None if old["tail"] is None else old["tail"].join(kept.select(*DOC, "seq"), [*DOC, "seq"], "left_anti").withColumn(DELETED, F.lit(True))
        new_states = updates.groupBy(*DOC).agg(F.max("seq").alias("seq"), F.max("held").alias("held"))
        added = entered.groupBy(*DOC).agg(F.sum(size).alias("more"))
        new_states = new_states.join(added, DOC, "left").select(*DOC, "seq", (F.coalesce("held", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("bytes"))

        def changes(new: DataFrame, *deletions: DataFrame | None) -> DataFrame:
            out = new.withColumn(DELETED, F.lit(False))
            for gone in deletions:
                if gone is not None:
                    out = out.unionByName(gone)
            # A key that is deleted and written in one batch is there.
            keys = [c for c in out.columns if c in ("collection", "doc", "client", "clock", "seq")] if "ops" in new.columns or "client" in new.columns else DOC
            return out.groupBy(*keys).agg(F.min_by(F.struct(DELETED, *[c for c in out.columns if c not in keys and c != DELETED]), DELETED).alias("r")).select(*keys, "r.*")

        return {
            "states": changes(new_states, _gone(old["states"], dropped)),
            "operations": changes(entered.drop("seq"), _gone(old["operations"], dropped)),
            "tail": changes(kept, _gone(old["tail"], dropped), out_of_tail),
        }

    try:
        return store.change(["states", "operations", "tail"], batch, make, writer, number)
    finally:
        drop_folder(spark, folder)
