"""Live documents over micro-batches, differences since a state vector, and answers to pulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import sync as S
from lodestrata.queries.registry import query, t
from lodestrata.sources.store import Store
from lodestrata.sources.tables import shared_folder
from lodestrata.streaming import feeds, live

#: Updates that a file of the stream holds, about.
FILE_ROWS = 20_000


@query(
    "WITH u AS (SELECT conv_id, turn, coalesce(strlen(text), 0) AS b, max(CASE WHEN turn % 7 = 5 THEN turn END) OVER (PARTITION BY conv_id) AS e FROM conversations), "
    "sized AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, b FROM u WHERE turn % 7 <> 5 AND (e IS NULL OR turn > e)), "
    "live AS (SELECT conv_id, seq, b + CASE WHEN seq = 0 THEN 4 ELSE 0 END AS b FROM sized) "
    "SELECT 'state' AS part, conv_id::VARCHAR AS doc, max(seq) AS seq, sum(b)::BIGINT AS bytes FROM live GROUP BY conv_id UNION ALL "
    "SELECT 'tail', conv_id::VARCHAR, seq, b FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC) AS k, sum(b) OVER (PARTITION BY conv_id ORDER BY seq DESC) AS s FROM live) WHERE k <= 3 AND s <= 900"
)
def live_tail(spark, d):
    """States and trimmed tails after three batches of updates, with documents that were deleted and came back; an operation that each update repeats enters once."""
    c = t(spark, d, "conversations")
    once = lambda client, clock, value: F.struct(client.alias("client"), clock.cast("long").alias("clock"), value.alias("value"))
    updates = c.select(
        (F.col("conv_id") % 3).cast("string").alias("collection"), F.col("conv_id").cast("string").alias("doc"), F.col("turn").cast("long").alias("n"), F.when(F.col("turn") % 7 == 5, "delete").otherwise("upsert").alias("kind"),
        F.array(once(F.col("role"), F.col("turn"), F.col("text")), once(F.lit("sys"), F.lit(0), F.lit("once"))).alias("ops"),
    )
    folder = shared_folder(spark, "live")
    # A document's updates of a batch are in one file; larger batches have more files.
    files = max(1, c.count() // FILE_ROWS)
    for low, high in ((-1, 1), (1, 4), (4, 1 << 30)):
        updates.where((F.col("n") > low) & (F.col("n") <= high)).repartition(files, "collection", "doc").write.mode("append").parquet(f"{folder}/in")
    store = Store(spark, f"{folder}/store", live.TABLES)
    rows = feeds.stream(spark, f"{folder}/in", updates.schema, files)
    sink = lambda batch, number: live.record_updates(store, batch, number, keep=3, budget=900)
    done = rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    done.awaitTermination()
    states = store.read("states").select(F.lit("state").alias("part"), "doc", "seq", "bytes")
    return states.unionByName(store.read("tail").select(F.lit("tail").alias("part"), "doc", "seq", F.col("byte_length").alias("bytes")))


@query(
    "WITH ops AS (SELECT event_id, user_id % 40 AS doc, event_type AS client FROM events), known AS (SELECT doc, client, max(event_id) AS clock FROM ops WHERE event_id % 3 = 0 AND doc % 2 = 0 GROUP BY ALL) "
    "SELECT event_id AS clock, doc, client FROM ops LEFT JOIN known USING (doc, client) WHERE clock IS NULL OR event_id > clock"
)
def crdt_diff_vector(spark, d):
    """What a reader lacks by each client's highest clock; it knows nothing of every second document."""
    ops = t(spark, d, "events").select(F.col("event_id").alias("clock"), (F.col("user_id") % 40).alias("doc"), F.col("event_type").alias("client"))
    return S.beyond(ops, S.state_vectors(ops.where("clock % 3 = 0 AND doc % 2 = 0")))


_FOLDED = "(SELECT user_id AS doc, arg_max(event_type, event_id) AS status, sum(event_id % 100) AS votes FROM events GROUP BY user_id)"


@query(
    f"SELECT c_custkey AS doc, CASE WHEN c_custkey % 4 = 3 THEN c_custkey % 5 ELSE greatest(3, c_custkey % 5) END AS seq, CASE WHEN c_custkey % 4 = 1 AND f.doc IS NOT NULL THEN f.status ELSE c_mktsegment END AS status, CASE WHEN c_custkey % 4 = 1 AND f.doc IS NOT NULL THEN f.votes ELSE c_acctbal END AS votes "
    f"FROM customer LEFT JOIN {_FOLDED} f ON f.doc = c_custkey WHERE c_custkey % 7 <> 0 AND c_custkey % 4 <> 0 UNION ALL SELECT c_custkey, 3, 'whole', 1.5 FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 4 = 2"
)
def pull_answer(spark, d):
    """A pull's answer with deleted, whole and changed documents, applied twice to those that are there."""
    c = t(spark, d, "customer").withColumn("doc", F.col("c_custkey"))
    local = c.where("doc % 7 <> 0").select("doc", (F.col("doc") % 5).alias("seq"), F.col("c_mktsegment").alias("status"), F.col("c_acctbal").cast("double").alias("votes"))
    answer = c.where("doc % 4 <> 3").select("doc", (F.col("doc") % 4 == 0).alias("deleted"), (F.col("doc") % 4 == 2).alias("has_document"), (F.col("doc") % 4 == 1).alias("has_diff"), F.lit(3).cast("long").alias("seq"))
    documents = c.where("doc % 4 = 2").select("doc", F.lit("whole").alias("status"), F.lit(1.5).alias("votes"))
    e, none = t(spark, d, "events"), F.lit(None).cast("string")
    entry = lambda field, value, delta: F.struct(F.lit(field).alias("field"), value.alias("value"), delta.alias("delta"))
    both = F.explode(F.array(entry("status", F.col("event_type"), none), entry("votes", none, (F.col("event_id") % 100).cast("string")))).alias("e")
    ops = e.select(F.col("user_id").alias("doc"), "event_id", both).select("doc", F.col("e.field").alias("client"), F.col("event_id").alias("clock"), "e.*", none.alias("member"), F.col("event_id").alias("ts"), F.col("event_id").alias("pos"))
    log, diff = ops.where("clock % 2 = 0"), ops.where("clock % 3 <> 0 OR clock % 2 = 1")
    fields = {"status": "register", "votes": "counter"}
    once, log = S.apply_answer(local, log, answer, documents, diff, fields)
    return S.apply_answer(once, log, answer, documents, diff, fields)[0]
