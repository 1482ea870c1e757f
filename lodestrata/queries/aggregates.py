"""Percentiles by index, folds of operation logs, retained tails."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import aggregates as A
from lodestrata.operators import windows as W
from lodestrata.queries.registry import query, t


_KINDS = "(SELECT CASE WHEN user_id % 5 = 0 THEN NULL ELSE event_type END AS event_type, CASE WHEN event_id % 1000 = 0 THEN value * 1000000 ELSE value END AS value FROM events)"


@query(
    "SELECT event_type, count(*) AS n, round(avg(value), 3) AS mean, list_sort(list(value))[CAST(least(count(*) - 1, floor(count(*) * 0.5)) AS BIGINT) + 1] AS p50, "
    f"list_sort(list(value))[CAST(least(count(*) - 1, floor(count(*) * 0.99)) AS BIGINT) + 1] AS p99 FROM {_KINDS} GROUP BY event_type"
)
def group_counts_latency(spark, d):
    """Percentiles of kinds, one of them null, whose values have a heavy tail."""
    e = t(spark, d, "events")
    rows = e.select(F.when(F.col("user_id") % 5 != 0, F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 1000 == 0, F.col("value") * 1000000).otherwise(F.col("value")).alias("value"))
    return A.exact_percentiles(rows, "event_type", "value", {"p50": 0.5, "p99": 0.99}).withColumn("mean", F.round("mean", 3))


@query(
    "SELECT l_orderkey % 20000 AS kind, count(*) AS n, list_sort(list(l_extendedprice))[CAST(least(count(*) - 1, floor(count(*) * 0.9)) AS BIGINT) + 1] AS p90 FROM lineitem GROUP BY ALL"
)
def many_kinds_p90(spark, d):
    """A percentile for each of very many kinds."""
    rows = t(spark, d, "lineitem").select((F.col("l_orderkey") % 20000).alias("kind"), "l_extendedprice")
    return A.exact_percentiles(rows, "kind", "l_extendedprice", {"p90": 0.9}).drop("mean")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def slowest(spark, d):
    return t(spark, d, "events").orderBy(F.desc("value"), "event_id").limit(10).select("event_id", "value")


_OPS = "(SELECT user_id AS doc, event_id AS pos, dayofyear(ts) * 24 + hour(ts) AS ts, event_type AS value, CASE WHEN event_type = 'error' THEN 'x' ELSE CAST(event_id % 7 AS VARCHAR) END AS delta FROM events)"


def _ops(spark, d):
    e = t(spark, d, "events")
    hour = F.dayofyear("ts").cast("long") * 24 + F.hour("ts")
    delta = F.when(F.col("event_type") == "error", "x").otherwise((F.col("event_id") % 7).cast("string"))
    return e.select(F.col("user_id").alias("doc"), F.col("event_id").alias("pos"), hour.alias("ts"), F.col("event_type").alias("value"), delta.alias("delta"))


@query(f"SELECT doc, coalesce(sum(TRY_CAST(delta AS DOUBLE)), 0) AS total FROM {_OPS} GROUP BY doc")
def counter_sum(spark, d):
    return _ops(spark, d).groupBy("doc").agg(A.counter(F.col("delta")).alias("total"))


@query(f"SELECT doc, value FROM {_OPS} QUALIFY row_number() OVER (PARTITION BY doc ORDER BY ts DESC, pos) = 1")
def register_lww(spark, d):
    return _ops(spark, d).groupBy("doc").agg(A.register(F.col("value"), F.col("ts"), F.col("pos")).alias("value"))


@query(f"SELECT doc, array_to_string(list_sort(list(DISTINCT value)), ',') AS members FROM {_OPS} GROUP BY doc")
def set_members(spark, d):
    return _ops(spark, d).groupBy("doc").agg(F.array_join(A.members(F.col("value")), ",").alias("members"))


@query(f"SELECT doc, arg_max(value, pos) FILTER (delta <> 'x') AS status, coalesce(sum(TRY_CAST(delta AS DOUBLE)), 0) AS votes, array_to_string(list_sort(list(DISTINCT delta)), ',') AS tags FROM {_OPS} GROUP BY doc")
def crdt_materialise(spark, d):
    ops = _ops(spark, d)
    none = F.lit(None).cast("string")
    shape = lambda field, df, value=none, delta=none, member=none: df.select("doc", F.lit(field).alias("field"), value.alias("value"), delta.alias("delta"), member.alias("member"), F.col("pos").alias("ts"), "pos")
    log = shape("status", ops.where("delta <> 'x'"), value=F.col("value")).union(shape("votes", ops, delta=F.col("delta"))).union(shape("tags", ops, member=F.col("delta")))
    return A.materialise(log, {"status": "register", "votes": "counter", "tags": "set"}).withColumn("tags", F.array_join("tags", ","))


@query(f"SELECT doc, value, min(pos) AS pos FROM {_OPS} GROUP BY doc, value")
def conflict_by_client(spark, d):
    """The first entry of each client (here the kind of event) of a document."""
    return _ops(spark, d).groupBy("doc", "value").agg(F.min("pos").alias("pos"))


@query(f"SELECT doc, value || ':' || n AS value FROM (SELECT doc, value, count(*) AS n FROM {_OPS} GROUP BY doc, value) QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, value) = 1")
def register_resolver(spark, d):
    """A register resolved by a rule of one's own: the value that most entries hold."""
    most_common = F.min_by(F.concat("value", F.lit(":"), F.col("n")), F.struct(-F.col("n"), F.col("value").isNull(), F.col("value")))
    return A.resolve_registers(_ops(spark, d), most_common)


@query("SELECT event_id AS op_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view') ")
def crdt_diff(spark, d):
    ops = t(spark, d, "events").select(F.col("event_id").alias("op_id"), "event_type")
    return A.new_operations(ops.where("event_type = 'view'"), ops.union(ops)).select("op_id")


@query("SELECT count(*) AS n FROM events")
def crdt_merge(spark, d):
    ops = t(spark, d, "events").select(F.col("event_id").alias("op_id"), "event_type", "user_id")
    return A.merge_operations(ops.where("user_id > 50"), ops.where("user_id < 100"), ops).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def tail_keep_n(spark, d):
    return W.keep_newest(t(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], "turn", 3)


@query(
    "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 5 AND s <= 900"
)
def tail_byte_budget(spark, d):
    rows = t(spark, d, "conversations").select("conv_id", "turn", F.octet_length("text").cast("long").alias("bytes"))
    return W.keep_within(rows, ["conv_id"], "turn", "bytes", 5, 900).select("conv_id", "turn")


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'")
def identity_keys(spark, d):
    return t(spark, d, "events").where("event_type = 'purchase'").select("user_id").distinct()


@query("SELECT c_nationkey, count(*) FILTER (o_orderstatus NOT IN ('F')) AS open_orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey")
def open_counts(spark, d):
    joined = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_nationkey").agg(F.count_if(~F.col("o_orderstatus").isin("F")).alias("open_orders"))


@query(
    "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, count(*) FILTER (value <= 5) AS b0, "
    "count(*) FILTER (value > 5 AND value <= 50) AS b1, count(*) FILTER (value > 50) AS b2 FROM events GROUP BY event_type"
)
def metric_histograms(spark, d):
    out = A.histograms(t(spark, d, "events"), ["event_type"], "value", [50.0, 5.0])
    return out.select("event_type", "n", F.round("total", 4).alias("total"), "least", "most", *[F.get("buckets", F.lit(k)).alias(f"b{k}") for k in range(3)])


@query("SELECT event_type, user_id % 3 AS shard, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def metric_gauges(spark, d):
    """The newest measure of each kind and shard."""
    return A.gauges(t(spark, d, "events").withColumn("shard", F.col("user_id") % 3), ["event_type", "shard"], "value", ["event_id"])


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS total FROM orders GROUP BY ALL")
def metric_counters(spark, d):
    return A.counters(t(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


_ROWS = "(SELECT *, CASE WHEN c_nationkey = 3 THEN 0 ELSE c_acctbal END AS balance FROM customer)"
_FOLDED = {"c_mktsegment": "register", "balance": "counter", "tags": "set"}


def _rows(spark, d):
    c = t(spark, d, "customer")
    return c.withColumn("balance", F.when(F.col("c_nationkey") == 3, 0.0).otherwise(F.col("c_acctbal"))).withColumn("tags", F.array("c_mktsegment", F.col("c_nationkey").cast("string")))


@query(
    f"SELECT c_custkey AS doc, 'c_mktsegment' AS field, c_mktsegment AS value, NULL::DOUBLE AS delta, NULL AS member, CAST(c_nationkey AS BIGINT) AS ts FROM {_ROWS} UNION ALL "
    f"SELECT c_custkey, 'balance', NULL, balance, NULL, c_nationkey FROM {_ROWS} WHERE balance <> 0 UNION ALL "
    f"SELECT c_custkey, 'tags', NULL, NULL, unnest([c_mktsegment, CAST(c_nationkey AS VARCHAR)]), c_nationkey FROM {_ROWS}"
)
def crdt_encode(spark, d):
    ops = A.encode_rows(_rows(spark, d), _FOLDED, "c_custkey", F.col("c_nationkey"))
    return ops.select("doc", "field", "value", F.col("delta").cast("double").alias("delta"), "member", "ts")


@query(
    f"WITH f AS (SELECT doc, arg_max(value, pos) FILTER (delta <> 'x') AS status, coalesce(sum(TRY_CAST(delta AS DOUBLE)), 0) AS votes FROM {_OPS} GROUP BY doc) "
    "SELECT c_custkey, c_name, CASE WHEN doc IS NULL THEN c_mktsegment ELSE status END AS status, CASE WHEN doc IS NULL THEN c_acctbal ELSE votes END AS votes FROM customer LEFT JOIN f ON doc = c_custkey"
)
def crdt_merge_plain(spark, d):
    """Folded fields laid over plain ones."""
    ops = _ops(spark, d)
    status = F.max_by(F.when(F.col("delta") != "x", F.col("value")), F.when(F.col("delta") != "x", F.col("pos")))
    folded = ops.groupBy("doc").agg(status.alias("status"), A.counter(F.col("delta")).alias("votes")).withColumnRenamed("doc", "c_custkey")
    local = t(spark, d, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("status"), F.col("c_acctbal").alias("votes"))
    return A.merge_folded(local, folded, "c_custkey", ["status", "votes"])


@query(
    "SELECT conv_id, count(*) FILTER (k <= 5 AND s <= 900) AS kept, count(*) FILTER (NOT (k <= 5 AND s <= 900)) AS deleted, coalesce(sum(bytes) FILTER (k <= 5 AND s <= 900), 0) AS retained_bytes FROM "
    "(SELECT conv_id, strlen(text) AS bytes, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) GROUP BY conv_id"
)
def tail_counters(spark, d):
    rows = t(spark, d, "conversations").select("conv_id", "turn", F.octet_length("text").cast("long").alias("bytes"))
    return W.tail_counters(rows, ["conv_id"], "turn", "bytes", 5, 900)
