"""Ids in nested values, and what they reach through circles of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import nested_ids as N
from lodestrata.queries.registry import query, t
from lodestrata.types import TableSpec, v

CUSTOMERS = TableSpec("customer").with_field("links", v.array(v.object(order=v.id("orders"), seen=v.record(v.id("nation")))))
ORDERS = TableSpec("orders").with_field("body", v.object(buyer=v.optional(v.id("customer")), next=v.union(v.id("orders"), v.union(v.id("customer"))), note=v.union(v.id("nation"), v.string())))
NATIONS = TableSpec("nation").with_field("boss", v.optional(v.union(v.null(), v.id("customer")))).with_field("deputy", v.id("customer"))

# Customers refer to orders and nations, orders to customers and to each other, nations to customers: circles of all lengths, and ids that nothing has.

_EDGES = """
edges AS (
  SELECT 'customer' AS src_tbl, c_custkey::VARCHAR AS src, 'orders' AS tbl, CASE WHEN c_custkey % 9 = 0 THEN 'gone-' || c_custkey ELSE (c_custkey % 20 + 1)::VARCHAR END AS id FROM customer WHERE c_custkey % 4 <> 0
  UNION ALL SELECT 'customer', c_custkey::VARCHAR, 'nation', c_nationkey::VARCHAR FROM customer WHERE c_custkey % 4 <> 0
  UNION ALL SELECT 'orders', o_orderkey::VARCHAR, 'customer', (o_orderkey % 10 + 1)::VARCHAR FROM orders WHERE o_orderkey % 5 <> 0
  UNION ALL SELECT 'nation', n_nationkey::VARCHAR, 'customer', (n_nationkey % 30 * 4 + 4)::VARCHAR FROM nation)
"""
_UNION_EDGES = """
alternatives AS (
  SELECT 'orders' AS src_tbl, o_orderkey::VARCHAR AS src, m.tbl, CASE WHEN o_orderkey % 3 = 0 THEN 'c' || o_orderkey ELSE (o_orderkey // 2 % 40 + 1)::VARCHAR END AS id FROM orders, (VALUES ('orders'), ('customer')) AS m(tbl))
"""
_EXISTS = "(SELECT 'customer' AS tbl, c_custkey::VARCHAR AS id FROM customer UNION ALL SELECT 'orders', o_orderkey::VARCHAR FROM orders UNION ALL SELECT 'nation', n_nationkey::VARCHAR FROM nation)"
_START = "SELECT 'customer' AS tbl, c_custkey::VARCHAR AS id FROM customer WHERE c_custkey % 50 = 7 UNION SELECT 'orders', 'none'"


def _tables(spark, d, following: bool):
    """Rows with their documents; following: orders also name the next order or customer."""
    c, o, n = (t(spark, d, name) for name in ("customer", "orders", "nation"))
    text = lambda x: x.cast("string")
    order = F.when(F.col("c_custkey") % 9 == 0, F.concat(F.lit("gone-"), text(F.col("c_custkey")))).otherwise(text(F.col("c_custkey") % 20 + 1))
    link = F.struct(order.alias("order"), F.create_map(F.lit("x"), text(F.col("c_nationkey"))).alias("seen"))
    links = F.filter(F.array(link), lambda _: F.col("c_custkey") % 4 != 0)
    following_id = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("c"), text(F.col("o_orderkey")))).otherwise(text(F.floor(F.col("o_orderkey") / 2) % 40 + 1))
    body = F.struct(F.when(F.col("o_orderkey") % 5 != 0, text(F.col("o_orderkey") % 10 + 1)).alias("buyer"), (following_id if following else F.lit(None).cast("string")).alias("next"), F.lit("no id").alias("note"))
    documents = lambda df, key, **fields: df.select(text(F.col(key)).alias("id"), F.to_variant_object(F.struct(*[f.alias(k) for k, f in fields.items()])).alias("doc"))
    return {
        "customer": (documents(c, "c_custkey", links=links), "id", "doc", CUSTOMERS),
        "orders": (documents(o, "o_orderkey", body=body), "id", "doc", ORDERS),
        "nation": (documents(n, "n_nationkey", boss=F.lit(7), deputy=text(F.col("n_nationkey") % 30 * 4 + 4)), "id", "doc", NATIONS),
    }


def _start(spark, d):
    c = t(spark, d, "customer").where("c_custkey % 50 = 7").select(F.lit("customer").alias("tbl"), F.col("c_custkey").cast("string").alias("id"))
    return c.unionByName(spark.sql("SELECT 'orders' AS tbl, 'none' AS id"))


def _local(spark, d):
    """What a reader has already: a few nations."""
    return t(spark, d, "nation").where("n_nationkey < 3").select(F.lit("nation").alias("tbl"), F.col("n_nationkey").cast("string").alias("id"))


_LOCAL = "SELECT 'nation' AS tbl, n_nationkey::VARCHAR AS id FROM nation WHERE n_nationkey < 3"


@query(
    f"WITH RECURSIVE {_EDGES}, {_UNION_EDGES}, every AS (SELECT * FROM edges UNION ALL SELECT * FROM alternatives), local AS ({_LOCAL}), "
    f"visited AS (SELECT * FROM ({_START}) UNION SELECT e.tbl, e.id FROM visited x JOIN every e ON e.src_tbl = x.tbl AND e.src = x.id WHERE NOT EXISTS (SELECT 1 FROM local l WHERE l.tbl = e.tbl AND l.id = e.id)) "
    f"SELECT tbl, id FROM visited SEMI JOIN {_EXISTS} h USING (tbl, id)"
)
def hydrate_circles(spark, d):
    """All rows of three tables that references reach from some customers, through circles and unions."""
    return N.reach(_start(spark, d), _tables(spark, d, True), _local(spark, d))[0]


@query(
    f"WITH RECURSIVE {_EDGES}, local AS ({_LOCAL}), have AS {_EXISTS}, "
    "needed AS (SELECT e.* FROM edges e WHERE NOT EXISTS (SELECT 1 FROM local l WHERE l.tbl = e.tbl AND l.id = e.id)), "
    f"visited AS (SELECT * FROM ({_START}) UNION SELECT e.tbl, e.id FROM visited x JOIN needed e ON e.src_tbl = x.tbl AND e.src = x.id), "
    "found AS (SELECT * FROM visited SEMI JOIN have USING (tbl, id)), "
    "closure AS (SELECT src_tbl, src, tbl, id FROM needed WHERE (src_tbl, src) IN (SELECT (tbl, id) FROM found) UNION SELECT c.src_tbl, c.src, e.tbl, e.id FROM closure c JOIN needed e ON e.src_tbl = c.tbl AND e.src = c.id), "
    "bad AS (SELECT tbl, id FROM visited WHERE (tbl, id) NOT IN (SELECT (tbl, id) FROM have) UNION SELECT src_tbl, src FROM closure WHERE src_tbl = tbl AND src = id) "
    "SELECT tbl, id FROM found f WHERE (tbl, id) NOT IN (SELECT (tbl, id) FROM bad) AND NOT EXISTS (SELECT 1 FROM closure c JOIN bad b ON b.tbl = c.tbl AND b.id = c.id WHERE c.src_tbl = f.tbl AND c.src = f.id)"
)
def hydrate_accepted(spark, d):
    """Of those rows, without the unions, the ones that may be stored: nothing that they need is missing or waits for itself."""
    found, edges = N.reach(_start(spark, d), _tables(spark, d, False), _local(spark, d))
    return N.accepted(found, edges, _local(spark, d))


@query(
    f"WITH {_EDGES}, {_UNION_EDGES}, have AS {_EXISTS} SELECT src, tbl, id FROM edges WHERE src_tbl = 'orders' AND (tbl, id) NOT IN (SELECT (tbl, id) FROM have) "
    "UNION SELECT src, tbl, id FROM alternatives a WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.id = a.id AND h.tbl IN ('orders', 'customer'))"
)
def missing_nested_refs(spark, d):
    """Ids at any depth of the orders' documents that no table has; a union misses all its members' ids or none."""
    tables = _tables(spark, d, True)
    known = None
    for name, (df, key, _, _) in tables.items():
        part = df.select(F.lit(name).alias("tbl"), F.col(key).alias("id"))
        known = part if known is None else known.unionByName(part)
    refs = N.row_references(tables["orders"][0].withColumnRenamed("id", "src"), "src", "doc", ORDERS)
    return N.missing_nested(refs, known, "src")


_TO = lambda x: f"(CASE WHEN {x} % 3 = 0 THEN 'remote-' || {x} ELSE 'local-' || {x} END)"


@query(
    f"SELECT o_orderkey, {_TO('o_custkey')} AS owner, {_TO('(o_custkey + 1)')} AS deep, 'local-' || o_custkey AS note, {_TO('(o_orderkey % 50)')} AS member, 'local-' || o_orderkey % 50 AS plain FROM orders"
)
def id_translate_deep(spark, d):
    """Local ids four levels deep in structs, arrays and maps; strings under other keys stay."""
    o = t(spark, d, "orders")
    local = lambda x: F.concat(F.lit("local-"), x.cast("string"))
    inner = F.struct(F.array(local(F.col("o_custkey") + 1), F.lit(None).cast("string")).alias("itemIds"), local(F.col("o_custkey")).alias("note"))
    groups = F.create_map(F.lit("memberId"), local(F.col("o_orderkey") % 50), F.lit("name"), local(F.col("o_orderkey") % 50))
    rows = o.select("o_orderkey", F.struct(local(F.col("o_custkey")).alias("ownerId"), F.array(F.struct(inner.alias("part"))).alias("parts"), groups.alias("groups")).alias("v"))
    ids = t(spark, d, "customer").select("c_custkey").unionByName(spark.range(0, 2).select(F.col("id").alias("c_custkey"))).distinct()
    ids = ids.unionByName(ids.agg((F.max("c_custkey") + 1).alias("c_custkey"))).where("c_custkey % 3 = 0")
    id_map = ids.select(local(F.col("c_custkey")).alias("local_id"), F.concat(F.lit("remote-"), F.col("c_custkey").cast("string")).alias("remote_id"))
    out = N.translate_nested(rows, "v", "o_orderkey", id_map)
    part = F.element_at("v.parts", 1)["part"]
    return out.select("o_orderkey", F.col("v.ownerId").alias("owner"), F.element_at(part["itemIds"], 1).alias("deep"), part["note"].alias("note"), F.element_at("v.groups", "memberId").alias("member"), F.element_at("v.groups", "name").alias("plain"))


@query(f"SELECT o_orderkey, {_TO('o_custkey')} AS owner, {_TO('(o_custkey + 1)')} AS deep, 'local-' || o_custkey AS note, CAST(o_totalprice AS DOUBLE) AS price FROM orders")
def id_translate_variant(spark, d):
    """The same within a VARIANT."""
    o = t(spark, d, "orders")
    local = lambda x: F.concat(F.lit("local-"), x.cast("string"))
    value = F.to_variant_object(F.struct(local(F.col("o_custkey")).alias("_id"), F.array(F.struct(F.array(local(F.col("o_custkey") + 1)).alias("itemIds"), local(F.col("o_custkey")).alias("note"), F.col("o_totalprice").cast("double").alias("price"))).alias("parts")))
    ids = t(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    ids = ids.unionByName(ids.agg((F.max("k") + 1).alias("k"))).where("k % 3 = 0")
    id_map = ids.select(local(F.col("k")).alias("local_id"), F.concat(F.lit("remote-"), F.col("k").cast("string")).alias("remote_id"))
    out = N.translate_nested(o.select("o_orderkey", value.alias("v")), "v", "o_orderkey", id_map)
    get = lambda path, kind="string": F.variant_get("v", path, kind)
    return out.select("o_orderkey", get("$._id").alias("owner"), get("$.parts[0].itemIds[0]").alias("deep"), get("$.parts[0].note").alias("note"), get("$.parts[0].price", "double").alias("price"))
