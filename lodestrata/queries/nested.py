"""Values of any shape: their order, equality and JSON form; and what changes touch."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import canonical as C
from lodestrata.operators import dependencies as D
from lodestrata.plans.query import Dependency
from lodestrata.queries.registry import query, t

# Order of nested values. In SQL a value is a list of (rank, number, text) items, an object the list of its pairs.

_ITEM = "STRUCT(r INTEGER, i BIGINT, d DOUBLE, s VARCHAR)"
_ITEM_SQL = lambda rank, i="NULL", d="NULL", s="NULL": f"{{'r': {rank}, 'i': CAST({i} AS BIGINT), 'd': CAST({d} AS DOUBLE), 's': CAST({s} AS VARCHAR)}}"


@query(
    "SELECT o_orderkey, row_number() OVER (ORDER BY kind, items, o_orderkey) - 1 AS place FROM (SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 5 WHEN 4 THEN 6 WHEN 5 THEN 8 WHEN 6 THEN 8 ELSE 9 END AS kind, CASE o_orderkey % 8 "
    f"WHEN 0 THEN [] WHEN 1 THEN [{_ITEM_SQL(2, i='o_custkey - 700')}] WHEN 2 THEN [{_ITEM_SQL(3, d='o_totalprice - 150000')}] WHEN 3 THEN [{_ITEM_SQL(5, i='(o_custkey % 2)')}] WHEN 4 THEN [{_ITEM_SQL(6, s='o_orderpriority || o_custkey')}] "
    f"WHEN 5 THEN [{_ITEM_SQL(3, d='o_custkey % 10')}, {_ITEM_SQL(6, s='o_orderpriority')}] WHEN 6 THEN [{_ITEM_SQL(3, d='o_custkey % 10')}] || (CASE WHEN o_custkey % 3 = 0 THEN [] ELSE [{_ITEM_SQL(1)}] END) "
    f"ELSE [{_ITEM_SQL(6, s=chr(39) + 'p' + chr(39))}, {_ITEM_SQL(6, s='o_orderpriority')}, {_ITEM_SQL(6, s=chr(39) + 's' + chr(39))}, {_ITEM_SQL(6, s='o_orderstatus')}] END::{_ITEM}[] AS items FROM orders)"
)
def nested_order(spark, d):
    """Orders by a value that is missing, a whole number, a number, a truth value, a text, a list or an object, each nested as it comes."""
    from lodestrata.operators.windows import numbered_all

    pick, up = F.col("o_orderkey") % 8, lambda c: F.to_variant_object(c)
    small = (F.col("o_custkey") % 10).cast("double")
    mixed = up(F.array(small.cast("variant"), F.col("o_orderpriority").cast("variant")))
    short = F.when(F.col("o_custkey") % 3 == 0, up(F.array(small))).otherwise(up(F.array(small, F.lit(None).cast("double"))))
    value = (
        F.when(pick == 1, (F.col("o_custkey") - 700).cast("variant")).when(pick == 2, (F.col("o_totalprice") - 150000).cast("double").cast("variant")).when(pick == 3, (F.col("o_custkey") % 2 == 1).cast("variant"))
        .when(pick == 4, F.concat("o_orderpriority", F.col("o_custkey").cast("string")).cast("variant")).when(pick == 5, mixed).when(pick == 6, short).when(pick == 7, up(F.struct(F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))))
    )
    rows = t(spark, d, "orders").select("o_orderkey", value.alias("value"))
    keyed = rows.select("o_orderkey", C.sort_key(F.col("value"), rows.schema["value"].dataType).alias("key"))
    return numbered_all(keyed, [F.col("key"), F.col("o_orderkey")], "place").select("o_orderkey", F.col("place").cast("long").alias("place"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY [o_orderpriority, o_orderstatus || o_custkey], o_totalprice, o_orderkey) - 1 AS place FROM orders")
def nested_order_typed(spark, d):
    """Orders by a typed list and a number, through the keys that JVM functions make."""
    from lodestrata.operators.windows import numbered_all

    rows = t(spark, d, "orders").select("o_orderkey", F.array("o_orderpriority", F.concat("o_orderstatus", F.col("o_custkey").cast("string"))).alias("l"), F.col("o_totalprice").cast("double").alias("p"))
    keyed = rows.select("o_orderkey", F.concat(*[C.sort_key(F.col(c), rows.schema[c].dataType) for c in ("l", "p")]).alias("key"))
    return numbered_all(keyed, [F.col("key"), F.col("o_orderkey")], "place").select("o_orderkey", F.col("place").cast("long").alias("place"))


@query("SELECT event_id, user_id % 3 <> 0 AS same, user_id % 3 <> 0 AND user_id % 2 = 0 AS same_map FROM events")
def nested_equal(spark, d):
    """Objects whose fields stand in another order, and maps, are equal by their content."""
    e = t(spark, d, "events")
    moved = F.when(F.col("user_id") % 3 == 0, F.lit("other")).otherwise(F.col("event_type"))
    rows = e.select(
        "event_id",
        F.struct(F.col("user_id").alias("u"), F.array(F.struct(F.col("event_type").alias("k"), F.col("value").alias("v"))).alias("l")).alias("a"),
        F.to_variant_object(F.struct(F.array(F.struct(F.col("value").alias("v"), moved.alias("k"))).alias("l"), F.col("user_id").alias("u"))).alias("b"),
        F.create_map(F.lit("k"), F.col("event_type"), F.lit("n"), F.col("user_id").cast("string")).alias("m"),
        F.create_map(F.lit("n"), F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")), F.lit("k"), moved).alias("o"),
    )
    kind = lambda c: rows.schema[c].dataType
    return rows.select("event_id", C.structurally_equal(F.col("a"), kind("a"), F.col("b"), kind("b")).alias("same"), C.structurally_equal(F.col("m"), kind("m"), F.col("o"), kind("o")).alias("same_map"))


@query("SELECT event_id, user_id, event_type, CASE user_id % 5 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN '-Infinity'::DOUBLE WHEN 2 THEN CAST(user_id AS DOUBLE) ELSE CAST(value AS DOUBLE) END AS x, strlen(event_type) AS n_bytes FROM events")
def value_json(spark, d):
    """Nested values with 64-bit integers, bytes, NaN and infinities through their JSON form and back."""
    x = F.when(F.col("user_id") % 5 == 0, F.lit(float("nan"))).when(F.col("user_id") % 5 == 1, F.lit(float("-inf"))).when(F.col("user_id") % 5 == 2, F.col("user_id").cast("double")).otherwise(F.col("value").cast("double"))
    rows = t(spark, d, "events").select("event_id", F.struct(F.col("user_id").cast("long").alias("u"), F.array(x).alias("xs"), F.encode("event_type", "UTF-8").alias("b"), F.create_map(F.lit("t"), F.col("event_type")).alias("m")).alias("v"))
    back = C.from_canonical(C.canonical(F.col("v"), rows.schema["v"].dataType), rows.schema["v"].dataType)
    return rows.select("event_id", back.alias("v")).select("event_id", F.col("v.u").alias("user_id"), F.element_at("v.m", "t").alias("event_type"), F.element_at("v.xs", 1).alias("x"), F.octet_length("v.b").cast("long").alias("n_bytes"))


# What changes touch. A row has a number u, often missing, a text s and an amount x; after the change another one.

_U = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END"
_CHANGES = f"(SELECT event_id, {_U} AS u0, event_type || '-' || user_id % 10 AS s0, value AS x0, event_id % 11 = 0 AS born, user_id + 7 AS u1, event_type || '-' || (user_id + 7) % 10 AS s1, value + 1 AS x1, event_id % 13 = 0 AS died FROM events)"


def _matches(k: int) -> str:
    """The subscriptions' ranges over one side of a change: half-open ones, texts, two fields, a missing value."""
    u, s, x = f"u{k}", f"s{k}", f"x{k}"
    return (
        f"CASE n_nationkey % 6 WHEN 0 THEN {u} >= 5 * n_nationkey WHEN 1 THEN {u} IS NULL OR {u} < 5 * n_nationkey WHEN 2 THEN {s} > 'click-' || n_nationkey % 10 AND {s} <= 'view' "
        f"WHEN 3 THEN {s} = 'view-' || n_nationkey % 10 AND {u} > 3 * n_nationkey AND {u} <= 3 * n_nationkey + 20 WHEN 4 THEN {x} > 4 * n_nationkey ELSE {u} IS NULL END"
    )


def _changes(spark, d):
    """change, tbl, before, after, id_before, id_after: every 11th row is new, every 13th is deleted."""
    e = t(spark, d, "events")
    text = lambda n: F.concat("event_type", F.lit("-"), (n % 10).cast("string"))
    u = F.col("user_id").cast("long")
    before = F.struct(F.when(F.col("event_id") % 7 != 0, u).alias("u"), text(u).alias("s"), F.col("value").alias("x"))
    after = F.struct((u + 7).alias("u"), text(u + 7).alias("s"), (F.col("value") + 1).alias("x"))
    rows = e.select(F.col("event_id").alias("change"), F.lit("events").alias("tbl"), F.when(F.col("event_id") % 11 != 0, before).alias("before"), F.when(F.col("event_id") % 13 != 0, after).alias("after"))
    name = F.col("change").cast("string")
    return rows.withColumn("id_before", F.when(F.col("before").isNotNull(), name)).withColumn("id_after", F.when(F.col("after").isNotNull(), name))


_BY_U, _BY_S, _BY_SU, _BY_X = (D.Watched("events", fields) for fields in (("u",), ("s",), ("s", "u"), ("x",)))


def _ranges(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), (F.col("n_nationkey") % 10).cast("string").alias("digit"))
    kinds = {"long": n.schema["k"].dataType, "text": n.schema["digit"].dataType}
    number, text = lambda c: C.sort_key(c.cast("long"), kinds["long"]), lambda c: C.sort_key(c, kinds["text"])
    from pyspark.sql import types as T

    amount = C.sort_key((F.col("k") * 4).cast("double"), T.DoubleType())
    k = F.col("k")
    cases = [
        (_BY_U, D.interval([], lower=number(k * 5))),
        (_BY_U, D.interval([], upper=number(k * 5), below=True)),
        (_BY_S, D.interval([], lower=text(F.concat(F.lit("click-"), "digit")), above=True, upper=text(F.lit("view")))),
        (_BY_SU, D.interval([text(F.concat(F.lit("view-"), "digit"))], lower=number(k * 3), above=True, upper=number(k * 3 + 20))),
        (_BY_X, D.interval([], lower=amount, above=True)),
        (_BY_U, D.interval([F.lit(C.MISSING)])),
    ]
    pick = lambda f: F.element_at(F.array(*[f(w, i) for w, i in cases]), (k % 6 + 1).cast("int"))
    return n.select(k.alias("sub"), F.lit("events").alias("tbl"), F.lit("range").alias("kind"), F.lit(None).cast("string").alias("id"), pick(lambda w, i: F.lit(w.space)).alias("space"), pick(lambda w, i: i[0]).alias("lo"), pick(lambda w, i: i[1]).alias("hi"))


def _keys(changes):
    kinds = {f.name: f.dataType for f in changes.schema["before"].dataType}
    return D.changed_keys(changes, "events", [_BY_U, _BY_S, _BY_SU, _BY_X], kinds)


@query(f"SELECT event_id AS change, n_nationkey AS sub FROM {_CHANGES}, nation WHERE (NOT born AND ({_matches(0)})) OR (NOT died AND ({_matches(1)}))")
def invalidation_ranges(spark, d):
    """Pairs of changes and stored ranges: with one bound or both, on numbers, texts and amounts, on two fields, on a missing value."""
    changes = _changes(spark, d)
    return D.touched_intervals(_keys(changes), _ranges(spark, d))


_POINTS = "(SELECT c_custkey, c_custkey % 4 AS kind, c_custkey * 3 AS doc, CASE WHEN c_custkey % 8 < 4 THEN 'events' ELSE 'orders' END AS tbl FROM customer)"


@query(
    f"SELECT n_nationkey AS sub FROM {_CHANGES}, nation WHERE (NOT born AND ({_matches(0)})) OR (NOT died AND ({_matches(1)})) GROUP BY n_nationkey "
    f"UNION SELECT 100 + c_custkey FROM {_POINTS} WHERE tbl = 'events' AND (kind <> 0 OR doc IN (SELECT event_id FROM {_CHANGES} WHERE NOT born OR NOT died)) "
    f"UNION SELECT sub FROM (SELECT 100 + c_custkey AS sub FROM {_POINTS} WHERE tbl = 'events' UNION ALL SELECT n_nationkey FROM nation) WHERE EXISTS (SELECT 1 FROM {_CHANGES} WHERE born AND died)"
)
def dependencies_fired(spark, d):
    """Of subscriptions to ranges, documents, scans and searches of two tables, those that the changes of one touch."""
    changes = _changes(spark, d)
    c, own = t(spark, d, "customer"), F.col("c_custkey").cast("long")
    kind = F.element_at(F.array(*map(F.lit, ("point", "scan", "search", "vector"))), (own % 4 + 1).cast("int"))
    none = F.lit(None).cast("binary")
    others = c.select((own + 100).alias("sub"), F.when(own % 8 < 4, "events").otherwise("orders").alias("tbl"), kind.alias("kind"), F.when(own % 4 == 0, (own * 3).cast("string")).alias("id"), F.lit(None).cast("string").alias("space"), none.alias("lo"), none.alias("hi"))
    return D.fired(changes, _keys(changes), _ranges(spark, d).unionByName(others))


@query(f"SELECT event_id AS change, 0 AS sub FROM {_CHANGES} WHERE (NOT born AND u0 > 20 AND u0 <= 40) OR (NOT died AND u1 > 20 AND u1 <= 40) UNION ALL SELECT event_id, 1 FROM {_CHANGES} WHERE (NOT born AND s0 = 'view-3') OR (NOT died AND s1 = 'view-3') UNION ALL SELECT event_id, 2 FROM {_CHANGES} WHERE event_id = 77 UNION ALL SELECT event_id, 0 FROM {_CHANGES} WHERE born AND died UNION ALL SELECT event_id, 1 FROM {_CHANGES} WHERE born AND died UNION ALL SELECT event_id, 2 FROM {_CHANGES} WHERE born AND died AND event_id <> 77")
def dependencies_of_queries(spark, d):
    """Pairs of changes and the dependencies that built queries declare: a range, an equality, a document."""
    from lodestrata.plans.query import Query, eq, gt, lte
    from lodestrata.types import TableSpec

    changes = _changes(spark, d)
    events = Query(t(spark, d, "events"), TableSpec("events", indexes={"by_u": ("u",), "by_s": ("s", "u")}))
    queries = [events.with_index("by_u", gt("u", 20), lte("u", 40)), events.with_index("by_s", eq("s", "view-3"))]
    rows = D.dependency_rows(spark, [*[(k, q.dependency()) for k, q in enumerate(queries)], (2, Dependency("point", "events", id=77))])
    return D.touched(changes, _keys(changes), rows)
