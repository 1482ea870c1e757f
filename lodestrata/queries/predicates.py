"""The filter tree's nodes, with null rules, on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import expr as E
from lodestrata.operators import schema as S
from lodestrata.operators import views as V
from lodestrata.queries.registry import QUERIES, SQL, query, t
from lodestrata.types import TableSpec, v


def _lines(spark, d, *nodes):
    condition = E.conjunction(list(nodes), (df := t(spark, d, "lineitem")).schema)
    return df.where(condition).select("l_orderkey", "l_linenumber", "l_quantity")


_LINES = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE "


def _register_comparisons() -> None:
    for name, op in {"eq": "=", "neq": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}.items():
        def run(spark, d, name=name):
            return _lines(spark, d, E.Node(name, (E.field("l_quantity"), E.lit(24.0))))

        QUERIES[f"filter_{name}"], SQL[f"filter_{name}"] = run, f"{_LINES} l_quantity {op} 24.0"


_register_comparisons()


@query(f"{_LINES} (l_quantity > 10 AND l_returnflag = 'R') OR NOT (l_discount < 0.05 OR l_linestatus = 'O')")
def filter_and_or_not(spark, d):
    a = E.and_(E.gt(E.field("l_quantity"), 10), E.eq(E.field("l_returnflag"), "R"))
    b = E.not_(E.or_(E.lt(E.field("l_discount"), 0.05), E.eq(E.field("l_linestatus"), "O")))
    return _lines(spark, d, E.or_(a, b))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity + 2) * 3 - 6 > 90 AND l_quantity / 4 < 11 AND l_quantity % 7 = 3")
def filter_arith(spark, d):
    q = E.field("l_quantity")
    return _lines(spark, d, E.gt(E.sub(E.mul(E.add(q, 2), 3), 6), 90), E.lt(E.div(q, 4), 11), E.eq(E.mod(q, 7), 3))


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN z = 0 AND x > 0 THEN 'Infinity' WHEN z = 0 AND x < 0 THEN '-Infinity' WHEN z = 0 THEN 'NaN' ELSE 'finite' END AS quotient, CASE WHEN z = 0 THEN 'NaN' ELSE 'finite' END AS rest "
    "FROM (SELECT *, l_quantity - 25 AS x, l_linenumber - 3 AS z FROM lineitem)"
)
def filter_div_zero(spark, d):
    x, z = E.sub(E.field("l_quantity"), 25), E.sub(E.field("l_linenumber"), 3)
    name = lambda c: F.when(F.isnan(c), "NaN").when(c == float("inf"), "Infinity").when(c == float("-inf"), "-Infinity").otherwise("finite")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", name(E.compile_node(E.div(x, z))).alias("quotient"), name(E.compile_node(E.mod(x, z))).alias("rest"))


_HOLES = "(SELECT event_id, nullif(event_type, 'click') AS kind, CASE WHEN user_id % 5 = 0 THEN NULL ELSE value END AS v FROM events)"


@query(
    "SELECT event_id, kind IS NULL AS eq_null, kind IS DISTINCT FROM 'view' AS neq, (v < 50 OR v IS NULL) AS lt, (v IS NOT NULL AND v >= 50) AS gte, (v <= 50 OR v IS NULL) AS lte, v IS NOT NULL AS gt_null, "
    f"NOT coalesce(v > 20 AND v IS NOT NULL, false) AS not_gt, true AS gte_null, false AS lt_null FROM {_HOLES}"
)
def filter_null_rules(spark, d):
    df = t(spark, d, "events").select("event_id", F.nullif("event_type", F.lit("click")).alias("kind"), F.when(F.col("user_id") % 5 != 0, F.col("value")).alias("v"))
    kind, x = E.field("kind"), E.field("v")
    nodes = {"eq_null": E.eq(kind, None), "neq": E.neq(kind, "view"), "lt": E.lt(x, 50.0), "gte": E.gte(x, 50.0), "lte": E.lte(x, 50.0), "gt_null": E.gt(x, None), "not_gt": E.not_(E.gt(x, 20.0)), "gte_null": E.gte(x, None), "lt_null": E.lt(x, None)}
    return df.select("event_id", *[F.coalesce(E.compile_node(n), F.lit(False)).alias(k) if k == "gte" else E.compile_node(n).alias(k) for k, n in nodes.items()])


@query("SELECT event_id FROM (SELECT event_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE value END AS a, CASE WHEN user_id % 3 = 0 THEN NULL ELSE value / 2 + 40 END AS b FROM events) WHERE CASE WHEN a IS NULL THEN b IS NOT NULL WHEN b IS NULL THEN false ELSE a < b END")
def filter_null_columns(spark, d):
    df = t(spark, d, "events").select("event_id", F.when(F.col("user_id") % 5 != 0, F.col("value")).alias("a"), F.when(F.col("user_id") % 3 != 0, F.col("value") / 2 + 40).alias("b"))
    return df.where(E.compile_node(E.lt(E.field("a"), E.field("b")))).select("event_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def filter_field_path(spark, d):
    df = t(spark, d, "events").withColumn("p", F.from_json("props", "k long"))
    return df.where(E.compile_node(E.gte(E.field("p.k"), 50))).select("event_id", F.col("p.k").alias("k"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount <> 0 AND l_returnflag <> ''")
def filter_truthy(spark, d):
    df = t(spark, d, "lineitem")
    return df.where(E.conjunction([E.field("l_discount"), E.field("l_returnflag")], df.schema)).select("l_orderkey", "l_linenumber")


@query("SELECT event_id, value FROM events WHERE user_id = 46")
def rls_scope(spark, d):
    return V.visible_to(t(spark, d, "events"), 46, "user_id").select("event_id", "value")


@query("SELECT event_id FROM events WHERE user_id % 4 = 0")
def rls_anonymous(spark, d):
    df = t(spark, d, "events").withColumn(V.IDENTITY, F.when(F.col("user_id") % 4 != 0, F.col("user_id")))
    return V.stripped(V.visible_to(df, None)).select("event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 769")
def view_ownership(spark, d):
    return V.owned(t(spark, d, "orders"), 769, "o_custkey").select("o_orderkey", "o_totalprice")


@query("SELECT event_id, coalesce(CASE WHEN user_id % 4 <> 0 THEN user_id END, 999) AS owner FROM events")
def restamp(spark, d):
    from lodestrata.operators.writes import restamp as stamped

    df = t(spark, d, "events").select("event_id", F.when(F.col("user_id") % 4 != 0, F.col("user_id")).alias("owner"))
    return stamped(df, "owner", 999)


ORDER_CHECK = TableSpec(
    "orders", creation="o_orderdate", id="o_orderkey",
    fields={"o_custkey": v.bigint(), "o_orderstatus": v.union(v.literal("F"), v.literal("O")), "o_totalprice": v.number(), "o_orderpriority": v.optional(v.string())},
)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'o_orderstatus: matches no member of the union' WHEN o_totalprice > 400000 THEN 'o_totalprice: missing required field' END AS problem FROM orders")
def validate_rows(spark, d):
    df = t(spark, d, "orders").withColumn("o_totalprice", F.when(F.col("o_totalprice") <= 400000, F.col("o_totalprice")))
    return S.validated(df, ORDER_CHECK).select("o_orderkey", F.col("_problem").alias("problem"))


@query("SELECT doc_id, toxic IN (0, 1) AND quality = 1 AS ok FROM labels")
def enum_check(spark, d):
    df = t(spark, d, "labels")
    spec = TableSpec("labels", creation="doc_id", id="doc_id", fields={"quality": v.literal(1), "toxic": v.union(v.literal(0), v.literal(1))})
    return S.validated(df, spec).select("doc_id", F.col("_problem").isNull().alias("ok"))

