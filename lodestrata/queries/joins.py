"""Lookups, children, semi and anti joins, references, ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import joins as J
from lodestrata.operators import references as R
from lodestrata.queries.registry import query, t


@query("SELECT o_orderkey, c_name, concat(c_mktsegment, '-', o_orderkey) AS identifier FROM orders JOIN customer ON o_custkey = c_custkey")
def lookup_join(spark, d):
    joined = J.lookup(t(spark, d, "orders"), t(spark, d, "customer"), "o_custkey", "c_custkey", must_exist=True)
    return joined.select("o_orderkey", "c_name", F.concat_ws("-", "c_mktsegment", F.col("o_orderkey").cast("string")).alias("identifier"))


@query("SELECT c_custkey, coalesce(n_name, 'unknown') AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def dict_join(spark, d):
    nations = t(spark, d, "nation").where("n_nationkey < 20")
    return J.dictionary(t(spark, d, "customer"), nations, "c_nationkey", "n_nationkey", "n_name", F.lit("unknown"), "nation").select("c_custkey", "nation")


@query("SELECT c_custkey, o_orderkey, child_rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS child_rank FROM orders) JOIN customer ON c_custkey = o_custkey WHERE child_rank <= 3")
def children_topn(spark, d):
    out = J.top_children(t(spark, d, "customer"), t(spark, d, "orders"), "c_custkey", "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 3)
    return out.select("c_custkey", "o_orderkey", F.col("child_rank").cast("long").alias("child_rank"))


_KNOWN = "(SELECT * FROM customer WHERE c_acctbal > 0)"


@query(f"SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM {_KNOWN} WHERE c_custkey = o_custkey)")
def exists_semi(spark, d):
    known = t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return J.having(t(spark, d, "orders"), known, "o_custkey").select("o_orderkey")


@query(f"SELECT o_orderkey, o_custkey AS missing FROM orders WHERE NOT EXISTS (SELECT 1 FROM {_KNOWN} WHERE c_custkey = o_custkey)")
def missing_refs(spark, d):
    return J.missing_references(t(spark, d, "orders"), F.array("o_custkey"), t(spark, d, "customer").where("c_acctbal > 0"), "c_custkey", "o_orderkey")


@query(f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def accepted_refs(spark, d):
    lines = t(spark, d, "lineitem").withColumn("row", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    checks = [(F.array("l_partkey"), t(spark, d, "part").where("p_size > 10"), "p_partkey"), (F.array("l_suppkey"), t(spark, d, "supplier").where("s_acctbal > 0"), "s_suppkey")]
    return J.split_by_references(lines, checks, "row")[0].select("l_orderkey", "l_linenumber")


@query(
    "WITH o AS (SELECT * FROM orders WHERE o_totalprice > 490000), c AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o)), n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c)), "
    "r AS (SELECT * FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n)) SELECT 'customer' AS tbl, c_custkey AS id FROM c UNION ALL SELECT 'nation', n_nationkey FROM n UNION ALL SELECT 'region', r_regionkey FROM r"
)
def hydrate_refs(spark, d):
    hops = [("o_custkey", t(spark, d, "customer"), "c_custkey"), ("c_nationkey", t(spark, d, "nation"), "n_nationkey"), ("n_regionkey", t(spark, d, "region"), "r_regionkey")]
    found = J.hydrate(t(spark, d, "orders").where("o_totalprice > 490000"), hops)
    rows = [df.select(F.lit(name).alias("tbl"), F.col(key).cast("long").alias("id")) for name, df, (_, _, key) in zip(("customer", "nation", "region"), found, hops, strict=True)]
    return rows[0].union(rows[1]).union(rows[2])


@query("SELECT o_orderkey, CASE WHEN c_nationkey = 7 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def id_translate(spark, d):
    known = t(spark, d, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("local_id"), (F.col("c_custkey") + 1000000).alias("remote_id"))
    return R.translate(t(spark, d, "orders"), known, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("SELECT o_custkey, list(CASE WHEN c_nationkey = 7 THEN o_orderkey + 1000000 ELSE o_orderkey END ORDER BY o_orderkey)::VARCHAR AS ids FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey")
def id_translate_nested(spark, d):
    orders, customer = t(spark, d, "orders"), t(spark, d, "customer")
    known = orders.join(customer.where("c_nationkey = 7"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("local_id"), (F.col("o_orderkey") + 1000000).alias("remote_id"))
    lists = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    return R.translate_arrays(lists, known, "ids", "o_custkey").select("o_custkey", F.concat(F.lit("["), F.array_join(F.transform("ids", lambda x: x.cast("string")), ", "), F.lit("]")).alias("ids"))


@query("WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_partkey // 2 ELSE p_partkey END AS id, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END AS rank FROM part) SELECT id, p_partkey FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, p_partkey) = 1")
def canonicalise(spark, d):
    part = t(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_partkey")
    known = part.where("id % 2 = 0").select(F.col("id").alias("local_id"), (F.col("id") / 2).cast("long").alias("remote_id"))
    return R.canonical(part, known, "id", [F.col("p_partkey")]).select("id", "p_partkey")


_TRACE = "(SELECT event_id AS span, user_id AS trace, event_type AS name FROM events)"


@query("SELECT c_custkey, coalesce(array_to_string(list_sort(list(o_orderkey)), ','), '') AS logs FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON o_custkey = c_custkey GROUP BY c_custkey")
def logs_spans_join(spark, d):
    logs = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey")
    out = J.logs_of_spans(t(spark, d, "customer").select("c_custkey"), logs, ["c_custkey"], F.col("o_orderkey"))
    return out.select("c_custkey", F.array_join(F.transform("logs", lambda x: x.cast("string")), ",").alias("logs"))


@query(f"SELECT span FROM {_TRACE} WHERE name <> 'view' OR trace NOT IN (SELECT trace FROM {_TRACE} WHERE name = 'error')")
def anti_spans(spark, d):
    spans = t(spark, d, "events").select(F.col("event_id").alias("span"), F.col("user_id").alias("trace"), F.col("event_type").alias("name"))
    return J.without_nested(spans, "trace", F.col("name") == "view", F.col("name") == "error").select("span")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def fk_check(spark, d):
    labels = t(spark, d, "labels").select(F.col("doc_id").alias("label"))
    return J.missing_references(labels, F.array("label"), t(spark, d, "documents").where("lang = 'en'"), "doc_id", "label").select(F.col("label").alias("doc_id"))


_RESULT = (
    '\'{"_id":7,"rows":[{"name":"x","_id":"c\' || c_custkey || \'","_creationTime":\' || c_custkey || \',"inner":{"_id":"hidden"}},{"deep":[{"_id":"n\' || c_nationkey || \'"},{"more":{"_id":"lost"}}]}],"n":null}\''
)


@query("SELECT c_custkey, 'c' || c_custkey AS id, CAST(c_custkey AS DOUBLE) AS creation_time FROM customer UNION ALL SELECT c_custkey, 'n' || c_nationkey, 0.0 FROM customer")
def harvest(spark, d):
    results = t(spark, d, "customer").select("c_custkey", F.parse_json(F.expr(_RESULT)).alias("value"))
    return R.harvested(results, "value").select("c_custkey", "id", "creation_time")


@query("SELECT c_custkey, 'c' || c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'n' || c_nationkey FROM customer")
def harvest_changed(spark, d):
    """Documents of every third customer are as before, with their fields in another order; those of the next third were different."""
    results = t(spark, d, "customer").select("c_custkey", F.parse_json(F.expr(_RESULT)).alias("value"))
    before = "'{\"inner\":{\"_id\":\"hidden\"},\"_creationTime\":' || c_custkey || ',\"_id\":\"c' || c_custkey || '\",\"name\":\"' || CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE 'y' END || '\"}'"
    previous = t(spark, d, "customer").where("c_custkey % 3 < 2").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.parse_json(F.expr(before)).alias("document"))
    return R.changed_documents(R.harvested(results, "value"), previous).select("c_custkey", "id")
