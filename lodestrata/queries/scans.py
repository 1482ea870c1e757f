"""Scans, index ranges, limits and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import expr as E
from lodestrata.operators import windows as W
from lodestrata.operators.views import IDENTITY, known_fields, stripped
from lodestrata.plans import paginate as P
from lodestrata.plans import query as Q
from lodestrata.plans.query import Query
from lodestrata.queries.registry import query, t
from lodestrata.sources.tables import delete_blobs, put_blobs
from lodestrata.types import TableSpec

EVENTS = TableSpec("events", {"by_user": ("user_id",), "by_type_user": ("event_type", "user_id")}, creation="ts", id="event_id")
ORDERS = TableSpec("orders", {"by_customer": ("o_custkey",), "by_status_date": ("o_orderstatus", "o_orderdate"), "by_priority": ("o_orderpriority",)}, creation="o_orderdate", id="o_orderkey")
LINES = TableSpec("lineitem", {"by_order": ("l_orderkey",)}, creation="l_shipdate", id="l_linenumber")


def events(spark: SparkSession, d: str) -> Query:
    return Query(t(spark, d, "events"), EVENTS)


def orders(spark: SparkSession, d: str) -> Query:
    return Query(t(spark, d, "orders"), ORDERS)


@query("SELECT event_id, user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events")
def scan_asc(spark, d):
    q = events(spark, d)
    return q.plan().select("event_id", "user_id", "event_type", "value", F.row_number().over(Window.partitionBy("user_id").orderBy(*q.sort())).cast("long").alias("place"))


@query("SELECT event_id, user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events")
def scan_desc(spark, d):
    q = events(spark, d).order("desc")
    return q.plan().select("event_id", "user_id", "event_type", "value", F.row_number().over(Window.partitionBy("user_id").orderBy(*q.sort())).cast("long").alias("place"))


@query("SELECT event_id, event_type, value FROM events WHERE user_id = 46")
def index_range_eq(spark, d):
    return events(spark, d).with_index("by_user", Q.eq("user_id", 46)).plan().select("event_id", "event_type", "value")


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'click' AND user_id > 20 AND user_id < 90")
def index_range_eq_gt_lt(spark, d):
    return events(spark, d).with_index("by_type_user", Q.eq("event_type", "click"), Q.gt("user_id", 20), Q.lt("user_id", 90)).plan().select("event_id", "user_id", "value")


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'view' AND user_id >= 50 ORDER BY user_id DESC, ts DESC, event_id DESC LIMIT 40")
def index_range_desc(spark, d):
    return events(spark, d).with_index("by_type_user", Q.eq("event_type", "view"), Q.gte("user_id", 50)).order("desc").take(40).plan().select("event_id", "user_id", "value")


@query("SELECT event_id, user_id FROM events WHERE (user_id, event_id) > (75, 4000)")
def seek_resume(spark, d):
    return t(spark, d, "events").where(P.after(("user_id", "event_id"), [75, 4000])).select("event_id", "user_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 250000.0")
def seek_inclusive(spark, d):
    return P.seek(t(spark, d, "orders"), "o_totalprice", 250000.0).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def point_get(spark, d):
    return Q.point_get(t(spark, d, "orders"), ORDERS, 7).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = 1200) THEN 'supplier' WHEN EXISTS (SELECT 1 FROM customer WHERE c_custkey = 1200) THEN 'customer' ELSE 'part' END AS \"table\" WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = 1200 UNION ALL SELECT 1 FROM customer WHERE c_custkey = 1200 UNION ALL SELECT 1 FROM part WHERE p_partkey = 1200)")
def probe_table(spark, d):
    tables = {"supplier": (t(spark, d, "supplier"), "s_suppkey"), "customer": (t(spark, d, "customer"), "c_custkey"), "part": (t(spark, d, "part"), "p_partkey")}
    return Q.probe_tables(tables, 1200)


@query("SELECT p_partkey AS id, p_brand AS p_brand, NULL AS s_name, 'part' AS \"table\" FROM part UNION ALL SELECT s_suppkey, NULL, s_name, 'supplier' FROM supplier")
def list_tables(spark, d):
    part = t(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand")
    supplier = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_name")
    return Q.list_tables({"part": part, "supplier": supplier})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def scope_list(spark, d):
    return Q.in_scope(t(spark, d, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, value FROM events WHERE value % 10 > 5 AND event_type = 'purchase' ORDER BY ts, event_id LIMIT 25")
def take_after_filter(spark, d):
    q = events(spark, d).take(25).filter(E.gt(E.mod(E.field("value"), 10), 5), E.eq(E.field("event_type"), "purchase")).take(3)
    return q.plan().select("event_id", "value")


@query("SELECT event_id, value FROM events WHERE value > 400 ORDER BY ts, event_id LIMIT 1")
def first_match(spark, d):
    return events(spark, d).filter(E.gt(E.field("value"), 400)).take(1).plan().select("event_id", "value")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 42 LIMIT 2")
def unique_match(spark, d):
    return orders(spark, d).with_index("by_id", Q.eq("o_orderkey", 42)).take(2).plan().select("o_orderkey", "o_custkey")


_PAGE = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'"


def _open(spark, d) -> Query:
    return orders(spark, d).with_index("by_status_date", Q.eq("o_orderstatus", "O"))


@query(f"{_PAGE} ORDER BY o_orderdate, o_orderkey LIMIT 50")
def page_first(spark, d):
    return P.page_plan(_open(spark, d)).limit(50).select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"WITH c AS (SELECT o_orderdate d, o_orderkey k FROM orders WHERE o_orderstatus = 'O' ORDER BY 1, 2 LIMIT 1 OFFSET 49) {_PAGE} AND (o_orderdate, o_orderkey) > (SELECT (d, k) FROM c) ORDER BY o_orderdate, o_orderkey LIMIT 50")
def page_next(spark, d):
    q = _open(spark, d)
    return P.page_plan(q, P.paginate(q, 50).continue_cursor).limit(50).select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"{_PAGE} ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30 OFFSET 30")
def page_next_desc(spark, d):
    q = _open(spark, d).order("desc")
    return P.page_plan(q, P.paginate(q, 30).continue_cursor).limit(30).select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"{_PAGE} ORDER BY o_orderdate, o_orderkey LIMIT 40 OFFSET 40")
def page_pinned(spark, d):
    q = _open(spark, d)
    first = P.paginate(q, 40)
    second = P.paginate(q, 40, first.continue_cursor)
    return P.page_plan(q, first.continue_cursor, second.continue_cursor).select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"{_PAGE} ORDER BY o_orderdate, o_orderkey LIMIT 15")
def page_budget_rows(spark, d):
    rows = P.paginate(_open(spark, d), 50, max_rows=15).page
    return spark.createDataFrame([(r.o_orderkey, r.o_custkey, r.o_totalprice) for r in rows], "o_orderkey long, o_custkey long, o_totalprice double")


@query(
    "WITH p AS (SELECT c_custkey, length(c_name) + length(c_mktsegment) AS n_bytes FROM customer ORDER BY c_custkey LIMIT 200), "
    "r AS (SELECT *, coalesce(sum(n_bytes) OVER (ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p) SELECT c_custkey, CAST(n_bytes AS BIGINT) AS n_bytes FROM r WHERE b < 1500"
)
def page_budget_bytes(spark, d):
    page = t(spark, d, "customer").orderBy("c_custkey").limit(200).select("c_custkey", (F.length("c_name") + F.length("c_mktsegment")).cast("long").alias("n_bytes"))
    return W.budget_prefix(page, [F.col("c_custkey")], "n_bytes", 1500)


@query("WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS k, count(*) OVER () AS n FROM (SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 61)) SELECT o_orderkey, n, CASE WHEN n > 4 * 25 THEN 'SplitRequired' WHEN n > 2 * 25 THEN 'SplitRecommended' END AS status FROM p WHERE k = (n - 1) // 2")
def page_split_hint(spark, d):
    page = orders(spark, d).take(61).plan()
    n = page.count()
    key = page.select("o_orderkey").collect()[P.split_index(n)][0]
    return spark.createDataFrame([(key, n, P.split_status(n, 25))], "o_orderkey long, n long, status string")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 32 OFFSET 64")
def page_offset(spark, d):
    return P.offset_page(t(spark, d, "documents"), [F.col("doc_id")], 64).select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 65")
def page_dockey(spark, d):
    return P.key_page(t(spark, d, "documents"), "doc_id", 100).select("doc_id", "lang")


@query("SELECT count(*) AS n FROM events")
def count_table(spark, d):
    return t(spark, d, "events").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM events WHERE user_id = 46 AND event_type = 'click'")
def count_scope(spark, d):
    return events(spark, d).with_index("by_type_user", Q.eq("event_type", "click"), Q.eq("user_id", 46)).matching().agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) = 0 AS is_empty FROM events WHERE user_id = -1")
def has_any(spark, d):
    return events(spark, d).with_index("by_user", Q.eq("user_id", -1)).matching().limit(1).agg((F.count(F.lit(1)) == 0).alias("is_empty"))


@query("SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def catalog_counts(spark, d):
    return Q.list_tables({n: t(spark, d, n).agg(F.count(F.lit(1)).alias("n")) for n in ("customer", "orders", "part")}).select(F.col("table").alias("name"), "n")


@query("SELECT event_id, CASE WHEN user_id IN (SELECT s_suppkey FROM supplier) THEN user_id END AS id FROM events")
def normalize_id(spark, d):
    """Ids of which some belong to another table."""
    spec = TableSpec("supplier", creation="s_suppkey", id="s_suppkey")
    return Q.normalize_ids(t(spark, d, "events").select("event_id", "user_id"), "user_id", t(spark, d, "supplier"), spec).select("event_id", "id")


@query("SELECT o_orderkey FROM orders ORDER BY CASE o_orderpriority WHEN '3-MEDIUM' THEN 0 WHEN '1-URGENT' THEN 1 WHEN '5-LOW' THEN 2 ELSE 3 END, o_orderdate DESC, o_orderkey LIMIT 100")
def ordinal_sort(spark, d):
    """The first orders by a list of priorities; those that aren't listed come last."""
    rank = Q.ordinal(F.col("o_orderpriority"), ["3-MEDIUM", "1-URGENT", "5-LOW"])
    return t(spark, d, "orders").orderBy(rank, F.col("o_orderdate").desc(), "o_orderkey").limit(100).select("o_orderkey")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS k FROM documents WHERE lang = 'en') SELECT doc_id FROM r WHERE k > (SELECT k FROM r ORDER BY doc_id LIMIT 1) ORDER BY k LIMIT 25")
def ranked_page(spark, d):
    """The page after the row whose id the cursor names."""
    from lodestrata.plans.paginate import ranked_page as page

    rows = t(spark, d, "documents").where("lang = 'en'")
    return page(rows, [F.col("n_chars").desc()], "doc_id", 25, rows.agg(F.min("doc_id")).first()[0]).select("doc_id")


@query("SELECT doc_id, strlen(text) AS size, to_base64(unhex(sha256(text))) AS sha256 FROM documents WHERE lang <> 'fr'")
def blob_metadata(spark, d):
    """Texts put as blobs with size and digest; French ones are deleted again."""
    docs = t(spark, d, "documents")
    blobs = put_blobs(docs.select("doc_id", "lang", F.col("text").cast("binary").alias("content")), "content").withColumn("storage_id", F.col("doc_id"))
    return delete_blobs(blobs, blobs.where("lang = 'fr'")).select("doc_id", "size", "sha256")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def strip_fields(spark, d):
    """Without the owner column, an omitted field and fields that aren't declared."""
    c = t(spark, d, "customer").withColumn(IDENTITY, F.col("c_nationkey"))
    return known_fields(stripped(c, "c_acctbal"), ["c_custkey", "c_name", "c_mktsegment", "gone"])
