"""Scalar functions on whole tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions import scalars as S
from lodestrata.functions.cron import daily, hourly, monthly, next_fire, weekly
from lodestrata.queries.registry import query, t


@query("SELECT page_id, substring(regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) AS slug FROM pages")
def slug(spark, d):
    return t(spark, d, "pages").select("page_id", S.slug(F.col("url")).alias("slug"))


@query("SELECT page_id, base64(unhex(sha256(html))) AS sha FROM pages")
def sha256_b64(spark, d):
    return t(spark, d, "pages").select("page_id", S.sha256_base64(F.col("html")).alias("sha"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_path(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT page_id, strlen(to_json({'page_id': page_id, 'url': url, 'body': {'html': html, 'path': string_split(url, '/')}})) AS bytes FROM pages")
def doc_bytes(spark, d):
    """Sizes of nested rows whose texts hold quotes, line ends and letters of several bytes."""
    from lodestrata.plans.paginate import byte_size

    nested = t(spark, d, "pages").select("page_id", "url", F.struct("html", F.split("url", "/").alias("path")).alias("body"))
    return nested.select("page_id", byte_size(nested).cast("long").alias("bytes"))


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '{\"v\":null}' ELSE '{\"v\":\"' || event_type || '\"}' END AS key FROM events")
def value_keys(spark, d):
    return t(spark, d, "events").select("event_id", S.value_key(F.when(F.col("user_id") % 3 != 0, F.col("event_type"))).alias("key"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'customer' ELSE 'customer::{\"nation\":\"' || c_nationkey || '\",\"segment\":\"' || c_mktsegment || '\"}' END AS key FROM customer")
def scope_keys(spark, d):
    arguments = F.when(F.col("c_acctbal") >= 0, F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string")))
    return t(spark, d, "customer").select("c_custkey", S.scope_key("customer", arguments).alias("key"))


@query("SELECT event_id, coalesce(CASE WHEN user_id % 2 = 0 THEN 'token-' || user_id END, event_type) AS key FROM events")
def identity_key_of(spark, d):
    token = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("token-"), F.col("user_id").cast("string")))
    return t(spark, d, "events").select("event_id", S.identity_key(token, F.col("event_type")).alias("key"))


@query("SELECT event_id, event_type AS text FROM events")
def prose_text(spark, d):
    """Text goes to a rich-text tree and back."""
    return t(spark, d, "events").select("event_id", S.prose_text(S.prose_document(F.col("event_type"))).alias("text"))


def _node(kind: str, children: Column) -> Column:
    """JSON of a rich-text node over an array of its children's JSON."""
    return F.concat(F.lit(f'{{"type":"{kind}","content":['), F.array_join(children, ","), F.lit("]}"))


def _leaf(text: Column) -> Column:
    return F.to_json(F.struct(F.lit("text").alias("type"), text.alias("text")))


@query(
    "SELECT conv_id, turn, trim(regexp_replace(role || chr(10) || turn || chr(10) || conv_id || chr(10) || chr(10) || chr(10) || replace(coalesce(text, ''), '. ', chr(10)), "
    "'\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM conversations"
)
def prose_trees(spark, d):
    """Plain text of nested trees: a heading with a hard break, a list, and a paragraph for each sentence of a turn."""
    heading = _node("heading", F.array(_leaf(F.col("role")), F.lit('{"type":"hardBreak"}'), _leaf(F.col("turn").cast("string"))))
    listed = _node("bulletList", F.array(_node("listItem", F.array(_node("paragraph", F.array(_leaf(F.col("conv_id").cast("string"))))))))
    sentences = F.transform(F.split(F.coalesce("text", F.lit("")), r"\. "), lambda s: _node("paragraph", F.array(_leaf(s))))
    tree = _node("doc", F.concat(F.array(heading, listed), sentences))
    return t(spark, d, "conversations").select("conv_id", "turn", S.prose_text(tree).alias("text"))


@query(
    "WITH s AS (SELECT o_orderkey, [(o_orderkey + k * 1831565813) & 4294967295 for k in range(1, 17)] AS s FROM orders), "
    "t AS (SELECT o_orderkey, [CAST((CAST(xor(x, x >> 15) AS HUGEINT) * (x | 1)) % 4294967296 AS BIGINT) for x in s] AS t FROM s), "
    "u AS (SELECT o_orderkey, [xor(x, (x + CAST((CAST(xor(x, x >> 7) AS HUGEINT) * (x | 61)) % 4294967296 AS BIGINT)) & 4294967295) for x in t] AS u FROM t), "
    "b AS (SELECT o_orderkey, [xor(x, x >> 14) >> 24 for x in u] AS b FROM u), "
    "h AS (SELECT o_orderkey, array_to_string([printf('%02x', x) for x in list_concat(b[1:6], [(b[7] & 15) | 64], b[8:8], [(b[9] & 63) | 128], b[10:16])], '') AS h FROM b) "
    "SELECT o_orderkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) AS id FROM h"
)
def uuid_det(spark, d):
    """A version 4 id of each order that depends on its key alone."""
    return t(spark, d, "orders").select("o_orderkey", S.uuid_of(F.col("o_orderkey")).alias("id"))


@query(
    "WITH o AS (SELECT o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day, (o_orderkey * 37) % 1440 AS now, (o_orderkey % 24) * 60 + o_orderkey % 60 AS fire, o_orderkey % 7 AS dow, o_orderkey % 2 AS daily FROM orders), "
    "f AS (SELECT *, CASE WHEN daily = 1 THEN 0 ELSE (dow - (day + 4) % 7 + 7) % 7 END AS ahead FROM o) "
    "SELECT o_orderkey, CAST(((day + ahead) * 1440 + fire + CASE WHEN ahead * 1440 + fire > now THEN 0 WHEN daily = 1 THEN 1440 ELSE 10080 END) * 60000 AS BIGINT) AS next_ms FROM f"
)
def cron_next(spark, d):
    """The next fire of each order's schedule, daily for odd keys and weekly for even ones, after a minute of its date."""
    k = F.col("o_orderkey")
    text = F.concat_ws(" ", (k % 60).cast("string"), (k % 24).cast("string"), F.lit("*"), F.lit("*"), F.when(k % 2 == 1, "*").otherwise((k % 7).cast("string")))
    now = (F.datediff("o_orderdate", F.lit("1970-01-01")).cast("long") * 1440 + (k * 37) % 1440) * 60000
    return t(spark, d, "orders").select("o_orderkey", next_fire(text, now).alias("next_ms"))


@query(
    "WITH c AS (SELECT c_custkey, c_custkey % 4 AS kind, c_custkey % 60 AS m, c_custkey % 24 AS h, 28000000 + c_custkey * 977 AS now FROM customer), "
    "x AS (SELECT *, now // 1440 AS day, now % 1440 AS tod, h * 60 + m AS slot FROM c), "
    "d AS (SELECT *, CASE kind WHEN 0 THEN NULL WHEN 1 THEN day + (CASE WHEN slot > tod THEN 0 ELSE 1 END) WHEN 2 THEN day + (CASE WHEN (day + 4) % 7 = 2 AND slot > tod THEN 0 ELSE (2 - (day + 4) % 7 + 6) % 7 + 1 END) "
    "ELSE (CASE WHEN day(DATE '1970-01-01' + day::INT) < 10 OR (day(DATE '1970-01-01' + day::INT) = 10 AND slot > tod) THEN date_trunc('month', DATE '1970-01-01' + day::INT)::DATE + 9 ELSE (date_trunc('month', DATE '1970-01-01' + day::INT) + INTERVAL 1 MONTH)::DATE + 9 END) - DATE '1970-01-01' END AS fire_day FROM x) "
    "SELECT c_custkey, CAST((CASE WHEN kind = 0 THEN now - tod % 60 + m + (CASE WHEN m > tod % 60 THEN 0 ELSE 60 END) ELSE fire_day * 1440 + slot END) * 60000 AS BIGINT) AS next_ms FROM d"
)
def schedules_next(spark, d):
    """The next fire of hourly, daily, weekly and monthly schedules."""
    c, k = t(spark, d, "customer"), F.col("c_custkey")
    m, h = k % 60, k % 24
    text = F.when(k % 4 == 0, hourly(m)).when(k % 4 == 1, daily(h, m)).when(k % 4 == 2, weekly(F.lit("tuesday"), h, m)).otherwise(monthly(F.lit(10), h, m))
    return c.select("c_custkey", next_fire(text, (28000000 + k * 977) * 60000).alias("next_ms"))


@query("SELECT event_id, user_id * 1000 + 30000 AS lease_expires FROM events")
def lease_times(spark, d):
    return t(spark, d, "events").select("event_id", S.lease_until(F.col("user_id") * 1000).alias("lease_expires"))
