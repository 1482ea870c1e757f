"""The change log, pulls, the queue, and what a change touches."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import changes as C
from lodestrata.operators import queue as K
from lodestrata.operators import windows as W
from lodestrata.plans import query as Q
from lodestrata.queries.registry import query, t

_LOG = "(SELECT conv_id % 10 AS collection, row_number() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id, turn) - 1 AS seq, conv_id AS doc, CASE WHEN role = 'system' THEN 'delete' ELSE 'upsert' END AS kind FROM conversations)"


def _log(spark, d):
    rows = t(spark, d, "conversations").select((F.col("conv_id") % 10).alias("collection"), F.col("conv_id").alias("doc"), F.when(F.col("role") == "system", "delete").otherwise("upsert").alias("kind"), "turn")
    return W.numbered(rows, ["collection"], [F.col("doc"), F.col("turn")]).drop("turn")


@query(f"SELECT collection, max(seq) AS head FROM {_LOG} GROUP BY collection")
def head_seq(spark, d):
    return C.heads(_log(spark, d))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq FROM conversations")
def doc_seq(spark, d):
    return W.numbered(t(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], [F.col("turn")])


@query(f"SELECT collection, doc, arg_max(kind, seq) AS kind, min(seq) AS first_seq FROM {_LOG} WHERE seq > 5 GROUP BY collection, doc")
def latest_change(spark, d):
    return C.latest_changes(_log(spark, d), 5)


@query(f"SELECT collection, max(seq) AS head, CASE WHEN 40 > max(seq) THEN 'full' WHEN 40 = max(seq) THEN 'current' WHEN min(seq) FILTER (seq > 40) <> 41 THEN 'full' ELSE 'incremental' END AS mode FROM {_LOG} WHERE NOT (collection = 3 AND seq = 41) GROUP BY collection")
def gap_detect(spark, d):
    return C.pull_mode(_log(spark, d).where("NOT (collection = 3 AND seq = 41)"), 40)


@query("SELECT conv_id, before, turn AS after FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role <> 'assistant') WHERE turn > before + 1")
def gap_audit(spark, d):
    return W.gaps(t(spark, d, "conversations").where("role <> 'assistant'").select("conv_id", "turn"), ["conv_id"], "turn")


_KNOWN = "(SELECT doc, max(seq) AS seq FROM log WHERE seq <= 20 GROUP BY doc)"
_STATES = "(SELECT doc, max(seq) AS seq, arg_max(kind, seq) AS kind FROM log GROUP BY doc HAVING arg_max(kind, seq) = 'upsert')"


@query(
    f"WITH log AS (SELECT doc, seq, kind FROM {_LOG} WHERE collection = 4), known AS {_KNOWN}, states AS {_STATES}, ch AS (SELECT doc, max(seq) AS last_seq, arg_max(kind, seq) AS kind FROM log WHERE seq > 20 GROUP BY doc) "
    "SELECT k.doc, CASE WHEN c.last_seq IS NULL OR c.last_seq <= k.seq THEN 'noop' WHEN c.kind = 'delete' OR s.doc IS NULL OR s.doc % 3 = 0 THEN 'delete' ELSE 'replace' END AS action, coalesce(s.seq, k.seq) AS seq "
    "FROM known k LEFT JOIN ch c USING (doc) LEFT JOIN states s USING (doc) UNION ALL "
    "SELECT c.doc, 'upsert', s.seq FROM ch c JOIN states s USING (doc) WHERE c.kind = 'upsert' AND s.doc % 3 <> 0 AND c.doc NOT IN (SELECT doc FROM known)"
)
def pull_incremental(spark, d):
    log = _log(spark, d).where("collection = 4").select("doc", "seq", "kind")
    known = log.where("seq <= 20").groupBy("doc").agg(F.max("seq").alias("seq"))
    states = log.groupBy("doc").agg(F.max("seq").alias("seq"), F.max_by("kind", "seq").alias("kind")).where("kind = 'upsert'").select("doc", "seq")
    return C.pull_incremental(known, log, states, 20, F.col("doc") % 3 != 0)


@query("SELECT doc_id, lang, CASE WHEN lang IS NULL THEN 'delete' ELSE 'replace' END AS action FROM labels LEFT JOIN (SELECT doc_id, lang FROM documents WHERE lang <> 'en') USING (doc_id)")
def pull_by_ids(spark, d):
    return C.pull_by_ids(t(spark, d, "labels").select("doc_id"), t(spark, d, "documents").where("lang <> 'en'").select("doc_id", "lang"), "doc_id").select("doc_id", "lang", "action")


@query("SELECT doc_id, source FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 32 OFFSET 32")
def pull_full_scoped(spark, d):
    from lodestrata.plans.paginate import offset_page
    from lodestrata.plans.query import in_scope

    return offset_page(in_scope(t(spark, d, "documents"), {"lang": "fr"}), [F.col("doc_id")], 32).select("doc_id", "source")


@query("SELECT doc_id FROM documents WHERE lang = 'de' AND doc_id NOT IN (SELECT doc_id FROM labels)")
def prune_absent(spark, d):
    return C.prune_absent(t(spark, d, "documents"), t(spark, d, "labels"), "doc_id", F.col("lang") == "de").select("doc_id")


@query("SELECT conv_id, max(s) AS seq FROM (SELECT conv_id, max(turn) AS s FROM conversations WHERE role = 'user' GROUP BY conv_id UNION ALL SELECT conv_id, max(turn) FROM conversations WHERE role = 'assistant' GROUP BY conv_id) GROUP BY conv_id")
def seq_monotone(spark, d):
    top = lambda role: t(spark, d, "conversations").where(F.col("role") == role).groupBy("conv_id").agg(F.max("turn").alias("seq"))
    return C.advance(top("user"), top("assistant"), ["conv_id"])


@query("WITH p AS (SELECT conv_id, max(turn) AS s FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT conv_id, max(turn) AS signal_seq FROM conversations LEFT JOIN p USING (conv_id) GROUP BY conv_id HAVING max(turn) > coalesce(max(p.s), -1)")
def redundant_pull(spark, d):
    c = t(spark, d, "conversations")
    return C.needed_pulls(c.select("conv_id", F.col("turn").alias("seq")), c.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("seq")), ["conv_id"])


_QUEUE = (
    "(SELECT event_id AS id, CASE WHEN user_id % 9 > 0 THEN user_id END AS identity, CASE event_type WHEN 'click' THEN 'processing' WHEN 'error' THEN 'blocked' WHEN 'view' THEN 'processing' WHEN 'signup' THEN NULL ELSE 'pending' END AS state, "
    "CASE WHEN event_type IN ('click', 'view') AND event_id % 3 > 0 THEN 'p' || event_id % 5 END AS owner, CASE WHEN event_type = 'click' AND event_id % 7 > 0 THEN event_id * 10 END AS lease_expires, "
    "CASE WHEN event_type = 'error' THEN 'scopeChanged' END AS blocked_reason, "
    "event_id % 1000 AS creation_time, user_id * 1000 + event_id % 4 AS target, CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'remove' ELSE 'patch' END AS op FROM events)"
)
_PROCESSORS = "(SELECT DISTINCT CASE WHEN user_id % 9 > 0 THEN user_id END AS identity, 'p' || k AS owner, CASE WHEN k <> 1 THEN 10000 * k END AS seen FROM events, (VALUES (0), (1), (2), (3)) ks(k))"


def _queue(spark, d):
    kind, i = F.col("event_type"), F.col("event_id")
    running = kind.isin("click", "view")
    return t(spark, d, "events").select(
        i.alias("id"), F.when(F.col("user_id") % 9 > 0, F.col("user_id")).alias("identity"),
        F.when(running, "processing").when(kind == "error", "blocked").when(kind == "signup", None).otherwise("pending").alias("state"),
        F.when(running & (i % 3 > 0), F.concat(F.lit("p"), (i % 5).cast("string"))).alias("owner"), F.when((kind == "click") & (i % 7 > 0), i * 10).alias("lease_expires"),
        F.when(kind == "error", "scopeChanged").alias("blocked_reason"), (i % 1000).alias("creation_time"), (F.col("user_id") * 1000 + i % 4).alias("target"),
        F.when(kind == "signup", "create").when(kind == "purchase", "remove").otherwise("patch").alias("op"),
    )


def _processors(spark, d):
    seen = F.explode(F.array(*[F.struct(F.lit(f"p{k}").alias("owner"), F.lit(None if k == 1 else 10_000 * k).cast("long").alias("seen")) for k in range(4)])).alias("p")
    return _queue(spark, d).select("identity").distinct().select("identity", seen).select("identity", "p.*")


@query(
    f"SELECT q.id, q.identity, 80000 AS lease_expires FROM {_QUEUE} q LEFT JOIN {_PROCESSORS} p ON q.identity IS NOT DISTINCT FROM p.identity AND q.owner = p.owner WHERE coalesce(state, 'pending') = 'pending' OR (state = 'processing' AND "
    "((lease_expires IS NOT NULL AND lease_expires <= 50000) OR (q.owner IS NOT NULL AND (p.owner IS NULL OR p.seen IS NULL OR p.seen <= 20000)))) QUALIFY row_number() OVER (PARTITION BY q.identity ORDER BY creation_time, q.id) = 1"
)
def queue_claim(spark, d):
    return K.claim(_queue(spark, d), F.lit(50000), "me", processors=_processors(spark, d)).select("id", "identity", "lease_expires")


_STATE = ["id", "state", "owner", "lease_expires", "blocked_reason"]


@query(
    f"SELECT id, CASE WHEN hit THEN 'processing' ELSE state END AS state, CASE WHEN hit THEN 'p2' ELSE owner END AS owner, CASE WHEN hit THEN 80000 ELSE lease_expires END AS lease_expires, blocked_reason FROM "
    f"(SELECT *, id % 2 = 0 AND coalesce((owner = 'p2' AND state = 'processing') OR (owner IS NULL AND coalesce(state, 'pending') = 'pending'), false) AS hit FROM {_QUEUE})"
)
def queue_renew(spark, d):
    return K.renew(_queue(spark, d), F.col("id") % 2 == 0, "p2", F.lit(50000)).select(*_STATE)


@query(
    f"SELECT id, CASE WHEN hit THEN 'pending' ELSE state END AS state, CASE WHEN NOT hit THEN owner END AS owner, CASE WHEN NOT hit THEN lease_expires END AS lease_expires, CASE WHEN NOT hit THEN blocked_reason END AS blocked_reason "
    f"FROM (SELECT *, coalesce(id % 2 = 0 AND owner = 'p1', false) AS hit FROM {_QUEUE}) WHERE NOT coalesce(id % 11 = 0 AND owner = 'p3', false)"
)
def queue_release(spark, d):
    """Half of an owner's rows are given back; some of another owner's are done and go."""
    return K.remove(K.release(_queue(spark, d), F.col("id") % 2 == 0, "p1"), F.col("id") % 11 == 0, "p3").select(*_STATE)


@query(
    f"SELECT id, CASE WHEN u THEN 'pending' WHEN hit THEN 'blocked' ELSE state END AS state, CASE WHEN NOT hit AND NOT u THEN owner END AS owner, CASE WHEN NOT hit AND NOT u THEN lease_expires END AS lease_expires, "
    f"CASE WHEN u THEN NULL WHEN hit THEN 'authorizationDenied' ELSE blocked_reason END AS blocked_reason FROM (SELECT *, id % 6 = 0 AS hit, identity IS NULL AS u FROM {_QUEUE})"
)
def queue_block(spark, d):
    """Rows are blocked for a denial; then all rows of those who aren't signed in are freed."""
    return K.unblock(K.block(_queue(spark, d), F.col("id") % 6 == 0, "authorizationDenied"), F.lit(None)).select(*_STATE)


@query(
    f"WITH q AS {_QUEUE}, s AS (SELECT target, bool_or(op = 'create') AS made, bool_or(op = 'remove') AS gone, bool_or(state = 'processing') AS running FROM q GROUP BY target), "
    "f AS (SELECT target, id FROM q WHERE op = 'remove' QUALIFY row_number() OVER (PARTITION BY target ORDER BY creation_time, id) = 1) "
    "SELECT q.id, q.op FROM q JOIN s USING (target) LEFT JOIN f USING (target) WHERE NOT (made AND gone AND NOT running) AND NOT (op = 'remove' AND q.id <> f.id AND state <> 'processing')"
)
def queue_compact(spark, d):
    return K.compact(_queue(spark, d)).select("id", "op")


_ERRORS = (
    "(SELECT event_id, event_id % 8 AS attempts, CASE WHEN event_id % 2 = 0 THEN 'issues:remove' ELSE 'issues:update' END AS ref, CASE event_id % 11 WHEN 0 THEN 'UNAUTHENTICATED' WHEN 1 THEN 'FORBIDDEN' WHEN 2 THEN 'DOCUMENT_NOT_FOUND' END AS code, "
    "CASE event_type WHEN 'view' THEN 'Expired TOKEN' WHEN 'error' THEN 'you are Not Authorized' WHEN 'signup' THEN 'scope mismatch' WHEN 'purchase' THEN 'delete on nonexistent document id 7' END AS message FROM events)"
)


@query(
    f"SELECT event_id, CASE WHEN ref LIKE '%:remove' AND (coalesce(code = 'DOCUMENT_NOT_FOUND', false) OR coalesce(contains(message, 'delete on nonexistent document id'), false)) THEN 'drop' WHEN reason <> 'unknown' THEN 'block' WHEN attempts < 5 THEN 'retry' ELSE 'dead_letter' END AS outcome, reason, wait_ms FROM "
    "(SELECT *, CASE WHEN code = 'UNAUTHENTICATED' THEN 'reauthRequired' WHEN code = 'FORBIDDEN' THEN 'authorizationDenied' WHEN regexp_matches(lower(message), 'unauthenticated|invalid token|expired token|authentication required') THEN 'reauthRequired' "
    "WHEN regexp_matches(lower(message), 'forbidden|not authorized|permission denied|access denied') THEN 'authorizationDenied' WHEN regexp_matches(lower(message), 'scope changed|scope mismatch|invalid scope') THEN 'scopeChanged' ELSE 'unknown' END AS reason, "
    f"CAST(least(1000, 25 * 2 ** attempts) AS BIGINT) AS wait_ms FROM {_ERRORS})"
)
def replay_classify(spark, d):
    kind, i = F.col("event_type"), F.col("event_id")
    code = F.when(i % 11 == 0, "UNAUTHENTICATED").when(i % 11 == 1, "FORBIDDEN").when(i % 11 == 2, "DOCUMENT_NOT_FOUND")
    message = F.when(kind == "view", "Expired TOKEN").when(kind == "error", "you are Not Authorized").when(kind == "signup", "scope mismatch").when(kind == "purchase", "delete on nonexistent document id 7")
    ref = F.when(i % 2 == 0, "issues:remove").otherwise("issues:update")
    return t(spark, d, "events").select("event_id", K.after_error(ref, code, message, i % 8).alias("outcome"), K.error_reason(code, message).alias("reason"), K.backoff_ms(i % 8).alias("wait_ms"))


@query("SELECT event_id FROM events WHERE (user_id BETWEEN 10 AND 20) OR (user_id + 5 BETWEEN 10 AND 20)")
def invalidation_overlap(spark, d):
    changes = t(spark, d, "events").select("event_id", F.struct("user_id").alias("before"), F.struct((F.col("user_id") + 5).alias("user_id")).alias("after"))
    return changes.where(C.touches((Q.gte("user_id", 10), Q.lte("user_id", 20)))).select("event_id")


@query("SELECT c_custkey AS sub FROM customer WHERE c_custkey % 50 <> 0 AND c_custkey % 150 IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 100) UNION SELECT c_custkey FROM customer WHERE c_custkey % 50 = 0")
def eq_dispatch(spark, d):
    changes = t(spark, d, "events").where("event_type = 'error' AND value > 100").select(F.lit("events").alias("tbl"), F.lit("user_id").alias("field"), F.col("user_id").alias("value"))
    subs = t(spark, d, "customer").select(F.col("c_custkey").alias("sub"), F.lit("events").alias("tbl"), F.lit("user_id").alias("field"), (F.col("c_custkey") % 150).alias("value"))
    return C.equal_subscriptions(changes, subs.where("sub % 50 <> 0"), subs.where("sub % 50 = 0").select("sub", "tbl"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN -1 ELSE o_totalprice END AS price FROM orders WHERE o_orderstatus <> 'F' OR o_orderpriority = '5-LOW'")
def remote_projection(spark, d):
    o = t(spark, d, "orders")
    remote = o.where("o_orderstatus <> 'F' OR o_orderpriority = '5-LOW'").select("o_orderkey", F.col("o_totalprice").alias("price"))
    local = o.select("o_orderkey", F.lit(-1.0).alias("price"))
    return K.projection(remote, local.union(local), o.where("o_orderstatus = 'P'"), "o_orderkey")


_MERGED = "(SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq FROM conversations)"


@query(
    f"SELECT 'log' AS part, conv_id AS doc, seq, CASE WHEN role = 'system' THEN 'delete' ELSE 'upsert' END AS kind FROM {_MERGED} UNION ALL "
    f"SELECT 'state', conv_id, max(seq), 'upsert' FROM {_MERGED} GROUP BY conv_id HAVING arg_max(role, seq) <> 'system'"
)
def record(spark, d):
    """A log of first turns and its states, after the other turns are recorded."""
    c = t(spark, d, "conversations").select((F.col("conv_id")).alias("collection"), F.col("conv_id").alias("doc"), F.when(F.col("role") == "system", "delete").otherwise("upsert").alias("kind"), F.col("role").alias("update"), "turn")
    first = c.join(c.groupBy("doc").agg(F.min("turn").alias("turn")), ["doc", "turn"], "left_semi")
    log = first.select("collection", F.lit(0).cast("long").alias("seq"), "doc", "kind")
    states = first.where("kind = 'upsert'").select("collection", "doc", "update", F.lit(0).cast("long").alias("seq"))
    changes = c.join(first.select("doc", "turn"), ["doc", "turn"], "left_anti")
    states, log = C.record(states, log, changes, [F.col("turn")])
    return log.select(F.lit("log").alias("part"), "doc", "seq", "kind").unionByName(states.select(F.lit("state").alias("part"), "doc", "seq", F.lit("upsert").alias("kind")))


_OPS = "(SELECT user_id AS doc, event_id AS pos, event_type AS value, value AS amount FROM events)"


@query(
    f"WITH f AS (SELECT doc, max(pos) AS seq, arg_max(value, pos) AS status, round(sum(amount), 4) AS votes FROM {_OPS} GROUP BY doc) SELECT doc, seq, CASE WHEN c_custkey IS NULL THEN status ELSE c_mktsegment END AS status, "
    "CASE WHEN c_custkey IS NULL THEN votes ELSE round(c_acctbal, 4) END AS votes FROM f LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON c_custkey = doc"
)
def materialised_states(spark, d):
    """States with their documents; those of every third customer are gone and come from the log."""
    e = t(spark, d, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("pos"), "event_type", F.col("value").alias("amount"))
    none = F.lit(None).cast("string")
    shape = lambda field, value, delta: e.select("doc", F.lit(field).alias("field"), value.alias("value"), delta.alias("delta"), none.alias("member"), F.col("pos").alias("ts"), "pos")
    ops = shape("status", F.col("event_type"), none).union(shape("votes", none, F.col("amount").cast("string")))
    documents = t(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("doc"), F.col("c_mktsegment").alias("status"), F.col("c_acctbal").alias("votes"))
    states = e.groupBy("doc").agg(F.max("pos").alias("seq"))
    return C.materialised_states(states, documents, ops, {"status": "register", "votes": "counter"}).withColumn("votes", F.round("votes", 4))


@query(
    "SELECT event_id, CASE WHEN event_type = 'click' AND event_id % 3 < 1 THEN '{\"key\":' || (props::JSON->>'k') || '}' ELSE props END AS args, "
    "CASE WHEN event_type = 'click' AND event_id % 3 < 2 THEN '{\"v\":3,\"was\":\"' || user_id || '\"}' WHEN event_type = 'view' THEN NULL ELSE CAST(user_id AS VARCHAR) END AS local_result, "
    "CASE WHEN event_type = 'click' THEN 4 WHEN event_type = 'view' THEN NULL ELSE 1 END AS payload_version FROM events"
)
def payload_migrate(spark, d):
    """Clicks have version 4 (2 and 3 rewrite, 4 changes nothing), other calls version 1; views have no result and stay."""
    click = F.col("event_type") == "click"
    result = F.when(F.col("event_type") != "view", F.col("user_id").cast("string"))
    queued = t(spark, d, "events").select("event_id", F.col("event_type").alias("ref"), F.col("props").alias("args"), result.alias("local_result"), F.when(click, F.col("event_id") % 3 + 1).cast("int").alias("payload_version"))
    key = lambda args, result: (F.to_json(F.struct(F.get_json_object(args, "$.k").cast("int").alias("key"))), result)
    was = lambda args, result: (args, F.to_json(F.struct(F.lit(3).alias("v"), result.alias("was"))))
    return K.migrate_payloads(queued, {"click": (4, {2: key, 3: was})}).drop("ref")
