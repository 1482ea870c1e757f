"""The change log of collections: head numbers, latest changes, gaps, kept tails, full and incremental pulls, and which queries a change touches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.expr import as_true
from lodestrata.operators.aggregates import materialise
from lodestrata.operators.windows import keep_newest, numbered
from lodestrata.plans.query import Bound

# A log row: collection, seq, doc, kind ('upsert' or 'delete').


def heads(log: DataFrame) -> DataFrame:
    """Each collection's newest number."""
    return log.groupBy("collection").agg(F.max("seq").alias("head"))


def latest_changes(log: DataFrame, since: int) -> DataFrame:
    """Each document's last kind after ``since``, with the place where it first came up."""
    return log.where(F.col("seq") > since).groupBy("collection", "doc").agg(F.max_by("kind", "seq").alias("kind"), F.min("seq").alias("first_seq"))


def pull_mode(log: DataFrame, since: int) -> DataFrame:
    """Per collection: 'full' where since is beyond the head or the log's next number is gone, 'current' at the head, else 'incremental'."""
    tail = log.groupBy("collection").agg(F.max("seq").alias("head"), F.min(F.when(F.col("seq") > since, F.col("seq"))).alias("next"))
    mode = F.when(F.lit(since) > F.col("head"), "full").when(F.lit(since) == F.col("head"), "current").when(F.col("next") != since + 1, "full").otherwise("incremental")
    return tail.select("collection", "head", mode.alias("mode"))


def record(states: DataFrame, log: DataFrame, changes: DataFrame, order: list[Column], keep: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(states, log) after changes (collection, doc, kind, update): an upsert replaces the document's state, a delete drops it; each change takes the next numbers."""
    fresh = numbered(changes, ["collection"], order, "_n").join(heads(log), "collection", "left")
    fresh = fresh.withColumn("seq", F.coalesce(F.col("head") + 1, F.lit(0)) + F.col("_n")).drop("head", "_n")
    last = fresh.groupBy("collection", "doc").agg(F.max_by(F.struct("kind", "update", "seq"), "seq").alias("l"))
    rows = last.where("l.kind = 'upsert'").select("collection", "doc", "l.update", "l.seq")
    new_states = states.join(last.select("collection", "doc"), ["collection", "doc"], "left_anti").unionByName(rows)
    new_log = log.unionByName(fresh.select(*log.columns))
    return new_states, new_log if keep is None else keep_newest(new_log, ["collection"], "seq", keep)


def materialised_states(states: DataFrame, documents: DataFrame, ops: DataFrame, fields: dict[str, str], key: str = "doc", in_scope: Column | None = None) -> DataFrame:
    """States (key, seq) with their documents; where a document is gone, with the fold of its operations. Only the logs of those are read into the fold."""
    live = states.join(documents, key)
    gone = states.join(documents.select(key), key, "left_anti")
    folded = materialise(gone.select(key).distinct().join(ops, key, "left"), fields, key)
    both = live.unionByName(gone.join(folded, key), allowMissingColumns=True)
    return both if in_scope is None else both.where(in_scope)


def pull_incremental(known: DataFrame, log: DataFrame, states: DataFrame, since: int, in_scope: Column | None = None) -> DataFrame:
    """What a reader that knows documents (doc, seq) must do: noop, delete, replace, or upsert for one it doesn't know.

    A known document with no change after its number is a noop; one whose last change
    is a delete, whose state is gone or has left the scope, is deleted.
    """
    last = log.where(F.col("seq") > since).groupBy("doc").agg(F.max_by("kind", "seq").alias("kind"), F.max("seq").alias("last_seq"))
    scope = F.lit(True) if in_scope is None else in_scope
    live = states.withColumn("_in", scope).select("doc", F.col("seq").alias("state_seq"), "_in")
    mine = known.join(last, "doc", "left").join(live, "doc", "left")
    action = (
        F.when(F.col("last_seq").isNull() | (F.col("last_seq") <= F.col("seq")), "noop").when(F.col("kind") == "delete", "delete")
        .when(F.col("state_seq").isNull() | ~F.col("_in"), "delete").otherwise("replace")
    )
    out = mine.select("doc", action.alias("action"), F.coalesce("state_seq", "seq").alias("seq"))
    new = last.where("kind = 'upsert'").join(known.select("doc"), "doc", "left_anti").join(live.where("_in"), "doc")
    return out.unionByName(new.select("doc", F.lit("upsert").alias("action"), F.col("state_seq").alias("seq")))


def pull_by_ids(requested: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """A requested document without a state is to be deleted."""
    return requested.join(states.withColumn("_there", F.lit(True)), key, "left").withColumn("action", F.when(F.col("_there"), "replace").otherwise("delete")).drop("_there")


def prune_absent(local: DataFrame, seen: DataFrame, key: str, scope: Column | None = None) -> DataFrame:
    """Local rows (in scope) that a finished pull didn't bring."""
    return (local if scope is None else local.where(scope)).join(seen.select(key), key, "left_anti")


def advance(old: DataFrame, new: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """Numbers never fall: the larger of the stored and the new one."""
    return old.select(*key, seq).unionByName(new.select(*key, seq)).groupBy(*key).agg(F.max(seq).alias(seq))


def needed_pulls(signals: DataFrame, pulled: DataFrame, key: list[str]) -> DataFrame:
    """Signals (key, seq) that are newer than what was pulled, one for each key."""
    top = signals.groupBy(*key).agg(F.max("seq").alias("signal_seq"))
    return top.join(pulled.select(*key, F.col("seq").alias("pulled_seq")), key, "left").where(F.col("signal_seq") > F.coalesce("pulled_seq", F.lit(-1))).select(*key, "signal_seq")


# Reactive queries


def touches(bounds: tuple[Bound, ...], before: str = "before", after: str = "after") -> Column:
    """Whether a change row (structs before and after) was or is in a range; without bounds any change counts."""
    if not bounds:
        return F.lit(True)

    def side(name: str) -> Column:
        parts = [as_true(Bound(b.op, f"{name}.{b.field}", b.value).node()) for b in bounds]
        return F.col(name).isNotNull() & reduce(lambda a, b: a & b, parts)

    return side(before) | side(after)


def equal_subscriptions(changes: DataFrame, subscriptions: DataFrame, broad: DataFrame) -> DataFrame:
    """Subscriptions that changes (tbl, field, value) fire, once each: those on that value, and those on the whole table."""
    narrow = subscriptions.join(changes.select("tbl", "field", "value").distinct(), ["tbl", "field", "value"], "left_semi").select("sub")
    whole = broad.join(changes.select("tbl").distinct(), "tbl", "left_semi").select("sub")
    return narrow.union(whole).distinct()
