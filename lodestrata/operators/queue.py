"""The queue of pending calls: claims with leases, compaction, and what to do after an error."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.windows import first_claimable

# A queue row: id, identity, state (pending, processing, blocked; null is pending), owner, started, lease_expires, blocked_reason, creation_time.


def stale_owner(now: Column, stale_ms: int) -> Column:
    """Of rows joined with processors (``seen``: when the owner was last seen): an owner that isn't known or hasn't been seen for so long. Rows without owner have none to lose."""
    return F.col("owner").isNotNull() & F.coalesce(F.col("seen") <= now - F.lit(stale_ms), F.lit(True))


def claimable(now: Column, gone: Column | None = None) -> Column:
    """Pending rows; processing rows with a lease that has run out, or, where it is known, whose owner is gone. No lease never runs out."""
    free = F.coalesce(F.col("lease_expires") <= now, F.lit(False))
    if gone is not None:
        free = free | F.coalesce(gone, F.lit(False))
    state = F.coalesce("state", F.lit("pending"))
    return (state == "pending") | ((state == "processing") & free)


def claim(queue: DataFrame, now: Column, owner: str, lease_ms: int = 30_000, processors: DataFrame | None = None, stale_ms: int | None = None) -> DataFrame:
    """The first claimable row of each identity, as claimed. First in, first out: a blocked or running head doesn't hold up the rows behind it.

    processors: (identity, owner, seen), a row each; stale_ms is the lease's length where it isn't given.
    """
    rows, gone = queue, None
    if processors is not None:
        p = processors.select(F.col("identity").alias("_identity"), F.col("owner").alias("_owner"), "seen")
        rows = queue.join(p, F.col("identity").eqNullSafe(F.col("_identity")) & (F.col("owner") == F.col("_owner")), "left")
        gone = stale_owner(now, lease_ms if stale_ms is None else stale_ms)
    head = first_claimable(rows, ["identity"], claimable(now, gone), [F.col("creation_time").asc(), F.col("id").asc()])
    return _with(head, F.lit(True), {"state": F.lit("processing"), "owner": F.lit(owner), "started": now, "lease_expires": now + F.lit(lease_ms), "blocked_reason": None}).select(*queue.columns)


def _with(queue: DataFrame, which: Column, values: dict[str, Column | None]) -> DataFrame:
    """The queue with values in the rows of ``which``; columns that the queue lacks are left out."""
    hit = F.coalesce(which, F.lit(False))
    new = lambda c: F.when(~hit, F.col(c)) if values[c] is None else F.when(hit, values[c]).otherwise(F.col(c))
    return queue.select(*[new(c).alias(c) if c in values else F.col(c) for c in queue.columns])


def _owned(which: Column, owner: str | None) -> Column:
    return which if owner is None else which & (F.col("owner") == owner)


def renew(queue: DataFrame, which: Column, owner: str, now: Column, lease_ms: int = 30_000) -> DataFrame:
    """A new lease for the owner's running rows, and for pending ones that nobody owns, which start to run."""
    free = F.col("owner").isNull() & (F.coalesce("state", F.lit("pending")) == "pending")
    mine = which & (((F.col("owner") == owner) & (F.col("state") == "processing")) | free)
    return _with(queue, mine, {"state": F.lit("processing"), "owner": F.lit(owner), "lease_expires": now + F.lit(lease_ms)})


def release(queue: DataFrame, which: Column, owner: str | None = None) -> DataFrame:
    """Back to pending, without owner, lease and reason; only the owner's rows where one is given."""
    return _with(queue, _owned(which, owner), {"state": F.lit("pending"), "owner": None, "started": None, "lease_expires": None, "blocked_reason": None})


def remove(queue: DataFrame, which: Column, owner: str | None = None) -> DataFrame:
    return queue.where(~F.coalesce(_owned(which, owner), F.lit(False)))


def block(queue: DataFrame, which: Column, reason: str | Column) -> DataFrame:
    return _with(queue, which, {"state": F.lit("blocked"), "owner": None, "started": None, "lease_expires": None, "blocked_reason": F.lit(reason) if isinstance(reason, str) else reason})


def unblock(queue: DataFrame, identity: Column) -> DataFrame:
    """All of an identity's rows pending again; null is the identity of those who aren't signed in."""
    return release(queue, F.col("identity").eqNullSafe(identity))


def compact(queue: DataFrame) -> DataFrame:
    """Rows (id, target, op, state, creation_time) without what cancels out.

    Of several removes of one target the first stays. A target that was created and
    removed here, with no row being processed, goes with all its rows.
    """
    sides = queue.groupBy("target").agg(
        F.max((F.col("op") == "create").cast("int")).alias("made"), F.max((F.col("op") == "remove").cast("int")).alias("gone"),
        F.max((F.col("state") == "processing").cast("int")).alias("running"), F.min(F.when(F.col("op") == "remove", F.struct("creation_time", "id"))).alias("first_remove"),
    )
    joined = queue.join(sides, "target")
    cancelled = (F.col("made") == 1) & (F.col("gone") == 1) & (F.col("running") == 0)
    repeated = (F.col("op") == "remove") & (F.col("id") != F.col("first_remove.id")) & (F.col("state") != "processing")
    return joined.where(~cancelled & ~repeated).select(*queue.columns)


# Error codes, and parts of messages, in small letters, that name a lost sign-in, a denial, a changed scope.
SIGN_IN = ("unauthenticated", "invalid token", "expired token", "authentication required")
DENIED = ("forbidden", "not authorized", "permission denied", "access denied")
SCOPE = ("scope changed", "scope mismatch", "invalid scope")
GONE = "delete on nonexistent document id"


def error_reason(code: Column, message: Column) -> Column:
    """Why a replay failed: reauthRequired, authorizationDenied, scopeChanged or unknown; codes go before messages."""
    says = lambda words: F.coalesce(F.lower(message), F.lit("")).rlike("|".join(words))
    return (
        F.when(code == "UNAUTHENTICATED", "reauthRequired").when(code == "FORBIDDEN", "authorizationDenied").when(says(SIGN_IN), "reauthRequired")
        .when(says(DENIED), "authorizationDenied").when(says(SCOPE), "scopeChanged").otherwise("unknown")
    )


def already_applied(ref: Column, code: Column, message: Column) -> Column:
    """A remove whose document is gone has had its effect."""
    return ref.endswith(":remove") & (F.coalesce(code == "DOCUMENT_NOT_FOUND", F.lit(False)) | F.coalesce(message.contains(GONE), F.lit(False)))


def after_error(ref: Column, code: Column, message: Column, attempts: Column, most: int = 5) -> Column:
    """What becomes of a row whose replay failed: drop what was applied before, block on a known reason, else retry, and at last dead-letter."""
    return (
        F.when(already_applied(ref, code, message), "drop").when(error_reason(code, message) != "unknown", "block")
        .when(attempts < most, "retry").otherwise("dead_letter")
    )


def backoff_ms(attempt: Column, base: int = 25, most: int = 1000) -> Column:
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2), attempt)).cast("long")


#: Rows that a task of a join gets, so that its memory doesn't grow with the tables.
TASK_ROWS = 500_000


def projection(remote: DataFrame, local: DataFrame, dirty: DataFrame, key: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """A remote snapshot as a reader with unsent changes sees it: dirty rows come from local, once, whatever remote has. Rows are dealt to as many tasks as their number asks for."""
    sizes = [df.count() for df in (remote, local, dirty)]
    n = max(int(remote.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(max(sizes) / task_rows))
    theirs, mine, keys = (df.repartition(n, key) for df in (remote, local, dirty.select(key)))
    clean = theirs.join(keys, key, "left_anti")
    return clean.unionByName(mine.join(keys, key, "left_semi").dropDuplicates([key]))


#: Rewrites the JSON texts (arguments, local result) of a queued call by one version.
PayloadStep = Callable[[Column, Column], tuple[Column, Column]]


def migrate_payloads(entries: DataFrame, plans: dict[str, tuple[int, dict[int, PayloadStep]]]) -> DataFrame:
    """Queued calls (ref, args, local_result, payload_version, ..) at the version that their ref has now.

    plans: for each ref its version and its steps, by the version that they lead to; a
    version without a step changes nothing. A ref without a plan is at version 1, as is an
    entry without a number. Entries that lack a ref, arguments or a result stay as they
    are. One that is ahead of its ref fails the job when it is read.
    """
    ref, start = F.col("ref"), F.coalesce(F.col("payload_version"), F.lit(1))
    whole = reduce(lambda a, b: a & b, [F.coalesce(F.col(c) != "", F.lit(False)) for c in ("ref", "args", "local_result")])
    target = reduce(lambda rest, p: F.when(ref == p[0], p[1][0]).otherwise(rest), plans.items(), F.lit(1))
    ahead = F.raise_error(F.concat(ref, F.lit(" has a payload of version "), start.cast("string"), F.lit(", newer than "), target.cast("string")))
    out = entries.withColumns({"_start": start, "_to": F.when(whole, F.when(start > target, ahead.cast("int")).otherwise(target))})
    for version in sorted({v for _, steps in plans.values() for v in steps}):
        args, result = F.col("args"), F.col("local_result")
        due = (F.col("_start") < version) & (F.lit(version) <= F.col("_to"))
        for name, (_, steps) in plans.items():
            if version in steps:
                new_args, new_result = steps[version](F.col("args"), F.col("local_result"))
                args, result = F.when(due & (ref == name), new_args).otherwise(args), F.when(due & (ref == name), new_result).otherwise(result)
        out = out.withColumns({"args": args, "local_result": result})
    return out.withColumn("payload_version", F.coalesce("_to", "payload_version")).drop("_start", "_to")
