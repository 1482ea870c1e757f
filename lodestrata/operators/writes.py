"""Writes as rewrites of DataFrames: each takes a table and change rows and gives the new table.

Tables here are immutable snapshots: a transaction is a list of levels of changes,
folded so that the last level wins, and a commit is the change rows between two
snapshots. Where the storage knows MERGE, ``changes`` is its source.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.scalars import uuid_of
from lodestrata.operators.windows import numbered_all


def insert(df: DataFrame, rows: DataFrame, id_column: str, creation: str, now_ms: float, order: list[Column], seed: int | None = None, scope: Column | None = None) -> DataFrame:
    """df and rows, each with a new id and rising creation times after the newest there, or the newest in scope where df holds several tables. Ids follow from a seed, drawn once, and the row's number, so a task that runs again gives the same."""
    seed = uuid.uuid4().int >> 66 if seed is None else seed
    newest = (df if scope is None else df.where(scope)).agg(F.max(creation)).first()[0]
    start = now_ms if newest is None or now_ms > newest else newest + 0.001
    timed = numbered_all(rows, order, "_k").withColumn(id_column, uuid_of(F.lit(seed).cast("long") + F.col("_k"))).withColumn(creation, F.lit(float(start)) + F.col("_k") * 0.001)
    return df.unionByName(timed.drop("_k"), allowMissingColumns=True)


def patch(df: DataFrame, changes: DataFrame, key: str, fields: list[str], unset: str | None = None) -> DataFrame:
    """Shallow merge: a change's non-null field replaces the old; fields that its array column ``unset`` names become null. Ids stay."""
    c = changes.select(F.col(key), *[F.col(f).alias(f"_new_{f}") for f in fields], F.lit(True).alias("_hit"), *([F.col(unset).alias("_unset")] if unset else []))
    joined = df.join(c, key, "left")

    def merged(f: str) -> Column:
        value = F.coalesce(f"_new_{f}", f)
        return F.when(F.coalesce(F.array_contains("_unset", f), F.lit(False)), F.lit(None)).otherwise(value) if unset else value

    return joined.select(*[merged(x).alias(x) if x in fields else F.col(x) for x in df.columns])


def replace(df: DataFrame, changes: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """The change's whole body under the old id; columns in keep (creation time) stay."""
    body = [x for x in df.columns if x != key and x not in keep]
    c = changes.select(F.col(key), F.lit(True).alias("_hit"), *[(F.col(x) if x in changes.columns else F.lit(None).cast(df.schema[x].dataType)).alias(f"_new_{x}") for x in body])
    joined = df.join(c, key, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{x}")).otherwise(F.col(x)).alias(x) if x in body else F.col(x) for x in df.columns])


def delete(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def _key(key: str | list[str]) -> list[str]:
    """The columns of a key, which may have several."""
    return [key] if isinstance(key, str) else list(key)


def upsert(df: DataFrame, rows: DataFrame, key: str | list[str]) -> DataFrame:
    """rows replace those of the same key and add the others; of rows with one key give the last one only."""
    return df.join(rows.select(*_key(key)), key, "left_anti").unionByName(rows)


def latest_by_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Of rows with one key the first in that order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def fold_levels(levels: list[DataFrame], key: str) -> DataFrame:
    """A transaction's nested levels as one: for each key the change of the innermost (last) level."""
    tagged = [x.withColumn("_level", F.lit(k)) for k, x in enumerate(levels)]
    return latest_by_key(reduce(lambda a, b: a.unionByName(b), tagged), [key], [F.col("_level").desc()]).drop("_level")


def change_rows(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, op, before, after) of every row that differs between two snapshots; columns that aren't named don't count."""
    side = lambda df, name: df.select(F.col(key), F.struct(*columns).alias(name), F.lit(True).alias(f"in_{name}"))
    both = side(before, "before").join(side(after, "after"), key, "full")
    op = F.when(F.col("in_before").isNull(), "insert").when(F.col("in_after").isNull(), "delete").otherwise("update")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select(key, op.alias("op"), "before", "after")


def reconcile(local: DataFrame, remote: DataFrame, key: str | list[str], columns: list[str], scope: Column | None = None, delete_absent: bool = True, keep: DataFrame | None = None) -> DataFrame:
    """What brings local to remote's state: (key, op, values); a key may have several columns. Equality is of ``columns`` alone; only local rows in scope may go, and none of keep."""
    mine = local if scope is None else local.where(scope)
    a = mine.select(*_key(key), *[F.col(c).alias(f"_old_{c}") for c in columns], F.lit(True).alias("_local"))
    b = remote.select(*_key(key), *columns, F.lit(True).alias("_remote"))
    both = a.join(b, key, "full")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in columns], F.lit(True))
    op = F.when(F.col("_remote").isNull(), "delete").when(F.col("_local").isNull(), "insert").when(~same, "update")
    out = both.withColumn("op", op).where(F.col("op").isNotNull())
    if not delete_absent:
        out = out.where("op <> 'delete'")
    if keep is not None:
        kept = out.where("op = 'delete'").join(keep.select(*_key(key)), key, "left_anti")
        out = out.where("op <> 'delete'").unionByName(kept)
    return out.select(*_key(key), "op", *columns)


def apply_changes(df: DataFrame, changes: DataFrame, key: str | list[str], columns: list[str]) -> DataFrame:
    """df after insert, update and delete rows."""
    kept = df.join(changes.select(*_key(key)), key, "left_anti")
    new = changes.where("op <> 'delete'").select(*_key(key), *columns)
    return kept.unionByName(new, allowMissingColumns=True)


def backfill(df: DataFrame, partial: DataFrame, key: str, columns: list[str], required: list[str]) -> DataFrame:
    """Rows to upsert from partial documents laid over existing ones: without required fields they are dropped, unchanged ones skipped."""
    old = df.select(F.col(key), *[F.col(c).alias(f"_old_{c}") for c in columns], F.lit(True).alias("_there"))
    laid = partial.join(old, key, "left").select(key, *[F.coalesce(F.col(c) if c in partial.columns else F.lit(None), F.col(f"_old_{c}")).alias(c) for c in columns], *[f"_old_{c}" for c in columns], "_there")
    for c in required:
        laid = laid.where(F.col(c).isNotNull())
    changed = reduce(lambda x, y: x | y, [~F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in columns], F.col("_there").isNull())
    return laid.where(changed).select(key, *columns)


def patch_missing(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Fills null fields only."""
    return df.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in df.columns])


def restamp(df: DataFrame, identity: str, owner: object) -> DataFrame:
    """Anonymous rows get an owner."""
    return df.withColumn(identity, F.coalesce(F.col(identity), F.lit(owner)))


def stamp_version(versions: DataFrame, tables: list[str]) -> DataFrame:
    """Versions (table, version) after a commit that wrote those tables."""
    wrote = F.col("table").isin(tables)
    return versions.withColumn("version", F.when(wrote, F.col("version") + 1).otherwise(F.col("version")))
