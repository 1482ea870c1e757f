"""Join shapes: lookups with an error, dictionaries, children, semi and anti joins, shadowing, chained references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows up to which a dictionary is sent to all tasks; larger ones are joined by shuffle.
DICTIONARY_ROWS = 100_000


def small(df: DataFrame, rows: int = DICTIONARY_ROWS) -> DataFrame:
    """df with a broadcast hint where it has no more rows than that; the count stops at the limit."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lookup(child: DataFrame, parent: DataFrame, fk: str, pk: str, must_exist: bool = False) -> DataFrame:
    """Each child with its parent's columns. With must_exist a child without a parent fails the job when it is read."""
    if not must_exist:
        return child.join(parent, child[fk] == parent[pk], "inner")
    joined = child.join(parent, child[fk] == parent[pk], "left")
    missing = F.raise_error(F.concat(F.lit(f"{fk} without {pk}: "), child[fk].cast("string")))
    return joined.withColumn(pk, F.when(parent[pk].isNull(), missing.cast(parent.schema[pk].dataType)).otherwise(parent[pk]))


def dictionary(df: DataFrame, names: DataFrame, key: str, entry: str, value: str, fallback: Column, alias: str) -> DataFrame:
    """df with the dictionary's value for its key, or the fallback."""
    listed = small(names.select(F.col(entry).alias("_entry"), F.col(value).alias("_value")))
    return df.join(listed, F.col(key) == F.col("_entry"), "left").withColumn(alias, F.coalesce("_value", fallback)).drop("_entry", "_value")


def top_children(parents: DataFrame, children: DataFrame, pk: str, fk: str, order: list[Column], n: int) -> DataFrame:
    """The first n children of each parent; a parent without children has no row. Ranks before it joins, so only n rows a key are joined."""
    ranked = children.withColumn("child_rank", F.row_number().over(Window.partitionBy(fk).orderBy(*order))).where(F.col("child_rank") <= n)
    return parents.join(ranked, parents[pk] == ranked[fk])


def having(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows with a match in other (EXISTS)."""
    return df.join(other.select(on) if isinstance(on, str) else other.select(*on), on, "left_semi")


def missing_references(df: DataFrame, ids: Column, target: DataFrame, target_id: str, row_id: str) -> DataFrame:
    """(row, missing) for every id in an array column that target lacks; null ids refer to nothing."""
    wanted = df.select(F.col(row_id), F.explode(F.array_distinct(F.array_compact(ids))).alias("missing"))
    return wanted.join(target.select(F.col(target_id).alias("missing")), "missing", "left_anti").select(row_id, "missing")


def split_by_references(df: DataFrame, checks: list[tuple[Column, DataFrame, str]], row_id: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, skipped): rows whose references all exist, and the others."""
    bad = None
    for ids, target, target_id in checks:
        part = missing_references(df, ids, target, target_id, row_id).select(row_id)
        bad = part if bad is None else bad.union(part)
    return df.join(bad, row_id, "left_anti"), df.join(bad, row_id, "left_semi")


def hydrate(start: DataFrame, hops: list[tuple[str, DataFrame, str]]) -> list[DataFrame]:
    """The distinct rows that a chain of references reaches, table by table: each hop is (foreign key, table, its key).

    Every step narrows to the keys still needed, so a shared parent is read once.
    """
    out, at = [], start
    for fk, df, key in hops:
        need = at.select(F.col(fk).alias(key)).where(F.col(key).isNotNull()).distinct()
        at = df.join(need, key, "left_semi")
        out.append(at)
    return out


def overlay(committed: DataFrame, pending: DataFrame, key: str, deleted: str = "_deleted") -> DataFrame:
    """Read your own writes: committed rows that no pending write shadows, and pending rows that aren't deletions."""
    visible = pending.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)
    return committed.join(pending.select(key), key, "left_anti").unionByName(visible)


def logs_of_spans(spans: DataFrame, logs: DataFrame, on: list[str], log: Column) -> DataFrame:
    """Each span with the sorted array of its logs; empty without any."""
    grouped = logs.groupBy(*on).agg(F.array_sort(F.collect_list(log)).alias("logs"))
    return spans.join(grouped, on, "left").withColumn("logs", F.coalesce("logs", F.array()))


def without_nested(spans: DataFrame, trace: str, nested: Column, top: Column) -> DataFrame:
    """Spans, but not nested ones whose trace also has a top-level span."""
    covered = spans.where(top).select(trace).distinct()
    inner = spans.where(nested).join(covered, trace, "left_anti")
    return spans.where(~nested).unionByName(inner)
