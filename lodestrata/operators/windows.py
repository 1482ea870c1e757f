"""Window shapes: kept tails, budgets by running sums, gaps, sequence numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(df: DataFrame, key: list[str], order: list[Column], name: str = "seq") -> DataFrame:
    """Sequence numbers from 0 within each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long") - 1)


def keep_newest(df: DataFrame, key: list[str], seq: str, n: int) -> DataFrame:
    """The n newest rows of each key; with n = 0 nothing is deleted."""
    if n <= 0:
        return df
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(seq).desc()))).where(F.col("_k") <= n).drop("_k")


def keep_within(df: DataFrame, key: list[str], seq: str, bytes_: str, n: int, budget: int) -> DataFrame:
    """The newest rows of each key within a count and a running byte sum: the first row over the budget goes, with all older ones. With n = 0 nothing is deleted."""
    if n <= 0:
        return df
    newest = Window.partitionBy(*key).orderBy(F.col(seq).desc())
    running = F.sum(bytes_).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_k", F.row_number().over(newest)).withColumn("_s", running).where((F.col("_k") <= n) & (F.col("_s") <= budget)).drop("_k", "_s")


def tail_counters(df: DataFrame, key: list[str], seq: str, bytes_: str, n: int, budget: int) -> DataFrame:
    """What ``keep_within`` would do to each key: rows kept, rows deleted and bytes retained."""
    newest = Window.partitionBy(*key).orderBy(F.col(seq).desc())
    running = F.sum(bytes_).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    stays = F.lit(True) if n <= 0 else (F.row_number().over(newest) <= n) & (running <= budget)
    return df.withColumn("_stays", stays).groupBy(*key).agg(F.count_if("_stays").alias("kept"), F.count_if(~F.col("_stays")).alias("deleted"), F.coalesce(F.sum(F.when(F.col("_stays"), F.col(bytes_))), F.lit(0)).alias("retained_bytes"))


def gaps(df: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Places where a key's sequence jumps: the last number before and the first after."""
    before = F.lag(seq).over(Window.partitionBy(*key).orderBy(seq))
    return df.withColumn("before", before).where(F.col(seq) > F.col("before") + 1).select(*key, "before", F.col(seq).alias("after"))


def numbered_all(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Numbers from 0 over all rows in that order: rows are dealt by ranges, numbered in each, and moved on by the sizes of the ranges before (a number for each partition).

    The dealt rows are a written table, as ranges are drawn from a sample and would differ if they were dealt again.
    """
    from lodestrata.sources.tables import shared_folder

    n, path = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), shared_folder(df.sparkSession, "dealt")
    df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    dealt = df.sparkSession.read.parquet(path)
    sizes, before, total = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}, [], 0
    for k in range(n):
        before.append(total)
        total += sizes.get(k, 0)
    offset = F.get(F.array(*map(F.lit, before)), F.col("_part"))
    return dealt.withColumn(name, F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + offset).drop("_part")


def first_claimable(df: DataFrame, key: list[str], claimable: Column, order: list[Column]) -> DataFrame:
    """The first row of each key that may be claimed."""
    ready = df.where(claimable)
    return ready.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def budget_prefix(df: DataFrame, order: list[Column], bytes_: str, most: int) -> DataFrame:
    """The first rows of an ordered page until the budget is reached, with the row that crosses it. For a page, which a limit has bounded before."""
    before = F.coalesce(F.sum(bytes_).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_b", before).where(F.col("_b") < most).drop("_b")


def monotone_times(df: DataFrame, proposed: str, order: list[Column], partition: list[str] | None = None, step: float = 0.001) -> DataFrame:
    """Creation times that always rise: each is the proposed time, or the one before plus a step where that isn't later.

    With t the proposed time and k the row's number the result is step * k plus the
    running maximum of t - step * k, which needs no loop.
    """
    w = Window.partitionBy(*(partition or [])).orderBy(*order)
    shifted = F.col(proposed) - F.lit(step) * F.row_number().over(w)
    peak = F.max(F.col("_shifted")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_k", F.row_number().over(w)).withColumn("_shifted", shifted).withColumn("creation_time", peak + F.lit(step) * F.col("_k")).drop("_k", "_shifted")
