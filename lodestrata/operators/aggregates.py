"""Counts, percentiles by index, and folds of operation logs (registers, counters, sets)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def percentile_at(sorted_values: Column, p: float) -> Column:
    """The element at floor(p * n), counted from 0 and at most n - 1, of a sorted array. Not interpolated."""
    n = F.size(sorted_values)
    return F.element_at(sorted_values, F.least(n - 1, F.floor(n * F.lit(p)).cast("int")) + 1)


def exact_percentiles(df: DataFrame, kind: str, value: str, ps: dict[str, float], partitions: int | None = None) -> DataFrame:
    """Count, mean and percentiles of each kind, null being a kind of its own; null values don't count.

    Values are counted first, so that a hot kind sends each distinct value once a task.
    The counts are dealt by ranges of (kind, value), whose ends Spark samples, so a
    partition holds its share of the distinct values however they are spread over
    kinds and numbers. Sums of the partitions tell which of them holds a percentile;
    only those are ranked, each on its own. The dealt counts are a written table, as ranges
    are drawn from a sample and would differ if they were dealt again.
    """
    from lodestrata.sources.tables import shared_folder

    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(kind).alias("kind"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    path = shared_folder(df.sparkSession, "percentiles")
    counted.repartitionByRange(n, "kind", "v").withColumn("part", F.spark_partition_id()).write.parquet(path)
    dealt = df.sparkSession.read.schema(T.StructType([*counted.schema, T.StructField("part", T.IntegerType())])).parquet(path)
    spans = dealt.groupBy("kind", "part").agg(F.sum("c").alias("n"), F.sum(F.col("v") * F.col("c")).alias("s"))  # for a kind, a row for each partition at most
    whole = spans.groupBy("kind").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"))
    by_kind = Window.partitionBy("kind")
    before = F.coalesce(F.sum("n").over(by_kind.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = spans.select("kind", "part", "n", before.alias("below"), F.sum("n").over(by_kind).alias("total"))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.least(F.col("total") - 1, F.floor(F.col("total") * F.lit(p))).alias("rank")) for name, p in ps.items()])).alias("a")
    found = ranked.select("kind", "part", "n", "below", asked).where((F.col("below") <= F.col("a.rank")) & (F.col("a.rank") < F.col("below") + F.col("n"))).select(F.col("kind").alias("of"), F.col("part").alias("at"), "below", "a.name", "a.rank")
    upto = F.sum("c").over(Window.partitionBy("part", "of", "name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("below")
    near = dealt.join(found, dealt["kind"].eqNullSafe(found["of"]) & (dealt["part"] == found["at"])).withColumn("upto", upto).where(F.col("upto") > F.col("rank"))
    picks = near.groupBy("of").agg(*[F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ps])
    return whole.join(picks, whole["kind"].eqNullSafe(picks["of"])).select(F.col("kind").alias(kind), "n", "mean", *ps)


# Operation logs: a row for each operation on a document's field.


def register(value: str | Column, ts: Column, tie: Column) -> Column:
    """The value with the latest time; of equal times the smallest tie (the first entry) wins."""
    return F.max_by(value, F.struct(ts, -tie))


def counter(delta: Column) -> Column:
    """The sum of numeric deltas, 0 without any; what isn't a number is ignored."""
    return F.coalesce(F.sum(delta.try_cast("double")), F.lit(0.0))


def members(item: Column) -> Column:
    """The sorted distinct members."""
    return F.array_sort(F.collect_set(item))


def materialise(ops: DataFrame, fields: dict[str, str], doc: str = "doc") -> DataFrame:
    """A row for each document from its log (doc, field, value, delta, member, ts, pos): each field folded by its kind, in one aggregation."""
    folds = []
    for name, kind in fields.items():
        mine = F.col("field") == name
        if kind in ("register", "prose"):
            folds.append(register(F.when(mine, F.col("value")), F.when(mine, F.col("ts")), F.when(mine, F.col("pos"))).alias(name))
        elif kind == "counter":
            folds.append(counter(F.when(mine, F.col("delta"))).alias(name))
        elif kind == "set":
            folds.append(members(F.when(mine, F.col("member"))).alias(name))
    return ops.groupBy(doc).agg(*folds)


def _text(x: Column, kind: T.DataType) -> Column:
    """A value as an operation holds it: strings as they are, nested values as JSON."""
    if isinstance(kind, T.StringType):
        return x
    return F.to_json(x) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else x.cast("string")


def encode_rows(rows: DataFrame, fields: dict[str, str], doc: str, seq: Column | None = None, prose: bool = True) -> DataFrame:
    """Rows as the log that ``materialise`` folds back: (doc, field, client, value, delta, member, ts, pos), in one pass.

    Registers (and prose, unless left out) have one entry each, null or not; a counter has
    one where it is neither null nor 0; a set has one for each distinct member, a null
    member being the text null. Other kinds have none. The client is ``_init``, the time is seq.
    """
    none = F.lit(None).cast("string")

    def entry(name: str, value: Column = none, delta: Column = none, member: Column = none) -> Column:
        return F.struct(F.lit(name).alias("field"), value.alias("value"), delta.alias("delta"), member.alias("member"))

    def added(name: str, of: T.DataType) -> Callable[[Column], Column]:
        return lambda x: entry(name, member=F.coalesce(_text(x, of), F.lit("null")))

    parts = []
    for name, kind in fields.items():
        c, of = F.col(name), rows.schema[name].dataType
        if kind == "register" or (kind == "prose" and prose):
            parts.append(F.array(entry(name, value=_text(c, of))))
        elif kind == "counter":
            parts.append(F.filter(F.array(entry(name, delta=F.when(c != 0, c.cast("string")))), lambda x: x["delta"].isNotNull()))
        elif kind == "set":
            listed = F.array_distinct(F.coalesce(c, F.array().cast(of)))
            parts.append(F.transform(listed, added(name, of.elementType)))
    stamp = F.lit(0) if seq is None else seq
    log = rows.select(F.col(doc).alias("doc"), stamp.cast("long").alias("ts"), F.explode(F.flatten(F.array(*parts))).alias("e"))
    return log.select("doc", "e.field", F.lit("_init").alias("client"), "e.value", "e.delta", "e.member", "ts", F.lit(0).cast("long").alias("pos"))


def merge_folded(local: DataFrame, folded: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Local documents with the folded fields of those that have a log: its values count, null ones too. Other documents and fields stay."""
    new = folded.select(key, F.struct(*fields).alias("_folded"))
    old = lambda c: F.col(c) if c in local.columns else F.lit(None)
    merged = lambda c: F.when(F.col("_folded").isNotNull(), F.col(f"_folded.{c}")).otherwise(old(c)).alias(c)
    names = [*local.columns, *[c for c in fields if c not in local.columns]]
    return local.join(new, key, "left").select(*[merged(c) if c in fields else F.col(c) for c in names])


def counted_entries(ops: DataFrame, doc: str = "doc", by: tuple[str, ...] = ("value",)) -> DataFrame:
    """A row for each document and distinct value: its entries' number ``n``, ``first`` and ``last`` place and latest ``ts``. ``by`` may name more, as the client."""
    return ops.groupBy(doc, *by).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.max("ts").alias("ts"))


def resolve_registers(ops: DataFrame, resolver: Column | Callable[[pd.DataFrame], object], result: str = "string", doc: str = "doc", by: tuple[str, ...] = ("value",)) -> DataFrame:
    """A register's value by a resolver of one's own over the counted entries of a document.

    A resolver is an aggregate of their columns, which takes any number of them. A function
    gets them as one frame in the order of their first entries, so it is for registers
    whose distinct values fit one; the entries themselves never meet in a frame.
    """
    counted = counted_entries(ops, doc, by)
    if isinstance(resolver, Column):
        return counted.groupBy(doc).agg(resolver.alias("value"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({doc: [key[0]], "value": [resolver(rows.sort_values("first", kind="stable"))]})

    return counted.groupBy(doc).applyInPandas(run, f"{doc} {ops.schema[doc].dataType.simpleString()}, value {result}")


def new_operations(mine: DataFrame, theirs: DataFrame, op_id: str = "op_id") -> DataFrame:
    """Operations of theirs that mine lacks, once each."""
    return theirs.dropDuplicates([op_id]).join(mine.select(op_id), op_id, "left_anti")


def merge_operations(*logs: DataFrame, op_id: str = "op_id") -> DataFrame:
    """The union of logs, each operation once: the order of merging and repeats don't matter."""
    out = logs[0]
    for x in logs[1:]:
        out = out.unionByName(x)
    return out.dropDuplicates([op_id])


def counters(df: DataFrame, attributes: list[str], amount: Column | None = None) -> DataFrame:
    """One total for each set of attributes, null attributes being a value of their own; each row adds 1 or its amount."""
    return df.groupBy(*attributes).agg(F.sum(F.lit(1) if amount is None else amount).alias("total"))


def gauges(df: DataFrame, attributes: list[str], value: str, at: list[str]) -> DataFrame:
    """The newest measure of each set of attributes, by the columns of ``at``; null measures don't count."""
    return df.where(F.col(value).isNotNull()).groupBy(*attributes).agg(F.max_by(value, F.struct(*at)).alias("value"))


def histograms(df: DataFrame, attributes: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Count, sum, least, most and bucket counts of a measure for each set of attributes, in one partial aggregation.

    ``buckets`` counts the values up to and including each bound that are above the one
    before, and last those above all bounds. Null and NaN measures don't count.
    """
    rising = sorted(bounds)
    x = F.col(value)
    edges = [F.lit(True) if low is None else x > low for low in [None, *rising]]
    tops = [F.lit(True) if high is None else x <= high for high in [*rising, None]]
    buckets = F.array(*[F.count_if(a & b) for a, b in zip(edges, tops, strict=True)])
    measured = df.where(x.isNotNull() & ~F.isnan(x.cast("double")))
    return measured.groupBy(*attributes).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("total"), F.min(x).alias("least"), F.max(x).alias("most"), buckets.alias("buckets"))
