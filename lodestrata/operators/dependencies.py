"""What queries depend on, as rows, and which changes touch them.

A dependency is the range of one index (equalities on a prefix of its fields, then a
lower and an upper bound on the next one), one document, or a whole table: a scan, a
text search or a vector search, whose results any change may alter. Index ranges become
intervals of bytes: ``sort_key`` of the fields one behind the other, so bounds on several
fields, with open ends and of any type are one interval [lo, hi).

Changes and intervals meet by rank, not by value. All interval ends are numbered in one
pass over range partitions, and each changed key gets the number of the last end that
isn't above it; that makes every type a whole number, however the values are
spread. An interval is then kept in the one or two bins that it touches of the bins at
least as wide as itself; a change looks up its bin of each width in use, one for each
power of two at most. Nothing is collected but those widths and the sizes of partitions.
A few intervals, which are counted first, need no ranks: they go to every task, and no
change is shuffled, however many changes have the same key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestrata.functions.canonical import BEYOND, key_bytes, sort_key
from lodestrata.functions.expr import path_column
from lodestrata.plans.query import Bound, Dependency
from lodestrata.sources.tables import shared_folder

#: A dependency's row. space names the table and the fields of an interval; lo is inside it, hi isn't.
ROW = "sub long, tbl string, kind string, id string, space string, lo binary, hi binary"
WHOLE = ("scan", "search", "vector")
#: So many intervals are held against every key; where there are more, ranks find them.
FEW = 200


@dataclass(frozen=True)
class Watched:
    """The fields whose joined keys ranges of a table bound: equalities come first, the bounded field last."""

    table: str
    fields: tuple[str, ...]

    @property
    def space(self) -> str:
        return f"{self.table}\x1f" + "\x1f".join(self.fields)

    def key(self, row: str, kinds: dict[str, T.DataType]) -> Column:
        """The joined key of a row in a struct column; null where there is no row."""
        parts = [sort_key(path_column(f"{row}.{f}"), kinds[f]) for f in self.fields]
        return F.when(F.col(row).isNotNull(), F.concat(*parts))


#: No bound at this end.
OPEN = object()


def interval(equal: list[Column], lower: object = OPEN, upper: object = OPEN, above: bool = False, below: bool = False) -> tuple[Column, Column]:
    """lo and hi of a range from keys: equalities, then bounds on the next field, which above or below leave out themselves."""
    start = F.concat(*equal) if equal else F.lit(b"")
    after = lambda key: F.concat(start, key, F.lit(BEYOND))  # noqa: E731  behind that key, before the next one
    lo = start if lower is OPEN else after(lower) if above else F.concat(start, lower)
    hi = F.concat(start, F.lit(BEYOND)) if upper is OPEN else F.concat(start, upper) if below else after(upper)
    return lo, hi


def watched_of(bounds: tuple[Bound, ...], table: str) -> Watched:
    return Watched(table, tuple(dict.fromkeys(b.field for b in bounds)))


def dependency_rows(spark: SparkSession, dependencies: list[tuple[int, Dependency]]) -> DataFrame:
    """Dependencies of built queries as rows, for a reader's own list of them; large sets of subscriptions are tables from the start."""
    rows = []
    for sub, d in dependencies:
        if d.kind == "range":
            prefix = b"".join(key_bytes(b.value) for b in d.bounds if b.op == "eq")
            lo, hi = prefix, prefix + BEYOND
            for b in d.bounds:
                key = prefix + (b"" if b.op == "eq" else key_bytes(b.value))
                if b.op in ("gt", "gte"):
                    lo = key + (BEYOND if b.op == "gt" else b"")
                elif b.op in ("lt", "lte"):
                    hi = key + (BEYOND if b.op == "lte" else b"")
            rows.append((sub, d.table, "range", None, watched_of(d.bounds, d.table).space, lo, hi))
        else:
            rows.append((sub, d.table, d.kind, None if d.id is None else str(d.id), None, None, None))
    return spark.createDataFrame(rows, ROW)


def changed_keys(changes: DataFrame, table: str, watched: list[Watched], kinds: dict[str, T.DataType], before: str = "before", after: str = "after") -> DataFrame:
    """change, space, key_before, key_after of one table's changes (change, and the row before and after), for each set of fields in use."""
    parts = [F.struct(F.lit(w.space).alias("space"), w.key(before, kinds).alias("key_before"), w.key(after, kinds).alias("key_after")) for w in watched if w.table == table]
    if not parts:
        raise ValueError(f"nothing is watched in {table}")
    return changes.select("change", F.explode(F.array(*parts)).alias("k")).select("change", "k.*")


def positions(ends: DataFrame, probes: DataFrame, partitions: int | None = None) -> DataFrame:
    """space, key, end, pos of distinct ends and probes (space, key): how many ends are not above the key, over all spaces in order, and whether the key is one."""
    spark = ends.sparkSession
    marked = ends.select("space", "key", F.lit(1).alias("end")).unionByName(probes.select("space", "key", F.lit(0).alias("end"))).groupBy("space", "key").agg(F.max("end").alias("end"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_folder(spark, "ends")
    marked.repartitionByRange(n, "space", "key").withColumn("part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    sizes = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.sum("end").alias("n")).collect()}
    before, total = [], 0
    for k in range(n):
        before.append(total)
        total += sizes.get(k, 0)
    running = F.sum("end").over(Window.partitionBy("part").orderBy("space", "key").rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("pos", running + F.get(F.array(*[F.lit(b).cast("long") for b in before]), F.col("part"))).select("space", "key", "end", "pos")


def touched_intervals(keys: DataFrame, intervals: DataFrame, few: int = FEW) -> DataFrame:
    """Pairs change, sub, once each: changes (change, space, key_before, key_after) of which either key lies in an interval (sub, space, lo, hi)."""
    real = intervals.where("lo < hi").select("sub", "space", "lo", "hi")
    if real.limit(few + 1).count() <= few:
        holds = lambda c: F.coalesce((F.col(c) >= F.col("lo")) & (F.col(c) < F.col("hi")), F.lit(False))
        return keys.join(F.broadcast(real), "space").where(holds("key_before") | holds("key_after")).select("change", "sub")
    ends = real.select("space", F.explode(F.array("lo", "hi")).alias("key"))
    sides = keys.select("space", F.explode(F.array("key_before", "key_after")).alias("key")).where("key IS NOT NULL")
    at = positions(ends, sides)
    of = lambda name, pos: at.select("space", F.col("key").alias(name), F.col("pos").alias(pos))
    # An interval holds the positions a to b.
    placed = real.join(of("lo", "a"), ["space", "lo"]).join(of("hi", "b"), ["space", "hi"]).select("sub", "a", (F.col("b") - 1).alias("b"))
    widths = placed.withColumn("level", F.ceil(F.log2((F.col("b") - F.col("a") + 1).cast("double"))).cast("int"))
    levels = [r["level"] for r in widths.select("level").distinct().collect()]  # 64 at most
    kept = widths.withColumn("bin", F.explode(F.array_distinct(F.array(*[F.call_function("shiftright", F.col(c), F.col("level")) for c in ("a", "b")]))))
    moved = keys.join(of("key_before", "pb"), ["space", "key_before"], "left").join(of("key_after", "pa"), ["space", "key_after"], "left").select("change", "pb", "pa")
    probes = moved.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    bin_of = lambda c: F.call_function("shiftright", F.col(c), F.col("level"))
    probes = probes.withColumn("bin", F.explode(F.filter(F.array_distinct(F.array(bin_of("pb"), bin_of("pa"))), lambda x: x.isNotNull())))
    inside = lambda c: F.coalesce(F.col(c).between(F.col("a"), F.col("b")), F.lit(False))
    # Where both keys lie inside but in different bins, the bin of the key before counts.
    once = (inside("pb") & (F.col("bin") == bin_of("pb"))) | (inside("pa") & ~inside("pb") & (F.col("bin") == bin_of("pa")))
    return probes.join(kept, ["level", "bin"]).where(once).select("change", "sub")


def touched(changes: DataFrame, keys: DataFrame | None, dependencies: DataFrame) -> DataFrame:
    """Pairs change, sub, once each, of changes (change, tbl, id_before, id_after) and dependencies (ROW).

    keys: ``changed_keys`` of the same changes. A change with neither row says only that
    its table changed, and touches all that depends on it.
    """
    nothing = F.col("id_before").isNull() & F.col("id_after").isNull()
    blind = changes.where(nothing).select("change", "tbl").join(dependencies.select("sub", "tbl"), "tbl").select("change", "sub")
    seen = changes.where(~nothing)
    whole = seen.select("change", "tbl").join(dependencies.where(F.col("kind").isin(*WHOLE)).select("sub", "tbl"), "tbl").select("change", "sub")
    ids = F.explode(F.array_distinct(F.filter(F.array("id_before", "id_after"), lambda x: x.isNotNull())))
    points = seen.select("change", "tbl", ids.alias("id")).join(dependencies.where("kind = 'point'").select("sub", "tbl", "id"), ["tbl", "id"]).select("change", "sub")
    out = blind.unionByName(whole).unionByName(points)
    return out if keys is None else out.unionByName(touched_intervals(keys, dependencies.where("kind = 'range'")))


def fired(changes: DataFrame, keys: DataFrame | None, dependencies: DataFrame) -> DataFrame:
    """sub of the dependencies that any change touches, without making pairs: what is to run again.

    An interval is touched if fewer changed keys lie below its lower end than below its
    upper one, so numbering the changed keys is all that ranges need.
    """
    nothing = F.col("id_before").isNull() & F.col("id_after").isNull()
    blind, seen = changes.where(nothing).select("tbl").distinct(), changes.where(~nothing)
    out = dependencies.join(blind, "tbl", "left_semi").select("sub")
    whole = dependencies.where(F.col("kind").isin(*WHOLE)).join(seen.select("tbl").distinct(), "tbl", "left_semi").select("sub")
    ids = seen.select("tbl", F.explode(F.array("id_before", "id_after")).alias("id")).distinct()
    points = dependencies.where("kind = 'point'").join(ids, ["tbl", "id"], "left_semi").select("sub")
    out = out.unionByName(whole).unionByName(points)
    if keys is not None:
        real = dependencies.where("kind = 'range' AND lo < hi")
        changed = keys.select("space", F.explode(F.array("key_before", "key_after")).alias("key")).where("key IS NOT NULL")
        at = positions(changed, real.select("space", F.explode(F.array("lo", "hi")).alias("key"))).withColumn("below", F.col("pos") - F.col("end"))
        of = lambda name, below: at.select("space", F.col("key").alias(name), F.col("below").alias(below))
        out = out.unionByName(real.join(of("lo", "a"), ["space", "lo"]).join(of("hi", "b"), ["space", "hi"]).where("a < b").select("sub"))
    return out.distinct()
