"""Ids inside rows: translating local ids, canonical rows, the order of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def translate(df: DataFrame, id_map: DataFrame, columns: list[str], local: str = "local_id", remote: str = "remote_id") -> DataFrame:
    """Known ids in the columns are replaced; others stay. One join a column, on the map's key."""
    for c in columns:
        m = id_map.select(F.col(local).alias(f"_l_{c}"), F.col(remote).alias(f"_r_{c}"))
        df = df.join(m, F.col(c) == F.col(f"_l_{c}"), "left").withColumn(c, F.coalesce(f"_r_{c}", c)).drop(f"_l_{c}", f"_r_{c}")
    return df


def translate_arrays(df: DataFrame, id_map: DataFrame, column: str, key: str, local: str = "local_id", remote: str = "remote_id") -> DataFrame:
    """The same within an array column, in place."""
    items = df.select(key, F.posexplode(column).alias("_pos", "_id"))
    named = items.join(id_map.select(F.col(local).alias("_id"), F.col(remote).alias("_to")), "_id", "left")
    back = named.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("_to", "_id").alias("x")))), lambda s: s["x"]).alias("_new"))
    return df.join(back, key, "left").withColumn(column, F.when(F.size(column) > 0, F.col("_new")).otherwise(F.col(column))).drop("_new")


def canonical(df: DataFrame, id_map: DataFrame, key: str, order: list[Column], local: str = "local_id", remote: str = "remote_id") -> DataFrame:
    """Rows under their remote ids, one for each: a row that came under its local alias wins over one under the remote id, then ``order`` decides."""
    m = id_map.select(F.col(local).alias("_l"), F.col(remote).alias("_r"))
    joined = df.join(m, F.col(key) == F.col("_l"), "left").withColumn("_rank", F.when(F.col("_r").isNotNull(), 0).otherwise(1)).withColumn(key, F.coalesce("_r", key))
    return joined.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("_rank", *order))).where("_k = 1").drop("_l", "_r", "_rank", "_k")


def table_order(references: dict[str, set[str]]) -> list[str]:
    """Tables with those they refer to first; in declared order among equals, and as declared where they refer in a circle."""
    out: list[str] = []
    left = {t: {r for r in refs if r in references and r != t} for t, refs in references.items()}
    while left:
        free = [t for t, refs in left.items() if not refs & left.keys()]
        if not free:
            return list(references)
        out += free
        for t in free:
            del left[t]
    return out


def root_tables(references: dict[str, set[str]]) -> list[str]:
    return [t for t, refs in references.items() if not refs - {t}]


def harvested(results: DataFrame, value: str, depth: int = 4) -> DataFrame:
    """Every document within a nested result: the other columns of results, id, creation_time, document.

    ``value`` is a variant column. An object with a string ``_id`` is a document and isn't
    searched further; other objects and arrays are, down to ``depth`` levels. A creation
    time that is missing or no number is 0. Each level is an explode within the row.
    """
    keys = [c for c in results.columns if c != value]
    kind = lambda path: F.schema_of_variant(F.try_variant_get("_v", path, "variant"))
    level, out = results.select(*keys, F.col(value).alias("_v")), None
    for k in range(depth + 1):
        is_document = F.coalesce(kind("$._id") == "STRING", F.lit(False))
        found = level.where(is_document).select(
            *keys, F.variant_get("_v", "$._id", "string").alias("id"),
            F.coalesce(F.when(kind("$._creationTime").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get("_v", "$._creationTime", "double")), F.lit(0.0)).alias("creation_time"),
            F.col("_v").alias("document"),
        )
        out = found if out is None else out.unionByName(found)
        if k < depth:
            inner = level.where(~is_document).lateralJoin(results.sparkSession.tvf.variant_explode(F.col("_v").outer()))
            level = inner.where(F.schema_of_variant("value").rlike("^(ARRAY|OBJECT)")).select(*keys, F.col("value").alias("_v"))
    return out


def changed_documents(documents: DataFrame, previous: DataFrame) -> DataFrame:
    """Of harvested documents those that previous (id, document) lacks or holds with another value; field order doesn't matter. Of several earlier ones with an id the one with the largest JSON counts."""
    before = previous.groupBy("id").agg(F.max(F.to_json("document")).alias("_before"))
    return documents.join(before, "id", "left").where(~F.col("_before").eqNullSafe(F.to_json("document"))).select(*documents.columns)
