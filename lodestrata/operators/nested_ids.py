"""Ids inside nested values: where they stand, which of them refer to nothing, their translation, and the rows that they reach.

Where ids stand follows from a table's declaration: a validator tree of objects, arrays,
records and unions is walked once, when the plan is built, into JVM functions over a
VARIANT; no row meets Python. A union is satisfied if one of its members is: by references
that all exist, or by a value of another kind, to which that member has no objection.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.sources.tables import shared_folder
from lodestrata.types import TableSpec, Validator

#: A reference in a row: where it stands, what it names, and which member of which union it belongs to. id is null for a member without references.
REFERENCE = "array<struct<path: string, tbl: string, id: string, choice: string, member: int>>"


def holds_ids(x: Validator) -> bool:
    """Whether any value of that kind may be a reference."""
    inner = [x.element] if x.element else [*x.members, *[f for _, f in x.fields]]
    return x.kind == "id" or any(map(holds_ids, inner))


def _flat(members: tuple[Validator, ...]) -> Iterator[Validator]:
    for m in members:
        yield from _flat(m.members) if m.kind == "union" else [m]


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is worked out once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def references_in(value: Column, x: Validator, path: Column | str = "", choice: Column | None = None, member: int | None = None) -> Column:
    """The references of a VARIANT by its validator, as REFERENCE."""
    none, path = F.array().cast(REFERENCE), F.lit(path) if isinstance(path, str) else path
    if not holds_ids(x):
        return none
    as_list = F.try_variant_get(value, "$", "array<variant>")
    as_map = F.try_variant_get(value, "$", "map<string, variant>")
    step = lambda c: F.concat(path, F.lit("."), c)
    flat = lambda parts: F.coalesce(F.flatten(parts), none)
    if x.kind == "id":
        text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
        one = lambda i: F.struct(path.alias("path"), F.lit(x.table).alias("tbl"), i.alias("id"), (F.lit(None) if choice is None else choice).cast("string").alias("choice"), F.lit(member).cast("int").alias("member"))
        return _once(text, lambda i: F.when(i.isNotNull(), F.array(one(i)).cast(REFERENCE)).otherwise(none))
    if x.kind == "array":
        return flat(F.transform(as_list, lambda e, i: references_in(e, x.element, step(i.cast("string")), choice, member)))
    if x.kind == "record":
        return flat(F.transform(F.map_entries(as_map), lambda e: references_in(e["value"], x.element, step(e["key"]), choice, member)))
    if x.kind == "object":
        parts = lambda m: [references_in(F.element_at(m, F.lit(k)), f, step(F.lit(k)), choice, member) for k, f in x.fields if holds_ids(f)]
        return _once(as_map, lambda m: F.when(m.isNotNull(), F.concat(*parts(m))).otherwise(none))
    members = list(_flat(x.members))
    if not all(map(holds_ids, members)):
        return none  # a member that asks for no reference accepts every value
    if choice is not None:
        raise ValueError("a union of ids may not stand within another one")

    def of_member(v: Column, k: int, m: Validator) -> Column:
        blank = F.array(F.struct(path, F.lit(m.table), F.lit(None).cast("string"), path, F.lit(k))).cast(REFERENCE)
        return _once(references_in(v, m, path, path, k), lambda found: F.when(F.size(found) == 0, blank).otherwise(found))

    def every(v: Column) -> Column:
        return F.when(v.isNotNull() & (F.schema_of_variant(v) != "VOID"), F.concat(*[of_member(v, k, m) for k, m in enumerate(members)])).otherwise(none)

    return _once(value, every)


def row_references(rows: DataFrame, key: str, document: str, spec: TableSpec) -> DataFrame:
    """key, path, tbl, id, choice, member of each reference in the declared fields of a VARIANT document."""
    whole = Validator("object", fields=tuple(spec.fields.items()))
    return rows.select(F.col(key), F.explode(references_in(F.col(document), whole)).alias("r")).select(key, "r.*")


def missing_nested(references: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """key, tbl, id, once each, of references to what known (tbl, id) lacks; a union asks for all of its members' ids, if none of them is satisfied."""
    here = known.select(F.col("tbl").alias("_tbl"), F.col("id").alias("_id")).distinct()
    found = references.join(here, (F.col("tbl") == F.col("_tbl")) & (F.col("id") == F.col("_id")), "left").withColumn("ok", F.col("id").isNull() | F.col("_id").isNotNull()).drop("_tbl", "_id")
    # References are read once and meet by their row, so what follows needs no other shuffle.
    lost = F.collect_set(F.when(~F.col("ok"), F.struct("tbl", "id")))
    members = found.where("choice IS NOT NULL OR NOT ok").repartition(key).groupBy(key, "choice", "member").agg(F.min("ok").alias("whole"), lost.alias("lost"))
    unions = members.groupBy(key, "choice").agg(F.max("whole").alias("any"), F.flatten(F.collect_list("lost")).alias("lost"))
    return unions.where("choice IS NULL OR NOT any").select(key, F.explode("lost").alias("l")).select(key, "l.*").distinct()


# Translation


def is_id_key(name: str, known: frozenset[str] = frozenset()) -> bool:
    """Whether a field of that name holds ids: by its name, or as declared."""
    return name in ("_id", "id") or name.endswith(("Id", "Ids")) or name in known


def _strings(x: Column, kind: T.DataType, allowed: bool, known: frozenset[str]) -> Column | None:
    """All strings of a typed value that may be ids, with repeats; None where there can't be any."""
    if isinstance(kind, T.StringType):
        return F.array(x) if allowed else None
    if isinstance(kind, T.ArrayType):
        inner = _strings(F.lit(""), kind.elementType, allowed, known)
        return None if inner is None else F.flatten(F.transform(x, lambda e: _strings(e, kind.elementType, allowed, known)))
    if isinstance(kind, T.MapType):
        # A record's keys are data, so its strings count where a key is like an id.
        named = F.map_filter(x, lambda k, _: F.lit(True) if _deep(kind.valueType) else _key_column(k, known))
        inner = _strings(F.lit(""), kind.valueType, True, known)
        return None if inner is None else F.flatten(F.transform(F.map_values(named), lambda e: _strings(e, kind.valueType, True, known)))
    if isinstance(kind, T.StructType):
        parts = [s for f in kind.fields if (s := _strings(x[f.name], f.dataType, is_id_key(f.name, known), known)) is not None]
        return F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts])) if parts else None
    return None


def _deep(kind: T.DataType) -> bool:
    """Whether objects within decide by their own keys."""
    return isinstance(kind, (T.StructType, T.MapType)) or (isinstance(kind, T.ArrayType) and _deep(kind.elementType))


def _key_column(k: Column, known: frozenset[str]) -> Column:
    return k.isin("_id", "id", *sorted(known)) | k.endswith("Id") | k.endswith("Ids")


def _rebuilt(x: Column, kind: T.DataType, named: Column, allowed: bool, known: frozenset[str]) -> Column:
    if isinstance(kind, T.StringType):
        return F.coalesce(F.element_at(named, x), x) if allowed else x
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda e: _rebuilt(e, kind.elementType, named, allowed, known))
    if isinstance(kind, T.MapType):
        if _deep(kind.valueType):
            return F.transform_values(x, lambda _, e: _rebuilt(e, kind.valueType, named, False, known))
        return F.transform_values(x, lambda k, e: F.when(_key_column(k, known), _rebuilt(e, kind.valueType, named, True, known)).otherwise(e))
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*[_rebuilt(x[f.name], f.dataType, named, is_id_key(f.name, known), known).alias(f.name) for f in kind.fields]))
    return x


def json_strings(text: str, known: frozenset[str] = frozenset()) -> list[str]:
    """The strings of a JSON value that may be ids; at the top every string may."""

    def walk(x: object, allowed: bool) -> Iterator[str]:
        if isinstance(x, str) and allowed:
            yield x
        elif isinstance(x, list):
            for e in x:
                yield from walk(e, allowed)
        elif isinstance(x, dict):
            for k, e in x.items():
                yield from walk(e, is_id_key(k, known))

    return sorted(set(walk(json.loads(text), True)))


class _Number(str):
    """A number's text."""


def json_translated(text: str, named: dict[str, str], known: frozenset[str] = frozenset()) -> str:
    """A JSON value with its ids translated; numbers keep their text."""

    def walk(x: object, allowed: bool) -> str:
        if isinstance(x, _Number):
            return x
        if isinstance(x, list):
            return "[" + ",".join(walk(e, allowed) for e in x) + "]"
        if isinstance(x, dict):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{walk(e, is_id_key(k, known))}" for k, e in x.items()) + "}"
        return json.dumps(named.get(x, x) if allowed and isinstance(x, str) else x, ensure_ascii=False)

    return walk(json.loads(text, parse_float=_Number, parse_int=_Number), True)


def translate_nested(df: DataFrame, column: str, key: str, id_map: DataFrame, local: str = "local_id", remote: str = "remote_id", known: frozenset[str] = frozenset()) -> DataFrame:
    """df with the ids in a nested column translated, at any depth; unknown strings stay. key is unique.

    Ids are joined to the map once for a row, however often they stand in it; where the map has an id twice the smaller translation counts. Typed columns are
    rebuilt by JVM functions along their schema; a VARIANT as JSON, so it holds no bytes.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, T.VariantType):
        strings = F.pandas_udf(lambda s: s.map(lambda t: [] if t is None else json_strings(t, known)), T.ArrayType(T.StringType()))(F.to_json(F.col(column)))
    else:
        strings = _strings(F.col(column), kind, True, known)
        if strings is None:
            return df
    pairs = df.select(key, F.explode(F.array_distinct(F.array_compact(strings))).alias("_id")).join(id_map.select(F.col(local).alias("_id"), F.col(remote).alias("_to")), "_id")
    named = pairs.groupBy(key, "_id").agg(F.min("_to").alias("_to")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_id", "_to"))).alias("_named"))
    joined = df.join(named, key, "left")
    if isinstance(kind, T.VariantType):

        @F.pandas_udf(T.StringType())
        def swap(texts: pd.Series, maps: pd.Series) -> pd.Series:
            return pd.Series([t if t is None or not m else json_translated(t, dict(m), known) for t, m in zip(texts, maps, strict=True)])

        value = F.parse_json(swap(F.to_json(F.col(column)), F.col("_named")))
    else:
        value = _rebuilt(F.col(column), kind, F.col("_named"), True, known)
    return joined.withColumn(column, F.when(F.col("_named").isNull(), F.col(column)).otherwise(value)).drop("_named").select(*df.columns)


# Reach


def reach(start: DataFrame, tables: dict[str, tuple[DataFrame, str, str, TableSpec]], local: DataFrame, most_rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """All rows that must be fetched for start (tbl, id), and their references.

    tables: name: (rows, key, VARIANT document, declaration). local (tbl, id) is there
    already. Each round looks up only what the round before asked for first, and asks for
    nothing twice, so circles end. Rounds are written tables. Gives (tbl, id) of the rows
    found, and (src_tbl, src, path, tbl, id, choice, member) of what they refer to.
    """
    spark = start.sparkSession
    folder = shared_folder(spark, "reach")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    there = local.select("tbl", "id").distinct()
    asked = written(start.select("tbl", "id").where("id IS NOT NULL").distinct().join(there, ["tbl", "id"], "left_anti"), "asked-0")
    visited, found, edges = asked, [], []
    for k in range(most_rounds):
        parts, rows = [], []
        for name, (df, key, document, spec) in tables.items():
            mine = asked.where(F.col("tbl") == name).select(F.col("id").alias("_id"))
            here = df.join(mine, df[key].cast("string") == mine["_id"], "left_semi").select(F.col(key).cast("string").alias("src"), document)
            rows.append(here.select(F.lit(name).alias("tbl"), F.col("src").alias("id")))
            parts.append(row_references(here, "src", document, spec).withColumn("src_tbl", F.lit(name)))
        found.append(written(reduce(DataFrame.unionByName, rows), f"found-{k}"))
        edges.append(written(reduce(DataFrame.unionByName, parts).select("src_tbl", "src", "path", "tbl", "id", "choice", "member"), f"edges-{k}"))
        new = missing_nested(edges[-1].withColumn("row", F.struct("src_tbl", "src")), there, "row").select("tbl", "id").distinct().join(visited, ["tbl", "id"], "left_anti")
        asked = written(new, f"asked-{k + 1}")
        if asked.isEmpty():
            return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, edges)
        visited = visited.unionByName(asked)
    raise RuntimeError("references are left after the last round")


def accepted(found: DataFrame, edges: DataFrame, local: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Of rows found by ``reach`` those that may be stored: all that they refer to is there or may be stored before them.

    Rows of a circle that nothing outside it satisfies wait for each other, so they stay out, and
    so does what refers to them. Each round accepts the rows that only asked for earlier ones.
    """
    spark = found.sparkSession
    folder = shared_folder(spark, "accepted")
    there, out, left = local.select("tbl", "id").distinct(), None, found.select("tbl", "id").distinct()
    for k in range(most_rounds):
        mine = edges.join(left.select(F.col("tbl").alias("src_tbl"), F.col("id").alias("src")), ["src_tbl", "src"], "left_semi").withColumn("row", F.struct("src_tbl", "src"))
        waits = missing_nested(mine, there, "row").select("row.src_tbl", "row.src").distinct()
        ready = left.join(waits.select(F.col("src_tbl").alias("tbl"), F.col("src").alias("id")), ["tbl", "id"], "left_anti")
        ready.write.parquet(f"{folder}/ready-{k}")
        ready = spark.read.schema("tbl string, id string").parquet(f"{folder}/ready-{k}")
        if ready.isEmpty():
            return ready if out is None else out
        out = ready if out is None else out.unionByName(ready)
        there, left = there.unionByName(ready), left.join(ready, ["tbl", "id"], "left_anti")
    raise RuntimeError("rows are left after the last round")
