"""Validators as Columns, schema changes, and versioned migrations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.types import TableSpec, Validator


def problem(validator: Validator, value: Column, kind: T.DataType, path: str) -> Column:
    """A text for what is wrong with the value, null where nothing is. The declared Spark type settles what it can; ids are checked by joins."""
    wrong = lambda what: F.lit(f"{path}: {what}")
    good = F.lit(None).cast("string")
    if validator.kind == "any":
        return good
    if validator.kind == "null":
        return F.when(value.isNotNull(), wrong("expected null"))
    if validator.kind == "union":
        parts = [problem(m, value, kind, path) for m in validator.members]
        passes = reduce(lambda a, b: a | b, [p.isNull() for p in parts], F.lit(False))
        return F.when(~passes, wrong("matches no member of the union"))
    absent = good if validator.optional else wrong("missing required field")
    expected = {"number": (T.DoubleType, T.FloatType), "bigint": (T.LongType, T.IntegerType, T.ShortType), "boolean": (T.BooleanType,), "string": (T.StringType,), "id": (T.StringType, T.LongType, T.IntegerType), "bytes": (T.BinaryType,), "array": (T.ArrayType,), "object": (T.StructType,), "record": (T.MapType,)}
    if validator.kind in expected and not isinstance(kind, expected[validator.kind]):
        return F.when(value.isNull(), absent).otherwise(wrong(f"expected {validator.kind}"))
    inner = good
    if validator.kind == "literal":
        same = value == F.lit(validator.value) if type(validator.value) is not bool or isinstance(kind, T.BooleanType) else F.lit(False)
        inner = F.when(~same, wrong(f"expected {validator.value!r}"))
    elif validator.kind == "array":
        inner = F.get(F.filter(F.transform(value, lambda x: problem(validator.element, x, kind.elementType, f"{path}[]")), lambda p: p.isNotNull()), F.lit(0))
    elif validator.kind == "record":
        inner = F.get(F.filter(F.transform(F.map_values(value), lambda x: problem(validator.element, x, kind.valueType, f"{path}.*")), lambda p: p.isNotNull()), F.lit(0))
    elif validator.kind == "object":
        declared = dict(validator.fields)
        parts = [F.when(value[f.name].isNotNull(), wrong(f"unexpected field {f.name}")) for f in kind.fields if f.name not in declared]
        parts += [problem(x, value[k], kind[k].dataType, f"{path}.{k}") if k in kind.names else (good if x.nullable else wrong(f"missing required field {k}")) for k, x in declared.items()]
        inner = F.coalesce(*parts, good)
    return F.when(value.isNull(), absent).otherwise(inner)


def validated(df: DataFrame, spec: TableSpec) -> DataFrame:
    """df with ``_problem``: the first thing wrong with each row, null for valid rows."""
    hidden = {spec.id, spec.creation, spec.identity}
    parts = [F.when(F.col(c).isNotNull(), F.lit(f"unexpected field {c}")) for c in df.columns if c not in spec.fields and c not in hidden]
    for name, x in spec.fields.items():
        if name in df.columns:
            parts.append(problem(x, F.col(name), df.schema[name].dataType, name))
        elif not x.nullable:
            parts.append(F.lit(f"{name}: missing required field"))
    return df.withColumn("_problem", F.coalesce(*parts, F.lit(None).cast("string")))


def quarantine(df: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows with their problem)."""
    checked = validated(df, spec)
    return checked.where("_problem IS NULL").drop("_problem"), checked.where("_problem IS NOT NULL")


def add_column(df: DataFrame, name: str, kind: str, default: object = None) -> DataFrame:
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    return df.withColumn(name, F.lit(default).cast(kind))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        raise ValueError(f"column {name} does not exist")
    return df.drop(name)


def duplicates(df: DataFrame, fields: list[str]) -> DataFrame:
    """Keys that would break a unique index, with how often they stand."""
    return df.groupBy(*fields).count().where("count > 1")


Step = Callable[[DataFrame], DataFrame]


def migrate(df: DataFrame, stored: int, steps: dict[int, Step], target: int | None = None) -> tuple[DataFrame, int]:
    """Applies the steps after the stored version in order, up to the target; numbers without a step just pass. Never backward."""
    target = max([stored, *steps]) if target is None else target
    if target < stored:
        raise ValueError(f"version {stored} is newer than {target}")
    for n in sorted(steps):
        if stored < n <= target:
            df = steps[n](df)
    return df, target


#: What a recovery may ask for: rows gone and the version at the target; or rows and version as the last whole step left them; or rows of its own.
Recovery = str | Callable[[DataFrame], DataFrame]


def migrate_recovering(df: DataFrame, stored: int, steps: dict[int, Step], on_error: Callable[[Exception, int, int], Recovery], target: int | None = None) -> tuple[DataFrame, int]:
    """``migrate`` step by step, each written before the next begins, so a step that fails on a row leaves those before it in place.

    on_error(error, version, target) then says what is to be done: 'reset', 'keep', 'retry'
    (which both leave the last whole step's rows and version, to be tried again or not at
    the next start), or a function that makes the rows of the target version.
    """
    from lodestrata.sources.tables import shared_folder

    target = max([stored, *steps]) if target is None else target
    if target < stored:
        raise ValueError(f"version {stored} is newer than {target}")
    spark, folder, version = df.sparkSession, shared_folder(df.sparkSession, "migration"), stored
    for n in sorted(k for k in steps if stored < k <= target):
        try:
            after = steps[n](df)
            after.write.parquet(f"{folder}/{n}")
        except Exception as e:  # noqa: BLE001 - whatever a step raises is the caller's to judge
            action = on_error(e, version, target)
            if callable(action):
                return action(df), target
            if action == "reset":
                return df.limit(0), target
            if action in ("keep", "retry"):
                return df, version
            raise ValueError(f"unknown recovery {action!r}") from e
        df, version = spark.read.schema(after.schema).parquet(f"{folder}/{n}"), n
    return df, target


def modify(df: DataFrame, columns: dict[str, Column], drop: Column | None = None, skip: Column | None = None) -> DataFrame:
    """A migration of rows: drop deletes, skip leaves alone, the others get the columns."""
    if drop is not None:
        df = df.where(~F.coalesce(drop, F.lit(False)))
    stay = F.lit(False) if skip is None else F.coalesce(skip, F.lit(False))
    return df.select(*[F.when(stay, F.col(c)).otherwise(columns[c]).alias(c) if c in columns else F.col(c) for c in df.columns])


def stored_versions(versions: DataFrame, key: list[str]) -> DataFrame:
    return versions.groupBy(*key).agg(F.max("version").alias("version"))
