"""A query builder over DataFrames: one source, filters, a limit, keyset pages.

The builder keeps a small plan (source, filters, limit), which is checked when it is
built, tells which rows it depends on, and compiles to one DataFrame. There is no
physical index: an index names an ordering and the fields that a range may bound.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lodestrata.functions import expr as E
from lodestrata.functions.ordering import sort_columns
from lodestrata.types import TableSpec


@dataclass(frozen=True)
class Bound:
    """One part of an index range: op is eq, gt, gte, lt or lte."""

    op: str
    field: str
    value: object

    def node(self) -> E.Node:
        return E.Node(self.op, (E.field(self.field), E.lit(self.value)))


def check_range(bounds: tuple[Bound, ...], fields: tuple[str, ...]) -> None:
    """Equalities on a prefix of the fields, then at most one lower and one upper bound on the next field."""
    at, state, open_field = 0, "eq", None
    for b in bounds:
        if b.field not in fields:
            raise ValueError(f"field {b.field} is not in the index")
        if state == "done":
            raise ValueError(f"no bound may follow both bounds of {open_field}")
        if state == "eq":
            if b.field != fields[at]:
                raise ValueError(f"bounds must follow the index's fields: {fields[at]} comes next, not {b.field}")
            if b.op == "eq":
                at += 1
                if at == len(fields):
                    state, open_field = "done", b.field
            else:
                state, open_field = ("lower" if b.op in ("gt", "gte") else "upper"), b.field
        elif b.field != open_field:
            raise ValueError(f"a bound of {open_field} may only be followed by its other bound")
        elif b.op == "eq" or (b.op in ("gt", "gte")) == (state == "lower"):
            raise ValueError(f"{b.field} already has a {state} bound")
        else:
            state = "done"


@dataclass(frozen=True)
class Dependency:
    """What a query has read: kind is scan, range, point, search or vector."""

    kind: str
    table: str
    bounds: tuple[Bound, ...] = ()
    id: object = None


class NotUnique(ValueError):
    """unique() met a second row."""


@dataclass(frozen=True)
class Query:
    df: DataFrame
    spec: TableSpec
    index: str = "by_creation_time"
    bounds: tuple[Bound, ...] = ()
    descending: bool = False
    filters: tuple[E.Node, ...] = ()
    limit: int | None = None

    def with_index(self, name: str, *bounds: Bound) -> Query:
        check_range(bounds, self.spec.index_fields(name))
        return replace(self, index=name, bounds=bounds)

    def order(self, direction: str) -> Query:
        if direction not in ("asc", "desc"):
            raise ValueError("order is asc or desc")
        return replace(self, descending=direction == "desc")

    def filter(self, *nodes: E.Node) -> Query:
        return replace(self, filters=(*self.filters, *nodes))

    def take(self, n: int) -> Query:
        """A limit counts after all filters wherever it stands, and only the first one counts."""
        if n < 0:
            raise ValueError("take needs a number of 0 or more")
        return self if self.limit is not None else replace(self, limit=n)

    # Plans

    @property
    def order_fields(self) -> tuple[str, ...]:
        return self.spec.index_fields(self.index)

    @property
    def order_key(self) -> tuple[str, ...]:
        """The index's fields without the prefix that equalities pin; ends in the id."""
        fields = self.order_fields
        pinned = 0
        for b in self.bounds:
            if b.op != "eq":
                break
            pinned += 1
        key = fields[min(pinned, len(fields) - 1) :]
        return key if key[-1] == self.spec.id else (*key, self.spec.id)

    def dependency(self) -> Dependency:
        return Dependency("range" if self.bounds else "scan", self.spec.name, self.bounds)

    def matching(self) -> DataFrame:
        """The rows in no order and without the limit."""
        condition = E.conjunction([*[b.node() for b in self.bounds], *self.filters], self.df.schema)
        return self.df if condition is None else self.df.where(condition)

    def sort(self) -> list[Column]:
        return sort_columns(self.order_key, self.descending)

    def plan(self) -> DataFrame:
        """The query's rows in order."""
        out = self.matching().orderBy(*self.sort())
        return out if self.limit is None else out.limit(self.limit)

    # Results

    def collect(self) -> list[Row]:
        return self.plan().collect()

    def first(self) -> Row | None:
        rows = self.take(1).collect()
        return rows[0] if rows else None

    def unique(self) -> Row | None:
        """The only row, None without one; NotUnique when there are more."""
        rows = (self if self.limit is not None else self.take(2)).collect()
        if len(rows) > 1:
            raise NotUnique(f"{self.spec.name}: more than one row")
        return rows[0] if rows else None

    def count(self) -> int:
        return self.matching().count() if self.limit is None else self.plan().count()

    def is_empty(self) -> bool:
        return self.matching().isEmpty()


def eq(field: str, value: object) -> Bound:
    return Bound("eq", field, value)


def gt(field: str, value: object) -> Bound:
    return Bound("gt", field, value)


def gte(field: str, value: object) -> Bound:
    return Bound("gte", field, value)


def lt(field: str, value: object) -> Bound:
    return Bound("lt", field, value)


def lte(field: str, value: object) -> Bound:
    return Bound("lte", field, value)


def point_get(df: DataFrame, spec: TableSpec, value: object, identity: object = ...) -> DataFrame:
    """The row with that id, if any; with an identity only where it owns the row."""
    rows = df.where(F.col(spec.id) == F.lit(value))
    if identity is not ... and spec.identity:
        rows = rows.where(F.col(spec.identity).eqNullSafe(F.lit(identity)))
    return rows.limit(1)


def normalize_ids(ids: DataFrame, column: str, table: DataFrame, spec: TableSpec) -> DataFrame:
    """ids with their column ``id``: the id where the table holds it, null for another table's id, for one that isn't there, and for null."""
    known = table.select(F.col(spec.id).alias("_known")).distinct()
    return ids.join(known, F.col(column) == F.col("_known"), "left").withColumn("id", F.col("_known")).drop("_known")


def ordinal(value: Column, order: list[str]) -> Column:
    """A value's place in a list of values, for sorting; values that aren't listed come last."""
    at = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(F.coalesce(at, F.lit(0)) == 0, F.lit(len(order))).otherwise(at - 1)


def probe_tables(tables: dict[str, tuple[DataFrame, str]], value: object) -> DataFrame:
    """The first table, in the given order, that holds the id: a column ``table`` with one row at most."""
    parts = [df.where(F.col(key) == F.lit(value)).select(F.lit(k).alias("rank"), F.lit(name).alias("table")).limit(1) for k, (name, (df, key)) in enumerate(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("rank").limit(1).select("table")


def list_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """All rows of several tables with the table's name; columns that a table lacks are null."""
    out = None
    for name, df in tables.items():
        part = df.withColumn("table", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def pick_index(spec: TableSpec, scope: dict[str, object]) -> str | None:
    """The index whose longest leading prefix the scope's keys cover; the first of equals, None without any."""
    best, most = None, 0
    for name, fields in spec.indexes.items():
        n = 0
        while n < len(fields) and fields[n] in scope:
            n += 1
        if n > most:
            best, most = name, n
    return best


def in_scope(df: DataFrame, scope: dict[str, object]) -> DataFrame:
    """Rows whose fields equal every value of the scope, null equal to null."""
    for path, value in scope.items():
        df = df.where(E.path_column(path).eqNullSafe(F.lit(value)))
    return df
