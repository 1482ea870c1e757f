"""What a table declares: its fields, ordering contracts, search and vector settings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

NAME = re.compile(r"(^_(id|creationTime)$)|^[a-zA-Z][a-zA-Z0-9_]*$")
CRDT_KINDS = ("prose", "register", "counter", "set", "plain", "omit")


@dataclass(frozen=True)
class Validator:
    """A value's declared shape. kind: null, number, bigint, boolean, string, bytes, any, literal, id, array, object, record, union."""

    kind: str
    value: object = None  # of a literal
    table: str | None = None  # of an id
    element: Validator | None = None  # of an array or record
    fields: tuple[tuple[str, Validator], ...] = ()  # of an object
    members: tuple[Validator, ...] = ()  # of a union
    optional: bool = False

    def maybe(self) -> Validator:
        return replace(self, optional=True)

    def spark_type(self) -> T.DataType:
        simple = {"number": T.DoubleType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "string": T.StringType(), "bytes": T.BinaryType(), "id": T.StringType(), "null": T.NullType()}
        if self.kind in simple:
            return simple[self.kind]
        if self.kind == "literal":
            return {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType()}.get(type(self.value), T.StringType())
        if self.kind == "array":
            return T.ArrayType(self.element.spark_type())
        if self.kind == "record":
            return T.MapType(T.StringType(), self.element.spark_type())
        if self.kind == "object":
            return T.StructType([T.StructField(k, v.spark_type(), v.nullable) for k, v in self.fields])
        if self.kind == "union":
            kinds = {m.spark_type() for m in self.members if m.kind != "null"}
            return kinds.pop() if len(kinds) == 1 else T.VariantType()
        return T.VariantType()

    @property
    def nullable(self) -> bool:
        return self.optional or self.kind in ("null", "any") or any(m.nullable for m in self.members)


class v:  # noqa: N801 - reads as v.number() in declarations
    """Validators by name."""

    null = staticmethod(lambda: Validator("null"))
    number = staticmethod(lambda: Validator("number"))
    bigint = staticmethod(lambda: Validator("bigint"))
    boolean = staticmethod(lambda: Validator("boolean"))
    string = staticmethod(lambda: Validator("string"))
    bytes = staticmethod(lambda: Validator("bytes"))
    any = staticmethod(lambda: Validator("any"))
    literal = staticmethod(lambda value: Validator("literal", value=value))
    id = staticmethod(lambda table: Validator("id", table=table))
    array = staticmethod(lambda element: Validator("array", element=element))
    record = staticmethod(lambda element: Validator("record", element=element))
    object = staticmethod(lambda **fields: Validator("object", fields=tuple(fields.items())))
    union = staticmethod(lambda *members: Validator("union", members=members))
    optional = staticmethod(lambda x: x.maybe())


@dataclass(frozen=True)
class TableSpec:
    """A table's declaration. An index is a list of fields that scans may be ordered and bounded by; the creation and id columns always follow."""

    name: str
    indexes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    creation: str = "_creationTime"
    id: str = "_id"
    fields: dict[str, Validator] = field(default_factory=dict)
    crdt: dict[str, str] = field(default_factory=dict)  # field: kind
    search: dict[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)  # index: (field, filter fields)
    vectors: dict[str, tuple[str, int, tuple[str, ...]]] = field(default_factory=dict)  # index: (field, dimensions, filter fields)
    identity: str | None = None  # the hidden owner column

    # Declarations read as a chain; each returns a new spec.

    def with_field(self, name: str, validator: Validator, crdt: str = "plain") -> TableSpec:
        if crdt not in CRDT_KINDS:
            raise ValueError(f"unknown field kind {crdt!r}")
        return replace(self, fields={**self.fields, name: validator}, crdt={**self.crdt, name: crdt})

    def index(self, name: str, *fields: str) -> TableSpec:
        if name in ("by_creation_time", "by_id") or name in self.indexes:
            raise ValueError(f"index {name} exists")
        return replace(self, indexes={**self.indexes, name: fields})

    def search_index(self, name: str, search_field: str, *filters: str) -> TableSpec:
        return replace(self, search={**self.search, name: (search_field, filters)})

    def vector_index(self, name: str, vector_field: str, dimensions: int, *filters: str) -> TableSpec:
        return replace(self, vectors={**self.vectors, name: (vector_field, dimensions, filters)})

    def index_fields(self, index: str) -> tuple[str, ...]:
        """An index's whole ordering contract."""
        if index == "by_creation_time":
            return (self.creation, self.id)
        if index == "by_id":
            return (self.id,)
        if index not in self.indexes:
            raise ValueError(f"index {self.name}.{index} not found")
        return (*self.indexes[index], self.creation, self.id)

    def schema(self) -> T.StructType:
        own = [T.StructField(self.id, T.StringType(), False), T.StructField(self.creation, T.DoubleType(), False)]
        return T.StructType(own + [T.StructField(k, x.spark_type(), x.nullable) for k, x in self.fields.items()])

    def checked(self) -> TableSpec:
        """Raises ValueError for declarations that don't hold together."""
        for name in (self.name, *self.fields):
            if not NAME.match(name):
                raise ValueError(f"invalid identifier {name!r}")
        if len(self.vectors) > 4:
            raise ValueError("a table has at most 4 vector indexes")
        known = {*self.fields, self.creation, self.id}
        for index, fields in self.indexes.items():
            if not fields or len(set(fields)) < len(fields):
                raise ValueError(f"index {index} has no fields, or one twice")
            if self.fields and (missing := [f for f in fields if f.split(".")[0] not in known]):
                raise ValueError(f"index {index}: unknown fields {missing}")
        for index, (_, dimensions, filters) in self.vectors.items():
            if not 2 <= dimensions <= 4096:
                raise ValueError(f"vector index {index}: dimensions must be 2 to 4096")
            if len(filters) > 16:
                raise ValueError(f"vector index {index}: at most 16 filter fields")
        return self
