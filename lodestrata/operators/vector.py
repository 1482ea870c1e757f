"""Exact vector search: cosine similarity of unit vectors in 32-bit floats, summed in 64 bits.

Rows whose vector is null, of another length or with a null or NaN element aren't in
the index. A zero vector stays zero and scores 0. Order: score descending, id.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.expr import Node, and_, as_true, eq, field, lit, or_
from lodestrata.sources.tables import Segments
from lodestrata.types import TableSpec

MOST, DEFAULT = 256, 10
MOST_CLAUSES = 64


@dataclass(frozen=True)
class VectorPlan:
    field: str
    vector: tuple[float, ...]
    limit: int
    condition: Node | None


def _clauses(x: Node) -> list[Node]:
    if x.op == "or":
        return [c for child in x.args for c in _clauses(child)]
    return [x]


def plan_vector(spec: TableSpec, index: str, vector: list[float], limit: int = DEFAULT, condition: Node | None = None) -> VectorPlan:
    """Checks the arguments; a filter is an equality of a declared field and a constant, or any of several."""
    if index not in spec.vectors:
        raise ValueError(f"vector index {spec.name}.{index} not found")
    name, dimensions, filters = spec.vectors[index]
    if len(vector) != dimensions:
        raise ValueError(f"{index} has {dimensions} dimensions, the query {len(vector)}")
    if not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in vector):
        raise ValueError("a vector holds numbers only")
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= MOST:
        raise ValueError(f"limit must be a whole number from 1 to {MOST}")
    listed = _clauses(condition) if condition is not None else []
    if len(listed) > MOST_CLAUSES:
        raise ValueError(f"at most {MOST_CLAUSES} filter clauses")
    for c in listed:
        ops = sorted(a.op for a in c.args) if c.op == "eq" else []
        if ops != ["field", "literal"]:
            raise ValueError("vector filters are eq(field, constant) and or_")
        used = next(a.args[0] for a in c.args if a.op == "field")
        if used not in filters:
            raise ValueError(f"{used} is not a filter field of {index}")
    return VectorPlan(name, tuple(map(float, vector)), limit, condition)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(vector: Column) -> Column:
    """Scaled to length 1, in floats; a zero vector as it is."""
    floats = vector.cast("array<float>")
    scaled = F.transform(F.array(norm(floats)), lambda n: F.transform(floats, lambda x: F.when(n == 0, x).otherwise((x.cast("double") / n).cast("float"))))
    return F.element_at(scaled, 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def indexable(vector: Column, dimensions: int) -> Column:
    return vector.isNotNull() & (F.size(vector) == dimensions) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))


def vector_search(df: DataFrame, plan: VectorPlan, id_column: str, visible: Column | None = None, digits: int | None = None) -> DataFrame:
    """The nearest rows with ``_score``: one scan, a score for each row, and the top of each partition."""
    v = F.col(plan.field)
    rows = df.where(indexable(v, len(plan.vector)))
    if plan.condition is not None:
        rows = rows.where(as_true(plan.condition))
    if visible is not None:
        rows = rows.where(visible)
    return _ranked(rows, unit(v), plan, id_column, digits)


def _ranked(rows: DataFrame, units: Column, plan: VectorPlan, id_column: str, digits: int | None) -> DataFrame:
    score = dot(units, unit(F.array(*[F.lit(x).cast("float") for x in plan.vector])))
    scored = rows.withColumn("_score", score if digits is None else F.round(score, digits))
    return scored.orderBy(F.col("_score").desc(), F.col(id_column).asc()).limit(plan.limit)


class VectorIndex(Segments):
    """A stored index of unit vectors with the filter fields beside them.

    ``add`` writes new and changed rows, ``remove`` the ids of rows that go; a row counts
    as its newest segment has it. A row whose vector isn't indexable is kept without one,
    so that it hides the vector it had before. ``compact`` writes all live rows as one segment.
    """

    def __init__(self, spark: SparkSession, path: str, spec: TableSpec, index: str):
        super().__init__(spark, path)
        self.spec, self.index = spec, index
        self.field, self.dimensions, self.filters = spec.vectors[index]

    def _write(self, rows: DataFrame) -> VectorIndex:
        self.append(rows.select(self.spec.id, *self.filters, self.field))
        return self

    def add(self, df: DataFrame) -> VectorIndex:
        v = F.col(self.field)
        return self._write(df.withColumn(self.field, F.when(indexable(v, self.dimensions), unit(v))))

    def remove(self, ids: DataFrame) -> VectorIndex:
        """Ids that go; of an index without rows nothing does."""
        if not self.segments():
            return self
        have = self.rows().schema
        return self._write(ids.select(self.spec.id, *[F.lit(None).cast(have[c].dataType).alias(c) for c in (*self.filters, self.field)]))

    def live(self, condition: Column | None = None) -> DataFrame:
        """Id, filter fields and unit vector of the rows that count. The newest segment of each id is found from ids alone."""
        rows = self.rows(condition)
        if len(self.segments()) > 1:
            newest = self.rows().groupBy(self.spec.id).agg(F.max("segment").alias("segment"))
            rows = rows.join(newest, [self.spec.id, "segment"])
        return rows.drop("segment").where(F.col(self.field).isNotNull())

    def search(self, vector: list[float], limit: int = DEFAULT, condition: Node | None = None, digits: int | None = None) -> DataFrame:
        """The nearest live rows with ``_score``."""
        plan = plan_vector(self.spec, self.index, vector, limit, condition)
        return _ranked(self.live(None if condition is None else as_true(condition)), F.col(self.field), plan, self.spec.id, digits)

    def compact(self) -> VectorIndex:
        """All live rows as a new folder's only segment."""
        return VectorIndex(self.spark, f"{self.path}-{uuid.uuid4().hex}", self.spec, self.index)._write(self.live())


any_of = or_
__all__ = ["VectorIndex", "VectorPlan", "and_", "any_of", "dot", "eq", "field", "indexable", "lit", "norm", "plan_vector", "unit", "vector_search"]
