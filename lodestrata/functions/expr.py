"""Filters as a small expression tree, compiled to Columns with two-valued logic.

Every comparison is true or false. Null, which also stands for a missing field, equals
itself and is less than everything else. Comparisons with a constant keep a shape that
Parquet readers can push down: ``a <=> 3``, ``a > 3``, ``a < 3 OR a IS NULL``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Node:
    op: str
    args: tuple = ()

    def __bool__(self) -> bool:
        raise TypeError("combine filters with and_, or_ and not_")


def field(path: str) -> Node:
    return Node("field", (path,))


def lit(value: object) -> Node:
    return Node("literal", (value,))


def _node(x: object) -> Node:
    return x if isinstance(x, Node) else lit(x)


def _binary(op: str):
    def build(a: object, b: object) -> Node:
        return Node(op, (_node(a), _node(b)))

    build.__name__ = op
    return build


eq, neq, gt, gte, lt, lte = map(_binary, ("eq", "neq", "gt", "gte", "lt", "lte"))
add, sub, mul, div, mod = map(_binary, ("add", "sub", "mul", "div", "mod"))


def and_(*children: Node) -> Node:
    return Node("and", tuple(map(_node, children)))


def or_(*children: Node) -> Node:
    return Node("or", tuple(map(_node, children)))


def not_(child: Node) -> Node:
    return Node("not", (_node(child),))


def path_column(path: str) -> Column:
    """A dotted path as a column; each part is quoted."""
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


def divided(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is an infinity, 0/0 is NaN."""
    zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def remainder(a: Column, b: Column) -> Column:
    """Truncated remainder with the dividend's sign; x % 0 is NaN."""
    return F.when(b == 0, F.lit(float("nan"))).otherwise(a % F.when(b != 0, b))


_ARITHMETIC = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": divided, "mod": remainder}
_BOOLEAN = {"eq", "neq", "gt", "gte", "lt", "lte", "and", "or", "not"}


def _is_null_literal(x: Node) -> bool:
    return x.op == "literal" and x.args[0] is None


def _is_value(x: Node) -> bool:
    return x.op == "literal" and x.args[0] is not None


def _greater(a: Column, b: Column, x: Node, y: Node, equal: bool) -> Column:
    """a > b, or a >= b, null being least."""
    plain = a >= b if equal else a > b
    if _is_null_literal(y):
        return F.lit(True) if equal else a.isNotNull()
    if _is_value(y):
        return F.coalesce(plain, F.lit(False)) if not _is_plain(x) else plain & a.isNotNull()
    if _is_null_literal(x):
        return b.isNull() if equal else F.lit(False)
    if _is_value(x):
        return plain | b.isNull()
    return F.coalesce(plain, F.when(b.isNull(), F.lit(True) if equal else a.isNotNull()).otherwise(F.lit(False)))


def _is_plain(x: Node) -> bool:
    return x.op == "field"


def compare(op: str, a: Column, b: Column, x: Node, y: Node) -> Column:
    if op == "eq":
        return a.isNull() if _is_null_literal(y) else a.eqNullSafe(b)
    if op == "neq":
        return a.isNotNull() if _is_null_literal(y) else ~a.eqNullSafe(b)
    if op in ("gt", "gte"):
        return _greater(a, b, x, y, op == "gte")
    return _greater(b, a, y, x, op == "lte")


def compile_node(x: Node) -> Column:
    """The node's value as a Column."""
    if x.op == "field":
        return path_column(x.args[0])
    if x.op == "literal":
        return F.lit(x.args[0])
    if x.op in ("and", "or"):
        unit = F.lit(x.op == "and")
        parts = [as_true(c) for c in x.args]
        return reduce((lambda a, b: a & b) if x.op == "and" else (lambda a, b: a | b), parts) if parts else unit
    if x.op == "not":
        return ~as_true(x.args[0])
    if x.op in _ARITHMETIC:
        a, b = (compile_node(c).cast("double") for c in x.args)
        return _ARITHMETIC[x.op](a, b)
    if x.op in _BOOLEAN:
        return compare(x.op, *map(compile_node, x.args), *x.args)
    raise NotImplementedError(f"operator {x.op} is not implemented")


def as_true(x: Node) -> Column:
    """Whether a child of and, or, not is exactly true; numbers, strings and null are not."""
    if x.op in _BOOLEAN:
        return compile_node(x)
    if x.op == "literal":
        return F.lit(x.args[0] is True)
    if x.op == "field":
        return F.coalesce(_exact_true(compile_node(x)), F.lit(False))
    return F.lit(False)


def _exact_true(c: Column) -> Column:
    return F.when(F.typeof(c) == "boolean", c.cast("string") == "true").otherwise(F.lit(False))


def truthy(x: Node, kind: T.DataType | None = None) -> Column:
    """The top level's rule: a bare value passes unless it is null, false, 0, NaN or the empty string."""
    if x.op in _BOOLEAN:
        return compile_node(x)
    c = compile_node(x)
    if kind is None and x.op in _ARITHMETIC:
        kind = T.DoubleType()
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(kind, T.StringType):
        return F.coalesce(c != "", F.lit(False))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce((c != 0) & ~F.isnan(c), F.lit(False))
    if isinstance(kind, T.NumericType):
        return F.coalesce(c != 0, F.lit(False))
    if x.op == "literal":
        return F.lit(bool(x.args[0]) and x.args[0] == x.args[0])
    return c.isNotNull()


def paths(x: Node) -> set[str]:
    """Every field path below the node."""
    if x.op == "field":
        return {x.args[0]}
    return {p for c in x.args if isinstance(c, Node) for p in paths(c)}


def conjunction(filters: list[Node], schema: T.StructType) -> Column | None:
    """All filters together under the top level's rule."""

    def kind(x: Node) -> T.DataType | None:
        if x.op != "field":
            return None
        at: T.DataType = schema
        for part in x.args[0].split("."):
            if not isinstance(at, T.StructType) or part not in at.names:
                return None
            at = at[part].dataType
        return at

    parts = [truthy(x, kind(x)) for x in filters]
    return reduce(lambda a, b: a & b, parts) if parts else None
