"""The total order over values, as sort columns.

missing < null < bigint < number < NaN < boolean < string < bytes < array < object. A
column of one type sorts natively with nulls first. A column that mixes types needs an
order key: a struct whose first member is the type's rank. Strings compare by UTF-8
bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions.expr import path_column

# Ranks of types in the total order.
RANKS = {"missing": 0, "null": 1, "bigint": 2, "number": 3, "boolean": 5, "string": 6, "bytes": 7, "array": 8, "object": 9}


def sort_columns(fields: list[str] | tuple[str, ...], descending: bool = False) -> list[Column]:
    """All fields in one direction; null is least, so it comes first or, descending, last."""
    return [path_column(f).desc_nulls_last() if descending else path_column(f).asc_nulls_first() for f in fields]


def order_key(value: Column) -> Column:
    """A sortable key of a VARIANT of scalars: (rank, bigint, number, boolean, string)."""
    kind = F.schema_of_variant(value)
    rank = (
        F.when(value.isNull(), RANKS["missing"]).when(kind == "VOID", RANKS["null"]).when(kind == "BIGINT", RANKS["bigint"])
        .when(kind.rlike("^(DOUBLE|FLOAT|DECIMAL)"), RANKS["number"]).when(kind == "BOOLEAN", RANKS["boolean"]).when(kind == "STRING", RANKS["string"])
        .when(kind == "BINARY", RANKS["bytes"]).when(kind.startswith("ARRAY"), RANKS["array"]).otherwise(RANKS["object"])
    )
    get = lambda t: F.try_variant_get(value, "$", t)
    only = lambda r, x: F.when(rank == r, x)
    return F.struct(rank.alias("rank"), only(2, get("bigint")).alias("i"), only(3, get("double")).alias("d"), only(5, get("boolean")).alias("b"), only(6, get("string")).alias("s"))
