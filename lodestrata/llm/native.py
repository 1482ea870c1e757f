"""Column helpers for operators that stay in DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Body = Callable[[Column], Column]


def let(value: Column, body: Body) -> Column:
    """body(value) with value computed once, also where body uses it within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def sums_before(lengths: Column, block: int = 256) -> Column:
    """For each length the sum of those before it, in blocks so that long arrays stay far from quadratic work."""

    def inner(blocks: Column) -> Column:
        return let(
            F.transform(blocks, total),
            lambda sums: F.flatten(
                F.transform(blocks, lambda b, k: let(total(F.slice(sums, 1, k)), lambda base: F.transform(b, lambda _, i: base + total(F.slice(b, 1, i)))))
            ),
        )

    blocks = F.transform(F.sequence(F.lit(0), F.size(lengths) - 1, F.lit(block)), lambda s: F.slice(lengths, s + 1, block))
    return F.when(F.size(lengths) == 0, F.array().cast("array<bigint>")).otherwise(let(blocks, inner))
