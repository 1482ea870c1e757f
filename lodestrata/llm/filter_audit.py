"""Filter interaction audit: what five filters remove in each of their 120 orders, evaluated in long form with windows.

A document fails filter A with under 200 words, B where under half of its words are
distinct, C where over 2 % of its code points are capitals A-Z, D if it holds one of
``[#$%&*|]``, and E if its text is identical to that of a smaller doc_id anywhere in the
table, removed or not. Words lie between ASCII white space and keep their case.

1. A task makes a bit mask of A to D, and a SHA-256 digest of the text, for each
   document; texts go no further. E compares a document's id with the smallest of its
   digest; only digests that stand more than once are joined back, from a written table,
   so a hot digest's documents can be split.
2. Documents are counted in mask cells (part, mask), at most 32 a part.
3. Each cell is unpivoted against the 600 steps of all orders. A running bit-or over an
   order's earlier filters tells whether the cell was removed earlier; conditional sums
   of the cells give a step's counts, and a filter-window total over all orders its
   Shapley sum. Cells are partitioned by (part, mask) once; the windows reuse that.

Null texts count as empty ones (which fail A only, and E behind the first), texts are
read whole, repeated rows count as often as they stand and don't fail E for each other,
a null doc_id fails E for none and has no labels, a null source is the part '' (with
the empty one), other columns are ignored, and an empty table gives an empty result. A
document is good or toxic if any of its label rows says so; null labels say nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import Scratch, narrowed, slices, text_bytes

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT = 200, 50, 2
BIT = {letter: 1 << k for k, letter in enumerate(FILTERS)}

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_SYMBOL = re.compile(rb"[#$%&*|]")
_CONTINUED = bytes(range(0x80, 0xC0))


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text in UTF-8 fails."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text) if text.isascii() else len(text.translate(None, _CONTINUED))
    return (
        BIT["A"] * (len(words) < MIN_WORDS)
        | BIT["B"] * (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words))
        | BIT["C"] * (100 * capitals > MAX_CAPITALS_PERCENT * points)
        | BIT["D"] * (_SYMBOL.search(text) is not None)
    )


def masked(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest, mask of each document, with the bits of A to D."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole)):
            texts = text_bytes(b.column("text"))
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), digests, pa.array([text_mask(t) for t in texts], pa.int32())], names=["doc_id", "part", "digest", "mask"])

    rows = narrowed(docs, "doc_id", "source", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    return rows.mapInArrow(run, "doc_id long, part string, digest binary, mask int")


def mask_cells(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """part, mask, n, good, toxic: the documents of each part that fail just the filters of mask."""
    rows = scratch.written(masked(docs), "audit-masks")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    rows = rows.join(scratch.written(first, "audit-copies"), "digest", "left")
    says = lambda c: F.max(F.coalesce(F.col(f"`{c}`") == 1, F.lit(False)).cast("int"))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    rows = rows.select("doc_id", "part", F.col("mask").bitwiseOR(F.when(F.col("doc_id") > F.col("first"), BIT["E"]).otherwise(0)).alias("mask"))
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long")).alias(c)
    return rows.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("good"), total("toxic"))


def order_steps() -> list[tuple[str, int, int]]:
    """filter_order, step from 1, bit of its filter: 600 rows."""
    return [("".join(order), k + 1, BIT[letter]) for order in permutations(FILTERS) for k, letter in enumerate(order)]


def audit_cells(cells: DataFrame) -> DataFrame:
    """The audit of mask cells (part, mask, n, good, toxic): a row for each part, order and step."""
    steps = F.array(*[F.struct(F.lit(order).alias("filter_order"), F.lit(step).alias("step"), F.lit(bit).alias("bit")) for order, step, bit in order_steps()])
    long_form = cells.withColumn("at", F.explode(steps)).select("part", "mask", "n", "good", "toxic", "at.filter_order", "at.step", "at.bit")
    earlier = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.bit_or("bit").over(earlier), F.lit(0)).bitwiseAND(F.col("mask")) != 0
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    told = long_form.select("part", "mask", "n", "good", "toxic", "filter_order", "step", "bit", before.alias("before"), fails.alias("fails"))
    where = lambda condition, value="n": F.sum(F.when(condition, F.col(value)).otherwise(F.lit(0).cast("long")))
    removed = F.col("fails") & ~F.col("before")
    steps_of = told.groupBy("part", "filter_order", "step", "bit").agg(
        where(~F.col("fails") & ~F.col("before")).alias("kept"),
        where(removed).alias("removed"),
        where(F.col("fails") & F.col("before")).alias("redundant"),
        where(F.col("mask") == F.col("bit")).alias("unique_fails"),
        where(removed, "good").alias("good_lost"),
        where(removed, "toxic").alias("toxic_lost"),
    )
    every_order = Window.partitionBy("part", "bit")
    return steps_of.withColumn("shapley", F.sum("removed").over(every_order)).drop("bit")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    with Scratch(docs.sparkSession) as scratch:
        cells = scratch.written(mask_cells(docs, labels, scratch), "audit-cells")
        scratch.keep(cells)
    return audit_cells(cells)
