"""Connected components of a table of links, by contraction in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import Scratch


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of links (a, b): nodes that links connect have one root, the same for all.

    Each round every node moves to the smallest node among itself and its neighbours,
    and links follow their ends; links within a node go. With ids in random order, such
    as digests, the number of nodes falls by a constant factor a round. Each round's
    tables are written, so plans stay short and a lost executor costs one round at most;
    only the last round's roots stay.
    """
    with Scratch(links.sparkSession) as scratch:
        links = links.where("a <> b").select("a", "b")
        moved = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().select("node", F.col("node").alias("root"))
        links, moved = scratch.written(links.distinct(), "links"), scratch.written(moved, "roots")
        for _ in range(most_rounds):
            if links.isEmpty():
                scratch.keep(moved)
                return moved
            both = links.union(links.select("b", "a"))
            step = scratch.written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("to")), "steps")
            left, right = step.select(F.col("node").alias("a"), F.col("to").alias("ta")), step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
            fewer = links.join(left, "a").join(right, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
            old, links = links, scratch.written(fewer, "links")
            before, moved = moved, scratch.written(moved.join(step.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
            scratch.drop(old, before, step)
    raise RuntimeError("links are left after the last round")
