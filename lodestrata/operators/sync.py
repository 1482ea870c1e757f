"""What a reader lacks by its state vector, and how a pull's answer joins what it has.

An operation is known by its client and that client's clock. A state vector holds each
client's highest clock for a document; what is beyond it is the difference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.aggregates import materialise, merge_folded

OPERATION = ["doc", "client", "clock"]


def state_vectors(ops: DataFrame) -> DataFrame:
    """doc, client, clock: the highest clock of each client in each document's operations."""
    return ops.groupBy("doc", "client").agg(F.max("clock").alias("clock"))


def beyond(ops: DataFrame, vectors: DataFrame) -> DataFrame:
    """The operations that a reader with these vectors lacks; all of a client or document that it doesn't name."""
    known = vectors.select("doc", "client", F.col("clock").alias("_known"))
    return ops.join(known, ["doc", "client"], "left").where("_known IS NULL OR clock > _known").drop("_known")


def merged(*logs: DataFrame) -> DataFrame:
    """Logs as one, each operation once."""
    out = logs[0]
    for x in logs[1:]:
        out = out.unionByName(x)
    return out.dropDuplicates(OPERATION)


def answer_actions(local: DataFrame, answer: DataFrame, key: str = "doc") -> DataFrame:
    """key, action, seq for every document that either side has, in one join.

    answer: key, deleted, has_document, has_diff, seq. A deleted document goes ('delete');
    of one that is there a difference is applied ('diff'), and without one it stays as it is
    ('keep'), as does one that the answer leaves out; one that isn't there is stored if the answer holds it
    whole ('insert'), and a mere difference to it is dropped. seq is the answer's where it is above the local one, else null.
    """
    a = answer.select(F.col(key).alias("_key"), "deleted", "has_document", "has_diff", F.col("seq").alias("_new"))
    both = local.select(key, "seq").join(a, F.col(key) == F.col("_key"), "full")
    there = F.col(key).isNotNull()
    action = (
        F.when(F.coalesce("deleted", F.lit(False)), "delete").when(there & F.coalesce("has_diff", F.lit(False)), "diff").when(there, "keep")
        .when(F.coalesce("has_document", F.lit(False)), "insert")
    )
    newer = F.when((action != "delete") & (F.col("seq").isNull() | (F.col("_new") > F.col("seq"))), F.col("_new"))
    return both.select(F.coalesce(key, "_key").alias(key), action.alias("action"), newer.alias("seq")).where("action IS NOT NULL")


def apply_answer(local: DataFrame, ops: DataFrame, answer: DataFrame, documents: DataFrame, diff: DataFrame, fields: dict[str, str], full: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, operations) after a pull's answer; applying it again changes nothing.

    local: doc, seq and columns; documents: those of the answer, whole, with the same columns but
    seq; diff: the operations of its differences. fields are folded from operations; the others stay. A
    full answer replaces all that is there by its documents.
    """
    columns = [c for c in local.columns if c not in ("doc", "seq")]
    if full:
        seqs = answer.where("NOT deleted").select("doc", F.col("seq").alias("_new"))
        old = local.select("doc", F.col("seq").alias("_old"))
        out = documents.join(seqs, "doc", "left").join(old, "doc", "left").select("doc", F.coalesce(F.greatest("_new", "_old"), F.lit(-1)).alias("seq"), *columns)
        return out, merged(ops.join(documents.select("doc"), "doc", "left_semi"), diff.join(documents.select("doc"), "doc", "left_semi").select(*ops.columns))
    actions = answer_actions(local, answer)
    does = lambda *names: actions.where(F.col("action").isin(*names)).select("doc", F.col("seq").alias("_new"))
    stays = local.join(does("keep", "diff"), "doc").withColumn("seq", F.coalesce("_new", "seq")).drop("_new")
    fresh = documents.join(does("insert"), "doc").select("doc", F.coalesce(F.col("_new"), F.lit(-1)).alias("seq"), *columns)
    wanted = diff.join(does("diff", "insert"), "doc", "left_semi").select(*ops.columns)
    log = merged(ops.join(does("delete"), "doc", "left_anti"), wanted)
    changed = log.join(does("diff"), "doc", "left_semi")
    folded = materialise(changed, fields)
    return merge_folded(stays, folded, "doc", list(fields)).unionByName(fresh), log
