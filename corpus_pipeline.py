"""A corpus pipeline: toxic documents go, one of each group of near copies stays, benchmark leaks go, personal data is masked, and what is left is packed.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet
and read again as the next stage's docs. All but the last keep the columns of
``documents``, with extra columns of any name. Null texts are kept and packed as empty
ones, repeated rows are near copies of each other (rows without words aren't), ties go
to the smallest doc_id, very long texts are read whole, and from an empty table nothing
comes out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import decontaminate, jaccard, packing, pii, toxicity
from lodestrata.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labels of documents still here, finds toxic go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays."""
    return jaccard.one_of_each(docs).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind; n_chars follows where it was known."""
    text = pii.masked(F.col("text"))
    changed = docs.withColumn("text", text)
    return changed.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))).select(*docs.columns) if "n_chars" in docs.columns else changed


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pii", mask_pii),
    ("packing", pack),
]

#: SQL can't express the classifier, the alignment and the packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; each stage's table is deleted once the next one is written, but for the last, which the result reads."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            before, docs = docs, scratch.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            scratch.drop(before)
        scratch.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
