"""What the training-data operators share: reading tables, and a place for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder below the one that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder; on a cluster, whose
    machines don't share their folders, that is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = Path(tempfile.gettempdir(), "lodestrata-shared").as_uri()
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/lodestrata/{tag}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Written tables of one operator's run. On leaving, those that no result reads are deleted, also after a failure."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def written(self, df: DataFrame, tag: str) -> DataFrame:
        """df as a written table in the shared folder, read again: later steps don't depend on the executors that made it."""
        path = shared_dir(self.spark, tag)
        self.paths[path] = None
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables now."""
        for path in [p for p, df in self.paths.items() if any(df is t for t in tables)]:
            removed(self.spark, path)
            del self.paths[path]

    def keep(self, *tables: DataFrame) -> None:
        """These stay, as the operator's result reads them."""
        self.paths = {p: df for p, df in self.paths.items() if not any(df is t for t in tables)}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            removed(self.spark, path)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a written table that stays, for results that read it."""
    with Scratch(df.sparkSession) as scratch:
        out = scratch.written(df, tag)
        scratch.keep(out)
    return out


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def narrowed(docs: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, text as string; extra columns of any name don't reach the operator."""
    return docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in columns])


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in pieces, so that only a piece at a time is turned into Python objects."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
