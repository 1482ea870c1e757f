"""Tables in storage: reading and writing by declaration, segments of stored indexes, blobs."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources.store import Conflict, Manifests
from lodestrata.types import TableSpec

FORMATS = ("parquet", "json", "orc", "csv")


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder where the session keeps checkpoints, which all executors share; a local session without that setting gets a temporary one.

    It belongs to the driver's process: the file system deletes it when that ends, as results may read it until then.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = Path(tempfile.gettempdir(), "lodestrata-tables").as_uri()
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return f"{path}/data"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``shared_folder`` gave, once no result reads it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at.getParent(), True)


def read_table(spark: SparkSession, path: str, spec: TableSpec | None = None, kind: str = "parquet") -> DataFrame:
    """A table with its declared schema, which spares JSON and CSV a pass to infer one."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    reader = spark.read.format(kind)
    if spec is not None and spec.fields:
        reader = reader.schema(spec.schema())
    return reader.option("header", "true").load(path) if kind == "csv" else reader.load(path)


def write_table(df: DataFrame, path: str, spec: TableSpec | None = None, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """df under its declared schema: columns are ordered and cast, and what doesn't fit raises."""
    if spec is not None and spec.fields:
        df = df.to(spec.schema())
    df.write.format(kind).mode(mode).option("header", "true").save(path)


def decode_json(df: DataFrame, column: str, spec: TableSpec) -> DataFrame:
    """Rows of a table kept as one JSON column, by the declared fields."""
    return df.withColumn("_doc", F.from_json(column, spec.schema())).select(*[c for c in df.columns if c != column], "_doc.*")


class Segments:
    """Numbered segments that are added and never changed, listed by the versions of a manifest: of writers at the same time each gets its own number, in the order of their commits."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Manifests(spark, self.path)

    def _listed(self) -> list[tuple[int, str]]:
        return [tuple(x) for x in self.manifests.newest()[1].get("segments", [])]

    def segments(self) -> list[int]:
        return [n for n, _ in self._listed()]

    def append(self, rows: DataFrame) -> None:
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{folder}")
        while True:
            version, state = self.manifests.newest()
            have = state.get("segments", [])
            try:
                self.manifests.publish(version + 1, {"segments": [*have, [have[-1][0] + 1 if have else 0, folder]]})
                return
            except Conflict:
                continue

    def rows(self, condition: Column | None = None) -> DataFrame:
        """The rows of all segments, each with its ``segment``."""
        parts = [self.spark.read.parquet(f"{self.path}/data/{folder}").where(F.lit(True) if condition is None else condition).withColumn("segment", F.lit(n)) for n, folder in self._listed()]
        if not parts:
            raise ValueError("the index is empty")
        return reduce(DataFrame.unionByName, parts)


def put_blobs(df: DataFrame, content: str) -> DataFrame:
    """Metadata columns for a binary column, and new ids."""
    return df.withColumn("storage_id", F.uuid()).withColumn("size", F.octet_length(content).cast("long")).withColumn("sha256", F.base64(F.unhex(F.sha2(content, 256))))


def delete_blobs(blobs: DataFrame, ids: DataFrame) -> DataFrame:
    return blobs.join(ids.select("storage_id"), "storage_id", "left_anti")
