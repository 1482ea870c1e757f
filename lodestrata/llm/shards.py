"""Sharding by size-tiered compaction under a versioned manifest.

A store is a folder: ``data/`` holds immutable Parquet shards, ``manifest/`` a JSON
file for each version, which lists that version's shards (path, bytes, rows). Only
what the newest manifest lists belongs to the table. A commit writes a whole new
manifest under a hidden name and gives it the next version's number in one step that
fails where that number exists: a hard link on local and mounted file systems, a rename
without overwriting on HDFS. So of two writers one wins and the other starts again from
the newer version, and no reader sees part of a manifest. Stores whose rename isn't
atomic and exclusive, as object stores without such a step, don't qualify. Files of a
failed job are never listed.

Appending writes arrivals as small shards. Compaction sorts shards into tiers by size,
each ``fan_in`` times the one below; where a tier has ``fan_in`` shards or more, they are
merged into files of about ``target_bytes``, without a shuffle. Shards of at least half
the target are left alone, so a byte is rewritten once a tier at most. Superseded files
go after ``vacuum``.

Rows are kept as they come: nulls, empty and very long texts, repeats and any columns.
An empty table commits a version without new shards. All shards have the first
append's schema; another schema is refused.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import defaultdict
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    shards: tuple[Shard, ...]


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, smallest: int = 64 << 10, fan_in: int = 4):
        self.spark, self.path = spark, path.rstrip("/")
        self.target_bytes, self.smallest, self.fan_in = target_bytes, smallest, fan_in
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at("manifest"))

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name if "/" in name and name.startswith(self.path) else f"{self.path}/{name}")

    # Manifests

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("manifest"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest version, or an older one that vacuum hasn't removed; version 0 is the empty store."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return Manifest(0, "", ())
        stream = self._fs.open(self._at(f"manifest/{version:010d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        read = json.loads(text)
        return Manifest(read["version"], read["schema"], tuple(Shard(**s) for s in read["shards"]))

    def _commit(self, base: Manifest, schema: str, shards: tuple[Shard, ...]) -> Manifest:
        new = Manifest(base.version + 1, schema, shards)
        hidden, final = self._at(f"manifest/_{uuid.uuid4().hex}"), self._at(f"manifest/{new.version:010d}.json")
        stream = self._fs.create(hidden, False)
        try:
            stream.write(bytearray(json.dumps(asdict(new)).encode()))
        finally:
            stream.close()
        try:
            self._publish(hidden, final)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {new.version} is there") from e
            raise
        finally:
            self._fs.delete(hidden, False)
        return new

    def _publish(self, hidden, final) -> None:
        """Make a whole file visible under its final name; raises Java's FileAlreadyExists exceptions where that is taken."""
        if self._fs.getUri().getScheme() == "file":
            at = lambda p: self._jvm.java.nio.file.Path.of(self._jvm.java.net.URI.create(self._fs.makeQualified(p).toUri().toString()))
            self._jvm.java.nio.file.Files.createLink(at(final), at(hidden))
        else:
            conf = self.spark.sparkContext._jsc.hadoopConfiguration()
            none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf).rename(hidden, final, none)

    # Shards

    def _listed(self, folder: str) -> list[tuple[str, int]]:
        out, walk = [], self._fs.listFiles(self._at(folder), True)
        while walk.hasNext():
            s = walk.next()
            if s.getPath().getName().startswith("part-"):
                out.append((s.getPath().toString(), s.getLen()))
        return sorted(out)

    def _shards(self, folder: str) -> list[Shard]:
        """The files of a written folder with rows; counting them reads no column."""
        files = self._listed(folder)
        if not files:
            return []
        # The same path is spelt differently by the two; its last two parts name a file within the folder.
        short = lambda p: tuple(p.rsplit("/", 2)[1:])
        counts = self.spark.read.parquet(*[p for p, _ in files]).groupBy(F.col("_metadata.file_path").alias("path")).count().collect()
        rows = {short(r["path"]): r["count"] for r in counts}
        return [Shard(p, n, rows[short(p)]) for p, n in files if short(p) in rows]

    def append(self, arrivals: DataFrame, by: str | None = None) -> Manifest:
        """Add arrivals as small shards in one version; ``by`` names a column whose values are separate arrivals, and isn't stored."""
        folder = f"data/{uuid.uuid4().hex}"
        writer = arrivals.write
        schema = arrivals.schema if by is None else StructType([f for f in arrivals.schema if f.name != by])
        (writer if by is None else writer.partitionBy(by)).parquet(f"{self.path}/{folder}")
        new = self._shards(folder)
        while True:
            base = self.manifest()
            if base.schema and StructType.fromJson(json.loads(base.schema)).simpleString() != schema.simpleString():
                raise ValueError("the store has another schema")
            try:
                return self._commit(base, base.schema or schema.json(), (*base.shards, *new))
            except Conflict:
                continue

    def tier(self, size: int) -> int:
        return 0 if size <= self.smallest else 1 + int(math.log(size / self.smallest, self.fan_in))

    def plan(self, manifest: Manifest) -> list[Shard]:
        """The shards of the lowest tier that has fan_in of them and is worth merging."""
        tiers: dict[int, list[Shard]] = defaultdict(list)
        for s in manifest.shards:
            if 2 * s.bytes < self.target_bytes:
                tiers[self.tier(s.bytes)].append(s)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fan_in), [])

    def compact(self) -> Manifest:
        """Merge until no tier is full. Each merge is a commit; a merge that lost its shards to another writer is dropped."""
        while chosen := self.plan(base := self.manifest()):
            folder = f"data/{uuid.uuid4().hex}"
            files = max(1, round(sum(s.bytes for s in chosen) / self.target_bytes))
            self._read(chosen, base.schema).coalesce(files).write.parquet(f"{self.path}/{folder}")
            merged = self._shards(folder)
            if sum(s.rows for s in merged) != sum(s.rows for s in chosen):
                raise RuntimeError("a merge changed the number of rows")
            while True:
                now = self.manifest()
                if not {*chosen} <= {*now.shards}:
                    break
                try:
                    self._commit(now, now.schema, (*[s for s in now.shards if s not in {*chosen}], *merged))
                    break
                except Conflict:
                    continue
        return base

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete shards that none of the last versions lists, and older manifests; returns the number of files. Not while others write."""
        kept = self.versions()[-keep_versions:]
        listed = {s.path for v in kept for s in self.manifest(v).shards}
        gone = [p for p, _ in self._listed("data") if p not in listed] if self._fs.exists(self._at("data")) else []
        for p in gone:
            self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(p), False)
        for v in self.versions()[:-keep_versions]:
            self._fs.delete(self._at(f"manifest/{v:010d}.json"), False)
        return len(gone)

    def _read(self, shards: list[Shard] | tuple[Shard, ...], schema: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*[s.path for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if not m.schema:
            raise ValueError("the store is empty and has no schema")
        return self._read(m.shards, m.schema) if m.shards else self.spark.createDataFrame([], StructType.fromJson(json.loads(m.schema)))
