"""Tables that many writers change at once: files that never change, listed by versions of one manifest.

A manifest names the files of all tables of a store. It is written under another name
and then made visible by a step that fails where its version exists, so of two
writers of one version one gets ``Conflict`` and goes on from the newer one. Nobody waits,
nothing is lost, and readers see whole versions only.

A table's rows are dealt into hash buckets by some of its key's columns. A commit writes
the changed rows only, as a delta; a bucket whose deltas outgrow its base is folded
into a new base, so in the long run a row is written a few times, however large the
table is. Reading takes clean buckets as they are and shuffles the others only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

#: Marks rows of a delta whose key goes.
DELETED = "_deleted"


class Conflict(RuntimeError):
    """The version is there already, or what a change was made from is no longer so."""


class Manifests:
    """Numbered JSON files in a folder, each made visible at once and never overwritten."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        at = self._at("versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int) -> dict:
        stream = self._fs.open(self._at(f"versions/{version:010d}.json"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def newest(self) -> tuple[int, dict]:
        """The newest version, -1 where there is none, and what it holds."""
        have = self.versions()
        return (have[-1], self.read(have[-1])) if have else (-1, {})

    def publish(self, version: int, content: dict) -> None:
        hidden, final = self._at(f"hidden/{uuid.uuid4().hex}"), self._at(f"versions/{version:010d}.json")
        self._fs.mkdirs(self._at("versions"))
        stream = self._fs.create(hidden, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        try:
            if self._fs.getUri().getScheme() == "file":  # a hard link is the step that fails
                local = lambda p: self._jvm.java.nio.file.Path.of(self._jvm.java.net.URI.create(self._fs.makeQualified(p).toUri().toString()))
                self._jvm.java.nio.file.Files.createLink(local(final), local(hidden))
            else:
                plain = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(hidden, final, plain)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {version} is there") from e
            raise
        finally:
            self._fs.delete(hidden, False)

    def deleted(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def folders(self, name: str) -> list[str]:
        at = self._at(name)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []


@dataclass(frozen=True)
class Table:
    """key: the columns that identify a row; by: those of them that buckets go by, all unless named."""

    key: tuple[str, ...]
    by: tuple[str, ...] = ()
    buckets: int = 32

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(self.by or self.key)), F.lit(self.buckets)).cast("int")


@dataclass
class _Written:
    """A folder of rows by bucket, not yet in a manifest."""

    folder: str
    rows: dict[int, tuple[int, int]]  # by bucket: rows, and how many of them delete
    schema: str


@dataclass
class Store:
    """Tables under one manifest.

    ``fold_share``: a bucket is folded once its deltas hold so many times its base's rows;
    ``most_deltas``: or once there are so many of them.
    """

    spark: SparkSession
    path: str
    tables: dict[str, Table]
    fold_share: float = 0.5
    most_deltas: int = 8
    manifests: Manifests = field(init=False)

    def __post_init__(self) -> None:
        self.manifests = Manifests(self.spark, self.path)

    # Reading

    def _rows(self, schema: StructType, files: list[tuple[str, int]], numbered: bool) -> DataFrame:
        paths = [f"{self.manifests.path}/data/{folder}/_b={b}" for folder, b in files]
        rows = self.spark.read.schema(schema).parquet(*paths)
        if not numbered:
            return rows
        order = {folder: k for k, folder in enumerate(dict.fromkeys(f for f, _ in files))}
        at = F.regexp_extract(F.col("_metadata.file_path"), "/data/([0-9a-f]{32})/", 1)
        return rows.select("*", F.element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), at).alias("_order"))

    def _live(self, name: str, state: dict, buckets: set[int] | None = None) -> DataFrame | None:
        """Live rows of all buckets or some; None for a table that was never written."""
        listed = state.get("tables", {}).get(name)
        if listed is None:
            return None
        schema, table = StructType.fromJson(json.loads(listed["schema"])), self.tables[name]
        columns = [f.name for f in schema if f.name != DELETED]
        chains = {int(b): files for b, files in listed["files"].items() if buckets is None or int(b) in buckets}
        whole = lambda files: len(files) == 1 and files[0][2]
        clean = [(files[0][0], b) for b, files in chains.items() if whole(files)]
        # Folders in the order of their commits: the last one with a key counts.
        place = {f: k for k, f in enumerate(listed["order"])}
        dirty = sorted(((f, b) for b, files in chains.items() if not whole(files) for f, *_ in files), key=lambda x: place[x[0]])
        parts = []
        if clean:
            parts.append(self._rows(schema, clean, False).select(*columns))
        if dirty:
            last = self._rows(schema, dirty, True).groupBy(*table.key).agg(F.max_by(F.struct(DELETED, *[c for c in columns if c not in table.key]), "_order").alias("_r"))
            parts.append(last.where(f"NOT _r.{DELETED}").select(*[F.col(c) if c in table.key else F.col(f"_r.`{c}`").alias(c) for c in columns]))
        if not parts:
            return self.spark.createDataFrame([], schema).select(*columns)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        return self._live(name, self.manifests.newest()[1] if version is None else self.manifests.read(version))

    # Writing

    def _write(self, name: str, rows: DataFrame) -> _Written:
        table, folder = self.tables[name], uuid.uuid4().hex
        shaped = rows if DELETED in rows.columns else rows.withColumn(DELETED, F.lit(False))
        shaped = shaped.withColumn(DELETED, F.coalesce(DELETED, F.lit(False)))
        shaped.withColumn("_b", table.bucket()).repartition(F.col("_b")).write.partitionBy("_b").parquet(f"{self.manifests.path}/data/{folder}")
        counts = {}
        if any(n.startswith("_b=") for n in self.manifests.folders(f"data/{folder}")):
            there = self.spark.read.schema(StructType([StructField(DELETED, BooleanType()), StructField("_b", IntegerType())])).parquet(f"{self.manifests.path}/data/{folder}")
            counts = {r["_b"]: (r["n"], r["gone"]) for r in there.groupBy("_b").agg(F.count(F.lit(1)).alias("n"), F.count_if(DELETED).alias("gone")).collect()}
        return _Written(folder, counts, shaped.schema.json())

    def _listed(self, state: dict, name: str, new: _Written) -> dict:
        """The store's tables with a written delta; where a bucket was empty and nothing is deleted the delta is its base."""
        tables, buckets = dict(state.get("tables", {})), self.tables[name].buckets
        old = tables.get(name, {"schema": new.schema, "buckets": buckets, "files": {}, "order": []})
        if old["buckets"] != buckets:
            raise ValueError(f"table {name} has {old['buckets']} buckets")
        shape = lambda s: StructType.fromJson(json.loads(s)).simpleString()
        if shape(old["schema"]) != shape(new.schema):
            raise ValueError(f"table {name} has other columns")
        files = {b: list(f) for b, f in old["files"].items()}
        for b, (n, gone) in new.rows.items():
            chain = files.setdefault(str(b), [])
            chain.append([new.folder, n, not chain and not gone])
        tables[name] = {**old, "files": files, "order": [*old["order"], new.folder]}
        return tables

    def commit(self, changes: dict[str, DataFrame], writer: str | None = None, batch: int = 0, since: dict[str, dict[int, list]] | None = None) -> bool:
        """Rows to add or replace, and keys to delete (``_deleted``), of several tables at once; one row for a key.

        A batch of a writer that is there already, or one after it, changes nothing, and the answer is False. since
        names what buckets held when the changes were made; where that has changed, Conflict.
        """
        done = lambda state: writer is not None and state.get("applied", {}).get(writer, -1) >= batch
        if done(self.manifests.newest()[1]):
            return False
        new = {name: self._write(name, rows) for name, rows in changes.items()}
        while True:
            version, state = self.manifests.newest()
            if done(state):
                return False
            for name, buckets in (since or {}).items():
                now = state.get("tables", {}).get(name, {}).get("files", {})
                if any(now.get(str(b), []) != files for b, files in buckets.items()):
                    raise Conflict(f"table {name} has changed")
            for name, x in new.items():
                state = {**state, "tables": self._listed(state, name, x)}
            if writer is not None:
                state = {**state, "applied": {**state.get("applied", {}), writer: batch}}
            try:
                self.manifests.publish(version + 1, state)
                break
            except Conflict:
                continue
        for name in new:
            self.fold(name)
        return True

    def update(self, name: str, batch: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame], writer: str | None = None, number: int = 0) -> bool:
        """Changes of one table made from what is there: merge gets the live rows whose ``by`` columns the batch holds, and the batch."""
        return self.change([name], batch, lambda old: {name: merge(old[name], batch)}, writer, number)

    def change(self, names: list[str], batch: DataFrame, make: Callable[[dict[str, DataFrame | None]], dict[str, DataFrame]], writer: str | None = None, number: int = 0) -> bool:
        """One commit of changes to several tables made from what is there. make gets of each table the live rows whose ``by`` columns the batch holds (None for a
        table without any rows yet); the tables have the same ``by`` and buckets. Where another writer changed those buckets meanwhile, it is made again."""
        table = self.tables[names[0]]
        by = list(table.by or table.key)
        if any((list(x.by or x.key), x.buckets) != (by, table.buckets) for x in (self.tables[n] for n in names)):
            raise ValueError("tables that change together go by the same columns")
        touched = {r["b"] for r in batch.select(table.bucket().alias("b")).distinct().collect()}
        asked = batch.select(*[F.col(c).alias(f"_by_{c}") for c in by]).distinct()
        while True:
            state = self.manifests.newest()[1]
            if writer is not None and state.get("applied", {}).get(writer, -1) >= number:
                return False
            old, since = {}, {}
            for name in names:
                files = state.get("tables", {}).get(name, {}).get("files", {})
                since[name] = {b: files.get(str(b), []) for b in touched}
                live = self._live(name, state, touched)
                old[name] = None if live is None else live.join(asked, [live[c].eqNullSafe(asked[f"_by_{c}"]) for c in by], "left_semi")
            try:
                return self.commit(make(old), writer, number, since)
            except Conflict:
                continue

    def fold(self, name: str, every: bool = False) -> int:
        """Fold the buckets that need it (or all with deltas) into new bases; the number of them. A fold whose files another writer folded is dropped."""
        state = self.manifests.newest()[1]
        listed = state["tables"][name]

        def due(files: list) -> bool:
            base, deltas = (files[0][1], files[1:]) if files[0][2] else (0, files)
            return bool(deltas) and (every or len(deltas) > self.most_deltas or sum(n for _, n, _ in deltas) > self.fold_share * base)

        chosen = {int(b): files for b, files in listed["files"].items() if due(files)}
        if not chosen:
            return 0
        new = self._write(name, self._live(name, state, set(chosen)))
        while True:
            version, state = self.manifests.newest()
            listed = state["tables"][name]
            still = {b: f for b, f in chosen.items() if listed["files"].get(str(b), [])[: len(f)] == f}
            if not still:
                return 0
            files = dict(listed["files"])
            for b, f in still.items():
                rest = files[str(b)][len(f) :]
                files[str(b)] = [[new.folder, new.rows[b][0], True], *rest] if b in new.rows else rest
                if not files[str(b)]:
                    del files[str(b)]
            used = {f for chain in files.values() for f, *_ in chain}
            order = [new.folder, *listed["order"]]  # below every delta that is left
            tables = {**state["tables"], name: {**listed, "files": files, "order": [f for f in order if f in used]}}
            try:
                self.manifests.publish(version + 1, {**state, "tables": tables})
                return len(still)
            except Conflict:
                continue

    def vacuum(self, keep: int = 1) -> int:
        """Delete folders that none of the last versions names, and older manifests. Not while others write."""
        have = self.manifests.versions()
        used = {f for v in have[-keep:] for x in self.manifests.read(v).get("tables", {}).values() for chain in x["files"].values() for f, *_ in chain}
        gone = [f for f in self.manifests.folders("data") if f not in used]
        for f in gone:
            self.manifests.deleted(f"data/{f}")
        for v in have[:-keep]:
            self.manifests.deleted(f"versions/{v:010d}.json")
        return len(gone)
