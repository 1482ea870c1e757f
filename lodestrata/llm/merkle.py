"""Merkle manifest of a data set: supersteps of messages between the nodes of hash trees, up to the root and down again.

Every document is a leaf. The leaves of a source, in order of doc_id, form a tree in
which each run of up to 16 consecutive nodes becomes one node, until one is left (the
subroot; a lone leaf is one itself). Subroots in order of their sources (null first)
form the top tree in the same way, whose last node is the root of the data set.

The trees are built as in Pregel, on keyed RDDs:

* *Up.* A superstep sends each child's digest to its parent; a parent that has heard
  from all its children, whose number follows from its key, hashes them and is a child in
  the next superstep. The last node of a source is done and waits for the others.
  Messages of neighbours to one parent are put together before the shuffle.
* *Down.* Starting from the root, each superstep sends to each child the path that
  it takes to the root: its place in its run, the digests of its siblings, and its
  parent's path. The nodes above the leaves answer with a row for each leaf.

A node's key is (source's number, leaves of the source, level, place), so messages
spread by key and the largest source is spread over all tasks. Each superstep's nodes
are written to the shared folder; a lost executor costs tasks of one superstep. Where the
leaves stand in their source comes from a range partitioning by (source, doc_id, leaf)
and the counts of its partitions, so no task holds a source.

Rows with one doc_id in one source go by leaf digest; a null doc_id comes first. Null
values are hashed as ``-`` and empty texts as ``0:``, so they differ; texts are hashed
whole; repeated rows are a leaf each; other columns are ignored; an empty table gives
an empty result. Memory: a task holds the unfinished nodes of its partition and, on the
way down, one node with its path (about 0.5 KB a level).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import Scratch, narrowed, slices

#: Children of a node at most.
ARITY = 16
#: Leaves of a task, and nodes of a partition in a superstep, about.
LEAVES_A_TASK, NODES_A_TASK = 100_000, 50_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_digest(values: list[bytes | None]) -> bytes:
    """Digest of a row's values: each ``-`` if null, else its length in bytes, a colon and the value."""
    h = hashlib.sha256()
    for v in values:
        if v is None:
            h.update(b"-")
        else:
            h.update(b"%d:" % len(v))
            h.update(v)
    return h.digest()


def hashed(digests: list[bytes]) -> bytes:
    """Digest of a node: of its children's digests as hex text, left to right."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, source, leaf, other of each row; other is the leaf digest of the row with A-Z lower-cased in its text where tampered holds, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole)):
            columns = [b.column(c).cast(pa.large_binary()).to_pylist() for c in (*FIELDS[1:-1], "text")]
            ids = [None if i is None else b"%d" % i for i in b.column("doc_id").to_pylist()]
            leaf, other = [], []
            for doc_id, source, lang, n_chars, text, changed in zip(ids, *columns, b.column("changed").to_pylist(), strict=True):
                leaf.append(leaf_digest([doc_id, source, lang, n_chars, text]))
                lower = text.lower() if changed and text is not None else text  # bytes: A-Z only
                other.append(leaf_digest([doc_id, source, lang, n_chars, lower]) if changed else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(leaf, pa.binary()), pa.array(other, pa.binary())], names=["doc_id", "source", "leaf", "other"])

    rows = narrowed(docs, *FIELDS)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in FIELDS[1:]], tampered.alias("changed"))
    return rows.mapInArrow(run, "doc_id long, source string, leaf binary, other binary")


def numbered_leaves(rows: DataFrame, tasks: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The leaves with their source's number, its number of leaves and their place in it; and source, number, total of each source."""
    ordered = rows.repartitionByRange(tasks, "source", "doc_id", "leaf").sortWithinPartitions("source", "doc_id", "leaf")
    ordered = scratch.written(ordered.withColumn("at", F.monotonically_increasing_id()), "merkle-ordered")
    part = F.shiftright("at", 33)  # above these bits is the number of the partition
    spans = scratch.written(ordered.groupBy("source", part.alias("part")).agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n")), "merkle-spans")
    sources = spans.groupBy("source").agg(F.min("low").alias("first"), F.sum("n").alias("total")).withColumn("part", F.shiftright("first", 33))
    # Sources are numbered by their first row: within its partition, and behind the sources of the partitions before, of which there are few rows.
    before = sources.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("first"))
    sources = scratch.written(sources.withColumn("k", within).join(before, "part").select("source", (F.col("base") + F.col("k") - 1).cast("long").alias("number"), "total"), "merkle-sources")
    earlier = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = spans.withColumn("start", F.coalesce(earlier, F.lit(0)) - F.col("low"))
    named = scratch.written(placed.alias("p").join(sources.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))).select(F.col("p.source").alias("name"), F.col("p.part").alias("in_part"), "start", "number", "total"), "merkle-starts")
    joined = ordered.join(named, ordered["source"].eqNullSafe(named["name"]) & (part == named["in_part"]))
    return joined.select("number", "total", (F.col("at") + F.col("start")).alias("place"), "doc_id", "leaf", "other"), sources


def children_of(key: tuple[int, int, int, int]) -> int:
    """How many children the node has."""
    _, total, level, place = key
    below = -(-total // ARITY ** (level - 1))
    return min(ARITY, below - ARITY * place)


def height_of(total: int) -> int:
    """Level of the last node over so many leaves; a lone leaf gets one node above it, which passes its digest on."""
    level, n = 1, -(-total // ARITY)
    while n > 1:
        level, n = level + 1, -(-n // ARITY)
    return level


def _spread(key: tuple) -> int:
    return zlib.crc32(b"%d %d %d %d" % key)


def _together(messages: Iterator[tuple]) -> Iterator[tuple]:
    """Messages to the same parent that follow each other as one."""
    for key, run in groupby(messages, lambda m: m[0]):
        yield key, [x for _, x in run]


def _heard(messages: Iterator[tuple]) -> Iterator[tuple]:
    """(key, digest, children) of each node, once it has heard from all its children; children: (slot, digest, payload) by slot."""
    inbox: dict[tuple, list] = {}
    for key, children in messages:
        mine = inbox.setdefault(key, [])
        mine.extend(children)
        if len(mine) == children_of(key):
            mine.sort(key=lambda c: c[0])
            digests = [d for _, d, _ in mine]
            yield key, digests[0] if key[1] == 1 else hashed(digests), mine
            del inbox[key]
    if inbox:
        raise RuntimeError("nodes without all their children")


NODE = "number long, total long, level int, place long, digest binary, slots array<int>, digests array<binary>, ids array<bigint>, others array<binary>"


class Supersteps:
    """Nodes of one set of trees, level by level; trees: as many leaves as total says, by number."""

    def __init__(self, scratch: Scratch, tag: str):
        self.scratch, self.tag, self.levels = scratch, tag, {}

    def _up(self, level: int, messages: RDD, partitions: int) -> DataFrame:
        heard = messages.mapPartitions(_together).partitionBy(partitions, _spread).mapPartitions(_heard)
        rows = heard.map(lambda n: (*n[0], n[1], [c[0] for c in n[2]], [c[1] for c in n[2]], [c[2][0] for c in n[2]] if level == 1 else None, [c[2][1] for c in n[2]] if level == 1 else None))
        nodes = self.scratch.written(self.scratch.spark.createDataFrame(rows, NODE, verifySchema=False), f"merkle-{self.tag}-{level}")
        self.levels[level] = nodes
        return nodes

    def up(self, first: DataFrame, count: int, most: int) -> DataFrame:
        """All levels over first (number, total, place, digest, doc_id, other), of count rows, of which a tree has most at most; number, digest of each tree's last node."""
        messages = first.rdd.map(lambda r: ((r[0], r[1], 1, r[2] // ARITY), (r[2] % ARITY, r[3], (r[4], r[5]))))
        for level in range(1, height_of(most) + 1):
            nodes = self._up(level, messages, 1 + count // (ARITY * NODES_A_TASK))
            count = -(-count // ARITY)
            waiting = nodes.where(F.col("total") > ARITY**level).select("number", "total", "place", "digest")
            messages = waiting.rdd.map(lambda r, up=level + 1: ((r[0], r[1], up, r[2] // ARITY), (r[2] % ARITY, r[3], None)))
        last = [nodes.where(F.col("total") <= ARITY**level).select("number", "digest", "total") for level, nodes in self.levels.items()]
        out = last[0]
        for more in last[1:]:
            out = out.union(more)
        return out

    def down(self, starts: RDD, answer: Callable[[tuple, tuple], Iterator[tuple]], shape: str, partitions: int) -> DataFrame:
        """Rows that the lowest nodes answer; starts: (number, total), (subroot, root, path) of each tree's last node."""
        starts = starts.map(lambda m: ((m[0][0], m[0][1], height_of(m[0][1]), 0), m[1]))
        sent = None
        for level in sorted(self.levels, reverse=True):
            here = starts.filter(lambda m, level=level: m[0][2] == level)
            inbox = here if sent is None else here.union(sent)
            n = partitions if level == 1 else 1 + partitions // ARITY ** (level - 1)
            nodes = self.levels[level].rdd.map(lambda r: (tuple(r[:4]), (list(r["slots"]), [bytes(d) for d in r["digests"]], r["ids"], r["others"])))
            joined = nodes.partitionBy(n, _spread).join(inbox.partitionBy(n, _spread), n)
            if level > 1:
                rows = joined.flatMap(_to_children)
                table = self.scratch.spark.createDataFrame(rows, PATHS, verifySchema=False)
                sent = self.scratch.written(table, f"merkle-paths-{self.tag}-{level}").rdd.map(lambda r: (tuple(r[:4]), (bytes(r[4]), bytes(r[5]), bytes(r[6]))))
            else:
                return self.scratch.written(self.scratch.spark.createDataFrame(joined.flatMap(lambda kv: answer(kv[0], kv[1])), shape, verifySchema=False), f"merkle-{self.tag}-answers")
        raise RuntimeError("no levels")


PATHS = "number long, total long, level int, place long, subroot binary, root binary, path binary"


def step_of(slot: int, digests: list[bytes]) -> bytes:
    """One level of a path: the place in the run, the number of siblings, their digests."""
    return bytes([slot, len(digests) - 1]) + b"".join(digests[:slot] + digests[slot + 1 :])


def steps(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """The levels of a path from the lowest on: place, siblings."""
    at = 0
    while at < len(path):
        slot, n = path[at], path[at + 1]
        yield slot, [path[at + 2 + 32 * k : at + 34 + 32 * k] for k in range(n)]
        at += 2 + 32 * n


def folded(digest: bytes, path: bytes) -> bytes:
    """The root that a digest leads to along a path."""
    for slot, siblings in steps(path):
        digest = hashed([*siblings[:slot], digest, *siblings[slot:]])
    return digest


def siblings_hex(path: bytes) -> bytes:
    return b"".join(s.hex().encode() for _, siblings in steps(path) for s in siblings)


def _to_children(joined: tuple) -> Iterator[tuple]:
    (number, total, level, place), ((slots, digests, _, _), (subroot, root, path)) = joined
    for slot in slots:
        yield number, total, level - 1, ARITY * place + slot, subroot, root, step_of(slot, digests) + path


def _own_path(key: tuple, slot: int, digests: list[bytes], path: bytes) -> bytes:
    """A leaf's path: a lone leaf is the last node itself."""
    return path if key[1] == 1 else step_of(slot, digests) + path


def _proofs(key: tuple, joined: tuple) -> Iterator[tuple]:
    """A row of RESULT for each leaf below a node."""
    (slots, digests, ids, others), (subroot, root, path) = joined
    above, reached = siblings_hex(path), {}
    for slot, digest, doc_id, other in zip(slots, digests, ids, others, strict=True):
        leaf = digest if other is None else bytes(other)
        if key[1] == 1:
            proof, mine = above, leaf
        else:
            run = digests[:slot] + digests[slot + 1 :]
            proof, mine = b"".join(d.hex().encode() for d in run) + above, hashed([*digests[:slot], leaf, *digests[slot + 1 :]])
        if mine not in reached:
            reached[mine] = folded(mine, path)
        end = reached[mine]
        yield doc_id, digest.hex(), subroot.hex(), root.hex(), hashlib.sha256(proof).hexdigest(), end.hex(), end == root


def _subroot_paths(key: tuple, joined: tuple) -> Iterator[tuple]:
    """From the lowest nodes of the top tree: each source's subroot, the root, and the path between them. others: the source's number of leaves."""
    (slots, digests, numbers, totals), (_, root, path) = joined
    for slot, digest, number, total in zip(slots, digests, numbers, totals, strict=True):
        yield number, int.from_bytes(total, "big"), digest, root, _own_path(key, slot, digests, path)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """RESULT for every row of docs; rows where tampered holds are verified with A-Z of their text lower-cased."""
    tampered = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.written(leaves(docs, tampered), "merkle-leaves")
        count = rows.count()
        if not count:
            return docs.sparkSession.createDataFrame([], RESULT)
        tasks = max(docs.sparkSession.sparkContext.defaultParallelism, count // LEAVES_A_TASK)
        placed, sources = numbered_leaves(rows, tasks, scratch)
        n_sources, most = sources.agg(F.count(F.lit(1)), F.max("total")).first()

        bottom, top = Supersteps(scratch, "sources"), Supersteps(scratch, "top")
        subroots = bottom.up(placed.select("number", "total", "place", "leaf", "doc_id", "other"), count, most)
        # The top tree's leaves; a source's number of leaves goes along as bytes.
        firsts = subroots.select(F.lit(0).cast("long"), F.lit(n_sources).cast("long"), "number", "digest", F.col("number").alias("doc_id"), F.unhex(F.lpad(F.hex("total"), 16, "0")).alias("other"))
        root = bytes(top.up(firsts, n_sources, n_sources).first()["digest"])
        spark = docs.sparkSession
        start = spark.sparkContext.parallelize([((0, n_sources), (root, root, b""))], 1)
        paths = top.down(start, _subroot_paths, "number long, total long, subroot binary, root binary, path binary", 1 + n_sources // (ARITY * NODES_A_TASK))
        begin = paths.rdd.map(lambda r: ((r[0], r[1]), (bytes(r[2]), bytes(r[3]), bytes(r[4]))))
        out = bottom.down(begin, _proofs, RESULT, max(tasks, 1 + count // NODES_A_TASK))
        scratch.keep(out)
    return out
