"""Packing: first-fit decreasing over a tournament tree of free capacities, in random groups of documents.

Tokenizing a document gives its pieces: runs of ``capacity`` ids and one rest. Each
document goes to a random group (a seeded hash; the number of groups follows the
number of rows, so a group keeps about ``group_docs`` documents at any scale). Within
a group the pieces are taken longest first and put into the first open sequence with
room, which a tournament tree over the sequences' free room finds in log time.

Only (doc_id, start, length, checksum) rows are shuffled, never texts or ids. Null and
empty texts have the end id alone; very long texts are encoded whole; equal rows are
packed one by one; doc_id may be null; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import narrowed

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class RoomTree:
    """A tournament tree: each leaf is a sequence's free room, each inner node the larger of its two children."""

    def __init__(self, leaves: int, room: int):
        self.size = 1 << max(0, (leaves - 1).bit_length())
        self.room = [room] * (2 * self.size)

    def first_fit(self, length: int) -> int:
        """The leftmost leaf with that much room."""
        room, at = self.room, 1
        if room[1] < length:
            raise ValueError("no leaf has room")
        while at < self.size:
            at *= 2
            if room[at] < length:
                at += 1
        return at - self.size

    def take(self, leaf: int, length: int) -> None:
        room, at = self.room, leaf + self.size
        room[at] -= length
        at //= 2
        while at:
            larger = max(room[2 * at], room[2 * at + 1])
            if room[at] == larger:
                break
            room[at] = larger
            at //= 2


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; pieces are taken longest first, equal ones in the given order."""
    order = np.argsort(-lengths, kind="stable")
    tree, used = RoomTree(len(lengths), capacity), {}
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in order.tolist():
        n = int(lengths[i])
        leaf = tree.first_fit(n)
        sequence[i], offset[i] = leaf, used.get(leaf, 0)
        used[leaf] = used.get(leaf, 0) + n
        tree.take(leaf, n)
    return sequence, offset


class Encoder:
    """The ids that ``tokenizers`` gives for a byte-level BPE file.

    The same vocabulary as ranks is several times faster in ``tiktoken``. Where the two
    could part - a text with a special string, or with characters outside the blocks
    whose classes all Unicode versions share - the text goes to ``tokenizers``, as do
    texts with a run of ``RUN`` characters without, or of nothing but, white space, which
    ``tiktoken``'s patterns have no stack for.
    """

    RUN = 100_000
    endless = re.compile(rf"\S{{{RUN}}}|\s{{{RUN}}}").search
    plain = re.compile("[^\x00-ɏ‐-‧‰-⁞€]").search

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or self.plain(text) or any(s in text for s in self.special) or (len(text) >= self.RUN and self.endless(text)):
            return self.slow.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return self.fast.encode_ordinary(text)


def pieces(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """A row for each piece of each document's ids and the end id; part numbers a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = Encoder(json_path, ranks_path, pattern), 0
        for b in batches:
            ids_of, rows = b.column("doc_id").to_pylist(), []
            for doc_id, text in zip(ids_of, b.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                part += 1
                rows += [(doc_id, at, min(capacity, len(ids) - at), zlib.crc32(ids[at : at + capacity].tobytes()), len(ids), part) for at in range(0, len(ids), capacity)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 6, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part"])

    return narrowed(docs.withColumn("doc_id", docs["doc_id"].cast("long")), "doc_id", "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, capacity: int = 1024, end_id: int = 0, group_docs: int = 4096, seed: int = 17) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece.

    sequence_id is unique over the whole result: the group's number times 2^32 plus the
    sequence's number in the group. The seeded hash covers the document's number within
    its task, so rows with one doc_id, or none, spread over groups as well.
    """
    groups = max(1, -(-docs.count() // group_docs))
    cut = pieces(docs, json_path, ranks_path, pattern, capacity, end_id)
    cut = cut.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "doc_tokens", "part"), F.lit(groups))).drop("part")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        sequence, offset = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        kept = rows.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return kept.append_column("sequence_id", pa.array((key[0].as_py() << 32) + sequence)).append_column("offset", pa.array(offset))

    return cut.repartition(max(1, min(groups, 4 * docs.sparkSession.sparkContext.defaultParallelism)) if groups < 10_000 else groups // 16, "grp").groupBy("grp").applyInArrow(run, PACKED)
