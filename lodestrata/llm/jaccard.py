"""Set similarity join on word shingles: a size-aware heavy-light join, and the groups its links form.

Two documents link when the Jaccard similarity of their sets of word shingles is at
least 3/4, tested exactly as 100 * common >= 75 * union. The join runs in steps:

1. *Which shingles recur.* Tasks hash shingles (64 bits: of 10^10 compared pairs of sets
   of 1,000 shingles, about 0.0005 would count a shingle too many; words aren't compared
   again) and send each, in sorted, compressed runs
   by hash range, to be counted over all documents; a shingle that a run of documents
   holds often is counted there first and sent once. Back comes each recurring shingle's
   frequency level. A run sends a row to at most ``FAN`` ranges: where there are more,
   runs are first gathered in groups, by coarse range, and divided from there, and come
   back the same way, so rows grow in proportion to the shingles. A document with under
   3/4 recurring shingles can have no partner and is done; of the others only recurring
   shingles matter.
2. *Candidates.* Shingles are ordered rare first. Linked sets share one of the first
   n - ceil(3n/4) + 1 shingles (prefix); shared by c, one more c-subset of a prefix c - 1
   longer. Small sets (light) enumerate all 2-subsets of their prefix; large sets
   (heavy) scan the inverted lists of single shingles. The boundary is the power of two
   at which the subsets made plus the list entries read, both known from the levels,
   are fewest. Pairs must also pass the length and position bounds.
3. *Links.* Every list's members are first held against one member of it, and the
   links found are contracted to components. What is left are lists over several
   components; all their pairs from different components and of fitting sizes are tested
   (lists are divided into bands of sizes first), so a pair is skipped only where its two
   sets are known to be in one component.

Exact copies (equal sets) are one class throughout. Documents without words have an
empty set and link with nothing. The result is a row per document: repeated rows get a
row each, very long texts are read whole, columns besides doc_id and text are ignored
(and kept by ``one_of_each``), an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import Scratch, free_name, narrowed, slices, text_bytes
from lodestrata.llm.components import connected_components

SHINGLE = 5
HASH_BITS = 64
#: Shingles that a run of documents holds before it is sent, and of which a range is counted at once.
RUN, RANGE = 1 << 19, 1 << 20
#: A shingle in so many documents of a run is counted there and sent once.
OFTEN = 8
#: Ranges that a run is divided into at once.
FAN = 256
#: Words, of so many bytes at most, whose hashes a task remembers; it forgets all of them beyond that.
MEMO, REMEMBERED = 100_000, 64
BOUNDARIES = (0, 8, 16, 32, 64, 128)

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hasher:
    """Shingle hashes of texts: words lie between ASCII white space, A-Z are lower-cased."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.known = size, {}

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        known, counts, out = self.known, [], []
        for t in texts:
            words = t.lower().split()
            counts.append(len(words))
            for w in words:
                h = known.get(w)
                if h is None:
                    if len(known) >= MEMO:
                        known.clear()
                    h = xxhash.xxh3_64_intdigest(w)
                    if len(w) <= REMEMBERED:
                        known[w] = h
                out.append(h)
        return np.array(out, np.uint64), np.array(counts, np.int64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles, and the number of each one's text; with repeats, texts in order."""
        h, counts = self.words(texts)
        if not len(h):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(texts)), counts)
        n = len(h) - self.size + 1
        full = np.zeros(max(n, 0), np.uint64)
        for k in range(self.size if n > 0 else 0):
            full = full * _MULTIPLIER + h[k : k + n]
        whole = owner[:n] == owner[self.size - 1 :] if n > 0 else np.zeros(0, bool)
        out, of = [full[whole]], [owner[:n][whole]] if n > 0 else [np.zeros(0, np.int64)]
        ends = np.cumsum(counts)
        for t in np.flatnonzero((counts > 0) & (counts < self.size)).tolist():  # the whole sequence as one, told apart by its length
            x = 0
            for w in h[ends[t] - counts[t] : ends[t]].tolist():
                x = (x * int(_MULTIPLIER) + w) % 2**64
            out.append(np.array([x ^ (0xA5A5 + int(counts[t]))], np.uint64))
            of.append(np.array([t]))
        h, of = np.concatenate(out), np.concatenate(of)
        order = np.argsort(of, kind="stable")
        return _mixed(h[order]), of[order]


def packed(h: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted hashes as differences, and columns, byte by byte plane, compressed."""
    gaps = np.diff(h, prepend=np.uint64(0))
    planes = [np.uint32(len(h)).tobytes()]
    for c in (gaps, *columns):
        planes.append(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n, at, out = int(raw[:4].view(np.uint32)[0]), 4, []
    for kind in (np.uint64, *kinds):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).ravel())
        at += n * width
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


ROWS = "bucket int, kind int, run long, local int, doc_id long, text_hash long, set_id binary, n long, data binary"
SETS = "set_id binary, n long, items binary, scan long"
_NONE = 0xFFFF


def cuts(h: np.ndarray, ranges: int, low: int = 0, high: int = 1 << HASH_BITS) -> list[int]:
    """Where sorted hashes from low up to high pass from one of ``ranges`` equal ranges to the next."""
    bounds = np.array([low + (high - low) * k // ranges for k in range(1, ranges)], np.uint64)
    return [0, *np.searchsorted(h, bounds).tolist(), len(h)]


def _runs(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Step 1's map side: rows of kind 0 hold a run's shingles of a range, 1 a document, 2 the holders of a run's frequent shingles."""

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in ROWS.split(", ")])

    def send(run: int, ids: list, marks: list[int], h: np.ndarray, of: np.ndarray, n_texts: int) -> Iterator[tuple]:
        order = np.argsort(h, kind="stable")
        h, of = h[order], of[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        h, of = h[new], of[new]
        sizes = np.bincount(of, minlength=n_texts)
        by_text = np.argsort(of.astype(np.uint16), kind="stable")
        mine, ends = h[by_text], np.cumsum(sizes)
        first: dict[bytes, int] = {}
        keep = np.zeros(n_texts, bool)
        for t in range(n_texts):
            digest = xxhash.xxh3_128_digest(mine[ends[t] - sizes[t] : ends[t]].tobytes()) if sizes[t] else None
            local = -1
            if digest is not None:
                local = first.setdefault(digest, t)
                keep[local] = True
            yield ((run + t) % buckets, 1, run, local, ids[t], marks[t], digest, int(sizes[t]), None)
        h, of = h[keep[of]], of[keep[of]].astype(np.uint16)
        if not len(h):
            return
        begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        count = np.diff(np.append(begin, len(h)))
        often = np.repeat(count >= OFTEN, count)
        if often.any():
            yield (run % buckets, 2, run, -1, None, None, None, 0, packed(h[often], of[often]))
        head = np.zeros(len(h), bool)
        head[begin] = True
        times = np.ones(len(h), np.uint16)
        times[begin] = np.where(count >= OFTEN, np.minimum(count, _NONE), 1)
        sent = ~often | head
        holder = np.where(often, _NONE, of).astype(np.uint16)[sent]
        h, times = h[sent], times[sent]
        edges = cuts(h, buckets)
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if a < b:
                yield (k, 0, run, -1, None, None, None, 0, packed(h[a:b], holder[a:b], times[a:b]))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, run = Hasher(), TaskContext.get().partitionId() << 32
        ids, marks, parts, size = [], [], [], 0

        def sent() -> pa.RecordBatch:
            return table(list(send(run, ids, marks, *hasher(parts), len(parts))))

        for piece in (x for b in batches for x in slices(b)):
            for doc_id, mark, text in zip(piece.column("doc_id").to_pylist(), piece.column("text_hash").to_pylist(), text_bytes(piece.column("text")), strict=True):
                ids.append(doc_id)
                marks.append(mark)
                parts.append(text)
                size += len(text)
                if size >= 6 * RUN or len(parts) == _NONE - 1:
                    yield sent()
                    run, size = run + len(parts), 0
                    ids, marks, parts = [], [], []
        if parts:
            yield sent()

    return go


def recurring(parts: list[list[np.ndarray]]) -> list[bytes | None]:
    """Of each part's shingles (hash, holder, times, any more columns) those that stand twice or more in all parts: hash, holder, level, more."""
    sizes = [len(p[0]) for p in parts]
    h, times = (np.concatenate([p[k] for p in parts]) for k in (0, 2))
    order = np.argsort(h, kind="stable")
    h = h[order]
    begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    total = np.add.reduceat(times[order].astype(np.int64), begin)
    level = np.zeros(len(h), np.uint8)
    level[order] = np.repeat(np.where(total >= 2, np.log2(total) + 1, 0).astype(np.uint8), np.diff(np.append(begin, len(h))))  # 0: stands once
    out, at = [], 0
    for p, n in zip(parts, sizes, strict=True):
        mine = level[at : at + n]
        at += n
        keep = mine > 0
        out.append(packed(p[0][keep], p[1][keep], mine[keep] - np.uint8(1), *[c[keep] for c in p[3:]]) if keep.any() else None)
    return out


def _counted(rows: pa.Table) -> pa.Table:
    """Step 1's reduce side, for one range of hashes: what recurs goes back to its run with its level; other rows pass."""
    here = rows.filter(pc.equal(rows["kind"], 0))
    out = [rows.filter(pc.not_equal(rows["kind"], 0))]
    if here.num_rows:
        found = recurring([unpacked(d, np.uint16, np.uint16) for d in here["data"].to_pylist()])
        here = here.set_column(here.schema.get_field_index("data"), "data", pa.array(found, pa.binary()))
        out.append(here.filter(pc.is_valid(here["data"])))
    return pa.concat_tables(out)


PIECES = "bucket int, part int, grp int, kind int, run long, data binary"


def _divided(parts: int, coarse: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Gathers the shingles that a group of runs has in one coarse range and divides them into finer ones; kind 3 names the runs, in order."""
    shape = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("grp", pa.int32()), ("kind", pa.int32()), ("run", pa.int64()), ("data", pa.binary())])

    def go(key: tuple, rows: pa.Table) -> pa.Table:
        bucket, grp = key[0].as_py(), key[1].as_py()
        runs, piece = np.unique(rows["run"].to_numpy(), return_inverse=True)
        unpacked_rows = [unpacked(d, np.uint16, np.uint16) for d in rows["data"].to_pylist()]
        h, holder, times = (np.concatenate([p[k] for p in unpacked_rows]) for k in range(3))
        owner = np.repeat(piece.astype(np.uint32), [len(p[0]) for p in unpacked_rows])
        order = np.argsort(h, kind="stable")
        h, holder, times, owner = h[order], holder[order], times[order], owner[order]
        out = [(bucket, None, grp, 3, None, runs.tobytes())]
        edges = cuts(h, parts, (bucket << HASH_BITS) // coarse, ((bucket + 1) << HASH_BITS) // coarse)
        out += [(bucket, k, grp, 0, None, packed(h[a:b], holder[a:b], times[a:b], owner[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)

    return go


def _counted_part(rows: pa.Table) -> pa.Table:
    """The count of one finer range: what recurs, with its level and the number of its run, goes back to its group."""
    data = rows["data"].to_pylist()
    found = recurring([unpacked(d, np.uint16, np.uint16, np.uint32) for d in data])
    rows = rows.set_column(rows.schema.get_field_index("data"), "data", pa.array(found, pa.binary()))
    return rows.filter(pc.is_valid(rows["data"]))


def _returned(rows: pa.Table) -> pa.Table:
    """A group's recurring shingles in one coarse range, dealt to its runs again."""
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
    shape = pa.schema([(x.split()[0], k) for x, k in zip(ROWS.split(", "), kinds, strict=True)])
    found = rows.filter(pc.equal(rows["kind"], 0))
    if not found.num_rows:
        return shape.empty_table()
    runs = np.frombuffer(rows.filter(pc.equal(rows["kind"], 3))["data"][0].as_py(), np.int64)
    parts = [unpacked(d, np.uint16, np.uint8, np.uint32) for d in found["data"].to_pylist()]
    h, holder, level, owner = (np.concatenate([p[k] for p in parts]) for k in range(4))
    order = np.lexsort((h, owner))
    h, holder, level, owner = h[order], holder[order], level[order], owner[order]
    edges, bucket = np.searchsorted(owner, np.arange(len(runs) + 1)).tolist(), rows["bucket"][0].as_py()
    out = [(bucket, 0, int(run), -1, None, None, None, 0, packed(h[a:b], holder[a:b], level[a:b])) for run, a, b in zip(runs.tolist(), edges, edges[1:], strict=False) if a < b]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)


def counted_runs(rows: DataFrame, buckets: int, fan: int, scratch: Scratch) -> DataFrame:
    """ROWS with documents, runs' frequent shingles, and what recurs of each run; rows: doc_id, text, text_hash."""
    if buckets <= fan:
        return scratch.written(rows.mapInArrow(_runs(buckets), ROWS).groupBy("bucket").applyInArrow(_counted, ROWS), "jaccard-runs")
    # Two levels: coarse ranges for all runs, finer ones for groups of about as many runs.
    coarse = min(1 << 14, math.isqrt(buckets - 1) + 1)
    parts = -(-buckets // coarse)
    sent = scratch.written(rows.mapInArrow(_runs(coarse), ROWS), "jaccard-sent")
    groups = max(1, -(-buckets * RANGE // (RUN * coarse)))
    pieces = sent.where("kind = 0").select("bucket", "run", F.pmod(F.xxhash64("run"), F.lit(groups)).cast("int").alias("grp"), "data")
    divided = scratch.written(pieces.groupBy("bucket", "grp").applyInArrow(_divided(parts, coarse), PIECES), "jaccard-divided")
    counted = divided.where("kind = 0").groupBy("bucket", "part").applyInArrow(_counted_part, PIECES)
    returned = counted.unionByName(divided.where("kind = 3")).groupBy("bucket", "grp").applyInArrow(_returned, ROWS)
    out = scratch.written(sent.where("kind <> 0").unionByName(returned), "jaccard-runs")
    scratch.drop(sent, divided)
    return out


def prefix_lengths(n: int) -> tuple[int, int]:
    """How many of the first shingles of a set of n must be looked at: against smaller sets, against larger ones."""
    return n - (3 * n + 3) // 4 + 1, n - (6 * n + 6) // 7 + 1


def _sets(rows: pa.Table) -> pa.Table:
    """Sets of one run that may have partners: recurring shingles, rare first; scan: list entries that a scan would read."""
    kinds = rows["kind"].to_numpy()
    documents = dict(zip(rows["local"].to_pylist(), zip(rows["set_id"].to_pylist(), rows["n"].to_pylist(), strict=True), strict=True)) if len(kinds) else {}
    back = [unpacked(d, np.uint16, np.uint8) for d in rows.filter(pa.array(kinds == 0))["data"].to_pylist()]
    shape = pa.schema([("set_id", pa.binary()), ("n", pa.int64()), ("items", pa.binary()), ("scan", pa.int64())])
    if not back:
        return shape.empty_table()
    h, holder, level = (np.concatenate([p[k] for p in back]) for k in range(3))
    often = holder == _NONE
    if often.any():
        (oh, ol), (eh, ed) = (h[often], level[often]), unpacked(rows.filter(pa.array(kinds == 2))["data"][0].as_py(), np.uint16)
        order = np.argsort(oh)
        oh, ol = oh[order], ol[order]
        at = np.minimum(np.searchsorted(oh, eh), len(oh) - 1)
        there = oh[at] == eh
        h, holder, level = np.append(h[~often], eh[there]), np.append(holder[~often], ed[there]), np.append(level[~often], ol[at[there]])
    order = np.lexsort((h, level, holder))
    h, holder, level = h[order], holder[order], level[order]
    owners, begin = np.unique(holder, return_index=True)
    out = []
    for t, a, b in zip(owners.tolist(), begin.tolist(), [*begin[1:].tolist(), len(h)], strict=True):
        set_id, n = documents[t]
        alone, probe = n - (b - a), prefix_lengths(n)[0]
        if 4 * (b - a) >= 3 * n and alone < probe:
            out.append((set_id, n, h[a:b].tobytes(), int((1 << level[a : a + probe - alone].astype(np.int64)).sum())))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * 4, shape, strict=True)], schema=shape)


def cost_boundary(sets: DataFrame) -> int:
    """The size up to which sets enumerate subsets: the candidate with the fewest subsets made plus list entries read."""
    small = F.array_min(F.filter(F.array(*[F.lit(b) for b in BOUNDARIES[1:]]), lambda b: b >= F.col("n")))  # null: larger than all
    width = F.col("n") - F.floor((3 * F.col("n") + 3) / 4) + 2 - (F.col("n") - F.length("items") / 8)
    cost = sets.groupBy(small.alias("size")).agg(F.sum(F.greatest(width * (width - 1) / 2, F.lit(0))).alias("subsets"), F.sum("scan").alias("scan")).collect()
    total = {b: sum(r["subsets"] if r["size"] is not None and r["size"] <= b else r["scan"] for r in cost) for b in BOUNDARIES}
    return min(BOUNDARIES, key=lambda b: (total[b], b))


SIGNATURES = "key long, set_id binary, n long, alone long, place int, role int"
LIGHT, PROBE, INDEX = 0, 1, 2


def signatures(sets: DataFrame, boundary: int) -> DataFrame:
    """Keys of each set: 2-subsets of light sets (role 0); single shingles to look up (1), to be found by (2), or both (3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole, 512)):
            ids, sizes, out = b.column("set_id").to_pylist(), b.column("n").to_pylist(), []
            for k, data in enumerate(b.column("items").to_pylist()):
                items, n = np.frombuffer(data, np.uint64), sizes[k]
                alone, (probe, index) = n - len(items), prefix_lengths(n)
                if n <= boundary:
                    head = items[: probe + 1 - alone]
                    i, j = np.triu_indices(len(head), 1)
                    both = head[i] * _MULTIPLIER + head[j]
                    out.append((_mixed(both), k, i + alone, np.full(len(i), LIGHT)))
                if 4 * n > 3 * boundary:
                    last = probe if n > boundary else index
                    place = np.arange(alone, last)
                    role = np.where(place < index, INDEX, 0) | (PROBE if n > boundary else 0)
                    out.append((items[: max(0, last - alone)], k, place, role))
            if out:
                who = np.repeat([k for _, k, _, _ in out], [len(h) for h, *_ in out])
                alone = np.array([n - len(x) // 8 for n, x in zip(sizes, b.column("items").to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([h for h, *_ in out]).astype(np.int64)), pa.array(ids, pa.binary()).take(pa.array(who)), pa.array(np.array(sizes)[who]), pa.array(alone[who]), pa.array(np.concatenate([p for _, _, p, _ in out]).astype(np.int32)), pa.array(np.concatenate([r for *_, r in out]).astype(np.int32))],
                    names=["key", "set_id", "n", "alone", "place", "role"],
                )

    return sets.select("set_id", "n", "items").mapInArrow(run, SIGNATURES)


def _possible(x: str, y: str) -> Column:
    """Whether the pair may be a candidate: y is the smaller set. Roles, lengths, and the shingles left from the common one on."""
    c = lambda t, name: F.col(f"{t}.{name}")
    roles = ((c(x, "role") == LIGHT) & (c(y, "role") == LIGHT)) | ((c(x, "role").bitwiseAND(PROBE) != 0) & (c(y, "role").bitwiseAND(INDEX) != 0))
    left = F.least(c(x, "n") - c(x, "place"), c(y, "n") - c(y, "place"))
    ordered = (c(y, "n") < c(x, "n")) | ((c(y, "n") == c(x, "n")) & (c(y, "set_id") < c(x, "set_id")))
    return ordered & (4 * c(y, "n") >= 3 * c(x, "n")) & roles & (7 * left >= 3 * (c(x, "n") + c(y, "n")))


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose sets have Jaccard similarity of 3/4 or more."""
    x = sets.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia"))
    y = sets.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole)):
            keep = []
            for na, nb, ia, ib in zip(*[b.column(c).to_pylist() for c in ("na", "nb", "ia", "ib")], strict=True):
                both = np.concatenate([np.frombuffer(ia, np.uint64), np.frombuffer(ib, np.uint64)])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= 75 * (na + nb - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "ia", "ib").mapInArrow(test, "a binary, b binary")


def _star_pairs(keys: DataFrame, fullest: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Each list's members against one of them: the one with the smallest share of shingles of its own, which is what others were copied from, or the largest.

    The lists' chosen members are a written table, so the join has plain exchanges and a long list's rows can be split.
    """
    pick = F.min(F.struct(F.col("alone") / F.col("n"), "n", "set_id", "place", "role")) if fullest else F.max(F.struct("n", "set_id", "place", "role"))
    pivot = keys.groupBy("key").agg(pick.alias("p"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "p.n", "p.set_id", "p.place", "p.role")
    pivot = scratch.written(pivot, "jaccard-pivots")
    joined = keys.alias("m").join(pivot.alias("p"), F.col("m.key") == F.col("p.key")).where(_possible("m", "p") | _possible("p", "m"))
    return joined.select(F.least("m.set_id", "p.set_id").alias("a"), F.greatest("m.set_id", "p.set_id").alias("b")).distinct(), pivot


def _banded_pairs(left: DataFrame) -> DataFrame:
    """Pairs of a list's members from different components; sizes within 4 / 3 of each other lie in one band or two neighbouring ones."""
    x = left.withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.34))))
    y = x.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    joined = x.alias("x").join(y.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.band") == F.col("y.band"))).where(_possible("x", "y") & (F.col("x.root") != F.col("y.root")))
    return joined.select(F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b")).distinct()


def similar_sets(sets: DataFrame, boundary: int | None = None) -> DataFrame:
    """node, root for every set that links with another; sets: SETS, a row each."""
    with Scratch(sets.sparkSession) as scratch:
        keys = scratch.written(signatures(sets, cost_boundary(sets) if boundary is None else boundary), "jaccard-keys")
        links = tested = roots = None
        for fullest in (True, False, None):
            used = []
            if roots is None:  # nothing is linked so far: each set is its own component
                left = keys.withColumn("root", F.col("set_id"))
            else:
                # Lists whose members are in more than one component so far.
                at = keys.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
                mixed = at.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
                left = scratch.written(at.join(mixed, "key"), "jaccard-mixed")
                used.append(left)
            if fullest is None:
                pairs = _banded_pairs(left)
            else:
                pairs, pivot = _star_pairs(left, fullest, scratch)
                used.append(pivot)
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = scratch.written(pairs, "jaccard-pairs")
            tested = pairs if tested is None else tested.union(pairs)
            new = scratch.written(linked(pairs, sets), "jaccard-links")
            links = new if links is None else links.union(new)
            if fullest is None or not new.isEmpty():
                roots = connected_components(links)
            scratch.drop(*used)
        return roots


def near_copies(docs: DataFrame, boundary: int | None = None, fan: int = FAN, range_size: int = RANGE) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash, set_id of every row of docs.

    component_id is the smallest doc_id that links reach (null doc_ids don't count;
    null only where the whole group has none). A row without words has 0 shingles and
    its own doc_id. text_hash is Spark's xxhash64 of the text.
    """
    rows = narrowed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(8, int(size / 6 / range_size) + 1)
    with Scratch(docs.sparkSession) as scratch:
        back = counted_runs(rows, buckets, fan, scratch)
        sets = scratch.written(back.where("kind <> 1 OR set_id IS NOT NULL").groupBy("run").applyInArrow(_sets, SETS).dropDuplicates(["set_id"]), "jaccard-sets")
        roots = similar_sets(sets, boundary)
        scratch.keep(back)
    documents = back.where("kind = 1").select("doc_id", "text_hash", "set_id", F.col("n").alias("n_shingles"))
    classes = documents.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("low"))
    grouped = classes.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    lowest = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    named = grouped.join(lowest, "root").select("set_id", "component_id")
    filled = documents.where("set_id IS NOT NULL").join(named, "set_id")
    empty = documents.where("set_id IS NULL").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id", "text_hash", "set_id"]
    return filled.select(*columns).union(empty.select(*columns))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, with one row of each group: the one with its smallest doc_id; rows without words stay."""
    found = near_copies(docs)
    words = found.where("set_id IS NOT NULL")
    first = words.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("set_id")).alias("own")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")).alias("k"))
    kept_id, kept_hash = free_name(docs, "kept_id"), free_name(docs, "kept_hash")
    kept = first.select(F.col("k.doc_id").alias(kept_id), F.col("k.text_hash").alias(kept_hash))
    blank = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\f\r")) == ""
    full = docs.where(~blank).withColumn(kept_hash, F.xxhash64("text"))
    full = full.join(kept, (full["doc_id"].cast("long").eqNullSafe(kept[kept_id])) & (full[kept_hash] == kept[kept_hash]), "left_semi")
    full = full.dropDuplicates(["doc_id", kept_hash]).drop(kept_hash)
    return full.unionByName(docs.where(blank))
