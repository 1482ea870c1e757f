"""Near-duplicate removal by min-max hashing: signatures of minima and maxima, banded; links confirmed on full sets.

Two documents link when the Jaccard similarity of their sets of 3-word shingles is at
least 0.85, tested exactly as 100 * common >= 85 * union.

1. *Signatures.* Every shingle is hashed to 64 bits, and ``PERMUTATIONS`` mixing
   functions permute the hashes of a set. Of each permutation both the minimum and the
   maximum are kept, so 128 unbiased values cost 64 evaluations a shingle, and as a
   set's two ends agree less often by accident than two minima would, similarities
   estimated from them vary less. Four values form a band: two permutations, both ends.
2. *Buckets.* Sets that agree in a band share a bucket. Of 32 bands at similarity 0.85
   none agrees with probability (1 - 0.85^4)^32, about 5e-11; that, and the odds of the
   sketches below, are the chance that a link between two sets is never looked at.
   Equal sets are one class before anything else.
3. *Links.* Each bucket's sets are first held against one of them, the one with the most
   neighbours over all bands, then against another one; links found are contracted to
   components. Buckets that still lie in several components have the pairs of different
   components held against each other. Before sets are fetched, sketches of one bit for
   each value must differ in at most ``MOST_BITS`` of 128 places (a linked pair does
   with odds under 1e-10), and in the last pass parities must fit: of each set's hashes
   ``PARITIES`` bits say whether an odd number of them fell there, so two sets differ in
   at least as many shingles as they differ in bits, which rules out a pair beyond
   doubt when that is more than similarity 0.85 allows sets of their sizes. Every link is
   then confirmed on the whole sets of 64-bit hashes (words aren't compared again; of
   10^10 compared pairs of sets of 1,000 shingles, about 0.0005 would count a shingle too
   many).

The shingles of sets that share no bucket are never kept: sets are made again from the
texts of the others only. Families of sets that are alike but not linked (similarity
0.5 to 0.84) are what the last pass costs most for: it compares the bits of all their
pairs of one bucket, though nearly none becomes a row.

A document with fewer words than three is one shingle of its own; without words it has an
empty set, links with nothing and stays. The result is a row per document: repeated rows
get a row each, null doc_ids don't count for the smallest one (component_id is null only
where the whole group has none), very long texts are read whole, columns besides doc_id
and text are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import Scratch, narrowed, slices, text_bytes
from lodestrata.llm.components import connected_components
from lodestrata.llm.jaccard import Hasher

SHINGLE, PERCENT = 3, 85
PERMUTATIONS, BANDS = 64, 32
MOST_BITS = 36
#: Bits of parity of a set, in words of 64.
PARITIES = 1024
#: Shingles whose permuted hashes are held at once.
BLOCK = 1 << 15
#: Keys of sets that are broadcast to the scan that makes them again, of 24 bytes each; beyond that they are joined by a shuffle.
MOST_BROADCAST = 1_000_000

_RNG = np.random.default_rng(20250101)
_FACTORS = _RNG.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _RNG.integers(0, 1 << 63, PERMUTATIONS, np.uint64)
_FINISH = np.uint64(0xD6E8FEB86659FD93)

SKETCHES = "doc_id long, text_hash long, set_id binary, n long, bands array<long>, low long, high long, odd array<long>"


def ends(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Minimum and maximum of each set under each permutation, a row a set; the sets' hashes follow each other, begin says where."""
    out = np.empty((len(begin), PERMUTATIONS, 2), np.uint64)
    for k in range(PERMUTATIONS):
        x = (h ^ _MASKS[k]) * _FACTORS[k]
        x ^= x >> np.uint64(32)
        x *= _FINISH
        out[:, k, 0], out[:, k, 1] = np.minimum.reduceat(x, begin), np.maximum.reduceat(x, begin)
    return out


def signatures(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``ends`` in blocks: sets of any size, none empty."""
    out, stops = np.empty((len(sizes), PERMUTATIONS, 2), np.uint64), np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        start = stops[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(stops, start + BLOCK, "right")))
        if last == first + 1 and sizes[first] > BLOCK:  # a large set in pieces
            pieces = [ends(h[a : min(a + BLOCK, stops[first])], np.array([0]))[0] for a in range(start, stops[first], BLOCK)]
            out[first, :, 0], out[first, :, 1] = np.min([p[:, 0] for p in pieces], 0), np.max([p[:, 1] for p in pieces], 0)
        else:
            out[first:last] = ends(h[start : stops[last - 1]], (stops - sizes)[first:last] - start)
        first = last
    return out


def banded(signature: np.ndarray) -> np.ndarray:
    """A key for each band of each set: of both ends under two permutations, and the band's number."""
    a, b = signature[:, 0::2], signature[:, 1::2]
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * _FINISH
    for x in (a[..., 0], a[..., 1], b[..., 0], b[..., 1]):
        key = (key ^ x) * _FACTORS[0]
        key ^= key >> np.uint64(29)
    return key


def sketch_bits(signature: np.ndarray) -> np.ndarray:
    """Two words of 64 bits for each set: a bit of each minimum, and of each maximum."""
    bits = ((signature >> np.uint64(17)) & np.uint64(1)) << np.arange(PERMUTATIONS, dtype=np.uint64)[None, :, None]
    return np.bitwise_or.reduce(bits, 1)


def parities(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Words of bits for each set, one where an odd number of its hashes falls on the bit."""
    place = np.repeat(np.arange(len(sizes)), sizes) * PARITIES + ((h >> np.uint64(7)) % np.uint64(PARITIES)).astype(np.int64)
    odd = (np.bincount(place, minlength=len(sizes) * PARITIES) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(sizes), PARITIES), axis=1).view(np.int64)


def sets_of(hasher: Hasher, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' sets of shingle hashes, sorted, one behind the other, and their sizes."""
    h, of = hasher(texts)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.bincount(of[new], minlength=len(texts))


def sketched(rows: DataFrame) -> DataFrame:
    """SKETCHES of doc_id, text, text_hash; set_id is null where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(SHINGLE)
        for b in (x for whole in batches for x in slices(whole, 64)):
            h, sizes = sets_of(hasher, text_bytes(b.column("text")))
            full, stops = np.flatnonzero(sizes), np.cumsum(sizes)
            digests: list[bytes | None] = [None] * len(sizes)
            keys: list[np.ndarray | None] = [None] * len(sizes)
            bits = np.zeros((len(sizes), 2), np.uint64)
            odd = list(parities(h, sizes))
            if len(full):
                signature = signatures(h, sizes[full])
                bits[full] = sketch_bits(signature)
                for t, key in zip(full.tolist(), banded(signature).view(np.int64), strict=True):
                    keys[t] = key
                    digests[t] = xxhash.xxh3_128_digest(h[stops[t] - sizes[t] : stops[t]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(digests, pa.binary()), pa.array(sizes), pa.array(keys, pa.list_(pa.int64())), *[pa.array(bits[:, k].view(np.int64)) for k in (0, 1)], pa.array(odd, pa.list_(pa.int64()))],
                names=[x.split()[0] for x in SKETCHES.split(", ")],
            )

    return rows.mapInArrow(run, SKETCHES)


def full_sets(rows: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """set_id, items of the wanted sets, made again from the text of one document each; wanted: set_id, doc_id, text_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(SHINGLE)
        for b in (x for whole in batches for x in slices(whole, 64)):
            h, sizes = sets_of(hasher, text_bytes(b.column("text")))
            stops = np.cumsum(sizes)
            items = [h[stop - n : stop].tobytes() for n, stop in zip(sizes.tolist(), stops.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("set_id"), pa.array(items, pa.binary())], names=["set_id", "items"])

    keys = wanted.select("set_id", F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"))
    keys = F.broadcast(keys) if wanted.count() <= MOST_BROADCAST else keys
    of = rows.join(keys, rows["doc_id"].eqNullSafe(keys["of_id"]) & (rows["text_hash"] == keys["of_hash"])).select("set_id", "text")
    return scratch.written(of.mapInArrow(run, "set_id binary, items binary").dropDuplicates(["set_id"]), "minmax-sets")


def confirmed(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose sets have Jaccard similarity of 0.85 or more."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole)):
            keep = []
            for ia, ib in zip(b.column("ia").to_pylist(), b.column("ib").to_pylist(), strict=True):
                both = np.frombuffer(ia + ib, np.uint64).copy()
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= PERCENT * (len(both) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = items.select(F.col("set_id").alias("a"), F.col("items").alias("ia"))
    y = items.select(F.col("set_id").alias("b"), F.col("items").alias("ib"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "ia", "ib").mapInArrow(test, "a binary, b binary")


def _fits(x: str, y: str) -> F.Column:
    """Whether sizes and sketches leave the pair a chance."""
    c = lambda t, name: F.col(f"{t}.{name}")
    sizes = (100 * c(x, "n") >= PERCENT * c(y, "n")) & (100 * c(y, "n") >= PERCENT * c(x, "n"))
    differ = sum((F.bit_count(c(x, w).bitwiseXOR(c(y, w))) for w in ("low", "high")), F.lit(0))
    return sizes & (differ <= MOST_BITS)


def _parities_fit(x: str, y: str) -> F.Column:
    """Whether the bits of parity allow the similarity; sets of sizes a and b differ in (a + b) * 15 / 185 shingles at most."""
    differ = sum((F.bit_count(F.get(f"{x}.odd", F.lit(k)).bitwiseXOR(F.get(f"{y}.odd", F.lit(k)))) for k in range(PARITIES // 64)), F.lit(0))
    return (100 + PERCENT) * differ <= (100 - PERCENT) * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def _pairs(joined: DataFrame, x: str, y: str) -> DataFrame:
    return joined.select(F.least(f"{x}.set_id", f"{y}.set_id").alias("a"), F.greatest(f"{x}.set_id", f"{y}.set_id").alias("b")).distinct()


def similar_sets(members: DataFrame, items: DataFrame, odd: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root of the sets that link with another; members: key, set_id, n, low, high, near of the sets in shared buckets; odd: set_id, odd."""
    links = tested = roots = None
    for step in ("most neighbours", "largest", "all"):
        used, left = [], members
        if roots is None:
            left = members.withColumn("root", F.col("set_id"))
        else:  # buckets whose sets are in several components so far
            at = members.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
            mixed = at.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
            used.append(scratch.written(mixed, "minmax-mixed"))
            left = scratch.written(at.join(used[-1], "key"), "minmax-left")
            used.append(left)
        if step == "all":
            left = left.join(odd, "set_id")
            pairs = _pairs(left.alias("x").join(left.alias("y"), F.col("x.key") == F.col("y.key")).where((F.col("x.set_id") < F.col("y.set_id")) & (F.col("x.root") != F.col("y.root")) & _fits("x", "y") & _parities_fit("x", "y")), "x", "y")
        else:
            by = F.struct("near", "n", "set_id", "low", "high", "root") if step == "most neighbours" else F.struct("n", "set_id", "low", "high", "root")
            pivot = left.groupBy("key").agg(F.max(by).alias("p")).select("key", "p.set_id", "p.n", "p.low", "p.high", "p.root")
            used.append(scratch.written(pivot, "minmax-pivots"))
            pairs = _pairs(left.alias("m").join(used[-1].alias("p"), F.col("m.key") == F.col("p.key")).where((F.col("m.set_id") != F.col("p.set_id")) & (F.col("m.root") != F.col("p.root")) & _fits("m", "p")), "m", "p")
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.written(pairs, "minmax-pairs")
        tested = pairs if tested is None else tested.union(pairs)
        new = scratch.written(confirmed(pairs, items), "minmax-links")
        links = new if links is None else links.union(new)
        if step == "all" or not new.isEmpty():
            roots = connected_components(links)
        scratch.drop(*used)
    return roots


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs; component_id is the smallest doc_id that links reach."""
    rows = narrowed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    with Scratch(docs.sparkSession) as scratch:
        sketches = scratch.written(sketched(rows), "minmax-sketches")
        found = sketches.where("set_id IS NOT NULL")
        # One of the documents with a set stands for it.
        one = F.min_by(F.struct("doc_id", "text_hash", "n", "low", "high", "bands", "odd"), F.struct("doc_id", "text_hash"))
        sets = scratch.written(found.groupBy("set_id").agg(one.alias("s"), F.min("doc_id").alias("least")), "minmax-classes")
        keys = sets.select("set_id", F.explode("s.bands").alias("key"))
        shared = scratch.written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "minmax-shared")
        buckets = scratch.written(keys.join(shared, "key"), "minmax-buckets")
        near = scratch.written(buckets.groupBy("set_id").agg(F.sum("size").alias("near")).join(sets, "set_id").select("set_id", "near", "s.*"), "minmax-near")
        items = full_sets(rows, near, scratch)
        members = scratch.written(buckets.drop("size").join(near.select("set_id", "near", "n", "low", "high"), "set_id"), "minmax-members")
        scratch.drop(shared, buckets)
        roots = similar_sets(members, items, near.select("set_id", "odd"), scratch)
        classes = sets.select("set_id", "least").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
        classes = scratch.written(classes, "minmax-roots")
        lowest = scratch.written(classes.groupBy("root").agg(F.min("least").alias("component_id")), "minmax-lowest")
        named = scratch.written(classes.join(lowest, "root").select("set_id", "component_id"), "minmax-named")
        scratch.keep(sketches, named)
    filled = found.join(named, "set_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = sketches.where("set_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return filled.union(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
