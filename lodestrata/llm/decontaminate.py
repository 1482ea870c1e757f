"""Benchmark decontamination by the q-gram lemma.

Texts are compared as bytes with A-Z lower-cased and each run of ASCII signs and white
space as one blank. An item has windows of two kinds: equally long ones of at most
``WINDOW`` bytes that cover it, and, where it is longer than half of that, windows of
half of ``WINDOW`` that start every eighth of ``WINDOW``, the last one flush with the
end. So each passage of 124 bytes or more holds a whole window, wherever in the item it
lies. A document leaks a window if some stretch of it is within k edits of the window,
k = ``ERROR`` of its length, or less where the bound that follows would fall under 1.
By the q-gram lemma such a stretch shares at least (length - q + 1) - k q grams with the
window, on diagonals (place in the document minus place in the item) that differ by k
at most. So shared grams are counted in bands of diagonals, each overlapping the next by
half and half wider than k, first of whole items, whose grams are indexed once, and in
the bands that may hold a window for each window; bands under the bound are dropped and
the others are verified by an alignment within the band. No window within its budget is
missed. Edits count against each window's own budget, so a passage whose edits leave
none of its windows within budget is none. Overlapping windows give a row each.

Items shorter than a gram after normalising are found where they stand as whole words,
without an edit, in the same scan.

The benchmark is a stated query set: its texts are sent to the tasks in blocks of about
half of ``BLOCK_BYTES`` (measured first; further blocks scan the documents again), and each
worker makes a block's index once, of about 16 bytes for each byte of text. Nothing is indexed on
the driver. Documents are scanned where they lie, whole, and never shuffled, very long ones in runs of
``CHUNK`` bytes of grams. Null and empty documents leak nothing; null items and items
without a letter or digit hold nothing to find; equal items are reported each; repeated
documents get their rows each; edits and end are those of the first band that holds a
window, so where a text repeats itself they may be of another place than the best one; other columns are ignored by ``find_leaks`` and kept by
``keep_clean``; empty tables give no leaks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import narrowed, text_bytes

Q = 10
WINDOW = 200
ERROR = 0.06
BLOCK_BYTES = 8 << 20
#: Bytes of documents whose grams are hashed at once.
CHUNK = 1 << 20

_WORD = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_PLAIN = bytes((c | 0x20 if 0x41 <= c <= 0x5A else c) if c in _WORD else 0x20 for c in range(256))


def normalised(text: bytes) -> bytes:
    return b" ".join(text.translate(_PLAIN).split())


def windows_of(text: bytes, width: int = WINDOW) -> list[tuple[int, bytes]]:
    """(start, bytes) of equally long windows that cover the text, and of overlapping ones half as wide."""
    n = max(1, -(-len(text) // width))
    cuts = [len(text) * i // n for i in range(n + 1)]
    half = width // 2
    starts = [*range(0, len(text) - half, max(1, half // 4)), len(text) - half] if len(text) > half else []
    return [(a, text[a:b]) for a, b in sorted({*zip(cuts, cuts[1:], strict=False), *((a, a + half) for a in starts)})]


def edit_budget(length: int, q: int = Q, error: float = ERROR) -> int:
    """Edits that a window may have: its share, but no more than leave a shared gram; negative without any gram."""
    return min(int(error * length), (length - q) // q)


def gram_hashes(b: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q bytes, by doubling."""
    by, done, out, have = b.astype(np.uint64), 1, None, 0
    power = 0x9E3779B97F4A7C15  # of the shift by ``done`` bytes
    while q:
        if q & done:
            out = by if out is None else out[: len(by) - have] * np.uint64(power) + by[have:] if len(by) > have else by[:0]
            have += done
            q -= done
        if q:
            by = by[:-done] * np.uint64(power) + by[done:] if len(by) > done else by[:0]
            power = power * power % 2**64
            done *= 2
    return out


def banded_edits(window: np.ndarray, text: np.ndarray, first: int, last: int, most: int) -> tuple[int, int] | None:
    """(edits, end) of the window's best stretch of text on diagonals first..last; None beyond ``most`` edits."""
    width = last - first + 1
    column, outside = np.arange(width), most + 1
    # row[c]: fewest edits of the window's first i bytes against a stretch that ends before text[first + i + c]
    row = np.where((first + column >= 0) & (first + column <= len(text)), 0, outside)
    for i, w in enumerate(window.tolist()):
        at = first + i + column
        inside = (at >= 0) & (at < len(text))
        step = row + ~(inside & (text[np.clip(at, 0, len(text) - 1)] == w))
        step = np.where(inside, step, outside)
        skip = np.append(row[1:], outside) + 1
        row = np.minimum(step, skip)
        row[(at + 1 < 0) | (at + 1 > len(text))] = outside
        row = np.minimum.accumulate(row - column) + column
        if row.min() > most:
            return None
    c = int(row.argmin())
    return int(row[c]), first + len(window) + c


@dataclass
class Index:
    """Windows of a block of items, and the items' grams sorted by hash."""

    items: np.ndarray
    starts: np.ndarray
    #: All texts one behind the other, and where in them the windows lie.
    text: np.ndarray
    at: np.ndarray
    size: np.ndarray
    budget: np.ndarray
    least: np.ndarray
    band: int
    #: Of the k-th text: its windows are first[k] to first[k + 1], and the smallest of their bounds.
    first: np.ndarray
    least_of: np.ndarray
    #: The texts with grams: where they begin in ``text``. Grams by half of their hash, and their places in ``text``.
    origin: np.ndarray
    hashes: np.ndarray
    begin: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray
    shift: int
    #: Items without a gram, by length with a blank at either end: sorted hashes, their windows' numbers.
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    def window(self, w: int) -> np.ndarray:
        return self.text[self.at[w] : self.at[w] + self.size[w]]


def build_index(items: list[tuple[int, bytes]], q: int = Q, error: float = ERROR, width: int = WINDOW) -> Index | None:
    ids, starts, at, size, first, origin, hashes, places = [], [], [], [], [0], [], [], []
    texts = [(item, normalised(text)) for item, text in items]
    offsets = np.append(0, np.cumsum([len(t) for _, t in texts])).tolist()
    for (item, text), offset in zip(texts, offsets, strict=False):
        for start, w in windows_of(text, width):
            if edit_budget(len(w), q, error) >= 0:
                ids.append(item)
                starts.append(start)
                at.append(offset + start)
                size.append(len(w))
        if len(ids) == first[-1]:
            continue
        h = gram_hashes(np.frombuffer(text, np.uint8), q)
        hashes.append((h >> np.uint64(32)).astype(np.uint32))
        places.append(np.arange(offset, offset + len(h), dtype=np.int32))
        origin.append(offset)
        first.append(len(ids))
    short: dict[int, list[tuple[int, int]]] = {}
    sizes = np.array(size, np.int64)
    for (item, text), offset in zip(texts, offsets, strict=False):
        if text and edit_budget(len(text), q, error) < 0:
            padded = np.frombuffer(b" " + text + b" ", np.uint8)
            short.setdefault(len(padded), []).append((int(gram_hashes(padded, len(padded))[0]), len(ids)))
            ids.append(item)
            starts.append(0)
            at.append(offset)
            size.append(len(text))
    if not ids:
        return None
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint32)
    place = np.concatenate(places) if places else np.zeros(0, np.int32)
    order = np.argsort(h, kind="stable")
    distinct, begin = np.unique(h[order], return_index=True)
    budget = np.array([edit_budget(n, q, error) for n in size[: len(sizes)]], np.int64)
    least = sizes - q + 1 - budget * q
    bits = max(16, min(26, int(len(distinct)).bit_length() + 3))
    bitmap = np.zeros(1 << bits, bool)
    shift = 32 - bits
    bitmap[_slot(distinct, shift)] = True
    bitmap = np.packbits(bitmap, bitorder="little")
    return Index(
        np.array(ids, np.int64), np.array(starts, np.int32), np.frombuffer(b"".join(t for _, t in texts), np.uint8), np.array(at, np.int64), np.array(size, np.int32),
        budget, least, 1 << int(budget.max(initial=0)).bit_length(), np.array(first), np.minimum.reduceat(least, first[:-1]) if len(least) else np.zeros(0, np.int64),
        np.array(origin, np.int64), distinct, np.append(begin, len(h)).astype(np.int32), place[order], bitmap, shift,
        {n: (np.array([x for x, _ in sorted(v)], np.uint64), np.array([w for _, w in sorted(v)])) for n, v in short.items()},
    )


def _slot(h: np.ndarray, shift: int) -> np.ndarray:
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(shift)


def shared_grams(text: np.ndarray, x: Index, q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexed texts, places in them and diagonals of all grams that the text shares with the index. Grams with equal halves of their hashes count as shared, which only raises counts."""
    found, places = [], []
    for at in range(0, max(1, len(text) - q + 1), CHUNK):
        h = (gram_hashes(text[at : at + CHUNK + q - 1], q) >> np.uint64(32)).astype(np.uint32)
        slot = _slot(h, x.shift)
        near = np.flatnonzero((x.bitmap[slot >> np.uint32(3)] >> (slot & np.uint32(7)).astype(np.uint8)) & np.uint8(1))
        k = np.searchsorted(x.hashes, h[near])
        k[k == len(x.hashes)] = 0
        same = x.hashes[k] == h[near]
        found.append(k[same])
        places.append(near[same] + at)
    gram, place = np.concatenate(found), np.concatenate(places)
    n = (x.begin[gram + 1] - x.begin[gram]).astype(np.int64)
    row = np.repeat(x.begin[gram] - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())
    there = x.place[row].astype(np.int64)
    owner = np.searchsorted(x.origin, there, side="right") - 1
    own = there - x.origin[owner]
    return owner, own, np.repeat(place, n) - own


def candidates(joined: np.ndarray, x: Index, q: int = Q) -> Iterator[tuple[int, int]]:
    """(window, first diagonal) of the bands that hold as many of a window's grams as its bound asks for."""
    if not len(x.hashes):
        return
    item, place, diagonal = shared_grams(joined, x, q)
    if not len(item):
        return
    # Bands are 2 * band wide and start at each multiple of band; a diagonal lies in two of them.
    lowest = int(diagonal.min()) // x.band - 1
    span = int(diagonal.max()) // x.band - lowest + 2
    key = item * span + diagonal // x.band - lowest
    key, place = np.concatenate([key, key - 1]), np.concatenate([place, place])
    keys, group, n = np.unique(key, return_inverse=True, return_counts=True)
    enough = n >= x.least_of[keys // span]
    if not enough.any():
        return
    row = np.flatnonzero(enough[group])
    row = row[np.lexsort((place[row], group[row]))]
    key, place = key[row], place[row]
    edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    size, starts = x.size, x.starts
    for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
        t, first = int(key[a]) // span, (int(key[a]) % span + lowest) * x.band
        ws = np.arange(x.first[t], x.first[t + 1])
        held = np.searchsorted(place[a:b], starts[ws] + size[ws] - q, side="right") - np.searchsorted(place[a:b], starts[ws])
        # diagonals of the window, which starts later than the item
        yield from ((w, first + int(x.starts[w])) for w in ws[held >= x.least[ws]].tolist())


def short_hits(texts: list[bytes], x: Index) -> Iterator[tuple[int, int, int]]:
    """(text, window, end) of every place where an item without a gram stands as whole words."""
    if not x.short:
        return
    ends = np.cumsum([len(t) + 3 for t in texts])
    padded = np.frombuffer(b"".join(b" " + t + b" \0" for t in texts), np.uint8)
    for n, (hashes, windows) in x.short.items():
        for at in range(0, len(padded), CHUNK):
            part = padded[at : at + CHUNK + n - 1]
            if len(part) < n:
                break
            h = gram_hashes(part, n)
            for i in np.flatnonzero(np.isin(h, hashes)).tolist():
                t = int(np.searchsorted(ends, at + i, side="right"))
                for k in range(int(np.searchsorted(hashes, h[i])), int(np.searchsorted(hashes, h[i], side="right"))):
                    w = int(windows[k])
                    if (part[i + 1 : i + n - 1] == x.window(w)).all() and part[i] == part[i + n - 1] == 0x20:
                        yield t, w, at + i + n - 2 - (int(ends[t]) - 3 - len(texts[t]))


def leaks(texts: list[bytes], x: Index, q: int = Q, every: bool = True) -> Iterator[tuple[int, int, int, int]]:
    """(text, window, edits, end) of every window that a text leaks, or only of one, once each; texts are normalised."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    joined = np.frombuffer(b"\0".join(texts), np.uint8)
    done = set()
    for t, w, end in short_hits(texts, x):
        one = (t, w) if every else t
        if one not in done:
            done.add(one)
            yield t, w, 0, end
    for w, first in candidates(joined, x, q):
        pattern, most = x.window(w), int(x.budget[w])
        low, high = first - most, first + 2 * x.band - 1 + most
        # The band may touch two texts that lie side by side.
        a = int(np.searchsorted(ends, max(0, low), side="right"))
        b = int(np.searchsorted(ends, max(0, min(high + len(pattern), len(joined) - 1)), side="right"))
        for t in range(a, min(b, len(texts) - 1) + 1):
            one = (t, w) if every else t
            if one in done or not texts[t]:
                continue
            begin = int(ends[t]) - 1 - len(texts[t])
            at = texts[t].find(pattern.tobytes(), max(0, low - begin), max(0, high - begin + len(pattern)))
            hit = (0, at + len(pattern)) if at >= 0 else banded_edits(pattern, joined[begin : begin + len(texts[t])], low - begin, high - begin, most)
            if hit:
                done.add(one)
                yield t, w, *hit


def _blocks(items: DataFrame, item_id: str) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of about half of BLOCK_BYTES; a longer item alone makes a longer block."""
    rows = items.select(F.col(item_id).cast("long").alias("item"), F.col("text").cast("string").alias("text")).dropna()
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-2 * size // BLOCK_BYTES))
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).orderBy("item", "text").collect()
        yield [(r["item"], r["text"].encode()) for r in block]


def packed(block: list[tuple[int, bytes]]) -> bytes:
    """A block as it is sent: ids and texts, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(block))


_LAST: dict[bytes, Index | None] = {}


def index_of(data: bytes) -> Index | None:
    """The index of a packed block; a worker keeps the last one it made for its next task."""
    key = xxhash.xxh3_128_digest(data)
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = build_index(pickle.loads(zstandard.ZstdDecompressor().decompress(data)))
    return _LAST[key]


SCHEMA = "doc_id long, item_id long, window_start long, window_length long, edits long, doc_end long"


def _pieces(texts: list[bytes], most: int) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``most`` bytes, each with the number of its first."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def find_leaks(docs: DataFrame, items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """A row for each document and leaked window: item, window, edits, and where in the normalised document it ends."""
    out = None
    rows = narrowed(docs.withColumn("doc_id", docs["doc_id"].cast("long")), "doc_id", "text")
    for block in _blocks(items, item_id):
        sent = docs.sparkSession.sparkContext.broadcast(packed(block))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            x = index_of(sent.value)
            for b in batches:
                found, ids = [], b.column("doc_id").to_pylist()
                texts = [normalised(t) for t in text_bytes(b.column("text"))] if x else []
                for first, part in _pieces(texts, CHUNK):
                    found += [(ids[first + t], int(x.items[w]), int(x.starts[w]), int(x.size[w]), edits, end) for t, w, edits, end in leaks(part, x)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [()] * 6)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        part = rows.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """The rows of docs, all columns, that leak no window."""
    for block in _blocks(items, item_id):
        sent = docs.sparkSession.sparkContext.broadcast(packed(block))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            x = index_of(sent.value)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for first, part in _pieces([normalised(t) for t in text_bytes(b.column("text"))] if x else [], CHUNK):
                    for t, *_ in leaks(part, x, every=False):
                        keep[first + t] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
