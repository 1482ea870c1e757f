"""Merkle manifest, min-max near-dedup and filter audit against plain versions."""

import hashlib
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import plain

from lodestrata.llm import filter_audit, merkle, minmax

# 11


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return hashlib.sha256(b"".join(b"-" if v is None else b"%d:" % len(x) + x for v in row for x in [str(v).encode()])).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def climb(tree, at, node):
    """Siblings of the node at a place of the lowest level, left to right and up; and where the node leads."""
    siblings = []
    for level in tree[:-1]:
        begin = at // 16 * 16
        run = level[begin : begin + 16]
        siblings += [d for i, d in enumerate(run) if begin + i != at]
        node = sha(*[node if begin + i == at else d for i, d in enumerate(run)])
        at //= 16
    return siblings, node


def manifest(rows, tampered):
    """rows: doc_id, source, lang, n_chars, text."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, (_, _, digest, r) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            changed = leaf((*r[:4], None if r[4] is None else plain.lower(r[4]))) if tampered(r) else digest
            low, node = climb(trees[s], at, changed)
            high, node = climb(top, k, node)
            out.append((r[0], digest, trees[s][-1][0], top[-1][0], sha(*low, *high), node, node == top[-1][0]))
    return Counter(out)


FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def fifth(row):
    return row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0


def by_crc():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


@pytest.mark.parametrize("n", [1, 16, 17, 300, 700])
def test_manifest(spark, n):
    """Trees of several heights: sources of one leaf, of a full run, of one more, and of hundreds; more sources than fit a run."""
    sources = [None, "", "a", "é", "Z", *[f"s{i:02}" for i in range(20)]]
    rows = [(i * 7 % 1009 if i % 50 else None, sources[1] if i < 290 else sources[i % len(sources)], ["en", None][i % 2], [None, i][i % 3 > 0], [None, "", "Some Text", "lower", "ÄÖ Ü"][i % 5]) for i in range(n)]
    rows += rows[:2]
    got = Counter(map(tuple, merkle.manifest(spark.createDataFrame(rows, FIELDS).repartition(3), by_crc()).collect()))
    assert got == manifest(rows, fifth)


def test_manifest_of_tricky_rows(spark, tricky, tricky_rows, empty, long, long_rows):
    shaped = lambda df: df.withColumn("n_chars", F.length("text").cast("long"))
    got = Counter(map(tuple, merkle.manifest(shaped(tricky), by_crc()).collect()))
    assert got == manifest([(i, "s", lang, None if t is None else len(t), t) for i, t, lang in tricky_rows], fifth)
    assert merkle.manifest(shaped(empty)).collect() == [] and merkle.manifest(shaped(empty)).columns == [x.split()[0] for x in merkle.RESULT.split(", ")]
    everyone = merkle.manifest(shaped(long).withColumn("source", F.lit(None).cast("string")), F.lit(True)).collect()
    assert Counter(map(tuple, everyone)) == manifest([(i, None, lang, len(t), t) for i, t, lang in long_rows], lambda r: True)


def test_manifest_tells_what_was_changed(spark):
    rows = [(i, "s", "en", 4, "Text" if i % 2 else "text") for i in range(100)]
    out = merkle.manifest(spark.createDataFrame(rows, FIELDS), F.col("doc_id") < 50).collect()
    assert all(r.verified == (r.doc_id >= 50 or r.doc_id % 2 == 0) for r in out) and len({r.root for r in out}) == 1


# 12


def shingle_set(text):
    words = plain.WHITE.findall(plain.lower(text or ""))
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))) if words else frozenset()


def near(rows):
    """doc_id, n_shingles, component_id, kept by all pairs."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [d for j, (d, _) in enumerate(rows) if find(j) == find(i) and d is not None]
        low = min(ids, default=None) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), low, doc_id == low))
    return Counter(out)


def test_minmax_dedup(spark, tricky, tricky_rows, empty):
    got = Counter(map(tuple, minmax.near_copies(tricky).collect()))
    assert got == near([(i, t) for i, t, _ in tricky_rows]) and minmax.near_copies(empty).collect() == []


def test_minmax_families(spark):
    """Chains of copies, families that are alike without a link, and pairs at the limit."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for family in range(12):
        text = list(rng.choice(words, 60 + 20 * family))
        for k in range(12):
            rows.append((len(rows) * 3 % 997, " ".join(text)))
            base = list(text)
            for at in rng.integers(0, len(text), 1 + k % 4):
                base[at] = rng.choice(words)
            rows.append((len(rows) * 3 % 997, " ".join(base)))
            if family % 2:
                text = base
    for m in (20, 40, 100):  # m shingles of which 0.85 * union are common, or one fewer
        text = list(rng.choice(words, m + 2, replace=False))
        for cut in range(1, m // 4):
            rows.append((10_000 + len(rows), " ".join(text[cut:])))
    want = near(rows)
    got = Counter(map(tuple, minmax.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == want and len({c for _, _, c, _ in want}) > 20


def test_minmax_of_long_texts(spark, long):
    out = {r.doc_id: r for r in minmax.near_copies(long).collect()}
    assert out[3].n_shingles == 0 and out[3].component_id == 3 and [out[i].component_id for i in (1, 2, 4, 5, 6)] == [1, 2, 4, 1, 1] and [out[i].kept for i in (1, 5)] == [True, False]


def test_signatures_and_parities():
    """Blocks don't matter, both ends estimate similarity, and bits of parity never differ in more places than sets."""
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 100_000, np.uint64)
    whole = minmax.signatures(np.concatenate([h, h[:10]]), np.array([100_000, 10]))
    assert (whole[1] == minmax.ends(h[:10], np.array([0]))[0]).all() and (whole[0] == minmax.ends(h, np.array([0]))[0]).all()
    for common in (300, 450, 490):
        shared, other = h[:common], h[common : common + 1000 - 2 * common]
        a, b = np.sort(np.concatenate([shared, other[: 500 - common]])), np.sort(np.concatenate([shared, other[500 - common :]]))
        x, y = (minmax.signatures(s, np.array([500]))[0] for s in (a, b))
        j = common / (1000 - common)
        assert abs((x == y).mean() - j) < 5 * (j * (1 - j) / 128) ** 0.5
        px, py = (minmax.parities(s, np.array([500]))[0] for s in (a, b))
        differ = int(np.bitwise_count((px ^ py).view(np.uint64)).sum())
        assert differ <= 1000 - 2 * common and differ > 0.7 * (1000 - 2 * common)


# 13


def fails(text):
    words = plain.WHITE.findall(text)
    out = "A" if len(words) < 200 else ""
    out += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    out += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text) else ""
    return out + ("D" if any(c in "#$%&*|" for c in text) else "")


def audit(rows, labels):
    """rows: doc_id, part, text; each document goes through each order."""
    first, good, toxic = {}, {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = [(p or "", fails(t or "") + ("E" if i is not None and i > first[t or ""] else ""), i in good, i in toxic) for i, p, t in rows]
    counts = {}
    for order in map("".join, permutations("ABCDE")):
        for k, letter in enumerate(order):
            for part in {p for p, *_ in docs}:
                here = [d for d in docs if d[0] == part]
                hit = [d for d in here if letter in d[1]]
                removed = [d for d in hit if not set(order[:k]) & set(d[1])]
                kept = sum(not set(order[: k + 1]) & set(d[1]) for d in here)
                counts[part, order, k + 1] = [kept, len(removed), len(hit) - len(removed), sum(d[1] == letter for d in hit), sum(d[2] for d in removed), sum(d[3] for d in removed)]
    total = Counter()
    for (part, order, step), c in counts.items():
        total[part, order[step - 1]] += c[1]
    return Counter((*key, *c, total[key[0], key[1][key[2] - 1]]) for key, c in counts.items())


def test_filter_audit(spark, tricky, tricky_rows, empty):
    rng = np.random.default_rng(3)
    ids = [i for i, _, _ in tricky_rows if i is not None]
    labels = [(int(i), q, x) for i in rng.choice(ids, 60) for q, x in [[(0, 0), (1, 0), (0, 1), (None, None)][int(rng.integers(4))]]] + [(None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(1))
    parts = [None, "", "x", "y"]
    rows = [(i, parts[k % 4], t) for k, (i, t, _) in enumerate(tricky_rows)] + [(500 + k, "z", " ".join(f"w{j % n}" for j in range(250))) for k, n in enumerate((250, 100, 250))]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, source string, text string, part string, mask int").repartition(3)
    got = Counter(map(tuple, filter_audit.filter_audit(docs, table).collect()))
    assert got == audit(rows, labels) and len(got) == 4 * 600
    assert filter_audit.filter_audit(empty, table).collect() == []
    assert filter_audit.filter_audit(docs, table.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_masks_of_long_texts(long_rows):
    for _, t, _ in long_rows:
        assert filter_audit.text_mask(t.encode()) == sum(filter_audit.BIT[c] for c in fails(t))
    for t in ["", "Ä" * 50 + "A", "Ä" * 49 + "A", "a" * 49 + "A", "a" * 48 + "A", "x #", "w " * 200, "a b " * 100, "a\x1cb " * 120]:
        assert filter_audit.text_mask(t.encode()) == sum(filter_audit.BIT[c] for c in fails(t))
